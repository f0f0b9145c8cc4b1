"""The whole run: reads to clusters, clusters to orderings, orderings to a report and scaffolds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.operators import agglomeration, clusters, links, orderings, trees


@dataclass(frozen=True)
class Parameters:
    """What the steps are steered by; see the INI's keys."""

    n_clusters: int
    min_sites: int = 25
    max_density: float = 2.0
    noninformative_ratio: float = 3.0
    trunk_sites: int = 15
    shred_sites: int = 15
    quality: float = 0.0
    excluded_groups: tuple[int, ...] = ()


def cluster(pairs: DataFrame, contigs: DataFrame, p: Parameters, anchors: DataFrame | None = None) -> DataFrame:
    """``cluster_id, tid``: contigs grouped by average linkage, uninformative ones added, the largest group first.

    Contigs with few sites, and repeats, take no part in the merging.
    """
    matrix = links.normalise(links.link_matrix(pairs), contigs)
    factors = links.skip_repeats(matrix, contigs, p.max_density)
    corrected = links.density_corrected(matrix, factors.where("factor > 0").select("tid", "factor"))
    enough = links.skip_few_sites(contigs, p.min_sites).where("not skip").select("tid")
    informative = enough.join(factors.where("not skip").select("tid"), "tid")
    grouped = agglomeration.cluster_contigs(corrected, informative, p.n_clusters, anchors=anchors)
    grouped = clusters.without_singletons(grouped)
    if p.noninformative_ratio:
        added = clusters.assign_noninformative(corrected, grouped, contigs, p.noninformative_ratio)
        grouped = grouped.unionByName(added)
    numbers = clusters.canonical(grouped, contigs)
    return grouped.join(numbers, grouped.cluster_id == numbers.old_id).select(F.col("new_id").cast("int").alias("cluster_id"), "tid")


def order(pairs: DataFrame, groups: DataFrame, contigs: DataFrame, p: Parameters) -> DataFrame:
    """``cluster_id, kind, pos, tid, rc, q``: trunks and full orders of all groups, oriented."""
    cells = links.oriented_distances(links.group_links(pairs, groups), contigs)
    placed = trees.group_orderings(cells, groups, contigs, p.trunk_sites, p.shred_sites)
    return placed.join(links.local_ids(groups), ["cluster_id", "local_id"]).select("cluster_id", "kind", "pos", "tid", "rc", "q")


def evaluate(ordered: DataFrame, groups: DataFrame, contigs: DataFrame, truth: DataFrame, p: Parameters) -> dict[str, DataFrame]:
    """The report's tables by name."""
    full = orderings.excluding_groups(ordered.where("kind = 'full'"), list(p.excluded_groups)).drop("kind")
    flags = orderings.error_flags(full, truth, p.quality)
    return {
        "totals": clusters.cluster_totals(groups, contigs),
        "misclustered": clusters.misclustered(groups, contigs, truth),
        "usage": orderings.usage(flags, groups, contigs),
        "errors": orderings.error_chart(flags, contigs),
        "chart": orderings.cluster_chart(flags, groups, contigs),
    }


def report_text(tables: dict[str, DataFrame]) -> str:
    """The tables as fixed-width text."""
    parts = []
    for name, table in tables.items():
        rows = [[("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)) for v in r] for r in table.collect()]
        widths = [max(map(len, column)) for column in zip(table.columns, *rows, strict=True)]
        show = lambda cells, widths=widths: " | ".join(c.rjust(w) for c, w in zip(cells, widths, strict=True))
        parts.append("\n".join([name.upper(), show(table.columns), "-+-".join("-" * w for w in widths), *map(show, rows)]))
    return "\n\n".join(parts) + "\n"
