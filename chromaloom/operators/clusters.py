"""Clusterings as relations: summaries, densities, linkages, assignment, order of clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.functions.numbers import sum_of_product_residues
from chromaloom.functions.ordered import ranked


def cluster_summary(clusters: DataFrame, contigs: DataFrame) -> DataFrame:
    """``cluster_id, n, len, share``: members, bases, and the share of all bases in clusters of its kind."""
    total = contigs.agg(F.sum("len").cast("double").alias("all_len"))
    sums = clusters.join(contigs, "tid").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"))
    return sums.crossJoin(F.broadcast(total)).select("cluster_id", "n", "len", (F.col("len") / F.col("all_len")).alias("share"))


def cluster_totals(clusters: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row: clusters, singletons, clustered contigs and bases, and what share of all they are."""
    sizes = cluster_summary(clusters, contigs)
    found = sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.sum("n").alias("n_clustered"), F.sum("len").alias("len_clustered"))
    every = contigs.agg(F.count(F.lit(1)).alias("n_all"), F.sum("len").alias("len_all"))
    return found.crossJoin(every).select("n_clusters", "n_singletons", "n_clustered", "len_clustered", (F.col("n_clustered") / F.col("n_all")).alias("share_n"), (F.col("len_clustered") / F.col("len_all")).alias("share_len"))


#: A pair of contigs weighs the product of their lengths, without its last bits.
WEIGHT_BITS = 20


def _pair_weights(sized: DataFrame, keys: list[str]) -> DataFrame:
    """One row, ``w``: the weights of all ordered pairs within the groups of ``keys`` (all contigs without keys), a contig with itself too.

    The sum of the whole parts of products over a power of two follows from the
    square of the sum and the products' residues, which depend on the residues
    of the lengths only; a group has no more of them than that power.
    """
    whole = 1 << WEIGHT_BITS
    residues = sized.groupBy(*keys, (F.col("len") % whole).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"))
    grouped = residues.withColumn("__all", F.lit(0)).groupBy("__all", *keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        length = sum(map(int, rows["len"]))
        return pd.DataFrame({"w": [length * length - sum_of_product_residues(rows["r"].to_numpy(), rows["n"].to_numpy(), WEIGHT_BITS) >> WEIGHT_BITS]})

    return grouped.applyInPandas(run, "w long").agg(F.sum("w").alias("w"))


def enrichment(links: DataFrame, clusters: DataFrame, contigs: DataFrame, half: bool = False) -> DataFrame:
    """``intra_density, inter_density, enrichment`` over all ordered pairs of clustered contigs, each with itself too.

    Only pairs with links are listed, for the numerators; the weights of all
    pairs are summed from residues of lengths.  With ``half`` the links are one
    triangle of a symmetric matrix, whose cells count twice.
    """
    sized = clusters.join(contigs, "tid").select("tid", "cluster_id", "len")
    one = sized.select(F.col("tid").alias("i"), F.col("cluster_id").alias("ci"), F.col("len").alias("li"))
    two = sized.select(F.col("tid").alias("j"), F.col("cluster_id").alias("cj"), F.col("len").alias("lj"))
    weight = F.call_function("shiftright", F.col("li") * F.col("lj"), F.lit(WEIGHT_BITS))
    linked = links.join(one, "i").join(two, "j").select((F.col("ci") == F.col("cj")).alias("same"), weight.alias("w"), "z")
    top = linked.groupBy("same").agg((F.sum(F.col("w") * F.col("z")) * (2 if half else 1)).cast("double").alias("wz"))
    everywhere, within = _pair_weights(sized, []).withColumnRenamed("w", "w_all"), _pair_weights(sized, ["cluster_id"]).withColumnRenamed("w", "w_in")
    sums = top.agg(F.coalesce(F.sum(F.when(F.col("same"), F.col("wz"))), F.lit(0.0)).alias("in"), F.coalesce(F.sum(F.when(~F.col("same"), F.col("wz"))), F.lit(0.0)).alias("out"))
    joined = sums.crossJoin(everywhere).crossJoin(within)  # one row each
    intra, inter = F.col("in") / F.col("w_in"), F.col("out") / (F.col("w_all") - F.col("w_in"))
    return joined.select(intra.alias("intra_density"), inter.alias("inter_density"), (intra / inter).alias("enrichment"))


def contig_enrichment_ratio(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """``tid, ratio``: mean links to other members of its cluster against mean links to members of other clusters."""
    size = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    total = clusters.agg(F.count(F.lit(1)).alias("total"))
    ci, cj = (clusters.select(F.col("tid").alias(x), F.col("cluster_id").alias(f"c{x}")) for x in "ij")
    sums = links.join(ci, "i").join(cj, "j").groupBy(F.col("i").alias("tid")).agg(
        F.sum(F.when(F.col("ci") == F.col("cj"), F.col("z")).otherwise(0)).alias("zi"), F.sum(F.when(F.col("ci") != F.col("cj"), F.col("z")).otherwise(0)).alias("zo")
    )
    joined = clusters.join(size, "cluster_id").join(sums, "tid", "left").crossJoin(F.broadcast(total))
    inside = F.coalesce("zi", F.lit(0)) / F.nullif(F.col("n") - 1, F.lit(0))
    outside = F.coalesce("zo", F.lit(0)) / F.nullif(F.col("total") - F.col("n"), F.lit(0))
    return joined.select("tid", (inside / F.nullif(outside, F.lit(0.0))).alias("ratio"))


def plurality(clusters: DataFrame, contigs: DataFrame, truth: DataFrame) -> DataFrame:
    """``cluster_id, chrom, len``: the chromosome that holds most bases of a cluster; ties go to the lowest."""
    summed = clusters.join(contigs, "tid").join(truth.select("tid", "chrom"), "tid").where("chrom is not null").groupBy("cluster_id", "chrom").agg(F.sum("len").alias("len"))
    best = Window.partitionBy("cluster_id").orderBy(F.desc("len"), "chrom")
    return summed.withColumn("k", F.row_number().over(best)).where("k = 1").select("cluster_id", "chrom", "len")


def misclustered(clusters: DataFrame, contigs: DataFrame, truth: DataFrame) -> DataFrame:
    """``cluster_id, n_bad, len_bad``: aligned members that are on another chromosome than their cluster's plurality."""
    best = plurality(clusters, contigs, truth).select("cluster_id", F.col("chrom").alias("best"))
    members = clusters.join(contigs, "tid").join(truth.select("tid", "chrom"), "tid").where("chrom is not null").join(best, "cluster_id")
    bad = F.col("chrom") != F.col("best")
    return members.groupBy("cluster_id").agg(F.count_if(bad).alias("n_bad"), F.coalesce(F.sum(F.when(bad, F.col("len"))), F.lit(0)).alias("len_bad"))


def linkage(links: DataFrame, clusters: DataFrame, tids: DataFrame) -> DataFrame:
    """``tid, cluster_id, linkage, k``: mean links of a contig to the members of each cluster that it has links to, ranked; ties by cluster.

    Clusters without a link have linkage 0 and rank below; they have no row, so
    the rows grow with the links.
    """
    sums = links.where("z > 0").join(tids.select(F.col("tid").alias("i")), "i", "left_semi").join(clusters.select(F.col("tid").alias("j"), "cluster_id"), "j").groupBy(F.col("i").alias("tid"), "cluster_id").agg(F.sum("z").alias("z"))
    size = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    scored = sums.join(size, "cluster_id").select("tid", "cluster_id", (F.col("z") / F.col("n")).alias("linkage"))
    return scored.withColumn("k", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("linkage"), "cluster_id")).cast("bigint"))


def assign_noninformative(links: DataFrame, clusters: DataFrame, contigs: DataFrame, ratio: float) -> DataFrame:
    """``tid, cluster_id`` for contigs outside all clusters whose best linkage is ``ratio`` times the second.

    All are decided before any is assigned.  If the second is 0 the best need
    only be above 0.  Only clusters with a link to a contig are looked at, since
    the others rank below.
    """
    outside = contigs.select("tid").join(clusters.select("tid"), "tid", "left_anti")
    size = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    sums = links.join(outside.select(F.col("tid").alias("i")), "i", "left_semi").join(clusters.select(F.col("tid").alias("j"), "cluster_id"), "j").groupBy(F.col("i").alias("tid"), "cluster_id").agg(F.sum("z").alias("z"))
    scored = sums.join(size, "cluster_id").select("tid", "cluster_id", (F.col("z") / F.col("n")).alias("linkage"))
    by_rank = Window.partitionBy("tid").orderBy(F.desc("linkage"), "cluster_id")
    ranked = scored.select("*", F.row_number().over(by_rank).alias("k"), F.lead("linkage").over(by_rank).alias("second"))
    second = F.coalesce("second", F.lit(0.0))
    return ranked.where((F.col("k") == 1) & (F.col("linkage") > 0) & ((second == 0) | (F.col("linkage") / second >= ratio))).select("tid", "cluster_id")


def canonical(clusters: DataFrame, contigs: DataFrame) -> DataFrame:
    """``old_id, new_id``: clusters numbered by falling length; ties by the old number."""
    sums = clusters.join(contigs, "tid").groupBy(F.col("cluster_id").alias("old_id")).agg(F.sum("len").alias("len"))
    return ranked(sums, [F.desc("len"), "old_id"], "new_id").select("old_id", "new_id")


def sorted_members(clusters: DataFrame) -> DataFrame:
    """``cluster_id, members``: each cluster as a sorted array."""
    return clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_set("tid")).alias("members"))


def sort_by_median(clusters: DataFrame) -> DataFrame:
    """``cluster_id, median, new_id``: clusters by the upper median of their sorted members; ties by number."""
    medians = sorted_members(clusters).select("cluster_id", F.col("members")[F.floor(F.size("members") / 2).cast("int")].alias("median"))
    return ranked(medians, ["median", "cluster_id"], "new_id")


def sort_by_smallest(clusters: DataFrame) -> DataFrame:
    """``cluster_id, new_id``: clusters in the lexicographic order of their sorted members."""
    # a contig is in one cluster, so the least members tell clusters apart
    least = clusters.groupBy("cluster_id").agg(F.min("tid").alias("first"))
    return ranked(least, ["first"], "new_id").select("cluster_id", "new_id")


def without_singletons(clusters: DataFrame) -> DataFrame:
    """Clusters of more than one member."""
    size = F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))
    return clusters.withColumn("__n", size).where("__n > 1").drop("__n")


def cluster_lines(clusters: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``cluster_id, line``: members by rising number, tab-separated, as numbers or names."""
    rows = clusters.select("cluster_id", "tid")
    if names is not None:
        rows = rows.join(names.select("tid", "name"), "tid")
    grouped = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("tid", *(["name"] if names is not None else [])))).alias("members"))
    field = "name" if names is not None else "tid"
    return grouped.select("cluster_id", F.array_join(F.transform("members", lambda m: m[field].cast("string")), "\t").alias("line"))


def dense_ids(clusters: DataFrame) -> DataFrame:
    """Clusters numbered by their least member, as sets come up when contigs are read in order."""
    first = clusters.groupBy("cluster_id").agg(F.min("tid").alias("first"))
    numbered = ranked(first, ["first"], "new_id").select("cluster_id", "new_id")
    return clusters.join(numbered, "cluster_id").select("tid", F.col("new_id").alias("cluster_id"))
