"""Read pairs to link matrices: filters, tallies, normalisation, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.functions.ordered import AT, PART, at_borders, dealt, met, within


def aligned(reads: DataFrame) -> DataFrame:
    """Reads whose flag does not say unmapped."""
    return reads.where(F.col("flag").bitwiseAND(4) == 0)


def aligned_pairs(reads: DataFrame) -> DataFrame:
    """Reads that are mapped and whose mate is."""
    return reads.where(F.col("flag").bitwiseAND(12) == 0)


def in_region(reads: DataFrame, tid: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Reads on a target with a position in the closed range."""
    kept = F.col("tid") == tid
    if start is not None:
        kept &= F.col("pos") >= start
    if end is not None:
        kept &= F.col("pos") <= end
    return reads.where(kept)


def names_match(first: Column, second: Column) -> Column:
    """Whether two read names are one pair's: equal, or one goes on from the other with no letter or digit."""

    def extends(short: Column, long: Column) -> Column:
        following = F.substring(long, F.length(short) + 1, F.lit(1))
        return long.startswith(short) & ~following.rlike("^[A-Za-z0-9]$") & (F.length(long) > F.length(short))

    return (first == second) | extends(first, second) | extends(second, first)


def consecutive_pairs(reads: DataFrame, name: str = "qname", order: str = "row_no", file: str = "file", parts: int | None = None) -> DataFrame:
    """Pairs of neighbouring reads of one file with matching names; a read is in one pair at most.

    Within a run of matching neighbours every other read starts a pair, as when
    reading front to back.  Files are scanned in ranges of their order: a range
    hands on its last name and how far into a run it ends, and takes its last
    read's mate from the range after it.
    """
    columns = [c for c in reads.columns if c != file]
    placed = dealt(reads, [file, order], parts)
    by_range, over_ranges = within([file]), Window.partitionBy(file).orderBy(PART)
    border = at_borders(placed, [file])
    ends = border.groupBy(PART, file).agg(F.max_by(name, AT).alias("__last"), F.min_by(F.struct(*columns), AT).alias("__first"))
    ends = ends.select(PART, file, F.lag("__last").over(over_ranges).alias("__before"), F.lead("__first").over(over_ranges).alias("__after"))
    place = F.row_number().over(by_range)
    before = F.when(place == 1, F.col("__before")).otherwise(F.lag(name).over(by_range))

    def mark(rows: DataFrame) -> DataFrame:
        return met(rows, ends, [file]).withColumn("__place", place).withColumn("__new", F.when(before.isNull() | ~names_match(before, F.col(name)), F.col("__place")))

    # by range: reads, where its last run starts (nowhere, if an earlier range's goes on through it), whether its first read starts one
    runs = mark(border).groupBy(PART, file).agg(F.count(F.lit(1)).alias("__n"), F.max("__new").alias("__start"), F.min_by("__new", AT).isNotNull().alias("__fresh"))
    runs = runs.withColumn("__length", F.when(F.col("__start").isNull(), F.col("__n")).otherwise(F.col("__n") - F.col("__start") + 1)).withColumn("__group", F.count("__start").over(over_ranges))
    runs = runs.withColumn("__sofar", F.sum("__length").over(Window.partitionBy(file, "__group").orderBy(PART)))
    runs = runs.select(PART, file, F.lag("__sofar").over(over_ranges).alias("__handed"), F.lead("__fresh").over(over_ranges).alias("__next_fresh"))
    joined = met(mark(placed), runs, [file])
    start = F.max("__new").over(by_range.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_run = F.when(start.isNull(), F.col("__handed") + F.col("__place")).otherwise(F.col("__place") - start + 1)
    following = F.lead(F.struct(*columns)).over(by_range)
    goes_on = F.when(F.lead("__place").over(by_range).isNotNull(), F.lead("__new").over(by_range).isNull()).otherwise(~F.col("__next_fresh"))
    mate = F.when(goes_on, F.coalesce(following, F.col("__after")))
    rows = joined.select(file, *columns, in_run.alias("__k"), mate.alias("__mate")).where((F.col("__k") % 2 == 1) & F.col("__mate").isNotNull())
    return rows.select(file, *[F.col(c).alias(f"{c}1") for c in columns], *[F.col(f"__mate.{c}").alias(f"{c}2") for c in columns])


def link_matrix(pairs: DataFrame) -> DataFrame:
    """``i, j, z``: links between contigs, both ways round.

    Each read of a pair with mapping quality above 0 adds a link to both cells.
    Pairs within a contig or at equal positions add none.  The unordered pair
    is summed before it is mirrored, which halves the shuffle.
    """
    return mirrored(half_matrix(pairs).withColumnsRenamed({"i": "a", "j": "b"}))


def half_matrix(pairs: DataFrame) -> DataFrame:
    """``i, j, z`` with ``i < j``: the upper triangle of :func:`link_matrix`, which is symmetric."""
    weight = (F.col("mapq1") > 0).cast("bigint") + (F.col("mapq2") > 0).cast("bigint")
    counted = pairs.where("pos1 <> pos2 and tid1 <> tid2 and (mapq1 > 0 or mapq2 > 0)")
    return counted.groupBy(F.least("tid1", "tid2").alias("i"), F.greatest("tid1", "tid2").alias("j")).agg(F.sum(weight).alias("z"))


def mirrored(half: DataFrame) -> DataFrame:
    """Both cells of each unordered pair ``a, b, z``."""
    ways = F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))
    return half.select(F.explode(ways).alias("c"), "z").select("c.i", "c.j", "z")


def edge_weights(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """``pairs`` with ``weight``: 2 for a link between two contigs' very ends, falling to 0 for one between their middles.

    A read's distance is the one to the nearer end of its contig; both together are set against half the contigs' length.
    """
    one, two = (contigs.select(F.col("tid").alias(f"tid{k}"), F.col("len").alias(f"len{k}")) for k in (1, 2))
    near = lambda k: F.least(F.col(f"pos{k}"), F.abs(F.col(f"len{k}") - F.col(f"pos{k}")))
    share = 2 * (near(1) + near(2)) / (F.col("len1") + F.col("len2")).cast("double")
    return pairs.join(one, "tid1").join(two, "tid2").withColumn("weight", 2 * (1 - share)).select(*pairs.columns, "weight")


def normalise(links: DataFrame, contigs: DataFrame, size: str = "re") -> DataFrame:
    """Links as if all contigs had the largest ``size``: ``trunc(z * max^2 / (size_i * size_j))``."""
    most = contigs.agg(F.max(size).cast("double").alias("most"))
    left = contigs.select(F.col("tid").alias("i"), F.col(size).cast("double").alias("si"))
    right = contigs.select(F.col("tid").alias("j"), F.col(size).cast("double").alias("sj"))
    scaled = links.join(left, "i").join(right, "j").crossJoin(F.broadcast(most))  # one row
    return scaled.select("i", "j", (F.col("z") * F.col("most") * F.col("most") / (F.col("si") * F.col("sj"))).cast("bigint").alias("z"))


def repeat_factor(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """``tid, factor``: a contig's links against the mean over all contigs."""
    sums = links.groupBy(F.col("i").alias("tid")).agg(F.sum("z").cast("double").alias("links"))
    mean = links.agg(F.sum("z").cast("double").alias("total")).crossJoin(contigs.agg(F.count(F.lit(1)).alias("n")))
    joined = contigs.select("tid").join(sums, "tid", "left").crossJoin(F.broadcast(mean))  # one row
    return joined.select("tid", (F.coalesce("links", F.lit(0.0)) / (F.col("total") / F.col("n"))).alias("factor"))


def density_corrected(links: DataFrame, factors: DataFrame) -> DataFrame:
    """Each row of the matrix divided by its own contig's factor and truncated; the result is not symmetric."""
    return links.join(factors.withColumnRenamed("tid", "i"), "i").select("i", "j", (F.col("z") / F.col("factor")).cast("bigint").alias("z"))


def skip_short(contigs: DataFrame, least: int) -> DataFrame:
    """``contigs`` with ``skip`` for those shorter than ``least``."""
    return contigs.withColumn("skip", F.col("len") < least)


def skipped_summary(marked: DataFrame) -> DataFrame:
    """How many contigs are skipped and their mean length, 0 if none."""
    return marked.where("skip").agg(F.count(F.lit(1)).alias("n_skipped"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))


def skip_few_sites(contigs: DataFrame, least: int) -> DataFrame:
    """``contigs`` with ``skip`` for those with fewer than ``least`` restriction sites (the count plus one)."""
    return contigs.withColumn("skip", F.col("re") < least)


def skip_repeats(links: DataFrame, contigs: DataFrame, multiplicity: float) -> DataFrame:
    """``tid, factor, skip`` for contigs whose factor reaches ``multiplicity``."""
    return repeat_factor(links, contigs).withColumn("skip", F.col("factor") >= multiplicity)


def binned_links(pairs: DataFrame, bin_size: int) -> DataFrame:
    """``chrom, bin1, bin2, z``: links between fixed-size bins of one target, the first at or before the second."""
    kept = pairs.where("pos1 <> pos2 and pos1 <= pos2 and mapq1 > 0 and mapq2 > 0 and tid1 = tid2")
    binned = kept.select(F.col("tid1").alias("chrom"), F.floor(F.col("pos1") / bin_size).alias("bin1"), F.floor(F.col("pos2") / bin_size).alias("bin2"))
    return binned.where("bin1 <> bin2").groupBy("chrom", "bin1", "bin2").agg(F.count(F.lit(1)).alias("z"))


def filter_funnel(pairs: DataFrame, least: int = 4096) -> DataFrame:
    """Pairs left after each filter of the link-size distribution."""
    good = (F.col("mapq1") > 0) & (F.col("mapq2") > 0)
    inside = good & (F.col("tid1") == F.col("tid2"))
    far = inside & (F.abs(F.col("pos1") - F.col("pos2")) >= least)
    return pairs.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("good"), F.count_if(inside).alias("intra"), F.count_if(far).alias("far"))


def flagstat(reads: DataFrame) -> DataFrame:
    """Counts of reads in all, mapped, and with a mapping quality."""
    mapped = F.col("flag").bitwiseAND(4) == 0
    return reads.agg(F.count(F.lit(1)).alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(mapped & (F.col("mapq") > 0)).alias("good"))


def target_coverage(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """``tid, hits, coverage``: reads of each contig, and per base."""
    counts = reads.groupBy("tid").agg(F.count(F.lit(1)).alias("hits"))
    joined = contigs.select("tid", "len").join(counts, "tid", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))
    return joined.select("tid", "hits", (F.col("hits") / F.col("len")).alias("coverage"))


def mappability(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """``tid, mappability``: the share of a contig's reads with a mapping quality above 0; 0 without reads."""
    counts = reads.groupBy("tid").agg(F.count_if(F.col("mapq") > 0).alias("good"), F.count(F.lit(1)).alias("n"))
    joined = contigs.select("tid").join(counts, "tid", "left")
    return joined.select("tid", (F.coalesce("good", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("mappability"))


def candidate_edges(links: DataFrame, above: int = 0) -> DataFrame:
    """The matrix's upper triangle above a weight: all pairs that clustering may start from, without listing the empty ones."""
    return links.where((F.col("i") < F.col("j")) & (F.col("z") > above))


def contigs_used(links: DataFrame, contigs: DataFrame, flag_adjacent: bool = True) -> DataFrame:
    """``tid, used``: contigs that have links; with ``flag_adjacent`` a contig without any also bars its neighbours by number.

    A single contig is used whatever it has.
    """
    linked = links.select(F.col("i").alias("tid")).distinct().withColumn("linked", F.lit(True))
    marked = contigs.select("tid").join(linked, "tid", "left").select("tid", F.coalesce("linked", F.lit(False)).alias("linked"))
    used = F.col("linked")
    if flag_adjacent:
        # neighbours are looked up by number, so no task has to see all contigs in order
        empty = marked.where("not linked").select(F.explode(F.array(F.col("tid") - 1, F.col("tid") + 1)).alias("tid")).distinct().withColumn("barred", F.lit(True))
        marked = marked.join(empty, "tid", "left")
        used = used & F.col("barred").isNull()
    single = contigs.agg((F.count(F.lit(1)) == 1).alias("single"))
    return marked.crossJoin(F.broadcast(single)).select("tid", (used | F.col("single")).alias("used"))


def group_links(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs with both qualities above 0 whose contigs are in one cluster, with the contigs' places in it."""
    places = local_ids(clusters)
    one = places.select(F.col("tid").alias("tid1"), F.col("cluster_id"), F.col("local_id").alias("c1"))
    two = places.select(F.col("tid").alias("tid2"), F.col("cluster_id"), F.col("local_id").alias("c2"))
    good = pairs.where("mapq1 > 0 and mapq2 > 0")
    return good.join(one, "tid1").join(two, ["tid2", "cluster_id"]).select("cluster_id", "c1", "c2", "pos1", "pos2", "tid1", "tid2")


def local_ids(clusters: DataFrame) -> DataFrame:
    """``cluster_id, tid, local_id``: the rank of a contig in its cluster, from 0."""
    return clusters.select("cluster_id", "tid", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("tid")) - 1).cast("bigint").alias("local_id"))


def oriented_distances(grouped: DataFrame, contigs: DataFrame, offset: int = 100) -> DataFrame:
    """``cluster_id, c1, rc1, c2, rc2, dist``: the distances of a link for all orientations, both ways round.

    The distance of a read to the end that faces the other contig is counted on
    either side, plus ``offset``; links within a contig have none.
    """
    size = contigs.select("tid", F.col("len"))
    joined = grouped.where("c1 <> c2").join(size.withColumnsRenamed({"tid": "tid1", "len": "len1"}), "tid1").join(size.withColumnsRenamed({"tid": "tid2", "len": "len2"}), "tid2")
    fw1, rc1 = F.col("len1") - F.col("pos1"), F.col("pos1")  # what lies after the read when c1 stands first
    fw2, rc2 = F.col("pos2"), F.col("len2") - F.col("pos2")

    def cell(a, ra, b, rb, distance):
        return F.struct(a.alias("c1"), F.lit(ra).alias("rc1"), b.alias("c2"), F.lit(rb).alias("rc2"), (distance + offset).alias("dist"))

    one, two = F.col("c1"), F.col("c2")
    cells = []
    for r1, d1 in ((False, fw1), (True, rc1)):
        for r2, d2 in ((False, fw2), (True, rc2)):
            cells.append(cell(one, r1, two, r2, d1 + d2))
            cells.append(cell(two, not r2, one, not r1, d1 + d2))
    return joined.select("cluster_id", F.explode(F.array(*cells)).alias("cell")).select("cluster_id", "cell.*")


def has_links(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster_id, has_links``: whether any two contigs of a cluster have a link, both taken as they are."""
    forward = cells.where("not rc1 and not rc2 and c1 < c2").select("cluster_id").distinct().withColumn("has_links", F.lit(True))
    return clusters.select("cluster_id").distinct().join(forward, "cluster_id", "left").withColumn("has_links", F.coalesce("has_links", F.lit(False)))


def group_repeat_factors(cells: DataFrame, clusters: DataFrame, contigs: DataFrame) -> DataFrame:
    """``cluster_id, local_id, factor``: links of a contig within its cluster against the mean of the cluster.

    Links count with the whole-number ratios of the cluster's largest site count to both contigs'.
    """
    sized = local_ids(clusters).join(contigs.select("tid", "re"), "tid").select("cluster_id", "local_id", "re")
    size = sized.groupBy("cluster_id").agg(F.max("re").alias("most"), F.count(F.lit(1)).alias("n_contigs"))
    counts = cells.where("not rc1 and not rc2").groupBy("cluster_id", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    for k in ("1", "2"):
        counts = counts.join(sized.select("cluster_id", F.col("local_id").alias(f"c{k}"), F.col("re").alias(f"re{k}")), ["cluster_id", f"c{k}"])
    counts = counts.join(size, "cluster_id").withColumn("n", F.expr("n * (most div re1) * (most div re2)"))
    each = counts.select("cluster_id", F.explode(F.array("c1", "c2")).alias("local_id"), "n").groupBy("cluster_id", "local_id").agg(F.sum("n").alias("n"))
    total = counts.groupBy("cluster_id").agg(F.sum("n").cast("double").alias("total"))
    joined = sized.join(size, "cluster_id").join(total, "cluster_id").join(each, ["cluster_id", "local_id"], "left")
    return joined.select("cluster_id", "local_id", (F.coalesce("n", F.lit(0)) / (2 * F.col("total") / F.col("n_contigs"))).alias("factor"))
