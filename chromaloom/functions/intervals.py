"""Half-open chromosome intervals: algebra on columns, and joins, merges and lookups on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.functions.ordered import AT, PART, at_borders, dealt, earlier, met, running_sum, within

#: Bins are nested: the finest hold 2 ** FINEST bases, those of each level above 2 ** STEP times as many, the top everything.
FINEST, STEP, TOP = 12, 3, 17
#: Intervals of one bin that a task holds at once.
SLICE = 1024


def contains_point(start: Column, stop: Column, p: Column) -> Column:
    return (p >= start) & (p < stop)


def contains(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether [a, b) holds [c, d)."""
    return (c >= a) & (d <= b)


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two intervals of a chromosome share a base."""
    return (a < d) & (c < b)


def abuts(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two intervals touch without sharing a base."""
    return (a == d) | (c == b)


def distance(same: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Bases between two intervals; 0 if they overlap or abut, -1 on different chromosomes."""
    return F.when(~same, -1).otherwise(F.greatest(F.greatest(a, c) - F.least(b, d), F.lit(0)))


def intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The shared region as a struct, null if there is none."""
    return F.when(overlaps(a, b, c, d), F.struct(F.greatest(a, c).alias("start"), F.least(b, d).alias("stop")))


def union(a: Column, b: Column, c: Column, d: Column, gap: bool) -> Column:
    """The region that both span as a struct; without ``gap`` null unless they overlap or abut."""
    both = F.struct(F.least(a, c).alias("start"), F.greatest(b, d).alias("stop"))
    return both if gap else F.when(overlaps(a, b, c, d) | abuts(a, b, c, d), both)


def extended(a: Column, b: Column, p: Column) -> Column:
    """The interval stretched to a point, whose end becomes the point itself."""
    return F.struct(F.least(a, p).alias("start"), F.greatest(b, p).alias("stop"))


def as_text(chrom: Column, a: Column, b: Column) -> Column:
    """``chr:a-b``."""
    return F.concat(chrom, F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string"))


def as_dashed(chrom: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("-", chrom, a.cast("string"), b.cast("string"))


def as_bed(chrom: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("\t", chrom, a.cast("string"), b.cast("string"))


def parsed(text: Column) -> Column:
    """``chr:a-b`` or a tab-separated line as a struct; null if it is neither or the start lies after the stop."""
    pattern = r"^([^:\t]+)[:\t](\d+)[-\t](\d+)"
    start, stop = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("bigint") for k in (2, 3))
    return F.when(start <= stop, F.struct(F.regexp_extract(text, pattern, 1).alias("chrom"), start.alias("start"), stop.alias("stop")))


def _level(a: Column, b: Column) -> Column:
    """The finest level with a bin that holds [a, b) whole."""
    differing = a.cast("long").bitwiseXOR((b - 1).cast("long"))
    bits = F.when(differing == 0, 0).otherwise(F.length(F.bin(differing)))
    return F.least(F.greatest(F.ceil((bits - FINEST) / STEP), F.lit(0)), F.lit(TOP)).cast("int")


def _bin(place: Column, level: Column) -> Column:
    return F.when(level >= TOP, F.lit(0)).otherwise(F.call_function("shiftright", place.cast("long"), level * STEP + FINEST)).cast("long")


def placed_in_bins(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows``, each once, with ``__level`` and ``__bin``: the smallest of the nested bins that holds the interval; empty intervals go."""
    kept = rows.where(F.col(a) < F.col(b)).withColumn("__level", _level(F.col(a), F.col(b)))
    return kept.withColumn("__bin", _bin(F.col(a), F.col("__level")))


def _levels(placed: DataFrame) -> DataFrame:
    """The levels that occur, a row for each: TOP + 1 at most."""
    return placed.select(F.col("__level").alias("__above")).distinct()


def _raised(placed: DataFrame, levels: DataFrame, a: str, own: bool) -> DataFrame:
    """Rows at the bins above theirs, of the levels that the other side has; with ``own`` at their own bin too."""
    higher = F.col("__above") >= F.col("__level") if own else F.col("__above") > F.col("__level")
    up = placed.join(F.broadcast(levels), higher)
    return up.withColumn("__bin", _bin(F.col(a), F.col("__above"))).withColumn("__level", F.col("__above")).drop("__above")


def _sliced(rows: DataFrame, keys: list[str], a: str, b: str, ident: str, parts: int | None) -> DataFrame:
    """``rows`` in order of place, with ``__slice``: of a bin, ``SLICE`` rows in a row at most are of one slice."""
    placed = dealt(rows, [*keys, a, b, ident], parts)
    return placed.withColumn("__slice", F.col(PART).cast("long") * (1 << 33) + F.floor(F.col(AT) / SLICE)).drop(PART, AT)


def overlap_join(left: DataFrame, right: DataFrame, chrom: str, parts: int | None = None) -> DataFrame:
    """Overlapping pairs of ``left`` (``id1, a1, b1``) and ``right`` (``id2, a2, b2``) with their shared region.

    An interval has one bin of its own, however long it is, and overlapping ones
    have bins of which one holds the other.  So the rows of either side meet
    those of the other at the bins above them; a pair does so once.  Bins can
    hold any number of intervals: those of ``right`` are cut into slices in
    order of place, and a row of ``left`` goes to the slices that it reaches.
    So a task holds one slice at a time, and the rows of a crowded bin are
    dealt to many tasks.
    """
    one, two = (placed_in_bins(rows.where(F.col(chrom).isNotNull()), a, b) for rows, a, b in ((left, "a1", "b1"), (right, "a2", "b2")))
    keys = [chrom, "__raised", "__level", "__bin"]
    # either the right row is raised to the bin of the left one, or the left row to one further up
    lefts = one.withColumn("__raised", F.lit("right")).unionByName(_raised(one, _levels(two), "a1", False).withColumn("__raised", F.lit("left")))
    rights = _raised(two, _levels(one), "a2", True).withColumn("__raised", F.lit("right")).unionByName(two.withColumn("__raised", F.lit("left")))
    slices = _sliced(rights, keys, "a2", "b2", "id2", parts)
    reach = slices.groupBy(*keys, "__slice").agg(F.min("a2").alias("__from"), F.max("b2").alias("__to"))
    # in order of place too: rows with equal neighbours follow each other in the result, which a columnar file holds in less space
    sent = dealt(lefts, [*keys, "a1", "b1", "id1"], parts).drop(PART, AT).join(reach, keys).where(overlaps(F.col("a1"), F.col("b1"), F.col("__from"), F.col("__to"))).drop("__from", "__to")
    pairs = sent.join(slices, [*keys, "__slice"]).where(overlaps(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2")))
    return pairs.withColumn("start", F.greatest("a1", "a2")).withColumn("stop", F.least("b1", "b2")).drop("__raised", "__level", "__bin", "__slice")


def point_lookup(points: DataFrame, calls: DataFrame, chrom: str, parts: int | None = None) -> DataFrame:
    """``points`` with the value of the first call that holds the point, -1 without one; of calls with one start the shorter is first.

    In order, a call is the first to hold any point only if it ends beyond all
    calls before it, and then from the furthest of those ends on.  These
    stretches do not overlap, so the last one begun before a point decides,
    however many calls lie over it: two ordered scans, no join.
    """
    keys = [chrom]
    placed = dealt(calls.where((F.col("a") < F.col("b")) & F.col(chrom).isNotNull()).select(chrom, "a", "b", "cn"), [chrom, "a", "b", "cn"], parts)
    reach = at_borders(placed, keys).groupBy(PART, *keys).agg(F.max("b").alias("__b"))
    reach = reach.select(PART, *keys, F.max("__b").over(earlier(keys)).alias("__reach"))
    before = F.greatest(F.max("b").over(within(keys).rowsBetween(Window.unboundedPreceding, -1)), F.col("__reach"))
    firsts = met(placed, reach, keys).withColumn("__before", before).where(F.col("__before").isNull() | (F.col("b") > F.col("__before")))
    stretches = firsts.select(chrom, F.greatest("a", "__before").alias("pos"), F.lit(False).alias("__point"), F.lit(None).cast(points.schema["pid"].dataType).alias("pid"), F.struct(F.col("b").alias("stop"), "cn").alias("__held"))
    asked = points.select(chrom, "pos", F.lit(True).alias("__point"), "pid", F.lit(None).cast(stretches.schema["__held"].dataType).alias("__held"))
    both = dealt(stretches.unionByName(asked), [chrom, "pos", "__point", "pid"], parts)
    last = at_borders(both, keys).where("__held is not null").groupBy(PART, *keys).agg(F.max_by("__held", AT).alias("__last"))
    # a range without stretches hands on nothing of its own
    ranges = at_borders(both, keys).select(PART, *keys).distinct()
    handed = met(ranges, last, keys).select(PART, *keys, F.last("__last", True).over(earlier(keys)).alias("__handed"))
    own = F.last("__held", True).over(within(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = met(both.withColumn("__own", own).where("__point"), handed, keys).withColumn("__held", F.coalesce("__own", "__handed"))
    held = F.when(F.col("pos") < F.col("__held.stop"), F.col("__held.cn"))
    return found.select("pid", chrom, "pos", F.coalesce(held, F.lit(-1)).alias("cn"))


def merged(rows: DataFrame, chrom: str, a: str, b: str, gap: int = 0, same: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Islands of intervals that overlap or lie ``gap`` bases apart at most; with ``same`` only of equal values.

    An ordered scan over ranges: a range hands on the greatest end so far and
    the start of the island that is open, so one chromosome takes many tasks.
    """
    keys = [chrom, *(same or [])]
    # of intervals with one start the longest decides
    starts = rows.groupBy(*keys, F.col(a).alias("__a")).agg(F.max(b).alias("__b"), F.count(F.lit(1)).alias("__n"))
    placed = dealt(starts, [*keys, "__a"], parts)
    border = at_borders(placed, keys)
    reach = border.groupBy(PART, *keys).agg(F.max("__b").alias("__b"))
    reach = reach.select(PART, *keys, F.max("__b").over(earlier(keys)).alias("__reach"))
    # greatest() passes over nulls: the first interval of a range has none before it there, that of a group nowhere
    before = F.greatest(F.max("__b").over(within(keys).rowsBetween(Window.unboundedPreceding, -1)), F.col("__reach"))
    fresh = F.when(before.isNull() | (F.col("__a") - before > gap), F.col("__a"))
    marked = met(placed, reach, keys).withColumn("__fresh", fresh)
    opened = met(border, reach, keys).withColumn("__fresh", fresh).groupBy(PART, *keys).agg(F.max("__fresh").alias("__fresh"))
    opened = opened.select(PART, *keys, F.max("__fresh").over(earlier(keys)).alias("__open"))
    island = F.coalesce(F.max("__fresh").over(within(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("__open"))
    islands = met(marked, opened, keys).withColumn("__island", island)
    return islands.groupBy(*keys, "__island").agg(F.min("__a").alias("start"), F.max("__b").alias("stop"), F.sum("__n").alias("n")).drop("__island")


def merged_calls(rows: DataFrame, chrom: str, a: str, b: str, values: list[str], gap: int = 0, parts: int | None = None) -> DataFrame:
    """``chrom, values, start, stop, n``: calls in order, joined while the next has the same values and lies ``gap`` bases from the joined ones at most.

    Unlike :func:`merged` a call of other values between two keeps them apart.
    """
    columns = [chrom, a, b, *values]
    placed = dealt(rows.select(*columns), columns, parts)
    ends = at_borders(placed, [chrom]).groupBy(PART, chrom).agg(F.max_by(F.struct(*values), AT).alias("__last"))
    ends = ends.select(PART, chrom, F.lag("__last").over(Window.partitionBy(chrom).orderBy(PART)).alias("__before"))
    before = F.when(F.row_number().over(within([chrom])) == 1, F.col("__before")).otherwise(F.lag(F.struct(*values)).over(within([chrom])))
    marked = met(placed, ends, [chrom]).withColumn("__change", F.when(F.struct(*values).eqNullSafe(before), 0).otherwise(1)).drop("__before")
    runs = running_sum(marked, [chrom], F.col("__change"), "__run").select(*columns, "__run")
    return merged(runs, chrom, a, b, gap, [*values, "__run"], parts).select(chrom, *values, "start", "stop", "n")


def haplotype_calls(rows: DataFrame, chrom: str, a: str, b: str, gap: int = 0, parts: int | None = None) -> DataFrame:
    """``chrom, start, stop, cn, major, minor``: copies of both haplotypes, joined as calls; the greater number has to be ``major``."""
    right = F.when(F.col("major") >= F.col("minor"), F.col("major")).otherwise(F.raise_error(F.lit("the lesser haplotype has more copies")).cast("int"))
    calls = merged_calls(rows.withColumn("major", right), chrom, a, b, ["major", "minor"], gap, parts)
    return calls.select(chrom, "start", "stop", (F.col("major") + F.col("minor")).alias("cn"), "major", "minor")


def without_support(calls: DataFrame, copy_numbers: DataFrame, chrom: str) -> DataFrame:
    """The calls of :func:`haplotype_calls` that no copy-number call (``chrom, start, stop, cn``) of their sum holds whole."""
    left = calls.select(chrom, F.struct("start", "stop", "major", "minor").alias("id1"), F.col("start").alias("a1"), F.col("stop").alias("b1"), F.col("cn").alias("cn1"))
    right = copy_numbers.select(chrom, F.lit(0).alias("id2"), F.col("start").alias("a2"), F.col("stop").alias("b2"), F.col("cn").alias("cn2"))
    held = overlap_join(left, right, chrom).where((F.col("a2") <= F.col("a1")) & (F.col("b1") <= F.col("b2")) & (F.col("cn1") == F.col("cn2")))
    return calls.join(held.select(chrom, "id1.start", "id1.stop", "id1.major", "id1.minor").distinct(), [chrom, "start", "stop", "major", "minor"], "left_anti").select(*calls.columns)


def windows_of(rows: DataFrame, chrom: str, a: str, b: str, n: int, parts: int | None = None) -> DataFrame:
    """``chrom, start, stop``: the span of every n intervals of a chromosome in order; the last window of all is left out, as it was never closed.

    Ranges hand on how many intervals their chromosome has had.
    """
    equal = rows.groupBy(chrom, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    numbered = running_sum(dealt(equal, [chrom, "__a", "__b"], parts), [chrom], F.col("__n"), "__last")
    first, last = (F.floor((F.col("__last") - x) / n) for x in (F.col("__n"), F.lit(1)))
    spans = numbered.withColumn("__w", F.explode(F.sequence(first, last))).groupBy(chrom, "__w").agg(F.min("__a").alias("start"), F.max("__b").alias("stop"))
    # one row
    newest = spans.agg(F.max(F.struct(chrom, "__w")).alias("last"))
    kept = spans.crossJoin(F.broadcast(newest)).where((F.col(chrom) != F.col(f"last.{chrom}")) | (F.col("__w") != F.col("last.__w")))
    return kept.select(chrom, "start", "stop")


def call_stats(rows: DataFrame, chrom: str, a: str, b: str, value: str) -> DataFrame:
    """``chrom, value, n, len``: calls and bases of each value."""
    return rows.groupBy(chrom, value).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(b) - F.col(a)).alias("len"))


def best_target(hits: DataFrame) -> DataFrame:
    """``query_id, target, best_len, unique_len, specificity``: by the bases of a query that one hit alone covers.

    Bases are never listed: hits turn into steps of a running depth, and the
    stretches where just one hit lies are summed.  Ties go to the lowest target.
    """
    ends = F.array(F.struct(F.col("q_start").alias("at"), F.lit(1).alias("d"), F.col("target").alias("t")), F.struct(F.col("q_end").alias("at"), F.lit(-1).alias("d"), F.col("target").alias("t")))
    steps = hits.select("query_id", F.explode(ends).alias("s"))
    # where the depth is one, the sum of the open hits' targets is the target itself
    summed = steps.groupBy("query_id", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"), F.sum(F.col("s.d") * F.col("s.t")).alias("t"))
    order = Window.partitionBy("query_id").orderBy("at")
    run = summed.select("query_id", "at", F.sum("d").over(order).alias("depth"), F.sum("t").over(order).alias("target"), F.lead("at").over(order).alias("next"))
    unique = run.where("depth = 1").groupBy("query_id", "target").agg(F.sum(F.col("next") - F.col("at")).alias("len"))
    best = Window.partitionBy("query_id").orderBy(F.desc("len"), "target")
    ranked = unique.select("query_id", "target", "len", F.sum("len").over(Window.partitionBy("query_id")).alias("unique_len"), F.row_number().over(best).alias("k"))
    return ranked.where("k = 1").select("query_id", F.col("target").cast("int").alias("target"), F.col("len").alias("best_len"), "unique_len", (F.col("len") / F.col("unique_len")).alias("specificity"))


def grown_region(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """``query_id, target, start, stop``: the place of a query on each of its targets.

    ``hits`` has ``query_id, target, hit, t_start, t_end`` (an end before the
    start: the other strand), ``sizes`` the length of each query.  From the
    longest hit on, hits are taken in while the region is no longer than the
    query; of equally long ones only the first counts.  Start and stop change
    places if the first hit is on the other strand.
    """
    low = F.least("t_start", "t_end")
    rows = hits.select("query_id", "target", "hit", low.alias("low"), (F.greatest("t_start", "t_end") - low).alias("len"), (F.col("t_end") < F.col("t_start")).alias("turned"))
    longest = rows.groupBy("query_id", "target", "len").agg(F.min_by("low", "hit").alias("low"), F.min(F.struct("hit", "turned")).alias("first"))
    grouped = longest.groupBy("query_id", "target").agg(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("shorter"), "low"))).alias("x"), F.min("first").alias("first")).join(sizes.select("query_id", "size"), "query_id")
    seed = F.struct(F.col("x")[0]["low"].alias("a"), (F.col("x")[0]["low"] - F.col("x")[0]["shorter"]).alias("b"))

    def grow(region, hit):
        a, b = F.least(region["a"], hit["low"]), F.greatest(region["b"], hit["low"] - hit["shorter"])
        fits = b - a <= F.col("size")
        return F.struct(F.when(fits, a).otherwise(region["a"]).alias("a"), F.when(fits, b).otherwise(region["b"]).alias("b"))

    region = grouped.withColumn("r", F.aggregate("x", seed, grow))
    turned = F.col("first.turned")
    return region.select("query_id", "target", F.when(turned, F.col("r.b")).otherwise(F.col("r.a")).alias("start"), F.when(turned, F.col("r.a")).otherwise(F.col("r.b")).alias("stop"))
