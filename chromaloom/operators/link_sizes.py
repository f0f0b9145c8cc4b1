"""Link size distribution: bins, densities, enrichment, and gap sizes by likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaloom.functions.numbers import floor_log2
from chromaloom.operators.links import local_ids

#: Bins are a sixteenth of an octave wide, from the least to the most distance.
LEAST, OCTAVES, PER_OCTAVE = 4096, 16, 16
PER_AREA = 1e6
#: Gaps are tried in steps of GAP_STEP below MOST_GAP.
GAP_STEP, MOST_GAP = 1000, 10_000_000
#: Gaps of a range that has one bound, from the first splitting to the last; ranges looked into before others are let go;
#: values closer than this may be equal to five places.
RANGES, PROMISING, TIE = (256, 64, 16, 4), 4, 2e-5


def link_bin(distance: Column) -> Column:
    """The bin of a distance, -1 below the least.

    The octave comes from the integer's bits and only the rest from a
    logarithm, so whole powers of two fall in their own bin.
    """
    octave = floor_log2(F.floor(distance / LEAST))
    ratio = distance / (LEAST * F.pow(F.lit(2.0), octave))
    return F.when(distance < LEAST, -1).otherwise(PER_OCTAVE * octave + F.floor(PER_OCTAVE * F.log2(ratio))).cast("int")


def bins(spark: SparkSession) -> DataFrame:
    """``bin, start, stop`` of the 256 bins."""

    def bound(k: Column) -> Column:
        return F.floor(F.lit(LEAST) * F.pow(F.lit(2.0), F.floor(k / PER_OCTAVE)) * F.pow(F.lit(2.0), (k % PER_OCTAVE) / float(PER_OCTAVE)))

    return spark.range(OCTAVES * PER_OCTAVE).select(F.col("id").cast("int").alias("bin"), bound(F.col("id")).alias("start"), bound(F.col("id") + 1).alias("stop"))


def histogram(pairs: DataFrame) -> DataFrame:
    """``bin, n``: links within a contig, both qualities above 0, by distance."""
    apart = F.abs(F.col("pos1") - F.col("pos2"))
    kept = pairs.where((F.col("mapq1") > 0) & (F.col("mapq2") > 0) & (F.col("tid1") == F.col("tid2")) & (apart >= LEAST))
    return kept.groupBy(link_bin(apart).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """``bin, start, stop, density``: links per pair of loci, in millions, by distance.

    A bin's count is divided by the sequence that could show such a link and by
    its width.  From the last bin that a contig reaches on, the density falls as
    1/x from the mean over the bins that hold the longest hundredth of the links.
    """
    spark = pairs.sparkSession
    counts = histogram(pairs)
    lengths = contigs.groupBy("len").agg(F.count(F.lit(1)).alias("k"))
    all_bins = F.broadcast(bins(spark))  # 256 rows
    norms = lengths.crossJoin(all_bins).groupBy("bin", "start", "stop").agg(F.sum(F.when(F.col("len") > F.col("start"), (F.col("len") - F.col("start")) * F.col("k")).otherwise(0)).alias("norm"))
    rows = norms.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = F.when(F.col("norm") > 0, F.col("n") / F.col("norm") / (F.col("stop") - F.col("start")) * PER_AREA)
    falling = Window.orderBy(F.desc("bin"))
    whole = Window.partitionBy()
    rows = rows.withColumn("own", own).withColumn("top", F.sum(F.when(F.col("norm") > 0, F.col("n")).otherwise(0)).over(falling)).withColumn("total", F.sum("n").over(whole))
    rows = rows.withColumn("inner", F.max(F.when(F.col("norm") > 0, F.col("bin"))).over(whole))
    first = F.max(F.when((F.col("norm") > 0) & (F.col("top") >= F.floor(F.col("total") / 100)), F.col("bin"))).over(whole)
    rows = rows.withColumn("first", first)
    mean = F.avg(F.when((F.col("bin") >= F.col("first")) & (F.col("bin") <= F.col("inner")), F.col("own") * (F.col("stop") - F.col("start")))).over(whole)
    value = F.when(F.col("bin") >= F.col("inner"), F.coalesce(mean, F.lit(0.0)) / (F.col("stop") - F.col("start"))).otherwise(F.col("own"))
    return rows.select("bin", "start", "stop", value.alias("density"))


def expected_within(length: Column) -> Column:
    """Links expected within a contig in a bin with ``start, stop, density``: a slice of a triangle."""
    right = F.least(F.col("stop"), length)
    middle = F.floor((F.col("start") + right) / 2)
    area = (right - F.col("start")) * (length - middle)
    return F.when(F.col("start") >= length, 0.0).otherwise(area * F.col("density") / PER_AREA)


def expected_between(gap: Column, len1: Column, len2: Column, enrichment: Column | float = 1.0) -> Column:
    """Links expected between two contigs ``gap`` apart in a bin with ``start, stop, density``: a slice of a trapezoid."""
    short, long = F.least(len1, len2), F.greatest(len1, len2)
    start, stop = F.col("start"), F.col("stop")

    def part(low: Column, high: Column, height) -> Column:
        return (high - low) * height(F.floor((low + high) / 2))

    rise = F.when(start < gap + short, part(F.greatest(start, gap), F.least(stop, gap + short), lambda x: x - gap)).otherwise(0)
    flat = F.when((stop >= gap + short) & (start < gap + long), (F.least(stop, gap + long) - F.greatest(start, gap + short)) * short).otherwise(0)
    fall = F.when(stop >= gap + long, part(F.greatest(start, gap + long), F.least(stop, gap + short + long), lambda x: gap + short + long - x)).otherwise(0)
    outside = (stop <= gap) | (start >= gap + short + long)
    return F.when(outside, 0.0).otherwise((rise + flat + fall) * F.col("density") / PER_AREA * enrichment)


def contig_enrichment(pairs: DataFrame, contigs: DataFrame, lsd: DataFrame) -> DataFrame:
    """``tid, enrichment``: links within a contig against those expected; 1 for short contigs, 0 without links."""
    lengths = contigs.select("len").distinct()
    expected = lengths.crossJoin(F.broadcast(lsd)).groupBy("len").agg(F.sum(expected_within(F.col("len"))).alias("expected"))
    good = pairs.where((F.col("mapq1") > 0) & (F.col("mapq2") > 0) & (F.col("tid1") == F.col("tid2")) & (F.abs(F.col("pos1") - F.col("pos2")) >= LEAST))
    seen = good.groupBy(F.col("tid1").alias("tid")).agg(F.count(F.lit(1)).alias("n"))
    rows = contigs.select("tid", "len").join(seen, "tid", "left").join(expected, "len")
    return rows.select("tid", F.when(F.col("len") < LEAST, 1.0).when(F.col("n").isNull(), 0.0).otherwise(F.col("n") / F.col("expected")).alias("enrichment"))


class GapSearch:
    """Poisson log-likelihoods of the gaps between two contigs, for many gaps at once."""

    def __init__(self, lsd: list[tuple[int, int, int, float | None]]):
        held = sorted(row for row in lsd if row[3])
        self.start, self.stop = (np.array([row[k] for row in held], dtype=np.int64) for k in (1, 2))
        self.density = np.array([row[3] for row in held], dtype=np.float64)
        self.bin = np.array([row[0] for row in held], dtype=np.int64)
        # the least whole distance of each bin, and of the one after the last
        octave, rest = np.divmod(np.arange(OCTAVES * PER_OCTAVE + 1), PER_OCTAVE)
        self.least = np.ceil(LEAST * 2.0**octave * 2.0 ** (rest / PER_OCTAVE)).astype(np.int64)

    def expected(self, gaps: np.ndarray, len1: int, len2: int, enrichment: float) -> np.ndarray:
        """Links expected in each bin with a density, a row for each gap; see :func:`expected_between`."""
        return self._expected(gaps[:, None], len1, len2, enrichment)

    def _expected(self, g: np.ndarray, len1: int, len2: int, enrichment: float) -> np.ndarray:
        """The same for gaps by row and bin."""
        short, long = sorted((len1, len2))
        start, stop = self.start[None, :], self.stop[None, :]

        def part(low, high, height):
            return (high - low) * height((low + high) // 2)

        rise = np.where(start < g + short, part(np.maximum(start, g), np.minimum(stop, g + short), lambda x: x - g), 0)
        flat = np.where((stop >= g + short) & (start < g + long), (np.minimum(stop, g + long) - np.maximum(start, g + short)) * short, 0)
        fall = np.where(stop >= g + long, part(np.maximum(start, g + long), np.minimum(stop, g + short + long), lambda x: g + short + long - x), 0)
        outside = (stop <= g) | (start >= g + short + long)
        return np.where(outside, 0.0, (rise + flat + fall) * self.density / PER_AREA * enrichment)

    def log_likelihoods(self, gaps: np.ndarray, len1: int, len2: int, enrichment: float, dists: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each gap the log-likelihood, and whether any bin expects a link; ``dists`` ascend."""
        below = np.r_[0, np.cumsum(counts)]
        value, used = np.zeros(len(gaps)), np.zeros(len(gaps), dtype=bool)
        for at in np.array_split(np.arange(len(gaps)), 1 + len(gaps) // 2048):
            m = self.expected(gaps[at], len1, len2, enrichment)
            seen = below[np.searchsorted(dists, self.least[None, :] - gaps[at, None])]
            k = np.diff(seen, axis=1)[:, self.bin]
            fits = m > 0
            found = np.flatnonzero((k > 0) & fits)
            value[at] = -np.where(fits, m, 0.0).sum(axis=1)
            many = k.ravel()[found]
            term = many * np.log(m.ravel()[found]) - _log_factorials(int(many.max(initial=1)))[many]
            value[at] += np.bincount(found // k.shape[1], term, len(at)) if k.shape[1] else 0.0
            used[at] = fits.any(axis=1)
        return value, used


    def bounds(self, first: np.ndarray, last: np.ndarray, len1: int, len2: int, enrichment: float, dists: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each range of gaps a value that no log-likelihood in it exceeds.

        The links expected in a bin rise with the gap up to the one at which the
        bin lies amid the trapezoid, and fall from there; the links seen in it
        lie between counts of distances.  Of all these pairs of expected and
        seen links the likeliest is the one with fewest expected.
        """
        ends = [self.expected(g, len1, len2, enrichment) for g in (first, last)]
        amid = (self.start + self.stop - len1 - len2) // 2
        top = np.maximum(*(self._expected(np.maximum(amid + k, 0)[None, :], len1, len2, enrichment) for k in (0, 1)))
        inside = (first[:, None] <= amid + 1) & (amid <= last[:, None])
        # middles are rounded down to whole places, by less than one place over the bin's width
        slack = (self.stop - self.start) * self.density / PER_AREA * enrichment
        low = np.minimum(*ends) - slack
        high = np.where(inside, np.maximum(np.maximum(*ends), top), np.maximum(*ends)) + slack
        below = np.r_[0, np.cumsum(counts)]
        upto = [below[np.searchsorted(dists, self.least[None, :] - g[:, None])] for g in (first, last)]
        most = (upto[0][:, 1:] - upto[1][:, :-1])[:, self.bin]
        fewest = np.maximum(upto[1][:, 1:] - upto[0][:, :-1], 0)[:, self.bin]
        # a probability is at most one, and a bin that expects nothing is passed over
        fits, out = low > 0, np.full(low.shape, -np.inf)
        least = np.where(fits, low, 1.0)
        for near in (np.floor(least), np.ceil(least)):
            k = np.clip(near.astype(np.int64), fewest, most)
            m = np.clip(k, least, np.where(fits, high, 1.0))
            out = np.maximum(out, k * np.log(m) - m - _log_factorials(int(k.max(initial=1)))[k])
        return np.where(fits, np.minimum(out, 0.0), 0.0).sum(axis=1)

    def best(self, gaps: np.ndarray, len1: int, len2: int, enrichment: float, dists: np.ndarray, counts: np.ndarray) -> tuple[int, float, int] | None:
        """The most likely of ascending gaps, the smallest of those equal to five places, its log-likelihood, and how many gaps were evaluated.

        Ranges of gaps are split while their bounds reach the best value so far;
        those that do not are never looked into.
        """
        rest, best, seen = np.stack([np.arange(0, len(gaps), RANGES[0]), np.minimum(np.arange(0, len(gaps), RANGES[0]) + RANGES[0], len(gaps))], axis=1), -np.inf, {}

        def look(at: np.ndarray) -> None:
            nonlocal best
            values, used = self.log_likelihoods(gaps[at], len1, len2, enrichment, dists, counts)
            seen.update(zip(at.tolist(), np.where(used, values, -np.inf).tolist(), strict=True))
            best = max(best, values[used].max(initial=-np.inf))

        for size in [*RANGES[1:], 0]:
            if not len(rest):
                break
            middle = rest.sum(axis=1) // 2
            bound = self.bounds(gaps[rest[:, 0]], gaps[rest[:, 1] - 1], len1, len2, enrichment, dists, counts)
            # the most promising ranges first: what they have lets the others go
            order = np.argsort(-bound)
            if len(fresh := np.setdiff1d(middle[order[:PROMISING]], list(seen))):
                look(fresh)
            rest = rest[bound >= best - TIE]
            if size:
                begin = np.concatenate([np.arange(a, b, size) for a, b in rest.tolist()]) if len(rest) else rest[:, 0]
                end = np.concatenate([np.minimum(np.arange(a, b, size) + size, b) for a, b in rest.tolist()]) if len(rest) else rest[:, 0]
                rest = np.stack([begin, end], axis=1)
        left = np.setdiff1d(np.concatenate([np.arange(a, b) for a, b in rest.tolist()]) if len(rest) else np.zeros(0, dtype=np.int64), list(seen)).astype(np.int64)
        if len(left):
            look(left)
        found = sorted((k, v) for k, v in seen.items() if v > -np.inf)
        if not found:
            return None
        at, value = found[int(np.argmax(np.round([v for _, v in found], 5)))]
        return int(gaps[at]), value, len(seen)


@lru_cache(maxsize=8)
def _log_factorials_to(most: int) -> np.ndarray:
    return np.r_[0.0, np.cumsum(np.log(np.arange(1, most + 1)))]


def _log_factorials(most: int) -> np.ndarray:
    return _log_factorials_to(1 << max(most, 1).bit_length())


def _gap_grid(far: int, step: int, most: int | None) -> np.ndarray:
    """The gaps that are tried: as far as the farthest link stays within the bins."""
    end = (LEAST << OCTAVES) - far - 1
    return np.arange(0, (end if most is None else min(end, most)) + 1, step)


def _by_pair(links: DataFrame) -> DataFrame:
    """A row for each pair with its distinct distances; there are at most as many as the two contigs have bases."""
    each = links.groupBy("pair", "len1", "len2", "enrichment", "dist").agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("pair", "len1", "len2", "enrichment").agg(F.array_sort(F.collect_list(F.struct("dist", "k"))).alias("x"))


def _searched(links: DataFrame, lsd: DataFrame, step: int, most: int | None, result, schema: str) -> DataFrame:
    """``result(search, pair, gaps, x)`` for each pair of contigs with links, ``x`` what the search takes besides gaps."""
    # 256 bins at most
    sizes = [(r["bin"], r["start"], r["stop"], r["density"]) for r in lsd.select("bin", "start", "stop", "density").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = GapSearch(sizes)
        for rows in batches:
            for row in rows.itertuples(index=False):
                dists, counts = (np.array([x[name] for x in row.x], dtype=np.int64) for name in ("dist", "k"))
                yield result(search, row.pair, _gap_grid(int(dists[-1]), step, most), (int(row.len1), int(row.len2), float(row.enrichment), dists, counts))

    return _by_pair(links).mapInPandas(run, f"pair {links.schema['pair'].dataType.simpleString()}, {schema}")


def gap_likelihood(links: DataFrame, lsd: DataFrame, step: int = GAP_STEP, most: int | None = MOST_GAP - GAP_STEP) -> DataFrame:
    """``pair, gap, ll`` for gaps from 0 in steps: the Poisson log-likelihood of the links of a pair of contigs.

    ``links`` has a row per link: ``pair, len1, len2, enrichment, dist``.  Bins
    where no link is expected are passed over; a gap where none is has no row.
    """

    def result(search: GapSearch, pair, gaps: np.ndarray, x: tuple) -> pd.DataFrame:
        values, used = search.log_likelihoods(gaps, *x)
        return pd.DataFrame({"pair": [pair] * int(used.sum()), "gap": gaps[used], "ll": values[used]})

    return _searched(links, lsd, step, most, result, "gap long, ll double")


def gap_size(links: DataFrame, lsd: DataFrame, step: int = GAP_STEP, most: int | None = MOST_GAP - GAP_STEP) -> DataFrame:
    """``pair, gap, ll``: the most likely gap of the links of :func:`gap_likelihood`; the smallest of those equal to five places.

    All gaps of the grid are covered, most of them by bounds on ranges of gaps.
    """

    def result(search: GapSearch, pair, gaps: np.ndarray, x: tuple) -> pd.DataFrame:
        found = search.best(gaps, *x)
        return pd.DataFrame({"pair": [pair] * (found is not None), "gap": [found[0]] if found else np.zeros(0, dtype=np.int64), "ll": [found[1]] if found else np.zeros(0)})

    return _searched(links, lsd, step, most, result, "gap long, ll double")


def spaced(ordering: DataFrame, cells: DataFrame, clusters: DataFrame, contigs: DataFrame, enrichment: DataFrame, lsd: DataFrame, step: int = GAP_STEP, most: int | None = MOST_GAP - GAP_STEP) -> DataFrame:
    """``cluster_id, pos, tid, rc, gap``: the orderings with the gap after each contig.

    The gap is the most likely one for the links of the two neighbours, oriented
    as they are placed; their expected links are enriched by the weighted
    product of both contigs' own enrichments.  Null after an ordering's last
    contig, and where two neighbours have no links or no gap fits them.
    """
    after = Window.partitionBy("cluster_id").orderBy("pos")
    sized = ordering.join(local_ids(clusters), ["cluster_id", "tid"]).join(contigs.select("tid", "len"), "tid").join(enrichment.select("tid", "enrichment"), "tid")
    columns = ("tid", "local_id", "rc", "len", "enrichment")
    near = sized.select("cluster_id", "pos", *(F.col(c).alias(f"{c}1") for c in columns), *(F.lead(c).over(after).alias(f"{c}2") for c in columns)).where("tid2 is not null")
    share = lambda own: 2 * F.col(own) / (F.col("len1") + F.col("len2"))
    both = F.pow("enrichment1", share("len1")) * F.pow("enrichment2", share("len2"))
    links = cells.select("cluster_id", F.col("c1").alias("local_id1"), F.col("rc1"), F.col("c2").alias("local_id2"), F.col("rc2"), "dist")
    met = near.join(links, ["cluster_id", "local_id1", "rc1", "local_id2", "rc2"])
    rows = met.select(F.struct("cluster_id", "pos").alias("pair"), "len1", "len2", both.alias("enrichment"), "dist")
    # a pair is named by its place; Python gets the name as text
    named = rows.withColumn("pair", F.concat_ws(":", "pair.cluster_id", "pair.pos"))
    gaps = gap_size(named.where("enrichment > 0"), lsd, step, most).select("pair", "gap")
    name = F.concat_ws(":", "cluster_id", "pos")
    return ordering.withColumn("pair", name).join(gaps, "pair", "left").select("cluster_id", "pos", "tid", "rc", "gap")


def link_variance(cells: DataFrame, contigs: DataFrame, width: int = 10_000) -> DataFrame:
    """``cluster_id, c1, c2, n, variance``: how links of a pair spread over bins of distance."""
    forward = cells.where("not rc1 and not rc2 and c1 < c2").withColumn("bin", F.floor(F.col("dist") / width))
    counts = forward.groupBy("cluster_id", "c1", "c2", "bin").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("cluster_id", "c1", "c2").agg(F.sum("k").alias("n"), F.var_pop("k").alias("variance"))


def trapezoid_deviation(cells: DataFrame, clusters: DataFrame, contigs: DataFrame, width: int = 10_000) -> DataFrame:
    """``cluster_id, c1, c2, n, deviation``: squared differences of a pair's links, by bins of distance, from evenly spread ones.

    Evenly spread links rise over the first contig's length, stay and fall over
    the last; the sum over all bins is divided by the links.  Bins without
    links add their expectation's square.
    """
    forward = cells.where("not rc1 and not rc2 and c1 < c2")
    seen = forward.groupBy("cluster_id", "c1", "c2", F.floor(F.col("dist") / width).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    sized = local_ids(clusters).join(contigs.select("tid", "len"), "tid")
    pairs = seen.groupBy("cluster_id", "c1", "c2").agg(F.sum("k").alias("n"))
    for k in ("1", "2"):
        pairs = pairs.join(sized.select("cluster_id", F.col("local_id").alias(f"c{k}"), F.col("len").alias(f"len{k}")), ["cluster_id", f"c{k}"])
    bins_of = pairs.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("len1") + F.col("len2")) / width))))
    start, stop = F.col("bin") * width, (F.col("bin") + 1) * width
    flat = F.col("n") / F.col("len2").cast("double") * width
    rising = (start + F.least(stop, "len1")) / 2.0 / F.col("len1")
    falling = (F.col("len1") + F.col("len2") - (stop + F.greatest(start, "len2")) / 2.0) / F.col("len1")
    expected = flat * F.when(start < F.col("len1"), rising).when(stop > F.col("len2"), falling).otherwise(1.0)
    rows = bins_of.join(seen, ["cluster_id", "c1", "c2", "bin"], "left")
    off = expected - F.coalesce("k", F.lit(0))
    return rows.groupBy("cluster_id", "c1", "c2", "n").agg((F.sum(off * off)).alias("d")).select("cluster_id", "c1", "c2", "n", (F.col("d") / F.col("n")).alias("deviation"))
