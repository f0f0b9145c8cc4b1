"""Aggregates and scalar functions over numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n50(values: DataFrame, column: str) -> DataFrame:
    """One row ``n50``: the first value, from the largest, up to which the values sum to half of all.

    If they sum to just half and smaller ones follow, the mean with the next,
    cut to an integer for integers.  Equal values are summed first, so the
    ordered step sees distinct values only.
    """
    sums = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    falling = Window.orderBy(F.desc("v"))
    whole = Window.partitionBy()
    run = sums.select("v", "n", F.sum(F.col("v") * F.col("n")).over(falling).alias("cum"), F.sum(F.col("v") * F.col("n")).over(whole).alias("total"), F.lead("v").over(falling).alias("next"))
    # half may also be reached inside a run of equal values, which then is the mean of equals
    reached = run.where(2 * F.col("cum") >= F.col("total")).orderBy(F.desc("v")).limit(1)
    kind = values.schema[column].dataType
    exact = (2 * F.col("cum") == F.col("total")) & F.col("next").isNotNull()
    return reached.select(F.when(exact, (F.col("v") + F.col("next")) / 2).otherwise(F.col("v")).cast(kind).alias("n50"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``r``: the correlation over the rows where both values are finite."""

    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))

    return rows.where(finite(x) & finite(y)).agg(correlation(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate: not a number where either side does not vary, null without pairs.

    ``corr`` divides by the spread whatever it is, which is an error in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.when(spread == 0, float("nan")).otherwise(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def log_sum_exp(a: Column, b: Column) -> Column:
    """``ln(e^a + e^b)``; minus infinity is neutral."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def floor_log2(value: Column) -> Column:
    """The place of the highest bit; 0 for 0 and 1."""
    return F.length(F.bin(F.greatest(value, F.lit(1)))) - 1


def normalised_counts(rows: DataFrame, key: str, count: str) -> DataFrame:
    """``key, p``: each count as a share of all."""
    total = rows.agg(F.sum(count).cast("double").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(key, (F.col(count) / F.col("total")).alias("p"))


def int_ranges(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, ranges``: the integers of each key as text, consecutive ones as ``a-b``, in brackets."""
    in_key = Window.partitionBy(key).orderBy(value)
    islands = rows.select(key, value).distinct().withColumn("island", F.col(value) - F.row_number().over(in_key))
    ends = islands.groupBy(key, "island").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    grouped = ends.select(key, F.struct("a", shown.alias("s")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select(key, F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["s"]), ","), F.lit("]")).alias("ranges"))


def checked_probabilities(rows: DataFrame, key: str, p: str) -> DataFrame:
    """``key, ok``: whether the probabilities of each key are not negative and sum to one within 1e-6."""
    return rows.groupBy(key).agg(((F.min(p) >= 0) & (F.abs(F.sum(p) - 1) <= 1e-6)).alias("ok"))


#: Of so many residues the pairs are gone through; of more their products are counted by a convolution.
FEW_RESIDUES, DIGIT = 2048, 12


def sum_of_product_residues(residues: np.ndarray, counts: np.ndarray, bits: int, few: int = FEW_RESIDUES) -> int:
    """The sum over all ordered pairs, each as often as counted, of ``r * s mod 2 ** bits``, exactly; residues are distinct and below ``2 ** bits``.

    A residue is a power of two times an odd number, and odd numbers modulo a
    power of two are plus or minus a power of five, so how often each product
    occurs is a cyclic convolution of counts over signs and exponents, one for
    each two powers of two.  Counts go in by digits, so the transforms are exact.
    """
    residues, counts = np.asarray(residues, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    if len(residues) <= few:
        rows = (int(n) * int((residues * r % (1 << bits)).astype(object) @ counts.astype(object)) for r, n in zip(residues.tolist(), counts.tolist(), strict=True))
        return sum(rows)
    exponent = np.zeros(1 << bits, dtype=np.int64)
    powers = np.ones(1 << (bits - 2), dtype=np.int64)
    for k in range(bits - 2):  # five to the power 2 ** k moves the first half to the second
        powers[1 << k : 2 << k] = powers[: 1 << k] * pow(5, 1 << k, 1 << bits) % (1 << bits)
    exponent[powers] = exponent[(1 << bits) - powers] = np.arange(len(powers))
    levels = []
    for level in range(bits):
        held = (residues > 0) & (residues & ((2 << level) - 1) == 1 << level)
        odd = residues[held] >> level
        levels.append(((odd & 3) >> 1, exponent[odd], counts[held]))
    total = 0
    for i, j in ((i, j) for i in range(bits) for j in range(i, bits - i)):
        left = bits - i - j
        size = max(1 << max(left - 2, 0), 1)
        sides = [_digits(np.bincount(sign * size + at % size, n, 2 * size).astype(np.int64).reshape(2, size) if left > 1 else np.array([[n.sum()]])) for sign, at, n in (levels[i], levels[j])]
        values = np.ones((1, 1), dtype=np.int64) if left == 1 else np.stack([powers[:size] % (1 << left), -powers[:size] % (1 << left)]) if left > 2 else np.array([[1], [3]])
        for p, one in enumerate(sides[0]):
            for q, other in enumerate(sides[1]):
                spread = np.fft.ifft2(np.fft.fft2(one) * np.fft.fft2(other)).real
                found = np.rint(spread).astype(np.int64)
                at = np.nonzero(found)
                total += (1 + (i != j)) * int((found[at].astype(object) * values[at]).sum()) << (i + j + DIGIT * (p + q))
    return total


def _digits(counts: np.ndarray) -> list[np.ndarray]:
    out = []
    while counts.any():
        out.append(counts & ((1 << DIGIT) - 1))
        counts = counts >> DIGIT
    return out
