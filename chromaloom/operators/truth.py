"""The reference placement of contigs: lookups, relabelling, order and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_truth(contigs: DataFrame, truth: DataFrame) -> DataFrame:
    """``tid, name, chrom, t0, t1``: -1 where a contig has no place."""
    rows = contigs.select("tid", "name").join(truth.select("tid", "chrom", "t0", "t1"), "tid", "left")
    return rows.select("tid", "name", F.coalesce("chrom", F.lit(-1)).alias("chrom"), F.when(F.col("chrom").isNull(), -1).otherwise(F.col("t0")).alias("t0"), F.when(F.col("chrom").isNull(), -1).otherwise(F.col("t1")).alias("t1"))


def high_quality(truth: DataFrame, alignability: float = 0.5, specificity: float = 0.9) -> DataFrame:
    """Contigs whose alignment is unique over enough of them and mostly on one target."""
    return truth.where((F.col("alignability") >= alignability) & (F.col("specificity") >= specificity))


def remove_target(truth: DataFrame, chrom: int) -> DataFrame:
    """Contigs on a target lose their place."""
    return truth.withColumn("chrom", F.when(F.col("chrom") != chrom, F.col("chrom")))


def merge_targets(truth: DataFrame, first: int, second: int) -> DataFrame:
    """Contigs on the second target count as on the first."""
    return truth.withColumn("chrom", F.when(F.col("chrom") == second, first).otherwise(F.col("chrom")))


def first_on_chrom(truth: DataFrame) -> DataFrame:
    """``chrom, tid``: the lowest contig on each chromosome."""
    return truth.where("chrom is not null").groupBy("chrom").agg(F.min("tid").alias("tid"))


def lengths_on_targets(truth: DataFrame, contigs: DataFrame) -> DataFrame:
    """``chrom, n, len, n_hq, len_hq``: contigs and bases on each target (null: none), and of high quality."""
    good = (F.col("alignability") >= 0.5) & (F.col("specificity") >= 0.9)
    rows = contigs.select("tid", "len").join(truth, "tid") if "len" not in truth.columns else truth
    return rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"), F.count_if(good).alias("n_hq"), F.sum(F.when(good, F.col("len")).otherwise(0)).alias("len_hq"))


def match_names(names: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """``name, chrom_id``: the chromosome of that name, else of the name after ``chr``, else -1."""
    exact = chromosomes.select(F.col("name"), F.col("chrom_id").alias("exact"))
    prefixed = chromosomes.select(F.col("name").alias("full"), F.col("chrom_id").alias("prefixed"))
    rows = names.join(exact, "name", "left").join(prefixed, F.concat(F.lit("chr"), F.col("name")) == F.col("full"), "left")
    return rows.select("name", F.coalesce("exact", "prefixed", F.lit(-1)).alias("chrom_id"))


def look_up(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``name, tid``; a name that the dictionary lacks is an error when the rows are read."""
    rows = names.join(dictionary.select("name", "tid"), "name", "left")
    known = F.when(F.col("tid").isNotNull(), F.col("tid")).otherwise(F.raise_error(F.concat(F.lit("unknown name: "), F.col("name"))).cast("int"))
    return rows.select("name", known.alias("tid"))


def bin_truth(sizes: DataFrame, bin_size: int) -> DataFrame:
    """``chrom, bin, start, stop``: chromosomes cut into bins, the last one shorter."""
    rows = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / bin_size).cast("int") - 1)))
    return rows.select("chrom", "bin", (F.col("bin") * bin_size).cast("bigint").alias("start"), F.least((F.col("bin") + 1) * bin_size, F.col("size")).cast("bigint").alias("stop"))


def bin_offsets(sizes: DataFrame, bin_size: int) -> DataFrame:
    """``chrom, bins, first``: bins of each chromosome and the number of the first in the whole genome."""
    from pyspark.sql import Window

    bins = F.ceil(F.col("size") / bin_size).cast("bigint")
    return sizes.select("chrom", bins.alias("bins"), (F.sum(bins).over(Window.orderBy("chrom")) - bins).alias("first"))


def same_targets(one: DataFrame, two: DataFrame) -> DataFrame:
    """``n_differing``: rows that only one of two dictionaries has."""
    both = one.exceptAll(two).unionByName(two.exceptAll(one))
    return both.agg(F.count(F.lit(1)).alias("n_differing"))
