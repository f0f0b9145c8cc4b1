"""Scans in order over many tasks.

A window keyed by chromosome or file puts all its rows into one task.  Here rows
are dealt by ranges of the whole order and written once; every range gives a
short summary for the groups in which it begins and ends, the summaries (two
rows a range) are added up in order, and what earlier ranges hand on is broadcast.
A running value is then the one within the range, and what was handed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The number of a row's range, and its place within the range.
PART, AT = "__part", "__at"
#: Used only where ``spark.checkpoint.dir`` is unset and the master is local.
LOCAL_DIR = "/tmp/checkpoints/chromaloom"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = LOCAL_DIR
    return f"{root.rstrip('/')}/chromaloom/{tag}-{uuid.uuid4().hex}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder: it cuts the lineage and is the same each time it is read."""
    path = shared_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``rows``, written in ranges of ``order``, with the number of the range and the place in it.

    Rows of equal order are of one range, so the order has to tell rows apart
    where many could be equal.  Without ``parts`` the session's number of
    partitions holds.
    """
    by_range = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(by_range.sortWithinPartitions(*order).withColumns({PART: F.spark_partition_id(), AT: place}), "dealt")


def within(keys: list[str]) -> Window:
    """Rows of a group in one range, in order."""
    return Window.partitionBy(PART, *keys).orderBy(AT)


def earlier(keys: list[str]) -> Window:
    """Of a table with a row for each range and group: the ranges before."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def _beside(rows: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` joined with a table of two rows a range at most; a null group is a group too."""
    renamed = small.withColumnsRenamed({k: f"{k}__of" for k in [PART, *keys]})
    condition = F.lit(True)
    for k in [PART, *keys]:
        condition = condition & F.col(k).eqNullSafe(F.col(f"{k}__of"))
    return rows.join(F.broadcast(renamed), condition, how).drop(*(f"{k}__of" for k in [PART, *keys]))


def at_borders(placed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the groups in which a range begins or ends, two a range: no other group goes on from range to range.

    Summaries are made of these rows alone, so they are as few as the ranges
    however many groups there are.
    """
    group = F.struct(*keys)
    ends = placed.groupBy(PART).agg(F.min_by(group, AT).alias("__one"), F.max_by(group, AT).alias("__two"))
    groups = ends.select(PART, F.explode(F.array("__one", "__two")).alias("__group")).select(PART, "__group.*").distinct()
    return _beside(placed, groups, keys, "left_semi")


def met(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` beside the summary of their range and group, made of :func:`at_borders`; nulls for other groups."""
    return _beside(rows, summaries, keys, "left")


def running_sum(placed: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Rows of :func:`dealt` with the sum of ``value`` over a group's rows up to this one."""
    handed = at_borders(placed, keys).groupBy(PART, *keys).agg(F.sum(value.cast("long")).alias("__sum"))
    handed = handed.select(PART, *keys, F.sum("__sum").over(earlier(keys)).alias("__handed"))
    own = F.sum("__v").over(within(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = placed.withColumn("__v", value.cast("long")).withColumn(name, own)
    return met(rows, handed, keys).withColumn(name, F.col(name) + F.coalesce("__handed", F.lit(0))).drop("__v", "__handed")


def ranked(rows: DataFrame, order: list[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their place, from 0, in the whole order, which has to tell them apart."""
    placed = dealt(rows, order, parts)
    sizes = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"))
    # a row for each range
    starts = sizes.select(F.col(PART).alias("__of"), F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), F.col(PART) == F.col("__of")).select(*rows.columns, (F.col("__start") + F.col(AT)).alias(name))
