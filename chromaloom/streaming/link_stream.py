"""A link matrix kept up to date while alignment files arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chromaloom.operators.links import link_matrix

#: Columns of a stream of pairs.
PAIRS = "qid long, tid1 int, tid2 int, pos1 long, pos2 long, mapq1 int, mapq2 int"


#: Columns of a stream of reads, and of a read that waits for its mate.
READS = "qname string, flag int, tid int, pos long, mapq int"
_WAITING = "tid int, pos long, mapq int"
#: A read without a mate is given up after so long.
MATE_HOURS = 24.0


def read_stream(spark: SparkSession, folder: str, files_each: int = 64) -> DataFrame:
    """Reads out of Parquet files as they come into a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_each).parquet(folder)


def mate_pairs(reads: DataFrame, hours: float = MATE_HOURS) -> DataFrame:
    """A stream of pairs out of a stream of aligned reads, whose mates may come in later batches.

    Reads of a template share their name up to ``/1`` or ``/2``.  Of each
    template that has had an odd number of reads the last one waits as state;
    the next read of the name is its mate.  A read that waits longer than
    ``hours`` is dropped, so the state holds what came within that time.
    """
    def meet(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        waiting, found = state.getOption, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                read, arrived = (int(row.tid), int(row.pos), int(row.mapq)), int(row.arrived.timestamp() * 1000)
                if waiting is None:
                    waiting = read
                else:
                    found.append((key[0], waiting[0], read[0], waiting[1], read[1], waiting[2], read[2]))
                    waiting = None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update(waiting)
            state.setTimeoutTimestamp(arrived + 1)  # the watermark passes this so many hours later
        yield pd.DataFrame(found, columns=["name", "tid1", "tid2", "pos1", "pos2", "mapq1", "mapq2"])

    named = reads.where(F.col("flag").bitwiseAND(4) == 0).select(F.regexp_replace("qname", "/[12]$", "").alias("name"), "tid", "pos", "mapq", F.current_timestamp().alias("arrived"))
    named = named.withWatermark("arrived", f"{int(hours * 3600)} seconds")
    schema = "name string, tid1 int, tid2 int, pos1 long, pos2 long, mapq1 int, mapq2 int"
    met = named.groupBy("name").applyInPandasWithState(meet, schema, _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    return met.select(F.xxhash64("name").alias("qid"), "tid1", "tid2", "pos1", "pos2", "mapq1", "mapq2")


def pair_stream(spark: SparkSession, folder: str, files_each: int = 64) -> DataFrame:
    """Pairs out of Parquet files as they come into a folder."""
    return spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_each).parquet(folder)


def running_matrix(pairs: DataFrame) -> DataFrame:
    """``a, b, z`` of all pairs so far; the state has a row per linked pair of contigs."""
    weight = (F.col("mapq1") > 0).cast("bigint") + (F.col("mapq2") > 0).cast("bigint")
    kept = pairs.where("pos1 <> pos2 and tid1 <> tid2 and (mapq1 > 0 or mapq2 > 0)")
    return kept.groupBy(F.least("tid1", "tid2").alias("a"), F.greatest("tid1", "tid2").alias("b")).agg(F.sum(weight).alias("z"))


def keep_deltas(pairs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch's own matrix, written under its number, so that a batch run twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        link_matrix(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summed_deltas(spark: SparkSession, table: str) -> DataFrame:
    """``i, j, z``: the matrix of all batches."""
    return spark.read.parquet(table).groupBy("i", "j").agg(F.sum("z").alias("z"))
