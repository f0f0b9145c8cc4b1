"""Observation sequences: dictionaries, transition and state frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symbol_ids(observations: DataFrame) -> DataFrame:
    """``symbol, sid, shown``: a dense number for each symbol and the character that prints it."""
    distinct = observations.select("symbol").distinct()
    return distinct.select("symbol", (F.row_number().over(Window.orderBy("symbol")) - 1).alias("sid")).withColumn("shown", F.char(F.col("sid") + 28))


def encode(observations: DataFrame) -> DataFrame:
    """``seq_id, t, sid``: symbols by their numbers."""
    return observations.join(symbol_ids(observations).drop("shown"), "symbol").select("seq_id", "t", "sid")


def transition_matrix(observations: DataFrame) -> DataFrame:
    """``a, b, n, p``: how often a symbol follows another, and as a share of what follows it."""
    after = F.lead("symbol").over(Window.partitionBy("seq_id").orderBy("t"))
    pairs = observations.select(F.col("symbol").alias("a"), after.alias("b")).where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))


def state_frequencies(observations: DataFrame) -> DataFrame:
    """``symbol, n, p``."""
    counts = observations.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
