"""Connected components by alternating large and small stars, with every step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import written

#: A node's links are dealt to so many tasks, so that a hub does not fill one.
SALTS = 16


def _with_least(links: DataFrame) -> DataFrame:
    """``u, v, least``: the least of u and its partners beside each link; hubs are salted."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    left = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return left.join(least.withColumn("salt", salts), ["u", "salt"]).select("u", "v", "least")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that has a link to another; root is the component's least node.

    ``links`` has long columns ``u`` and ``v``; repeats, loops and both
    directions are allowed, rows with a null are ignored.  Each round writes
    its links to the shared folder, so a lost executor costs one round.
    """
    cleaned = links.where((F.col("u") != F.col("v")) & F.col("u").isNotNull() & F.col("v").isNotNull())
    now = written(cleaned.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u and v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = written(large.distinct(), "links")
        # after a large star every link points from the greater node to the less
        seen = _with_least(large)
        small = seen.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(seen.select("u", F.col("least").alias("v")))
        now = written(small.distinct(), "links")
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
