"""Operator 7: exact top-k inner products by pivot-table elimination.

Integer vectors are lifted by one coordinate to a common norm, which turns the
highest inner product into the least Euclidean distance.  The distances of every
candidate to many pivots are computed once and kept as a table.  For a query, the
largest difference between its own pivot distances and a candidate's is a lower
bound of their distance; candidates are evaluated in the order of that bound
until it passes the k-th best distance found, which makes the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.llm.common import gathered, shared_path, written

K = 5
SCALE = 256
PIVOTS = 32
#: Rows from which the pivots are chosen, and queries that are broadcast at once.
PIVOT_SAMPLE = 2000
QUERY_BLOCK = 8192
CANDIDATE_ROWS = 8192
#: Candidates evaluated between two looks at the bound.
STEP = 512
#: Sums of products up to here are exact in doubles.
_EXACT = 2.0**53


def quantised(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """``id, x array<long>``: floor(scale * x) of every vector that is whole and finite; components beyond a long are an error."""
    x = F.transform(F.col(vector_column), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("x"))
    whole = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    beyond = F.raise_error(F.lit("a scaled component exceeds what a long holds")).cast("long")
    scaled = F.transform("x", lambda v: F.when(F.abs(v * scale) < 2.0**63, F.floor(v * scale)).otherwise(beyond))
    return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & whole).select("id", scaled.alias("x"))


def _matrix(lists: list, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    out = np.zeros((len(lists), width))
    for k, row in enumerate(lists):
        out[k, : len(row)] = row
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that brings their squared norm to ``most``."""
    return np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0.0))


def _choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from one another, each the farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    least = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _dot(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; beyond what doubles hold they are summed as Python integers."""
    if exact:
        return x @ q
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x], dtype=object)


class Best:
    """The k best candidates that a task has met so far, for every query."""

    def __init__(self, queries: int, k: int, exact: bool):
        self.k, self.exact = k, exact
        self.scores = [np.empty(0, dtype=float if exact else object)] * queries
        self.ids = [np.empty(0, dtype=np.int64)] * queries

    def least(self, n: int, seed: float) -> float:
        """A score that a further candidate of query ``n`` has to reach."""
        return max(seed, float(self.scores[n][-1])) if len(self.scores[n]) == self.k else seed

    def add(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[n], scores]), np.concatenate([self.ids[n], ids])
        if len(scores) > 4 * self.k and self.exact:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= edge], ids[scores >= edge]
        keep = sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[: self.k]
        self.scores[n], self.ids[n] = scores[keep], ids[keep]

    def evaluate(self, n: int, query: np.ndarray, own: int, ceiling: np.ndarray, x: np.ndarray, ids: np.ndarray, seed: float) -> None:
        """Evaluate candidates by falling ceiling (rising lower bound) until none below can be among the best."""
        open_rows = np.flatnonzero((ceiling >= 2.0 * self.least(n, seed)) & (ids != own))
        order = open_rows[np.argsort(-ceiling[open_rows], kind="stable")]
        at, step = 0, STEP
        while at < len(order) and ceiling[order[at]] >= 2.0 * self.least(n, seed):
            part = order[at : at + step]
            at, step = at + step, step * 2
            self.add(n, _dot(x[part], query, self.exact), ids[part])


def _seeds(q: np.ndarray, own: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k sampled rows reach, less what doubles may be off."""
    out = np.full(len(q), -np.inf)
    if len(sample) > k:
        for at in np.array_split(np.arange(len(q)), 1 + len(q) // 512):
            scores = np.where(ids[None, :] == own[at, None], -np.inf, q[at] @ sample.T)
            out[at] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return out - 1e-9 * np.abs(np.where(np.isfinite(out), out, 0.0)) - 1.0


def pivot_table(rows: DataFrame, pivots: np.ndarray, most: float, width: int) -> DataFrame:
    """``id, x, d array<float>``: every vector with its distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lifted(_matrix(batch.column("x").to_pylist(), width), most)
            d = _distances(x, pivots).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(list(d), pa.list_(pa.float32()))], names=["id", "x", "d"])

    return rows.mapInArrow(run, "id long, x array<long>, d array<float>")


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query.

    ``is_query`` is a condition on column ``id``.  Candidates are all rows but
    those of the query's own id; ties go to the smaller id; fewer candidates
    give fewer rows.  Vectors that are null or hold a null or non-finite
    component and rows with a null id take no part; a component whose scaled
    value no long holds is an error; shorter vectors are filled with zeros; rows
    that repeat an id are candidates each; an empty table gives an empty one;
    other columns are not read.  Queries go in blocks of bounded size against
    all rows; each task carries the k best of a query from batch to batch and
    gives k rows a query at its end, and these meet by query.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale, id_column, vector_column), "quantised")
    square = F.aggregate("x", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    count, most, width = rows.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("x"))).head()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score long")
    if not count:
        return empty
    width = max(width, 1)
    exact = most < _EXACT
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
    sampled, sampled_ids = _matrix([r["x"] for r in sample], width), np.array([r["id"] for r in sample], dtype=np.int64)
    pivot_rows = _choose_pivots(_lifted(sampled, most), pivots)
    table = written(pivot_table(rows, pivot_rows, most, width), "pivot-table")
    queries = rows.where(is_query).select("id").distinct()
    queries = written(table.join(queries, "id", "left_semi"), "queries")
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // query_block))
    folder, found = shared_path(spark, "top-k"), None
    for block in range(blocks):
        chosen = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        asked = chosen.collect()
        own = np.array([r["id"] for r in asked], dtype=np.int64)
        q = _matrix([r["x"] for r in asked], width)
        # a query is lifted by zero, which leaves the distances to candidates as their inner products say
        d = _distances(np.c_[q, np.zeros(len(q))], pivot_rows)
        shared = spark.sparkContext.broadcast((own, q, d, _seeds(q, own, sampled, sampled_ids, k)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, q, d, seeds = shared.value
            norms = (q * q).sum(axis=1) + most
            slack = 1e-5 * np.sqrt(most) + 1e-6  # the table's distances are rounded
            best = Best(len(own), k, exact)
            for batch in gathered(batches, CANDIDATE_ROWS):
                ids = batch.column("id").to_numpy()
                x = _matrix(batch.column("x").to_pylist(), width)
                table = batch.column("d").values.to_numpy().reshape(len(ids), -1)
                for n in range(len(own)):
                    bound = np.maximum(np.abs(table - d[n].astype(np.float32)).max(axis=1, initial=0.0).astype(np.float64) - slack, 0.0)
                    # twice the inner product is at most this
                    best.evaluate(n, q[n], own[n], norms[n] - bound * bound, x, ids, seeds[n])
            for n in range(len(own)):
                if len(best.ids[n]):
                    columns = np.full(len(best.ids[n]), own[n]), best.ids[n], [int(s) for s in best.scores[n]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", id_column, "score"])

        found = table.select("id", "x", "d").mapInArrow(run, f"query_id long, {id_column} long, score long")
        if blocks > 1:
            # each block is a job of its own, so neither the plan nor the broadcasts add up
            found.write.parquet(f"{folder}/block={block}")
            shared.unpersist()
    if blocks > 1:
        found = spark.read.parquet(folder).drop("block")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_column))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id_column, "score")
