"""Operator 13: ranked lexical search by MaxScore in every shard.

A first pass over the whole texts writes an index: for each document its number
of terms, and the query terms it holds with their frequencies.  A shard is the
part of the index that a task reads; it inverts its documents block by block.
For every query the terms are split by their upper bounds in the block: while
the bounds of the terms not yet read could carry a document of their own past
the least of the best so far, the next term is essential and its whole list is
read; the others are non-essential, and their lists are only probed for
documents found already, and only while the bounds still to come let such a
document qualify.  The best are carried from block to block, so later blocks
start with high thresholds.  Scores are whole numbers with statistics of the
whole corpus, so the shards' lists can be merged as they are.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chromaloom.llm.common import arrow_map, gathered, release_kept, utf8_list, written
from chromaloom.llm.decontamination import words_of

TOP = 10
#: Bytes of query text that are looked for together; more queries take further passes over the documents.
BLOCK_BYTES = 2 << 20
#: Documents that a shard inverts together.
BLOCK_ROWS = 16_384
#: Lists of one query that shards give are first merged in so many groups.
SALTS = 64
#: How a term's frequency is weakened: 10^9 tf / (1000 tf + 8 m), where m is 10 for the least and grows by 90 for the mean length.
_ONE, _TF, _LENGTH, _BASE, _SLOPE = 1_000_000_000, 1000, 8, 10, 90


def term_weight(n_docs: int, holding: int) -> int:
    """A term's weight in thousandths."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def lengths_of(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """``m`` of documents by their numbers of terms."""
    return _BASE + _SLOPE * n_terms * n_docs // max(all_terms, 1)


class Shard:
    """The inverted lists of some documents: term by term the documents in order, and what the term gives each."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, docs: np.ndarray, m: np.ndarray, weight: np.ndarray):
        gain = weight[terms] * (_ONE * tfs // (_TF * tfs + _LENGTH * m[docs]))
        order = np.lexsort((docs, terms))
        order = order[gain[order] > 0]
        terms, self.docs, self.gain = terms[order], docs[order], gain[order]
        self.begin = np.searchsorted(terms, np.arange(len(weight) + 1))
        self.bound = np.zeros(len(weight), dtype=np.int64)
        held = np.flatnonzero(np.diff(self.begin))
        if len(held):
            self.bound[held] = np.maximum.reduceat(self.gain, self.begin[held])
        self.score = np.zeros(len(m), dtype=np.int64)

    def search(self, terms: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The best documents by score and then by order, of those whose score is at least ``least`` (1 or more)."""
        bounds = self.bound[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        terms, bounds = terms[order], bounds[order]
        # what the terms from a place on can give together
        to_come = np.r_[np.cumsum(bounds[::-1])[::-1], 0]
        score, found, k = self.score, np.zeros(0, dtype=np.int64), 0
        touched = []
        while k < len(terms) and to_come[k] >= least:  # essential: documents that only it and later ones hold can qualify
            a, b = self.begin[terms[k]], self.begin[terms[k] + 1]
            docs = self.docs[a:b]
            touched.append(docs[score[docs] == 0])
            score[docs] += self.gain[a:b]
            k += 1
            if k < len(terms):
                found = np.concatenate(touched)
                least = max(least, _at_rank(score[found], top))
        found = np.concatenate(touched) if touched else found
        reached = found
        while k < len(terms):  # non-essential: probed for what can still qualify
            found = found[score[found] + to_come[k] >= least]
            if not len(found):
                break
            a, b = self.begin[terms[k]], self.begin[terms[k] + 1]
            at = np.searchsorted(self.docs[a:b], found)
            at[at == b - a] = 0
            hit = self.docs[a:b][at] == found
            score[found[hit]] += self.gain[a:b][at[hit]]
            k += 1
            least = max(least, _at_rank(score[found], top))
        found = found[score[found] >= least]
        found = found[np.lexsort((found, -score[found]))[:top]]
        best = score[found]
        score[reached] = 0
        return found, best


def _at_rank(scores: np.ndarray, rank: int) -> int:
    """The score at that rank, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - rank)[len(scores) - rank]) if len(scores) >= rank else 0


def _query_blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Queries with their distinct terms, in parts of about ``block_bytes`` of text; rows of one id are one query."""
    rows = items.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for part in range(parts):
        chosen = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        terms: dict[object, set[bytes]] = {}
        for row in chosen.collect():
            terms.setdefault(row["id"], set()).update(words_of(bytes(row["text"])))
        yield [(k, sorted(v)) for k, v in sorted(terms.items(), key=lambda x: (x[0] is None, x[0])) if v]


def _index(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """``id, n, terms, tfs``, written: documents with at least one term, and which of the vocabulary they hold how often."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        known = pickle.loads(shared.value).get
        for batch in batches:
            n, at, flat_terms, flat_tfs, sizes = [], [], [], [], []
            for k, text in enumerate(utf8_list(batch, "text")):
                words = words_of(text)
                if words:
                    held = np.fromiter(map(known, words, repeat(-1)), dtype=np.int32, count=len(words))
                    terms, tfs = np.unique(held[held >= 0], return_counts=True)
                    at.append(k)
                    n.append(len(words))
                    sizes.append(len(terms))
                    flat_terms.append(terms)
                    flat_tfs.append(tfs.astype(np.int32))
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat) if flat else [], pa.int32())) for flat in (flat_terms, flat_tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return written(arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>"), "lexical-index")


def _holding(index: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    for row in arrow_map(index.select("terms"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def _searched(index: DataFrame, queries: list[np.ndarray], weight: np.ndarray, n_docs: int, all_terms: int, top: int) -> DataFrame:
    """``query, id, score``: the best documents of each shard for each query, by number."""
    shared, kind = index.sparkSession.sparkContext.broadcast(pickle.dumps((queries, weight))), index.schema["id"].dataType
    arrow_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        asked, weights = pickle.loads(shared.value)
        best: list[list[tuple]] = [[] for _ in asked]
        for batch in gathered(batches, BLOCK_ROWS):
            # documents in the order in which ties are decided
            batch = batch.take(pc.sort_indices(batch.column("id"), null_placement="at_end"))
            ids, sizes = batch.column("id").to_pylist(), pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            m = lengths_of(batch.column("n").to_numpy(), n_docs, all_terms)
            terms, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
            shard = Shard(terms, tfs, np.repeat(np.arange(batch.num_rows), sizes), m, weights)
            for k, wanted in enumerate(asked):
                held = best[k]
                least = held[-1][0] if len(held) == top else 1
                docs, scores = shard.search(wanted, top, max(least, 1))
                if len(docs):
                    held += [(s, ids[d]) for s, d in zip(scores.tolist(), docs.tolist(), strict=True)]
                    held.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
                    del held[top:]
        flat = [(k, i, s) for k, held in enumerate(best) for s, i in held]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], arrow_type), pa.array([x[2] for x in flat], pa.int64())], names=["query", "id", "score"])

    return arrow_map(index, run, f"query int, id {kind.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``top`` documents of highest score above 0.

    Null and wordless texts are no documents, very long ones are taken whole;
    repeated rows are documents of their own; ties go to the smaller id, null
    ids last.  Rows of one item id are one item with all their terms, a null id
    is an item too; an item without terms, or whose terms no document holds, has
    no row, and so have all items of an empty table.  Other columns are not
    read.  Every block of items, of bounded size, is broadcast and takes a pass
    over the texts; texts are not shuffled.
    """
    spark, out = docs.sparkSession, None
    id_type, item_type = (frame.schema[column].dataType.simpleString() for frame, column in ((docs, id_column), (items, item_column)))
    for block in _query_blocks(items, item_column, item_text, block_bytes):
        vocabulary = {word: k for k, word in enumerate(sorted({w for _, words in block for w in words}))}
        index = _index(docs, vocabulary, id_column, text_column)
        n_docs, all_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
        weight = np.array([term_weight(n_docs, n) for n in _holding(index, len(vocabulary)).tolist()], dtype=np.int64)
        found = _searched(index, [np.array([vocabulary[w] for w in words], dtype=np.int64) for _, words in block], weight, n_docs, all_terms, top)
        better = [F.desc("score"), F.asc_nulls_last("id")]
        for keys in (["query", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")], ["query"]):
            found = found.select("query", "id", "score", *keys[1:])
            by = Window.partitionBy("query", *(["salt"] if keys[1:] else [])).orderBy(*better)
            found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], f"query int, item {item_type}")
        # one row for each query of the block
        named = found.join(F.broadcast(names), "query").select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
        out = named if out is None else out.unionByName(named)
    return out if out is not None else spark.createDataFrame([], f"{item_column} {item_type}, rank int, {id_column} {id_type}, score long")
