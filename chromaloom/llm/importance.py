"""Operator 11: importance resampling towards a target distribution, by partition-local word tries.

A document's features are its runs of one to ``longest`` consecutive words, each
falling into a bucket by the CRC-32 of its bytes.  Every task keeps the runs of
its own partition in a trie of words: a node is a run and holds how often it was
passed and the CRC of its bytes, so a run one word longer only adds that word's
bytes.  When a task ends, or its trie is full, the counts of the nodes go to the
totals of their buckets; the totals of all tasks and both sides are merged, and
give each bucket its gain.  Documents are then scored by walking such tries
again, with the gains attached to the nodes, and drawn by weight plus Gumbel
noise, which samples without replacement in proportion to the exponential of the
weight.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_map, release_kept, utf8_list, written
from chromaloom.llm.decontamination import words_of

BUCKETS, LONGEST = 10_000, 1
#: Only documents of so many words can be drawn, and so many of a hundred of them are.
LEAST_WORDS, PERCENT = 20, 10
#: Seed of the noise; scores are in thousandths.
SEED, SCALE = 2024, 1000
#: A trie of more nodes gives its counts to the buckets and starts again.
NODES = 200_000
#: Words that are walked together; a longer text is walked alone.
WORDS_AT_ONCE = 1 << 17


class WordTrie:
    """Runs of words as paths from the root; a node is a number that stands for a run.

    ``gains``, if given, are attached to the nodes by their buckets.
    """

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST, gains: np.ndarray | None = None):
        self.buckets, self.longest, self.gains = buckets, longest, gains
        self.clear()

    def clear(self) -> None:
        self.first: dict[bytes, int] = {}
        #: Nodes below the first level by (parent, node of the added word among the first level's).
        self.below: dict[tuple[int, int], int] = {}
        self.crc: list[int] = []
        self.word: list[bytes] = []
        self.count = np.zeros(1024, dtype=np.int64)
        self._gain = np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.crc)

    def _node(self, crc: int, word: bytes) -> int:
        self.crc.append(crc)
        self.word.append(word)
        return len(self.crc) - 1

    def walk(self, words: list[bytes], text: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Nodes that are passed, level by level, each with the text it is passed in; ``text`` numbers each word's."""
        first = self.first
        for word in set(words).difference(first):
            first[word] = self._node(zlib.crc32(word), word)
        level = np.fromiter(map(first.__getitem__, words), dtype=np.int64, count=len(words))
        added, out, whose = level, [(level, text)], text
        for _ in range(1, self.longest):
            # a run grows by the word after it, if that is of the same text
            added = added[1:]
            goes_on = whose[:-1] == text[len(text) - len(added) :]
            pairs = np.stack([level[:-1], added], axis=1)[goes_on]
            distinct, which = np.unique(pairs, axis=0, return_inverse=True)
            nodes = np.empty(len(distinct), dtype=np.int64)
            for k, (parent, word) in enumerate(distinct.tolist()):
                node = self.below.get((parent, word))
                if node is None:
                    node = self.below[parent, word] = self._node(zlib.crc32(b" " + self.word[word], self.crc[parent]), b"")
                nodes[k] = node
            found = nodes[which.reshape(-1)]
            out.append((found, whose[:-1][goes_on]))
            # runs that end with their text stand for nothing from here on; -1 is no text's number
            level = np.full(len(added), -1, dtype=np.int64)
            level[goes_on] = found
            whose = np.where(goes_on, whose[:-1], -1)
        return out

    def add(self, words: list[bytes], text: np.ndarray) -> None:
        """Count the runs of some words."""
        for nodes, _ in self.walk(words, text):
            if len(self.count) < len(self):
                self.count = np.r_[self.count, np.zeros(max(len(self.count), len(self) - len(self.count)), dtype=np.int64)]
            more = np.bincount(nodes, minlength=1)
            self.count[: len(more)] += more

    def totals(self) -> np.ndarray:
        """Counts of the nodes by bucket."""
        out = np.zeros(self.buckets, dtype=np.int64)
        np.add.at(out, np.array(self.crc, dtype=np.int64) % self.buckets, self.count[: len(self)])
        return out

    def weigh(self, words: list[bytes], text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and weight of each of ``texts`` texts."""
        number, weight = np.zeros(texts, dtype=np.int64), np.zeros(texts, dtype=np.int64)
        for nodes, whose in self.walk(words, text):
            if len(self._gain) < len(self):
                new = np.array(self.crc[len(self._gain) :], dtype=np.int64) % self.buckets
                self._gain = np.r_[self._gain, self.gains[new]]
            number += np.bincount(whose, minlength=texts)
            # runs of a text lie together, so sums are differences of running sums, whole numbers throughout
            running, edge = np.r_[0, np.cumsum(self._gain[nodes])], np.searchsorted(whose, np.arange(texts + 1))
            weight += running[edge[1:]] - running[edge[:-1]]
        return number, weight


def _groups(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], np.ndarray]]:
    """Texts in groups: their places, all their words, and the number within the group of each word's text."""
    places, words, sizes = [], [], []
    for k, text in enumerate(texts):
        own = words_of(text)
        if words and len(words) + len(own) > WORDS_AT_ONCE:
            yield places, words, np.repeat(np.arange(len(places)), sizes)
            places, words, sizes = [], [], []
        places.append(k)
        words += own
        sizes.append(len(own))
    if places:
        yield places, words, np.repeat(np.arange(len(places)), sizes)


def bucket_totals(rows: DataFrame, text_column: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket, n``: occurrences of features in whole texts by bucket, those that have any; null texts have none."""
    texts = rows.select(F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        trie, totals = WordTrie(buckets, longest), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, words, text in _groups(utf8_list(batch, "text")):
                if len(words):
                    trie.add(words, text)
                if len(trie) > NODES:
                    totals += trie.totals()
                    trie.clear()
        totals += trie.totals()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at], pa.int64())], names=["bucket", "n"])

    return arrow_map(texts, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths: the smoothed log ratio of its shares in the target and in the source."""
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = (math.floor(SCALE * math.log((target.get(b, 0) + 1) * (s_all + buckets) / ((source.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets))
    return np.fromiter(gain, dtype=np.int64, count=buckets)


def gumbel(id_column: Column, seed: int = SEED) -> Column:
    """Noise in thousandths from the digest of the seed and the id; a null id counts as the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight`` for every whole text; no shuffle."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        own = pickle.loads(shared.value)
        trie = WordTrie(len(own), longest, own)
        for batch in batches:
            n_words, number, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for places, words, text in _groups(utf8_list(batch, "text")):
                n_words[places] = np.bincount(text, minlength=len(places)) if len(text) else 0
                if len(words):
                    number[places], weight[places] = trie.weigh(words, text, len(places))
                if len(trie) > NODES:
                    trie.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (n_words, number, weight))], names=["id", "n_words", "n_features", "weight"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: Iterable[Column], rank: str = "rank") -> DataFrame:
    """``rows``, written, with their place (from 1) in a total order.

    Rows are dealt by range and sorted; each knows its place within its range,
    and the ranges' lengths (as many numbers as there are ranges) give the rest.
    """
    order = list(order)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("place_", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("place_", 33).alias("part_"), F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "part_ long, before_ long")
    # one row for each range
    placed = dealt.withColumn("part_", part).join(F.broadcast(starts), "part_")
    return placed.select(*rows.columns, (F.col("before_") + within + 1).alias(rank))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text") -> DataFrame:
    """``id, n_features, weight, score, rank`` for every document; rank is null for those that are not drawn.

    A null or wordless text has no features and weight 0, very long texts are
    taken whole, repeated rows count and are drawn each, a null id is noise of
    the empty text and ranks after others of its score; ties go to the smaller
    id.  With fewer than ``100 / percent`` eligible documents none is drawn.  An
    empty target gives gains from the smoothing alone, an empty table an empty
    one; other columns are not read.  The driver gets the ``buckets`` totals of
    both sides; only ids and numbers are shuffled.
    """
    totals = [{r["bucket"]: r["n"] for r in bucket_totals(*side, buckets, longest).collect()} for side in ((docs, text_column), (target, target_text))]
    scored = weights(docs, bucket_gains(*totals, buckets), longest, id_column, text_column)
    scored = scored.select("id", "n_features", "weight", (F.col("weight") + gumbel(F.col("id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    # numbers only, written: dealing by range looks at them twice
    placed = ranked(written(scored, "weights"), [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("id")], "place")
    drawn = placed.agg(F.count_if("eligible")).head()[0] * percent // 100
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    return placed.select(F.col("id").alias(id_column), "n_features", "weight", "score", rank.alias("rank"))
