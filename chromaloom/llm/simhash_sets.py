"""Operator 8 on shingle sets: SimHash rings of many segments, filtered by pigeonring chains, decided by the whole sets.

One 64-bit SimHash cannot tell a similarity of 0.8 from 0.6: the bits that may
differ are too many for any chain of segments to stay equal.  Here each of the
ring's 32 segments is a SimHash of its own, bit by bit the majority of the
hashes of three shingles that the segment draws alike from every text (those
that are least in three orders).  Similar texts then have many segments that are
wholly equal and a few that are not.

By the pigeonring principle two rings within the whole budget have a segment from
which every chain of consecutive segments stays within its proportional budget.
Texts meet in buckets of a chain of two equal segments; the longer chains from
there prune, then the full Hamming distance, and the shingle sets decide.

Only components are wanted, so not all pairs of a bucket are looked at.  First
every text meets its bucket's leader.  Then rounds follow in which a text meets
those texts of its buckets that are of another component so far and pass the
chains, the nearest few at first and more each round, until no
such pair is left that has not been decided.  A bucket whose texts are all of one
component has no more work, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_map, free_name, release_kept, utf8_list, written
from chromaloom.llm.components import components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Segments of a ring, shingles drawn for each, and bits of a segment that may differ on average.
SEGMENTS, DRAWN, BUDGET = 32, 3, 8
#: Nearest texts of other components that a text meets in the first round, and how many times as many in each later one.
NEAREST, GROWTH = 4, 8
#: Buckets of more texts are compared in pairs of parts of about this size; rows that are compared with a bucket at once.
BUCKET_ROWS, ROWS_AT_ONCE = 4096, 32
SEED = 42
#: Shingles whose hashes are held together while rings are made.
SHINGLES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    each = min(words_each, len(words))
    digest = xxhash.xxh64_intdigest
    at = zip(starts[: len(words) - each + 1].tolist(), ends[each - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in at], dtype=np.uint64))


def rings(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 32-bit segments for each set; sets are not empty."""
    rng = np.random.default_rng(SEED)
    together = np.concatenate(sets)
    heads = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.zeros((len(sets), SEGMENTS), dtype=np.uint32)
    for segment in range(SEGMENTS):
        drawn = []
        for _ in range(DRAWN):
            turn, factor = rng.integers(0, 1 << 64, 2, dtype=np.uint64)
            drawn.append(np.minimum.reduceat((together ^ turn) * (factor | np.uint64(1)), heads).astype(np.uint32))
        a, b, c = drawn
        out[:, segment] = (a & b) | (b & c) | (a & c)
    return out


def _ringed(rows: DataFrame, words_each: int) -> DataFrame:
    """``id, row_key, node, ring`` for rows of ``id, row_key, node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        for batch in batches:
            made, sets, held = [], [], 0
            for text in utf8_list(batch, "text"):
                sets.append(shingle_hashes(text, words_each))
                held += len(sets[-1])
                if held >= SHINGLES_AT_ONCE:
                    made += list(rings(sets).view(np.int32))
                    sets, held = [], 0
            if sets:
                made += list(rings(sets).view(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row_key", "node")), pa.array(made, pa.list_(pa.int32()))], names=["id", "row_key", "node", "ring"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, row_key long, node long, ring array<int>")


def _sets(rows: DataFrame, words_each: int) -> DataFrame:
    """``node, shingles`` for rows of ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        for batch in batches:
            sets = [shingle_hashes(t, words_each).view(np.int64) for t in utf8_list(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return arrow_map(rows, run, "node long, shingles array<long>")


def _chains_hold(differing: Column, start: Column) -> Column:
    """Whether all chains of consecutive segments from ``start``, the whole ring last, stay within their budgets."""
    ring = F.concat(F.slice(differing, start + 1, SEGMENTS), F.slice(differing, F.lit(1), start))
    none = F.struct(F.lit(0).alias("length"), F.lit(0).alias("bits"), F.lit(True).alias("holds"))

    def longer(chain: Column, bits: Column) -> Column:
        length, total = chain["length"] + 1, chain["bits"] + bits
        return F.struct(length.alias("length"), total.alias("bits"), (chain["holds"] & (total <= length * BUDGET)).alias("holds"))

    return F.aggregate(ring, none, longer)["holds"]


def _bits_apart(one: Column, other: Column) -> Column:
    """Differing bits of two 32-bit segments; ``bit_count`` takes a negative integer for a long."""
    return F.bit_count(one.bitwiseXOR(other).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def _candidates(met: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``u, v`` of ``start, u, v`` that pass the chains from one of their starts."""
    pairs = met.groupBy("u", "v").agg(F.collect_set("start").alias("starts"))
    first, second = (texts.select(F.col("node").alias(n), F.col("ring").alias(r)) for n, r in (("u", "a"), ("v", "b")))
    both = pairs.join(first, "u").join(second, "v").withColumn("differing", F.zip_with("a", "b", _bits_apart))
    return both.where(F.exists("starts", lambda start: _chains_hold(F.col("differing"), start))).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose shingle sets have that similarity at least."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= F.lit(similarity) * (F.size("a") + F.size("b") - common)).select("u", "v")


def _pair(one: Column, other: Column) -> list[Column]:
    return [F.least(one, other).alias("u"), F.greatest(one, other).alias("v")]


def _met_before(bits: np.ndarray, start: int) -> np.ndarray:
    """Which pairs, by the bits that differ in each segment, share a bucket of an earlier start from which they stay within all budgets."""
    budget, before = BUDGET * np.arange(1, SEGMENTS + 1), np.zeros(len(bits), dtype=bool)
    for s in range(start):
        at = np.flatnonzero((bits[:, s] == 0) & (bits[:, (s + 1) % SEGMENTS] == 0) & ~before)
        before[at] = (np.cumsum(np.roll(bits[at], -s, axis=1), axis=1, dtype=np.int16) <= budget).all(axis=1)
    return before


def bucket_pairs(nodes: np.ndarray, labels: np.ndarray, ring: np.ndarray, start: int, nearest: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one bucket that are of different components and stay within all budgets from ``start``: for each text the nearest, and whether there are more.

    A pair that shares several such buckets is met in the one of the earliest start.
    """
    turned = np.roll(ring, -start, axis=1)
    budget = BUDGET * np.arange(1, SEGMENTS + 1)
    one, other, more = [], [], False
    # texts of the component that has most need not ask: those of the others ask for them
    names, which, counts = np.unique(labels, return_inverse=True, return_counts=True)
    asking = np.flatnonzero(which != np.argmax(counts))
    for k in range(0, len(asking), ROWS_AT_ONCE):
        own = asking[k : k + ROWS_AT_ONCE]
        apart = np.cumsum(np.bitwise_count(turned[own][:, None, :] ^ turned[None, :, :]), axis=2, dtype=np.int16)
        far = np.where((apart <= budget).all(axis=2) & (labels[own][:, None] != labels[None, :]), apart[:, :, -1], np.int16(SEGMENTS * 32 + 1))
        rows, columns = np.nonzero(far <= SEGMENTS * 32)
        again = _met_before(np.bitwise_count(ring[own[rows]] ^ ring[columns]), start)
        far[rows[again], columns[again]] = SEGMENTS * 32 + 1
        for row, at in zip(far, own, strict=True):
            near = np.flatnonzero(row <= SEGMENTS * 32)
            if len(near) > nearest:
                more = True
                near = near[np.lexsort((nodes[near], row[near]))[:nearest]]
            one.append(np.full(len(near), nodes[at]))
            other.append(nodes[near])
    if not one:
        return nodes[:0], nodes[:0], False
    a, b = np.concatenate(one), np.concatenate(other)
    return np.minimum(a, b), np.maximum(a, b), more


def _met(rows: DataFrame, nearest: int) -> DataFrame:
    """``u, v, more``: :func:`bucket_pairs` of all buckets of ``key, part, start, node, label, ring``; a row without ``u`` says that there are more."""

    def found(held: pa.Table) -> pa.RecordBatch:
        ring = np.stack(held.column("ring").to_pylist()).astype(np.int32).view(np.uint32)
        u, v, more = bucket_pairs(held.column("node").to_numpy(), held.column("label").to_numpy(), ring, held.column("start")[0].as_py(), nearest)
        pairs = np.unique(np.stack([u, v], axis=1), axis=0)
        last = [None] * more
        return pa.RecordBatch.from_arrays([pa.array([*pairs[:, 0].tolist(), *last], pa.int64()), pa.array([*pairs[:, 1].tolist(), *last], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, parts = batch.column("key").to_numpy(), batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in pairwise(edges):
                if held and (held[0].column("key")[0].as_py(), held[0].column("part")[0].as_py()) != (int(keys[a]), int(parts[a])):
                    yield found(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield found(pa.Table.from_batches(held))

    return arrow_map(rows.repartition("key", "part").sortWithinPartitions("key", "part"), run, "u long, v long")


def _in_parts(rows: DataFrame) -> DataFrame:
    """Rows of ``key, node, n`` with ``part``: those of a large bucket go to every pair of parts that holds theirs."""
    parts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.least(own, other).cast("long") * parts + F.greatest(own, other))
    return rows.withColumn("part", F.explode(pairs))


def _links(buckets: DataFrame, texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``node, root``: components of the texts of the buckets ``key, start, node, n, weight``, whose weight is a text's sum of ``n``."""
    # the leader is the text that shares most: an original, from which its copies differ less than from one another
    order = F.struct((-F.col("weight")).alias("weight"), F.xxhash64("node").alias("order"), "node")
    leaders = buckets.groupBy("key").agg(F.min(order).alias("first")).select("key", F.col("first.node").alias("leader"))
    met = buckets.join(leaders.hint("merge"), "key").where("node != leader").select("start", *_pair(F.col("node"), F.col("leader")))
    decided = written(_candidates(met, texts), "candidates")
    roots = components(written(_verified(decided, sets, similarity), "links"))
    nodes, nearest = buckets.select("node").distinct(), NEAREST
    labels = written(nodes.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels")
    while True:
        labelled = buckets.select("key", "start", "node", "n").join(labels.hint("merge"), "node")
        mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("key")
        open_rows = labelled.join(mixed.hint("merge"), "key", "left_semi").join(texts.select("node", "ring").hint("merge"), "node")
        pairs = written(_met(_in_parts(open_rows), nearest).distinct(), "met")
        # pairs that have been decided and failed are met again, so more are asked for each time
        fresh = written(pairs.where("u is not null").join(decided.hint("merge"), ["u", "v"], "left_anti"), "fresh")
        if fresh.isEmpty() and pairs.where("u is null").isEmpty():
            return labels.withColumnRenamed("label", "root")
        links = written(_verified(fresh, sets, similarity), "links")
        if not links.isEmpty():
            # components are joined, not found anew: links lead between their least nodes
            ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")).hint("merge") for c in "uv"]
            between = links.join(ends[0], "u").join(ends[1], "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
            joined = components(between).withColumnRenamed("node", "label")
            labels = written(labels.join(joined.hint("merge"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        decided = decided.unionByName(fresh)
        nearest *= GROWTH


def drop_similar(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of texts whose shingle sets have that similarity at least; all columns are kept.

    The row with the least id stays, rows without an id only where the component
    has no other, and of rows that repeat both id and text one.  Null, empty and
    wordless texts all stay; a text of fewer words is one shingle; very long
    texts are taken whole; an empty table gives an empty one; columns of any
    other name are left alone.  Texts and rows are told apart by 64-bit hashes.
    """
    text, own = F.col(text_column).cast("string"), free_name(docs, "row_key")
    row_key = F.xxhash64(F.col(id_column).cast("string"), text)
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).select(F.col(id_column).alias("id"), row_key.alias("row_key"), F.xxhash64(text).alias("node"), text.alias("text"))
    ringed = written(_ringed(rows, shingle_words), "ringed")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key"))
    # copies of one text are looked at once
    texts = written(ringed.groupBy("node").agg(least.alias("least"), F.first("ring").alias("ring")), "texts")
    place, ring = F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), F.concat("ring", F.slice("ring", 1, 1))
    keys = F.transform(place, lambda k: F.struct(k.alias("start"), F.xxhash64(k, F.col("ring")[k], F.col("ring")[k + 1]).alias("key")))
    buckets = texts.select("node", ring.alias("ring")).select("node", F.explode(keys).alias("at")).select("at.key", "at.start", "node")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(buckets.join(shared.hint("merge"), "key"), "shared")
    weights = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    buckets = written(buckets.join(weights.hint("merge"), "node").select("key", "start", "node", "n", "weight"), "buckets")
    # one row of each text that shares a bucket; by a shuffle at every size, as the list grows with the documents
    chosen = texts.join(buckets.select("node").distinct().hint("merge"), "node", "left_semi").select(F.col("least.row_key").alias("row_key"))
    candidates = rows.select("row_key", "node", "text").join(chosen.hint("merge"), "row_key", "left_semi").dropDuplicates(["row_key"])
    sets = written(_sets(candidates, shingle_words), "sets")
    roots = _links(buckets, texts, sets, similarity).withColumnRenamed("node", "linked")
    placed = texts.join(roots, F.col("node") == F.col("linked"), "left").select(F.coalesce("root", "node").alias("root"), "least")
    kept = written(placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row_key").alias(own)), "kept")
    stays = docs.where(worded).withColumn(own, row_key).join(kept.hint("merge"), own, "left_semi").dropDuplicates([own])
    return docs.where(~worded).unionByName(stays.drop(own))
