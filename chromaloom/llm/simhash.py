"""Operator 8: SimHash near-duplicates with pigeonring filtering.

The 64 bits of a fingerprint are a ring of four segments.  By the pigeonring
principle two fingerprints that differ in at most ``d`` bits have a segment from
which every chain of 1, 2, 3 .. consecutive segments differs in at most 1/4, 2/4,
3/4 .. of ``d``.  With d = 3 the first segment is equal and the second differs in
one bit at most, so one of its halves is equal too: fingerprints meet in buckets
of a segment and a half of the next.  In a bucket the chains are checked before
the full distance.  Each bucket gives a spanning forest of its links, not all
pairs, and the components of the forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_map, gathered, release_kept, utf8_list, written
from chromaloom.llm.components import components

DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
SEGMENTS, SEGMENT_BITS, HALF_BITS = 4, 16, 8
#: Buckets of more rows are compared in pairs of parts of about this size.
BUCKET_ROWS = 4096
#: Of buckets up to this size the links are found for all buckets of a batch together.
SMALL_BUCKET = 16
#: Bucket rows that a task looks at together.
LINK_ROWS = 20_000
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text: bit k is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= words_each:
        starts, ends = starts[: len(words) - words_each + 1], ends[words_each - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), _SHINGLES_AT_ONCE):
        at = zip(starts[k : k + _SHINGLES_AT_ONCE].tolist(), ends[k : k + _SHINGLES_AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in at], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, fp`` for every whole text, however long, fp as a signed long; null and wordless texts have 0."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        for batch in batches:
            made = np.array([fingerprint(t) for t in utf8_list(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made.view(np.int64))], names=["id", "fp"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def bucketed(distinct: DataFrame) -> DataFrame:
    """``key, fp``: each fingerprint in its eight buckets; a key is start, half, segment and half's bits."""
    keys = []
    for start in range(SEGMENTS):
        segment = F.shiftrightunsigned("fp", SEGMENT_BITS * start).bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            shift = (SEGMENT_BITS * (start + 1)) % 64 + HALF_BITS * half
            bits = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFF))
            keys.append(F.lit((start * 2 + half) << 24).cast("long") + segment * 256 + bits)
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _divided(buckets: DataFrame) -> DataFrame:
    """``key, part, fp``: rows of a large bucket go to every pair of parts that holds theirs."""
    hot = written(
        buckets.groupBy("key").count().where(F.col("count") > BUCKET_ROWS).select("key", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("parts")), "hot"
    )
    if hot.isEmpty():
        return buckets.select("key", F.lit(0).cast("long").alias("part"), "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(F.col("own"), other).cast("long") * F.col("parts") + F.greatest(F.col("own"), other))
    # not broadcast by hand: Spark broadcasts the hot keys only where their measured size allows it
    met = buckets.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    return met.select("key", F.explode(pairs).alias("part"), "fp")


def _within(first: np.ndarray, second: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which pairs stay within the chain budgets from segment ``start``, and within the distance."""
    differing = first ^ second
    bits = np.uint64(SEGMENT_BITS)
    turn = np.asarray(start, dtype=np.uint64) * bits
    ring = (differing >> turn) | np.where(turn == 0, np.uint64(0), differing << ((np.uint64(64) - turn) % np.uint64(64)))
    fine = np.ones(len(differing), dtype=bool)
    for chain in range(1, SEGMENTS):
        at = np.flatnonzero(fine)
        mask = np.uint64((1 << (SEGMENT_BITS * chain)) - 1)
        fine[at] = np.bitwise_count(ring[at] & mask) * SEGMENTS <= DISTANCE * chain
    at = np.flatnonzero(fine)
    fine[at] = np.bitwise_count(ring[at]) <= DISTANCE
    return fine


def forest(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one bucket: each fingerprint is compared with those not yet reached."""
    left, sources, targets = np.arange(len(fps)), [], []
    waiting: list[int] = []
    while len(left):
        if not waiting:
            waiting, left = [int(left[0])], left[1:]
        at = waiting.pop()
        near = _within(np.broadcast_to(fps[at], len(left)), fps[left], start)
        if near.any():
            reached = left[near]
            sources.append(np.full(len(reached), at))
            targets.append(reached)
            waiting.extend(reached.tolist())
            left = left[~near]
    if not sources:
        return fps[:0], fps[:0]
    return fps[np.concatenate(sources)], fps[np.concatenate(targets)]


def bucket_links(keys: np.ndarray, parts: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets that lie one after another."""
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])])
    sizes = np.diff(np.r_[new, len(keys)])
    starts = (keys >> 25).astype(np.int64)
    sources, targets = [fps[:0]], [fps[:0]]
    for at in np.flatnonzero(sizes > SMALL_BUCKET):
        rows = slice(new[at], new[at] + sizes[at])
        a, b = forest(fps[rows], int(starts[new[at]]))
        sources.append(a)
        targets.append(b)
    bucket = np.repeat(np.arange(len(new)), sizes)
    small = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL_BUCKET)
    for step in range(1, SMALL_BUCKET):
        first = small[small + step < len(keys)]
        first = first[bucket[first] == bucket[first + step]]
        if not len(first):
            break
        near = _within(fps[first], fps[first + step], starts[first])
        sources.append(fps[first[near]])
        targets.append(fps[first[near] + step])
    return np.concatenate(sources), np.concatenate(targets)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets that arrive sorted; the last bucket waits for the next batch."""

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = bucket_links(rows[0], rows[1], rows[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(name).to_numpy() for name in ("key", "part", "fp")]
        rows = rows if held is None else [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
        keys, parts = rows[0], rows[1]
        cut = int(np.flatnonzero((keys != keys[-1]) | (parts != parts[-1]))[-1]) + 1 if (keys[0], parts[0]) != (keys[-1], parts[-1]) else 0
        if cut:
            yield out([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
    if held is not None:
        yield out(held)


def links(distinct: DataFrame) -> DataFrame:
    """``u, v``: links between distinct fingerprints whose components are those of all links within the distance."""
    rows = _divided(bucketed(distinct)).repartition("key", "part").sortWithinPartitions("key", "part")
    return rows.mapInArrow(lambda batches: _link_batches(gathered(batches, LINK_ROWS)), "u long, v long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, fingerprint, component_id`` for every document.

    Fingerprints within three bits of each other link; a component is all that
    links reach and its id the least document id in it (null ids are passed
    over; null if it has no other).  Null and wordless texts share the
    fingerprint zero, which links like any other.  Copies share a fingerprint
    and are looked at once, however many they are.  Repeated rows are kept.
    """
    made = written(fingerprints(docs, id_column, text_column), "fingerprints")
    distinct = written(made.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    least = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    by_print = written(placed.join(least, "root").select("fp", "component_id"), "by-print")
    joined = made.join(by_print, "fp")
    return joined.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
