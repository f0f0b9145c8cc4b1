"""Operator 2: a quality classifier by a factorisation machine.

Features of a text are its hashed words, statistics of its structure and its
metadata (the declared number of characters against the real one).  The machine
adds to a linear score the products of all pairs of features, weighted by inner
products of low-rank factors; by the identity "square of the sum minus sum of
squares" this costs time linear in the features.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from chromaloom.llm.common import arrow_map, id_remainder, release_kept, utf8_list

#: Hashed words share so many features; structure and metadata follow.
WORD_FEATURES = 1 << 14
RANK = 8
#: Labelled rows that the machine is fitted on, at most; they are the least by a hash of their id.
TRAINING_ROWS = 8_000
#: Scores from here on are good.
THRESHOLD = 0.3
EPOCHS, RATE, SHRINK = 6, 0.05, 1e-5
_HASHES_KEPT = 100_000
_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_UPPER, _LOWER, _DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0x30, 0x3A))
_MARKS = b"#$%&*|!<>{}[]=_@~^\\"
STRUCTURE = (
    "bias", "log_bytes", "log_words", "word_length", "upper", "digits", "punctuation", "marks", "spaces", "lines_per_word", "line_length",
    "distinct_words", "most_frequent", "short_words", "long_words", "sentence_ends", "capitalised", "repeated_lines", "non_ascii", "marked_words", "declared_length",
)
FEATURES = WORD_FEATURES + len(STRUCTURE)


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


class Features:
    """Turns texts into sparse features, remembering the hashes of words."""

    def __init__(self) -> None:
        self.bucket: dict[bytes, int] = {}

    def _buckets(self, words: list[bytes]) -> np.ndarray:
        known = self.bucket
        if len(known) > _HASHES_KEPT:
            known.clear()
        for word in [w for w in set(words) if w not in known]:
            known[word] = zlib.crc32(word) % WORD_FEATURES
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def of(self, text: bytes, declared: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of one text; an empty text has the bias and the declared length alone."""
        words = text.split()
        folded = text.lower().split()
        n, size = len(words), len(text)
        counts = np.bincount(self._buckets(folded), minlength=1) if n else np.zeros(1, dtype=np.int64)
        at = np.flatnonzero(counts)
        values = np.log1p(counts[at])
        if len(at):
            values = values / np.sqrt((values * values).sum())
        lines = text.split(b"\n")
        held = [line for line in lines if line.strip()]
        characters = len(text.decode("utf-8", "replace"))
        upper, lower, digits = (size - len(text.translate(None, kind)) for kind in (_UPPER, _LOWER, _DIGITS))
        distinct = len(set(folded))
        structure = [
            1.0,
            np.log1p(size) / 12,
            np.log1p(n) / 10,
            min(_share(sum(map(len, words)), n) / 12, 3.0),
            _share(upper, upper + lower),
            _share(digits, size),
            _share(size - len(text.translate(None, _PUNCTUATION)), size) * 4,
            _share(size - len(text.translate(None, _MARKS)), size) * 8,
            _share(size - len(text.translate(None, b" \t\n\r\x0b\x0c")), size),
            min(_share(len(lines), n), 2.0),
            np.log1p(_share(n, len(held))) / 6,
            _share(distinct, n),
            _share(float(counts.max()), n),
            _share(sum(len(w) <= 2 for w in words), n),
            _share(sum(len(w) >= 14 for w in words), n),
            _share(text.count(b".") + text.count(b"?") + text.count(b"!"), n) * 2,
            _share(sum(w[:1].isupper() for w in words), n),
            _share(len(held) - len(set(held)), len(held)),
            _share(size - characters, size),
            _share(sum(w[-1] in _MARKS for w in words), n),
            0.0 if declared is None else float(np.clip(np.log1p(max(declared, 0)) - np.log1p(characters), -2, 2)),
        ]
        index = np.r_[at, np.arange(WORD_FEATURES, FEATURES)]
        return index, np.r_[values, np.nan_to_num(structure)]


class FactorisationMachine:
    """Weights ``w`` and factors ``v`` of every feature; the bias is a feature."""

    def __init__(self, features: int = FEATURES, rank: int = RANK, seed: int = 2):
        self.w = np.zeros(features)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (features, rank))

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        """Linear score plus all pairwise products, in linear time."""
        scaled = self.v[index] * value[:, None]
        total = scaled.sum(axis=0)
        return float(self.w[index] @ value + 0.5 * (total @ total - (scaled * scaled).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        """Probability of label 1."""
        return float(1 / (1 + np.exp(-np.clip(self.raw(index, value), -35, 35))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 2) -> FactorisationMachine:
        """Logistic loss by AdaGrad, one row after another in a seeded order."""
        labels = np.asarray(labels)
        share = labels.mean() if len(labels) else 0.5
        if not len(rows) or share in (0.0, 1.0):
            self.w[WORD_FEATURES] = 8.0 * (2 * share - 1) if len(rows) else 0.0
            self.v[:] = 0
            return self
        # weights of the square root of the inverse frequency keep scores between both priors
        weight = np.where(labels == 1, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
        gw, gv = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                index, value = rows[k]
                factors = self.v[index]
                scaled = factors * value[:, None]
                total = scaled.sum(axis=0)
                raw = self.w[index] @ value + 0.5 * (total @ total - (scaled * scaled).sum())
                slope = weight[k] * (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[k])
                dw = slope * value + SHRINK * self.w[index]
                dv = slope * value[:, None] * (total[None, :] - scaled) + SHRINK * factors
                gw[index] += dw * dw
                gv[index] += dv * dv
                self.w[index] -= rate * dw / np.sqrt(gw[index])
                self.v[index] = factors - rate * dv / np.sqrt(gv[index])
        return self


def fit_machine(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", length_column: str = "n_chars") -> FactorisationMachine:
    """Fit on labelled rows whose ``crc32(id as text) mod 5`` is not 0, at most ``training_rows`` of them.

    The rows are the least by a hash of their id, then by id and by a hash of
    their text; rows that repeat both are one row, and of several labels of an
    id the highest holds.  Features are made on the executors from whole texts,
    however long; the driver gets those of the bounded sample only.  Null labels
    and null ids are passed over, a null text is the empty one; without labels,
    or without rows, every score is one half.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("id is not null and label is not null")
    chosen = known.where(id_remainder("id", 5) != 0).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(training_rows).collect()
    if not chosen:
        return FactorisationMachine().fit([], [])
    spark = docs.sparkSession
    label_of = {r["id"]: int(r["label"] > 0) for r in chosen}
    sample = spark.createDataFrame([(k,) for k in label_of], f"id {known.schema['id'].dataType.simpleString()}")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), F.col(length_column).cast("long").alias("declared"))
    # at most training_rows ids, then as many rows: sides of bounded size
    rows = rows.join(F.broadcast(sample), "id", "left_semi")
    keys = rows.select("id", "key").distinct().orderBy(F.xxhash64("id"), "id", "key").limit(training_rows).collect()
    if not keys:
        return FactorisationMachine().fit([], [])
    rows = rows.join(F.broadcast(spark.createDataFrame(keys, rows.select("id", "key").schema)), ["id", "key"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        features = Features()
        for batch in batches:
            made = [features.of(t, n) for t, n in zip(utf8_list(batch, "text"), batch.column("declared").to_pylist(), strict=True)]
            index = pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32()))
            value = pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), index, value], names=["id", "key", "index", "value"])

    made = arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, key long, index array<int>, value array<float>")
    first = F.min(F.struct("value", "index")).alias("first")
    got = made.groupBy("id", "key").agg(first).select("id", "key", "first.index", "first.value").toArrow()
    ids, keys = got.column("id").to_pylist(), got.column("key").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], keys[k]))
    index, value = got.column("index").combine_chunks(), got.column("value").combine_chunks()
    data = [(index[k].values.to_numpy(zero_copy_only=False).astype(np.int64), value[k].values.to_numpy(zero_copy_only=False).astype(np.float64)) for k in order]
    return FactorisationMachine().fit(data, [label_of[ids[k]] for k in order])


_FEATURES = Features()


def _scoring(docs: DataFrame, machine: FactorisationMachine, text_column: str, length_column: str):
    """A function for the executors: the scores of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((machine.w.astype(np.float32), machine.v.astype(np.float32))))
    place, length = docs.columns.index(text_column), docs.columns.index(length_column)

    def scorer():
        release_kept()
        model = FactorisationMachine.__new__(FactorisationMachine)
        model.w, model.v = pickle.loads(shared.value)
        return lambda batch: [model.score(*_FEATURES.of(t or b"", n)) for t, n in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(length).to_pylist(), strict=True)]

    return scorer


def score_documents(docs: DataFrame, machine: FactorisationMachine, threshold: float = THRESHOLD, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from the threshold on).

    Null texts are scored as empty ones, very long ones whole; repeated rows get
    equal scores; a null declared length counts as right; a score equal to the
    threshold is 1; an empty table gives an empty one.  Other columns are no
    input and stay, except that ``score`` and ``predicted`` are replaced.  No shuffle.
    """
    kept = docs.drop("score", "predicted")
    scorer = _scoring(kept, machine, text_column, length_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = scorer()
        for batch in batches:
            scores = scores_of(batch)
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    schema = StructType([*kept.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return arrow_map(kept, run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """The documents that the classifier does not reject, with just their own columns, whatever their names."""
    scorer = _scoring(docs, fit_machine(docs, labels), text_column, length_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = scorer()
        for batch in batches:
            yield batch.filter(pa.array([s >= threshold for s in scores_of(batch)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
