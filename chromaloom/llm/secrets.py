"""Operator 9: secret scans by base patterns and a ratio of two character Markov models.

Three patterns find assignments, access keys and long hexadecimal runs.  Besides,
every long run of key characters is scored by two Markov models of characters,
one of random strings and one of ordinary identifiers, both trained from labelled
samples; a run whose log-likelihood ratio passes the threshold is a secret too.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_map, string_list

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "markov")
_NAMES = ["password", "passwd", "secret", "token", "api_?key"]
_EITHER = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", name) for name in _NAMES)
_ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_LONG = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARACTERS, ACCESS_CHARACTERS = 8, 16

#: What the Markov models may score: runs of these characters between others, of this length at least.
_RUN = re.compile(r"(?<![^\W_])[A-Za-z0-9+/_-]{16,}={0,2}(?![^\W_])")
_RUN_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_AT = {c: k for k, c in enumerate(_RUN_ASCII)}
#: A secret's log-likelihood ratio: in nats for the run, and for each of its characters.
THRESHOLD, THRESHOLD_EACH = 12.0, 0.5
#: Documents from which ordinary identifiers and found secrets are taken as samples.
SAMPLE_DOCUMENTS = 2000
#: Random strings that are made as samples.
RANDOM_SAMPLES = 6000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in code points, sorted."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARACTERS]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARACTERS]
    # a match of the pattern is a maximal run, so asking for 32 characters finds the same runs
    spans += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    return sorted(spans)


def spelled(spans: Iterable[tuple[int, int, int]]) -> str:
    """``kind:start:end`` of spans, joined by commas."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def transitions(strings: Iterable[str]) -> np.ndarray:
    """Counts of first characters (row 0) and of neighbouring characters (row 1 + the first of them)."""
    size = len(_RUN_ASCII)
    code = []
    for string in strings:
        at = [_AT[c] for c in string if c in _AT]
        if at:
            code.append(np.r_[0, 1 + np.array(at[:-1], dtype=np.int64)] * size + at)
    return np.bincount(np.concatenate(code), minlength=(size + 1) * size).reshape(size + 1, size) if code else np.zeros((size + 1, size), dtype=np.int64)


class MarkovRatio:
    """Two first-order Markov models of characters, from their transition counts, and their log-likelihood ratio."""

    def __init__(self, random_counts: np.ndarray, identifier_counts: np.ndarray, smoothing: float = 0.5):
        logs = []
        for counts in (random_counts, identifier_counts):
            first, pairs = counts[0] + smoothing, counts[1:] + smoothing
            logs.append((np.log(first / first.sum()), np.log(pairs / pairs.sum(axis=1, keepdims=True))))
        self.first = (logs[0][0] - logs[1][0]).tolist()
        self.pair = {a + b: float(logs[0][1][i, j] - logs[1][1][i, j]) for a, i in _AT.items() for b, j in _AT.items()}

    def ratio(self, string: str) -> float:
        """ln of the string's likelihood as a random one over that as an identifier."""
        return self.first[_AT[string[0]]] + sum(map(self.pair.__getitem__, map(str.__add__, string, string[1:])))

    def secret(self, string: str) -> bool:
        ratio = self.ratio(string)
        return ratio >= THRESHOLD and ratio >= THRESHOLD_EACH * len(string)


def random_strings(count: int = RANDOM_SAMPLES, seed: int = 9) -> list[str]:
    """Labelled samples of secrets: strings drawn evenly from the alphabets that keys use."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [digits + "abcdef", upper + digits, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", lower + digits]
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(16, 64))) for k in range(count)]


_WORDS = re.compile(r"[A-Za-z0-9_-]{4,}")


def labelled_samples(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Transition counts of random strings and of ordinary identifiers, from at most ``sample_documents`` whole texts.

    What the base patterns find in those is labelled random, what surrounds it
    ordinary, pairs of neighbouring words joined by ``_`` or ``-`` or nothing
    among it; made random strings are added.  The texts are those of the rows
    with the least hash of their id, then the least id and hash of their text;
    rows that repeat both are one row, rows without an id are passed over.  The
    executors count whole texts, so the driver gets tables of a fixed size.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")).where(F.col("id").isNotNull())
    keys = rows.select("id", "key").distinct().orderBy(F.xxhash64("id"), "id", "key").limit(sample_documents)
    chosen = keys.collect()
    size = len(_RUN_ASCII)
    secret_counts, plain_counts = transitions(random_strings()), np.zeros((size + 1, size), dtype=np.int64)
    if not chosen:
        return secret_counts, plain_counts
    # a side of at most sample_documents rows; of rows that repeat id and text one is taken
    sample = docs.sparkSession.createDataFrame(chosen, keys.schema)
    texts = rows.join(F.broadcast(sample), ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min("text").alias("text")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((size + 1, size), dtype=np.int64) for _ in range(2)]
        for batch in batches:
            for text in string_list(batch, "text"):
                at, secret, rest = 0, [], []
                for start, kind, end in base_spans(text):
                    secret.append(text[start:end] if kind else re.split(r"[:=\s\"']+", text[start:end])[-1])
                    rest.append(text[at:start])
                    at = max(at, end)
                words = _WORDS.findall(" ".join([*rest, text[at:]]))
                joined = (a + "_-"[k % 2] + b if k % 3 else a + b for k, (a, b) in enumerate(zip(words[::2], words[1::2], strict=False)))
                counts[0] += transitions(secret)
                counts[1] += transitions(chain(words, joined))
        yield pa.RecordBatch.from_arrays([pa.array([c.ravel()], pa.list_(pa.int64())) for c in counts], names=["secret", "plain"])

    for row in arrow_map(texts, run, "secret array<long>, plain array<long>").collect():
        secret_counts += np.array(row["secret"]).reshape(secret_counts.shape)
        plain_counts += np.array(row["plain"]).reshape(plain_counts.shape)
    return secret_counts, plain_counts


def markov_spans(text: str, base: list[tuple[int, int, int]], model: MarkovRatio) -> list[tuple[int, int, int]]:
    """Runs that the model takes for random and that touch no base span; both lists ascend, so one pass is enough."""
    out, at, reach = [], 0, 0
    for m in _RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and model.secret(m[0]):
            out.append((m.start(), 3, m.end()))
    return out


def find_secrets(docs: DataFrame, model: MarkovRatio, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` for every whole text.

    A run of key characters that touches no base span and that the model takes
    for random is a span of kind ``markov``; base spans stay as they are.
    Null and empty texts have no spans, very long ones are scanned whole in one
    pass; a ratio equal to a threshold is a secret; repeated rows are scanned
    each; a null id stays null; an empty table gives an empty one; other columns
    are not read.  Offsets are code points, the end exclusive.  No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, all_spans = [], []
            for text in string_list(batch, "text"):
                spans = base_spans(text)
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in spans))
                digests.append(hashlib.sha256(spelled(spans).encode()).hexdigest())
                more = markov_spans(text, spans, model)
                all_spans.append(spelled(sorted([*spans, *more])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                names=[id_column, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return arrow_map(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
