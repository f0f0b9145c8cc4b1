"""Operator 5: token counts by rank-synchronous array merging.

The pre-tokens of a batch lie end to end in numpy arrays.  In each round every
sequence applies its own lowest-rank pair, all sequences at once; a sequence
without a pair is done and the symbols that survive are its tokens.  The pairs
of a sequence that share the lowest rank merge in the same round, which equals
merging them one by one because a merge never makes a pair of lower rank than
its own (checked when the vocabulary is loaded).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chromaloom.llm.common import TwoGenerationCache, arrow_map, kept_by_worker, string_list
from chromaloom.llm.pretokens import piece_finder

#: Pre-tokens kept with their counts by a Python worker, and bytes merged at once.
CACHED_PIECES = 250_000
BYTES_AT_ONCE = 1 << 20
#: Pre-tokens of more bytes are merged by themselves, each merge touching only its own places.
LONG_PIECE = 1024
_NO_RANK = np.iinfo(np.int64).max


def byte_characters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {byte: chr(byte) for byte in printable}
    hidden = (byte for byte in range(256) if byte not in shown)
    return shown | {byte: chr(0x100 + k) for k, byte in enumerate(hidden)}


class MergeTable:
    """A byte-level BPE vocabulary as sorted arrays of pairs, ranks and merged symbols."""

    def __init__(self, definition: str, pattern: str):
        spec = json.loads(definition)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[c] for _, c in sorted(byte_characters().items())], dtype=np.int64)
        born = {}
        keys, merged = [], []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if max(born.get(left, -1), born.get(right, -1)) >= rank:
                raise ValueError(f"merge {rank} uses a symbol that a later merge makes")
            born.setdefault(left + right, rank)
            keys.append(vocab[left] * self.size + vocab[right])
            merged.append(vocab[left + right])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.by_rank = np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64)
        self.ranks = order.astype(np.int64)
        self.merged = np.array(merged, dtype=np.int64)[order]
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces = piece_finder(pattern)

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings stood between them."""
        if self.special is None or not self.special.search(text):
            return self.pieces(text), 0
        parts = self.special.split(text)
        return [piece for part in parts for piece in self.pieces(part)], len(parts) - 1

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        counts = np.zeros(len(pieces), dtype=np.int64)
        short, held = [], 0
        for k, piece in enumerate(pieces):
            if len(piece) > LONG_PIECE:
                counts[k] = self._count_long(piece)
                continue
            short.append(k)
            held += len(piece)
            if held >= BYTES_AT_ONCE:
                counts[short] = self._count([pieces[n] for n in short])
                short, held = [], 0
        if short:
            counts[short] = self._count([pieces[n] for n in short])
        return counts

    def _count_long(self, piece: bytes) -> int:
        """Tokens of one long piece: the lowest rank left is applied at all its places at once.

        The places of a pair are kept by rank when the pair comes up, so a merge
        looks at these alone; the symbols are linked to their neighbours.  A rank
        comes up for the last time before it is applied, since a merge makes only
        pairs of higher rank.
        """
        symbols = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].copy()
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(left: np.ndarray) -> None:
            left = left[after[left] < n]
            key = symbols[left] * self.size + symbols[after[left]]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            left, rank = left[known], self.ranks[at[known]]
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            heads = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, part in zip(rank[heads].tolist(), np.split(left, heads[1:]), strict=True) if len(rank) else ():
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        note(np.arange(n))
        keys, merged = self.by_rank
        while ranks:
            rank = heapq.heappop(ranks)
            first, second = divmod(int(keys[rank]), self.size)
            left = np.unique(np.concatenate(places.pop(rank)))
            left = left[alive[left] & (symbols[left] == first) & (after[left] < n)]
            left = left[symbols[after[left]] == second]
            if first == second and len(left):
                # of overlapping equal pairs (a a a) every second one merges, from the left
                place = np.arange(len(left))
                fresh = np.r_[True, after[left[:-1]] != left[1:]]
                left = left[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            if not len(left):
                continue
            right = after[left]
            symbols[left], alive[right] = merged[rank], False
            after[left] = after[right]
            inner = after[left] < n
            before[after[left][inner]] = left[inner]
            earlier = before[left]
            note(np.unique(np.r_[left, earlier[earlier >= 0]]))
        return int(alive.sum())

    def _count(self, pieces: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (owner[:-1] == owner[1:]) & (self.keys[at] == key)
            if not known.any():
                break
            rank = np.where(known, self.ranks[at], _NO_RANK)
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, _NO_RANK], heads)
            run = np.diff(np.r_[heads, len(symbols)])
            best = np.repeat(lowest, run)[:-1]
            chosen = known & (rank == best)
            # of overlapping equal pairs (a a a) every second one merges, from the left
            place = np.flatnonzero(chosen)
            first = np.r_[True, np.diff(place) > 1]
            offset = np.arange(len(place)) - np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
            place = place[offset % 2 == 0]
            symbols[place] = self.merged[at[place]]
            np.subtract.at(counts, owner[place], 1)
            alive = np.repeat(lowest, run) != _NO_RANK
            alive[place + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        return counts


class TokenCounter:
    """Counts tokens of texts, remembering the pre-tokens that it has met."""

    def __init__(self, merges: MergeTable):
        self.merges = merges
        self.known = TwoGenerationCache(CACHED_PIECES)

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.merges.split(text) for text in texts]
        if new := self.known.missing(chain.from_iterable(pieces for pieces, _ in parts)):
            self.known.young.update(zip(new, self.merges.count([p.encode() for p in new]).tolist(), strict=True))
        count = self.known.young.__getitem__
        return [sum(map(count, pieces)) + extra for pieces, extra in parts]


def counter_for(definition: str, pattern: str) -> TokenCounter:
    """The counter of this Python worker, kept from task to task."""
    return kept_by_worker("counter", (hash(definition), pattern), lambda: TokenCounter(MergeTable(definition, pattern)))


def count_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of every whole text: ``id, n_bytes, n_tokens, over_limit``.

    Null and empty texts have no bytes and no tokens; very long texts, and long
    pieces without a break, are merged whole; of equal ranks the left merges
    first; just ``limit`` tokens are not over it; repeated rows are counted each;
    a null id stays null; an empty table gives an empty one; other columns are
    not read.  Rows keep their partitions: no shuffle.  The vocabulary, a file of
    fixed size, goes to the executors once.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(shared.value, pattern)
        for batch in batches:
            texts = string_list(batch, "text")
            tokens = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    return arrow_map(rows, run, f"`{id_column}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
