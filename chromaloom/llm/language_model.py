"""Operator 1: language-model scores by a hierarchical Pitman-Yor model.

Every word of the training texts, and the start of a text, is a context with a
restaurant of its own, whose dishes are all words that follow it there.  All
these restaurants share one parent, the restaurant of single words; each table
of a context sends one customer to its dish there.  The base below is one half
for a word that training has not and the other half evenly for those it has.

The work is dealt by context: what goes to a part of the contexts travels as
arrays of word hashes, so one exchange carries a batch in a few rows.

1. Words are counted.
2. Contexts: distinct neighbours are counted and seated by Gibbs sampling, each
   part for itself (:mod:`seating`); tables are summed by dish.
3. The parent is seated from those sums; its predictive probabilities are
   averaged over samples of its seating.
4. All texts are scored.  Each part of the contexts gets the parent
   probabilities of the rare words that it has; neighbours meet the counts of
   their context, which is seated again given the parent, and the averaged
   tables give the probability.  Sums by document come back.

Frequent words and frequent neighbours (``SHARE`` of the training tokens or
more, so three and a third millions of each at most, whatever the corpus) are looked up in a
broadcast and not dealt, and frequent contexts are split by dish; so neither a
frequent word nor a frequent pair gathers in one task.  Words are told apart by
64-bit hashes.  All of them, and all their neighbours, take part.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_map, gathered, id_remainder, release_kept, scratch, utf8_list, written
from chromaloom.llm.seating import Restaurants

#: Words and pairs of this share of the training tokens are looked up in a broadcast.
SHARE = 3e-7
#: Training tokens of a part of the contexts, on average.
PART_TOKENS = 600_000
#: Tokens that a task holds together before it deals them.
TOKENS_AT_ONCE = 800_000
BURN_IN, SAMPLES = 2, 3
#: Distinct words that a task counts before it passes the counts on.
COUNTED_WORDS = 400_000
#: Share of the base for a word that training has not.
UNSEEN_BASE = 0.5
END = ""
_SEED = 42  # as in Spark's xxhash64
_BLOCK_BITS = 12
_BLOBS = "part int, kind int, start long, a binary, b binary, c binary, d binary"
_WORDS, _PAIRS, _TOKENS, _SUM, _BASE, _TEXT = range(6)


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes by which words are told apart; Spark's ``xxhash64`` gives the same."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, _SEED) for w in words], dtype=np.uint64).view(np.int64)


END_HASH = int(word_hashes([b""])[0])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` of the texts in column ``text``; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(held.keys()), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in utf8_list(batch, "text"):
                held.update(tokens_of(text))
                held[b""] += 1
                if len(held) >= COUNTED_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return arrow_map(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    x = (hashes.view(np.uint64) ^ np.uint64(turn * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each pair of hashes."""
    return (_mixed(first, 1) << np.uint64(13)) ^ (_mixed(second, 2) * np.uint64(0x94D049BB133111EB))


class Lookup:
    """Values by hash: sorted keys, and arrays of what belongs to them."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its place, and whether it is there; a missing key has some other's place."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


@dataclass
class Dealing:
    """How contexts and words are dealt to parts."""

    parts: int
    split: Lookup  # frequent contexts: into how many parts their dishes go

    def context_parts(self, contexts: np.ndarray, dishes: np.ndarray) -> np.ndarray:
        at, found = self.split.find(contexts)
        ways = np.where(found, self.split.values[0][at], 1) if len(self.split.keys) else np.ones(len(contexts), dtype=np.int64)
        return ((_mixed(contexts, 3).astype(np.int64) + _mixed(dishes, 4).astype(np.int64) % ways) % self.parts).astype(np.int64)


def _blobs(parts: np.ndarray, kind: int, start: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part, holding its entries of the columns as bytes."""
    if not len(parts):
        return
    order = np.argsort(parts, kind="stable")
    parts = parts[order]
    edges = np.r_[0, np.flatnonzero(np.diff(parts)) + 1, len(parts)]
    n = len(edges) - 1
    arrays = [pa.array(parts[edges[:-1]], pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([start] * n, pa.int64())]
    for column in columns:
        data = memoryview(np.ascontiguousarray(column[order])).cast("B")
        size = column.dtype.itemsize
        arrays.append(pa.array([bytes(data[a * size : b * size]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()))
    arrays += [pa.nulls(n, pa.binary())] * (4 - len(columns))
    yield pa.RecordBatch.from_arrays(arrays, names=["part", "kind", "start", "a", "b", "c", "d"])


def _dealt(blobs: DataFrame, parts: int) -> DataFrame:
    """Blobs of one part after another, each part in one task."""
    return blobs.repartition(max(1, -(-parts // 2)), "part").sortWithinPartitions("part", "kind")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """Each part with its blobs (start, a, b, c, d) by kind."""
    now, held = None, {}
    for batch in batches:
        for part, kind, *rest in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if part != now:
                if held:
                    yield now, held
                now, held = part, {}
            held.setdefault(kind, []).append(tuple(rest))
    if held:
        yield now, held


def _column(blobs: list[tuple], place: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(b[place] for b in blobs), dtype=kind)


class Reader:
    """Texts as arrays of numbers of the distinct words of a batch."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = []
        self.lengths: list[int] = []

    def add(self, text: bytes) -> None:
        before = len(self.words)
        self.words += tokens_of(text)
        self.words.append(b"")
        self.lengths.append(len(self.words) - before)

    @property
    def tokens(self) -> int:
        return len(self.words)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words; of every token the context's and its own number, and its text's."""
        number = dict.fromkeys(chain((b"",), self.words))
        for k, word in enumerate(number):
            number[word] = k
        dishes = np.fromiter(map(number.__getitem__, self.words), dtype=np.int64, count=len(self.words))
        contexts = np.r_[0, dishes[:-1]] if len(dishes) else dishes
        return word_hashes(list(number)), contexts, dishes, np.repeat(np.arange(len(self.lengths)), self.lengths)


def _pair_blobs(train: DataFrame, dealing: Dealing) -> DataFrame:
    """Distinct neighbours of the training texts with their counts, as blobs by context part."""
    shared = train.sparkSession.sparkContext.broadcast(pickle.dumps(dealing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        dealing, reader = pickle.loads(shared.value), Reader()

        def out() -> Iterator[pa.RecordBatch]:
            hashes, contexts, dishes, _ = reader.neighbours()
            code, n = np.unique(contexts * len(hashes) + dishes, return_counts=True)
            v, w = hashes[code // len(hashes)], hashes[code % len(hashes)]
            yield from _blobs(dealing.context_parts(v, w), _PAIRS, 0, v, w, n.astype(np.int32))

        for batch in batches:
            for text in utf8_list(batch, "text"):
                reader.add(text)
                if reader.tokens >= TOKENS_AT_ONCE:
                    yield from out()
                    reader.clear()
        if reader.tokens:
            yield from out()

    return arrow_map(train.select("text"), run, _BLOBS)


def _pair_order(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order in which equal pairs, and all pairs of one context, lie together."""
    key = (_mixed(v, 8) >> np.uint64(14) << np.uint64(30)) | (_mixed(w, 9) >> np.uint64(18))
    order = np.argsort(key)
    a, b, k = v[order], w[order], key[order]
    meet = (k[1:] >> np.uint64(30)) == (k[:-1] >> np.uint64(30))
    if (meet & (a[1:] != a[:-1])).any() or ((k[1:] == k[:-1]) & (b[1:] != b[:-1])).any():
        return np.lexsort((w, v))  # two words share the bits that were compared
    return order


def _summed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, those of a context together, with their sums of ``n``, and for every entry the number of its pair."""
    order = _pair_order(v, w)
    a, b = v[order], w[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, dtype=bool)
    number = np.empty(len(v), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return a[fresh], b[fresh], np.bincount(number, n, int(fresh.sum())).astype(np.int64), number


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each run of equal ones, and for every entry the number of its run."""
    fresh = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, dtype=bool)
    return values[fresh], np.cumsum(fresh) - 1


@dataclass
class Frequent:
    """What a broadcast holds of frequent words: their counts and parent probabilities."""

    words: Lookup  # count, parent probability
    rest: float  # parent probability of other words, while it is not known for each


def _seated(blobs: DataFrame, dealing: Dealing, frequent: Frequent, least: float) -> DataFrame:
    """``kind, v, w, n, m``: contexts seated part by part.

    Kind 0: customers less tables ``n`` of dish ``w`` in a part, where there are
    any; 4: a dish ``w`` that is not frequent in part ``n``; 1: customers ``n`` and mean
    tables ``m`` of a frequent context ``v`` in a part; 2: customers and mean
    tables of a frequent pair; 3: mean discount ``m`` and strength of a part
    (``n`` has the strength in millionths, ``w`` the rows that were drawn).
    """
    shared = blobs.sparkSession.sparkContext.broadcast(pickle.dumps((dealing, frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealing, frequent = pickle.loads(shared.value)
        for part, held in _by_part(batches):
            v, w, c, _ = _summed(*(_column(held[_PAIRS], k + 1, t) for k, t in enumerate(("i8", "i8", "i4"))))
            dishes, dish = np.unique(w, return_inverse=True)
            at, known = frequent.words.find(dishes)
            base = np.where(known, frequent.words.values[1][at] if len(frequent.words.keys) else 0.0, frequent.rest)[dish]
            contexts, context = _runs(v)
            split_at, split = dealing.split.find(contexts)
            share = np.where(split, 1.0 / dealing.split.values[0][split_at], 1.0) if len(dealing.split.keys) else np.ones(len(contexts))
            own = np.bincount(context, c, len(contexts))
            house = Restaurants(context, c, base, share, own / share)
            tables, discount, strength = house.averaged(BURN_IN, SAMPLES - 1, np.random.default_rng([1, part]))
            _, often = frequent.words.find(contexts)
            pairs = np.flatnonzero(c >= least)
            mean = np.bincount(context, tables, len(contexts))
            less = np.bincount(dish, c - house.tables, len(dishes))
            joined, rare = np.flatnonzero(less > 0), np.flatnonzero(~known)
            rows = [
                (0, np.zeros(len(joined), dtype=np.int64), dishes[joined], less[joined], np.zeros(len(joined))),
                (4, np.zeros(len(rare), dtype=np.int64), dishes[rare], np.full(len(rare), part), np.zeros(len(rare))),
                (1, contexts[often], np.zeros(often.sum(), dtype=np.int64), own[often], mean[often]),
                (2, v[pairs], w[pairs], c[pairs], tables[pairs]),
                (3, np.zeros(1, dtype=np.int64), np.array([1 + (c > 1).sum()]), np.array([strength * 1e6]), np.array([discount])),
            ]
            for kind, *columns in rows:
                arrays = [pa.array(x.astype(t)) for x, t in zip(columns, ("i8", "i8", "i8", "f8"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *arrays], names=["kind", "v", "w", "n", "m"])

    return arrow_map(_dealt(blobs, dealing.parts), run, "kind int, v long, w long, n long, m double")


@dataclass
class Parent:
    """The restaurant of single words: averaged predictive probabilities by a word's customers there."""

    customers: np.ndarray
    mean_tables: np.ndarray  # by customers
    discount: float
    strength: float
    tables: float
    total: int
    distinct: int

    def probabilities(self, customers: np.ndarray) -> np.ndarray:
        customers = np.maximum(customers, 0)
        tables = np.where(customers > 0, np.interp(customers, self.customers, self.mean_tables), 0.0)
        opened = self.strength + self.discount * self.tables
        base = (1 - UNSEEN_BASE) / max(self.distinct, 1)
        return (customers - self.discount * tables + opened * base) / (self.strength + self.total)

    def unseen(self) -> float:
        """The probability of one event: a word that training has not."""
        if not self.total:
            return 1.0
        return UNSEEN_BASE * (self.strength + self.discount * self.tables) / (self.strength + self.total)


def seat_parent(customers: np.ndarray, words: np.ndarray, distinct: int, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Parent:
    """Gibbs sampling of the parent, whose ``words[k]`` words have ``customers[k]`` customers each.

    Words with equal customers are alike, and the mean of their tables stands for each.
    """
    total = int(customers @ words)
    if not total:
        return Parent(np.array([1]), np.array([1.0]), 0.5, 1.0, 0.0, 0, distinct)
    most = 512  # of many alike words so many are drawn, each standing for several
    rows = np.minimum(words, most)
    kind = np.repeat(np.arange(len(customers)), rows)
    base = np.full(len(kind), (1 - UNSEEN_BASE) / max(distinct, 1))
    house = Restaurants(np.zeros(len(kind), dtype=np.int64), customers[kind], base, np.ones(1), np.array([total]), stands=np.repeat(words / rows, rows))
    tables, discount, strength = house.averaged(burn_in, samples, np.random.default_rng(7))
    mean = np.bincount(kind, tables, len(customers)) / rows
    return Parent(customers, mean, discount, strength, float(mean @ words), total, distinct)


@dataclass
class Model:
    """What scoring needs besides the table of all words."""

    dealing: Dealing
    frequent: Frequent  # count and parent probability of frequent words
    contexts: Lookup  # of frequent contexts: customers, tables
    pairs: Lookup  # of frequent pairs: log10 probability
    parent: Parent
    discount: float
    strength: float
    total: int
    distinct: int


def fit(train: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the texts in column ``text``, the table ``h, c, tables`` of all its words, and which part wants which rare word (``h, part``).

    Without training texts all contexts and the parent are empty, and a new
    word has probability one.
    """
    counts = written(word_counts(train), "word-counts").select("word", "c", F.xxhash64("word").alias("h"))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    least = SHARE * total
    common = counts.where(F.col("c") >= F.lit(least)).select("h", "c").toArrow()
    hashes, often = (common.column(k).to_numpy().astype(np.int64) for k in ("h", "c"))
    parts = max(1, -(-total // PART_TOKENS))
    wide = often > total / parts / 2
    ways = np.minimum(np.ceil(often[wide] / max(total / parts / 2, 1)), parts).astype(np.int64)
    dealing = Dealing(parts, Lookup(hashes[wide], ways))
    rare = max(total - often.sum(), 1) / max(total, 1) / max(distinct - len(often), 1)
    first = Frequent(Lookup(hashes, often, often / max(total, 1)), float(rare))
    seated = written(_seated(_pair_blobs(train, dealing), dealing, first, least), "seated")

    # a word's tables are its customers in the parent: all its tokens but those that joined a table
    less = seated.where("kind = 0").groupBy(F.col("w").alias("h")).agg(F.sum("n").alias("less"))
    words = written(counts.select("h", "c").join(less, "h", "left").select("h", "c", (F.col("c") - F.coalesce("less", F.lit(0))).alias("tables")), "words")
    # above 4,096 customers words are grouped by steps of one per cent, so the list is short at every size
    step = F.when(F.col("tables") <= 4096, F.col("tables")).otherwise(F.lit(4096) + F.floor(F.log(F.col("tables") / 4096) / math.log(1.01)))
    kinds = words.groupBy(step.alias("step")).agg(F.avg("tables").alias("tables"), F.count(F.lit(1)).alias("n")).orderBy("step").toArrow()
    customers = np.rint(kinds.column("tables").to_numpy()).astype(np.int64)
    parent = seat_parent(customers, kinds.column("n").to_numpy().astype(np.int64), distinct)

    seats = words.where(F.col("c") >= F.lit(least)).select("h", "c", "tables").toArrow()
    h, c, t = (seats.column(k).to_numpy().astype(np.int64) for k in ("h", "c", "tables"))
    frequent = Frequent(Lookup(h, c, parent.probabilities(t)), 0.0)
    found = seated.where("kind = 1").groupBy("v").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    contexts = Lookup(*(found.column(k).to_numpy() for k in ("v", "n", "m")))
    discount, strength = seated.where("kind = 3").agg(F.coalesce(F.sum(F.col("m") * F.col("w")) / F.sum("w"), F.lit(0.5)), F.coalesce(F.sum(F.col("n") / 1e6 * F.col("w")) / F.sum("w"), F.lit(1.0))).head()
    often = seated.where("kind = 2").select("v", "w", "n", "m").toArrow()
    v, w, n, m = (often.column(k).to_numpy() for k in ("v", "w", "n", "m"))
    model = Model(dealing, frequent, contexts, Lookup(np.zeros(0, dtype=np.uint64), np.zeros(0)), parent, discount, strength, total, distinct)
    if len(v):
        at, known = frequent.words.find(w)
        log = _log_probability(model, *_context_totals(model, v, np.zeros(len(v)), np.zeros(len(v))), n, m, np.where(known, frequent.words.values[1][at], parent.unseen()))
        model.pairs = Lookup(pair_keys(v, w), log)
    wanted = seated.where("kind = 4").select(F.col("w").alias("h"), F.col("n").cast("int").alias("part"))
    return model, words, wanted


def _context_totals(model: Model, contexts: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of contexts: of frequent ones those of all parts, of others what is given."""
    at, known = model.contexts.find(contexts)
    if not len(model.contexts.keys):
        return customers, tables
    return np.where(known, model.contexts.values[0][at], customers), np.where(known, model.contexts.values[1][at], tables)


def _log_probability(model: Model, total: np.ndarray, seated: np.ndarray, customers: np.ndarray, tables: np.ndarray, base: np.ndarray) -> np.ndarray:
    """log10 of the averaged predictive probability of dishes in their contexts; a context without customers is its parent."""
    own = np.maximum(customers - model.discount * tables, 0.0)
    opened = model.strength + model.discount * seated
    held = np.log10(np.maximum(own + opened * base, 1e-300)) - np.log10(model.strength + total)
    return np.where(total > 0, held, np.log10(base))


def _sum_blobs(parts: int, kind: int, rows: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Values by row as blobs by block of rows; ``rows`` ascend, the first column written is the place in the block."""
    if not len(rows):
        return
    block = rows >> _BLOCK_BITS
    edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(rows)]
    first = block[edges[:-1]]
    place = (rows - (block << _BLOCK_BITS)).astype(np.uint16)
    arrays = [pa.array((_mixed(first, 6).astype(np.int64) % parts).astype(np.int32)), pa.array(np.full(len(first), kind, dtype=np.int32)), pa.array(first)]
    for column in (place, *columns):
        data = memoryview(np.ascontiguousarray(column)).cast("B")
        size = column.dtype.itemsize * (column.shape[1] if column.ndim > 1 else 1)
        arrays.append(pa.array([bytes(data[a * size : b * size]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()))
    arrays += [pa.nulls(len(first), pa.binary())] * (3 - len(columns))
    yield pa.RecordBatch.from_arrays(arrays, names=["part", "kind", "start", "a", "b", "c", "d"])


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the distinct words of many texts; every token's context, dish and text; row and train flag of every text."""
    reader, rows, train = Reader(), [], []

    def out() -> tuple:
        return *reader.neighbours(), np.array(rows, dtype=np.int64), np.array(train, dtype=np.int64)

    for batch in batches:
        for row, held, text in zip(batch.column("row").to_pylist(), batch.column("held_out").to_pylist(), utf8_list(batch, "text"), strict=True):
            reader.add(text)
            rows.append(row)
            train.append(0 if held else 1)
            if reader.tokens >= TOKENS_AT_ONCE:
                yield out()
                reader.clear()
                rows.clear()
                train.clear()
    if rows:
        yield out()


def _wanted_by_held_out(rows: DataFrame, model: Model) -> DataFrame:
    """``h, part``: rare words of the texts that are held out, and the parts where they are scored."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((model.dealing, model.frequent.words.keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        dealing, keys = pickle.loads(shared.value)
        frequent = Lookup(keys)
        for hashes, contexts, dishes, *_ in _read_texts(batches):
            _, often = frequent.find(hashes)
            far = np.flatnonzero(~often[dishes])
            w = hashes[dishes[far]]
            code = np.unique(dishes[far] * dealing.parts + dealing.context_parts(hashes[contexts[far]], w))
            word, part = code // dealing.parts, code % dealing.parts
            yield pa.RecordBatch.from_arrays([pa.array(hashes[word]), pa.array(part.astype(np.int32))], names=["h", "part"])

    return arrow_map(rows.where("held_out").select("row", "held_out", "text"), run, "h long, part int")


def _word_blobs(wanted: DataFrame, words: DataFrame) -> DataFrame:
    """The counts and tables of the rare words that each part of the contexts wants, as blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, TOKENS_AT_ONCE):
            h, c, tables, part = (batch.column(k).to_numpy() for k in range(4))
            yield from _blobs(part.astype(np.int64), _WORDS, 0, h, c, tables)

    return arrow_map(wanted.join(words, "h").select("h", "c", "tables", "part"), run, _BLOBS)


def _token_blobs(rows: DataFrame, model: Model) -> DataFrame:
    """Tokens in infrequent pairs, as blobs by context part, and by row what needs no dealing."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((model.dealing, model.frequent.words, model.pairs, model.total, model.distinct)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        dealing, frequent, pairs, total, distinct = pickle.loads(shared.value)
        for hashes, contexts, dishes, text, row, train in _read_texts(batches):
            at, often = frequent.find(hashes)
            counts = np.where(often, frequent.values[0][at], 0) if len(frequent.keys) else np.zeros(len(hashes), dtype=np.int64)
            plain = np.where(often, np.log10((counts + 1) / (total + distinct + 1)), 0.0)[dishes]
            near = often[dishes]
            first, second = _mixed(hashes, 1) << np.uint64(13), _mixed(hashes, 2) * np.uint64(0x94D049BB133111EB)
            place, paired = pairs.find(first[contexts] ^ second[dishes])
            log = np.where(paired, pairs.values[0][place], 0.0) if len(pairs.keys) else np.zeros(len(dishes))
            n = len(row)
            sums = np.c_[np.bincount(text, log, n), np.bincount(text, plain, n)]
            whole = np.c_[np.bincount(text, minlength=n), np.bincount(text, paired, n), np.bincount(text, near, n)].astype(np.int32)
            yield from _sum_blobs(dealing.parts, _TEXT, row, sums, whole)
            rest = np.flatnonzero(~paired)
            rest = rest[np.argsort(contexts[rest], kind="stable")]  # equal contexts together are small when compressed
            offset = (((row[text[rest]] - row[0]) << 1) | train[text[rest]]).astype(np.uint32)
            v, w = hashes[contexts[rest]], hashes[dishes[rest]]
            yield from _blobs(dealing.context_parts(v, w), _TOKENS, int(row[0]), v, w, offset)

    return arrow_map(rows.select("row", "held_out", "text"), run, _BLOBS)


def _context_scores(blobs: DataFrame, model: Model) -> DataFrame:
    """Sums of log10 probabilities by row, as blobs by block, of all tokens that were dealt by context."""
    shared = blobs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        whole = model.total + model.distinct + 1
        for part, held in _by_part(batches):
            for start, *columns in held.get(_TEXT, ()):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_TEXT], pa.int32()), pa.array([start], pa.int64()), *(pa.array([x], pa.binary()) for x in columns)], names=["part", "kind", "start", "a", "b", "c", "d"])
            tokens = held.get(_TOKENS, [])
            if not tokens:
                continue
            v, w, place = (_column(tokens, k, t) for k, t in ((1, "i8"), (2, "i8"), (3, "u4")))
            row = np.repeat([b[0] for b in tokens], [len(b[3]) // 4 for b in tokens]) + (place >> 1).astype(np.int64)
            a, b, c, number = _summed(v, w, place & 1)
            dishes, dish = np.unique(b, return_inverse=True)
            at, often = model.frequent.words.find(dishes)
            base = np.where(often, model.frequent.words.values[1][at], 0.0) if len(model.frequent.words.keys) else np.zeros(len(dishes))
            rare = Lookup(*(_column(held.get(_WORDS, []), k, "i8") for k in (1, 2, 3)))
            at, known = rare.find(dishes)
            counts, tables = (np.where(known, x[at], 0) for x in rare.values) if len(rare.keys) else (np.zeros(len(dishes), dtype=np.int64),) * 2
            base = np.where(often, base, np.where(known, model.parent.probabilities(tables), model.parent.unseen()))[dish]
            plain = np.where(often, 0.0, np.log10((counts + 1) / whole))[dish]
            contexts, context = _runs(a)
            own = np.bincount(context, c, len(contexts))
            total, fixed = _context_totals(model, contexts, own, np.full(len(contexts), np.nan))
            rows = np.flatnonzero(c > 0)
            house = Restaurants(context[rows], c[rows], base[rows], np.ones(len(contexts)), total, model.discount, model.strength, fixed)
            seated = np.zeros(len(a))
            seated[rows] = house.averaged(BURN_IN, SAMPLES, np.random.default_rng([2, part]), learn=False)[0]
            value = _log_probability(model, total[context], house.context_tables(seated[rows])[context], c, seated, base)
            order = np.argsort(row, kind="stable")
            found, at = _runs(row[order])
            number = number[order]
            far = np.flatnonzero(plain[number])
            if len(far):
                far_rows, far_at = _runs(row[order][far])
                yield from _sum_blobs(model.dealing.parts, _BASE, far_rows, np.bincount(far_at, plain[number[far]], len(far_rows)))
            sums = np.bincount(at, value[number], len(found)).astype(np.float32)
            tallies = np.c_[np.bincount(at, minlength=len(found)), np.bincount(at, (known & ~often)[dish][number], len(found))].astype(np.uint32)
            yield from _sum_blobs(model.dealing.parts, _SUM, found, sums, tallies)

    return arrow_map(_dealt(blobs, model.dealing.parts), run, _BLOBS)


def _row_scores(blobs: DataFrame, parts: int) -> DataFrame:
    """``row, n_tokens, n_known, base_score, score, scored``: what the blobs of a block of rows sum to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            size = 1 << _BLOCK_BITS
            whole, real = np.zeros((size, 3), dtype=np.int64), np.zeros((size, 2))  # tokens, scored, known; log, base
            for kind, place, b, c in held:
                place = np.frombuffer(place, dtype="u2").astype(np.int64)
                if kind == _TEXT:
                    np.add.at(real, place, np.frombuffer(b, dtype="f8").reshape(-1, 2))
                    np.add.at(whole, place, np.frombuffer(c, dtype="i4").reshape(-1, 3))
                elif kind == _BASE:
                    real[place, 1] += np.frombuffer(b, dtype="f8")
                else:
                    real[place, 0] += np.frombuffer(b, dtype="f4")
                    whole[place, 1:] += np.frombuffer(c, dtype="u4").reshape(-1, 2)
            used = np.flatnonzero(whole[:, 0])
            columns = [(now << _BLOCK_BITS) + used, whole[used, 0], whole[used, 2], real[used, 1], real[used, 0], whole[used, 1]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row", "n_tokens", "n_known", "base_score", "score", "scored"])

        for batch in batches:
            for kind, start, a, b, c in zip(*(batch.column(k).to_pylist() for k in ("kind", "start", "a", "b", "c")), strict=True):
                if start != now:
                    if held:
                        yield out()
                    now, held = start, []
                held.append((kind, a, b, c))
        if held:
            yield out()

    blocks = blobs.repartition(max(1, -(-parts // 2)), "start").sortWithinPartitions("start")
    return arrow_map(blocks, run, "row long, n_tokens long, n_known long, base_score double, score double, scored long")


def rare_words(rows: DataFrame, model: Model, words: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blobs of the rare words of each part, in training and held-out texts; nothing else that :func:`fit` has written is needed any more."""
    return written(_word_blobs(wanted.unionByName(_wanted_by_held_out(rows, model)), words), "rare-words", outer=True)


def score(rows: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """``rows`` (columns ``row``, ``id``, ``held_out``, ``text``) with counts and log10 probabilities, text left out.

    ``row`` numbers the rows alike each time they are read; where a text does
    not get all its tokens back, the numbers were not, and that is an error.
    """
    blobs = _token_blobs(rows, model).unionByName(rare)
    sums = written(_row_scores(_context_scores(blobs, model), model.dealing.parts), "row-scores")
    whole = F.when(F.col("scored") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("rows were not numbered alike")).cast("long"))
    return rows.select("row", "id", "held_out").join(sums, "row").select(
        "id", "held_out", whole.alias("n_tokens"), "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fit on the rows whose ``crc32(id as text) mod 7`` is not 2 and score all.

    ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.  Like
    the base, ``score`` takes all words that training has not as one event.
    Null texts are empty ones, which have the end as their only token; very long
    ones are taken whole; a null id counts as the empty text; repeated rows are
    trained on and scored each; without training rows every token has
    probability one; an empty table gives an empty one; other columns are not
    read.  ``docs`` has to give its rows in the same order each time it is read,
    as files do.  Perplexity is ``10 ** (-score / n_tokens)`` over the rows held out.
    """
    held = (id_remainder(id_column, 7) == 2).alias("held_out")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_column].alias("id"), held, docs[text_column].cast("string").alias("text"))
    with scratch(docs.sparkSession):
        model, words, wanted = fit(rows.where(~F.col("held_out")))
        rare = rare_words(rows, model, words, wanted)
    return score(rows, model, rare).withColumnRenamed("id", id_column)
