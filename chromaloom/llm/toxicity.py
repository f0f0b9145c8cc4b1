"""Operator 12: toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input has two parts: a vector of the word itself, and one made of the
vectors of its character n-grams, so unseen forms of a known stem are
understood.  Two gated recurrent units read a window of words forward and
backward, attention weighs the places, and a logistic unit scores what it pools.
All overlapping windows of a text are scored; the text's score is that of its
worst window.  Labels stand for whole texts, so training looks for the worst
window of each text again in every epoch and learns from that one.  Network,
training and scoring are numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from chromaloom.llm.common import arrow_map, id_remainder, release_kept, utf8_list
from chromaloom.llm.decontamination import words_of

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_WIDTH, GRAM_WIDTH = 8, 6, 6
GRAM_SIZES = (4, 6)
#: Scores from here on are toxic.
THRESHOLD = 0.5
#: The network is fitted on at most so many labelled rows of either label, and on so many windows of each.
TRAINING_ROWS, TRAINING_WINDOWS = 1500, 16
EPOCHS, LEAST_STEPS, BATCHES, RATE, EMBEDDING_RATE = 8, 100, (16, 96), 0.01, 0.02
#: The first value of a word or n-gram is its log odds, so many standard errors nearer to nothing.  Words of fewer rows,
#: and n-grams of which so little is certain that their value is nothing, are not known to the network: learning them
#: would be learning the rows by heart.
ERRORS, LEAST_ROWS = 2.0, 3
#: Bags whose words and n-grams are counted together, and new words that are looked up together.
_BAGS_AT_ONCE, _NEW_AT_ONCE = 64, 20_000
#: Words whose inputs a task remembers, windows that go through the network together, and words of texts that do.
_WORDS_KEPT, _WINDOWS_AT_ONCE, _WORDS_AT_ONCE = 250_000, 2048, 1 << 18
_MIX, _FIRST_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)


def starts_of(words: int) -> np.ndarray:
    """Where the overlapping windows of a text begin; the last one ends with the text."""
    if words <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.r_[np.arange(0, words - WINDOW, STRIDE), words - WINDOW]


def n_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character n-grams of the words, and where each word's begin."""
    # every word between marks, three in all, and enough after the last one for its longest n-gram
    marked = np.frombuffer(b"<" + b">><".join(words) + b">>" + b"\0" * max(GRAM_SIZES), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 3
    begin = np.r_[0, np.cumsum(sizes)]
    left = np.repeat(begin[1:], sizes) - np.arange(begin[-1])
    hashes, at = [], []
    for size in GRAM_SIZES:
        held = np.flatnonzero(left >= size)
        mixed = np.full(len(held), size, dtype=np.uint64)
        for k in range(size):
            mixed = (mixed ^ marked[held + k]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        hashes.append(mixed)
        at.append(held)
    order = np.argsort(np.concatenate(at), kind="stable")
    hashes, at = np.concatenate(hashes)[order], np.concatenate(at)[order]
    return hashes, np.searchsorted(at, begin[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of the network, and its passes; a window is a row of numbers of words, -1 after its end."""

    def __init__(self, seed: int = 12):
        rng = np.random.default_rng(seed)
        width = WORD_WIDTH + GRAM_WIDTH
        #: Known words and n-grams; their vectors follow the one of all others, which is nothing.
        self.known: dict[bytes, int] = {}
        self.known_grams, self.first_bits = np.zeros(0, dtype=np.uint64), np.zeros(1 << 20, dtype=bool)
        self.word, self.gram = np.zeros((1, WORD_WIDTH), dtype=np.float32), np.zeros((1, GRAM_WIDTH), dtype=np.float32)
        small = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        #: By direction: of inputs, of the state, and biases of the three gates; attention and output weights.
        self.dense = {"inputs": np.stack([small(width, 3 * HIDDEN) for _ in range(2)]), "state": np.stack([small(HIDDEN, 3 * HIDDEN) for _ in range(2)]), "bias": np.zeros((2, 3 * HIDDEN), np.float32), "attention": small(2 * HIDDEN), "output": small(2 * HIDDEN), "base": np.zeros(1, np.float32)}
        #: The score of every text where there was nothing to learn from.
        self.constant: float | None = None

    def rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the vectors of words and of their n-grams, 0 for unknown ones, and where each word's n-grams begin."""
        own = np.fromiter(map(self.known.get, words, repeat(0)), dtype=np.int64, count=len(words))
        hashes, begin = n_grams(words)
        grams = np.zeros(len(hashes), dtype=np.int64)
        # most n-grams are unknown, and most of those are so by the first bits of their hash
        maybe = np.flatnonzero(self.first_bits[hashes >> _FIRST_BITS])
        place = np.searchsorted(self.known_grams, hashes[maybe])
        place[place == len(self.known_grams)] = 0
        found = self.known_grams[place] == hashes[maybe] if len(maybe) else place
        grams[maybe] = np.where(found, place + 1, 0)
        return own, grams, begin

    def telling(self, words: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of words, from ``first`` on for those of which something is known and 0 for all others; and the rows of the former."""
        places, own, grams, begin = [], [], [], []
        held = 0
        for k in range(0, len(words), _NEW_AT_ONCE):
            some_own, some_grams, starts = self.rows(words[k : k + _NEW_AT_ONCE])
            known = np.flatnonzero((some_own > 0) | np.logical_or.reduceat(some_grams > 0, starts))
            place = np.zeros(len(some_own), dtype=np.int64)
            place[known] = np.arange(first, first + len(known))
            sizes = np.diff(np.r_[starts, len(some_grams)])[known]
            begins = np.cumsum(sizes) - sizes
            places.append(place)
            own.append(some_own[known])
            grams.append(some_grams[np.repeat(starts[known] - begins, sizes) + np.arange(sizes.sum())])
            begin.append(begins + held)
            held, first = held + int(sizes.sum()), first + len(known)
        return np.concatenate(places), np.concatenate(own), np.concatenate(grams), np.concatenate(begin)

    def vectors(self, own: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A row of inputs for each word; a word has an n-gram at least.

        Of the n-grams' first values the greatest counts, of the others the mean.
        """
        held = self.gram[grams]
        means = np.add.reduceat(held[:, 1:], begin, axis=0) / np.diff(np.r_[begin, len(grams)])[:, None]
        return np.concatenate([self.word[own], np.maximum.reduceat(held[:, :1], begin, axis=0), means], axis=1).astype(np.float32)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """What inputs give to the gates: direction, gate, word."""
        return np.ascontiguousarray(np.einsum("dwg,nw->dgn", self.dense["inputs"], vectors, optimize=True) + self.dense["bias"][:, :, None])

    def score(self, gates: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Log-odds of windows of one length, given as place by window; -1 beyond the end of short ones."""
        length, count = windows.shape
        short = bool(count) and bool((windows[-1] < 0).any())
        inside = windows >= 0 if short else None
        attention, output = (self.dense[k].reshape(2, HIDDEN) for k in ("attention", "output"))
        heads = np.stack([attention, output], axis=1)
        both = np.zeros((length, 2, count), dtype=np.float32)
        for d in range(2):
            turned, h = np.ascontiguousarray(self.dense["state"][d].T), np.zeros((HIDDEN, count), dtype=np.float32)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                given, from_state = gates[d].take(windows[t], axis=1), turned @ h
                zr = given[: 2 * HIDDEN]
                zr += from_state[: 2 * HIDDEN]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                n = from_state[2 * HIDDEN :]
                n *= zr[HIDDEN:]
                n += given[2 * HIDDEN :]
                np.tanh(n, out=n)
                new = h - n
                new *= zr[:HIDDEN]
                new += n
                h = new if inside is None else np.where(inside[t], new, h)
                both[t] += heads[d] @ h
        e, g = both[:, 0], both[:, 1]
        if inside is not None:
            e = np.where(inside, e, np.float32(-1e9))
        alpha = np.exp(e - e.max(axis=0))
        return (alpha * g).sum(axis=0) / alpha.sum(axis=0) + self.dense["base"][0]

    def slopes(self, vectors: np.ndarray, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Slopes of the weighted logistic loss by the dense weights and by the words' inputs; windows are window by place."""
        count, length = windows.shape
        inside = (windows >= 0)[:, :, None]
        given = vectors[windows]
        attention, output = self.dense["attention"], self.dense["output"]
        states, kept = [], []
        for d in range(2):
            w, u, b = self.dense["inputs"][d], self.dense["state"][d], self.dense["bias"][d]
            h, out, steps = np.zeros((count, HIDDEN), np.float32), np.zeros((length, count, HIDDEN), np.float32), {}
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                x, s = given[:, t] @ w + b, h @ u
                z, r = _sigmoid(x[:, :HIDDEN] + s[:, :HIDDEN]), _sigmoid(x[:, HIDDEN : 2 * HIDDEN] + s[:, HIDDEN : 2 * HIDDEN])
                n = np.tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
                steps[t] = h, z, r, n, s[:, 2 * HIDDEN :]
                h = np.where(inside[:, t], n + z * (h - n), h)
                out[t] = h
            states.append(out)
            kept.append(steps)
        hidden = np.concatenate(states, axis=2)
        e, g = hidden @ attention, hidden @ output
        e = np.where(inside[:, :, 0].T, e, -1e9)
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        logit = (alpha * g).sum(axis=0) + self.dense["base"][0]
        slope = (_sigmoid(logit) - labels) * weight / weight.sum()
        to_g = alpha * slope
        to_e = alpha * (g - (alpha * g).sum(axis=0)) * slope
        found = {"attention": np.einsum("tb,tbh->h", to_e, hidden), "output": np.einsum("tb,tbh->h", to_g, hidden), "base": slope.sum(keepdims=True), "inputs": np.zeros_like(self.dense["inputs"]), "state": np.zeros_like(self.dense["state"]), "bias": np.zeros_like(self.dense["bias"])}
        to_hidden, to_given = to_g[:, :, None] * output + to_e[:, :, None] * attention, np.zeros_like(given)
        for d in range(2):
            w, u, part = self.dense["inputs"][d], self.dense["state"][d], slice(d * HIDDEN, (d + 1) * HIDDEN)
            carried = np.zeros((count, HIDDEN), np.float32)
            for t in range(length - 1, -1, -1) if d == 0 else range(length):
                h, z, r, n, s = kept[d][t]
                to_h = carried + to_hidden[t][:, part]
                own = np.where(inside[:, t], to_h, 0)
                to_n = own * (1 - z) * (1 - n * n)
                to_z, to_r = own * (h - n) * z * (1 - z), to_n * s * r * (1 - r)
                to_x, to_s = np.concatenate([to_z, to_r, to_n], axis=1), np.concatenate([to_z, to_r, to_n * r], axis=1)
                found["inputs"][d] += given[:, t].T @ to_x
                found["state"][d] += h.T @ to_s
                found["bias"][d] += to_x.sum(axis=0)
                to_given[:, t] += to_x @ w.T
                carried = to_h - own + own * z + to_s @ u.T
        to_vectors = np.zeros_like(vectors)
        np.add.at(to_vectors, windows[windows >= 0], to_given[windows >= 0])
        return found, to_vectors

    def fit(self, bags: list[list[list[bytes]]], labels: list[int], epochs: int = EPOCHS, seed: int = 12) -> Network:
        """Train on bags of windows (lists of words), one bag a text; bags without words are passed over."""
        kept = [k for k, bag in enumerate(bags) if any(bag)]
        bags, labels = [[w for w in bags[k] if w] for k in kept], np.array([labels[k] for k in kept], dtype=np.float32)
        share = float(labels.mean()) if len(labels) else 0.0
        if share in (0.0, 1.0):
            self.constant = share
            return self
        number: dict[bytes, int] = {}
        whose, rows = [], []
        for k, bag in enumerate(bags):
            for window in bag:
                ids = [number.setdefault(w, len(number)) for w in window]
                rows.append(ids + [-1] * (WINDOW - len(ids)))
                whose.append(k)
        windows, whose = np.array(rows, dtype=np.int64), np.array(whose)
        words = list(number)
        self._begin(windows, whose, labels, words)
        places, own, grams, begin = self.telling(words, 1)
        windows = np.where(windows >= 0, places[windows], -1)
        # place 0 stands for all words of which nothing is known
        own, grams, begin = np.r_[0, own], np.r_[0, grams], np.r_[0, begin + 1]
        first = np.r_[0, np.flatnonzero(np.diff(whose)) + 1]
        weight = np.ones(len(labels), dtype=np.float32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.dense.items()}
        gone = [np.full((len(table), 1), 1e-4, np.float32) for table in (self.word, self.gram)]
        # few rows are dealt to small batches, and are gone through more often
        batch = int(np.clip(len(labels) // 24, *BATCHES))
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(labels)))
        rng, step = np.random.default_rng(seed), 0
        odds = np.where(windows >= 0, self.word[own[windows], 0], 0).sum(axis=1)
        for epoch in range(epochs):
            if epoch:
                gates = self.gates(self.vectors(own, grams, begin))
                odds = np.concatenate([self.score(gates, np.ascontiguousarray(windows[k : k + _WINDOWS_AT_ONCE].T)) for k in range(0, len(windows), _WINDOWS_AT_ONCE)])
            worst = np.array([a + int(np.argmax(odds[a:b])) for a, b in pairwise([*first, len(windows)])])
            shuffled = rng.permutation(len(worst))
            for k in range(0, len(worst), batch):
                rows, step = shuffled[k : k + batch], step + 1
                chosen = windows[worst[rows]]
                used, local = np.unique(chosen[chosen >= 0], return_inverse=True)
                placed = np.full(chosen.shape, -1)
                placed[chosen >= 0] = local
                ends = np.r_[begin, len(grams)]
                sizes = ends[used + 1] - ends[used]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                own_grams = grams[np.repeat(ends[used] - starts, sizes) + np.arange(sizes.sum())]
                slopes, to_vectors = self.slopes(self.vectors(own[used], own_grams, starts), placed, labels[rows], weight[rows])
                for name, slope in slopes.items():
                    mean, square = moments[name]
                    mean += 0.1 * (slope - mean)
                    square += 0.001 * (slope * slope - square)
                    self.dense[name] -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                to_vectors[:, WORD_WIDTH] = 0  # the n-grams' first values stay as they are
                to_grams = np.repeat(to_vectors[:, WORD_WIDTH:] / sizes[:, None], sizes, axis=0)
                for table, seen, at, slope in ((self.word, gone[0], own[used], to_vectors[:, :WORD_WIDTH]), (self.gram, gone[1], own_grams, to_grams)):
                    touched, which = np.unique(at, return_inverse=True)
                    total = np.stack([np.bincount(which, slope[:, c], minlength=len(touched)) for c in range(table.shape[1])], axis=1) * (touched > 0)[:, None]
                    seen[touched] += (total * total).mean(axis=1, keepdims=True)
                    table[touched] -= EMBEDDING_RATE * total / np.sqrt(seen[touched])
        return self

    def _begin(self, windows: np.ndarray, whose: np.ndarray, labels: np.ndarray, words: list[bytes]) -> None:
        """Take the words and n-grams that enough rows hold; their first value is how much likelier toxic rows do."""
        at, place = np.nonzero(windows >= 0)
        bag, word = np.divmod(np.unique(whose[at] * len(words) + windows[at, place]), len(words))
        hashes, begin = n_grams(words)
        names, number = np.unique(hashes, return_inverse=True)
        ends = np.r_[begin, len(hashes)]
        counts = [(np.zeros(size), np.zeros(size)) for size in (len(words), len(names))]
        edges = [*range(0, len(labels), _BAGS_AT_ONCE), len(labels)]
        for first, after in pairwise(np.searchsorted(bag, edges).tolist()):  # whole bags, so each counts once
            bags, held = bag[first:after], word[first:after]
            sizes = np.diff(ends)[held]
            starts = np.cumsum(sizes) - sizes
            grams = number[np.repeat(ends[held] - starts, sizes) + np.arange(sizes.sum())]
            for (toxic, clean), whose_row, row in ((counts[0], bags, held), (counts[1], np.repeat(bags, sizes), grams)):
                of, rows = np.divmod(np.unique(whose_row * len(toxic) + row), len(toxic))
                toxic += np.bincount(rows, labels[of], minlength=len(toxic))
                clean += np.bincount(rows, 1 - labels[of], minlength=len(clean))
        firsts = []
        for toxic, clean in ((t + 0.5, c + 0.5) for t, c in counts):
            odds = np.log(toxic / clean) - np.log(labels.sum() / (1 - labels).sum())
            bound = np.sign(odds) * np.clip(np.abs(odds) - ERRORS * np.sqrt(1 / toxic + 1 / clean), 0, 4)
            firsts.append((np.flatnonzero(toxic + clean > LEAST_ROWS), bound))
        (often, values), (often_grams, gram_values) = firsts
        often_grams = often_grams[gram_values[often_grams] != 0]
        self.known = {words[k]: n + 1 for n, k in enumerate(often.tolist())}
        self.known_grams = names[often_grams]
        self.first_bits[self.known_grams >> _FIRST_BITS] = True
        self.word, self.gram = (np.zeros((len(v) + 1, width), dtype=np.float32) for v, width in ((often, WORD_WIDTH), (often_grams, GRAM_WIDTH)))
        self.word[1:, 0], self.gram[1:, 0] = values[often], gram_values[often_grams]


class Scorer:
    """Scores whole texts, remembering what words give to the gates."""

    def __init__(self, network: Network):
        self.network = network
        self.number: dict[bytes, int] = {}
        nothing = np.zeros(1, dtype=np.int64)
        self.gates, self.held = network.gates(network.vectors(nothing, nothing, nothing)), 1

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        if len(number) > _WORDS_KEPT:
            number.clear()
            self.held = 1
        ids = np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        if len(absent := np.flatnonzero(ids < 0)):
            absent_words = [words[k] for k in absent.tolist()]
            new = list(set(absent_words))
            places, own, grams, begin = self.network.telling(new, self.held)
            number.update(zip(new, places.tolist(), strict=True))
            ids[absent] = np.fromiter(map(number.__getitem__, absent_words), dtype=np.int32, count=len(absent))
            if len(own):
                self.gates = np.concatenate([self.gates[:, :, : self.held], self.network.gates(self.network.vectors(own, grams, begin))], axis=2)
                self.held += len(own)
        return ids

    def _together(self, texts: list[list[bytes]]) -> np.ndarray:
        """Log-odds of some texts with words: those of each one's worst window."""
        ids, sizes = self._numbers([w for words in texts for w in words]), np.array([len(words) for words in texts])
        begin, out = np.r_[0, np.cumsum(sizes)[:-1]], np.full(len(texts), -np.inf)
        starts = [starts_of(n) for n in sizes.tolist()]
        whose = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        at = np.concatenate(starts) + begin[whose]
        full = sizes[whose] >= WINDOW
        for chosen in (np.flatnonzero(full), np.flatnonzero(~full)):
            for k in range(0, len(chosen), _WINDOWS_AT_ONCE):
                part = chosen[k : k + _WINDOWS_AT_ONCE]
                place = at[part] + np.arange(WINDOW)[:, None]
                inside = np.arange(WINDOW)[:, None] < sizes[whose[part]]
                windows = np.where(inside, ids[np.minimum(place, len(ids) - 1)], -1)
                np.maximum.at(out, whose[part], self.network.score(self.gates, windows))
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        """Probability of label 1; a text without words has nothing toxic in it and gets 0."""
        out = np.zeros(len(texts))
        if self.network.constant is not None:
            return (out + self.network.constant).tolist()
        held, places, n = [], [], 0
        for k, text in enumerate([*texts, b""]):
            words = words_of(text)
            if held and (n + len(words) > _WORDS_AT_ONCE or k == len(texts)):
                odds = self._together(held)
                out[places] = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
                held, places, n = [], [], 0
            if words:
                held.append(words)
                places.append(k)
                n += len(words)
        return out.tolist()


def fit_network(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, training_windows: int = TRAINING_WINDOWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Network:
    """Fit on labelled rows whose ``crc32(id as text) mod 5`` is not 0, at most ``training_rows`` of either label.

    The ids are the least of each label by a hash, and then twice as many rows
    at most, by hashes of id and text; rows that repeat both are one row.  Of
    several labels of an id the highest holds.  Of a row's windows so many are
    taken, evenly over the whole text.  Null labels and ids are passed over;
    null, empty and wordless texts teach nothing; with rows of one label only
    every score is that label's, and without any it is 0.
    """
    known = labels.select(F.col(id_column).alias("id"), (F.col(label_column) > 0).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(id_remainder("id", 5) != 0).groupBy("id").agg(F.max("label").alias("label"))
    chosen = [r for label in (0, 1) for r in known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(training_rows).collect()]
    if not chosen:
        return Network().fit([], [])
    label_of = {r["id"]: r["label"] for r in chosen}
    id_type = known.schema["id"].dataType.simpleString()
    # at most twice training_rows ids
    sample = docs.sparkSession.createDataFrame([(k,) for k in label_of], f"id {id_type}")
    rows = docs.select(F.col(id_column).cast(id_type).alias("id"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(sample), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        for batch in batches:
            found = []
            for text in utf8_list(batch, "text"):
                words = words_of(text)
                starts = starts_of(len(words))
                starts = starts[np.unique(np.linspace(0, len(starts) - 1, min(training_windows, len(starts))).astype(np.int64))]
                found.append([b" ".join(words[s : s + WINDOW]) for s in starts.tolist()] if words else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], names=["id", "windows"])

    made = arrow_map(rows, run, f"id {id_type}, windows array<string>").distinct()
    got = made.orderBy(F.xxhash64("id", "windows"), "id").limit(2 * training_rows).collect()
    got.sort(key=lambda r: (r["id"], r["windows"]))
    return Network().fit([[w.encode().split(b" ") for w in r["windows"]] for r in got], [label_of[r["id"]] for r in got])


def score_documents(docs: DataFrame, network: Network, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more toxic) and ``predicted`` (1 from the threshold on).

    Null and wordless texts have score 0, very long ones are scored in all their
    windows, repeated rows get equal scores, a score at the threshold is 1, an
    empty table gives an empty one.  Other columns are no input and stay, except
    that ``score`` and ``predicted`` are replaced.  No shuffle.
    """
    kept = docs.drop("score", "predicted")
    shared, place = docs.sparkSession.sparkContext.broadcast(pickle.dumps(network)), kept.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            scores = scorer.scores([t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()])
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    schema = StructType([*kept.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return arrow_map(kept, run, schema)
