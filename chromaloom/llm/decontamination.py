"""Operator 4: benchmark decontamination by a generalised suffix automaton.

The words of all benchmark items make one suffix automaton.  Document words
stream through it; after each word the automaton gives the longest suffix read
so far that occurs in an item.  Where that length reaches the window, the last
``window`` words occur in an item; an item of fewer words counts as one window
of its own length.  Only runs of words that some item has are streamed, since
any other word sends the automaton back to its start.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from chromaloom.llm.common import arrow_map, free_name, release_kept, written

WINDOW = 10
#: Bytes of item text in one automaton; a larger benchmark makes several.  An automaton takes about 60 bytes of memory
#: for each byte of its text, on the driver and in each Python worker, whatever its items share.
BLOCK_BYTES = 2 << 20
#: Automata that one pass over the documents uses, one after another for each stretch of so many bytes of them.
BLOCKS_AT_ONCE, STRETCH_BYTES = 8, 32 << 20

#: A-Z become a-z; every byte that is no digit, letter or part of a non-ASCII character becomes a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over item words, with the items of each window.

    Most states have one transition; it stands in two arrays, and only the
    others of a state are in a dictionary.  A window's items stand in a row of
    one array, each item once, so they take no more room than the items' words.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.symbol, self.target = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        spelled = []
        for item, text in items:
            ids = array("i", [self.vocabulary.setdefault(word, len(self.vocabulary)) for word in words_of(text)])
            if ids:
                spelled.append((len(self.names), ids))
                self.names.append(item)
                last = 0
                for symbol in ids:
                    last = self._extend(last, symbol)
        self._label(spelled)

    def _go(self, state: int, symbol: int) -> int:
        """The state after ``symbol``, -1 for none."""
        if self.symbol[state] == symbol:
            return self.target[state]
        held = self.more.get(state)
        return -1 if held is None else held.get(symbol, -1)

    def _lead(self, state: int, symbol: int, target: int) -> None:
        if self.symbol[state] in (-1, symbol):
            self.symbol[state], self.target[state] = symbol, target
        else:
            self.more.setdefault(state, {})[symbol] = target

    def _state(self, length: int, link: int, symbol: int = -1, target: int = -1) -> int:
        self.symbol.append(symbol)
        self.target.append(target)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, parent: int, symbol: int, target: int) -> int:
        """The part of ``target`` whose strings end right after ``parent``'s."""
        copy = self._state(self.length[parent] + 1, self.link[target], self.symbol[target], self.target[target])
        if target in self.more:
            self.more[copy] = dict(self.more[target])
        self.link[target] = copy
        while parent >= 0 and self._go(parent, symbol) == target:
            self._lead(parent, symbol, copy)
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        there = self._go(last, symbol)
        if there >= 0:  # an earlier item has these words already
            return there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
        new, at = self._state(self.length[last] + 1, 0), last
        while at >= 0 and self._go(at, symbol) < 0:
            self._lead(at, symbol, new)
            at = self.link[at]
        if at >= 0:
            target = self._go(at, symbol)
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, symbol, target)
        return new

    def _label(self, spelled: list[tuple[int, array]]) -> None:
        count, window = len(self.link), self.window
        by_length = np.argsort(np.frombuffer(self.length, dtype=np.int32), kind="stable")[1:].tolist()
        #: The state on a state's suffix path that holds the strings of just window words, -1 for none.
        self.anchor = anchor = array("i", [-1]) * count
        for state in by_length:
            if self.length[state] >= window:
                up = self.link[state]
                anchor[state] = state if self.length[up] < window else anchor[up]
        at, whose = array("q"), array("q")
        short: dict[int, dict[int, list[int]]] = {}
        for item, ids in spelled:
            state = 0
            for k, symbol in enumerate(ids):
                state = self._go(state, symbol)
                if k + 1 >= window:
                    at.append(anchor[state])
                    whose.append(item)
            if len(ids) < window:
                short.setdefault(state, {}).setdefault(len(ids), []).append(item)
        # windows with their items, each once, and where a state's begin
        held = np.unique(np.frombuffer(at, dtype=np.int64) * max(len(spelled), 1) + np.frombuffer(whose, dtype=np.int64))
        states, items = np.divmod(held, max(len(spelled), 1))
        self.items = array("i", items.astype(np.int32).tobytes())
        self.begin = array("i", np.searchsorted(states, np.arange(count + 1)).astype(np.int32).tobytes())
        #: Items shorter than a window by the state where they end and their length, and the next such state on the suffix path.
        self.short = short
        self.short_at = array("i", [-1]) * count
        for state in by_length:
            self.short_at[state] = state if state in short else self.short_at[self.link[state]]
        self.least = min([window, *(n for held in short.values() for n in held)]) if spelled else 0

    def scan(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of words inside windows, and the items, for a run of known words."""
        spans, found, found_short, state, matched = [], set(), set(), 0, 0
        symbols, targets, more, link, length, short, short_at = self.symbol, self.target, self.more, self.link, self.length, self.short, self.short_at
        for at, symbol in enumerate(ids):
            while True:
                if symbols[state] == symbol:
                    state = targets[state]
                    matched += 1
                    break
                held = more.get(state)
                after = held.get(symbol, -1) if held is not None else -1
                if after >= 0:
                    state = after
                    matched += 1
                    break
                if not state:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            reach = 0
            if matched >= self.window:
                found.add(self.anchor[state])
                reach = self.window
            ending = short_at[state] if short else -1
            while ending >= 0:
                for n in short[ending]:
                    if n <= matched:
                        found_short.add((ending, n))
                        reach = max(reach, n)
                ending = short_at[link[ending]] if link[ending] >= 0 else -1
            if reach:
                start, end = at + 1 - reach, at + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))
        items = {self.names[k] for state in found for k in self.items[self.begin[state] : self.begin[state + 1]]}
        items.update(self.names[k] for state, n in found_short for k in short[state][n])
        return spans, items

    def scan_texts(self, texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int]], set[str]]]:
        """Spans and items of each text's words."""
        if not self.vocabulary:
            yield from (([], set()) for _ in texts)
            return
        known = self.vocabulary.get
        for words in texts:
            spans: list[tuple[int, int]] = []
            items: set[str] = set()
            if len(words) >= self.least:
                ids = np.array([known(w, -1) for w in words], dtype=np.int64)
                edge = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False].astype(np.int8)))
                for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if end - start >= self.least:
                        more, names = self.scan(ids[start:end].tolist())
                        spans += [(a + start, b + start) for a, b in more]
                        items |= names
            yield spans, items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*kept, text[last:]])


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in parts of about ``block_bytes`` at most; an item is never divided."""
    items = benchmark.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for part in range(parts):
        chosen = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        yield [(row["id"], bytes(row["text"])) for row in chosen.collect()]


def _passes(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int, window: int) -> Iterator[tuple[list, bool]]:
    """The broadcast automata of each pass over the documents, and whether it is the last."""
    context, blocks = benchmark.sparkSession.sparkContext, _blocks(benchmark, id_column, text_column, block_bytes)
    block = next(blocks)
    while block is not None:
        shared = []
        while block is not None and len(shared) < BLOCKS_AT_ONCE:
            shared.append(context.broadcast(pickle.dumps(SuffixAutomaton(block, window))))
            block = next(blocks, None)
        yield shared, block is None


def _scans(shared: list, batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[tuple[list[tuple[int, int]], set[str]]]]]:
    """Each batch with its texts' words, and their spans and items by all automata of a pass; one automaton is held at a time."""
    release_kept()
    if len(shared) == 1:
        automaton = pickle.loads(shared[0].value)
        for batch in batches:
            words = [words_of(t or b"") for t in batch.column(place).cast(pa.binary()).to_pylist()]
            yield batch, words, list(automaton.scan_texts(words))
        return
    for stretch in _stretches(batches):
        words = [[words_of(t or b"") for t in batch.column(place).cast(pa.binary()).to_pylist()] for batch in stretch]
        found: list[list[tuple[list, set]]] = [[([], set()) for _ in texts] for texts in words]
        for one in shared:
            automaton = pickle.loads(one.value)
            for texts, held in zip(words, found, strict=True):
                for k, (spans, names) in enumerate(automaton.scan_texts(texts)):
                    held[k] = held[k][0] + spans, held[k][1] | names
            del automaton
        yield from zip(stretch, words, found, strict=True)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, of about ``STRETCH_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= STRETCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of every whole text inside occurrences of benchmark windows.

    Returns ``id, n_words, spans array<struct<start:int,end:int>>, items
    array<string>``: disjoint half-open word spans in order, and the ids of the
    items that have an occurring window, as sorted strings.  Null and empty
    texts have no words; items without words match nothing; a null item id is
    the empty string and rows of one item id are one item; repeated documents
    are scanned each; an empty benchmark hits nothing; an empty table gives an
    empty one; other columns are not read.  No shuffle: the automata of
    ``BLOCKS_AT_ONCE`` blocks of the benchmark, of bounded size, are broadcast;
    only a benchmark of more than that carries the texts to another pass.
    """
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    id_type, first = rows.schema["id"].dataType.simpleString(), True
    found = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    for shared, last in _passes(benchmark, item_column, item_text, block_bytes, window):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch, texts, scanned in _scans(shared, batches, 1):
                before = [((), ())] * len(texts) if first else list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True))
                spans, items = [], []
                for (more, names), (old, old_names) in zip(scanned, before, strict=True):
                    all_spans = _joined([*((s["start"], s["end"]) for s in old), *more])
                    spans.append([{"start": a, "end": b} for a, b in all_spans])
                    items.append(sorted(names.union(old_names)))
                columns = {
                    "id": batch.column("id"),
                    "text": batch.column("text"),
                    "n_words": pa.array([len(t) for t in texts], pa.int64()),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    "items": pa.array(items, pa.list_(pa.string())),
                }
                if last:
                    del columns["text"]
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        rows = arrow_map(rows, run, f"id {id_type}, {'' if last else 'text string, '}{found}")
        if not last:
            rows = written(rows, "decontamination")
        first = False
    return rows.withColumnRenamed("id", id_column)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document; see :func:`contamination`."""
    id_column = parameters.get("id_column", "doc_id")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]).cast("long"))
    return contamination(docs, benchmark, **parameters).select(
        id_column,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.8, block_bytes: int = BLOCK_BYTES, text_column: str = "text") -> DataFrame:
    """Documents without their contaminated spans; all columns are kept.

    A span of more than ``max_span`` words goes from the text.  A document whose
    spans cover more than ``max_coverage`` of its words goes as a whole.  Texts
    without hits, null and empty ones stay as they are; repeated rows are each
    cut alike, an empty table gives an empty one, and columns of any name stay.  Spans are those of the
    whole benchmark on the unchanged text: where it is scanned in several
    blocks, the spans are carried from block to block and cut after the last.
    """
    columns, place, first = docs.columns, docs.columns.index(text_column), True
    carried = free_name(docs, "spans")
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema, with_spans = docs.schema, StructType([*docs.schema.fields, StructField(carried, ArrayType(span))])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for shared, last in _passes(benchmark, "item_id", "text", block_bytes, window):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch, words, scanned in _scans(shared, batches, place):
                before = [()] * len(words) if first else batch.column(len(columns)).to_pylist()
                found = [_joined([*((s["start"], s["end"]) for s in old), *spans]) for (spans, _), old in zip(scanned, before, strict=True)]
                batch = batch.select(range(len(columns)))
                if not last:
                    spans = pa.array([[{"start": a, "end": b} for a, b in held] for held in found], spans_type)
                    yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*columns, carried])
                    continue
                keep, changed = [], {}
                for k, spans in enumerate(found):
                    covered = sum(b - a for a, b in spans)
                    keep.append(not spans or covered <= max_coverage * len(words[k]))
                    if keep[k] and (long := [(a, b) for a, b in spans if b - a > max_span]):
                        changed[k] = long
                if changed:
                    old = batch.column(place)
                    whole = old.cast(pa.binary()).to_pylist()
                    for k, long in changed.items():
                        whole[k] = without_spans(whole[k], long)
                    batch = batch.set_column(place, batch.schema.field(place), pa.array(whole, pa.binary()).cast(old.type))
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = arrow_map(docs, run, schema if last else with_spans)
        if not last:
            docs = written(docs, "decontamination")
        first = False
    return docs
