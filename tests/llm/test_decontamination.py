import hashlib
import random
import re

import pytest

from chromaloom.llm import decontamination as dc
from tests.llm.cases import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    words = brute_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        spelled = brute_words(item_text)
        size = min(window, len(spelled))
        windows = {tuple(spelled[k : k + size]) for k in range(len(spelled) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes, at_once", [(1 << 20, 8), (300, 8), (300, 2)])
def test_against_brute_force(spark, monkeypatch, block_bytes, at_once):
    monkeypatch.setattr(dc, "BLOCKS_AT_ONCE", at_once)
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "É", "d7"]
    items = [(k, rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for k in range(30)] + [(40, None), (41, ""), (42, "only Four, words here")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 400))) for _ in range(60)]
    texts += [f"x {items[k][1].upper()} y" for k in range(20)] + ["it has ONLY four words   here and only four", "only four words"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.contamination_report(docs, bench, block_bytes=block_bytes).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n_words, n_hit, found = brute(texts[row.doc_id], items)
        assert (row.n_words, row.n_hit, row.n_items) == (n_words, n_hit, len(found)), row
        assert row.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert row.contaminated == (n_hit > 0)


def test_awkward_documents(spark):
    docs = documents(spark)
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river"), (2, "naïve"), (None, None)], "item_id long, text string")
    rows = dc.contamination_report(docs, bench).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.n_hit for r in rows} == {0: 11, 1: 11, 2: 11, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0, 8: 0, None: 0, 9: 0}
    assert dc.contamination_report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert dc.contamination_report(docs.limit(0), bench).count() == 0


def test_spans_are_cut_and_covered_documents_go(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    passage = "One two, three four five six seven eight nine ten eleven"
    rows = [(1, f"Before this. {passage}! After it came a long and clean sentence of many words.", 5), (2, passage, 6), (3, "Clean text.", 7), (4, None, 8)]
    kept = dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string, spans int"), bench).collect()
    assert {r.doc_id: r.text for r in kept} == {1: "Before this. ! After it came a long and clean sentence of many words.", 3: "Clean text.", 4: None}
    assert {r.doc_id: r.spans for r in kept} == {1: 5, 3: 7, 4: 8}


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_blocks_cut_what_the_whole_benchmark_cuts(spark, block_bytes):
    words = [f"w{k}" for k in range(1, 16)]
    items = [(k, " ".join(words[:10])) for k in range(4)] + [(k, " ".join(words[5:])) for k in range(4, 8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert block_bytes > 60 or sum(1 for b in dc._blocks(bench, "item_id", "text", block_bytes) if b) > 1
    around = [f"clean{k}" for k in range(30)]
    rows = [(1, " ".join([*around, *words])), (2, " ".join([*words[:10], "x", *words[5:], "y"])), (3, None)]
    kept = dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: r.text for r in kept} == {1: " ".join(around) + " ", 3: None}


def test_items_that_share_a_window_take_linear_room():
    import pickle

    shared = " ".join(f"s{k}" for k in range(10))
    sizes = []
    for n in (2_000, 20_000):
        items = [(str(k), f"{shared} own{k} word{k}".encode()) for k in range(n)] + [(f"x{k}", b"the same three") for k in range(n)]
        automaton = dc.SuffixAutomaton(items)
        sizes.append(len(pickle.dumps(automaton)))
        spans, names = next(automaton.scan_texts([dc.words_of(f"a {shared} b the same three".encode())]))
        assert spans == [(1, 11), (12, 15)] and len(names) == 2 * n
    assert sizes[1] < 12 * sizes[0]
