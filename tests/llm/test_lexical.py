import math
from collections import Counter

import numpy as np
import pytest

from chromaloom.llm import lexical as L
from tests.llm.cases import documents
from tests.llm.test_importance import words


def brute(rows, items, top):
    held = [(doc_id, Counter(w), len(w)) for doc_id, text in rows if (w := words(text))]
    n_docs, all_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc_id, counts, n in held:
            m = 100 - 90 + 90 * n * n_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * counts[t] // (1000 * counts[t] + 8 * m)) for t in terms if counts[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [repr((item, rank + 1, doc_id, -score)) for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def made(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(k // 2 if k % 5 == 0 else k, " ".join(f"w{x}" for x in rng.zipf(1.2, rng.integers(0, 40)) % 60)) for k in range(n)]
    items = [(k % 25, " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 15)) % 70)) for k in range(40)] + [(None, "w1 w2"), (99, None)]
    return rows, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_equals_brute_force_in_one_and_in_many_blocks(spark, block_bytes):
    rows, items = made(5, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    frame = L.search(docs, spark.createDataFrame(items, "item_id long, text string"), top=10, block_bytes=block_bytes)
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr(tuple(r)) for r in frame.collect()) == brute(rows, items, 10)


def test_awkward_documents(spark):
    docs = documents(spark)
    items = [(1, "quick fox lorem"), (2, "École 中文"), (3, ""), (4, "nowhere")]
    frame = L.search(docs, spark.createDataFrame(items, "item_id long, text string"), top=3)
    assert sorted(repr(tuple(r)) for r in frame.collect()) == brute([(r.doc_id, r.text) for r in docs.collect()], items, 3)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert L.search(docs, nothing).count() == 0
    assert L.search(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 0.5), (2, "b", 6, 0.5)], "doc_id string, text string, rank int, score double")
    items = spark.createDataFrame([("x", "b")], "item_id string, text string")
    assert [tuple(r)[:3] for r in L.search(docs, items).orderBy("rank").collect()] == [("x", 1, "2"), ("x", 2, "1")]


def test_a_shard_reads_few_lists_and_finds_the_same():
    rng = np.random.default_rng(9)
    n, terms = 3000, 40
    pairs = np.unique(np.stack([rng.integers(0, n, 30_000), rng.zipf(1.5, 30_000) % terms], axis=1), axis=0)
    tfs, m, weight = rng.integers(1, 6, len(pairs)), rng.integers(10, 400, n), rng.integers(0, 3000, terms)
    shard = L.Shard(pairs[:, 1], tfs, pairs[:, 0], m, weight)
    gain = weight[pairs[:, 1]] * (10**9 * tfs // (1000 * tfs + 8 * m[pairs[:, 0]]))
    for _ in range(60):
        asked = rng.choice(terms, rng.integers(1, 12), replace=False)
        score = np.bincount(pairs[:, 0], gain * np.isin(pairs[:, 1], asked), minlength=n).astype(np.int64)
        best = np.lexsort((np.arange(n), -score))[:10]
        best = best[score[best] > 0]
        docs, scores = shard.search(asked, 10, 1)
        assert docs.tolist() == best.tolist() and scores.tolist() == score[best].tolist()
        assert not shard.score.any()
        if len(best) > 3:  # a threshold that was carried in leaves what reaches it
            least = int(score[best[3]])
            docs, scores = shard.search(asked, 10, least)
            assert docs.tolist() == [d for d in best.tolist() if score[d] >= least]
