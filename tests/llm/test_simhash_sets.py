import random

import numpy as np
import pytest

from chromaloom.llm import simhash_sets
from tests.llm.cases import documents


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_roots(texts):
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = [brute_shingles(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def altered(rng, text, most):
    words = text.split()
    for at in rng.sample(range(len(words)), rng.randint(0, most)):
        words[at] = f"other{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        first = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(80, 400)))
        texts += [first, *(altered(rng, first, 8) for _ in range(5))]
    # a large group around the threshold, so that leaders do not reach all of a bucket at once
    common = " ".join(f"c{k}" for k in range(300))
    texts += [altered(rng, common, 9) for _ in range(60)]
    texts += ["one two", "One  two", "one three", "alone"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = simhash_sets.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_roots(texts)))


def test_rows_without_an_id_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(100))
    near, other = text.replace("w50", "x"), " ".join(f"v{k}" for k in range(100))
    rows = [(5, text), (5, text), (5, near), (None, text), (None, near), (7, near), (None, other), (None, other), (None, None), (9, " "), (10, None)]
    kept = simhash_sets.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 5 and sum(r.doc_id == 5 for r in kept) == 1
    assert [r.text for r in kept if r.doc_id is None and r.text] == [other]
    docs = documents(spark)
    assert simhash_sets.drop_similar(docs).columns == docs.columns
    assert simhash_sets.drop_similar(docs.limit(0)).count() == 0


def group(kind, rng):
    """Adverse groups: many links at the threshold, chains, and followers of different originals."""
    words = [f"{kind}{k}" for k in range(300)]
    base = " ".join(words)
    if kind == "few":
        return [altered(rng, base, 6) for _ in range(150)]
    if kind == "many":
        return [altered(rng, base, 12) for _ in range(80)]
    if kind == "chain":  # each shares most with the next, the ends nothing
        return [" ".join(f"t{k}" for k in range(at, at + 120)) for at in range(0, 600, 6)]
    if kind == "two":  # two originals that one text joins
        other = altered(rng, base, 14)
        return [*(altered(rng, base, 5) for _ in range(40)), *(altered(rng, other, 5) for _ in range(40)), base, other]
    if kind == "growing":
        return [" ".join(words[:n]) for n in range(60, 300, 4)]
    return [altered(rng, " ".join(words[:20]), 2) for _ in range(60)]  # short texts


@pytest.mark.parametrize("parts", [4096, 40])
def test_adverse_groups_lose_no_link(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash_sets, "BUCKET_ROWS", parts)
    rng, texts = random.Random(11), []
    for kind in ("few", "many", "chain", "two", "growing", "short"):
        texts += group(kind, rng)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = set(brute_roots(texts))
    kept = {r.doc_id for r in simhash_sets.drop_similar(docs).collect()}
    assert len(kept) < 1.01 * len(want) + 1 and kept >= want


def test_pairs_of_a_bucket():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, simhash_sets.SEGMENTS, dtype=np.uint32)
    ring = np.stack([base ^ np.where(rng.random(simhash_sets.SEGMENTS) < 0.2, np.uint32(1) << rng.integers(0, 32, simhash_sets.SEGMENTS, dtype=np.uint32), np.uint32(0)) for _ in range(40)])
    ring[30:] = rng.integers(0, 1 << 32, (10, simhash_sets.SEGMENTS), dtype=np.uint32)
    nodes, labels = np.arange(40) * 3, np.arange(40) // 4
    u, v, more = simhash_sets.bucket_pairs(nodes, labels, ring, 5, 100)
    got = set(zip(u.tolist(), v.tolist(), strict=True))
    budget = simhash_sets.BUDGET * np.arange(1, simhash_sets.SEGMENTS + 1)
    want = set()
    for a in range(40):
        for b in range(a):
            bits = np.bitwise_count(ring[a] ^ ring[b]).astype(int)
            holds = lambda s: (np.cumsum(np.roll(bits, -s)) <= budget).all()  # noqa: B023, E731
            earlier = any(bits[s] == 0 and bits[s + 1] == 0 and holds(s) for s in range(5))
            if labels[a] != labels[b] and holds(5) and not earlier:
                want.add((b * 3, a * 3))
    assert got == want and not more and len(want) > 5
    few, other, more = simhash_sets.bucket_pairs(nodes, labels, ring, 5, 1)
    assert 0 < len(few) <= 40 and set(zip(few.tolist(), other.tolist(), strict=True)) <= want
