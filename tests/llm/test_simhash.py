import random

import numpy as np
import pytest
import xxhash

from chromaloom.llm import simhash
from chromaloom.llm.components import components
from tests.llm.cases import documents


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """Component of each value of a list by comparing all."""
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(values))]


def near_values(seed, centres, each):
    rng = random.Random(seed)
    values = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            value = centre
            for _ in range(rng.randint(0, 7)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    return sorted(values)


def test_awkward_documents(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    values = {k: brute_fingerprint(t) for k, t in texts.items()}
    ids = [k for k in values if k is not None]
    roots = brute_components([values[k] for k in ids])
    expect = {ids[k]: min(ids[j] for j in range(len(ids)) if roots[j] == roots[k]) for k in range(len(ids))}
    for row in rows:
        assert row.fingerprint == f"{values[row.doc_id]:016x}"
        if row.doc_id is not None:
            assert row.component_id == expect[row.doc_id]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows", [4096, 8])
def test_links_reach_what_brute_force_reaches(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    values = near_values(5, 12, 60)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()
    root = {r.node: r.root for r in found}
    mine = [root.get(v, v) for v in signed]
    truth = brute_components(values)
    assert len(set(zip(mine, truth, strict=True))) == len(set(mine)) == len(set(truth))


def test_components_of_chains_hubs_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 180)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 180)} | {201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
