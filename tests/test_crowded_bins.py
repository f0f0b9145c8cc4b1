"""Overlaps where many intervals lie in one bin."""

import random

import pytest

from chromaloom.functions import intervals as I


@pytest.fixture
def uncoalesced(spark):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def test_a_crowded_bin_is_dealt_to_many_tasks(uncoalesced, monkeypatch):
    monkeypatch.setattr(I, "SLICE", 50, raising=False)
    rng = random.Random(8)
    made = lambda n: [("a", k, a := 100 + rng.randrange(600), a + rng.choice([0, 1, 9, 300])) for k in range(n)]
    # one that spans bins, equal ones, and one of no chromosome
    left, right = [*made(60), ("a", 60, 5, 90_000), (None, 61, 0, 9)], [*made(900), ("a", 900, 0, 90_000), *[("a", k, 300, 310) for k in range(901, 1100)], (None, 1100, 0, 9)]
    one, two = (uncoalesced.createDataFrame(rows, f"chrom string, id{k} int, a{k} long, b{k} long") for k, rows in ((1, left), (2, right)))
    found = I.overlap_join(one, two, "chrom")
    got = sorted((r.id1, r.id2, r.start, r.stop) for r in found.collect())
    assert got == sorted((i, j, max(a, c), min(b, d)) for x, i, a, b in left for y, j, c, d in right if x and x == y and a < d and c < b and a < b and c < d)
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < 0.7 * len(got)


def test_equal_neighbours_follow_each_other(uncoalesced, tmp_path):
    """A file of pairs takes under two bytes a row where many intervals overlap."""
    rng = random.Random(9)
    made = lambda n: [("a", k, a := rng.randrange(4000), min(a + 300, 4095)) for k in rng.sample(range(10 * n), n)]
    one, two = (uncoalesced.createDataFrame(made(1500), f"chrom string, id{k} long, a{k} long, b{k} long") for k in (1, 2))
    found = I.overlap_join(one, two, "chrom").select("id1", "id2", "start", "stop")
    found.write.parquet(path := f"{tmp_path}/pairs")
    size = sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet"))
    assert size < 2 * uncoalesced.read.parquet(path).count()
