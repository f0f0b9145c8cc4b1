"""The first call over a point, against brute force, where many calls lie over it."""

import random

import pytest

from chromaloom.functions import intervals as I


@pytest.mark.parametrize("parts", [None, 7])
def test_first_call_under_many(spark, parts):
    rng = random.Random(5)
    calls = [(rng.choice(["a", "b", None]), a := rng.randrange(300), a + rng.randrange(-2, 120), rng.randrange(3)) for _ in range(400)]
    points = [(k, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-5, 430)])) for k in range(600)]
    want = {}
    for pid, chrom, pos in points:
        over = [(a, b, cn) for c, a, b, cn in calls if c is not None and c == chrom and pos is not None and a <= pos < b]
        want[pid] = min(over)[2] if over else -1
    frames = spark.createDataFrame(points, "pid int, chrom string, pos long"), spark.createDataFrame(calls, "chrom string, a long, b long, cn int")
    found = I.point_lookup(*frames, "chrom", parts).collect()
    assert len(found) == 600 and {r.pid: r.cn for r in found} == want


def test_no_join_of_points_with_calls(spark, capsys):
    points, calls = spark.createDataFrame([(1, "a", 5)], "pid int, chrom string, pos long"), spark.createDataFrame([("a", 0, 9, 2)], "chrom string, a long, b long, cn int")
    I.point_lookup(points, calls, "chrom").explain()
    assert "SortMergeJoin" not in capsys.readouterr().out
