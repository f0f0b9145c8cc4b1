"""Regions of binary alignments: pushed conditions, the index, and stretches that vouch for one another."""

import random

import pytest

from chromaloom.operators.links import in_region
from chromaloom.sources import files
from tests.test_files import bam_bytes


def made(seed, n=6000, in_order=True):
    rng = random.Random(seed)
    places = [(rng.randint(0, 1), rng.randrange(900_000)) for _ in range(n)]
    places = sorted(places) if in_order else places
    return [(f"read{k}.{rng.randrange(10**9)}".encode() + b"\0", rng.choice([0, 16]), t, p, rng.randint(0, 60), t, p) for k, (t, p) in enumerate(places)] + [(b"lost\0", 4, -1, -1, 0, -1, -1)] * 5


@pytest.fixture
def counted(monkeypatch):
    """Bytes that are read from files, by this process."""
    total, opened = [0], files._opened

    class Counting:
        def __init__(self, source):
            self.source = source

        def size(self):
            return self.source.size()

        def read_at(self, n, at):
            total[0] += n
            return self.source.read_at(n, at)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.source.close()

    monkeypatch.setattr(files, "_opened", lambda path: Counting(opened(path)))
    return total


@pytest.mark.parametrize("in_order", [True, False])
@pytest.mark.parametrize("stretch", [5_000, 40_000, 32 << 20])
def test_regions_equal_a_filter_over_everything(spark, tmp_path, in_order, stretch):
    records = made(stretch, in_order=in_order)
    path = str(tmp_path / "a.bam")
    (tmp_path / "a.bam").write_bytes(bam_bytes(records))
    files.write_bam_index(spark, [path], str(tmp_path / "index"), stretch)
    _, whole = files.read_alignments(spark, [path])
    _, some = files.read_alignments(spark, [path], str(tmp_path / "index"))
    assert [tuple(r)[2:] for r in some.orderBy("row_no").collect()] == [(n[:-1].decode(), *rest) for n, *rest in records]
    for tid, start, end in ((0, 100_000, 130_000), (1, None, 5_000), (1, 899_000, None), (0, 5, 5)):
        low, high = start or 0, 1 << 40 if end is None else end
        want = sorted((n[:-1].decode(), p) for n, _, t, p, *_ in records if t == tid and low <= p <= high)
        for reads in (whole, some):
            assert sorted((r.qname, r.pos) for r in in_region(reads, tid, start, end).select("qname", "pos").collect()) == want
    assert some.where("tid = 0 and mapq > 30 and flag = 16 and qname like 'read%'").count() == sum(t == 0 and q > 30 and f == 16 for _, f, t, _, q, *_ in records)


def test_a_region_reads_its_blocks_only(spark, tmp_path, counted):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

    records = made(1, 60_000)
    path = str(tmp_path / "a.bam")
    (tmp_path / "a.bam").write_bytes(bam_bytes(records))
    files.write_bam_index(spark, [path], str(tmp_path / "index"), 100_000)
    reader = files.BamReader([path], files.STRETCH_BYTES, str(tmp_path / "index"))
    asked = [EqualTo(("tid",), 1), GreaterThanOrEqual(("pos",), 400_000), LessThanOrEqual(("pos",), 410_000)]
    assert list(reader.pushFilters(asked)) == []
    counted[0] = 0
    got = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted(r["pos"] for r in got) == sorted(p for _, _, t, p, *_ in records if t == 1 and 400_000 <= p <= 410_000)
    size = (tmp_path / "a.bam").stat().st_size
    assert size > 700_000 and counted[0] < 0.35 * size
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    plan = in_region(files.read_alignments(spark, [path], str(tmp_path / "index"))[1], 1, 400_000, 410_000)._jdf.queryExecution().toString()
    # the source has tested the places; Spark only tests for nulls
    assert "400000" not in plan.split("Physical Plan")[1]


def test_a_wrong_guess_is_refused(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.bam"
    path.write_bytes(bam_bytes(made(3)))
    reader = files.BamReader([str(path)], 20_000)
    parts = reader.partitions()
    assert len(parts) > 3
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 6005
    right = files.first_record
    # a guess that takes the second record for the first would lose one without a word
    monkeypatch.setattr(files, "first_record", lambda raw, targets: right(raw[(at := right(raw, targets)) + 4 + int.from_bytes(raw[at : at + 4], "little") :], targets) + at + 4 + int.from_bytes(raw[at : at + 4], "little"))
    with pytest.raises(ValueError, match="the next begins at"):
        list(reader.read(parts[0]))
