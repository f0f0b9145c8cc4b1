"""Ordered scans over ranges, and nested bins, against brute force; small ranges make every border matter."""

import random

import pytest
from pyspark.sql import functions as F

from chromaloom.functions import intervals as I
from chromaloom.functions import ordered as O
from chromaloom.functions import sequences as S


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def islands(rows, gap):
    out = []
    for c, a, b in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        if out and out[-1][0] == c and a - out[-1][2] <= gap:
            out[-1][2], out[-1][3] = max(out[-1][2], b), out[-1][3] + 1
        else:
            out.append([c, a, b, 1])
    return sorted(map(str, out))


@pytest.mark.parametrize("spread, gap", [(40_000, 0), (4_000, 0), (40_000, 30), (100, 0)])
def test_islands_of_one_chromosome_over_many_ranges(many_ranges, spread, gap):
    rng = random.Random(spread + gap)
    rows = [(rng.choice([7, 7, 7, 8, None]), a := rng.randrange(spread), a + rng.choice([1, 5, 60, 900])) for _ in range(800)]
    frame = many_ranges.createDataFrame(rows, "chrom int, a long, b long")
    got = I.merged(frame, "chrom", "a", "b", gap, parts=9)
    assert sorted(str(list(r)) for r in got.collect()) == islands(rows, gap)


def test_no_window_is_keyed_by_a_chromosome_alone(many_ranges):
    frame = many_ranges.range(5000).select(F.lit(1).alias("chrom"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 5).alias("b"))
    placed = O.dealt(frame, ["chrom", "a"], 8)
    sizes = [r["count"] for r in placed.groupBy(O.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    for made in (I.merged(frame, "chrom", "a", "b", parts=8), I.windows_of(frame, "chrom", "a", "b", 25, parts=8)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        # the other windows are over the summaries, which have a row for each range
        for line in plan.splitlines():
            if "Window [" in line and "__part" not in line:
                raise AssertionError(line)
    assert I.merged(frame, "chrom", "a", "b", parts=8).count() == 5000


def test_windows_of_intervals_over_many_ranges(many_ranges):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), a := rng.randrange(3000), a + rng.randrange(1, 50)) for _ in range(1000)] + [(1, 50, 60)] * 90
    spans, order = {}, sorted(rows)
    for c in {r[0] for r in rows}:
        for k, r in enumerate([r for r in order if r[0] == c]):
            x = spans.setdefault((c, k // 25), [c, r[1], r[2]])
            x[1], x[2] = min(x[1], r[1]), max(x[2], r[2])
    spans.pop(max(spans))
    got = I.windows_of(many_ranges.createDataFrame(rows, "chrom int, a long, b long"), "chrom", "a", "b", 25, parts=6)
    assert sorted(tuple(r) for r in got.collect()) == sorted(map(tuple, spans.values()))


def test_ranks_over_many_ranges(many_ranges):
    rows = many_ranges.range(3000).select("id", (F.col("id") * 7919 % 3001).alias("v"))
    got = O.ranked(rows, ["v"], "k", 9).collect()
    assert sorted(r.v for r in got) == [r.v for r in sorted(got, key=lambda r: r.k)] and sorted(r.k for r in got) == list(range(3000))
    assert O.ranked(rows.limit(0), ["v"], "k").count() == 0


def test_sites_of_one_long_sequence(many_ranges):
    rng = random.Random(8)
    text = "".join(rng.choice("ACGT") for _ in range(20_000))
    frame = many_ranges.createDataFrame([("x", text), ("y", "GA"), ("z", "")], "key string, seq string")
    sites, at = [], text.find("GATC")
    while at >= 0:
        sites.append(at)
        at = text.find("GATC", at + 4)
    got = S.motif_positions(frame, "key", "seq", "GATC", 7)
    assert sorted(r.pos for r in got.collect()) == sites
    spans = []
    for p in sites:
        if spans and p - 40 <= spans[-1][1]:
            spans[-1][1] = p + 40
        else:
            spans.append([p - 40, p + 40])
    found = sorted((r.start, r.stop) for r in S.motif_windows(frame, "key", "seq", "GATC", 40, 7).collect())
    assert found == [(max(a, 0), min(b, len(text))) for a, b in spans]


def made_intervals(seed, n, offset=0):
    rng = random.Random(seed)
    return [(rng.choice([1, 2]), offset + k, a := rng.randrange(3 << 20), a + rng.choice([0, 1, 30, 3000, 5000, 70_000, 2 << 20])) for k in range(n)]


def test_nested_bins_meet_every_pair_once(spark):
    left, right = [*made_intervals(1, 150), (1, 900, 0, 1 << 40)], [*made_intervals(2, 150), (1, 901, 4095, 4097), (1, 902, 0, 1)]
    one, two = (spark.createDataFrame(rows, f"chrom int, id{k} int, a{k} long, b{k} long") for k, rows in ((1, left), (2, right)))
    got = sorted((r.id1, r.id2, r.start, r.stop) for r in I.overlap_join(one, two, "chrom").collect())
    assert got == sorted((i, j, max(a, c), min(b, d)) for x, i, a, b in left for y, j, c, d in right if x == y and a < d and c < b and a < b and c < d)
    calls = spark.createDataFrame([(c, a, b, k % 5) for c, k, a, b in left], "chrom int, a long, b long, cn int")
    points = spark.createDataFrame([(k, c, a) for c, k, a, _ in right], "pid int, chrom int, pos long")
    want = {k: next((cn for _, _, cn in sorted((x, y, i % 5) for q, i, x, y in left if q == c and x <= a < y)), -1) for c, k, a, _ in right}
    assert {r.pid: r.cn for r in I.point_lookup(points, calls, "chrom").collect()} == want


def test_an_interval_has_one_row_however_long(spark):
    rows = spark.createDataFrame([(1, 0, 1, 250_000_000), (1, 1, 5, 9), (1, 2, 4000, 4200), (1, 3, 7, 7)], "chrom int, id int, a long, b long")
    placed = I.placed_in_bins(rows, "a", "b").collect()
    assert sorted(r.id for r in placed) == [0, 1, 2]
    for r in placed:
        shift = 12 + 3 * r["__level"]
        assert r.a >> shift == (r.b - 1) >> shift == r["__bin"]
        assert r["__level"] == 0 or r.a >> (shift - 3) != (r.b - 1) >> (shift - 3)


def paired(names):
    out, k = [], 0
    matches = lambda a, b: a == b or any(x.startswith(y) and not x[len(y)].isalnum() for x, y in ((a, b), (b, a)) if len(x) > len(y))
    while k + 1 < len(names):
        if matches(names[k], names[k + 1]):
            out.append((k, k + 1))
            k += 2
        else:
            k += 1
    return out


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_mates_across_the_borders_of_ranges(many_ranges, parts):
    from chromaloom.operators.links import consecutive_pairs

    rng, rows, want = random.Random(parts), [], []
    for file in "abc":
        names = []
        while len(names) < (5 if file == "b" else 150):
            names += [f"r{len(names)}" + rng.choice(["", "", ""])] * rng.choice([1, 2, 2, 3, 5, 12])
        names = [n + rng.choice(["", "/1", "/2"]) if rng.random() < 0.2 else n for n in names]
        rows += [(file, k, n, k * 10) for k, n in enumerate(names)]
        want += [(file, names[a], a, a * 10, names[b], b, b * 10) for a, b in paired_as_runs(names)]
    frame = many_ranges.createDataFrame(rows, "file string, row_no int, qname string, pos long").repartition(5)
    got = consecutive_pairs(frame, parts=parts)
    assert got.columns == ["file", "row_no1", "qname1", "pos1", "row_no2", "qname2", "pos2"]
    assert sorted((r.file, r.qname1, r.row_no1, r.pos1, r.qname2, r.row_no2, r.pos2) for r in got.collect()) == sorted(want)


def paired_as_runs(names):
    """Front to back: a read starts a pair if the next one matches, and both are then used."""
    return paired(names)


def test_headers_over_many_ranges(many_ranges):
    from chromaloom.sources import records as R

    rng, rows, sizes, k = random.Random(2), [], [], 0
    for n in range(60):
        rows.append(("f", k, f">s{n} more"))
        body = ["ACGT"[: rng.randrange(1, 5)] * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 2, 30]))]
        rows += [("f", k + 1 + j, line) for j, line in enumerate(body)]
        k += 1 + len(body)
        sizes.append((n, f"s{n}", "".join(body)))
    frame = many_ranges.createDataFrame([("f", -1, "before"), *rows], "file string, row_no int, value string").repartition(4)
    assert sorted((r.tid, r.name, r.size) for r in R.fasta_sizes(frame, 11).collect()) == [(n, s, len(x)) for n, s, x in sizes]
    assert sorted((r.tid, r.name, r.seq) for r in R.fasta_sequences(frame, 11).collect()) == sizes


def test_files_are_cut_inside_records(spark, tmp_path):
    from chromaloom.sources import files

    rng = random.Random(6)
    sequences = {f: [(n, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 7, 60, 2000])))) for n in range(40)] for f in "xy"}
    for f, held in sequences.items():
        (tmp_path / f"{f}.fa").write_text("".join(f">{f}{n}\n" + "".join(s[k : k + 50] + "\n" for k in range(0, len(s), 50)) for n, s in held))
    hits = {q: rng.randrange(40) for q in range(90)}
    (tmp_path / "z.out").write_text("".join(f"# BLASTN 2\n# Query: q{q}\n" + f"q{q}\tchr1\t99\t10\t0\t0\t1\t11\t5\t15\t1e-5\t20\n" * n for q, n in hits.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        paths = [str(tmp_path / f"{f}.fa") for f in "xy"]
        rows = files.headed(spark, paths, ">")
        assert rows.rdd.getNumPartitions() >= 10
        assert sorted((r.file[-4], r.row_no, r.value) for r in rows.collect()) == sorted((r.file[-4], r.row_no, r.value) for r in files.lines(spark, paths).collect())
        got = files.read_fasta_sizes(spark, paths)
        assert sorted((r.name, r.tid, r.size) for r in got.collect()) == sorted((f"{f}{n}", n, len(s)) for f, held in sequences.items() for n, s in held)
        assert sorted((r.name, r.seq) for r in files.read_fasta(spark, paths[0]).collect()) == sorted((f"x{n}", s) for n, s in sequences["x"])
        found = files.read_blast(spark, [str(tmp_path / "z.out")]).groupBy("query_id", "query").count().collect()
        assert sorted((r.query_id, r.query, r["count"]) for r in found) == sorted((q, f"q{q}", n) for q, n in hits.items() if n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pairs_and_rows_of_large_tables_keep_apart(spark):
    """Keys were numbers that met once a cluster had 100,000 contigs, or an order key passed ten million."""
    from chromaloom.plans import size_queries

    rows = size_queries._links(spark, "/root/testdata/sf0.001")
    assert rows.schema["pair"].dataType.simpleString().startswith("struct<cluster_id:") and rows.select("pair").distinct().count() > 1
    order = size_queries._blast_lines(spark, "/root/testdata/sf0.001").schema["row_no"].dataType.simpleString()
    assert order == "struct<query_id:bigint,hit:bigint>"


def test_calls_are_joined_in_order(many_ranges, tmp_path):
    from chromaloom.sources import sinks
    from tests.test_ordered_text import whole_text

    rng, rows, at = random.Random(9), [], 0
    for _ in range(600):
        at += rng.choice([0, 0, 5, 40])
        rows.append((rng.choice([1, 1, 1, 2]), at, at + 10, *rng.choice([(1, 1), (1, 1), (2, 0), (2, 1)])))
        at += 10
    want = []
    for c in (1, 2):
        for _, a, b, major, minor in sorted(r for r in rows if r[0] == c):
            if want and want[-1][0] == c and want[-1][4:] == [major, minor] and a - want[-1][2] <= 5:
                want[-1][2] = max(b, want[-1][2])
            else:
                want.append([c, a, b, major + minor, major, minor])
    frame = many_ranges.createDataFrame(rows, "chrom int, a long, b long, major int, minor int")
    calls = I.haplotype_calls(frame, "chrom", "a", "b", 5, parts=8)
    assert sorted(map(list, calls.collect())) == want
    names = many_ranges.createDataFrame([(1, "chrA"), (2, "chrB")], "chrom int, name string")
    sinks.write_haplotype_calls(calls, str(tmp_path / "bed"), names, 4)
    assert whole_text(tmp_path / "bed") == "".join("\t".join(map(str, ["chr" + "_AB"[c], *rest])) + "\n" for c, *rest in want)
    held = many_ranges.createDataFrame([(c, a, b, cn + (k % 50 == 0)) for k, (c, a, b, cn, _, _) in enumerate(want)], "chrom int, start long, stop long, cn int")
    assert sorted(map(list, I.without_support(calls, held, "chrom").collect())) == [w for k, w in enumerate(want) if k % 50 == 0]
    with pytest.raises(Exception, match="lesser haplotype"):
        I.haplotype_calls(many_ranges.createDataFrame([(1, 0, 5, 0, 1)], "chrom int, a long, b long, major int, minor int"), "chrom", "a", "b").collect()
