import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from chromaloom.operators import links as L
from chromaloom.plans import settings
from chromaloom.plans.scaffolding import Parameters, cluster, evaluate, order, report_text
from chromaloom.sources import files, genome, records, sinks
from chromaloom.streaming import link_stream

SAM = "@HD\tVN:1.0\n@SQ\tSN:ctgA\tLN:1000\n@SQ\tSN:ctgB\tLN:2000\nr1\t0\tctgA\t11\t30\t10M\tctgB\t21\t0\t*\t*\nr1\t16\tctgB\t21\t0\t10M\tctgA\t11\t0\t*\t*\nr2/1\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\nr2/2\t0\tctgA\t5\t9\t10M\t=\t5\t0\t*\t*\n"


RECORDS = ((b"r1\0", 0, 0, 10, 30, 1, 20), (b"r1\0", 16, 1, 20, 0, 0, 10), (b"r2/1\0", 4, -1, -1, 0, -1, -1), (b"r2/2\0", 0, 0, 4, 9, 0, 4))


def bam_bytes(records=RECORDS, cuts=(37,), bases=0):
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2)
    for name, size in ((b"ctgA\0", 1000), (b"ctgB\0", 2000)):
        raw += struct.pack("<i", len(name)) + name + struct.pack("<i", size)
    for name, flag, tid, pos, mapq, mtid, mpos in records:
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(name), mapq, 0, 0, flag, bases, mtid, mpos, 0) + name + bytes((bases + 1) // 2) + b"\xff" * bases
        raw += struct.pack("<i", len(body)) + body
    rng, cuts = random.Random(1), list(cuts)
    while cuts[-1] + 40_000 < len(raw):
        cuts.append(cuts[-1] + rng.randint(200, 40_000))
    out, edges = b"", [0, *cuts, len(raw)]
    for part in [*(raw[a:b] for a, b in zip(edges, edges[1:])), b""]:
        packed = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = packed.compress(part) + packed.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("stretch", [3_000, 20_000, 32 << 20])
@pytest.mark.parametrize("bases", [0, 151])
def test_binary_files_are_read_in_stretches(spark, tmp_path, stretch, bases):
    rng = random.Random(3)
    records = [(f"read{k // 2}.{rng.randrange(10**9)}".encode() + b"\0", rng.choice([0, 16, 4]), rng.randint(-1, 1), rng.randint(-1, 900), rng.randint(0, 60), rng.randint(-1, 1), rng.randint(-1, 900)) for k in range(6000)]
    path = tmp_path / "many.bam"
    path.write_bytes(bam_bytes(records, (37,), bases))
    spark.dataSource.register(files.BamSource)
    read = spark.read.format("bam").option("paths", str(path)).option("stretch", str(stretch)).load()
    assert stretch > 1 << 20 or read.rdd.getNumPartitions() > 3
    got = [tuple(r)[2:] for r in read.orderBy("row_no").collect()]
    assert got == [(name[:-1].decode(), *rest) for name, *rest in records]


def test_lines_are_numbered_across_the_parts_of_a_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = files.lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
        assert rows.rdd.getNumPartitions() > 4
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.file[-5], r.row_no, r.value) for r in got) == sorted((name, k, f"{name} {k}") for name in "ab" for k in range(5000))
    (tmp_path / "none.txt").write_text("")
    assert files.lines(spark, str(tmp_path / "none.txt")).count() == 0


def test_text_and_binary_alignments_agree(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.BAM").write_bytes(bam_bytes())
    seen = []
    for name in ("a.sam", "a.BAM"):
        contigs, reads = files.read_alignments(spark, [str(tmp_path / name)])
        assert [tuple(r) for r in contigs.orderBy("tid").collect()] == [(0, "ctgA", 1000), (1, "ctgB", 2000)]
        seen.append([tuple(r)[2:] for r in reads.orderBy("row_no").collect()])
    assert seen[0] == seen[1] and seen[0][0] == ("r1", 0, 0, 10, 30, 1, 20)


def test_reads_pair_up_by_name(spark):
    names = ["a", "a", "b/1", "b/2", "c", "cx", "d", "d", "d", "e", "e.2"]
    rows = spark.createDataFrame([("f", k, n) for k, n in enumerate(names)], "file string, row_no int, qname string")
    found = [(r.qname1, r.qname2) for r in L.consecutive_pairs(rows).orderBy("row_no1").collect()]
    assert found == [("a", "a"), ("d", "d"), ("e", "e.2")]
    assert not spark.range(1).select(L.names_match(F.lit("c"), F.lit("cx")).alias("x")).head().x


def test_sequence_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nACGT\nAC\n>two\nGGG\n")
    got = files.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("tid").collect()
    assert [(r.tid, r.name, r.seq) for r in got] == [(0, "one", "ACGTAC"), (1, "two", "GGG")]
    sinks.write_fasta(spark.createDataFrame([("s", "A" * 165)], "name string, seq string"), str(tmp_path / "y.fa"))
    assert [r.value for r in spark.read.text(str(tmp_path / "y.fa")).collect()] == [">s", "A" * 80, "A" * 80, "A" * 5]
    for k in (1, 2):
        (tmp_path / f"b.{k}.out").write_text("".join(f"# BLASTN 2\n# Query: q{k}{n}\n" + f"q{k}{n}\tchr1\t99\t10\t0\t0\t1\t11\t5\t15\t1e-5\t20\n" * n for n in (0, 1, 2)))
    hits = files.read_blast(spark, [str(tmp_path / f"b.{k}.out") for k in (1, 2)]).orderBy("query_id", "row_no").collect()
    assert [(r.query_id, r.query) for r in hits] == [(1, "q11"), (2, "q12"), (2, "q12"), (4, "q21"), (5, "q22"), (5, "q22")]


def test_caches_are_read_back(spark, tmp_path):
    matrix = [(0, 1, 5), (1, 0, 5), (2, 0, 7), (0, 2, 7), (1, 1, 3)]
    sinks.write_link_matrix(spark.createDataFrame(matrix, "i int, j int, z long"), str(tmp_path / "glm"), 3)
    assert sorted(tuple(r) for r in files.read_link_matrix(spark, str(tmp_path / "glm")).collect()) == sorted(m for m in matrix if m[0] != m[1])
    cells = [(0, False, 1, True, 150), (0, False, 1, True, 90), (1, False, 0, True, 90)]
    sinks.write_group_links(spark.createDataFrame(cells, "c1 int, rc1 boolean, c2 int, rc2 boolean, dist long"), str(tmp_path / "clm"))
    assert sorted(tuple(r) for r in files.read_group_links(spark, str(tmp_path / "clm")).collect()) == sorted(cells)
    (tmp_path / "clusters.txt").write_text("# two\nb\ta\nc\n")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "tid int, name string")
    assert sorted(tuple(r) for r in files.read_clusters(spark, str(tmp_path / "clusters.txt"), names).collect()) == [(0, 0), (0, 1), (1, 2)]
    with pytest.raises(Exception, match="unknown name"):
        files.read_clusters(spark, str(tmp_path / "clusters.txt"), names.where("tid < 2")).collect()
    (tmp_path / "o.txt").write_text("# order\n3\tx\t1\t2.5\t.\n1\ty\t0\t.\t100\n")
    assert [tuple(r) for r in files.read_ordering(spark, str(tmp_path / "o.txt")).orderBy("pos").collect()] == [(0, 3, "x", True, 2.5, None), (1, 1, "y", False, None, 100)]
    (tmp_path / "g.txt").write_text("V\t0\tSTART\nV\t1\tEND\nE\te1\t0\t1\t-0.5\n")
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.txt"))
    assert nodes.count() == 2 and edges.head().w == -0.5
    sinks.write_graph(spark.createDataFrame([(0, 1), (1, 2)], "a int, b int"), str(tmp_path / "dot"))
    assert [r.value for r in spark.read.text(str(tmp_path / "dot")).collect()] == ["graph G {", "0 -- 1;", "1 -- 2;", "}"]


def test_small_formats(spark):
    one = lambda *values: spark.createDataFrame([(v,) for v in values], "value string")
    assert [r.tokens for r in records.csv_tokens(one("a, b,,c")).collect()] == [["a", "b", "", "c"]]
    assert [r.value for r in records.column_of(one("a 5\tx", "b\t6 y"), 1, "int").collect()] == [5, 6]
    with pytest.raises(Exception, match="too few columns"):
        records.column_of(one("a"), 1, "int").collect()
    assert {r.symbol: r.p for r in records.count_column(one("AAA 3", "", "CCC 1")).collect()} == {"AAA": 0.75, "CCC": 0.25}
    columns = records.alignment_columns(spark.createDataFrame([(0, "AC", "GT", "-A")], "block int, s1 string, s2 string, s3 string"))
    assert [r.symbol for r in columns.orderBy("k").collect()] == ["AG-", "CTA"]
    assert genome.chromosomes(spark).count() == 24


INI = {k: "x" if t in (str, list) else "1" for k, t in settings.KEYS.items()} | {"CLUSTER_NONINFORMATIVE_RATIO": "3", "CLUSTER_CONTIGS_WITH_CENS": "-1", "SAM_FILES": "a.bam b.bam"}


def ini(**changes):
    return "# comment\n" + "".join(f"{k} = {v}\n" for k, v in (INI | changes).items())


def test_settings():
    found = settings.parse(ini())
    assert found["SAM_FILES"] == ["a.bam", "b.bam"] and found["DO_ORDERING"] is True and found["CLUSTER_N"] == 1
    for bad in (ini(CLUSTER_N="x"), ini(DO_ORDERING="yes"), ini(CLUSTER_NONINFORMATIVE_RATIO="0.5"), ini(CLUSTER_CONTIGS_WITH_CENS="1 2"), ini().replace("SPECIES", "SPECIE"), ini().rpartition("REPORT_DRAW")[0]):
        with pytest.raises(settings.SettingsError):
            settings.parse(bad)
    assert settings.without_comments("#a\n\nb = 1\n") == "b = 1\n"


def planted(spark, chromosomes=3, each=10, seed=2):
    """Contigs along chromosomes, and pairs whose chance falls with their distance."""
    rng = random.Random(seed)
    size = 20_000
    contigs = [(k, f"c{k}", size, 40, 41) for k in range(chromosomes * each)]
    truth = [(k, k // each, (k % each) * size, (k % each + 1) * size, False) for k in range(chromosomes * each)]
    pairs = []
    for n in range(20_000):
        chrom, a = rng.randrange(chromosomes), rng.randrange(each * size)
        b = a + int(size * 0.2 / max(rng.random(), 1e-3)) * rng.choice((-1, 1))
        if 0 <= b < each * size and a // size != b // size:
            pairs.append((n, chrom * each + a // size, chrom * each + b // size, a % size, b % size, 30, 30))
    for n in range(300):
        a, b = rng.sample(range(chromosomes * each), 2)
        pairs.append((10**6 + n, a, b, rng.randrange(size), rng.randrange(size), 30, 30))
    return (
        spark.createDataFrame(contigs, "tid int, name string, len long, re_raw long, re long"),
        spark.createDataFrame(truth, "tid int, chrom int, t0 long, t1 long, rc boolean"),
        spark.createDataFrame(pairs, link_stream.PAIRS),
    )


def test_planted_chromosomes_are_found(spark):
    contigs, truth, pairs = planted(spark)
    p = Parameters(n_clusters=3, min_sites=5, trunk_sites=5, shred_sites=5)
    groups = cluster(pairs.cache(), contigs, p).cache()
    found = {frozenset(r.m) for r in groups.groupBy("cluster_id").agg(F.collect_set("tid").alias("m")).collect()}
    assert found == {frozenset(range(10 * c, 10 * c + 10)) for c in range(3)}
    ordered = order(pairs, groups, contigs, p).cache()
    for c in range(3):
        tids = [r.tid for r in ordered.where(f"kind = 'full' and cluster_id = {c}").orderBy("pos").collect()]
        steps = [abs(a - b) for a, b in zip(tids, tids[1:], strict=False)]
        assert len(tids) == 10 and sum(s == 1 for s in steps) >= 7
    text = report_text(evaluate(ordered, groups, contigs, truth, p))
    assert "TOTALS" in text and "CHART" in text


def test_streamed_matrix_equals_the_whole(spark, tmp_path):
    _, _, pairs = planted(spark)
    for k in range(3):
        pairs.where(f"qid % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = link_stream.pair_stream(spark, str(tmp_path / "in"), 1)
    link_stream.keep_deltas(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    whole = sorted(tuple(r) for r in L.link_matrix(pairs).collect())
    assert sorted(tuple(r) for r in link_stream.summed_deltas(spark, str(tmp_path / "out")).collect()) == whole
    query = link_stream.running_matrix(stream).writeStream.outputMode("complete").format("memory").queryName("links_now").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r.z for r in spark.table("links_now").collect()) * 2 == sum(r[2] for r in whole)


def test_mates_that_come_in_different_batches(spark, tmp_path):
    _, _, pairs = planted(spark)
    reads = [(f"q{r.qid}" + end, 0, tid, pos, mapq) for r in pairs.limit(250).collect() for end, tid, pos, mapq in (("/1", r.tid1, r.pos1, r.mapq1), ("/2", r.tid2, r.pos2, r.mapq2))]
    want = sorted(tuple(r) for r in L.link_matrix(spark.createDataFrame([(k, a[2], b[2], a[3], b[3], a[4], b[4]) for k, (a, b) in enumerate(zip(reads[::2], reads[1::2], strict=True))], link_stream.PAIRS)).collect())
    reads += [("alone", 0, 1, 5, 30), ("lost/1", 4, -1, -1, 0), ("lost/2", 0, 2, 9, 30)]
    random.Random(5).shuffle(reads)
    for k in range(4):
        spark.createDataFrame(reads[k::4], link_stream.READS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = link_stream.mate_pairs(link_stream.read_stream(spark, str(tmp_path / "in"), 1))
    link_stream.keep_deltas(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 4
    assert sorted(tuple(r) for r in link_stream.summed_deltas(spark, str(tmp_path / "out")).collect()) == want


def test_regions_grow_from_the_longest_hit(spark):
    from chromaloom.functions.intervals import grown_region

    rng = random.Random(4)
    hits = [(q, t, n, a, a + s) if rng.random() < 0.5 else (q, t, n, a + s, a) for n, (q, t, a, s) in enumerate((rng.randrange(4), rng.randrange(2), rng.randrange(500), rng.randint(1, 60)) for _ in range(80))]
    found = grown_region(spark.createDataFrame(hits, "query_id int, target int, hit int, t_start int, t_end int"), spark.createDataFrame([(q, 150 + 40 * q) for q in range(4)], "query_id int, size int")).collect()
    assert len(found) == len({(h[0], h[1]) for h in hits})
    for r in found:
        own = [h for h in hits if (h[0], h[1]) == (r.query_id, r.target)]
        lengths = {}
        for h in own:
            lengths.setdefault(abs(h[4] - h[3]), min(h[3], h[4]))
        ordered = sorted(lengths.items(), reverse=True)
        a, b = ordered[0][1], ordered[0][1] + ordered[0][0]
        for size, low in ordered:
            x, y = min(a, low), max(b, low + size)
            if y - x <= 150 + 40 * r.query_id:
                a, b = x, y
        assert (r.start, r.stop) == ((b, a) if own[0][4] < own[0][3] else (a, b))
