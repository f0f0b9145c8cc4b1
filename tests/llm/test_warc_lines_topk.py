import base64
import hashlib
import random
from collections import Counter

import pytest

from chromaloom.llm import line_dedup, topk, warc
from tests.llm.cases import documents

PAGES = [
    (1, "http://a/1", "<p>é 1</p>", 0), (2, "http://a/2", "<p>same</p>", 0), (3, None, "<p>same</p>", 0), (4, "http://a/4", None, 0),
    (5, "http://a/5", "", 0), (6, "http://a/6", "x\r\n\r\ny" * 50000, 0), (7, "http://a/7", "<p>same</p>", 0), (None, "http://a/8", "no id", 0), (7, "http://a/7", "<p>same</p>", 0),
]


@pytest.mark.parametrize("min_payload", [0, 12])
def test_archives_are_read_back(spark, min_payload):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, offset int")
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder, min_payload=min_payload)
    rows = warc.read_records(index, folder).collect()
    expect = []
    for page_id, url, html, _ in PAGES:
        if page_id is None:
            continue
        payload = (html or "").encode()
        keeper = max(p for p, _, h, _ in PAGES if p is not None and (h or "").encode() == payload)
        stored = keeper == page_id or len(payload) < min_payload
        expect.append((page_id, url or "", len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if stored else "revisit", None if stored else keeper, payload if stored else None))
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in rows) == Counter(expect)
    some = warc.read_records(index.where("page_id in (1, 6)"), folder).collect()
    assert sorted(r.page_id for r in some) == [1, 6]
    nothing = warc.archive_folder(pages)
    assert warc.read_records(warc.write_archives(pages.limit(0), nothing), nothing).count() == 0


def brute_lines(rows, ratio, least):
    pages, holding = Counter(), Counter()
    for _, text, host in rows:
        pages[host or ""] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            holding[host or "", line] += 1
    out = []
    for doc_id, text, host in rows:
        lines = text.split("\n") if text is not None else []
        stays = lambda n, all_pages: n <= ratio * all_pages or n < least
        kept = [x for x in lines if not x.strip(" ") or stays(holding[host or "", x.strip(" ")], pages[host or ""])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("broadcast", [8 << 20, -1])
def test_lines_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)
    rng = random.Random(6)
    lines = ["", " ", "menu", " menu ", "imprint", "École", *(f"line {k}" for k in range(30))]
    rows = [(k, "\n".join(rng.choices(lines, weights=[3, 1, 9, 2, 5, 1, *[1] * 30], k=rng.randint(0, 8))), rng.choice(["a", "a", "a", "b", None])) for k in range(200)]
    rows += [(400 + k, "small\n" + str(k % 2), "small") for k in range(3)] + [(410 + k, "pair", "two") for k in range(2)]
    rows += [(300, None, "a"), (301, "", "c"), (302, "menu\n" * 3000, "a"), (1, "menu", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_dedup.line_report(docs, ratio=0.2, min_pages=4).collect()
    expect = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows, 0.2, 4)]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found) == Counter(expect)
    kept = {(r.doc_id, r.text) for r in line_dedup.drop_boilerplate(docs, ratio=0.2, min_pages=4).collect()}
    assert kept == {(i, t if n else None) for i, n, _, t in brute_lines(rows, 0.2, 4)}


def test_hosts_of_urls(spark):
    rows = [(k, "http://Site.example/a" if k % 2 else "https://site.example/b?x", "menu\n" + str(k)) for k in range(12)] + [(20, None, "menu"), (21, "no url", "menu")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host_", topk.F.lit("own")).withColumn("lines_", topk.F.lit(1))
    kept = line_dedup.drop_boilerplate(pages, text_column="html", ratio=0.5, host_column=line_dedup.host_of("url"))
    assert kept.columns == pages.columns
    assert {r.page_id: r.html for r in kept.collect()} == {**{k: str(k) for k in range(12)}, 20: "", 21: ""}


def test_lines_of_awkward_documents(spark, monkeypatch):
    docs = documents(spark)
    for size in (line_dedup.BROADCAST_BYTES, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", size)
        kept = line_dedup.drop_boilerplate(docs)
        assert kept.columns == docs.columns and len(kept.collect()) == docs.count()
    assert line_dedup.line_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size, lines", [("0.001", 34), ("0.01", 152), ("0.1", 319)])
def test_the_ratio_decides_at_every_size(spark, size, lines):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    F = topk.F
    assert line_dedup.boilerplate(docs).agg(F.sum(F.size("hashes"))).head()[0] == lines
    counts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.explode(F.array_distinct(F.transform(F.split("text", "\n"), F.trim))).alias("line")).where("line <> ''").groupBy("host", "line").count()
    pages = docs.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    assert counts.join(pages, "host").where("count >= 2 and count > 0.01 * pages").count() == lines


@pytest.mark.parametrize("block", [8192, 3])
def test_top_k_against_brute_force(spark, block):
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)], 1) for k in range(150)] + [(200 + k, [0.5, -0.25, 0.0, 1.0, 2.0, -3.0], 1) for k in range(8)]
    rows += [(300, None, 1), (301, [1.0, None, 2.0, 1.0, 1.0, 1.0], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1), (304, [1.0, 2.0], 1), (310, [], 1), (None, [1.0] * 6, 1)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), topk.F.col("id") % 10 == 0, query_block=block).collect()
    whole = {k: [int(256 * x // 1) for x in v] for k, v, _ in rows if k is not None and v is not None and k not in (301, 302, 303)}
    expect = set()
    for q, a in whole.items():
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), k) for k, b in whole.items() if k != q)[:5]
            expect |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(scored)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == expect and len(found) == len(expect)


def test_top_k_of_few_and_none(spark):
    kind = "vec_id long, embedding array<double>"
    query = topk.F.col("id") % 50 == 0
    assert topk.top_k(spark.createDataFrame([], kind), query).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], kind), query).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], kind), query).collect()] == [(0, 1, 1, -65536)]
    assert [r.vec_id for r in topk.top_k(spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 5.0]), (2, [1e6, 6.0])], kind), query).collect()] == [2, 1]
