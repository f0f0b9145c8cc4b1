import math
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from chromaloom.llm import importance as I
from tests.llm.cases import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(0x41, 0x5B)}))


def runs(text, longest):
    w = words(text)
    return [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute(rows, target, buckets, longest, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets, dtype=int), np.zeros(buckets, dtype=int)
    for side, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in runs(text, longest):
                side[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + buckets) / ((int(s[b]) + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        fs = runs(text, longest)
        h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    order = sorted((k for k in range(len(out)) if out[k][4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    drawn = {k: n + 1 for n, k in enumerate(order[: len(order) * percent // 100])}
    return sorted((repr((*r[:4], drawn.get(k))) for k, r in enumerate(out)))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_awkward_documents_equal_brute_force(spark, longest):
    docs = documents(spark)
    target = [("quick brown jumps over lorem ipsum", 1), (None, 2), ("", 3)]
    frame = I.resample(docs, spark.createDataFrame(target, "text string, doc_id int"), buckets=50, longest=longest, least_words=3, percent=40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert frame.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in frame.collect()) == brute(rows, [t[0] for t in target], 50, longest, 3, 40, 2024)


def test_empty_tables(spark):
    docs = documents(spark)
    nothing = spark.createDataFrame([], "item_id int, text string")
    assert I.resample(docs.limit(0), nothing).count() == 0
    assert I.resample(docs, nothing).count() == docs.count()


def test_tries_that_start_again_count_the_same():
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % k for k in rng.zipf(1.3, n) % 300) for n in rng.integers(0, 80, 60)]
    whole, parts, totals = I.WordTrie(97, 3), I.WordTrie(97, 3), np.zeros(97, dtype=np.int64)
    for k in range(0, len(texts), 7):
        for _, w, text in I._groups(texts[k : k + 7]):
            whole.add(w, text)
            parts.add(w, text)
        totals += parts.totals()
        parts.clear()
    brute_totals = np.zeros(97, dtype=np.int64)
    for text in texts:
        for f in runs(text.decode(), 3):
            brute_totals[zlib.crc32(f.encode()) % 97] += 1
    assert (whole.totals() == brute_totals).all() and (totals == brute_totals).all()


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 as a").repartition(9)
    from pyspark.sql import functions as F

    got = sorted((r["rank"], -r.a, r.id) for r in I.ranked(rows, [F.desc("a"), F.asc("id")]).collect())
    assert [g[0] for g in got] == list(range(1, 5001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
