import numpy as np

from chromaloom.llm import toxicity as T
from tests.llm.cases import documents

STEMS = ("grob", "fies")


def toxic_rows(n, seed):
    """Texts of invented words; toxic ones hold words of two stems, with endings of any kind."""
    rng = np.random.default_rng(seed)
    syllables = "ba ke li mo nu ra se ti vo za".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for k in range(n):
        text, toxic = [word() for _ in range(rng.integers(5, 150))], bool(rng.random() < 0.3)
        for _ in range(1 + len(text) // 20 if toxic else 0):
            text[rng.integers(len(text))] = STEMS[rng.integers(2)] + word()
        rows.append((k, " ".join(text), "en"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_slopes_are_those_of_the_loss():
    n, rng = T.Network(), np.random.default_rng(0)
    n.dense = {k: v.astype(np.float64) + 0.1 for k, v in n.dense.items()}
    vectors, windows = rng.normal(size=(20, T.WORD_WIDTH + T.GRAM_WIDTH)), rng.integers(0, 20, (4, T.WINDOW))
    windows[0, 10:] = -1
    labels, weight = np.array([0, 1, 1, 0.0]), np.array([1, 2, 1, 0.5])

    def loss():
        gates = np.einsum("dwg,nw->dgn", n.dense["inputs"], vectors) + n.dense["bias"][:, :, None]
        odds = np.r_[n.score(gates, windows[:1].T), n.score(gates, windows[1:].T)]
        return (weight * np.logaddexp(0, np.where(labels > 0, -odds, odds))).sum() / weight.sum()

    found, to_vectors = n.slopes(vectors, windows, labels, weight)
    for table, slope in [*((n.dense[k], found[k]) for k in n.dense), (vectors, to_vectors)]:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in table.shape)
            before, step = table[at], 1e-3
            table[at] = before + step
            up = loss()
            table[at] = before - step
            down = loss()
            table[at] = before
            assert abs((up - down) / (2 * step) - slope[at]) < 2e-5


def test_windows_overlap_and_reach_the_end():
    for n in (1, 31, 32, 33, 48, 1000):
        starts = T.starts_of(n)
        assert starts[0] == 0 and (np.diff(starts) <= T.STRIDE).all()
        assert starts[-1] == max(0, n - T.WINDOW)


def test_scores_do_not_depend_on_company():
    rows, labels = toxic_rows(60, 4)
    texts = [r[1].encode() for r in rows] + [b"", b"one", " ".join(r[1] for r in rows).encode()]
    bags = [[r[1].encode().split()[s : s + T.WINDOW] for s in T.starts_of(len(r[1].split()))] for r in rows]
    network = T.Network().fit(bags, [m[2] for m in labels], epochs=2)
    together = T.Scorer(network).scores(texts)
    alone = [T.Scorer(network).scores([t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5) and together[60] == 0
    # the worst window decides
    assert abs(together[-1] - max(together[:60])) < 0.5 and together[-1] > 0


def test_held_out_texts(spark):
    rows, labels = toxic_rows(900, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    network = T.fit_network(docs.repartition(3), frame)
    other, truth = toxic_rows(300, 8)
    got = {r.doc_id: r.predicted for r in T.score_documents(spark.createDataFrame(other, "doc_id long, text string, lang string"), network).collect()}
    assert sum(got[k] == t for k, _, t in truth) >= 0.97 * len(truth)
    again = T.fit_network(docs.repartition(5), frame)
    assert all(np.array_equal(network.dense[k], again.dense[k]) for k in network.dense)


def test_awkward_documents(spark):
    docs = documents(spark)
    for labels in ([(0, 1, 0), (6, 1, 1), (7, 0, 1), (None, 0, 1), (1, 0, None)], [], [(0, 1, 1), (1, 0, 1), (2, 1, 1)]):
        network = T.fit_network(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        scored = T.score_documents(docs, network)
        assert scored.columns == [*docs.columns, "score", "predicted"]
        got = scored.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        if network.constant is None:
            assert all(r.score == 0 for r in got if not (r.text or "").strip())
    assert T.score_documents(docs.limit(0), network).count() == 0
