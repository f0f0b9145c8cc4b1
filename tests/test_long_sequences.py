"""State models over sequences that are cut into blocks, against the kernels over whole sequences."""

import numpy as np
import pytest

from chromaloom.operators import markov as K

MODEL = K.Model(np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.15, 0.05], [0.1, 0.7, 0.2], [0.25, 0.05, 0.7]]), np.array([[0.7, 0.2, 0.05, 0.05], [0.1, 0.5, 0.3, 0.1], [0.05, 0.15, 0.3, 0.5]]))


@pytest.fixture
def cut(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 50)
    rng = np.random.default_rng(3)
    sequences = {k: K.generate(MODEL, n, int(rng.integers(1 << 30)))[1] for k, n in enumerate((1500, 1, 49, 50, 51, 700, 3))}
    rows = [(k, t, int(s)) for k, symbols in sequences.items() for t, s in enumerate(symbols)]
    return sequences, spark.createDataFrame(rows, "seq_id long, t int, sid int").repartition(5)


def test_a_long_sequence_takes_many_blocks(cut):
    _, frame = cut
    held = K.blocks(frame, "sid", 6)
    sizes = held.where("seq_id = 0").selectExpr("size(t) as n").collect()
    assert len(sizes) >= 30 and max(r.n for r in sizes) <= 50
    assert held.where("alone").select("seq_id").distinct().count() >= 2


def test_decoding_equals_the_kernel(cut):
    sequences, frame = cut
    got = {(r.seq_id, r.t): r.state for r in K.decode(frame, MODEL, 6).collect()}
    assert len(got) == sum(map(len, sequences.values()))
    for k, symbols in sequences.items():
        assert [got[k, t] for t in range(len(symbols))] == K.viterbi(MODEL, symbols)[1].tolist()


@pytest.mark.parametrize("hard", [False, True])
def test_training_equals_the_kernel(cut, hard):
    sequences, frame = cut
    start = K.Model.uniform(3, 4, 0.2, 0.5)
    trained, likelihoods = K.train(frame, start, 1, hard, 6)
    ll, first, switches, emitted = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for symbols in sequences.values():
        if hard:
            own, path = K.viterbi(start, symbols)
            a, b, c = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
            a[path[0]] += 1
            np.add.at(b, (path[:-1], path[1:]), 1)
            np.add.at(c, (path, symbols), 1)
        else:
            own, a, b, c = K.expected_counts(start, symbols)
        ll, first, switches, emitted = ll + own, first + a, switches + b, emitted + c
    assert likelihoods[0] == pytest.approx(ll / np.log(2), rel=1e-9)
    for found, want in ((trained.initial, first), (trained.transition, switches), (trained.emission, emitted)):
        assert np.allclose(found, want / want.sum(axis=-1, keepdims=True), atol=1e-9)


def test_scored_observations_equal_the_kernel(spark, cut):
    sequences, frame = cut
    places = np.array([0.0, 1.5, 3.0])
    scored = frame.selectExpr("seq_id", "t", "transform(array(0d, 1.5d, 3d), p -> -power(sid - p, 2) / 2) as logs")
    got = {(r.seq_id, r.t): r.state for r in K.decode_continuous(scored, MODEL, 6).collect()}
    trained, likelihoods = K.train_continuous(scored, MODEL, 1, 6)
    ll, first, switches = 0.0, np.zeros(3), np.zeros((3, 3))
    initial, transition, _ = MODEL.logs()
    for k, symbols in sequences.items():
        scores = -((symbols[:, None] - places) ** 2) / 2
        assert [got[k, t] for t in range(len(symbols))] == K.most_likely(initial, transition, scores)[1].tolist()
        own, a, b, _ = K.posterior_counts(MODEL.initial, MODEL.transition, np.exp(scores - scores.max(axis=1, keepdims=True)))
        ll, first, switches = ll + own, first + a, switches + b
    assert likelihoods[0] == pytest.approx(ll / np.log(2), rel=1e-9)
    assert np.allclose(trained.transition, switches / switches.sum(axis=1, keepdims=True)) and np.allclose(trained.initial, first / first.sum())
