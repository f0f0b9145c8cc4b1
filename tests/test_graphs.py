import itertools
import math
import random

import numpy as np
import pytest

from chromaloom.operators import agglomeration as A
from chromaloom.operators import markov as K
from chromaloom.operators import trees as T


def slow_clusters(contigs, links, wanted):
    """Merging with all scores computed anew each time."""
    groups = [{c} for c in contigs]
    merges = 0
    while True:
        best = None
        for x, y in itertools.combinations(groups, 2):
            z = sum(links.get((min(i, j), max(i, j)), 0) for i in x for j in y) / len(x) / len(y)
            if z > 0 and (best is None or z > best[0]):
                best = (z, x, y)
        if best is None:
            return groups
        groups = [g for g in groups if g is not best[1] and g is not best[2]] + [best[1] | best[2]]
        merges += 1
        if merges > len(contigs) // 2 and sum(len(g) > 1 for g in groups) == wanted:
            return groups


@pytest.mark.parametrize("seed", range(6))
def test_agglomeration_against_brute_force(seed):
    rng = random.Random(seed)
    contigs = list(range(18))
    half = {(i, j): rng.random() + 5 * (i % 3 == j % 3) for i, j in itertools.combinations(contigs, 2) if rng.random() < 0.7}
    both = half | {(j, i): z for (i, j), z in half.items()}
    found = A.agglomerate(contigs, both, 3)
    assert {frozenset(g) for g in found} == {frozenset(g) for g in slow_clusters(contigs, half, 3)}


def test_anchors_never_meet():
    links = {(i, j): 1.0 + (i + j) / 100 for i in range(8) for j in range(8) if i != j}
    found = A.agglomerate(list(range(8)), links, 1, anchors=frozenset({0, 7}))
    assert not any({0, 7} <= g for g in found)


def random_group(rng, size, keep=0.5):
    pairs = {(i, j): (rng.randint(1, 30), [-rng.random() * 9 for _ in range(4)]) for i, j in itertools.combinations(range(size), 2) if rng.random() < keep}
    return T.Group([rng.randint(5, 40) for _ in range(size)], pairs)


@pytest.mark.parametrize("seed", range(5))
def test_forest_weighs_least(seed):
    rng = random.Random(seed)
    edges = {(i, j): rng.random() for i, j in itertools.combinations(range(7), 2) if rng.random() < 0.6}
    tree = T.minimum_forest(7, edges)
    mine = {(a, b) for a in range(7) for b in tree[a] if a < b}
    root = list(range(7))

    def find(k):
        return k if root[k] == k else find(root[k])

    least = set()
    for (a, b), _ in sorted(edges.items(), key=lambda e: e[1]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            least.add((a, b))
    assert mine == least


@pytest.mark.parametrize("seed", range(5))
def test_longest_path_against_all_pairs(seed):
    rng = random.Random(seed)
    size = 12
    tree = [[] for _ in range(size)]
    for k in range(1, size):
        p = rng.randrange(k)
        tree[k].append(p)
        tree[p].append(k)
    far = max(len(T._farthest(tree, n)) for n in range(size))
    path = T.longest_path(tree)
    assert len(path) == far and path[0] <= path[-1]
    assert all(b in tree[a] for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("seed", range(5))
def test_orientation_against_all_choices(seed):
    rng = random.Random(seed)
    group = random_group(rng, 8, 0.9)
    order = rng.sample(range(8), 6)

    def score(turned):
        return sum(group.log_likelihood(a, x, b, y) for a, b, x, y in zip(order, order[1:], turned, turned[1:], strict=False))

    turned, quality = T.orient(group, order)
    assert score(turned) == pytest.approx(max(score(t) for t in itertools.product((False, True), repeat=6)))
    assert min(quality) >= -1e-9


@pytest.mark.parametrize("seed", range(5))
def test_full_orders_have_each_contig_once(seed):
    group = random_group(random.Random(seed), 25, 0.3)
    tree = T.smooth_thorns(group, T.spanning_tree(group, 15))
    trunk = T.longest_path(tree)
    full = T.reinsert(group, [list(n) for n in tree], 0)
    assert len(set(full)) == len(full) and set(trunk) <= set(full)
    assert {n for n in range(25) if group.near[n]} <= set(full)


def all_paths(n, edges, start, end):
    into = {}
    for k, (u, v, w) in enumerate(edges):
        into.setdefault(u, []).append((v, w, k))

    def go(node):
        if node == end:
            yield 0.0, [end], []
        for v, w, k in into.get(node, []):
            for total, path, used in go(v):
                yield total + w, [node, *path], [k, *used]

    return list(go(start))


@pytest.mark.parametrize("seed", range(5))
def test_graph_paths_against_enumeration(seed):
    rng = random.Random(seed)
    edges = [(u, v, rng.uniform(-3, 1)) for u in range(8) for v in range(u + 1, 8) if rng.random() < 0.6] + [(0, 7, -5.0)]
    paths = all_paths(8, edges, 0, 7)
    score, path = K.best_path(8, edges, 0, 7)
    assert score == pytest.approx(max(p[0] for p in paths)) and path in [p[1] for p in paths]
    total, shares = K.posteriors(8, edges, 0, 7)
    whole = sum(math.exp(p[0]) for p in paths)
    assert total == pytest.approx(math.log(whole))
    for k in range(len(edges)):
        share = sum(math.exp(p[0]) for p in paths if k in p[2]) / whole
        assert math.exp(shares[k]) == pytest.approx(share, abs=1e-9)


def test_hidden_states_against_enumeration():
    rng = np.random.default_rng(3)
    p = lambda *s: rng.dirichlet(np.ones(s[-1]), s[:-1]) if len(s) > 1 else rng.dirichlet(np.ones(s[0]))
    model = K.Model(p(3), p(3, 3), p(3, 4))
    symbols = np.array([0, 3, 1, 2, 2])

    def joint(states):
        value = model.initial[states[0]] * model.emission[states[0], symbols[0]]
        for a, b, s in zip(states, states[1:], symbols[1:], strict=False):
            value *= model.transition[a, b] * model.emission[b, s]
        return value

    every = list(itertools.product(range(3), repeat=5))
    ll, path = K.viterbi(model, symbols)
    assert ll == pytest.approx(math.log(max(map(joint, every)))) and joint(path) == pytest.approx(max(map(joint, every)))
    total, first, switches, emitted = K.expected_counts(model, symbols)
    whole = sum(map(joint, every))
    assert total == pytest.approx(math.log(whole))
    for s in range(3):
        assert first[s] == pytest.approx(sum(joint(e) for e in every if e[0] == s) / whole)
    assert switches[0, 1] == pytest.approx(sum(joint(e) * sum(a == 0 and b == 1 for a, b in zip(e, e[1:], strict=False)) for e in every) / whole)
    assert emitted.sum() == pytest.approx(5) and switches.sum() == pytest.approx(4)


def test_training_raises_the_likelihood(spark):
    rng = np.random.default_rng(5)
    truth = K.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]]))
    rows = [(k, t, int(s)) for k in range(8) for t, s in enumerate(K.generate(truth, 60, int(rng.integers(1 << 30)))[1])]
    observations = spark.createDataFrame(rows, "seq_id long, t int, sid int").cache()
    model, likelihoods = K.train(observations, K.Model.uniform(2, 3, 0.3, 0.5), 6)
    assert all(b >= a - 1e-9 for a, b in zip(likelihoods, likelihoods[1:], strict=False)) and likelihoods[-1] > likelihoods[0]
    hard, _ = K.train(observations, K.Model.uniform(2, 3, 0.3, 0.5), 3, hard=True)
    assert hard.checked() is hard
    assert len(K.walk(np.array([[0.0, 1.0], [1.0, 0.0]]), 0, 4)) == 4 and K.walk(np.array([[0.0, 1.0], [1.0, 0.0]]), 0, 4).tolist() == [0, 1, 0, 1]


@pytest.mark.parametrize("edit, most", [(T.randomly_inverted, 2 * 3), (T.randomly_perturbed, 3 * 3)])
def test_random_edits_keep_the_contigs(spark, edit, most):
    rows = [(c, p, 100 * c + p, p % 3 == 0) for c, n in ((0, 40), (1, 2), (2, 1)) for p in range(n)]
    ordering = spark.createDataFrame(rows, "cluster_id int, pos int, tid int, rc boolean")
    got = sorted(tuple(r) for r in edit(ordering, 3).collect())
    assert got == sorted(tuple(r) for r in edit(ordering, 3).collect()) and got != sorted(rows)
    assert [r[:2] for r in got] == [r[:2] for r in sorted(rows)] and {r[2] for r in got} == {r[2] for r in rows}
    # neighbours stay neighbours but at the ends of what was edited
    order = [(t, r) for c, _, t, r in got if c == 0]
    old = [(t, r) for c, _, t, r in sorted(rows) if c == 0]
    near = lambda x: {frozenset([(a, ar), (b, not br)]) for (a, ar), (b, br) in zip(x, x[1:])}
    assert len(near(old) - near(order)) <= most
    assert [r for r in got if r[0] == 2] == [r for r in rows if r[0] == 2]


def test_continuous_states_against_brute_force(spark):
    rng = np.random.default_rng(4)
    model = K.Model(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.full((2, 3), 1 / 3))
    scores = {k: rng.normal(size=(n, 2)) for k, n in ((0, 6), (1, 1), (2, 4))}
    rows = spark.createDataFrame([(k, t, [float(v) for v in x]) for k, held in scores.items() for t, x in enumerate(held)], "seq_id long, t int, logs array<double>")
    found = {}
    for r in K.decode_continuous(rows, model).orderBy("seq_id", "t").collect():
        found.setdefault(r.seq_id, []).append(r.state)
    first, switches, ll = np.zeros(2), np.zeros((2, 2)), 0.0
    for k, held in scores.items():
        weight = {}
        for path in itertools.product(range(2), repeat=len(held)):
            steps = [model.initial[path[0]], *(model.transition[a, b] for a, b in zip(path, path[1:]))]
            weight[path] = math.prod(steps) * math.exp(sum(held[t, s] - held[t].max() for t, s in enumerate(path)))
        assert tuple(found[k]) == max(weight, key=weight.get)
        total = sum(weight.values())
        ll += math.log2(total)
        for path, w in weight.items():
            first[path[0]] += w / total
            for a, b in zip(path, path[1:]):
                switches[a, b] += w / total
    trained, likelihoods = K.train_continuous(rows, model, 1)
    assert likelihoods == pytest.approx([ll])
    assert np.allclose(trained.initial, first / first.sum()) and np.allclose(trained.transition, switches / switches.sum(axis=1, keepdims=True))
    with pytest.raises(Exception, match="every state"):
        K.decode_continuous(rows.selectExpr("seq_id", "t", "array(0d, double('-inf')) as logs"), model).collect()


def test_chains_follow_the_model(spark):
    model = K.Model(np.array([0.0, 1.0]), np.array([[0.9, 0.1], [0.5, 0.5]]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    rows = K.chains(spark.range(300).selectExpr("id as seq_id"), model, 40).collect()
    assert len(rows) == 300 * 40 and all(r.state == r.sid for r in rows) and all(r.state == 1 for r in rows if r.t == 0)
    by = {(r.seq_id, r.t): r.state for r in rows}
    after = [by[k, t + 1] for (k, t), s in by.items() if s == 0 and t < 39]
    assert sum(after) / len(after) == pytest.approx(0.1, abs=0.02)
    assert K.model_lines(model)[1] == "TRANS\t0\t0.9\t0.1"

