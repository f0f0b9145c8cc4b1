"""The graph and model queries against their kernels, fed with rows that are collected and grouped in plain Python."""

import math
from collections import defaultdict

import numpy as np
import pytest

from chromaloom.operators import agglomeration as A
from chromaloom.operators import links as L
from chromaloom.operators import markov as K
from chromaloom.operators import sequences_of_states as Q
from chromaloom.operators import trees as T
from chromaloom.plans import graph_queries as G
from chromaloom.plans.adapters import view
from chromaloom.plans.link_queries import norm
from chromaloom.plans.ordering_queries import cells

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def groups(spark):
    """Each cluster's sites by local number, its links by pair, and its ordering."""
    members, re = defaultdict(list), {r.tid: r.re for r in view(spark, DATA, "contigs").collect()}
    for r in view(spark, DATA, "clusters").collect():
        members[r.cluster_id].append(r.tid)
    local = {c: {tid: k for k, tid in enumerate(sorted(held))} for c, held in members.items()}
    pairs = defaultdict(lambda: defaultdict(lambda: [0, [None] * 4]))
    for r in cells(spark, DATA).collect():
        if r.c1 < r.c2:
            held, at = pairs[r.cluster_id][r.c1, r.c2], 2 * r.rc1 + r.rc2
            held[0] += at == 0
            held[1][at] = (held[1][at] or 0.0) - math.log(r.dist)
    ordering = defaultdict(list)
    for r in view(spark, DATA, "ordering").orderBy("cluster_id", "pos").collect():
        ordering[r.cluster_id].append(local[r.cluster_id][r.tid])
    made = {c: T.Group([re[tid] for tid in sorted(members[c])], {k: (v[0], v[1]) for k, v in sorted(pairs[c].items())}) for c in members}
    return made, ordering


def test_trees_and_paths(spark, groups):
    for name, smoothed in (("spanning_tree", False), ("smooth_thorns", True)):
        got = defaultdict(set)
        for r in G.REGISTRY[name][0](spark, DATA).collect():
            got[r.cluster_id].add((r.a, r.b))
        paths = defaultdict(list)
        for r in T.longest_paths(G.REGISTRY[name][0](spark, DATA)).orderBy("cluster_id", "pos").collect():
            paths[r.cluster_id].append(r.node)
        for cluster, group in groups[0].items():
            if group.size > 1:
                tree = T.spanning_tree(group, 15)
                tree = T.smooth_thorns(group, tree) if smoothed else tree
                edges = {(a, b) for a in range(group.size) for b in tree[a] if a < b}
                assert got[cluster] == edges
                if edges:
                    ordered = [[] for _ in range(max(max(e) for e in edges) + 1)]
                    for a, b in sorted(edges):
                        ordered[a].append(b)
                        ordered[b].append(a)
                    assert paths[cluster] == T.longest_path(ordered)


def test_orders_and_orientations(spark, groups):
    got = defaultdict(list)
    for r in G.REGISTRY["group_orderings"][0](spark, DATA).orderBy("cluster_id", "kind", "pos").collect():
        got[r.cluster_id, r.kind].append((r.local_id, r.rc, r.q))
    placed = defaultdict(list)
    for r in G.REGISTRY["orient_viterbi"][0](spark, DATA).orderBy("cluster_id", "pos").collect():
        placed[r.cluster_id].append((r.local_id, r.rc, r.q))
    for cluster, group in groups[0].items():
        if group.size > 1:
            tree = T.smooth_thorns(group, T.spanning_tree(group, 15))
            for kind, order in (("trunk", T.longest_path(tree)), ("full", T.reinsert(group, [list(n) for n in tree], 15))):
                turned, quality = T.orient(group, order)
                assert [x[:2] for x in got[cluster, kind]] == list(zip(order, turned, strict=True))
                assert [x[2] for x in got[cluster, kind]] == pytest.approx(quality)
        order = groups[1].get(cluster, [])
        turned, quality = T.orient(group, order) if order else ([], [])
        assert [x[:2] for x in placed[cluster]] == list(zip(order, turned, strict=True))
        assert [x[2] for x in placed[cluster]] == pytest.approx(quality)


def test_clusters(spark):
    links = L.density_corrected(norm(spark, DATA), L.repeat_factor(norm(spark, DATA), view(spark, DATA, "contigs"))).collect()
    informative = sorted(r.tid for r in L.skip_few_sites(view(spark, DATA, "contigs"), 10).where("not skip").collect())
    chosen = set(informative)
    held = {(r.i, r.j): float(r.z) for r in links if r.z > 0 and r.i in chosen and r.j in chosen}
    expect = {(tid, k) for k, group in enumerate(A.by_median(A.agglomerate(informative, held, 24))) for tid in group}
    assert {(r.tid, r.cluster_id) for r in G.REGISTRY["ah_clusters"][0](spark, DATA).collect()} == expect


def test_state_models(spark):
    sequences = defaultdict(list)
    for r in Q.encode(view(spark, DATA, "observations")).orderBy("seq_id", "t").collect():
        sequences[r.seq_id].append((r.t, r.sid))
    model = G._model()
    got = {(r.seq_id, r.t): r.state for r in G.REGISTRY["hmm_viterbi"][0](spark, DATA).collect()}
    for seq_id, held in sequences.items():
        states = K.viterbi(model, np.array([s for _, s in held]))[1]
        assert [got[seq_id, t] for t, _ in held] == states.tolist()
    for _ in range(3):
        first, switches, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros_like(model.emission)
        for held in sequences.values():
            _, a, b, c = K.expected_counts(model, np.array([s for _, s in held]))
            first, switches, emitted = first + a, switches + b, emitted + c
        model = K.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (first, switches, emitted)))
    found = {(r.kind, r.i, r.j): r.p for r in G.REGISTRY["hmm_baum_welch"][0](spark, DATA).collect()}
    for name, table in (("transition", model.transition), ("emission", model.emission)):
        for (i, j), p in np.ndenumerate(table):
            assert found[name, i, j] == pytest.approx(p, abs=1e-9)


def test_random_order_is_a_permutation(spark):
    ordering = view(spark, DATA, "ordering")
    old = defaultdict(list)
    for r in ordering.orderBy("cluster_id", "pos").collect():
        old[r.cluster_id].append(r.tid)
    new, turned = defaultdict(list), 0
    for r in T.shuffled(ordering).orderBy("cluster_id", "pos").collect():
        new[r.cluster_id].append(r.tid)
        turned += r.rc
    assert {c: sorted(x) for c, x in new.items()} == {c: sorted(x) for c, x in old.items()} and new != old
    assert 0.3 < turned / sum(map(len, old.values())) < 0.7
