"""Queries over clustering, ordering and state models, which SQL cannot express; tests compare them with brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from chromaloom.functions.ordered import written
from chromaloom.operators import agglomeration as A
from chromaloom.operators import links as L
from chromaloom.operators import markov as K
from chromaloom.operators import sequences_of_states as Q
from chromaloom.operators import trees as T
from chromaloom.plans.adapters import view
from chromaloom.plans.link_queries import half_norm, norm
from chromaloom.plans.ordering_queries import cells

SYMBOLS = 5


def _informative(s, d):
    contigs = L.skip_few_sites(view(s, d, "contigs"), 10)
    return contigs.where("not skip").select("tid")


def ah_clusters(s, d):
    """Average-linkage clusters of the contigs with enough sites, links corrected for repeats."""
    # read for the sums, their mean and the links: written once
    n = L.mirrored(written(half_norm(s, d).withColumnsRenamed({"i": "a", "j": "b"}), "links"))
    corrected = L.density_corrected(n, L.repeat_factor(n, view(s, d, "contigs")))
    return A.cluster_contigs(corrected, _informative(s, d), 24)


def move_contigs(s, d):
    return A.move_contigs(norm(s, d), view(s, d, "clusters"), view(s, d, "contigs"), 1.2)


def _three(s, d):
    return cells(s, d), view(s, d, "clusters"), view(s, d, "contigs")


def _model() -> K.Model:
    return K.Model.uniform(3, SYMBOLS, 0.1, 0.5)


def hmm_viterbi(s, d):
    return K.decode(Q.encode(view(s, d, "observations")), _model())


def _trained(hard: bool):
    def query(s, d):
        model, _ = K.train(Q.encode(view(s, d, "observations")), _model(), 3, hard)
        rows = [("initial", 0, k, float(p)) for k, p in enumerate(model.initial)]
        rows += [(name, i, j, float(t[i, j])) for name, t in (("transition", model.transition), ("emission", model.emission)) for i in range(t.shape[0]) for j in range(t.shape[1])]
        return s.createDataFrame(rows, "kind string, i int, j int, p double")

    return query


def _scored(s, d):
    """Observations with how likely each of three states shows them: the nearer its own place, the likelier."""
    rows = Q.encode(view(s, d, "observations"))
    return rows.select("seq_id", "t", F.array(*(-F.pow(F.col("sid") - place, F.lit(2)) / 2 for place in (0.0, 2.0, 4.0))).alias("logs"))


def hmm_continuous_training(s, d):
    model, _ = K.train_continuous(_scored(s, d), _model(), 3)
    rows = [("initial", 0, k, float(p)) for k, p in enumerate(model.initial)]
    rows += [("transition", i, j, float(model.transition[i, j])) for i in range(3) for j in range(3)]
    return s.createDataFrame(rows, "kind string, i int, j int, p double")


def _dags(s, d):
    """A small layered graph per order: line items in order are layers, prices their weights."""
    rows = s.read.parquet(f"{d}/lineitem.parquet")
    return rows.groupBy(F.col("l_orderkey").alias("dag")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.log("l_quantity").alias("w")))).alias("x"))


def _edges(items) -> tuple[int, list[tuple[int, int, float]]]:
    """Two nodes a layer between a start and an end."""
    edges, n = [], len(items)
    for k, item in enumerate(items):
        for a in (0, 1):
            for source in (0,) if k == 0 else (2 * k - 1, 2 * k):
                edges.append((source, 2 * k + 1 + a, float(item["w"]) * (1 if (item["l_partkey"] + source + a) % 2 else 0.5)))
    edges += [(source, 2 * n + 1, 0.0) for source in ((2 * n - 1, 2 * n) if n else (0,))]
    return 2 * n + 2, edges


def best_path(s, d):
    """``dag, score, path``: the heaviest path through each order's graph."""

    def run(batches):
        for rows in batches:
            out = []
            for dag, items in zip(rows["dag"], rows["x"], strict=True):
                n, edges = _edges(items)
                score, path = K.best_path(n, edges, 0, n - 1)
                out.append((dag, score, ",".join(map(str, path))))
            yield pd.DataFrame(out, columns=["dag", "score", "path"])

    return _dags(s, d).mapInPandas(run, "dag long, score double, path string")


def forward_backward(s, d):
    """``dag, total, most``: ln of the sum over paths, and the share of the likeliest edge.

    Orders of as many items have the same edges, so those of a batch are summed together.
    """

    def run(batches):
        for batch in batches:
            held = batch.column(1)
            size, first = held.value_lengths().to_numpy(zero_copy_only=False), held.offsets.to_numpy()[:-1] - held.offsets[0].as_py()
            items = held.flatten()
            part, weight = (items.field(k).to_numpy(zero_copy_only=False) for k in ("l_partkey", "w"))
            total, most = np.empty(len(size)), np.empty(len(size))
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                at = first[rows]
                edges, weights = [], []
                for k in range(n):
                    for a in (0, 1):
                        for source in (0,) if k == 0 else (2 * k - 1, 2 * k):
                            edges.append((source, 2 * k + 1 + a))
                            weights.append(weight[at + k] * np.where((part[at + k] + source + a) % 2 != 0, 1.0, 0.5))
                for source in (2 * n - 1, 2 * n) if n else (0,):
                    edges.append((source, 2 * n + 1))
                    weights.append(np.zeros(len(rows)))
                total[rows], shares = K.posteriors_of_many(2 * n + 2, edges, np.array(weights), 0, 2 * n + 1)
                most[rows] = np.exp(shares.max(axis=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(most)], ["dag", "total", "most"])

    return _dags(s, d).select(F.col("dag").cast("long"), "x").mapInArrow(run, "dag long, total double, most double")


REGISTRY = {
    "ah_clusters": (ah_clusters, None),
    "move_contigs": (move_contigs, None),
    "spanning_tree": (lambda s, d: T.group_trees(*_three(s, d)), None),
    "smooth_thorns": (lambda s, d: T.group_trees(*_three(s, d), smoothed=True), None),
    "longest_path": (lambda s, d: T.longest_paths(T.group_trees(*_three(s, d))), None),
    "group_orderings": (lambda s, d: T.group_orderings(*_three(s, d)), None),
    "trunk": (lambda s, d: T.group_orderings(*_three(s, d)).where("kind = 'trunk'"), None),
    "full_order": (lambda s, d: T.group_orderings(*_three(s, d)).where("kind = 'full'"), None),
    "orient_viterbi": (lambda s, d: T.orient_ordering(cells(s, d), view(s, d, "ordering"), view(s, d, "clusters")), None),
    "orient_q": (lambda s, d: T.orient_ordering(cells(s, d), view(s, d, "ordering"), view(s, d, "clusters")).select("cluster_id", "pos", "local_id", "q"), None),
    "invert_random": (lambda s, d: T.randomly_inverted(view(s, d, "ordering"), 3), None),
    "perturb_random": (lambda s, d: T.randomly_perturbed(view(s, d, "ordering"), 5), None),
    "randomize": (lambda s, d: T.shuffled(view(s, d, "ordering")), None),
    "hmm_viterbi": (hmm_viterbi, None),
    "hmm_baum_welch": (_trained(False), None),
    "hmm_viterbi_training": (_trained(True), None),
    "hmm_continuous": (lambda s, d: K.decode_continuous(_scored(s, d), _model()), None),
    "hmm_continuous_training": (hmm_continuous_training, None),
    "markov_chain": (lambda s, d: K.chains(view(s, d, "observations").select("seq_id").distinct(), _model(), 20), None),
    "best_path": (best_path, None),
    "forward_backward": (forward_backward, None),
}
