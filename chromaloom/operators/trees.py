"""Ordering and orienting the members of one group: spanning trees, trunks, shreds, orientations.

These run per group in ``applyInPandas``: the links of a group have been summed
by Spark to a row per pair of contigs, so a task holds the sparse pairs of one
group and nothing else.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.operators.links import local_ids

Tree = list[list[int]]
ROUNDS, MOST_PENALTY = 100, 10
THORN_RATIO = 3.0


class Group:
    """Contigs of a group, their site counts, and sparse links with oriented log-likelihoods."""

    def __init__(self, sites: list[int], pairs: dict[tuple[int, int], tuple[int, list[float]]]):
        self.sites, self.size = sites, len(sites)
        self.pairs = pairs
        self.most = max(sites, default=1)
        self.near: list[list[int]] = [[] for _ in sites]
        for a, b in pairs:
            self.near[a].append(b)
            self.near[b].append(a)

    def density(self, a: int, b: int) -> float:
        """Links times the whole-number ratios of the largest site count to each contig's."""
        found = self.pairs.get((min(a, b), max(a, b)))
        return float(found[0] * (self.most // self.sites[a]) * (self.most // self.sites[b])) if found else 0.0

    def log_likelihood(self, a: int, a_rc: bool, b: int, b_rc: bool) -> float:
        """Of a before b in these orientations; b before a is the same read from the other strand."""
        if a > b:
            a, a_rc, b, b_rc = b, not b_rc, a, not a_rc
        found = self.pairs.get((a, b))
        return found[1][2 * a_rc + b_rc] if found else 0.0


def minimum_forest(size: int, edges: dict[tuple[int, int], float]) -> Tree:
    """Prim from vertex 0, then from each vertex not reached; edges that are not listed do not exist."""
    tree: Tree = [[] for _ in range(size)]
    near: list[list[tuple[float, int]]] = [[] for _ in range(size)]
    for (a, b), weight in edges.items():
        near[a].append((weight, b))
        near[b].append((weight, a))
    reached = [False] * size
    for root in range(size):
        if reached[root]:
            continue
        reached[root] = True
        waiting = [(w, root, v) for w, v in near[root]]
        heapq.heapify(waiting)
        while waiting:
            _, u, v = heapq.heappop(waiting)
            if reached[v]:
                continue
            reached[v] = True
            tree[u].append(v)
            tree[v].append(u)
            for w, x in near[v]:
                if not reached[x]:
                    heapq.heappush(waiting, (w, v, x))
    return tree


def _farthest(tree: Tree, start: int) -> list[int]:
    """The path from a node to the first found of those most steps away."""
    before, best, steps = {start: -1}, start, {start: 0}
    queue = deque([start])
    while queue:
        node = queue.popleft()
        for other in tree[node]:
            if other not in before:
                before[other], steps[other] = node, steps[node] + 1
                if steps[other] > steps[best]:
                    best = other
                queue.append(other)
    path = [best]
    while before[path[-1]] >= 0:
        path.append(before[path[-1]])
    return path[::-1]


def longest_path(tree: Tree, first: int = 0) -> list[int]:
    """The longest path of the first tree that has an edge, from its end with the lower number; empty without one. Nodes before ``first`` have none."""
    start = next((n for n in range(first, len(tree)) if tree[n]), None)
    if start is None:
        return []
    path = _farthest(tree, _farthest(tree, start)[-1])
    return path if path[0] <= path[-1] else path[::-1]


def spanning_tree(group: Group, min_sites: int) -> Tree:
    """The tree whose longest path is longest over rounds in which the last path is opened for contigs beside it."""
    if group.size == 2:
        return [[1], [0]]
    least = min_sites
    while least > 0 and sum(s >= least for s in group.sites) < 3:
        least -= 1
    best: Tree = [[] for _ in group.sites]
    trunk: list[int] = []
    longest, penalty = 0, 1
    for _ in range(ROUNDS):
        place = {contig: k for k, contig in enumerate(trunk)}
        edges = {}
        for a, b in group.pairs:
            if group.sites[a] < least or group.sites[b] < least or not (density := group.density(a, b)):
                continue
            weight = 1.0 / density
            if a in place and b in place:
                if abs(place[a] - place[b]) != 1:
                    continue
                weight *= penalty
            edges[a, b] = weight
        if not edges:
            return best
        tree = minimum_forest(group.size, edges)
        trunk = longest_path(tree)
        if len(trunk) > longest:
            longest, best = len(trunk), [list(near) for near in tree]
        else:
            penalty += 1
            if penalty >= MOST_PENALTY:
                break
    return best


def smooth_thorns(group: Group, tree: Tree) -> Tree:
    """Leaves beside the path moved into it where the links allow; the tree is changed and returned."""
    for leaf in range(group.size):
        if len(tree[leaf]) != 1:
            continue
        fork = tree[leaf][0]
        if len(tree[fork]) != 3:
            continue
        one, two = (n for n in tree[fork] if n != leaf)
        if len(tree[one]) == 1 or len(tree[two]) == 1:
            continue
        gain_one = group.density(leaf, one) - group.density(fork, one)
        gain_two = group.density(leaf, two) - group.density(fork, two)
        if gain_one >= 0 or gain_two >= 0:
            chosen = one if gain_one > gain_two else two
        else:
            ratio = gain_one / gain_two
            chosen = one if ratio < 1 / THORN_RATIO else two if ratio > THORN_RATIO else None
        if chosen is not None:
            tree[fork].remove(chosen)
            tree[chosen].remove(fork)
            tree[leaf].append(chosen)
            tree[chosen].append(leaf)
    return tree


def shreds_of(group: Group, tree: Tree) -> tuple[list[int], list[list[int]]]:
    """The trunk, and the paths left when longest paths are peeled off, then single contigs that have links."""
    left = [list(near) for near in tree]
    whole = longest_path(tree)
    path, gone, shreds, first = whole, set(), [], 0
    while path:
        gone.update(path)
        for node in path:
            for other in left[node]:
                if other not in gone:
                    left[other].remove(node)
            left[node] = []
        # nodes never get edges back, so none before the last first one is looked at again
        while first < group.size and not left[first]:
            first += 1
        path = longest_path(left, first)
        if path:
            shreds.append(path)
    shreds += [[n] for n in range(group.size) if n not in gone and (group.near[n] or group.size == 1)]
    return whole, shreds


def reinsert(group: Group, tree: Tree, min_sites: int) -> list[int]:
    """The trunk with each shred of enough sites put where it gains most links; at the end if nowhere does."""
    if group.size == 1:
        return [0]
    trunk, shreds = shreds_of(group, tree)
    order = _Line(trunk)
    for shred in shreds:
        if sum(group.sites[n] for n in shred) <= min_sites:
            continue
        # only beside a contig with links to an end of the shred is anything gained
        beside = {n for end in (shred[0], shred[-1]) for n in group.near[end] if n in order.mark}
        places = {p for n in beside for p in ((order.before[n], n), (n, order.after[n]))}
        best, place, turned = 0.0, (order.last, None), False
        for before, after in sorted(places, key=lambda p: -1.0 if p[0] is None else order.mark[p[0]]):
            for rc in (False, True) if len(shred) > 1 else (False,):
                x, y = (after, before) if rc else (before, after)
                gain = (group.density(x, shred[0]) if x is not None else 0.0) + (group.density(y, shred[-1]) if y is not None else 0.0)
                if x is not None and y is not None:
                    gain -= group.density(x, y)
                if gain > best:
                    best, place, turned = gain, (before, after), rc
        order.insert(shred[::-1] if turned else shred, *place)
    return list(order)


class _Line:
    """Contigs in order, each with those beside it and a mark that rises along the order."""

    def __init__(self, contigs: list[int]):
        self.before: dict[int, int | None] = {}
        self.after: dict[int, int | None] = {}
        self.mark: dict[int, float] = {}
        self.first: int | None = None
        self.last: int | None = None
        self.insert(contigs, None, None)

    def __iter__(self):
        at = self.first
        while at is not None:
            yield at
            at = self.after[at]

    def insert(self, contigs: list[int], before: int | None, after: int | None) -> None:
        """Put contigs between two neighbours; None stands for what is beyond an end."""
        low = 0.0 if before is None else self.mark[before]
        step = 1.0 if after is None else (self.mark[after] - low) / (len(contigs) + 1)
        last = before
        for k, contig in enumerate(contigs, 1):
            self.before[contig], self.mark[contig] = last, low + k * step
            if last is None:
                self.first = contig
            else:
                self.after[last] = contig
            last = contig
        if last is not None:
            self.after[last] = after
        if after is None:
            self.last = last
        else:
            self.before[after] = last
        if step < 1e-9 * (1.0 + low):  # marks come too close to be told apart: new ones
            self.mark = {contig: k + 1.0 for k, contig in enumerate(self)}


def orient(group: Group, order: list[int]) -> tuple[list[bool], list[float]]:
    """Most likely orientations by dynamic programming, and how much each is better than turning that contig alone; ties stay forward."""
    if not order:
        return [], []
    score, back = [0.0, 0.0], []
    for a, b in zip(order, order[1:], strict=False):
        now, came = [], []
        for rc in (False, True):
            options = [score[p] + group.log_likelihood(a, bool(p), b, rc) for p in (0, 1)]
            came.append(0 if options[0] >= options[1] else 1)
            now.append(max(options))
        score = now
        back.append(came)
    last = 0 if score[0] >= score[1] else 1
    turned = [bool(last)]
    for came in reversed(back):
        last = came[last]
        turned.append(bool(last))
    turned.reverse()
    quality = []
    for k, contig in enumerate(order):
        gain = 0.0
        for rc, sign in ((turned[k], 1), (not turned[k], -1)):
            if k:
                gain += sign * group.log_likelihood(order[k - 1], turned[k - 1], contig, rc)
            if k + 1 < len(order):
                gain += sign * group.log_likelihood(contig, rc, order[k + 1], turned[k + 1])
        quality.append(gain)
    return turned, quality


def pair_table(cells: DataFrame) -> DataFrame:
    """``cluster_id, c1, c2, n, ff, fr, rf, rr``: links of each pair and their log-likelihoods by orientation."""
    half = cells.where("c1 < c2")
    ll = -F.log(F.col("dist").cast("double"))
    sums = [F.sum(F.when((F.col("rc1") == a) & (F.col("rc2") == b), ll)).alias(name) for name, a, b in (("ff", False, False), ("fr", False, True), ("rf", True, False), ("rr", True, True))]
    summed = half.groupBy("cluster_id", "c1", "c2").agg(F.count_if(~F.col("rc1") & ~F.col("rc2")).alias("n"), *sums)
    # a fresh column, as the groups it meets may stem from the same table
    return summed.withColumn("cluster_id", F.col("cluster_id").cast("int").alias("cluster_id"))


def _cogrouped(contigs: DataFrame, pairs: DataFrame):
    """Both by cluster, dealt to a set number of tasks: groups are few bytes and much work, so small partitions must not be put together."""
    parts = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = (rows.repartition(parts, "cluster_id").groupBy("cluster_id") for rows in (contigs, pairs))
    return one.cogroup(two)


def _group(contigs: pd.DataFrame, pairs: pd.DataFrame) -> Group:
    sites = contigs.sort_values("local_id")["re"].astype(int).tolist()
    held = {(int(r.c1), int(r.c2)): (int(r.n), [r.ff, r.fr, r.rf, r.rr]) for r in pairs.sort_values(["c1", "c2"]).itertuples(index=False)}
    return Group(sites, held)


_SCHEMA = "cluster_id int, kind string, pos int, local_id int, rc boolean, q double"


def group_orderings(cells: DataFrame, clusters: DataFrame, contigs: DataFrame, min_sites: int = 15, full_min_sites: int | None = None) -> DataFrame:
    """``cluster_id, kind, pos, local_id, rc, q``: the trunk and the full order of each group, oriented.

    A group without links has no rows.
    """
    members = local_ids(clusters).join(contigs.select("tid", "re"), "tid").select(F.col("cluster_id").cast("int").alias("cluster_id"), "local_id", "re")
    shred_sites = min_sites if full_min_sites is None else full_min_sites

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            group = _group(left, right)
            tree = smooth_thorns(group, spanning_tree(group, min_sites)) if group.size > 1 else [[]]
            found = {"trunk": longest_path(tree) if group.size > 1 else [0], "full": reinsert(group, [list(n) for n in tree], shred_sites)}
            for kind, order in found.items():
                turned, quality = orient(group, order)
                rows += [(int(left["cluster_id"].iloc[0]), kind, k, n, rc, q) for k, (n, rc, q) in enumerate(zip(order, turned, quality, strict=True))]
        return pd.DataFrame(rows, columns=["cluster_id", "kind", "pos", "local_id", "rc", "q"])

    return _cogrouped(members, pair_table(cells)).applyInPandas(run, _SCHEMA)


def group_trees(cells: DataFrame, clusters: DataFrame, contigs: DataFrame, min_sites: int = 15, smoothed: bool = False) -> DataFrame:
    """``cluster_id, a, b``: edges of each group's spanning tree, with thorns smoothed if asked."""
    members = local_ids(clusters).join(contigs.select("tid", "re"), "tid").select(F.col("cluster_id").cast("int").alias("cluster_id"), "local_id", "re")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) > 1:
            group = _group(left, right)
            tree = spanning_tree(group, min_sites)
            tree = smooth_thorns(group, tree) if smoothed else tree
            rows = [(int(left["cluster_id"].iloc[0]), a, b) for a in range(group.size) for b in tree[a] if a < b]
        return pd.DataFrame(rows, columns=["cluster_id", "a", "b"])

    return _cogrouped(members, pair_table(cells)).applyInPandas(run, "cluster_id int, a int, b int")


def longest_paths(edges: DataFrame) -> DataFrame:
    """``cluster_id, pos, node``: the longest path of each group's tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree: Tree = [[] for _ in range(int(max(rows["a"].max(), rows["b"].max())) + 1)]
        for a, b in sorted(zip(rows["a"].astype(int), rows["b"].astype(int), strict=True)):
            tree[a].append(b)
            tree[b].append(a)
        path = longest_path(tree)
        return pd.DataFrame({"cluster_id": rows["cluster_id"].iloc[0], "pos": range(len(path)), "node": path})

    return edges.groupBy("cluster_id").applyInPandas(run, "cluster_id int, pos int, node int")


def orient_ordering(cells: DataFrame, ordering: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster_id, pos, local_id, rc, q``: an ordering's contigs oriented afresh."""
    order = ordering.join(local_ids(clusters), ["cluster_id", "tid"]).select("cluster_id", "pos", "local_id")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        placed = left.sort_values("pos")
        contigs = placed["local_id"].astype(int).tolist()
        size = int(max([*contigs, *right["c1"], *right["c2"]], default=-1)) + 1
        group = Group([1] * size, {(int(r.c1), int(r.c2)): (int(r.n), [r.ff, r.fr, r.rf, r.rr]) for r in right.itertuples(index=False)})
        turned, quality = orient(group, contigs)
        return pd.DataFrame({"cluster_id": placed["cluster_id"].astype("int32"), "pos": placed["pos"], "local_id": contigs, "rc": turned, "q": quality})

    return _cogrouped(order, pair_table(cells)).applyInPandas(run, "cluster_id int, pos int, local_id int, rc boolean, q double")


def shuffled(ordering: DataFrame, seed: int = 1) -> DataFrame:
    """Each ordering in a random order with random orientations, the same for the same seed."""
    key = F.xxhash64("cluster_id", "tid", F.lit(seed))
    pos = (F.row_number().over(Window.partitionBy("cluster_id").orderBy(key, "tid")) - 1).cast("int")
    return ordering.select("cluster_id", "tid", pos.alias("pos"), (F.pmod(F.xxhash64(key), F.lit(2)) == 0).alias("rc"))


def _invert(order: list[tuple[int, bool]], start: int, stop: int) -> None:
    """Turn round the stretch from ``start`` to ``stop``, both included."""
    order[start : stop + 1] = [(tid, not rc) for tid, rc in reversed(order[start : stop + 1])]


def _edited(ordering: DataFrame, seed: int, edit) -> DataFrame:
    """Each ordering after ``edit(order, rng)``, the same for the same seed; an order of one contig stays."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        cluster = int(rows["cluster_id"].iloc[0])
        order = list(zip(rows["tid"].astype(int).tolist(), rows["rc"].astype(bool).tolist(), strict=True))
        if len(order) > 1:
            edit(order, np.random.default_rng([seed, cluster & 0xFFFFFFFF]))
        return pd.DataFrame({"cluster_id": cluster, "pos": range(len(order)), "tid": [t for t, _ in order], "rc": [r for _, r in order]})

    return ordering.select("cluster_id", "pos", "tid", "rc").groupBy("cluster_id").applyInPandas(run, "cluster_id int, pos int, tid int, rc boolean")


def randomly_inverted(ordering: DataFrame, n: int = 1, seed: int = 1) -> DataFrame:
    """``n`` times a stretch of two contigs or more, drawn evenly, is turned round in each ordering."""

    def edit(order: list, rng: np.random.Generator) -> None:
        for _ in range(n):
            start, stop = sorted(rng.choice(len(order), 2, replace=False).tolist())
            _invert(order, start, stop)

    return _edited(ordering, seed, edit)


def randomly_perturbed(ordering: DataFrame, n: int = 1, seed: int = 1) -> DataFrame:
    """``n`` times a stretch is turned round, or a contig is moved along it either way, short stretches being likelier."""

    def edit(order: list, rng: np.random.Generator) -> None:
        size = len(order)
        for _ in range(n):
            reach = int(size - np.sqrt(1 + rng.integers(0, size * size - 1)))
            start = int(rng.integers(0, size - reach))
            stop = start + reach
            if rng.integers(0, 2):
                _invert(order, start, stop)
            else:
                source, target = (start, stop) if rng.integers(0, 2) else (stop, start)
                order.insert(target, order.pop(source))

    return _edited(ordering, seed, edit)
