"""Weighted acyclic graphs, hidden Markov models and Markov chains.

Sequences are cut into blocks of bounded length.  What a block does to the
states is a small matrix, and matrices multiply along a sequence, so blocks of
one long sequence are worked on at once; training sums counts over all blocks
each round, and only the model's own small tables come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.ordered import AT, PART, dealt, earlier, met, within, written

_MINUS = -np.inf
#: Observations of a block at most.
BLOCK = 1 << 16


def best_path(n_nodes: int, edges: list[tuple[int, int, float]], start: int, end: int) -> tuple[float, list[int]]:
    """The heaviest path from start to end over nodes in topological order; of equal ones that of the first parent."""
    score, parent = [_MINUS] * n_nodes, [-1] * n_nodes
    score[start] = 0.0
    into: list[list[tuple[int, float]]] = [[] for _ in range(n_nodes)]
    for u, v, w in edges:
        into[v].append((u, w))
    for node in range(n_nodes):
        for u, w in into[node]:
            if score[node] < score[u] + w:
                score[node], parent[node] = score[u] + w, u
    path = [end]
    while path[-1] != start and parent[path[-1]] >= 0:
        path.append(parent[path[-1]])
    return (score[end], path[::-1]) if path[-1] == start else (_MINUS, [])


def posteriors(n_nodes: int, edges: list[tuple[int, int, float]], start: int, end: int) -> tuple[float, list[float]]:
    """ln of the sum over all paths, and of each edge's share of it, by forward and backward sums."""
    total, shares = posteriors_of_many(n_nodes, [(u, v) for u, v, _ in edges], np.array([[w] for _, _, w in edges]).reshape(len(edges), 1), start, end)
    return float(total[0]), shares[:, 0].tolist()


def posteriors_of_many(n_nodes: int, edges: list[tuple[int, int]], weights: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`posteriors` of graphs with the same edges at once: ``weights`` and the shares have a row for each edge, a column for each graph."""
    forward, backward = np.full((2, n_nodes, weights.shape[1]), _MINUS)
    forward[start], backward[end] = 0.0, 0.0
    for k in sorted(range(len(edges)), key=lambda k: edges[k][1]):
        u, v = edges[k]
        forward[v] = np.logaddexp(forward[v], forward[u] + weights[k])
    for k in sorted(range(len(edges)), key=lambda k: -edges[k][0]):
        u, v = edges[k]
        backward[u] = np.logaddexp(backward[u], backward[v] + weights[k])
    total = forward[end]
    shares = [forward[u] + w + backward[v] - total for (u, v), w in zip(edges, weights, strict=True)]
    return total, np.array(shares).reshape(weights.shape)


@dataclass
class Model:
    """Probabilities of the first state, of the next state, and of symbols by state."""

    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray

    @classmethod
    def uniform(cls, states: int, symbols: int, switch: float, tilt: float = 0.0) -> Model:
        """All first states alike, a given chance of each switch, and emissions that lean on symbols by state."""
        transition = np.full((states, states), switch)
        np.fill_diagonal(transition, 1 - (states - 1) * switch)
        emission = np.ones((states, symbols))
        for s in range(states):
            emission[s, s % symbols] += tilt
        return cls(np.full(states, 1 / states), transition, emission / emission.sum(axis=1, keepdims=True)).checked()

    def checked(self) -> Model:
        for p in (self.initial, self.transition, self.emission):
            if (p < 0).any() or (np.abs(p.sum(axis=-1) - 1) > 1e-6).any():
                raise ValueError("probabilities must not be negative and must sum to one")
        return self

    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            return np.log(self.initial), np.log(self.transition), np.log(self.emission)


def most_likely(initial: np.ndarray, transition: np.ndarray, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """ln probability of the most likely states, and the states, the lowest of equal ones, from logarithms.

    ``scores`` has a row for each time: the ln likelihood of what is seen then in each state.
    """
    if not len(scores):
        return 0.0, np.zeros(0, dtype=int)
    score, back = initial + scores[0], []
    for seen in scores[1:]:
        options = score[:, None] + transition
        back.append(options.argmax(axis=0))
        score = options.max(axis=0) + seen
    path = [int(score.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return float(score.max()), np.array(path[::-1])


def viterbi(model: Model, symbols: np.ndarray) -> tuple[float, np.ndarray]:
    """:func:`most_likely` states of a sequence of symbols."""
    initial, transition, emission = model.logs()
    return most_likely(initial, transition, emission[:, np.asarray(symbols, dtype=int)].T)


def posterior_counts(initial: np.ndarray, transition: np.ndarray, likelihoods: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """ln likelihood, expected counts of first states and switches, and the states' posteriors by time, by scaled forward and backward sums.

    ``likelihoods`` has a row for each time; a common factor of a row only adds
    to the ln likelihood.  For a block inside a sequence ``before`` has the
    shares of the states at the time before it, and ``after`` how likely each
    last state makes all that follows, up to a factor.
    """
    n, states = len(likelihoods), len(initial)
    first, switches, gammas = np.zeros(states), np.zeros((states, states)), np.zeros((n, states))
    if not n:
        return 0.0, first, switches, gammas
    alpha, scale = np.zeros((n, states)), np.zeros(n)
    for t in range(n):
        alpha[t] = ((initial if before is None else before @ transition) if t == 0 else alpha[t - 1] @ transition) * likelihoods[t]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    beta = np.ones(states) if after is None else after / (alpha[-1] @ after)
    for t in range(n - 1, -1, -1):
        gammas[t] = alpha[t] * beta
        if t or before is not None:
            onward = likelihoods[t] * beta / scale[t]
            switches += (alpha[t - 1] if t else before)[:, None] * transition * onward[None, :]
            beta = transition @ onward
    return float(np.log(scale).sum()), gammas[0] if before is None else first, switches, gammas


def expected_counts(model: Model, symbols: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """ln likelihood and the expected counts of first states, switches and emissions."""
    symbols = np.asarray(symbols, dtype=int)
    ll, first, switches, gammas = posterior_counts(model.initial, model.transition, model.emission[:, symbols].T)
    emitted = np.zeros_like(model.emission)
    np.add.at(emitted.T, symbols, gammas)
    return ll, first, switches, emitted


def blocks(observations: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """``seq_id, block, alone, first, t, v``, written: sequences cut into blocks of ``BLOCK`` observations at most, in order.

    ``observations`` has ``seq_id, t`` and a value; ``t`` and ``v`` have a
    block's times and values, ``alone`` says that the sequence has just that
    one.  Blocks are rows, so what reads them again and again needs no shuffle.
    """
    placed = dealt(observations.select("seq_id", "t", value), ["seq_id", "t"], parts)
    number = F.call_function("shiftleft", F.col(PART).cast("long"), F.lit(33)) + F.floor(F.col(AT) / BLOCK)
    rows = placed.groupBy("seq_id", number.alias("block")).agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v")))).alias("x"))
    counts = rows.groupBy("seq_id").agg((F.count(F.lit(1)) == 1).alias("alone"), F.min("block").alias("first"))
    return written(rows.join(counts, "seq_id").select("seq_id", "block", "alone", (F.col("block") == F.col("first")).alias("first"), F.col("x.t").alias("t"), F.col("x.v").alias("v")), "blocks")


def _values(v) -> np.ndarray:
    """A block's values by time: symbols, or a row of scores each."""
    return np.array(v.tolist() if isinstance(v, np.ndarray) and v.dtype == object else v)


def _scored_by(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    """From symbols to their ln likelihoods by time and state."""
    emission = model.logs()[2].T
    return lambda symbols: emission[symbols]


def _finite(scores: np.ndarray) -> np.ndarray:
    scores = scores.astype(float).reshape(len(scores), -1)
    if np.isneginf(scores).any():
        raise ValueError("every state must be able to show every observation")
    return scores


def most_likely_through(initial: np.ndarray, transition: np.ndarray, scores: np.ndarray, first: bool) -> np.ndarray:
    """The best score through a block from each state before it to each last state; all rows alike for a sequence's first block."""
    best = np.tile(initial, (len(initial), 1)) + scores[0] if first else transition + scores[0]
    for seen in scores[1:]:
        best = (best[:, :, None] + transition[None]).max(axis=1) + seen
    return best


def likelihood_through(initial: np.ndarray, transition: np.ndarray, likelihoods: np.ndarray, first: bool) -> np.ndarray:
    """The likelihood of a block, up to a factor, from each state before it to each last state; all rows alike for a sequence's first block."""
    through = (np.tile(initial, (len(initial), 1)) if first else transition) * likelihoods[0]
    through = through / through.max()
    for seen in likelihoods[1:]:
        through = through @ transition * seen
        through /= through.max()
    return through


def most_likely_within(initial: np.ndarray, transition: np.ndarray, scores: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The best scores of the last states of a block, and the states come from at each time, the one before the block first."""
    options = initial[None] if before is None else before[:, None] + transition
    back, score = [options.argmax(axis=0)], options.max(axis=0) + scores[0]
    for seen in scores[1:]:
        options = score[:, None] + transition
        back.append(options.argmax(axis=0))
        score = options.max(axis=0) + seen
    return score, back


def _traced(back: list[np.ndarray], last: int) -> list[int]:
    """The states of a block from its last one back, and the state before it, in order."""
    path = [last]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


def _mapped(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of each row gives a frame."""

    def run(batches):
        for frame in batches:
            for row in frame.itertuples(index=False):
                yield function(row)

    return rows.mapInPandas(run, schema)


def _in_order(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of each sequence's rows of blocks, in order; there are as many as it has blocks."""
    return rows.groupBy("seq_id").applyInPandas(lambda frame: function(frame.sort_values("block")), schema)


def _decoded(held: DataFrame, model: Model, scores_of) -> DataFrame:
    """``seq_id, t, state``: the most likely states of the sequences of :func:`blocks`.

    Each block gives the best scores from every state to every other; these are
    multiplied along the sequence (maxima of sums), which gives every block the
    scores that come in.  The blocks then say which state before them leads to
    which last one, and from a sequence's best last state the last states of all
    blocks follow, and the states inside.
    """
    initial, transition, _ = model.logs()

    def whole(row) -> pd.DataFrame:
        return pd.DataFrame({"seq_id": row.seq_id, "t": row.t, "state": most_likely(initial, transition, scores_of(_values(row.v)))[1]})

    out = "seq_id long, t int, state int"
    alone = _mapped(held.where("alone").select("seq_id", "t", "v"), whole, out)
    cut = held.where("not alone").drop("alone")
    if cut.isEmpty():
        return alone

    def through(row) -> pd.DataFrame:
        return pd.DataFrame({"seq_id": [row.seq_id], "block": [row.block], "m": [most_likely_through(initial, transition, scores_of(_values(row.v)), row.first).ravel()]})

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        states, came, score = len(initial), [], np.zeros(len(initial))
        for m in rows["m"]:
            came.append(score)
            score = (score[:, None] + np.array(m).reshape(states, states)).max(axis=0) if len(came) > 1 else np.array(m)[:states]
        return pd.DataFrame({"seq_id": rows["seq_id"], "block": rows["block"], "before": came})

    def within_block(row) -> tuple[np.ndarray, list[np.ndarray]]:
        return most_likely_within(initial, transition, scores_of(_values(row.v)), None if row.first else np.array(row.before))

    def leading(row) -> pd.DataFrame:
        score, back = within_block(row)
        return pd.DataFrame({"seq_id": [row.seq_id], "block": [row.block], "best": [int(score.argmax())], "back": [[_traced(back, s)[0] for s in range(len(score))]]})

    def returning(rows: pd.DataFrame) -> pd.DataFrame:
        lasts = [int(rows["best"].iloc[-1])]
        for back in rows["back"].iloc[:0:-1]:
            lasts.append(int(back[lasts[-1]]))
        return pd.DataFrame({"seq_id": rows["seq_id"], "block": rows["block"], "last": lasts[::-1]})

    def states_of(row) -> pd.DataFrame:
        return pd.DataFrame({"seq_id": row.seq_id, "t": row.t, "state": _traced(within_block(row)[1], row.last)[1:]})

    keys = ["seq_id", "block"]
    summaries = _mapped(cut.select("seq_id", "block", "first", "t", "v"), through, "seq_id long, block long, m array<double>")
    coming = cut.join(_in_order(summaries, along, "seq_id long, block long, before array<double>"), keys)
    lasts = _in_order(_mapped(coming.select("seq_id", "block", "first", "t", "v", "before"), leading, "seq_id long, block long, best int, back array<int>"), returning, "seq_id long, block long, last int")
    return alone.unionByName(_mapped(coming.join(lasts, keys).select("seq_id", "block", "first", "t", "v", "before", "last"), states_of, out))


def _sums(held: DataFrame, model: Model, scores_of, emitted: int, hard: bool = False) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """ln likelihood and expected counts over all sequences of :func:`blocks`; a task gives one row of sums for each batch.

    Sequences of several blocks are gone through as in :func:`_decoded`, with
    sums of products; likelihoods come in from the front and from the back.
    """
    states = len(model.initial)
    initial, transition = model.initial, model.transition
    log_initial, log_transition, _ = model.logs()
    size = 1 + states + states * states + states * emitted

    def counted(values: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> np.ndarray:
        scores, seen = scores_of(values), np.zeros((states, emitted))
        if hard:
            ll, path = most_likely(log_initial, log_transition, scores)
            first, switches, gammas = np.zeros(states), np.zeros((states, states)), np.eye(states)[path]
            np.add.at(switches, (path[:-1], path[1:]), 1)
            first[path[:1]] += 1
        else:
            # the highest score of a time is taken out of the likelihoods, which keeps them from vanishing
            top = scores.max(axis=1, keepdims=True) if not emitted else np.zeros((len(scores), 1))
            ll, first, switches, gammas = posterior_counts(initial, transition, np.exp(scores - top), before, after)
        if emitted:
            np.add.at(seen.T, values, gammas)
        return np.concatenate([[ll], first, switches.ravel(), seen.ravel()])

    def run(batches):
        for frame in batches:
            total = np.zeros(size)
            for row in frame.itertuples(index=False):
                total += counted(_values(row.v), None if row.before is None else np.array(row.before), None if row.after is None else np.array(row.after))
            yield pd.DataFrame({"k": np.arange(size), "v": total})

    none = F.lit(None).cast("array<double>")
    ready = held.where("alone").select("v", none.alias("before"), none.alias("after"))
    cut = held.where("not alone")
    if not cut.isEmpty():

        def through(row) -> pd.DataFrame:
            scores = scores_of(_values(row.v))
            likelihoods = np.exp(scores - scores.max(axis=1, keepdims=True))
            return pd.DataFrame({"seq_id": [row.seq_id], "block": [row.block], "m": [likelihood_through(initial, transition, likelihoods, row.first).ravel()]})

        def both_ways(rows: pd.DataFrame) -> pd.DataFrame:
            through_all = [np.array(m).reshape(states, states) for m in rows["m"]]
            before, after = [None], [None]
            for m in through_all[:-1]:
                out = m[0] if before[-1] is None else before[-1] @ m
                before.append(out / out.sum())
            for m in through_all[:0:-1]:
                back = m @ (np.ones(states) if after[-1] is None else after[-1])
                after.append(back / back.sum())
            return pd.DataFrame({"seq_id": rows["seq_id"], "block": rows["block"], "before": before, "after": after[::-1]})

        summaries = _mapped(cut.select("seq_id", "block", "first", "t", "v"), through, "seq_id long, block long, m array<double>")
        joined = cut.join(_in_order(summaries, both_ways, "seq_id long, block long, before array<double>, after array<double>"), ["seq_id", "block"])
        ready = ready.unionByName(joined.select("v", "before", "after"))
    sums = ready.mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
    sums = sums if len(sums) else np.zeros(size)
    a, b = 1 + states, 1 + states + states * states
    return float(sums[0]), sums[1:a], sums[a:b].reshape(states, states), sums[b:].reshape(states, emitted)


def _hard_sums(held: DataFrame, model: Model, scores_of, emitted: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Counts along the most likely states; those of sequences of several blocks from their decoded states."""
    alone = held.where("alone")
    ll, first, switches, seen = _sums(alone, model, scores_of, emitted, hard=True)
    cut = held.where("not alone")
    if cut.isEmpty():
        return ll, first, switches, seen
    initial, transition, _ = model.logs()
    states = written(_decoded(cut, model, scores_of), "decoded")
    each = cut.select("seq_id", F.explode(F.arrays_zip("t", "v")).alias("o")).select("seq_id", F.col("o.t").alias("t"), F.col("o.v").alias("v"))
    placed = dealt(each.join(states, ["seq_id", "t"]), ["seq_id", "t"])
    ends = placed.groupBy(PART, "seq_id").agg(F.max_by("state", AT).alias("__last"))
    ends = ends.select(PART, "seq_id", F.max_by("__last", PART).over(earlier(["seq_id"])).alias("__before"))
    came = F.coalesce(F.lag("state").over(within(["seq_id"])), F.col("__before"))
    for row in met(placed, ends, ["seq_id"]).select(came.alias("a"), F.col("state").alias("b"), "v").groupBy("a", "b", "v").count().collect():  # states times states times symbols
        n, log = row["count"], scores_of(np.array([row.v]))[0][row.b]
        seen[row.b, row.v] += n
        if row.a is None:
            first[row.b] += n
            ll += n * (initial[row.b] + log)
        else:
            switches[row.a, row.b] += n
            ll += n * (transition[row.a, row.b] + log)
    return ll, first, switches, seen


def decode(observations: DataFrame, model: Model, parts: int | None = None) -> DataFrame:
    """``seq_id, t, state``: the most likely states of each sequence (``seq_id, t, sid``); a long one takes many tasks."""
    return _decoded(blocks(observations, "sid", parts), model, _scored_by(model))


def _normalised(counts: np.ndarray) -> np.ndarray:
    """Shares by row; a row without counts is even."""
    total = counts.sum(axis=-1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), 1 / counts.shape[-1])


def train(observations: DataFrame, model: Model, rounds: int = 10, hard: bool = False, parts: int | None = None) -> tuple[Model, list[float]]:
    """Baum-Welch (or, with ``hard``, Viterbi) training over all sequences; also the log2-likelihood before each round.

    The sequences are dealt and written once; a round reads them where they are.
    It ends early when a round changes nothing.
    """
    likelihoods, held = [], blocks(observations, "sid", parts)
    for _ in range(rounds):
        ll, first, switches, emitted = (_hard_sums if hard else _sums)(held, model, _scored_by(model), model.emission.shape[1])
        likelihoods.append(ll / np.log(2))
        after = Model(_normalised(first), _normalised(switches), _normalised(emitted))
        same = all((x == y).all() for x, y in ((after.initial, model.initial), (after.transition, model.transition), (after.emission, model.emission)))
        model = after
        if same:
            break
    return model, likelihoods


def generate(model: Model, length: int, seed: int | list[int] = 1) -> tuple[np.ndarray, np.ndarray]:
    """States and symbols of a random walk; a draw takes the first index up to which the probabilities sum to it."""
    rng = np.random.default_rng(seed)

    def draw(p: np.ndarray) -> int:
        return int(min(np.searchsorted(np.cumsum(p), rng.random()), len(p) - 1))

    states, symbols = [], []
    for t in range(length):
        states.append(draw(model.initial if t == 0 else model.transition[states[-1]]))
        symbols.append(draw(model.emission[states[-1]]))
    return np.array(states, dtype=int), np.array(symbols, dtype=int)


def walk(transition: np.ndarray, start: int, length: int, seed: int = 1) -> np.ndarray:
    """A Markov chain of states."""
    size = len(transition)
    first = np.zeros(size)
    first[start] = 1
    return generate(Model(first, transition, np.eye(size)), length, seed)[0]


def decode_continuous(observations: DataFrame, model: Model, parts: int | None = None) -> DataFrame:
    """``seq_id, t, state``: the most likely states where the data themselves are scored.

    ``observations`` has ``seq_id, t, logs``: the ln likelihood of what is seen in each state, all finite.
    The model's first states and switches count; its emissions do not.
    """
    return _decoded(blocks(observations, "logs", parts), model, _finite)


def train_continuous(observations: DataFrame, model: Model, rounds: int = 10, parts: int | None = None) -> tuple[Model, list[float]]:
    """Baum-Welch training of first states and switches over scored observations; also the log2-likelihood before each round.

    Scores are set against the highest of their time, so the likelihoods are up to a constant.
    """
    likelihoods, held = [], blocks(observations, "logs", parts)
    for _ in range(rounds):
        ll, first, switches, _ = _sums(held, model, _finite, 0)
        likelihoods.append(ll / np.log(2))
        after = Model(_normalised(first), _normalised(switches), model.emission)
        same = (after.initial == model.initial).all() and (after.transition == model.transition).all()
        model = after
        if same:
            break
    return model, likelihoods


def chains(sequences: DataFrame, model: Model, length: int, seed: int = 1) -> DataFrame:
    """``seq_id, t, state, sid``: a random walk of the model for each ``seq_id``, the same for the same seed."""

    def run(batches):
        for rows in batches:
            for seq_id in rows["seq_id"].tolist():
                states, symbols = generate(model, length, [seed, seq_id & 0xFFFFFFFF])
                yield pd.DataFrame({"seq_id": seq_id, "t": np.arange(length), "state": states, "sid": symbols})

    return sequences.select("seq_id").mapInPandas(run, "seq_id long, t int, state int, sid int")


def model_lines(model: Model) -> list[str]:
    """The model as text: a line for the first states, then one for each state's switches and emissions."""

    def shown(p: np.ndarray) -> str:
        return "\t".join(f"{x:.6g}" for x in p)

    return [f"INIT\t{shown(model.initial)}", *(f"TRANS\t{k}\t{shown(p)}" for k, p in enumerate(model.transition)), *(f"EMISS\t{k}\t{shown(p)}" for k, p in enumerate(model.emission))]
