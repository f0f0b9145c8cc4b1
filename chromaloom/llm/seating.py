"""Pitman-Yor restaurants: seating by Gibbs sampling.

A row is a dish of a restaurant with its customers and its number of tables.
Given the other rows, a row's number of tables ``t`` has the weight

    S(c, t) * base ** t * (strength + discount * others) * ... one factor a table

with the generalised Stirling numbers ``S``.  A sweep draws the rows one after
another (of a restaurant with more than ``TURNS`` open rows, every ``TURNS``-th
together), each given the tables that all others have just then.  Rows of one
customer have one table and are never open.  Discount and strength are drawn
from their conditionals over a grid.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Customers up to which the Stirling numbers are tabulated; beyond, they come from a saddle point, put right by what
#: it lacks at ``REFERENCE`` customers (a function of t / c ** discount; the means of drawn tables stay within 1 %).
EXACT, REFERENCE = 64, 1024
#: Rows of a restaurant that are drawn one after another.
TURNS = 16
#: Wider ranges of tables are drawn from the normal distribution round the mode.
WIDE = 128
#: Numbers of tables round the present one among which a row of many customers is drawn in a sweep.
WINDOW = 24
DISCOUNTS = np.arange(1, 20) / 20
STRENGTHS = np.geomspace(0.05, 200, 16)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive numbers, to about ten digits."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    small = x < 8
    y = np.where(small, x + 8, x)
    for k in range(8):
        shift += np.where(small, np.log(np.where(small, x + k, 1.0)), 0.0)
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


@lru_cache(maxsize=64)
def small_stirling(discount: float) -> np.ndarray:
    """ln S(c, t) for c and t up to ``EXACT``; row and column 0 are unused."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    tables = np.arange(EXACT + 1)
    for c in range(EXACT):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * tables, 0.0))
        out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c, :-1]])
    return out


def saddle_stirling(discount: float, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """ln S(c, t) by the saddle point of its generating function; exact at t = 1 and t = c, too low where t is far below c ** discount."""
    c, t = np.broadcast_arrays(np.asarray(customers, dtype=np.float64), np.asarray(tables, dtype=np.float64))
    # S(c, t) = c! / (t! d^t) [x^c] (1 - (1 - x)^d)^t; with u = 1 - x the saddle solves c u (1 - u^d) = t d u^d (1 - u)
    level = np.log(c / (t * discount))
    log_u = np.minimum(-level / (1 - discount), -1e-3)
    low, high = np.full(c.shape, -np.inf), np.full(c.shape, -1e-12)
    for _ in range(14):  # Newton's steps, halved where they leave the bracket
        full, part = -np.expm1(log_u), -np.expm1(discount * log_u)
        value = level + (1 - discount) * log_u + np.log(part) - np.log(full)
        low, high = np.where(value < 0, log_u, low), np.where(value < 0, high, log_u)
        slope = 1 - discount - discount * (1 - part) / part + (1 - full) / full
        after = log_u - value / np.maximum(slope, 1e-12)
        outside = (after <= low) | (after >= high)
        log_u = np.where(outside, np.where(np.isfinite(low), (low + high) / 2, 2 * log_u), after)
    x, power = -np.expm1(log_u), np.exp(discount * log_u)
    u, hold = np.exp(log_u), -np.expm1(discount * log_u)
    # second derivative of t ln(1 - u^d) - c ln x in ln x
    first = t * discount * power / u / hold
    second = -t * discount * power / u**2 * ((1 - discount) / hold * -1 + discount * power / hold**2)
    curve = x * first + x * x * second
    value = t * np.log(hold) - c * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(curve, 1e-300))
    value += log_gamma(c + 1) - log_gamma(t + 1) - t * np.log(discount)
    single = log_gamma(c - discount) - log_gamma(np.full(c.shape, 1 - discount))
    return np.where(t >= c, 0.0, np.where(t == 1, single, value))


@lru_cache(maxsize=64)
def _correction(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """What the saddle point lacks, by ln(t / c ** discount), as found at ``REFERENCE`` customers."""
    now, tables = np.full(REFERENCE + 1, -np.inf), np.arange(REFERENCE + 1)
    now[0] = 0.0
    for c in range(REFERENCE):
        with np.errstate(divide="ignore"):
            stay = now + np.log(np.maximum(c - discount * tables, 0.0))
        now = np.logaddexp(stay, np.r_[-np.inf, now[:-1]])
    t = np.unique(np.geomspace(2, REFERENCE - 1, 200).astype(np.int64))
    lacks = now[t] - saddle_stirling(discount, np.full(len(t), REFERENCE), t)
    place = np.log(t) - discount * np.log(REFERENCE)
    # towards fewer tables it goes on as a straight line
    slope = (lacks[1] - lacks[0]) / (place[1] - place[0])
    return np.r_[place[0] - 40, place], np.r_[lacks[0] - 40 * slope, lacks]


def log_stirling(discount: float, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """ln S(c, t), from the table where c is small."""
    customers, tables = np.broadcast_arrays(customers, tables)
    out = np.empty(customers.shape)
    small = customers <= EXACT
    out[small] = small_stirling(discount)[customers[small], tables[small]]
    c, t = customers[~small], tables[~small]
    lacks = np.interp(np.log(t) - discount * np.log(c), *_correction(discount))
    out[~small] = saddle_stirling(discount, c, t) + np.where((t > 1) & (t < c), lacks, 0.0)
    return out


def _log_weight(c: np.ndarray, t: np.ndarray, log_base: np.ndarray, others: np.ndarray, discount: float, strength: float) -> np.ndarray:
    ratio = strength / discount + others
    opened = t * np.log(discount) + log_gamma(ratio + t) - log_gamma(ratio)
    return log_stirling(discount, c, t) + t * log_base + opened


def draw_tables(customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator, now: np.ndarray | None = None) -> np.ndarray:
    """Tables of rows with these customers, base probabilities and tables of the rest of their restaurant.

    Two customers are one draw; up to ``EXACT`` every number of tables is
    weighed.  Beyond, with ``now`` (the present tables), one of ``WINDOW``
    numbers round that is drawn, the window lying anywhere over it with equal
    chance, which leaves the conditional as it is.  Without ``now`` the mode is
    searched, and every number round it is weighed if there are at most
    ``WIDE``; otherwise the normal distribution with the curvature of the mode
    is drawn, whose error is of the order of one over its standard deviation
    (more than ``WIDE / 16``).
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    others = np.asarray(others, dtype=np.float64)
    pairs = np.flatnonzero(customers == 2)
    if len(pairs):
        odds = base[pairs] * (strength + discount * (others[pairs] + 1)) / (1 - discount)
        tables[pairs] += rng.random(len(pairs)) * (1 + odds) < odds
    least = 3
    while least <= EXACT:
        width = min(2 * least - 2, EXACT)
        held = np.flatnonzero((customers >= least) & (customers <= width))
        for part in np.array_split(held, 1 + len(held) * width // (1 << 20)) if len(held) else ():
            steps = np.log(base[part, None] * (strength + discount * (others[part, None] + np.arange(width)[None, :])))
            weight = small_stirling(discount)[customers[part], 1 : width + 1] + steps.cumsum(axis=1)
            tables[part] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
        least = width + 1
    many = np.flatnonzero(customers > EXACT)
    for part in np.array_split(many, 1 + len(many) // 2048) if len(many) else ():
        given = customers[part], np.log(base[part]), others[part], discount, strength, rng
        tables[part] = _draw_many(*given) if now is None else _draw_near(now[part], *given)
    return tables


def _draw_near(now: np.ndarray, c: np.ndarray, log_base: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    tried = (now - rng.integers(0, WINDOW, len(now)))[:, None] + np.arange(WINDOW)[None, :]
    inside = (tried >= 1) & (tried <= c[:, None])
    kept = np.clip(tried, 1, c[:, None])
    weight = _log_weight(np.broadcast_to(c[:, None], kept.shape), kept, log_base[:, None], others[:, None], discount, strength)
    weight = np.where(inside, weight, -np.inf)
    return kept[np.arange(len(now)), np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)]


def modes(c: np.ndarray, log_base: np.ndarray, others: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """The likeliest number of tables; the weights are log-concave in it, so it is found by halving on their differences."""
    low, high = np.ones(len(c), dtype=np.int64), c.copy()
    while (low < high).any():
        middle = (low + high) // 2
        rises = _log_weight(c, np.minimum(middle + 1, c), log_base, others, discount, strength) > _log_weight(c, middle, log_base, others, discount, strength)
        low, high = np.where(rises & (low < high), middle + 1, low), np.where(rises, high, middle)
        low = np.minimum(low, high)
    return low


def _draw_many(c: np.ndarray, log_base: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    mode = modes(c, log_base, others, discount, strength)
    step = np.maximum(1, mode // 50)
    down, up = np.maximum(mode - step, 1), np.minimum(mode + step, c)
    at = _log_weight(c, mode, log_base, others, discount, strength)
    fall = np.maximum(at - _log_weight(c, up, log_base, others, discount, strength), at - _log_weight(c, down, log_base, others, discount, strength))
    reach = np.maximum(up - mode, mode - down)
    spread = reach / np.sqrt(2 * np.maximum(fall, 1e-9))
    out = np.clip(np.rint(mode + spread * rng.normal(size=len(c))), 1, c).astype(np.int64)
    narrow = np.flatnonzero(16 * spread + 8 < WIDE)
    if len(narrow):
        half = WIDE // 2
        first = np.maximum(mode[narrow] - half, 1)
        tried = first[:, None] + np.arange(WIDE)[None, :]
        inside = tried <= c[narrow, None]
        kept = np.minimum(tried, c[narrow, None])
        weight = _log_weight(np.broadcast_to(c[narrow, None], kept.shape), kept, log_base[narrow, None], others[narrow, None], discount, strength)
        weight = np.where(inside, weight, -np.inf)
        out[narrow] = first + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
    return out


@dataclass
class Restaurants:
    """Rows ``context, customers, base`` of many restaurants, contexts ascending.

    ``total`` are a context's customers.  ``share`` says which part of a
    context's dishes the rows are: its tables are taken to be as many in each.
    ``fixed`` are tables of contexts that are given (nan where they are not);
    ``stands`` tells for how many alike rows each row stands.
    """

    context: np.ndarray
    customers: np.ndarray
    base: np.ndarray
    share: np.ndarray
    total: np.ndarray
    discount: float = 0.5
    strength: float = 1.0
    fixed: np.ndarray | None = None
    stands: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.tables = np.minimum(self.customers, 1).astype(np.int64)
        self.weight = np.ones(len(self.customers)) if self.stands is None else self.stands
        self.swept = self.drawn = False
        self.free = np.ones(len(self.total), dtype=bool) if self.fixed is None else np.isnan(self.fixed)
        self.open_rows = open_rows = np.flatnonzero(self.customers > 1)
        _, place = np.unique(self.context[open_rows], return_index=True)
        turn = (np.arange(len(open_rows)) - np.repeat(place, np.diff(np.r_[place, len(open_rows)]))) % TURNS if len(open_rows) else open_rows
        turn = np.where(self.customers[open_rows] > EXACT, turn // 4, turn)  # these are costly, so more of them go together
        order = np.argsort(turn, kind="stable")
        self.turns = np.split(open_rows[order], np.flatnonzero(np.diff(turn[order])) + 1) if len(open_rows) else []

    def context_tables(self, tables: np.ndarray | None = None) -> np.ndarray:
        """Tables of each context, those of its other parts included."""
        seated = np.bincount(self.context, (self.tables if tables is None else tables) * self.weight, len(self.total)) / self.share
        return seated if self.fixed is None else np.where(self.free, seated, self.fixed)

    def sweep(self, rng: np.random.Generator) -> None:
        """One round of Gibbs sampling over the open rows."""
        seated = self.context_tables()
        if not self.swept and len(many := self.open_rows[self.customers[self.open_rows] > EXACT]):
            # rows of many customers start at their mode
            at = self.context[many]
            for part in np.array_split(np.arange(len(many)), 1 + len(many) // 4096):
                rows = many[part]
                self.tables[rows] = modes(self.customers[rows], np.log(self.base[rows]), np.maximum(seated[at[part]] - 1, 0.0), self.discount, self.strength)
            seated = self.context_tables()
        for rows in self.turns:
            at, old = self.context[rows], self.tables[rows]
            others = np.maximum(seated[at] - old, 0.0)
            new = draw_tables(self.customers[rows], self.base[rows], others, self.discount, self.strength, rng, old)
            np.add.at(seated, at, np.where(self.free[at], (new - old) * self.weight[rows] / self.share[at], 0.0))
            self.tables[rows] = new
        self.swept = True

    def draw_parameters(self, rng: np.random.Generator) -> None:
        """Griddy Gibbs: strength and discount from their conditionals; all contexts share them."""
        seated = np.rint(self.context_tables()).astype(np.int64)
        rows, row_n = _counted(self.customers[self.open_rows], self.tables[self.open_rows], self.weight[self.open_rows])  # a single customer weighs nothing
        used = self.total > 0
        places, place_n = _counted(np.rint(self.total[used]).astype(np.int64), np.maximum(seated[used], 1), np.ones(used.sum()))
        c, t = places[:, 0].astype(float), places[:, 1].astype(float)

        def likelihood(discount: float, strength: float) -> float:
            ratio = strength / discount
            opened = (t - 1) * np.log(discount) + log_gamma(ratio + t) - log_gamma(np.array(ratio + 1.0))
            return float(place_n @ (opened - log_gamma(strength + c) + log_gamma(np.array(strength + 1.0))))

        if not len(t):
            return
        # at first the whole grid, then a step or two at a time
        near = np.abs(np.log(STRENGTHS / self.strength)) < (1.2 if self.drawn else np.inf)
        weight = np.array([likelihood(self.discount, s) for s in STRENGTHS[near]])
        self.strength, self.drawn = float(STRENGTHS[near][np.argmax(weight + rng.gumbel(size=len(weight)))]), True
        tried = DISCOUNTS[np.abs(DISCOUNTS - self.discount) < 0.06]  # a step of the grid at a time
        weight = np.array([likelihood(d, self.strength) + float(row_n @ log_stirling(float(d), rows[:, 0], rows[:, 1])) for d in tried])
        self.discount = float(tried[np.argmax(weight + rng.gumbel(size=len(weight)))])

    def averaged(self, burn_in: int, samples: int, rng: np.random.Generator, learn: bool = True) -> tuple[np.ndarray, float, float]:
        """Mean tables of every row, and the mean discount and strength, over samples after a burn-in.

        With ``learn`` discount and strength are sampled too, from a start that counts of one and two customers give.
        """
        if learn:
            once, twice = (float(self.weight[self.customers == k].sum()) for k in (1, 2))
            if once:
                self.discount = float(DISCOUNTS[np.argmin(np.abs(DISCOUNTS - once / (once + 2 * twice)))])
        tables, discount, strength = np.zeros(len(self.customers)), 0.0, 0.0
        for k in range(burn_in + samples):
            self.sweep(rng)
            if learn:
                self.draw_parameters(rng)
            if k >= burn_in:
                tables += self.tables
                discount += self.discount
                strength += self.strength
        return tables / samples, discount / samples, strength / samples


def _counted(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of two columns of counts, and the weight of each."""
    width = int(second.max(initial=0)) + 1
    code, number = np.unique(first.astype(np.int64) * width + second, return_inverse=True)
    return np.c_[code // width, code % width], np.bincount(number, weight, len(code))
