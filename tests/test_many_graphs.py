"""Sums over the paths of many graphs at once."""

import random

import numpy as np
import pytest

from chromaloom.operators import markov as K
from chromaloom.plans import graph_queries as G


def test_sums_over_orders_at_once_are_those_of_each(spark, tmp_path):
    rng = random.Random(6)
    items = [(order, line, rng.randrange(50), rng.randrange(9), float(rng.randrange(1, 50))) for order in range(40) for line in range(1, 1 + rng.randrange(1, 8))]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").repartition(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.dag: (r.total, r.most) for r in G.forward_backward(spark, str(tmp_path)).collect()}
    for order in range(40):
        n, edges = G._edges([{"l_partkey": p, "w": float(np.log(q))} for o, _, p, _, q in items if o == order])
        total, shares = K.posteriors(n, edges, 0, n - 1)
        assert found[order] == pytest.approx((total, float(np.exp(max(shares)))), abs=1e-12)
