"""The exact sum of whole parts of products, from residues, against all pairs."""

import numpy as np
import pytest

from chromaloom.functions.numbers import sum_of_product_residues
from chromaloom.operators import clusters as C


@pytest.mark.parametrize("bits, n, most", [(3, 8, 5), (6, 60, 10**6), (10, 900, 70_000), (20, 1500, 10**9), (20, 1500, 3)])
def test_residues_by_convolution_equal_all_pairs(bits, n, most):
    rng = np.random.default_rng(bits + n)
    residues = rng.choice(1 << bits, min(n, 1 << bits), replace=False)
    counts = rng.integers(1, most, len(residues))
    want = sum(int(a) * int(b) % (1 << bits) * int(x) * int(y) for a, x in zip(residues, counts, strict=True) for b, y in zip(residues, counts, strict=True)) if n < 1000 else sum_of_product_residues(residues, counts, bits, few=1 << 21)
    assert sum_of_product_residues(residues, counts, bits, few=0) == want
    assert sum_of_product_residues(residues, counts, bits, few=1 << 21) == want


def test_enrichment_of_many_lengths(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 30_000_000, 400).tolist()
    cluster_of = rng.integers(0, 6, 400).tolist()
    links = [(int(a), int(b), int(z)) for a, b, z in zip(rng.integers(0, 400, 900), rng.integers(0, 400, 900), rng.integers(1, 40, 900), strict=True)]
    frames = (spark.createDataFrame(links, "i int, j int, z long"), spark.createDataFrame(list(enumerate(cluster_of)), "tid int, cluster_id int"), spark.createDataFrame(list(enumerate(lengths)), "tid int, len long"))
    weigh = lambda a, b: lengths[a] * lengths[b] >> 20
    within = sum(weigh(a, b) for a in range(400) for b in range(400) if cluster_of[a] == cluster_of[b])
    between = sum(weigh(a, b) for a in range(400) for b in range(400)) - within
    inside = sum(z * weigh(a, b) for a, b, z in links if cluster_of[a] == cluster_of[b])
    outside = sum(z * weigh(a, b) for a, b, z in links if cluster_of[a] != cluster_of[b])
    got = C.enrichment(*frames)
    assert got.head().intra_density == inside / within and got.head().inter_density == outside / between
