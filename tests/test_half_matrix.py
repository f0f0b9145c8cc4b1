"""Enrichment from one triangle of the link matrix."""

import random

from chromaloom.operators import clusters as C
from chromaloom.operators import links as L


def test_half_a_symmetric_matrix_is_enough(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(12), rng.randrange(12), rng.randrange(5), rng.randrange(5), rng.randrange(2), rng.randrange(2)) for _ in range(300)]
    frame = spark.createDataFrame(pairs, "tid1 int, tid2 int, pos1 int, pos2 int, mapq1 int, mapq2 int")
    clusters, contigs = spark.createDataFrame([(t, t % 3) for t in range(10)], "tid int, cluster_id int"), spark.createDataFrame([(t, 90000 + 7000 * t, t + 1) for t in range(12)], "tid int, len long, re long")
    whole = C.enrichment(L.normalise(L.link_matrix(frame), contigs), clusters, contigs).first()
    assert C.enrichment(L.normalise(L.half_matrix(frame), contigs), clusters, contigs, half=True).first() == whole
