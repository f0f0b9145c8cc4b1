import math

import pytest

from chromaloom.operators import link_sizes as Z
from chromaloom.operators.links import local_ids
from chromaloom.plans import size_queries
from chromaloom.plans.adapters import view
from chromaloom.plans.ordering_queries import cells

DATA = "/root/testdata/sf0.001"


def brute_likelihoods(len1, len2, dists, lsd, enrichment=1.0, most=10_000_000):
    """ln likelihood by gap, one bin and link at a time."""
    short, long, found = min(len1, len2), max(len1, len2), {}

    def bin_of(distance):
        return math.floor(16 * math.log2(distance / 4096)) if distance >= 4096 else -1

    for gap in range(0, most, 1000):
        ll, terms = 0.0, 0
        seen = [bin_of(x + gap) for x in dists]
        for number, start, stop, density in lsd:
            if stop <= gap or start >= gap + len1 + len2:
                continue
            area = 0
            if start < gap + short:
                low, high = max(start, gap), min(stop, gap + short)
                area += (high - low) * ((low + high) // 2 - gap)
            if stop >= gap + short and start < gap + long:
                area += (min(stop, gap + long) - max(start, gap + short)) * short
            if stop >= gap + long:
                low, high = max(start, gap + long), min(stop, gap + len1 + len2)
                area += (high - low) * (gap + len1 + len2 - (low + high) // 2)
            m = area * density / 1e6 * enrichment
            if m > 0:
                k = seen.count(number)
                ll, terms = ll - m + (k * math.log(m) - math.lgamma(k + 1) if k else 0.0), terms + 1
        if terms:
            found[gap] = ll
    return found


def best(found):
    return min((-round(ll, 5), gap) for gap, ll in found.items())[1]


@pytest.fixture(scope="module")
def sizes(spark):
    return [(r.bin, r.start, r.stop, r.density) for r in size_queries.lsd(spark, DATA).collect() if r.density]


def test_gaps_of_all_neighbours_by_brute_force(spark, sizes):
    got = {r.pair: r.gap for r in size_queries.REGISTRY["gap_size"][0](spark, DATA).collect()}
    links = {}
    for r in size_queries._links(spark, DATA).collect():
        links.setdefault((r.pair, r.len1, r.len2), []).append(r.dist)
    assert set(got) == {pair for pair, _, _ in links}
    assert any(pair.local_id % 8 for pair in got)
    ll = {}
    for r in size_queries.REGISTRY["poisson_ll"][0](spark, DATA).collect():
        ll.setdefault(r.pair, {})[r.gap] = r.ll
    for pair, len1, len2 in sorted(links)[:: max(1, len(links) // 5)]:
        slow = brute_likelihoods(len1, len2, links[pair, len1, len2], sizes)
        assert got[pair] == best(slow)
        assert ll[pair] == pytest.approx(slow, abs=1e-6)
    assert Z.GAP_STEP == 1000 and Z.MOST_GAP == 10_000_000


def test_contigs_are_spaced_by_brute_force(spark, sizes):
    ordering, contigs, clusters = (view(spark, DATA, name) for name in ("ordering", "contigs", "clusters"))
    rows = {(r.cluster_id, r.pos): r for r in size_queries.space_contigs(spark, DATA).collect()}
    assert len(rows) == ordering.count()
    lengths = {r.tid: r.len for r in contigs.collect()}
    enrichment = {r.tid: r.enrichment for r in Z.contig_enrichment(size_queries.far_pairs(spark, DATA), contigs, size_queries.lsd(spark, DATA)).collect()}
    local = {(r.cluster_id, r.tid): r.local_id for r in local_ids(clusters).collect()}
    links = {}
    for r in cells(spark, DATA).collect():
        links.setdefault((r.cluster_id, r.c1, r.rc1, r.c2, r.rc2), []).append(r.dist)
    checked = 0
    for (cluster, pos), row in sorted(rows.items()):
        after = rows.get((cluster, pos + 1))
        if after is None:
            assert row.gap is None
            continue
        dists = links.get((cluster, local[cluster, row.tid], row.rc, local[cluster, after.tid], after.rc))
        a, b = lengths[row.tid], lengths[after.tid]
        both = enrichment[row.tid] ** (2 * a / (a + b)) * enrichment[after.tid] ** (2 * b / (a + b))
        if not dists or both <= 0:
            assert row.gap is None
        elif checked < 5:
            checked += 1
            assert row.gap == best(brute_likelihoods(a, b, dists, sizes, both))
