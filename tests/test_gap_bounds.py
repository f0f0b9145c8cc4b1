"""The gap search by bounds against the whole grid."""

import numpy as np
import pytest

from chromaloom.operators import link_sizes as Z


def made(rng):
    sizes, total = [], 40_000.0
    for k in range(Z.OCTAVES * Z.PER_OCTAVE):
        start, stop = (int(Z.LEAST * 2.0 ** (x / Z.PER_OCTAVE)) for x in (k, k + 1))
        sizes.append((k, start, stop, None if rng.random() < 0.02 else total / (start * (1 + rng.random()))))
    return Z.GapSearch(sizes)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_and_the_best_gap_is_that_of_the_grid(seed):
    rng = np.random.default_rng(seed)
    search, shares = made(rng), []
    for _ in range(5):
        len1, len2 = (int(x) for x in rng.integers(5_000, 3_000_000, 2))
        far = int(rng.choice([0, 20_000, 400_000, 3_000_000]))
        n = int(rng.choice([1, 3, 40, 300]))
        dists, counts = np.unique(rng.integers(0, min(len1 + len2, 200_000), n) + rng.integers(0, 5), return_counts=True)
        gaps = Z._gap_grid(int(dists[-1]), 1000, 9_999_000)
        x = len1, len2, float(rng.choice([0.3, 1.0, 4.0])) * (1 if far else 2), dists, counts
        values, used = search.log_likelihoods(gaps, *x)
        for size in (3, 50, 700):
            first = np.arange(0, len(gaps) - size, size * 7 + 1)
            bound = search.bounds(gaps[first], gaps[first + size - 1], *x)
            for a, top in zip(first.tolist(), bound.tolist(), strict=True):
                inside = values[a : a + size][used[a : a + size]]
                assert not len(inside) or inside.max() <= top + 1e-9
        found = search.best(gaps, *x)
        at = int(np.argmax(np.round(np.where(used, values, -np.inf), 5)))
        assert found[0] == gaps[at] and found[1] == pytest.approx(values[at], abs=1e-9)
        shares.append(found[2] / len(gaps))
    assert np.mean(shares) < 0.5
    print(f"evaluated: {np.mean(shares):.1%} of the grid")
