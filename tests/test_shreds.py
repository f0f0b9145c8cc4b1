"""Shreds put into an order, against the plain search, and how much of the group is looked at."""

import random

import pytest

from chromaloom.operators import trees as T


def some_group(rng, size, links):
    pairs = {}
    while len(pairs) < links:
        a, b = sorted(rng.sample(range(size), 2))
        pairs[a, b] = (rng.randrange(1, 4), [0.0] * 4)
    return T.Group([rng.choice([5, 10, 20]) for _ in range(size)], pairs)


def plain_shreds(group, tree):
    left = [set(near) for near in tree]
    whole = T.longest_path(tree)
    path, gone, shreds = whole, set(), []
    while path:
        for node in path:
            gone.add(node)
            for other in left[node]:
                left[other].discard(node)
            left[node] = set()
        path = T.longest_path([[n for n in tree[k] if n in left[k]] for k in range(group.size)])
        shreds += [path] if path else []
    return whole, shreds + [[n] for n in range(group.size) if n not in gone and group.near[n]]


def plain_order(group, tree, min_sites):
    order, shreds = plain_shreds(group, tree)
    for shred in shreds:
        if sum(group.sites[n] for n in shred) <= min_sites:
            continue
        best, place, turned = 0.0, len(order), False
        for at in range(len(order) + 1):
            before, after = order[at - 1] if at else None, order[at] if at < len(order) else None
            for rc in (False, True) if len(shred) > 1 else (False,):
                x, y = (after, before) if rc else (before, after)
                gain = (group.density(x, shred[0]) if x is not None else 0.0) + (group.density(y, shred[-1]) if y is not None else 0.0)
                gain -= group.density(x, y) if x is not None and y is not None else 0.0
                if gain > best:
                    best, place, turned = gain, at, rc
        order[place:place] = shred[::-1] if turned else shred
    return order


@pytest.mark.parametrize("seed", range(12))
def test_shreds_go_where_the_plain_search_puts_them(seed):
    rng = random.Random(seed)
    group = some_group(rng, 60, rng.choice([30, 70, 200]))
    tree = T.smooth_thorns(group, T.spanning_tree(group, 15))
    for sites in (0, 15):
        assert T.reinsert(group, [list(n) for n in tree], sites) == plain_order(group, tree, sites)


def test_shreds_look_beside_their_links_only(monkeypatch):
    rng = random.Random(1)
    group = some_group(rng, 1500, 1600)
    tree = T.spanning_tree(group, 0)
    asked = []
    density = T.Group.density
    monkeypatch.setattr(T.Group, "density", lambda self, a, b: asked.append(1) or density(self, a, b))
    T.reinsert(group, tree, 0)
    assert len(asked) < 60_000


def test_marks_are_dealt_anew():
    line, plain, rng = T._Line([0, 1]), [0, 1], random.Random(3)
    for k in range(2, 300):
        at = rng.choice([0, 1, 1, 1, rng.randrange(len(plain) + 1)])
        line.insert([k], plain[at - 1] if at else None, plain[at] if at < len(plain) else None)
        plain.insert(at, k)
    assert list(line) == plain == sorted(plain, key=line.mark.__getitem__) and line.last == plain[-1]
