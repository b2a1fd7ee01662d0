"""Clusters by density and by the order of rows against versions that look at everything."""

import random

import numpy as np
import pytest

from tidemark.operators import density, order, ordered
from tidemark.operators.ordered import first_fit


def plain_fold(rows):
    clusters, out = [], {}
    for i, terms in sorted(rows):
        terms = set(terms or [])
        for name, held in clusters:
            if terms and held and len(terms & held) / min(len(terms), len(held)) >= 0.5:
                held |= terms
                out[i] = name
                break
        else:
            clusters.append((i, terms))
            out[i] = i
    return out


@pytest.mark.parametrize("seed, n, words", [(1, 150, 60), (3, 250, 25)])
def test_ordered_clusters(spark, seed, n, words):
    """Frequent and rare terms, repeated rows, rows without terms; each order gives its own clusters, and each is met."""
    r = random.Random(seed)
    rows = [(3 * k, [f"w{min(int(r.expovariate(4 / words)), words - 1)}" for _ in range(r.randrange(9))]) for k in range(n)]
    rows += [(3 * n + k, rows[5][1]) for k in range(20)] + [(9999, None)]
    backwards = [(-i, t) for i, t in rows]
    found = []
    for some in (rows, backwards):
        got = dict(map(tuple, first_fit(spark.createDataFrame(some, "id long, terms array<string>")).collect()))
        assert got == plain_fold(some)
        found.append({frozenset(abs(i) for i in got if got[i] == c) for c in set(got.values())})
    assert found[0] != found[1]


def test_ordered_clusters_of_nothing(spark):
    assert first_fit(spark.createDataFrame([], "id long, terms array<string>")).count() == 0


def test_ordered_clusters_of_windows(spark, monkeypatch):
    """Few sets of terms, repeated often, so that they change to clusters that grow; windows of few sets, one after the other."""
    monkeypatch.setattr(ordered, "KINDS", 12, raising=False)
    r = random.Random(4)
    kinds = [[f"w{min(int(r.expovariate(0.12)), 24)}" for _ in range(r.randrange(1, 7))] for _ in range(60)]
    rows = [(k, kinds[min(int(r.expovariate(12 / (k + 9))), 59)]) for k in range(700)]
    got = dict(map(tuple, first_fit(spark.createDataFrame(rows, "id long, terms array<string>")).collect()))
    assert got == plain_fold(rows)
    homes = {}
    for i, terms in rows:
        homes.setdefault(frozenset(terms), set()).add(got[i])
    assert sum(len(h) > 1 for h in homes.values()) > 3


def test_ordered_clusters_settle_at_once(spark, monkeypatch):
    """A chain in which each row depends on the one before, with many copies: tables that are written don't grow with its length."""
    written, write = [], ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df: written.append(1) or write(df))
    rows = [(3 * k, [f"w{k}", f"w{k + 1}"]) for k in range(40)] + [(1000 + k, [f"w{k % 40}", f"w{k % 40 + 1}"]) for k in range(200)]
    got = dict(map(tuple, first_fit(spark.createDataFrame(rows, "id long, terms array<string>")).collect()))
    assert got == plain_fold(rows) and set(got.values()) == {0} and len(written) < 25


def test_ordered_rows_of_one_id(spark):
    """Rows of one id are rows of their own, one after the other."""
    rows = [(1, ["b", "a"]), (1, ["c", "d"]), (2, ["a"]), (2, ["d", "x"]), (2, ["q"]), (3, ["q", "x"]), (3, ["q", "x"])]
    got = sorted(map(tuple, first_fit(spark.createDataFrame(rows, "id long, terms array<string>")).collect()))
    assert got == [(1, 1), (1, 1), (2, 1), (2, 1), (2, 2), (3, 1), (3, 1)]


def plain_density(ids, x, least, samples):
    """The hierarchy by union-find over all pairs, walked node by node."""
    n = len(ids)
    d = density.distances(x, x)
    cores = np.array([np.sort(np.delete(d[k], k))[min(max(1, samples - 1), n - 1) - 1] for k in range(n)])
    reach = np.maximum(np.maximum(d, cores[:, None]), cores[None, :])
    pairs = sorted((reach[i, j], ids[i], ids[j], i, j) for i in range(n) for j in range(n) if ids[i] < ids[j])
    node, children, size, weight = list(range(n)), {}, {k: 1 for k in range(n)}, {}

    def root(k):
        while node[k] != k:
            k = node[k]
        return k

    for w, _, _, i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            node.append(len(node))
            node[a] = node[b] = new = len(node) - 1
            children[new], size[new], weight[new] = (a, b), size[a] + size[b], w
    top = len(node) - 1
    clusters, falls = {top: [None, 0.0]}, []
    todo = [(top, top)]
    while todo:
        at, own = todo.pop()
        a, b = children[at]
        lam = 1 / weight[at]
        large = [c for c in (a, b) if size[c] >= least]
        if len(large) == 2:
            for c in large:
                clusters[c] = [own, lam]
                todo.append((c, c))
            continue
        for c in (a, b):
            if c in large:
                todo.append((c, own))
            else:
                under = [c]
                while under:
                    y = under.pop()
                    if y < n:
                        falls.append((y, own, lam))
                    else:
                        under += children[y]
    stability = {c: 0.0 for c in clusters}
    for _, c, lam in falls:
        stability[c] += lam - clusters[c][1]
    for c, (above, born) in clusters.items():
        if above is not None:
            stability[above] += size[c] * (born - clusters[above][1])
    stability = {c: round(s, density.DIGITS) for c, s in stability.items()}
    worth, kept = {}, {}
    for c in sorted(clusters):  # children have smaller numbers
        below = sum(worth[k] for k, (above, _) in clusters.items() if above == c)
        worth[c] = max(stability[c], below)
        kept[c] = c != top and stability[c] >= below - 1e-9

    def chosen(c):
        best = None
        while c is not None:
            best, c = (c if kept[c] else best), clusters[c][0]
        return best

    groups = {}
    for y, c, _ in falls:
        groups.setdefault(chosen(c), []).append(ids[y])
    out = {}
    for c, members in groups.items():
        out |= {i: (i, True) if c is None else (min(members), False) for i in members}
    return out


def blobs(seed, sizes, dim=3, spread=0.3):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=dim) * 4 + spread * r.normal(size=(n, dim)) for n in sizes])


CASES = {
    "blobs": (blobs(1, [30, 20, 10, 1, 1, 1]), 5, 5),
    "pairs": (np.random.default_rng(2).normal(size=(70, 8)), 2, 2),
    "line": (np.cumsum(1 + 0.01 * np.arange(60))[:, None] * np.ones((1, 2)), 2, 2),
    "copies": (np.concatenate([blobs(3, [12, 9]), blobs(3, [12, 9])[:8], np.zeros((15, 3))]), 3, 2),
    "two": (np.array([[0.0, 0.0], [1.0, 0.0]]), 2, 2),
}


@pytest.mark.parametrize("case, block", [("blobs", 1024), ("pairs", 16), ("line", 16), ("copies", 1024), ("two", 1024)])
def test_density_clusters(spark, monkeypatch, case, block):
    """One block and many; clear groups, noise, a chain whose links grow, equal points."""
    monkeypatch.setattr(density, "BLOCK", block)
    x, least, samples = CASES[case]
    ids = [7 * k + 3 for k in range(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "id long, v array<double>")
    got = {r.id: (r.cluster, r.noise) for r in density.density_clusters(df, least, samples).collect()}
    assert got == plain_density(ids, x, least, samples)
    if case == "blobs":
        assert sum(list(got.values()).count(y) >= 10 for y in set(got.values()) if not y[1]) == 3


@pytest.mark.parametrize("seed, least, samples, block", [(5, 2, 2, 8), (6, 3, 5, 1024)])
def test_density_of_copies(spark, monkeypatch, seed, least, samples, block):
    """Points of a grid, some of them often, so that most distances are equal; only distinct ones are compared."""
    monkeypatch.setattr(density, "BLOCK", block)
    met, pairs = [], density.block_pairs
    monkeypatch.setattr(density, "block_pairs", lambda points: met.append(points.count()) or pairs(points))
    r = np.random.default_rng(seed)
    x = np.concatenate([r.integers(0, 5, (40, 2)), np.repeat(r.integers(0, 9, (6, 2)), r.integers(1, 12, 6), axis=0)]).astype(float)
    ids = r.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "id long, v array<double>")
    got = {r.id: (r.cluster, r.noise) for r in density.density_clusters(df, least, samples).collect()}
    assert got == plain_density(ids, x, least, samples) and met == [len({tuple(row) for row in x})] * 2


def test_density_of_few(spark):
    df = spark.createDataFrame([(4, [1.0])], "id long, v array<double>")
    assert [tuple(r) for r in density.density_clusters(df).collect()] == [(4, 4, True)] and density.density_clusters(df.limit(0)).count() == 0


def test_pointers_are_followed_to_the_end(spark):
    rows = [(k, k - 1 if k % 100 else None, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "node long, parent long, value long")
    assert dict(map(tuple, order.gathered(df, "value").collect())) == {k: 100 - k % 100 for k in range(300)}
    assert {r.node: r.value for r in order.followed(df.withColumn("value", df.node), {"value": order.later}).collect()} == {k: k - k % 100 for k in range(300)}
    got = order.numbered(df, ["value", "node"], "n").collect()
    assert {r.node: r.n for r in got} == {k: k for k in range(300)}
