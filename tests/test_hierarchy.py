"""Clusters of the density hierarchy against a plain-Python condensed tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import hierarchy, vectors


def plain(v, min_samples, least):
    """Labels as sets of rows: single linkage by mutual reachability, condensed top-down, greatest excess of mass."""
    n = len(v)
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), 12)
    core = np.sort(d + np.diag([np.inf] * n), axis=1)[:, min_samples - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    group = {i: i for i in range(n)}
    nodes = {i: ([], 0.0, [i]) for i in range(n)}
    for weight in sorted({w[i, j] for i in range(n) for j in range(i)}):  # all that meet on one weight meet at once
        up = {g: g for g in set(group.values())}
        for i, j in np.argwhere(np.triu(w == weight, 1)):
            a, b = group[i], group[j]
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[a] = b
        parts = {}
        for g in up:
            root = g
            while up[root] != root:
                root = up[root]
            parts.setdefault(root, []).append(g)
        for own in parts.values():
            if len(own) > 1:
                new = len(nodes)
                nodes[new] = (own, weight, [x for g in own for x in nodes[g][2]])
                group.update(dict.fromkeys(nodes[new][2], new))

    def condensed(node, birth):
        """(stability, rows of the chosen clusters) of the cluster that begins at node."""
        rows, mass, at = nodes[node][2], 0.0, node
        while True:
            children, weight, own = nodes[at]
            big = [c for c in children if len(nodes[c][2]) >= least]
            level = 1 / max(weight, 1e-10)
            if len(big) != 1:
                mass += len(own) * level
                below = [condensed(c, level) for c in big]
                break
            mass += (len(own) - len(nodes[big[0]][2])) * level
            at = big[0]
        stability, best = mass - birth * len(rows), sum(s for s, _ in below)
        if birth and stability >= best:
            return stability, [rows]
        return best, [r for _, x in below for r in x]

    chosen = condensed(len(nodes) - 1, 0.0)[1] if n >= least else []
    return sorted(sorted(r) for r in chosen)


def found(spark, v, min_samples, least):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, e array<double>").repartition(3)
    by = {}
    for r in hierarchy.clusters(vectors.points(df, "k", "e"), min_samples, least).collect():
        by.setdefault(r["cluster"], []).append(r["id"])
    assert sum(map(len, by.values())) == len(v)
    by.pop(-1, None)
    assert sorted(by) == list(range(len(by))) and sorted(map(len, by.values()), reverse=True) == [len(by[k]) for k in sorted(by)]
    return sorted(sorted(r) for r in by.values())


def _unlike(seed, copies=0):
    """Groups of unlike density, one of them two groups in one, and noise."""
    rng = np.random.default_rng(seed)
    parts = [((0, 0), 0.05, 30), ((0.6, 0), 0.05, 25), ((8, 0), 1.0, 40), ((0, 9), 0.3, 20)]
    v = np.concatenate([rng.standard_normal((n, 2)) * s + c for c, s, n in parts] + [rng.uniform(-4, 14, (15, 2))])
    return np.concatenate([v, np.repeat(v[:1], copies, axis=0)])


@pytest.mark.parametrize("small,least", [(100_000, 8), (0, 5)])
def test_unlike_densities(spark, monkeypatch, small, least):
    """With the driver's finish, and in rounds to the end."""
    monkeypatch.setattr(hierarchy, "SMALL", small)
    monkeypatch.setattr(vectors, "TILE", 64)
    v = _unlike(3) if small else _unlike(4)[::2]
    want = plain(v, 3, least)
    assert len(want) >= 3
    assert found(spark, v, 3, least) == want


def test_copies_and_few_points(spark):
    v = _unlike(5, copies=60)
    assert found(spark, v, 4, 6) == plain(v, 4, 6)
    assert found(spark, v[:4], 2, 5) == [] and found(spark, v[:20], 3, 12) == []


def test_spanning_tree_has_the_least_weight(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SMALL", 3)
    rng = np.random.default_rng(7)
    links = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 400), rng.integers(0, 40, 400), rng.integers(0, 9, 400))]
    got = hierarchy.spanning(spark.createDataFrame(links, "id long, neighbor long, w double")).collect()
    sets, total, n = hierarchy._Sets(), 0.0, 0
    for a, b, w in sorted(links, key=lambda x: x[2]):
        if sets.root(a) != sets.root(b):
            sets.up[sets.root(a)] = sets.root(b)
            total, n = total + w, n + 1
    assert sum(r["w"] for r in got) == total and len(got) == n


def _chain(n):
    """n groups of three points, of which one after the other joins: a tree as deep as there are groups."""
    inside = [(3 * g + i, 3 * g + i + 1, 0.1 + 0.01 * (g % 3)) for g in range(n) for i in (0, 1)]
    return inside + [(3 * g, 3 * g + 3, 1.0 + 0.1 * (g % n)) for g in range(n - 1)]


def test_deep_trees_take_no_round_a_level(spark, monkeypatch):
    edges = spark.createDataFrame(_chain(40), "a long, b long, w double")
    points, saved = spark.range(120), []
    save = hierarchy.save
    monkeypatch.setattr(hierarchy, "save", lambda df: saved.append(1) or save(df))
    assert hierarchy.from_tree(points, edges, 3).count() == 120
    assert len(saved) < 15


def test_tree_on_the_driver_selects_as_levels_do(spark):
    edges = spark.createDataFrame(_chain(5), "a long, b long, w double")
    members, splits = hierarchy.basins(spark.range(15), edges, 3)
    up = hierarchy.merges(splits, members)
    entries, known = hierarchy.entered(members, up), hierarchy._Known(up.collect())
    assert sorted(map(tuple, entries.collect())) == sorted(map(tuple, hierarchy._climbed(members, known).collect()))
    own = entries.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(hierarchy._inverse(F.col("b"))).alias("mass")).collect()
    want = hierarchy.select(hierarchy.stabilities(entries, up)).where("chosen IS NOT NULL").collect()
    assert sorted(known.chosen(own)) == sorted(map(tuple, want)) and want
