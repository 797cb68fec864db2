"""The fuzzy neighbour graph against a plain loop, and its layout against numpy."""

import math

import numpy as np

from cairn.operators import graph, vectors


def plain(v, k):
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), 12)
    near = [sorted((d[i, j], j) for j in range(len(v)) if j != i)[:k] for i in range(len(v))]
    overall = np.mean([x for n in near for x, _ in n])
    w = {}
    for i, n in enumerate(near):
        far = [x for x, _ in n]
        rho = min((x for x in far if x > 0), default=0.0)
        low, high, at = 0.0, math.inf, 1.0
        for _ in range(64):
            if sum(math.exp(-max(0.0, x - rho) / at) for x in far) > math.log2(k):
                high = at
            else:
                low = at
            at = at * 2 if high == math.inf else (low + high) / 2
        at = max(at, 1e-3 * (np.mean(far) if rho > 0 else overall))
        for x, j in n:
            w[i, j] = 1.0 if x - rho <= 0 else math.exp(-(x - rho) / at)
    return {(i, j): w.get((i, j), 0) + w.get((j, i), 0) - w.get((i, j), 0) * w.get((j, i), 0) for i, j in {(min(e), max(e)) for e in w}}


def test_weights_and_layout(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.standard_normal((25, 3)) + c for c in ((0, 0, 0), (7, 0, 0))] + [np.full((6, 3), 3.5), rng.uniform(0, 7, (8, 3))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, e array<double>").repartition(3)
    edges = graph.fuzzy_graph(vectors.points(df, "k", "e"), 5)
    got, want = {(r["a"], r["b"]): r["w"] for r in edges.collect()}, plain(v, 5)
    assert set(got) == set(want) and all(abs(got[e] - want[e]) < 1e-9 for e in want)

    m = np.zeros((len(v), len(v)))
    for (i, j), w in {**want, (0, 40): 0.8, (3, 60): 0.7, (52, 9): 0.9}.items():
        m[i, j] = m[j, i] = w
    links = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(np.triu(m)))], "a long, b long, w double")
    root = np.sqrt(m.sum(axis=0))
    s = (m / np.outer(root, root) + np.eye(len(v))) / 2
    at = {r["id"]: r["vec"] for r in graph.spectral_layout(links, 2, rounds=6).collect()}
    x = np.array([at[i] for i in range(len(v))])
    assert np.allclose(x.T @ x, np.eye(2), atol=1e-8) and np.abs(x.T @ root).max() < 1e-8
    values = np.linalg.eigvalsh(s)[::-1]
    first = x.T @ s @ x
    assert first[0, 0] > 0.8 * values[1] and first[0, 0] <= values[1] + 1e-9
