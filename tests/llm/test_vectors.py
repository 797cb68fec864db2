"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from cairn.llm import embedding_dedup as ed


def brute(rows, threshold=0.95):
    """(n_links, component_id) by id of rows (id, vector or None), ids unique."""
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = dict.fromkeys(up, 0)
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: (n[i], root(i)) for i in up}


def result(spark, rows, kind="array<double>", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").selectExpr("*", "'x' AS id", "0 AS bucket", "'d' AS digest")
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_vectors(df, **more).collect()}


@pytest.mark.parametrize("block", [2048, 16])
def test_groups_of_near_copies(spark, monkeypatch, block):
    """A third of all rows near each other, exact copies, links just above and below the threshold, blocks cut small."""
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "STRIP", 8)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((5, 24))
    near = [base[0] + 0.12 * rng.standard_normal(24) for _ in range(60)]
    pairs = []
    for cosine in (0.9501, 0.951, 0.96, 0.949, 0.9):
        for _ in range(6):
            a = rng.standard_normal(24)
            o = rng.standard_normal(24)
            o -= a * (a @ o) / (a @ a)
            pairs += [a, cosine * a / np.linalg.norm(a) + np.sqrt(1 - cosine**2) * o / np.linalg.norm(o)]
    rows = [(i, v.tolist()) for i, v in enumerate([*near, *pairs, *[base[1]] * 9, *rng.standard_normal((40, 24))])]
    rows += [(5000, [1.0, 2.0]), (5001, [2.0, 4.0]), (5002, [1.0]), (5003, [1e-300] * 24), (5004, [1e300] * 24)]
    assert result(spark, rows) == brute(rows[:-2] + [(5003, [1.0] * 24), (5004, [1.0] * 24)])


def test_planted_links_just_above_the_threshold(spark):
    rng = np.random.default_rng(8)
    n = 3000
    a = rng.standard_normal((n, 32))
    o = rng.standard_normal((n, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= a * (a * o).sum(axis=1, keepdims=True)
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(0.9502, 0.97, (n, 1))
    b = c * a + np.sqrt(1 - c * c) * o
    got = result(spark, [(2 * i + k, v.tolist()) for i in range(n) for k, v in enumerate((a[i], b[i]))])
    assert sum(got[2 * i + 1] [1] <= 2 * i for i in range(n)) >= n - 2


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0] * 3), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [None, 1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [2.0, 0.0, 0.0]), (9, [-1.0, 0.0, 0.0]), (10, [-0.0, 0.0, 1.0]), (11, [0.0, 0.0, 1.0])]
    for kind in ("array<double>", "array<float>"):
        assert result(spark, rows, kind) == brute(rows)
    assert result(spark, [], "array<float>") == {}
    assert result(spark, [(3, None), (4, [0.0])], "array<float>") == {3: (0, 3), 4: (0, 4)}


def test_plan_keeps_its_chance():
    for n in (1, 500, 50_000, 10**6, 10**9):
        bits, tables, cut = ed.plan(n, 0.95)
        agree = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - agree) ** tables <= ed.MISS and 13 < cut < 48
