"""Centroid clustering against plain integer loops."""

import hashlib

import numpy as np
import pytest

from cairn.llm import centroid_clustering as cc


def brute(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all()]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centers = [list(v) for _, v in first]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    near = lambda v: min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for c in range(len(centers)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centers[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [(i, near(v), far(v, centers[near(v)])) for i, v in kept]
    total = {c: sum(d for _, o, d in own if o == c) for c in range(len(centers))}
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in own), key=str)


def result(spark, rows, kind="array<double>", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").selectExpr("*", "'x' AS cluster", "0 AS page", "1 AS id_", "2 AS vec").repartition(3)
    return sorted(map(tuple, cc.clusters(df, **more).collect()), key=str)


@pytest.mark.parametrize("spread", [0.02, 0.2, 3.0])
def test_equal_to_plain_loops(spark, spread):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((6, 64)) / 8
    rows = [(i, (middles[i % 6] + spread * rng.standard_normal(64) / 8).tolist()) for i in range(150)]
    rows += [(1000 + i, middles[0].tolist()) for i in range(60)]  # a third are copies
    rows += [(3, middles[1].tolist()), (3, middles[1].tolist()), (None, middles[2].tolist()), (None, None), (2000, None), (2001, [1.0] * 63), (2002, [0.5] * 65), (2003, []), (2004, [None, *[0.1] * 63]), (2005, [float("nan")] * 64), (2006, [float("inf"), *[0.0] * 63]), (2007, [0.0] * 64), (2008, [1e5] * 64)]
    fetched = []
    assert result(spark, rows, fetched=fetched) == brute(rows)
    assert fetched and all(n <= total for n, _, total in fetched)
    if spread < 0.1:  # far apart: cells tell nearly all
        assert fetched[-1][0] < 0.2 * fetched[-1][2]


def test_cells_never_decide_wrongly():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-1000, 1000, (3000, 7)), np.repeat([[0, 1, -5, 3, 2, 9, 9]], 5, axis=0)])
    borders, least, most = cc.cell_bounds(x[:500], x.min(axis=0), x.max(axis=0))
    cells = np.stack([np.searchsorted(borders[i], x[:, i], side="right") for i in range(7)], axis=1)
    inside = np.arange(7)
    assert (least[inside, cells] <= x).all() and (x <= most[inside, cells]).all()
    for centers in (x[:8], np.repeat(x[:1], 3, axis=0), x[:1], rng.integers(-200, 200, (5, 7))):
        told = cc.Intervals(centers, least, most).nearest(cells)
        sure = told >= 0
        assert (told[sure] == cc.distances(x, centers).argmin(axis=1)[sure]).all()
    assert sure.any()


def test_few_rows_no_rows_and_too_large(spark):
    rows = [(i, [0.1 * i] * 64) for i in range(3)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == [] and result(spark, [(None, [1.0] * 64)]) == [] and result(spark, [(1, None)]) == []
    with pytest.raises(Exception, match="beyond"):
        result(spark, [(1, [1e6] * 64)])
