"""Top-k search against all pairs."""

import numpy as np
import pytest

from cairn.llm import topk_search as ts


def brute(rows, k=5, every=50):
    kept = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    out = []
    for i, q in kept:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if len(v) == len(q) and (j, v) != (i, q))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def result(spark, rows, kind="array<double>", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").selectExpr("*", "'x' AS id", "0 AS bucket", "'d' AS digest", "1 AS rank", "2 AS score").repartition(3)
    return sorted(map(tuple, ts.search(df, **more).collect()))


def _rows():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((8, 12)) / 4
    rows = [(i, (base[i % 8] + rng.standard_normal(12) / 16).tolist()) for i in range(400)]
    rows += [(1000 + i, base[0].tolist()) for i in range(200)]  # a third are copies, four of them queries
    rows += [(50, base[1].tolist()), (50, base[1].tolist()), (51, base[1].tolist()), (-50, base[2].tolist())]
    rows += [(None, base[0].tolist()), (5000, None), (5050, []), (5100, [None] * 12), (5150, [float("nan")] * 12), (5200, [float("inf")] * 12), (5250, [0.0] * 12), (5251, [0.0] * 12)]
    return rows + [(6000, [1.0, -1.0]), (6001, [0.5, 2.0]), (6050, [1.0])]


@pytest.mark.parametrize("shard,queries,shards", [(2048, 512, 1024), (40, 7, 3)])
def test_equal_to_all_pairs(spark, monkeypatch, shard, queries, shards):
    """In one shard and in many small ones, with copies, ties, negative ids and ids that differ in vectors."""
    for name, value in (("SHARD", shard), ("QUERIES", queries), ("SHARDS", shards)):
        monkeypatch.setattr(ts, name, value)
    rows = _rows()
    assert result(spark, rows) == brute(rows)
    assert result(spark, [r for r in rows if r[0] != 50], k=1, every=3) == brute([r for r in rows if r[0] != 50], 1, 3)


def test_few_rows_no_rows_and_too_large(spark):
    assert result(spark, []) == [] and result(spark, [(1, [1.0])]) == [] and result(spark, [(0, [1.0])]) == []
    assert result(spark, [(0, [1.0]), (3, [2.0])], "array<float>") == [(0, 1, 3, 256 * 512)]
    with pytest.raises(Exception, match="more than 8192"):
        result(spark, [(0, [1e9])])


def test_stops_on_proof_before_all_postings():
    """Members equal a full sort, and near neighbours are proven with a part of the postings."""
    rng = np.random.default_rng(4)
    x = np.rint(rng.standard_normal((1500, 32)) * 40)
    q = np.concatenate([x[:20] + np.rint(rng.standard_normal((20, 32)) * 3), np.zeros((1, 32)), np.rint(rng.standard_normal((9, 32)) * 40)])
    least = rng.permutation(len(x))
    full = (q @ x.T).astype(np.int64)
    sixth = np.sort(full, axis=1)[:, -6].astype(float)
    for theta in (np.full(len(q), -np.inf), sixth):
        tally = []
        who, row, score = ts.members(x, least, ts.postings(x), q, theta, 6, tally)
        for i in range(len(q)):
            best = np.lexsort((least, -full[i]))[:6]
            assert row[who == i].tolist() == best.tolist() and score[who == i].tolist() == full[i][best].tolist()
    added, scored, every, pairs = tally[0]  # with a bound from the home shard
    assert added < 0.85 * every and scored < 0.1 * pairs
    high = np.full(len(q), full.max() + 1.0)
    assert len(ts.members(x, least, ts.postings(x), q, high, 6)[0]) == 0
