"""Sources, sinks, vectors and models against numpy and round trips; defined results of odd inputs."""

import io
import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import stats
from cairn.operators import gates, media, models, relational, sampling, tables, vectors
from cairn.plans.registry import ORACLES, QUERIES
from cairn.sources import files

D = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    return None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"knn_topk", "mixing_score", "silhouette_euclid", "density_clusters", "combat", "remediation_exclusion", "cluster_sweep", "method_agreement"}))
def test_every_query_has_its_sql_result(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, want = QUERIES[name](spark, D).toPandas(), con.execute(ORACLES[name]).df()
    rows = lambda d: sorted(str(plain(r)) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_kruskal_counts_small_groups(spark):
    """Groups of 10, 10 and 5 values: the third counts in the statistic."""
    data = [(g, float(x)) for g, xs in enumerate((range(10), range(6, 16), (30, 31, 31, 2, 40))) for x in xs]
    xs = np.array([x for _, x in data])
    ranks = np.array([(xs < x).sum() + ((xs == x).sum() + 1) / 2 for x in xs])
    n, groups = len(xs), np.array([g for g, _ in data])
    h = 12 / (n * (n + 1)) * sum(ranks[groups == g].sum() ** 2 / (groups == g).sum() for g in range(3)) - 3 * (n + 1)
    h /= 1 - sum(t**3 - t for t in np.unique(xs, return_counts=True)[1]) / (n**3 - n)
    r = stats.kruskal(spark.createDataFrame(data, "g int, x double").repartition(7), "g", "x").first()
    assert (r["n"], r["groups"], r["dof"], r["underpowered"]) == (25, 3, 2, False) and math.isclose(r["h"], h) and math.isclose(r["p"], stats.chi2_tail(h, 2))
    assert stats.kruskal(spark.createDataFrame([], "g int, x double"), "g", "x").first()["underpowered"]
    assert stats.kruskal(spark.createDataFrame([(i % 2, 1.0) for i in range(40)], "g int, x double"), "g", "x").first()["h"] is None


def test_chi_square_of_tables_side_by_side(spark):
    cells = [("t", "x", "p", 8), ("t", "x", "q", 2), ("t", "y", "p", 3), ("t", "y", "q", 7), ("u", "x", "p", 5), ("u", "y", "q", 5), ("v", "x", "p", 4)]
    got = {r["k"]: r for r in stats.cramers_v(stats.chi_square(spark.createDataFrame(cells, "k string, a string, b string, n long"), ["k"])).collect()}
    assert math.isclose(got["t"]["chi2"], 20 * (abs(8 * 7 - 2 * 3) - 10) ** 2 / (10 * 10 * 11 * 9))
    assert math.isclose(got["u"]["chi2"], 10 * (25 - 5) ** 2 / 5**4) and got["v"]["v"] is None  # zero cells count in Yates' correction
    assert gates.exclusion_trace(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_chi_square_of_a_label_that_most_batches_hold(spark):
    """One label in 3,000 batches, another in every tenth: margins don't depend on partitions, and equal sums over a dense table."""
    cells = [(i, "hot", 3 + i % 4) for i in range(3000)] + [(i, "rare", 1 + i % 3) for i in range(0, 3000, 10)]
    dense = np.zeros((3000, 2))
    for a, b, n in cells:
        dense[a, int(b == "rare")] = n
    expected = dense.sum(1, keepdims=True) * dense.sum(0) / dense.sum()
    want = ((dense - expected) ** 2 / expected).sum()
    for parts in (1, 9):
        r = stats.chi_square(spark.createDataFrame(cells, "a long, b string, n long").repartition(parts)).first()
        assert (r["rows"], r["cols"], r["dof"], r["n"]) == (3000, 2, 2999, dense.sum()) and math.isclose(r["chi2"], want, rel_tol=1e-9)
    assert stats.chi_square(spark.createDataFrame([], "a long, b string, n long")).first()["rows"] == 0


def test_exclusion_with_ties_nulls_and_two_by_two_steps(spark):
    data = [("a", "x", 60), ("b", "y", 60), ("c", "x", 30), ("c", "y", 25), ("d", "x", 9), ("d", "y", 11), (None, "x", 5)]
    df = spark.createDataFrame([(a, b) for a, b, n in data for _ in range(n)], "a string, b string")
    trace, left = gates.iterative_exclusion(df, "a", "b", stop=0.05)
    cells, want = {(a, b): n for a, b, n in data if a}, []
    while True:
        rows = {a: sum(n for (x, _), n in cells.items() if x == a) for a, _ in cells}
        cols = {b: sum(n for (_, y), n in cells.items() if y == b) for _, b in cells}
        total, k = sum(rows.values()), min(len(rows), len(cols)) - 1
        off = {(a, b): abs(cells.get((a, b), 0) - rows[a] * cols[b] / total) for a in rows for b in cols}
        cut = 0.5 if len(rows) == len(cols) == 2 else 0.0
        chi = sum((o - min(cut, o)) ** 2 / (rows[a] * cols[b] / total) for (a, b), o in off.items())
        v = math.sqrt(chi / (total * k)) if k else 0.0
        able = sorted((-rows[a], a) for a in rows if rows[a] >= 50 and max(n for (x, _), n in cells.items() if x == a) / rows[a] > 0.7)
        drop = able[0][1] if v >= 0.05 and able else None
        want.append((total, round(v, 9), len(able), drop))
        if not drop:
            break
        cells = {k_: n for k_, n in cells.items() if k_[0] != drop}
    assert [(r["n"], round(r["v"], 9), r["candidates"], r["dropped"]) for r in trace.orderBy("step").collect()] == want
    assert {r["a"] for r in left.select("a").distinct().collect()} == {"c", "d", None}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.001, 500), min_size=1, max_size=5), st.integers(1, 60))
def test_tail_decreases(xs, k):
    p = [stats.chi2_tail(x, k) for x in sorted(xs)]
    assert all(0 <= b <= a * (1 + 1e-9) <= 1 + 1e-6 for a, b in zip(p, p[1:]))


def test_running_sums_and_medians_do_not_depend_on_partitions(spark):
    for n in (1, 3, 7):
        df = spark.range(1000).withColumn("x", F.col("id") * 3 % 1009).repartition(n)
        got = {r["x"]: r["before"] for r in tables.before(df, "x", F.lit(2)).collect()}
        assert got == {x: 2 * i for i, x in enumerate(sorted(got))}
    words = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("B",), ("a",)], "k string")
    assert {r["k"]: r["code"] for r in relational.codes(words, "k").collect()} == {"B": 0, "a": 1, "b": 2, "é": 3}
    for xs, mid in (([1.0, 3.0], 2.0), ([5.0], 5.0), ([1.0, 1.0, 9.0], 1.0), ([None], None)):
        assert relational.median(spark.createDataFrame([(x,) for x in xs], "x double"), "x").first()["median"] == mid


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "hot").when(F.col("id") < 4990, "b"))
    got = sampling.ranked(df.repartition(6), "g", "id").collect()
    for g in ("hot", "b", None):
        assert sorted(r["nth"] for r in got if r["g"] == g) == list(range(1, sum(r["g"] == g for r in got) + 1))
    few = sampling.capped(df, "g", "id", F.when(F.col("g") == "hot", 20)).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in few} == {"hot": 20, "b": 990, None: 10}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300)] + [tuple(map(int, rng.integers(1000, 1400, 2))) for _ in range(250)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pca_is_that_of_population_scaled_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 6)) @ rng.standard_normal((6, 6)) + 4
    got = np.array([r["pc"] for r in models.pca(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "v", 3).orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    load = np.linalg.svd(z, full_matrices=False)[2][:3].T
    load *= np.sign(load[np.abs(load).argmax(axis=0), range(3)])
    assert np.allclose(got, z @ load, atol=1e-6)


def test_combat_with_covariates_keeps_their_effect(spark):
    rng = np.random.default_rng(5)
    n, batch, age, sex = 120, np.arange(120) % 3, rng.uniform(20, 80, 120), rng.integers(0, 2, 120).astype(float)
    effects = np.array([[0.05, -0.02, 0.0, 0.1], [1.0, 0.0, -2.0, 0.5]])
    x = rng.standard_normal((n, 4)) * (1 + batch[:, None]) + 3 * batch[:, None] + np.stack([age, sex], 1) @ effects
    df = spark.createDataFrame([(i, int(b), float(a), float(s), v.tolist()) for i, (b, a, s, v) in enumerate(zip(batch, age, sex, x))], "id long, b int, age double, sex double, v array<double>")
    design = np.concatenate([np.eye(3)[batch], age[:, None], sex[:, None]], axis=1)
    want = np.linalg.lstsq(design, x, rcond=None)[0][3:]
    assert np.allclose(models.covariate_effects(df, "v", "b", ["age", "sex"]), want)
    bare = spark.createDataFrame([(i, int(b), v.tolist()) for i, (b, v) in enumerate(zip(batch, x - np.stack([age, sex], 1) @ want))], "id long, b int, v array<double>")
    plain_ = np.array([r["vec"] for r in models.combat(bare, "id", "v", "b").orderBy("id").collect()]) + np.stack([age, sex], 1) @ want
    got = np.array([r["vec"] for r in models.combat(df, "id", "v", "b", covariates=["age", "sex"]).orderBy("id").collect()])
    assert np.allclose(got, plain_) and not np.allclose(got, np.array([r["vec"] for r in models.combat(df, "id", "v", "b").orderBy("id").collect()]))


def test_combat_equals_its_sql_to_the_sign_of_zero(spark, tmp_path):
    """Vectors so small that many components round to zero from below, which SQL gives as -0.0."""
    rng = np.random.default_rng(11)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((60, 8)) * 1e-5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = np.array([v for _, v in sorted(con.execute(ORACLES["combat"]).fetchall())])
    got = np.array([r["vec"] for r in QUERIES["combat"](spark, str(tmp_path)).orderBy("vec_id").collect()])
    assert (np.signbit(want) & (want == 0)).sum() > 10
    assert (got == want).all() and (np.signbit(got) == np.signbit(want)).all()


def test_density_clusters_find_links_beyond_the_nearest(spark):
    """Two groups of three, all within eps of each other but not among each other's nearest: one cluster."""
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate([0.0, 0.01, 0.02, 0.5, 0.51, 0.52])], "k long, e array<double>")
    assert {r["cluster"] for r in models.density_clusters(vectors.points(df, "k", "e"), 2, 0.6, 2).collect()} == {0}


def test_sweep_stability_and_agreement(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 32)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.standard_normal((25, 2)) * 0.3 + c for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(i, x.tolist(), i % 25) for i, x in enumerate(v)], "id long, vec array<double>, lesion int").select("id", F.lit(None).cast("string").alias("label"), "vec", "lesion")
    rows = models.sweep(df, [3], [0.6, 50.0], 5).orderBy("ord").collect()
    assert [r["n_clusters"] for r in rows] == [3, 1] and rows[0]["silhouette"] > 0.7 and rows[0]["davies_bouldin"] < 0.5 and rows[1]["silhouette"] is None
    labels = models.density_clusters(df, 3, 0.6, 5)
    one = models.cut_tree(df, *models.density_tree(df, 3, [0.6, 50.0]), 0.6, 5)
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, one.collect()))
    got = models.stability(df, labels, "lesion", [1000, 1001], 3, 0.6, 5).collect()
    assert [r["n"] for r in got] == [60, 60] and all(r["ari"] > 0.8 for r in got)
    assert models.agreement(labels, labels).first()["ari"] == 1.0


def test_neighbours_far_from_the_origin_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    monkeypatch.setattr(vectors, "STRIP", 5)
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.standard_normal((40, 3)) + 1e6, np.repeat(rng.standard_normal((1, 3)), 12, axis=0) + 1e6])
    pts = vectors.points(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, e array<double>"), "k", "e")
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), 12)
    got = {}
    for r in vectors.nearest(pts, pts, 4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"]))
    for i in range(len(v)):
        want = sorted((d[i, j], j) for j in range(len(v)) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_vectors_missing_or_not_a_number(spark):
    have = spark.createDataFrame([(1, [3.0, 4.0]), (2, [float("nan"), 1.0]), (3, [0.0, 0.0]), (4, None)], "id long, v array<double>")
    assert tuple(vectors.norm_summary(have, "v").first()) == (4, 1, 1, 1, 5.0)
    assert [r["id"] for r in have.where(~vectors.has_nan(F.col("v"))).orderBy("id").collect()] == [1, 3]
    ids = spark.createDataFrame([(1,), (9,)], "id long")
    assert vectors.lookup(ids, have, "id", "v").count() == 1 and vectors.lookup(ids, have, "id", "v", "null").where("v IS NULL").count() == 1
    with pytest.raises(ValueError):
        vectors.lookup(ids, have, "id", "v", "fail")
    with pytest.raises(ValueError):
        relational.ordered_lookup(ids.withColumn("ord", F.col("id")), have, "id", "ord")
    with pytest.raises(ValueError):
        relational.single_source(have, "id", 1)


def test_sources_and_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, float("nan")), ("a", 2, 0.5)], "id string, n int, x double")  # NaN comes back as NULL
    files.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, files.csv(spark, f"{tmp_path}/csv", df.schema).collect())) == [("a", 2, 0.5), ("b", 1, None)]
    (tmp_path / "in").mkdir()
    for name, v in (("y", [1.0, 2.0]), ("x", [[3.0], [4.0]])):
        buffer = io.BytesIO()
        np.save(buffer, np.array(v, np.float16))
        (tmp_path / "in" / f"{name}.npy").write_bytes(buffer.getvalue())
    (tmp_path / "in" / "note.txt").write_text("no vector")
    assert [r["id"] for r in files.listing(spark, f"{tmp_path}/in", "*.npy", ordered=True).collect()] == ["x", "y"]
    assert files.listing(spark, f"{tmp_path}/in").count() == 3
    got = files.npy(spark, f"{tmp_path}/in")
    assert sorted(map(tuple, got.collect())) == [("x", [3.0, 4.0]), ("y", [1.0, 2.0])]
    files.write_vectors(got, f"{tmp_path}/vec")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/vec").collect())) == sorted(map(tuple, got.collect()))
    table = spark.createDataFrame([("s", "p", 3), ("t", "q", 4)], "a string, b string, n long")
    files.write_crosstab(table, f"{tmp_path}/cross", ["p", "q"])
    assert sorted(map(tuple, files.csv(spark, f"{tmp_path}/cross", "a string, p long, q long").collect())) == [("s", 3, 0), ("t", 0, 4)]
    files.write_report(spark.createDataFrame([("v", 0.5, [0.1, 0.2], True)], "name string, mean double, aris array<double>, stable boolean"), f"{tmp_path}/report", {"bootstrap": ["mean", "aris", "stable"]})
    (part,) = (tmp_path / "report").glob("part-*.json")
    assert json.loads(part.read_text()) == {"name": "v", "bootstrap": {"mean": 0.5, "aris": [0.1, 0.2], "stable": True}}
    assert files.json(spark, str(part)).first()["bootstrap"]["aris"] == [0.1, 0.2]
    patches = spark.range(60).select((F.col("id") % 5).alias("key"), F.col("id").alias("patch"), F.array(F.col("id").cast("float")).alias("vec"))
    files.write_keyed(patches, f"{tmp_path}/keyed", "key", 8)
    one = files.read_keyed(spark, f"{tmp_path}/keyed", "key", 3, 8)
    assert sorted(r["patch"] for r in one.collect()) == list(range(3, 60, 5)) and one.columns == patches.columns


def test_media(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 3)).astype(float)
    pixels = spark.createDataFrame([("i", *map(float, p)) for p in image] + [("black", 0.0, 0.0, 0.0)], "image string, r double, g double, b double")
    light = np.power(np.power(image, 6).mean(axis=0), 1 / 6)
    gain = 1 / (light / np.linalg.norm(light) * np.sqrt(3))
    gains = media.shades_of_gray(pixels, "image", ["r", "g", "b"])
    assert np.allclose(gains.where("image = 'i'").select("r", "g", "b").first(), gain) and tuple(gains.where("image = 'black'").first())[1:] == (None,) * 3
    got = media.corrected(pixels, gains, "image", ["r", "g", "b"]).where("image = 'i'").select("r", "g", "b").collect()
    assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, np.clip(image * gain, 0, 255))))
    assert media.fallback_rate(spark.createDataFrame([(True,), (False,), (None,), (True,)], "used boolean"), "used").first()[0] == 2 / 3


def test_reports_and_grids(spark):
    df = spark.createDataFrame([(2, "b", 0.2), (1, "a", 0.1)], "o int, k string, v double")
    assert relational.as_list(df, "o", "v").first()[0] == [0.1, 0.2] and relational.as_map(df, "k", "v").first()[0] == {"a": 0.1, "b": 0.2}
    many = spark.range(relational.REPORT + 1).select("id", F.lit(1).alias("v"))
    assert len(relational.as_list(many.where("id > 0"), "id", "v").first()[0]) == relational.REPORT and relational.as_list(many.limit(0), "id", "v").first()[0] == []
    for gathered in (relational.as_list, relational.as_map):
        with pytest.raises(Exception, match="report holds at most"):
            gathered(many, "id", "v").collect()
    grid = relational.grid(spark, a=[1, 2], b=["x", "y", "z"])
    assert [tuple(r) for r in grid.orderBy("ord").collect()] == [(i, 1 + i // 3, "xyz"[i % 3]) for i in range(6)]
    good, bad = relational.split_bad(spark.createDataFrame([(1, True, 5, None), (2, False, None, "why"), (3, None, 7, "?")], "id int, ok boolean, value int, reason string"), "ok", "value", "reason")
    assert [tuple(r) for r in good.collect()] == [(1, 5)] and sorted(map(tuple, bad.collect())) == [(2, "why"), (3, "?")]
    assert relational.without_noise(spark.createDataFrame([(1, -1), (2, 0), (3, None)], "id int, c int"), "c").count() == 1
    assert stats.adjusted_rand(spark.createDataFrame([], "a int, b int"), "a", "b").first()["ari"] is None


def test_not_a_number_is_no_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan,), (1.0,), (2.0,), (None,)], "x double")
    assert relational.median(df, "x").first()["median"] == 1.5
    assert sorted(r["x"] for r in relational.median_fill(df, "x").collect()) == [1.0, 1.5, 1.5, 2.0]
    assert sorted(map(tuple, relational.histogram(df, "x", 2).collect())) == [(0, 1), (1, 1)]
    rows = [(g, float(i % 7) + (g == "b")) for g in "ab" for i in range(15)]
    with_nan = spark.createDataFrame(rows + [("a", nan), ("b", nan), ("b", None)], "g string, x double")
    assert stats.kruskal(with_nan, "g", "x").first() == stats.kruskal(spark.createDataFrame(rows, "g string, x double"), "g", "x").first()


def test_points_that_are_no_numbers_leave_others_alone(spark):
    rng = np.random.default_rng(1)
    rows = [(i, str(i % 2), (rng.standard_normal(2) + 5 * (i % 2)).tolist()) for i in range(12)]
    odd = [(90, "0", [float("nan"), 1.0]), (91, "1", [float("inf"), 1.0]), (92, "1", [None, 1.0])]
    both = [vectors.points(spark.createDataFrame(r, "k long, l string, v array<double>"), "k", "v", "l") for r in (rows, rows + odd)]
    for run in (lambda p: vectors.nearest(p, p, 3), vectors.silhouette, vectors.davies_bouldin, lambda p: models.density_clusters(p, 3, 3.0, 3)):
        want, got = (sorted(map(tuple, run(p).collect())) for p in both)
        assert got == want and got


@pytest.mark.parametrize("stop,pure,want", [(0.0, 0.4, [3, 2, 1]), (0.0, 0.7, [2, 1, 0]), (0.9, 0.4, [3])])
def test_exclusion_ends_where_every_batch_is_a_candidate(spark, stop, pure, want):
    """Three batches that V never tells apart enough: the trace goes on while a batch is left."""
    rows = [(b, l) for b, l, n in (("x", "p", 80), ("x", "q", 20), ("y", "q", 90), ("y", "p", 30), ("z", "p", 60), ("z", "q", 50)) for _ in range(n)]
    trace = gates.exclusion_trace(spark.createDataFrame(rows, "b string, l string"), "b", "l", stop, pure).orderBy("step").collect()
    assert [r["candidates"] for r in trace] == want and trace[-1]["dropped"] is None
    assert [r["dropped"] for r in trace[:-1]] == sorted((r["dropped"] for r in trace[:-1]), key="yzx".index if pure < 0.6 else "yx".index)
