"""Published results of the modelled protocol, recomputed. The tables and figures below."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from cairn.functions import stats
from cairn.operators import gates, relational

SOURCES = {
    "BASEL": (4, 4, 0), "ANON": (538, 614, 509), "BCN_D": (0, 0, 143), "VIENNA": (5, 3, 20), "ATHENS": (7, 6, 0), "ANRIOT": (0, 0, 4), "BCN": (0, 0, 3036), "HIBA": (0, 0, 126),
    "ICL": (77, 40, 119), "MILK": (89, 61, 550), "MSKCC": (135, 263, 77), "SYD": (6, 40, 0), "SYD_PG": (0, 18, 152), "UQ": (2, 12, 3), "VIDIR": (17, 33, 1),
}


@pytest.fixture(scope="module")
def cohort(spark):
    counts = [(s, d, n) for s, ns in SOURCES.items() for d, n in zip(("invasive", "in situ", "nos"), ns) if n]
    df = spark.createDataFrame(counts, "dataset string, diagnosis string, n int")
    return df.select("dataset", "diagnosis", F.explode(F.sequence(F.lit(1), "n")).alias("k")).withColumn("id", F.concat_ws("-", "dataset", "diagnosis", "k")).cache()


def test_confounding(cohort):
    r = gates.confounding(cohort, "dataset", "diagnosis").first()
    assert (r["n"], r["rows"], r["cols"], r["verdict"]) == (6714, 15, 3, "STOP") and math.isclose(r["v"], 0.5406240295310171, rel_tol=1e-12)


def test_exclusion(cohort):
    trace, left = gates.iterative_exclusion(cohort, "dataset", "diagnosis")
    rows = trace.orderBy("step").collect()
    assert [r["n"] for r in rows] == [6714, 3678, 2978, 2808, 2665] and [r["candidates"] for r in rows] == [5, 4, 3, 2, 1]
    assert [r["dropped"] for r in rows] == ["BCN", "MILK", "SYD_PG", "BCN_D", None]
    for r, v in zip(rows, (0.5406240295310171, 0.41930400219778036, 0.3994846646110058, 0.3709043129574246, 0.3118057454341598)):
        assert math.isclose(r["v"], v, rel_tol=1e-12)
    assert left.count() == 2665 and left.where("dataset IN ('BCN', 'MILK', 'SYD_PG', 'BCN_D')").count() == 0


def test_balanced_schemes(spark, cohort):
    got = {r["scheme"]: r for r in gates.balanced_schemes(cohort, "dataset", "diagnosis", "id").collect()}
    assert gates.SCHEMES == ((200, 400), (100, 300), (50, 200), (30, 150), (20, 100), (10, 75), (5, 50))
    assert got[4]["n"] == 2799  # sizes under caps (20, 100), whatever rows are drawn
    best = gates.choose_scheme(spark.createDataFrame(list(got.values()))).first()
    assert best["v"] < 0.35 and all(got[i]["v"] >= 0.35 for i in range(best["scheme"]))
    # the published draw under these caps
    drawn = {**SOURCES, "BCN": (0, 0, 20), "BCN_D": (0, 0, 20), "HIBA": (0, 0, 20), "MILK": (16, 8, 76), "SYD_PG": (0, 11, 89)}
    table = spark.createDataFrame([(a, str(b), n) for a, ns in drawn.items() for b, n in enumerate(ns) if n], "a string, b string, n long")
    r = stats.cramers_v(stats.chi_square(table)).first()
    assert r["n"] == 2799 and math.isclose(r["v"], 0.32722764086126177, rel_tol=1e-12)


def test_tail_probabilities(spark):
    cases = [(12.162253983750222, 3, 0.006847518871979601), (20.82421581937612, 3, 1.1450632239803355e-4), (16.615008945843105, 9, 0.05509750207899379)]
    df = spark.createDataFrame(cases, "x double, k int, p double").withColumn("got", stats.p_value(F.col("x"), F.col("k")))
    for r in df.collect():
        assert math.isclose(stats.chi2_tail(r["x"], r["k"]), r["p"], rel_tol=1e-12) and math.isclose(r["got"], r["p"], rel_tol=1e-11)
    more = [(x, k) for k in (1, 2, 5, 8, 19, 57, 200) for x in (0.01, 0.5, 3.0, 8.1, 40.0, 190.0, 900.0)]
    for r in spark.createDataFrame(more, "x double, k int").withColumn("got", stats.p_value(F.col("x"), F.col("k"))).collect():
        assert math.isclose(r["got"], stats.chi2_tail(r["x"], r["k"]), rel_tol=1e-9, abs_tol=1e-14), r


def test_row_percent(spark):
    counts = [((3, 32, 19), (5.56, 59.26, 35.19)), ((756, 912, 4687), (11.9, 14.35, 73.75)), ((26, 23, 1), (52.0, 46.0, 2.0)), ((90, 125, 31), (36.59, 50.81, 12.6))]
    table = spark.createDataFrame([(a, b, n) for a, (ns, _) in enumerate(counts) for b, n in enumerate(ns)], "a int, b int, n long")
    got = {(r["a"], r["b"]): r["percent"] for r in relational.row_percent(table).collect()}
    assert got == {(a, b): p for a, (_, ps) in enumerate(counts) for b, p in enumerate(ps)}


def test_power_guards(spark):
    """Groups of 3 and 656 values, and a single group: underpowered, with NULL statistics."""
    rows = [(0, float(i)) for i in range(3)] + [(1, float(i)) for i in range(656)]
    for data, groups in ((rows, 2), (rows[3:], 1)):
        r = stats.kruskal(spark.createDataFrame(data, "g int, x double"), "g", "x").first()
        assert (r["groups"], r["underpowered"], r["h"], r["dof"], r["p"]) == (groups, True, None, None, None)
        r = stats.chi_square_test(spark.createDataFrame([(g, str(x % 2)) for g, x in data], "g int, x string"), "g", "x").first()
        assert (r["underpowered"], r["chi2"], r["dof"], r["p"]) == (True, None, None, None)
    one = stats.chi_square_test(spark.createDataFrame([(i % 2, "x") for i in range(60)], "g int, x string"), "g", "x").first()
    assert one["underpowered"] and one["chi2"] is None


def test_noise_fraction(spark):
    labels = spark.createDataFrame([(c,) for c, n in ((1, 1553), (0, 73), (-1, 35)) for _ in range(n)], "cluster int")
    r = gates.cluster_shape(labels, "cluster").first()
    assert (r["n"], r["n_clusters"]) == (1661, 2) and math.isclose(r["noise_frac"], 0.02107164358819988)


def test_selection_takes_the_first_of_a_tie(spark):
    """Silhouettes that tie at the maximum among candidates: the first row in order wins; more noise or clusters than allowed don't count."""
    rows = [(0, 16, 0.1, 0.99), (1, 2, 0.31, 0.98), (2, 2, 0.0, 0.9015), (3, 2, 0.0, 0.9015), (4, 2, 0.0, 0.9015), (5, 3, 0.2, 0.5), (6, 1, 0.0, None)]
    best = gates.select_config(spark.createDataFrame(rows, "ord int, n_clusters int, noise_frac double, silhouette double"), "ord").first()
    assert (best["ord"], best["fallback_used"]) == (2, False)


def test_bootstrap_summary(spark):
    """Population, not sample, deviation."""
    aris = [0.9941076466595462, 0.5895181659226622, 0.9948240647012561]
    r = gates.summary(spark.createDataFrame([(x,) for x in aris], "ari double"), "ari").first()
    assert math.isclose(r["mean"], statistics.fmean(aris)) and math.isclose(r["std"], statistics.pstdev(aris)) and r["is_stable"]


METRICS = {
    "balanced": [("raw", 0.8238678763097367, 0.5403348703145847, 0.004101889207959175), ("harmony", 0.6713078200868898, 0.9176904793871097, 0.0013603538946118043), ("retry", 0.6798818042422694, 0.9003102002970474, 0.0015640202905391832)],
    "excluded": [("raw", 0.8626641651031894, 0.4928627851478409, 0.003456899430602789), ("harmony", 0.725703564727955, 0.8355909686008587, 0.0026556289592316196)],
}


def test_acceptance(spark):
    for rows, n in ((METRICS["balanced"], 15), (METRICS["excluded"], 11)):
        m = spark.createDataFrame(rows, "name string, batch_acc double, mixing double, bio_silhouette double")
        assert {r["passed"] for r in gates.accepted(m, F.lit(1 / n)).collect()} == {False}
        r = gates.with_retry(m, F.lit(1 / n), "harmony", "retry").first()
        assert (r["used"], r["passed"]) == ("harmony", False)
    good = [("raw", 0.8, 0.5, 0.1), ("harmony", 0.8, 0.9, 0.1), ("retry", 0.1, 0.9, 0.09)]
    m = spark.createDataFrame(good, "name string, batch_acc double, mixing double, bio_silhouette double")
    assert tuple(gates.with_retry(m, F.lit(1 / 15), "harmony", "retry").first()) == ("retry", True)
