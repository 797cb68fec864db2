"""Association and rank statistics as aggregates of aggregates; no dense pivot, no driver loop over rows."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.tables import before, dealt_join, number, save


def crosstab(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Long contingency table (*by, a, b, n); rows with a missing key are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def chi_square(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (*by, n, rows, cols, chi2, dof) of each long table; Yates' correction for 2 x 2 only.

    Margins are sums of saved cells, joined to them so that no label's cells meet in one task. In a 2 x 2 table
    every cell is as far from its expectation as any other, so that one cell tells the correction."""
    saved = save(table.select(*by, "a", "b", "n"))
    cells = saved
    for side, other, total in (("a", "b", "r"), ("b", "a", "c")):
        key = F.struct(*by, side)
        sums = saved.groupBy(key.alias("key_")).agg(F.sum("n").alias(total), F.min(other).alias("first_"))
        cells = dealt_join(cells.withColumn("key_", key), sums, "key_", other).withColumn(f"new_{total}", F.col("first_") == F.col(other)).drop("key_", "first_")
    part = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.when(F.col("new_r"), 1)).alias("rows"), F.count(F.when(F.col("new_c"), 1)).alias("cols"),
        F.sum(F.col("n").cast("double") * F.col("n") / (F.col("r").cast("double") * F.col("c"))).alias("s"),
        F.max(F.struct("r", "c", F.col("n").alias("m"))).alias("cell"),
    )
    n, r, c = F.col("n").cast("double"), F.col("cell.r").cast("double"), F.col("cell.c").cast("double")
    off = F.abs(F.col("cell.m") - r * c / n)
    yates = F.pow(F.greatest(off - F.least(F.lit(0.5), off), F.lit(0.0)), 2) * F.pow(n, 3) / (r * (n - r) * c * (n - c))
    chi = F.when((F.col("rows") == 2) & (F.col("cols") == 2), yates).otherwise(n * (F.col("s") - 1))
    return part.select(*by, "n", "rows", "cols", chi.alias("chi2"), ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"))


def cramers_v(stat: DataFrame) -> DataFrame:
    """stat with v = sqrt(chi2 / (n * (min(rows, cols) - 1))); NULL where a side has one level."""
    k = F.least("rows", "cols") - 1
    return stat.withColumn("v", F.when(k > 0, F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("n") * k))))


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x), in closed form for integer k."""
    if x <= 0:
        return 1.0
    if k % 2 == 0:
        return math.fsum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(k // 2))
    terms, log_odd = [], 0.0
    for i in range((k - 1) // 2):
        log_odd += math.log(2 * i + 1)
        terms.append(math.exp(0.5 * math.log(2 * x / math.pi) - x / 2 + i * math.log(x) - log_odd))
    return math.erfc(math.sqrt(x / 2)) + math.fsum(terms)


def _erfc(z: Column) -> Column:
    """The complementary error function of z >= 0: a series of positive terms under 2, a continued fraction from 2 on."""
    square = z * z
    step = lambda s, i: F.struct((s["term"] * 2 * square / (2 * i + 1)).alias("term"), (s["sum"] + s["term"] * 2 * square / (2 * i + 1)).alias("sum"))
    start = F.struct(z.alias("term"), z.alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), F.lit(1.0), lambda t, i: 1 + i / (2 * square) / t)
    return F.when(z < 2, 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * series).otherwise(F.exp(-square) / (z * math.sqrt(math.pi)) / fraction)


def p_value(x: Column, dof: Column) -> Column:
    """P(chi-square with dof degrees of freedom > x) as a column; 1 for x <= 0, NULL for dof < 1 or NULL x."""
    x, k = x.cast("double"), dof.cast("int")
    odd = k % 2
    n = (k - odd) / 2  # terms of the sum
    first = F.when(odd == 1, 0.5 * F.log(2 * x / math.pi) - x / 2).otherwise(-x / 2)
    state = F.struct(first.alias("log"), F.lit(0.0).alias("sum"))
    added = lambda s, i: F.struct((s["log"] + F.when(odd == 1, F.log(x) - F.log(2 * i + 1)).otherwise(F.log(x / 2) - F.log(i))).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum"))
    total = F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), state, added, lambda s: s["sum"])
    tail = total + F.when(odd == 1, _erfc(F.sqrt(x / 2))).otherwise(0.0)
    return F.when(k < 1, None).when(x <= 0, 1.0).when(x.isNotNull(), tail)


def kruskal(df: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    """One row (groups, n, h, dof, underpowered, p): H with average ranks and tie correction over all groups.

    With fewer than two groups of at least `least` values the test is underpowered, and h, dof and p are
    NULL, as they are where all values are equal. Ranks come from counts of distinct values, within ranges; NULL and NaN are no values."""
    own = df.select(F.col(group).alias("g"), number(value).alias("x")).where("g IS NOT NULL AND x IS NOT NULL")
    counts = save(own.groupBy("x", "g").agg(F.count("*").alias("n")))
    values = counts.groupBy("x").agg(F.sum("n").alias("t"))
    ranked = before(values, "x", F.col("t")).select("x", "t", (F.col("before") + (F.col("t") + 1) / 2).alias("rank"))
    tie = F.when(F.min("g").over(Window.partitionBy("x")) == F.col("g"), F.pow(F.col("t").cast("double"), 3) - F.col("t")).otherwise(0.0)
    cells = counts.join(ranked, "x").withColumn("tie", tie)
    sums = cells.groupBy("g").agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("m"), F.sum("tie").alias("ties"))
    total = sums.agg(F.count("*").alias("groups"), F.sum("m").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("ties").alias("ties"), F.count(F.when(F.col("m") >= least, 1)).alias("able"))
    n = F.col("n").cast("double")
    spread = 1 - F.col("ties") / (F.pow(n, 3) - n)
    able = (F.col("able") >= 2) & (F.col("ties") < F.pow(n, 3) - n)
    out = total.select("groups", "n", F.when(able, (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / spread).alias("h"), F.when(F.col("able") >= 2, F.col("groups") - 1).alias("dof"), (F.col("able") < 2).alias("underpowered"))
    return out.withColumn("p", p_value(F.col("h"), F.col("dof")))


def chi_square_test(df: DataFrame, group: str, label: str, least: int = 10) -> DataFrame:
    """One row (groups, n, chi2, dof, underpowered, p): underpowered, with NULL statistics, where fewer than two
    groups hold `least` labels or the table has fewer than two rows or columns."""
    table = crosstab(df, group, label)
    power = table.groupBy("a").agg(F.sum("n").alias("m")).agg(F.count(F.when(F.col("m") >= least, 1)).alias("able"))
    able = (F.col("able") >= 2) & (F.col("rows") >= 2) & (F.col("cols") >= 2)
    both = chi_square(table).crossJoin(F.broadcast(power))  # one row each
    out = both.select(F.col("rows").alias("groups"), F.coalesce("n", F.lit(0)).alias("n"), F.when(able, F.col("chi2")).alias("chi2"), F.when(able, F.col("dof")).alias("dof"), (~able).alias("underpowered"))
    return out.withColumn("p", p_value(F.col("chi2"), F.col("dof")))


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, ari), one row a group; labels of noise count like any other; 1 where the denominator is 0.

    Cells and both margins are sums over one table, so that no label's cells meet in one task."""
    cells = crosstab(df, a, b, by)
    none = lambda c: F.lit(None).cast(cells.schema[c].dataType)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("x"), y.alias("y")) for k, x, y in (("s", F.col("a"), F.col("b")), ("sa", F.col("a"), none("b")), ("sb", none("a"), F.col("b")))))
    sums = cells.select(*by, "n", F.explode(kinds).alias("k")).groupBy(*by, "k.kind", "k.x", "k.y").agg(F.sum("n").alias("n"))
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, _pairs(F.col("n"))).otherwise(0.0)).alias(kind)
    s = sums.groupBy(*by).agg(F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("n"), one("s"), one("sa"), one("sb"))
    expected = F.when(F.col("n") > 1, F.col("sa") * F.col("sb") / _pairs(F.col("n"))).otherwise(0.0)
    bottom = (F.col("sa") + F.col("sb")) / 2 - expected
    return s.select(*by, "n", F.when(F.abs(bottom) < 1e-12, 1.0).otherwise((F.col("s") - expected) / bottom).alias("ari"))


def purity(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, purity): the share of the commonest label of each group."""
    return crosstab(df, group, label).groupBy(F.col("a").alias(group)).agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("purity"))


def gate(v: Column, stop: float = 0.35, caveat: float = 0.20) -> Column:
    """The verdict on an association v; one that can't be told (NULL) stops nothing."""
    return F.when(v >= stop, "STOP").when(v >= caveat, "PROCEED_WITH_CAVEAT").otherwise("PROCEED")
