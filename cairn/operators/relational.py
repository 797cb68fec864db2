"""Cohort filters, category handling, counts and histograms as declarative plans."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.tables import before, dealt_join, number

#: Levels that a display table (dense crosstab, one column a level) may have.
LEVELS = 10_000
#: Most rows that a report gathers in one row.
REPORT = 10_000


def cohort(meta: DataFrame, present: DataFrame, key: str, where: Column) -> DataFrame:
    """Rows that meet `where` and whose key is in `present`; the cheap predicate is applied before the semi-join."""
    return meta.where(where).join(present.select(key).distinct(), key, "left_semi")


def single_source(df: DataFrame, key: str, value, least: int = 100) -> DataFrame:
    """Rows of one source; an error unless there are more than `least` of them."""
    own = df.where(F.col(key) == value)
    n = own.limit(least + 1).count()
    if n <= least:
        raise ValueError(f"only {n} rows of {value!r}, more than {least} are needed")
    return own


def without_noise(df: DataFrame, cluster: str) -> DataFrame:
    """Rows in a cluster: neither noise (-1) nor without a label."""
    return df.where(F.col(cluster) != -1)


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row of counts: total and what is left after each stage, in one pass."""
    kept, aggs = F.lit(True), [F.count("*").alias("total")]
    for name, test in stages:
        kept = kept & F.coalesce(test, F.lit(False))
        aggs.append(F.count(F.when(kept, 1)).alias(name))
    return df.agg(*aggs)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n, fraction), NULL left out."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total_"))
    return n.join(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total_")).alias("fraction"))


def filled_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n): non-null values of each group; groups without any have 0."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"))


def levels(df: DataFrame, key: str) -> list:
    """The sorted distinct values of a key that names rows or columns of a display table; an error if there are more than LEVELS."""
    found = [r[0] for r in df.where(F.col(key).isNotNull()).select(key).distinct().limit(LEVELS + 1).collect()]
    if len(found) > LEVELS:
        raise ValueError(f"more than {LEVELS} levels of {key}; keep the table long")
    return sorted(found)


def row_fractions(table: DataFrame) -> DataFrame:
    """A long table (a, b, n) made dense, with each cell's fraction of its row."""
    rows = table.groupBy("a").agg(F.sum("n").alias("row_n"), F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("cells"))
    columns = levels(table, "b")
    wide = rows.withColumn("b", F.explode(F.array(*map(F.lit, columns)))) if columns else rows.withColumn("b", F.lit(None))
    n = F.coalesce(F.try_element_at("cells", F.col("b")), F.lit(0))
    return wide.select("a", "b", n.alias("n"), (n / F.col("row_n")).alias("fraction"))


def row_percent(table: DataFrame) -> DataFrame:
    """A long table (a, b, n) made dense, with each cell's percentage of its row to 2 places, half to even."""
    return row_fractions(table).select("a", "b", "n", F.bround(F.col("fraction") * 100, 2).alias("percent"))


def top_k_or_other(df: DataFrame, key: str, k: int, other: str = "Other") -> DataFrame:
    """df with `bucket`: the key if among the k commonest (ties by key), else `other`, as are NULLs."""
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k).select(key, F.lit(True).alias("top"))
    return df.join(F.broadcast(top), key, "left").withColumn("bucket", F.when(F.col("top"), F.col(key)).otherwise(other)).drop("top")


def merge_small(df: DataFrame, key: str, least: int, missing: str = "Anonymous", other: str = "Other") -> DataFrame:
    """df with `batch`: NULL becomes `missing` first, then groups under `least` rows become `other`."""
    own = df.withColumn("batch", F.coalesce(key, F.lit(missing)))
    small = own.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") < least).select("batch", F.lit(True).alias("small"))
    row = F.struct(F.lit(0), *(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind))  # maps have no hash
    return dealt_join(own, small, "batch", row, "left").withColumn("batch", F.when(F.col("small"), other).otherwise(F.col("batch"))).drop("small")


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rate, missing) of each column, from one pass."""
    one = df.agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(f"r{i}") for i, c in enumerate(columns)), *(F.sum(F.col(c).isNull().cast("int")).alias(f"m{i}") for i, c in enumerate(columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("rate"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)))).alias("x")).select("x.*")


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n) of equal bins, the last closed on both sides; values outside a given range are dropped, as are NULL and NaN."""
    own = df.select(number(value).alias("x")).where("x IS NOT NULL")
    if low is None or high is None:
        low, high = own.agg(F.min("x"), F.max("x")).first()
        if low is None:
            low, high = 0.0, 1.0
    width = (high - low) / bins or 1.0
    return own.where(F.col("x").between(low, high)).groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """(size, n_groups): a count of counts."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b, both) of distinct non-null keys in the first columns of a and b."""
    x, y = (d.select(F.col(d.columns[0]).alias("key")).where("key IS NOT NULL").distinct().withColumn(n, F.lit(1)) for d, n in ((a, "a"), (b, "b")))
    return x.join(y, "key", "full").agg(F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"))


def codes(df: DataFrame, key: str) -> DataFrame:
    """(key, code): codes of the sorted distinct non-null values, from 0."""
    own = df.where(F.col(key).isNotNull()).select(key).distinct()
    return before(own, key, F.lit(1), "code").withColumn("code", F.col("code").cast("int"))


def one_hot(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """df with an int column for each sorted level but the first; NULL is the first level."""
    return df.select("*", *(F.coalesce((F.col(key) == x).cast("int"), F.lit(0)).alias(f"{prefix}{x}") for x in levels(df, key)[1:]))


def median(df: DataFrame, column: str) -> DataFrame:
    """One row (median): the exact one, from counts of distinct values in ranges; NULL and NaN are no values; NULL without values."""
    values = df.select(number(column).alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("t"))
    total = values.agg(F.sum("t").alias("total"))
    at = before(values, "x", F.col("t")).join(F.broadcast(total))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("t"))
    return at.agg(((F.max(F.when(holds(low), F.col("x"))) + F.max(F.when(holds(high), F.col("x")))) / 2).alias("median"))


def median_fill(df: DataFrame, column: str) -> DataFrame:
    """df with NULLs and NaNs of a numeric column replaced by its exact median."""
    mid = median(df, column).withColumnRenamed("median", "median_")
    return df.join(F.broadcast(mid)).withColumn(column, F.coalesce(number(column), "median_")).drop("median_")


def missing_keys(ids: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return ids.join(have.select(key).distinct(), key, "left_anti")


def require_none(missing: DataFrame, what: str) -> None:
    n = missing.count()
    if n:
        raise ValueError(f"{n} {what}")


def ordered_lookup(ids: DataFrame, facts: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of facts for the keys of ids, with ids' columns, in the order of ids' `order`; an error if a key has none."""
    require_none(missing_keys(ids, facts, key), "keys have no row")
    return ids.join(facts, key).orderBy(order)


def pivot_grid(df: DataFrame, index: str, column: str, values: Sequence, cell: str, rows: Sequence | None = None) -> DataFrame:
    """A dense display grid with a column for each of `values` and, where given, a row for each of `rows`; gaps are NULL."""
    grid = df.groupBy(index).pivot(column, list(values)).agg(F.first(cell, ignorenulls=True))
    if rows is None:
        return grid
    axis = df.sparkSession.createDataFrame([(x,) for x in rows], f"`{index}` {df.schema[index].dataType.simpleString()}")
    return axis.join(grid, index, "left")


def unnested(df: DataFrame, column: str, outer: str = "outer", inner: str = "inner", value: str = "value") -> DataFrame:
    """(outer, inner, value) of a map of maps."""
    return df.select(F.explode(column).alias(outer, "in_")).select(outer, F.explode("in_").alias(inner, value))


def _report(df: DataFrame, entries: Column, values: Column) -> DataFrame:
    """One row (values) made from all rows of a report; more than REPORT of them are an error, found before they meet in a row."""
    few = df.limit(REPORT + 1).agg(F.count("*").alias("n_"), F.array_sort(F.collect_list(entries)).alias("entries_"))
    return few.select(F.when(F.col("n_") <= REPORT, values).otherwise(F.raise_error(F.lit(f"a report holds at most {REPORT} rows"))).alias("values"))


def as_list(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row (values): the values by `order`, of at most REPORT rows."""
    return _report(df, F.struct(F.col(order).alias("o"), F.col(value).alias("v")), F.transform("entries_", lambda s: s["v"]))


def as_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row (values): a map by key, keys as strings, in their order, of at most REPORT rows."""
    return _report(df, F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v")), F.map_from_entries("entries_"))


def grid(spark, **axes: Sequence) -> DataFrame:
    """(ord, *axes): all combinations of a few literal values, the last axis fastest, with their ordinal."""
    out = spark.range(1).select(F.lit(0).alias("ord"))
    for name, values in axes.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("pos_", name)).withColumn("ord", F.col("ord") * len(values) + F.col("pos_")).drop("pos_")
    return out


def split_bad(df: DataFrame, ok: str, value: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose step went well, without the flag and reason, and the others, without the value. A NULL flag is a failure."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return df.where(good).drop(ok, reason), df.where(~good).drop(ok, value)
