"""Scratch tables, joins on hot keys, ranks without a global sort, and connected components."""

import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder. Where none is named, local mode takes a temporary one; a cluster is refused, as its workers share no such folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_saved: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_scopes: list[list[str]] = []


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _saved[out] = path
    for scope in _scopes:
        scope.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*saved: DataFrame) -> None:
    """Delete what save() wrote of these tables, which no plan may read any more; other tables are left alone."""
    for df in saved:
        if path := _saved.pop(df, None):
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession):
    """Within it, all that save() writes is noted, and deleted at the end but for the tables given to the yielded function."""
    mine: list[str] = []
    kept: set[str] = set()
    _scopes.append(mine)
    try:
        yield lambda *tables: kept.update(_saved[t] for t in tables if t in _saved)
    finally:
        _scopes.pop()
        for path in mine:
            if path not in kept:
                _delete(spark, path)


def dealt_join(df: DataFrame, facts: DataFrame, key: str, row: str | Column, how: str = "inner") -> DataFrame:
    """df joined with facts, which hold few rows per key. The rows of a key are dealt over all shuffle
    partitions by a hash of `row`, and a fact goes only where its key has rows, so no key meets in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("deal_", F.pmod(F.xxhash64(F.lit(7), row), F.lit(parts)))
    held = dealt.select(key, "deal_").distinct().join(facts, key)
    return dealt.join(held, [key, "deal_"], how).drop("deal_")


def before(df: DataFrame, order: str, weight: Column, name: str = "before", more: dict[str, Column] | None = None) -> DataFrame:
    """df, whose `order` is not null and unique, with the sum of weight over all rows of a smaller `order`; more: further sums by name.

    The input runs once: it is dealt into ranges of `order` and saved. One row of sums for each range meets in one task."""
    weights = {name: weight, **(more or {})}
    own = df.select("*", *(w.alias(f"weight_{i}") for i, w in enumerate(weights.values())))
    ranged = save(own.repartitionByRange(F.col(order)).withColumn("range_", F.spark_partition_id()))
    sums = ranged.groupBy("range_").agg(*(F.sum(f"weight_{i}").alias(f"sum_{i}") for i in range(len(weights))))
    running = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shuffle partition at most
    starts = sums.select("range_", *(F.coalesce(F.sum(f"sum_{i}").over(running), F.lit(0)).alias(f"start_{i}") for i in range(len(weights))))
    inside = Window.partitionBy("range_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "range_")
    return out.select(*df.columns, *((F.col(f"start_{i}") + F.coalesce(F.sum(f"weight_{i}").over(inside), F.lit(0))).alias(n) for i, n in enumerate(weights)))


def number(column: str | Column) -> Column:
    """A numeric column as doubles, NaN as NULL."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(x), x)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Min-label hooking with pointer jumping. Every round works on edges between labels only, so that
    what is settled drops out; a round at least halves the labels that still have an edge, and only
    the count of those edges reaches the driver."""
    edges = save(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = save(nodes.withColumn("component", F.col("node")))
    live = edges
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = save(both.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("low")).select("label", F.least("label", "low").alias("parent"), F.lit(True).alias("moved")))
        while not parent.where("moved").isEmpty():
            up = parent.select(F.col("label").alias("parent"), F.col("parent").alias("next"))
            jumped = save(parent.drop("moved").join(up, "parent").select("label", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
            forget(parent)
            parent = jumped
        moved = save(labels.join(parent.select(F.col("label").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        pa_, pb = (parent.select(F.col("label").alias(x), F.col("parent").alias(f"{x}_")) for x in "ab")
        left = save(live.join(pa_, "a").join(pb, "b").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).where("a <> b").distinct())
        forget(parent, labels, live)
        labels, live = moved, left
    forget(live)
    return labels
