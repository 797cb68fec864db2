"""The fuzzy neighbour graph of points (McInnes, Healy and Melville, UMAP), and a spectral layout of it."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.passes import total
from cairn.operators.sampling import order_key
from cairn.operators.tables import save
from cairn.operators.vectors import nearest

#: Halvings of the search for a bandwidth, and the least bandwidth as a share of the mean distance.
HALVINGS, LEAST = 64, 1e-3


def bandwidth(distances: Column, rho: Column, target: float) -> Column:
    """The width at which the memberships exp(-max(0, d - rho) / width) of an array of distances add up to target, by halving."""
    sums = lambda width: F.aggregate(distances, F.lit(0.0), lambda s, d: s + F.exp(-F.greatest(d - rho, F.lit(0.0)) / width))
    start = F.struct(F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(1.0).alias("at"))

    def halved(s: Column, _: Column) -> Column:
        over = sums(s["at"]) > target
        low, high = F.when(over, s["low"]).otherwise(s["at"]), F.when(over, s["at"]).otherwise(s["high"])
        at = F.when(high == float("inf"), s["at"] * 2).otherwise((low + high) / 2)
        return F.struct(low.alias("low"), high.alias("high"), at.alias("at"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halved, lambda s: s["at"])


def fuzzy_graph(points: DataFrame, k: int) -> DataFrame:
    """(a, b, w), a < b: the union of the fuzzy sets of each point's k nearest others, both ways at most once.

    A neighbour at the least distance over 0 is a member for sure; others by how far beyond it they are, over a width
    of the point's own, at which memberships add up to log2(k). Points without another are on no edge."""
    near = save(nearest(points, points, k))
    by = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor", "distance"))).alias("near"))  # k rows a point
    d = F.transform("near", lambda x: x["distance"])
    mean = near.agg(F.avg("distance").alias("all_"))
    known = by.select("id", "near", d.alias("d"), F.coalesce(F.array_min(F.filter(d, lambda x: x > 0)), F.lit(0.0)).alias("rho")).join(F.broadcast(mean))  # one row
    own = F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")
    width = F.greatest(bandwidth(F.col("d"), F.col("rho"), math.log2(k) if k > 1 else 1.0), LEAST * F.when(F.col("rho") > 0, own).otherwise(F.col("all_")))
    each = known.withColumn("width", width).select("id", "rho", "width", F.explode("near").alias("x")).select("id", "x.neighbor", "x.distance", "rho", "width")
    beyond = F.col("distance") - F.col("rho")
    w = F.when((beyond <= 0) | (F.col("width") == 0), 1.0).otherwise(F.exp(-beyond / F.col("width")))
    sides = each.select(F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b"), w.alias("w"))
    union = F.sum("w") - F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0)
    return sides.groupBy("a", "b").agg(union.alias("w"))


def spectral_layout(edges: DataFrame, k: int, rounds: int = 40) -> DataFrame:
    """(id, vec): the k leading directions of the graph's normalised weights after the trivial one, by orthogonal iteration.

    Each round is one join of the edges with the vectors of their ends; the driver gets (k + 1) * (k + 1) sums. Signs and,
    for directions alike in weight, turns are arbitrary; how far it has come depends on rounds."""
    half = edges.select(F.col("a").alias("id"), F.col("b").alias("of"), "w").union(edges.select(F.col("b").alias("id"), F.col("a").alias("of"), "w"))
    degree = save(half.groupBy("id").agg(F.sum("w").alias("degree")))
    ends = [degree.select(F.col("id").alias(x), F.sqrt("degree").alias(f"root_{x}")) for x in ("id", "of")]
    links = save(half.join(ends[0], "id").join(ends[1], "of").select("id", "of", (F.col("w") / (F.col("root_id") * F.col("root_of"))).alias("w")))
    size = k + 1
    seeded = [((F.conv(F.substring(order_key(i, "id"), 1, 8), 16, 10).cast("double") / 2**31) - 1).alias("x") for i in range(k)]
    at = degree.select("id", F.array(F.sqrt("degree"), *seeded).alias("v"))  # the first is the trivial direction

    def turned(rows: DataFrame) -> DataFrame:
        def kernel(pdf: pd.DataFrame) -> np.ndarray:
            v = np.stack(pdf["v"].to_numpy())
            return (v.T @ v).ravel()

        gram = total(rows, kernel, size * size).reshape(size, size)
        turn = np.linalg.inv(np.linalg.cholesky(gram + 1e-14 * np.trace(gram) * np.eye(size))).T  # keeps the order of directions

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"id": pdf["id"], "v": list(np.stack(pdf["v"].to_numpy()) @ turn)})

        return save(rows.mapInPandas(run, "id long, v array<double>"))

    at = turned(save(at))
    for _ in range(rounds):
        met = links.join(at.withColumnRenamed("id", "of"), "of")
        sums = met.groupBy("id").agg(*(F.sum(F.col("w") * F.col("v")[i]).alias(f"x{i}") for i in range(size)))
        moved = sums.join(at, "id").select("id", F.array(*((F.col(f"x{i}") + F.col("v")[i]) / 2 for i in range(size))).alias("v"))  # all weights made positive
        at = turned(save(moved))
    return at.select("id", F.slice("v", 2, k).alias("vec"))
