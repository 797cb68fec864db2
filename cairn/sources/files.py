"""Sources and sinks: explicit schemas, path listings as columns, vectors from .npy bytes, keyed tables, nested JSON reports."""

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.operators.tables import number


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table with a header row; NaN is read as NULL, like an empty field."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*(number(F.col(f"`{c}`")).cast(kind).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))


def listing(spark: SparkSession, path: str, glob: str = "*", ordered: bool = False) -> DataFrame:
    """(id): file stems under path, from a scan that reads no content; sorted if asked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    ids = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("id"))
    return ids.orderBy("id") if ordered else ids


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) from one .npy vector a file, read in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select(F.regexp_extract("path", r"([^/]+?)\.npy$", 1).alias("id"), "content")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vec": [np.load(io.BytesIO(c), allow_pickle=False).astype(float).ravel().tolist() for c in b["content"]]})

    return files.mapInPandas(run, "id string, vec array<double>")


def json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Parquet instead of one array file a row."""
    df.write.mode("overwrite").parquet(path)


def write_crosstab(table: DataFrame, path: str, columns: list) -> None:
    """A long table (a, b, n) as a wide CSV: its rows' names, and a column of counts for each of `columns` (0 where none)."""
    write_csv(table.groupBy("a").pivot("b", columns).agg(F.sum("n")).fillna(0), path)


def write_report(df: DataFrame, path: str, sections: dict[str, list[str]]) -> None:
    """One row as nested JSON: columns stay on top but those of `sections`, which become objects of that name."""
    inner = {c for columns in sections.values() for c in columns}
    write_json(df.select(*(c for c in df.columns if c not in inner), *(F.struct(*columns).alias(name) for name, columns in sections.items())).coalesce(1), path)


def write_keyed(df: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Parquet in folders by a hash of the key, so that rows of one key are found without reading the rest."""
    df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_keyed(spark: SparkSession, path: str, key: str, value, parts: int = 64) -> DataFrame:
    """The rows of one key of what write_keyed wrote with the same `parts`: one folder is read."""
    table = spark.read.parquet(path)
    wanted = F.lit(value).cast(table.schema[key].dataType)
    return table.where((F.col("part") == _part(spark, wanted, parts)) & (F.col(key) == wanted)).drop("part")


def _part(spark: SparkSession, value: Column, parts: int) -> int:
    return spark.range(1).select(F.pmod(F.xxhash64(value), F.lit(parts))).first()[0]
