"""The corpus pipeline: documents in, the training mix out. Each stage is one operator of cairn.llm."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontamination, minhash_dedup, mixing, pii, quality
from cairn.llm._shared import forget, row_key, save, scratch, table, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score >= 0.7). It learns from the labelled rows of its input.

    Null texts are scored as empty; rows without an id and repeated rows are judged each by its own text."""
    with scratch(spark):
        model = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = max((c.lower() for c in docs.columns), key=len) + "_score"  # longer than any other name
    return quality.scored(docs, model, name=score).where(F.col(score) >= quality.ACCEPT).drop(score)


def _key(docs: DataFrame) -> Column:
    return row_key(docs["doc_id"], F.md5(F.coalesce(docs["text"], F.lit(""))))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more): the one with the smallest id.

    Rows without an id stay, as do null and empty texts. Rows that share an id are judged each by its own
    text, so that one can go and another stay; repeated rows share their fate."""
    with scratch(spark) as keep:
        gone = save(minhash_dedup.near_duplicates(docs, percent=80, text_key=True).where("NOT kept").select(row_key("doc_id", "text_key").alias("gone_key")).distinct())
        keep(gone)
    return without(docs, _key(docs), gone)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. Each row is judged by its own text, those without an id or with a repeated one too."""
    key = _key(docs)
    with scratch(spark) as keep:
        rows = docs.select(key.alias("row_key"), docs["text"])
        gone = save(decontamination.leaks(rows, table(spark, sf_dir, "benchmark"), id_column="row_key").select(F.col("row_key").alias("gone_key")).distinct())
        keep(gone)
    return without(docs, key, gone)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows the text.

    Null and empty texts, rows without an id and repeated rows stay as rows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, one row per row: rows without an id and repeated rows too, 0 of null and empty texts."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: No SQL says what trees, lassos and MinHash keep; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents. A stage's own scratch tables, and its input, are deleted once its output is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            out = save(stage(spark, docs, sf_dir))
            keep(out)
        forget(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
