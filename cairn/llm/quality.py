"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on statistics of labelled texts, every path from a root becomes a conjunctive rule,
lasso logistic regression weighs the rules, and those with a weight are compiled into one Spark column
expression. Statistics are counted over whole texts by an Arrow function; scoring is then a projection,
without a join or shuffle."""

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._shared import one_label, save, scratch, session, slices, table, utf8, word_hashes, words

#: At most so many labelled rows are fitted on, taken by a hash of the id.
SAMPLE = 20_000
TREES, DEPTH, LASSO, ACCEPT = 20, 3, 0.0005, 0.7


STATISTICS = ("upper", "symbols", "digits", "repeats", "distinct", "word_length", "stops", "lines", "long_words", "log_words")
_UPPER, _LETTER, _SYMBOL, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_DIGIT[48:58] = _STOP[[33, 46, 63]] = True


def statistics(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """STATISTICS of whole UTF-8 texts that lie one after another, each linear in the texts' bytes."""

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[off[1:]] - total[off[:-1]]).astype(np.float64)

    accented = np.zeros(len(raw), bool)
    if len(raw) > 1:
        accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    starts, ends, first = words(raw, off)
    hashes = word_hashes(raw, starts, ends)
    of = np.repeat(np.arange(len(off) - 1), np.diff(first))
    n = np.maximum(np.diff(first), 1).astype(np.float64)
    same = np.zeros(len(of), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(of), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[1:] != of[:-1])
    per = lambda mask: np.bincount(of[mask], minlength=len(off) - 1)
    letters, size = np.maximum(count(_LETTER[raw]), 1), np.maximum(np.diff(off), 1)
    return [
        count(_UPPER[raw] | accented) / letters, count(_SYMBOL[raw]) / size, count(_DIGIT[raw]) / size, per(same) / n, per(new) / n,
        letters / n, count(_STOP[raw]) / n, count(raw == 10) / n, per(ends - starts >= 20) / n, np.log1p(n),
    ]


def with_statistics(docs: DataFrame, text_column: str) -> DataFrame:
    """(row_, *STATISTICS): the rows of docs as structs, with the statistics of their texts; a null text is empty."""
    session(docs)

    def run(batches):
        for batch in batches:
            rows = batch.column("row_")
            texts = pa.RecordBatch.from_arrays([rows.field(text_column), pa.array(range(len(rows)))], ["text", "at"])
            for part in slices(texts, "text"):
                own = rows.slice(part.column("at")[0].as_py(), part.num_rows)
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, statistics(*utf8(part.column("text"))))], ["row_", *STATISTICS])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(x, T.DoubleType()) for x in STATISTICS)]))


_TEST = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.eE+]+)\)")


def rules(debug: str) -> list[tuple[tuple[str, str, float], ...]]:
    """The distinct paths of a forest, of any length, as conjunctions of (statistic, comparison, value)."""
    found, path = {}, []
    for line in debug.splitlines():
        if m := _TEST.search(line):
            depth = len(line) - len(line.lstrip())
            path = [(d, t) for d, t in path if d < depth] + [(depth, (STATISTICS[int(m[2])], m[3], float(m[4])))]
            found[tuple(t for _, t in path)] = None
        elif "Tree " in line:
            path = []
    return list(found)


def _holds(rule) -> Column:
    out = None
    for name, test, value in rule:
        one = F.col(name) <= value if test == "<=" else F.col(name) > value
        out = one if out is None else out & one
    return out


def fit(labelled: DataFrame, label: str) -> tuple[float, list[tuple[float, tuple]]]:
    """Intercept and weighted rules from rows of STATISTICS and a 0/1 label. Without two classes, no rules."""
    n, ones = labelled.agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    if not n or not ones or ones == n:
        return (4.0 if n and ones else -4.0 if n else 0.0), []
    rows = labelled.select(array_to_vector(F.array(*STATISTICS)).alias("features"), F.col(label).cast("double").alias("label"), *STATISTICS)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=1, subsamplingRate=0.7, featureSubsetStrategy="onethird", maxBins=64).fit(rows.select("features", "label"))
    found = rules(forest.toDebugString)
    if not found:
        return 0.0, []
    hits = rows.select(array_to_vector(F.array(*(F.when(_holds(r), 1.0).otherwise(0.0) for r in found))).alias("features"), "label")
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(save(hits))
    return float(model.intercept), [(float(w), r) for w, r in zip(model.coefficients.toArray(), found) if abs(w) > 1e-6]


def compiled(model) -> Column:
    """The probability of label 1 as one column expression over STATISTICS."""
    out = F.lit(model[0])
    for weight, rule in model[1]:
        out = out + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-out))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text_column: str = "text"):
    """The rule model of labelled documents: at most SAMPLE rows or so, chosen by a hash of the id, texts whole.

    Of conflicting labels of one id the least counts; rows without an id or label teach nothing, null texts
    are empty, rows that share an id each count. Empty tables give a model without rules."""
    marked = one_label(labels, label, id_column)
    n = marked.count()
    part = F.pmod(F.xxhash64(F.lit("quality"), F.col(id_column)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(n, 1)))
    sample = docs.select(id_column, text_column).join(marked.where(part), id_column)
    return fit(save(with_statistics(sample, text_column).select("row_.label_", *STATISTICS)), "label_")


def scored(docs: DataFrame, model, text_column: str = "text", name: str = "score_") -> DataFrame:
    """docs with the score, from 0 to 1, added as `name` (a column of that name is replaced); other columns stay. Null texts are scored as empty."""
    return with_statistics(docs.drop(name), text_column).select("row_.*", compiled(model).alias(name))


def fold(id_column: str, parts: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod 4 is 2 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        model = learn(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= ACCEPT).cast("int").alias("predicted"))
