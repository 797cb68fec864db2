"""Toxicity by weak supervision.

The labelled texts are dealt into disjoint sources, and each source makes lexicons of its own: words, and
stems, that its toxic texts favour. Lexicon voters (a word's and a stem's for each source) and pattern
voters (how many words, how dense the stems are, shouting) vote on every text of the learning fold. A
generative model estimates by expectation-maximisation, from the vote patterns alone, each voter's rates in
toxic and other texts, and from the correlations that remain between voters how much of each vote is new.
A linear classifier over the words and stems of texts is trained on its posterior labels; labels reach it
through the lexicons, and through the choice of its shrinkage by parts of the learning rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._shared import one_label, save, scratch, session, slices, table
from cairn.llm.quality import fold

#: Labelled texts that lexicons are made from and texts with a posterior that the classifier is fitted on, by a hash of the id.
SAMPLE, FITTED, ACCEPT = 15_000, 15_000, 0.7
#: Disjoint parts of the labelled texts.
SOURCES = 3
_WORDS = re.compile(r"[^\W\d_]+")
#: Letters of a stem; a stem is written with a star.
STEMS = range(3, 9)
#: How many times as often a term must be used in toxic texts, in what share of them, and from what ratio of uses a word is sure.
ODDS, SEEN, SURE = 20, 0.01, 50
#: Shares of a text's words that begin with a lexicon stem, from which voters vote.
DENSE = (0.012, 0.025)
#: Words that a text is taken to have at least where shares are told, so that one word of a short text is not dense.
SHORT = 100
VOTERS = 2 * SOURCES + 5
#: Shrinkages that are tried, and parts of the learning rows of which each is scored by models of the others.
SHRINKAGES, PARTS = (1e-4, 1e-5, 1e-3, 1e-6), 2


#: Bytes of text whose terms a task counts at once, as a term takes far more memory than its letters.
COUNT_BYTES = 1 << 19


def _counted(batches):
    """For each slice of texts, of each source, word and stem: occurrences in toxic and in other texts, and toxic texts."""
    for batch in batches:
        for part in slices(batch, "text", COUNT_BYTES):
            counts: dict[tuple[int, str], list[int]] = {}
            for text, mark, source in zip(*(part.column(c).to_pylist() for c in ("text", "label", "source"))):
                own = Counter(_WORDS.findall((text or "").lower()))
                terms = Counter({"": sum(own.values())})
                for w, n in own.items():
                    terms[w] += n
                    for k in STEMS[: max(0, len(w) - STEMS[0])]:
                        terms[w[:k] + "*"] += n
                for t, n in terms.items():
                    c = counts.setdefault((source, t), [0, 0, 0])
                    c[0 if mark else 1] += n
                    c[2] += mark
            rows = [(s, t, *c) for (s, t), c in counts.items()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["source", "term", "yes", "no", "texts"])


def lexicons(marked: DataFrame) -> dict[int, set[str]]:
    """Of rows (text, label, source): the terms of each source that its toxic texts use ODDS times as often or more.

    All terms that pass are taken; they are as few as SEEN of the toxic texts of a bounded sample allow.
    Words are only sure ones: that other texts hardly use and that no doubtful stem explains."""
    counts = save(marked.mapInArrow(_counted, "source int, term string, yes long, no long, texts long").groupBy("source", "term").agg(*(F.sum(c).alias(c) for c in ("yes", "no", "texts"))))
    out: dict[int, set[str]] = {}
    for r in counts.where("term = ''").collect():
        if not r["yes"] or not r["no"]:
            continue
        odds = F.log((F.col("yes") + 0.1) / r["yes"]) - F.log((F.col("no") + 0.5) / r["no"])
        enough = max(3, math.ceil(r["texts"] * SEEN))
        own = counts.where((F.col("source") == r["source"]) & (F.col("term") != "") & (F.col("texts") >= enough) & (odds >= math.log(ODDS)))
        sure = {x["term"]: x["no"] * SURE <= x["yes"] for x in own.select("term", "yes", "no").collect()}
        blurred = {t for t, s in sure.items() if t.endswith("*") and not s}
        out[r["source"]] = {t for t, s in sure.items() if t.endswith("*") or s and not any(t[:k] + "*" in blurred for k in STEMS)}
    return out


def dictionary(terms: dict[int, set[str]]) -> tuple[dict[str, int], set[str]]:
    """Of each term the sources that hold it, as bits, and the first letters of all stems."""
    bits: dict[str, int] = {}
    for source, own in terms.items():
        for t in own:
            bits[t] = bits.get(t, 0) | 1 << source
    return bits, {t[: STEMS[0]] for t in bits if t.endswith("*")}


def matches(text: str, bits: dict, heads: set[str]) -> tuple[int, dict[str, int]]:
    """The number of words of a text, and how often each term of the dictionary occurs."""
    words = Counter(_WORDS.findall(text.lower()))
    found: dict[str, int] = {}
    for w, n in words.items():
        if w in bits:
            found[w] = n
        if w[: STEMS[0]] in heads:
            for k in STEMS:
                if k < len(w) and (t := w[:k] + "*") in bits:
                    found[t] = found.get(t, 0) + n
    return sum(words.values()), found


def votes(text: str, bits: dict[str, int], heads: set[str]) -> str:
    """One vote a voter, as +, -, or 0 for an abstention."""
    n, found = matches(text, bits, heads)
    words = [t for t in found if not t.endswith("*")]
    most = lambda held: max((c for t, c in found.items() if t.endswith("*") and held(bits[t])), default=0) / max(n, SHORT)
    by = {t for t in found if bits[t].bit_count() > SOURCES // 2}  # terms that most sources hold
    out = []
    for s in range(SOURCES):
        word, dense = any(bits[t] >> s & 1 for t in words), most(lambda b: b >> s & 1) > DENSE[0]
        out.append("+" if word else "0" if dense else "-")
        out.append("+" if dense else "0" if word else "-")
    agreed, densest = sum(t in by for t in words), most(lambda b: b.bit_count() > SOURCES // 2)
    return "".join((
        *out,
        "+" if agreed >= 2 else "0" if by else "-",
        "+" if agreed and len(words) >= 3 else "0" if by else "-",
        "+" if densest > DENSE[1] else "0" if agreed or densest > DENSE[0] else "-",
        "+" if any(found[t] >= 3 for t in by) else "0" if by else "-",
        "+" if agreed and len(text) > 40 and text.upper() == text else "0",
    ))


def _voted(bits: dict, heads: set[str]):
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for part in slices(batch, "text"):
                counts.update(votes(text or "", bits, heads) for text in part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    return run


def label_model(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """The posterior of each vote pattern, from the counts of patterns: EM over each voter's rates of votes in
    both classes, from a start at the majority of votes; a vote is worth the less the more its voter
    correlates with others within a class."""
    if not counts:
        return {}
    names = sorted(counts)
    n = np.array([counts[p] for p in names], np.float64)
    cast = np.eye(3)[np.array([["-0+".index(c) for c in p] for p in names])]
    values = cast @ np.array([-1.0, 0.0, 1.0])
    post = 1 / (1 + np.exp(-2.0 * values.sum(axis=1)))
    for _ in range(rounds):
        y, o = n * post, n * (1 - post)
        prior = (y.sum() + 0.5) / (n.sum() + 1)
        yes = (np.einsum("p,plv->lv", y, cast) + 0.1) / (y.sum() + 0.3)
        no = (np.einsum("p,plv->lv", o, cast) + 0.1) / (o.sum() + 0.3)
        rest = values - post[:, None] * (yes @ [-1.0, 0.0, 1.0]) - (1 - post)[:, None] * (no @ [-1.0, 0.0, 1.0])
        cov = (rest * (n / n.sum())[:, None]).T @ rest
        sd = np.sqrt(np.diag(cov)) + 1e-9
        worth = 1 / (1 + (np.abs(cov / np.outer(sd, sd)) - np.eye(len(sd))).clip(0).sum(axis=1))
        score = math.log(prior / (1 - prior)) + np.einsum("plv,lv->p", cast, (np.log(yes) - np.log(no)) * worth[:, None])
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(names, post.tolist()))


def _posteriors(bits: dict, heads: set[str], post: dict[str, float]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                p = [post.get(votes(t or "", bits, heads), 0.0) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("text"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([0] * len(p), pa.int32())], ["text", "post", "label", "source"])

    return run


def features(n: int, found: dict[str, int]) -> dict[str, float]:
    """Of a text of n words: 1 for a word that occurs, a growing share of 1 for a stem by how dense it is."""
    return {t: min(1.0, 40.0 * c / max(n, SHORT)) if t.endswith("*") else 1.0 for t, c in found.items()}


def _featured(index: dict[str, int], heads: set[str]):
    def run(batches):
        for batch in batches:
            rows = [sorted((index[t], v) for t, v in features(*matches(text or "", index, heads)).items()) for text in batch.column("text").to_pylist()]
            at, values = [[i for i, _ in r] for r in rows], [[v for _, v in r] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("post"), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["part", "post", "at", "values"])

    return run


def _vectors(made: DataFrame, index: dict[str, int], heads: set[str]) -> DataFrame:
    """(part, post, features) of rows (text, part, post)."""
    size = len(index)
    sparse = F.udf(lambda at, values: Vectors.sparse(size, at, values), VectorUDT())  # no built-in makes sparse vectors; FITTED or SAMPLE rows or so
    out = made.select("text", "part", "post").mapInArrow(_featured(index, heads), "part int, post double, at array<int>, values array<double>")
    return out.select("part", "post", sparse("at", "values").alias("features"))


def fit(rows: DataFrame, terms: set[str], known: DataFrame | None = None, chosen: dict | None = None) -> dict[str, float]:
    """Weights of the linear classifier: logistic regression on rows (text, post), each a toxic one of weight post and another of the rest. "!" is the intercept.

    known: labelled rows (text, label) of the learning fold. The shrinkage is the one of SHRINKAGES with the least
    log loss on them, each scored by a model that has not seen its PARTS of texts; without such rows it is the
    first. `chosen`, if given, gets the losses by shrinkage."""
    total = rows.agg(F.count("*").alias("n"), F.sum("post").alias("yes")).first()
    if not terms or not total["n"] or not 1e-6 < total["yes"] < total["n"] - 1e-6:
        return {"!": -4.0}
    index = {t: i for i, t in enumerate(sorted(terms))}
    _, heads = dictionary({0: terms})
    part = F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")
    made = _vectors(rows.select("text", part.alias("part"), "post"), index, heads)
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("post").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("post")).alias("weight"))))
    both = save(made.select("part", "features", sides.alias("side")).select("part", "features", "side.*").where("weight > 0.001"))

    def trained(data: DataFrame, shrinkage: float):
        return LogisticRegression(regParam=shrinkage, elasticNetParam=0.0, standardization=False, maxIter=100, weightCol="weight").fit(data)

    losses = dict.fromkeys(SHRINKAGES, 0.0)
    tests = None if known is None else save(_vectors(known.select("text", part.alias("part"), F.col("label").cast("double").alias("post")), index, heads))
    for p in range(PARTS if tests is not None else 0):
        own, rest = tests.where(F.col("part") == p), both.where(F.col("part") != p)
        if rest.select("label").distinct().count() < 2:
            continue
        for shrinkage in SHRINKAGES:
            right = vector_to_array("probability")[F.col("post").cast("int")]
            losses[shrinkage] += trained(rest, shrinkage).transform(own).agg(F.sum(-F.log(F.greatest(right, F.lit(1e-12))))).first()[0] or 0.0
    if chosen is not None:
        chosen.update(losses)
    model = trained(both, min(SHRINKAGES, key=losses.get))
    w = model.coefficients.toArray()
    return {"!": float(model.intercept)} | {t: float(w[i]) for t, i in index.items() if w[i]}


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text") -> dict[str, float]:
    """Weights by term from docs (the learning fold; all of it is voted on) and labels.

    Lexicons are made from SAMPLE labelled texts or so, the classifier from FITTED texts with a posterior
    or so. Of conflicting labels of one id the least counts; rows without an id or label teach the lexicons
    nothing, null texts are empty, rows that share an id each count. Without labels of both kinds, or with
    empty tables, every text scores alike and low."""
    session(docs)
    marked = one_label(labels, label, id_column)
    n = marked.count()
    nth = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(id_column)), F.lit(1_000_000))
    texts = docs.select(id_column, F.col(text_column).alias("text"))
    sample = texts.join(marked.where(nth < int(1_000_000 * min(1.0, SAMPLE / max(n, 1)))), id_column)
    source = F.pmod(F.xxhash64(F.lit("source"), F.col(id_column)), F.lit(SOURCES)).cast("int")
    marked = save(sample.select("text", F.col("label_").alias("label"), source.alias("source")))
    bits, heads = dictionary(lexicons(marked))
    seen = save(texts.select("text").mapInArrow(_voted(bits, heads), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")))
    counts = {r["pattern"]: r["n"] for r in seen.collect()}  # at most 3 ** VOTERS, whatever the corpus
    post, total = label_model(counts), sum(counts.values())
    part = F.pmod(F.xxhash64(F.lit("posterior"), F.col(id_column)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FITTED / max(total, 1)))
    rows = save(texts.where(part).select("text").mapInArrow(_posteriors(bits, heads, post), "text string, post double, label int, source int"))
    return fit(rows, lexicons(rows).get(0, set()) | set(bits), marked)


def _scored(weights: dict[str, float]):
    _, heads = dictionary({0: {t for t in weights if t != "!"}})
    bits = {t: 1 for t in weights if t != "!"}

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    x = features(*matches(text or "", bits, heads))
                    z = weights["!"] + sum(v * weights.get(t, 0.0) for t, v in x.items())
                    out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: dict[str, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score), one row per row of docs, repeated rows and rows without an id too; null texts are empty. Other columns are not read, nothing is shuffled."""
    session(docs)
    kind = docs.schema[id_column].dataType.simpleString()
    src = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return src.mapInArrow(_scored(model), f"id {kind}, score double").withColumnRenamed("id", id_column)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod 3 is 1 are never learned from."""
    docs, keep = table(spark, sf_dir, "documents"), fold("doc_id", 3) != 1
    with scratch(spark):
        model = learn(docs.where(keep), table(spark, sf_dir, "labels").where(keep))
    out = score(docs, model)
    return out.select("doc_id", (~keep).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
