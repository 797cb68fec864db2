"""Language identification by hierarchical discrimination.

One-versus-one linear support vector machines over hashed byte trigrams first choose the language family,
then the language within it. Each machine is trained in a task of its own on the features of a bounded sample of
whole texts, found before they are shuffled; whole texts are scored in bulk, without a shuffle."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._shared import save, scratch, session, slices, table, utf8
from cairn.llm.quality import fold

#: Texts that each side of a machine learns from, shared by the side's languages, by a hash of the id; hashed features.
SAMPLE, BINS = 1_500, 1 << 12
#: Languages that a family may hold of those that no family names.
WIDEST = 12
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi", "romance": "fr es it pt ro ca gl oc la", "slavic": "ru pl cs sk uk bg sr hr sl mk be bs",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "baltic": "lt lv", "semitic": "ar he mt am", "indic": "hi bn ur mr gu pa ne si", "cjk": "zh ja ko",
}
_FAMILY = {x: family for family, names in FAMILIES.items() for x in names.split()}
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], "other")


def families(langs: list[str]) -> dict[str, list[str]]:
    """The languages by family. Those of no named family are dealt, by name, into families of at most WIDEST, so
    that L languages need about (L / WIDEST)^2 / 2 + L * WIDEST / 2 machines and not L^2 / 2."""
    groups: dict[str, list[str]] = {}
    others = 0
    for x in sorted(langs):
        name = family(x)
        if name == "other":
            name, others = f"other{others // WIDEST or ''}", others + 1
        groups.setdefault(name, []).append(x)
    return groups


def trigrams(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row a text: unit-length square roots of its counts of hashed trigrams of letters and single spaces."""
    n = len(off) - 1
    b = _FOLD[raw].astype(np.uint32)
    if len(b) < 3:
        return np.zeros((n, BINS), np.float32)
    h = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(20)
    blank = b == 32
    good = (blank[:-2].astype(np.int8) + blank[1:-1] + blank[2:]) < 2
    row = np.repeat(np.arange(n), np.diff(off))[:-2]
    good &= row == np.repeat(np.arange(n), np.diff(off))[2:]
    x = np.sqrt(np.bincount(row[good] * BINS + h[good], minlength=n * BINS)[: n * BINS].reshape(n, BINS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _features(batches):
    """Texts as the bins of their trigrams and their values there: at most 6 bytes a bin, however long the text."""
    for batch in batches:
        for part in slices(batch, "text"):
            x = trigrams(*utf8(part.column("text")))
            at = [np.flatnonzero(row) for row in x]
            found = [pa.array([i.astype(np.uint16).tobytes() for i in at], pa.binary()), pa.array([row[i].tobytes() for row, i in zip(x, at)], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("order"), *found], ["lang", "order", "bins", "values"])


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    """The texts' features, and a last column of ones."""
    x = np.zeros((len(rows), BINS + 1), np.float32)
    x[:, -1] = 1
    for out, bins, values in zip(x, rows["bins"], rows["values"]):
        out[np.frombuffer(bins, np.uint16)] = np.frombuffer(values, np.float32)
    return x


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """A linear machine with squared hinge loss, by accelerated gradient steps."""
    rows = rows.sort_values(["side", "order", "bins"])
    x = _matrix(rows)
    y = np.where(rows["side"].to_numpy() > 0, 1.0, -1.0).astype(np.float32)
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate, decay = np.float32(0.2), np.float32(1e-4)
    for k in range(300):
        slack = np.maximum(1 - y * (x @ v), 0)
        step = v - rate * (decay * v - 2 * (x.T @ (c * y * slack)))
        v, w = step + np.float32(k / (k + 3)) * (step - w), step
    return pd.DataFrame({"name": [rows["name"].iloc[0]], "weights": [w.astype(np.float32).tobytes()]})


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> dict:
    """Machines by name ("a|b": positive for b) for all pairs of families and of languages in one family.

    A side of a machine learns from SAMPLE texts or so, whatever its number of languages, and from BINS
    features of each, so that a task is bounded in bytes whatever the texts' length. Rows without text or lang teach nothing; an empty table gives no machines."""
    spark = session(docs)
    src = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
    groups = families(list(counts))
    part = lambda x, among: int(1_000_000 * min(1.0, SAMPLE / len(among) / counts[x]))
    tasks = [(f"{a}|{b}", x, side, part(x, groups[g])) for a in sorted(groups) for b in sorted(groups) if a < b for side, g in ((0, a), (1, b)) for x in groups[g]]
    tasks += [(f"{a}|{b}", x, side, part(x, [x])) for g in groups.values() for a in g for b in g if a < b for side, x in ((0, a), (1, b))]
    if not tasks:
        return {"groups": groups, "machines": {}}
    deal = spark.createDataFrame(tasks, "name string, lang string, side int, share int")
    order = F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(1_000_000))
    most = deal.groupBy("lang").agg(F.max("share").alias("most"))  # one row a language, as many as there are machines at most
    sample = src.withColumn("order", order).join(F.broadcast(most), "lang").where("order < most").select("lang", "order", "text")
    dealt = save(sample.mapInArrow(_features, "lang string, order long, bins binary, values binary")).join(F.broadcast(deal), "lang").where("order < share").drop("share")
    trained = dealt.groupBy("name").applyInPandas(_train, "name string, weights binary").collect()
    return {"groups": groups, "machines": {r["name"]: np.frombuffer(r["weights"], np.float32) for r in trained}}


def _duel(names: list[str], machines: dict, margins: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each row's winner among names by votes, then summed margins, and its weakest margin."""
    n = len(next(iter(margins.values()))) if margins else 0
    won, total = np.zeros((len(names), n)), np.zeros((len(names), n))
    least = np.full((len(names), n), np.inf)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if a < b:
                m = margins[f"{a}|{b}"]
                won[i] += m <= 0
                won[j] += m > 0
                for k, s in ((i, -m), (j, m)):
                    total[k] += np.clip(s, -3, 3)
                    least[k] = np.minimum(least[k], s)
    best = (won + 1e-3 * total).argmax(axis=0)
    return best, least[best, np.arange(n)]


def _predicted(model: dict):
    groups, machines = model["groups"], model["machines"]
    families = sorted(groups)

    def run(batches):
        names = sorted(machines)
        w = np.stack([machines[x] for x in names], axis=1) if names else np.zeros((BINS + 1, 0), np.float32)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                x = trigrams(*utf8(part.column("text")))
                m = x @ w[:-1] + w[-1]
                margins = {k: m[:, i] for i, k in enumerate(names)} or {"": np.zeros(len(texts))}
                first, sure = _duel(families, machines, margins) if len(families) > 1 else (np.zeros(len(texts), int), np.full(len(texts), np.inf))
                inner = {f: _duel(groups[f], machines, margins) if len(groups[f]) > 1 else (np.zeros(len(texts), int), np.full(len(texts), np.inf)) for f in families}
                langs, scores = [], []
                for i, text in enumerate(texts):
                    if not families or not text or not any(map(str.isalpha, text)):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    f = families[first[i]]
                    best, margin = inner[f]
                    langs.append(groups[f][best[i]])
                    scores.append(float(1 / (1 + np.exp(-2 * np.clip(min(sure[i], margin[i]), -15, 15)))))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per row of docs, repeated rows and rows without an id too.

    lang_pred is a learned value, or und with score 0 if the text is null or has no letter (Unicode category
    L; or nothing was learned); ties go to the first name; score, from 0 to 1, rises with the weakest margin of the duels won. Other columns are not read."""
    session(docs)
    kind = docs.schema[id_column].dataType.simpleString()
    src = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return src.mapInArrow(_predicted(model), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32(doc_id) mod 4 is 2 are never learned from."""
    docs, keep = table(spark, sf_dir, "documents"), fold("doc_id", 4) != 2
    with scratch(spark):
        model = learn(docs.where(keep))
    out = identify(docs, model)
    return out.select("doc_id", (~keep).alias("held_out"), "lang_pred", "score")
