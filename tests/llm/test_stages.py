"""Each stage of the pipeline against plain Python or SQL, on documents with nulls, repeats, shared ids and further columns."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cairn.llm import mixing, pii, quality

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{D}/documents.parquet").selectExpr("*", "'x' AS key", "1 AS row_", "'g' AS gone_key", "2 AS id", "'h' AS hash")
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = random.Random(7)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    more = [(9001, base), (9002, base.replace(" w", " W")), (9003, base + " tail"), (9004, f"{base.split()[0]} so {item} and"), (None, base), (9005, None), (9005, ""), (9006, base + " mail a.b@c.de now 10.0.0.1"), (9001, "quite another text than that of the row before"), (9007, "one two"), (9008, "One TWO")]
    extra = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS key", "1 AS row_", "'g' AS gone_key", "2 AS id", "'h' AS hash")
    return own.unionByName(extra).unionByName(extra.where("doc_id = 9007")).cache()


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_quality_stage(spark, docs):
    model = quality.learn(docs, spark.read.parquet(f"{D}/labels.parquet"))
    scores = quality.scored(docs, model, name="quality_score").select("doc_id", "text", "quality_score").collect()
    out = pipeline.quality_stage(spark, docs, D)
    assert out.columns == docs.columns and texts(out) == sorted([(r["doc_id"], r["text"]) for r in scores if r["quality_score"] >= 0.7], key=str)


def test_near_dedup_stage(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    low = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(x):
                if sets[x] and sets[y] and low[x] is not None and low[y] is not None and low[x] != low[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    low[x] = low[y] = min(low[x], low[y])
                    changed = True
    want = [r for r, s, c in zip(rows, sets, low) if r[0] is None or not s or c == r[0]]
    out = pipeline.near_dedup_stage(spark, docs, D)
    assert out.columns == docs.columns and texts(out) == sorted(want, key=str)
    kept = texts(out)
    assert (9001, "quite another text than that of the row before") in kept and [i for i, _ in kept].count(9007) == 2 and 9002 not in [i for i, _ in kept]


def test_decontamination_stage(spark, docs):
    """Documents that hold all words of an item in a row go; those that share no five words in a row with any item stay."""
    plain = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    runs = {tuple(i[k : k + 5]) for i in items for k in range(max(1, len(i) - 4))}
    out = pipeline.decontamination_stage(spark, docs, D)
    kept = texts(out)
    assert out.columns == docs.columns and set(kept) <= set(texts(docs))
    for i, t in texts(docs):
        words = plain(t)
        joined = f" {' '.join(words)} "
        if any(len(x) >= 5 and f" {' '.join(x)} " in joined for x in items):
            assert (i, t) not in kept
        elif not any(tuple(words[k : k + 5]) in runs for k in range(len(words) - 4)) and not re.search(r"\d|[A-Z]", t or ""):
            assert (i, t) in kept
    assert 9004 not in [i for i, _ in kept] and (9005, None) in kept


def test_pii_stage(spark, docs):
    model = pii.learn(docs)
    want = []
    for i, t in texts(docs):
        if t:
            for kind, s, e in sorted(pii.spans(t, model)[1], key=lambda x: -x[1]):
                t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
        want.append((i, t))
    out = pipeline.pii_stage(spark, docs, D)
    assert out.columns == docs.columns and out.schema["n_chars"] == docs.schema["n_chars"] and texts(out) == sorted(want, key=str)
    assert out.where(F.col("text").isNotNull() & (F.col("n_chars") != F.length("text"))).count() == 0
    assert out.where("doc_id = 9006").first()["text"].endswith("mail [EMAIL] now [IP]")


def test_mixing_stage(spark, docs, tmp_path):
    own = docs.select("doc_id", "text", "source").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    own.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({mixing.ORACLE.strip()})").fetchall()
    got = [tuple(r) for r in pipeline.mixing_stage(spark, spark.read.parquet(str(tmp_path / "documents")), D).select(*names).collect()]
    flat = lambda rows: sorted((i, s, n, round(t, 6), k) for i, s, n, t, k in rows)
    assert flat(got) == flat(want)


def test_empty_documents_and_benchmark(spark, docs):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0


def test_run_leaves_only_its_last_tables(spark):
    import os

    from cairn.operators.tables import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    rows = pipeline.run(spark, D).count()
    made = set(os.listdir(shared_dir(spark))) - before
    assert rows > 0 and len(made) <= 6


def test_rows_that_share_a_slot_with_a_gone_one_stay(spark, monkeypatch):
    """A bitmap so small that most rows share a slot with a gone one: only the very id and text go."""
    from pyspark.sql import functions as F

    from cairn.llm import _shared

    monkeypatch.setattr(_shared, "BITS", 15)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.lit("k").alias("gone_key"))
    docs = docs.union(spark.createDataFrame([(None, "t1", "k"), (5, "other", "k"), (5, None, "k")], "doc_id long, text string, gone_key string"))
    key = _shared.row_key(docs["doc_id"], F.md5(F.coalesce(docs["text"], F.lit(""))))
    gone = docs.where("doc_id % 2 = 1 AND text LIKE 't%'").select(key.alias("gone_key"))
    left = _shared.without(docs, key, gone)
    assert left.columns == docs.columns and left.count() == 30_003
    assert left.where("doc_id % 2 = 1").count() == 2 and left.where("doc_id IS NULL").count() == 1


def test_shrinkage_is_chosen_on_learning_rows(spark, monkeypatch):
    """The least loss on labelled texts of the other part wins; without labelled rows it is the first."""
    from cairn.llm import toxicity

    rows = [(f"word{i % 50} " + ("bad" if i % 3 == 0 else "good") + f" x{i}", 0.97 if i % 3 == 0 else 0.02) for i in range(300)]
    df = spark.createDataFrame(rows, "text string, post double")
    known = df.selectExpr("text", "int(post > 0.5) AS label")
    monkeypatch.setattr(toxicity, "SHRINKAGES", (10.0, 1e-4))
    chosen = {}
    assert toxicity.fit(df, {"bad", "good"}, known, chosen)["bad"] > 1
    assert chosen[1e-4] < chosen[10.0] and toxicity.fit(df, {"bad", "good"})["bad"] < 1
