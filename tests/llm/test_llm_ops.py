"""Edge cases and brute-force comparisons of the training-data operators on small fixtures."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontamination, embedding_dedup, html_extraction, language_id, minhash_dedup, mixing, pii, quality, token_counts, toxicity

D = "/root/testdata/sf0.001"
ODD = [(1, None, None), (2, "", "a"), (3, "  \n", "a"), (4, "One two", "b"), (5, "one TWO", "b"), (6, "a b c d e f " * 3000, None), (7, "é ́ <|endoftext|> 12,5", "b"), (8, "one two", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, 1, "x", 0.0) for i, t, s in ODD], "doc_id long, text string, source string, n int, score_ string, upper double")


def rows(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def test_token_counts(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    got = rows(token_counts.token_counts(odd, path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    for i, t, _ in ODD:
        n = len(model.encode(t or "", add_special_tokens=False))
        assert got[i] == (len((t or "").encode()), n, n > 2048)
    assert token_counts.token_counts(odd.limit(0), path).count() == 0


def brute_components(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0 and sets[a]:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates(spark, odd):
    rng = random.Random(3)
    docs = [(i, t) for i, t, _ in ODD]
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([7, 60, 200]))]
        for k in range(7):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "x"
            docs.append((100 + g * 10 + k, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(minhash_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == brute_components(docs)
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and own[0]["target"] <= 2 * own[0]["source_size"]
    assert mixing.mix(odd.limit(0)).count() == 0 and all(r["taken"] == 0 for r in mixing.mix(odd.where("doc_id < 4")).collect())


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((40, 16))
    v = np.concatenate([v, v[:10] + 0.05 * rng.standard_normal((10, 16)), v[:3]])
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [])]
    got = rows(embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "vec_id", "n_links", "component_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert all(got[i] == (near[i].sum() - 1, int(np.flatnonzero(near[i])[0])) for i in range(len(v)))
    assert all(got[i] == (0, i) for i in range(900, 905))


def test_pii(spark, odd):
    text = "é mail a.b@c.de, x@@y.z 10.0.0.1 300.1.1.1, card 4111 1111 1111 1111, +1 (415) 555-0100."
    got = pii.find_pii(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == [(1, 1, 1, 1), (0, 0, 0, 0)]
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert not re.search(r"a\.b@|4111|555-0100|10\.0\.0\.1", out) and "[EMAIL]" in out
    assert pii.redact(odd).select("doc_id", "text").orderBy("doc_id").first()["text"] is None
    assert pii.base_spans("1" * 200_000 + "@" * 50_000) == []


def test_html(spark):
    page = "<body><nav>m</nav><script>'</p>'</script><article><h1>T &amp;amp; u</h1><p>a <b>b</b>\n c<div class='reader-comments'><p>no</div></article><footer>f</footer>"
    data = [(1, "http://h/a/1", page), (2, None, None), (3, "http://h/b/1", "<div>top bar</div><div>first story text</div>"), (4, "http://h/b/2", "<div>top bar</div><div>second story text</div>"), (4, "http://h/b/2", "<div>top bar</div><div>second story text</div>")]
    got = [tuple(r) for r in html_extraction.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).select("page_id", "text", "n_chars").orderBy("page_id").collect()]
    assert got == [(1, "T &amp; u a b c", 15), (2, "", 0), (3, "first story text", 16), (4, "second story text", 17), (4, "second story text", 17)]
    assert html_extraction.shared_lines([1, 2, 3, 4, 2], [2, 4, 9, 2]) == [1, 3, 4]


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "A farmer named Tom has 12 apples and sells 5 kg of pears to Mary for 30 dollars today"), (2, "one two three"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So: A farmer named Jim has 7 apples and sells 9 kg of pears to Anna for 4 dollars today."), (2, "well one, two three"), (3, None), (4, ""), (5, "a farmer sells pears")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()} == {(1, 1), (2, 2)}


def test_classifiers(spark, odd):
    labels = spark.createDataFrame([(i, 0) for i in range(5)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.learn(odd, labels)).where("score BETWEEN 0 AND 1").count() == len(ODD)
    out = quality.scored(odd, (0.5, [(1.0, (("upper", ">", 0.1),))]))
    assert out.columns == ["doc_id", "text", "source", "n", "upper", "score_"] and out.where("score_ BETWEEN 0 AND 1").count() == len(ODD)
    own = odd.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'en', 'fr') AS lang")
    got = rows(language_id.identify(own, language_id.learn(own)), "doc_id", "lang_pred")
    assert got[1] == got[2] == got[3] == ("und",) and got[4][0] in ("en", "fr")
    assert language_id.identify(own, language_id.learn(own.limit(0))).where("lang_pred = 'und'").count() == len(ODD)


def test_held_out_quality(spark):
    got = quality.op2_quality(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert got.where("predicted = quality").count() >= 0.95 * got.count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = corpus_pipeline.run(spark, D).collect()
    ids = {r["doc_id"] for r in out}
    assert 0 < len(ids) == len(out) < docs.count() and all(r["taken"] <= 2 * r["size"] for r in out)


def _held_out(spark, query, table_, label):
    d = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{d}/{table_}.parquet").select("doc_id", label).where(f"{label} IS NOT NULL")
    return query(spark, d).where("held_out").join(known, "doc_id")


def test_held_out_languages(spark):
    got = _held_out(spark, language_id.op7_language_id, "documents", "lang")
    for lang, n, right in got.groupBy("lang").agg(F.count("*"), F.count(F.when(F.col("lang") == F.col("lang_pred"), 1))).collect():
        assert right >= 0.9 * n > 0, lang


def test_held_out_toxicity(spark):
    """Few toxic texts a language teach at this size; what is found must be right, and most of it found."""
    by = {r["toxic"]: (r["n"], r["said"]) for r in _held_out(spark, toxicity.op5_toxicity, "labels", "toxic").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("said")).collect()}
    assert by[1][1] >= 0.5 * by[1][0] > 0 and by[0][1] <= 0.02 * by[0][0]


def test_base_spans_match_patterns():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, text):
        digits = [int(c) for c in text if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in text.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    rng = random.Random(5)
    pieces = ["a", "b.c", "@", ".", "x.de", " ", "-", "+1", "(2)", "4111 1111 1111 1111", "10.0.0.1", "256", "7", "0", "é", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 16)))
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if good(k, m[0])]
        assert pii.base_spans(text) == want, text


def test_rows_without_or_with_repeated_ids(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (None, None), (1, text), (1, text), (2, text), (2, None)], "doc_id long, text string")
    got = sorted(minhash_dedup.near_duplicates(docs).collect(), key=str)
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True), (2, 3, 1, False), (None, 0, None, True), (None, 3, None, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    vecs = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, None), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_vectors(vecs).select("vec_id", "n_links", "component_id", "kept").collect()
    want = [(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet").selectExpr("*", "'x' AS score_", "1 AS id", "'y' AS deal_", "0.0 AS upper", "doc_id AS part")
    docs = docs.union(docs.limit(3).selectExpr("CAST(NULL AS BIGINT)", *docs.columns[1:])).union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), D).count() == 0, name


def test_pipeline_near_dedup_from_80_percent(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(54)]
    near = ["x" if i == 25 else w for i, w in enumerate(base)]  # 45 of 55 shingles: 0.818
    far = ["y" if i in (20, 25) else w for i, w in enumerate(base)]  # 40 of 60: 0.667
    docs = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, D).collect()) == [1, 3]
    for percent in (80, 85):
        assert rows(minhash_dedup.near_duplicates(df, percent), "doc_id", "n_shingles", "component_id", "kept") == brute_components(docs, percent)
    assert minhash_dedup.banding(85) == (20, 5)
    for percent in (50, 80, 85, 95, 100):
        bands, size = minhash_dedup.banding(percent)
        assert bands * size <= minhash_dedup.COORDINATES and (1 - (percent / 100) ** size) ** bands <= (1 - 0.85**5) ** 20 * 1.001


def test_pii_spans_and_redaction_agree():
    import pyarrow as pa

    texts = ["write to jane (at) example (dot) com", "WRITE TO JANE (AT) EXAMPLE (DOT) COM", "write to Jane [At] example [Dot] com.", "that is at home", "call 10.0.0.1 or a.b@c.de", "", None]
    model = {pii._pattern(kind, votes): 1.0 for kind, _, _, votes in pii.candidates(texts[0], [])}
    assert model
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    told = [s for b in pii._reported(model)([batch]) for s in b.column("spans").to_pylist()]
    cleaned = [s for b in pii._redacted(model, 1)([batch]) for s in b.column("text").to_pylist()]
    assert [len(s.split(",")) if s else 0 for s in told] == [1, 1, 1, 0, 2, 0, 0]
    for text, found, clean in zip(texts, told, cleaned):
        for kind, start, end in sorted((x.split(":") for x in found.split(",") if x), key=lambda x: -int(x[1])):
            text = f"{text[: int(start)]}[{kind.upper()}]{text[int(end) :]}"
        assert clean == text


def leaked(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(docs, 1)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()}


def test_decontamination_judges_each_occurrence(spark):
    item = "A shop has 12 apples and sells 5 kg of pears to an old farmer for 30 dollars today"
    other = "A shop has 7 apples and sells 9 kg of pears to an old farmer for 4 dollars today"
    third = "A shop has 8 apples and sells 2 kg of pears to an old farmer for 6 dollars today"
    two_slots = "a child has 3 apples and its friend has 3 pears so how many fruits are there"
    docs = [
        f"{item}. {other}.", f"{other}. {third}.", f"{other} and then we close {item} but {third}", "so a child has 4 apples and its friend has 5 pears so how many fruits are there",
        "a shop has 8 apples but no farmer", "word " * 300 + item.replace("pears", "pears (ripe, green, and sweet)") + " word" * 300 + other,
    ]
    assert leaked(spark, [item, two_slots], docs) == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 1)}
    long = f"{item} while rain falls on all the roofs of our little town and nobody minds"
    assert leaked(spark, [long], [long.replace("roofs", "red and very wet roofs") + " . " + long.replace("12", "7").replace("30", "8").replace(" 5 ", " 6 ")]) == {(1, 1)}
    assert decontamination.occurrences([0, 1, 2, 7, 8, 9], [0, 1, 2, 0, 1, 2], 20) == [[0, 1, 2], [3, 4, 5]]


def test_decontamination_names_that_begin_sentences(spark):
    item = "Tom has 12 apples and 3 pears. Mary buys 5 of them and sells 2 to Jane. How many are left?"
    docs = [item.replace("Tom", "Jim").replace("Mary", "Anna"), item.replace("Tom", "Jim").replace("Mary", "Anna").replace("Jane", "Lea").replace("12", "9"), item, "Tom has a dog. Mary sells it to Jane. How many are left?"]
    assert leaked(spark, [item, "Who wrote Hamlet in the year 1600?"], [*docs, "Shakespeare wrote Macbeth in the year 1606?"]) == {(1, 1), (2, 1), (3, 1)}


def test_decontamination_items_of_numbers(spark):
    items = ["Compute 3 * 4 - 5", "Sort 4, 8, 15, 16, 23, 42 ascending", "A farmer named Tom sells pears to Mary every day"]
    docs = ["Please: compute 3 * 4 - 5!", "We sort 4, 8, 15, 16, 23, 42 ascending. And more.", "Compute 3 * 4 - 6. Sort 4, 8, 15, 16, 23, 43 ascending", "a farmer named Jim sells pears to Anna every day"]
    assert leaked(spark, items, docs) == {(1, 1), (2, 2), (4, 3)}
    assert leaked(spark, items[:2], docs) == {(1, 1), (2, 2)}


def test_html_wrappers_are_no_frames():
    inside = lambda page: [t for kind, t in html_extraction.lines(page) if kind == html_extraction.INSIDE]
    for start, end in [("<div class='layout with-sidebar'>", "</div>"), ("<div id='page-header-fixed'>", "</div>"), ("<form>", "</form>"), ("<div class='search'>", "</div>"), ("<div class='site-nav'>", "</div>")]:
        for tag in ("article", "main"):
            page = f"<body>{start}<nav>m</nav><{tag}><div class='post-header'><h1>T</h1></div><p>a</p><div class='share-buttons'>s</div><div class='reader-comments'><article>c</article></div></{tag}><p>tail</p>{end}</body>"
            assert inside(page) == ["T", "a"], page
    assert inside("<article>a</article><section class='comments'><article>c</article></section><aside><article>d</article></aside>") == ["a"]
    kinds = dict((t, kind) for kind, t in html_extraction.lines("<div class='layout with-sidebar'><p>a</p><div class='sidebar'>b</div><div class='main-nav'>c</div></div><div id='page-header-fixed'>d</div>"))
    assert kinds == {"a": html_extraction.OPEN, "b": html_extraction.FRAME, "c": html_extraction.FRAME, "d": html_extraction.OPEN}
