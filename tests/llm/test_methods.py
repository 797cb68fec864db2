"""The training-data operators' methods against plain Python on small fixtures, stage by stage."""

import html.parser
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import decontamination, html_extraction, language_id, minhash_dedup, pii, quality, token_counts, toxicity
from cairn.llm._shared import utf8

ODD_TEXTS = [None, "", " \n\t", "One two", "one two", "²³ ½", "é", "x" * 300_000, "word " * 60_000, "1" * 50_000, "<p>", "日本語のテキスト"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a row without an id, columns with names that operators use."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "One two"), (3, "other"), (None, "no id"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS id", "0 AS label", "1 AS own", "2.0 AS score", "'k' AS key", "3 AS row_", "'u' AS upper", "4 AS text_key", "5 AS gone_key", "'en' AS lang", "'s' AS source", "'h' AS hash")


def counted(df):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.collect()))


def test_every_row_gets_a_result(spark, odd):
    import public_tokenizers

    ids = counted(odd)
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int").selectExpr("*", "toxic AS quality", "'z' AS text")
    path = public_tokenizers.path("word_bpe_49k.json")
    model = toxicity.learn(odd, labels)
    for run in (
        lambda d: token_counts.token_counts(d, path), lambda d: toxicity.score(d, model), lambda d: quality.scored(d, (0.1, [(1.0, (("upper", ">", 0.1),))])),
        lambda d: language_id.identify(d, language_id.learn(odd)), lambda d: pii.find_pii(d), lambda d: pii.redact(d), lambda d: minhash_dedup.near_duplicates(d),
    ):
        assert counted(run(odd)) == ids
        assert run(odd.limit(0)).count() == 0
    pages = odd.selectExpr("doc_id AS page_id", "text AS html", "'http://h/a' AS url", "id", "hash", "own")
    assert html_extraction.main_text(pages).count() == odd.count() and html_extraction.main_text(pages.limit(0)).count() == 0


def test_conflicting_labels_teach_the_least(spark):
    from cairn.llm._shared import one_label

    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, one_label(labels, "toxic", "doc_id").collect())) == [(1, 0), (2, 1)]


def test_long_unspaced_texts_count_as_a_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lengths, cut = token_counts._tokenizer(path)
    model = Tokenizer.from_file(path)
    texts = ["7" * 60_000, "ab12" * 12_000, "日本" * 9_000 + "12" * 9_000, "'s't12" * 4000 + " ́x", "<|endoftext|>1" * 3000]
    want = [len(model.encode(t, add_special_tokens=False)) for t in texts]
    assert cut and token_counts.text_lengths(lengths, [t.encode() for t in texts], token_counts.Memory()) == want
    assert all(len(p) <= token_counts.PART_BYTES + 1 for p in token_counts.pieces(texts[0].encode()))
    lengths, cut = token_counts._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not cut


def test_quality_score_follows_its_rules(spark):
    """Statistics counted character by character and rules applied one by one give the score of the compiled expression."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", "é", "Ü", " ", "\n", ".", "!", "#", "1", "the ", "longest" * 4]) for _ in range(rng.randrange(0, 80))) for _ in range(60)] + ["", None]

    def plain(text):
        raw, words = (text or "").encode(), (text or "").encode().lower().split()
        n, letters = max(len(words), 1), sum(65 <= c < 91 or 97 <= c < 123 or c >= 192 for c in raw)
        upper = sum(65 <= c < 91 for c in raw) + sum(raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E for i in range(1, len(raw)))
        size = max(len(raw), 1)
        return dict(
            upper=upper / max(letters, 1), symbols=sum(chr(c) in "#$%&*+/<=>@[\\]^_`{|}~" for c in raw) / size, digits=sum(48 <= c < 58 for c in raw) / size,
            repeats=sum(a == b for a, b in zip(words, words[1:])) / n, distinct=len(set(words)) / n, word_length=max(letters, 1) / n, stops=sum(c in b"!.?" for c in raw) / n,
            lines=raw.count(10) / n, long_words=sum(len(w) >= 20 for w in words) / n, log_words=math.log1p(n),
        )

    model = (-0.3, [(1.5, (("upper", ">", 0.2),)), (-2.0, (("symbols", "<=", 0.05), ("lines", ">", 0.01))), (0.7, (("distinct", "<=", 0.9), ("log_words", ">", 1.0), ("word_length", ">", 3.0))), (0.4, (("repeats", ">", 0.0),))])
    want = []
    for t in texts:
        x = plain(t)
        z = model[0] + sum(w for w, rule in model[1] if all(x[s] <= v if test == "<=" else x[s] > v for s, test, v in rule))
        want.append(1 / (1 + math.exp(-z)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["score_"] for r in quality.scored(df, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want, rtol=1e-12)


def test_quality_rules_are_the_paths_of_the_trees():
    debug = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 3 <= 0.25)
      Predict: 0.0
     Else (feature 3 > 0.25)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    upper, repeats = quality.STATISTICS[0], quality.STATISTICS[3]
    assert set(quality.rules(debug)) == {((upper, "<=", 0.5),), ((upper, ">", 0.5),), ((upper, "<=", 0.5), (repeats, "<=", 0.25)), ((upper, "<=", 0.5), (repeats, ">", 0.25))}


def test_toxicity_scores_are_the_linear_classifier(spark):
    weights = {"!": -2.0, "idiot": 3.0, "moron": -1.0, "scu*": 4.0, "scum*": 2.0}
    texts = ["you IDIOT idiot", "scummy scum is scu", "moron " * 3, "a scumbag among many words here " * 5, "a scumbag among many words here " * 50, "", None, "idiots"]

    def plain(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        present = {w for w in words if w in weights}
        z = weights["!"] + sum(weights[w] for w in present)
        for stem in ("scu", "scum"):
            n = sum(w.startswith(stem) and len(w) > len(stem) for w in words)
            z += weights[stem + "*"] * min(1.0, 40 * n / max(len(words), toxicity.SHORT))
        return 1 / (1 + math.exp(-z))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["score"] for r in toxicity.score(df, weights).orderBy("doc_id").collect()]
    assert np.allclose(got, [plain(t) for t in texts])


def test_toxicity_label_model_finds_the_voters_worth():
    """Texts of known classes, voters of known rates, two of them copies of one: posteriors follow the classes, and nothing is told to the model."""
    rng = np.random.default_rng(1)
    n, counts, truth = 4000, {}, {}
    for _ in range(n):
        y = rng.random() < 0.15
        v = ["+" if rng.random() < (0.85 if y else 0.03) else "-" for _ in range(4)]
        noise = "+" if rng.random() < 0.5 else "-"
        p = "".join([*v, noise, noise, "0"])
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    post = toxicity.label_model(counts)
    right = sum(sum(y == (post[p] >= 0.5) for y in ys) for p, ys in truth.items())
    assert right >= 0.97 * n and toxicity.label_model({}) == {}


def test_toxicity_lexicons_of_disjoint_sources(spark):
    rows = [("you bad thing " + "filler words here " * 20, 1, s) for s in (0, 1) for _ in range(10)] + [("filler words here " * 20 + ("odd" if s else "thing"), 0, s) for s in (0, 1) for _ in range(40)]
    found = toxicity.lexicons(spark.createDataFrame(rows, "text string, label int, source int"))
    assert "bad" in found[0] and "you" in found[0] and "thing" not in found[0] and "thing" in found[1] and "filler" not in found[0] | found[1]


def test_decontamination_against_brute_force(spark):
    """Items and documents of small-letter words, numbers and names within sentences, against runs compared one by one."""
    rng = random.Random(6)
    names, words = ["Tom", "Mary", "Jim", "Anna"], [f"w{c}{d}" for c in "abcdef" for d in "ghijk"]
    words = [re.sub(r"\d", "", w) for w in words]

    def sentence(n):
        return [rng.choice(words) if rng.random() < 0.7 or k == 0 else rng.choice(names) if rng.random() < 0.5 else str(rng.randrange(2, 9)) for k in range(n)]

    items = [sentence(rng.randrange(6, 14)) for _ in range(8)]
    docs = []
    for item in items:
        docs += [sentence(5) + item + sentence(4), [str(rng.randrange(2, 9)) if w.isdigit() else rng.choice(names) if w in names else w for w in item], item[: len(item) // 2] + sentence(3), [("7" if w.isdigit() else w) for w in item]]
    docs += [sentence(30) for _ in range(6)]
    kind = lambda w: "#" if w.isdigit() else "N" if w in names else w

    def brute(doc, item):
        runs = lambda t: [(i, tuple(map(kind, t[i : i + 5])), t[i : i + 5]) for i in range(len(t) - 4)]
        wanted = [r for r in runs(item) if sum(k in ("#", "N") for k in r[1]) <= 3]
        if not wanted:
            return None
        n = len({k for _, k, _ in wanted})
        met = [(p, j, k, dv, iv) for p, k, dv in runs(doc) for j, k2, iv in wanted if k == k2]
        shifts = {p - j for p, j, *_ in met}
        for groups in [[m for m in met if m[0] - m[1] == s] for s in shifts]:
            if len({k for _, _, k, _, _ in groups}) < 0.8 * n:
                continue
            slots, back = {}, {}
            for _, j, k, dv, iv in groups:
                for o, t in enumerate(k):
                    if t in ("#", "N"):
                        slots.setdefault(j + o, []).append(dv[o])
                        back[(j + o, dv[o])] = iv[o]
            total = len(back)
            agree = sum(max(map(v.count, v)) for v in slots.values()) / max(1, sum(map(len, slots.values())))
            by = {}
            for (_, d), i in back.items():
                by.setdefault(d, []).append(i)
            apart = sum(max(map(v.count, v)) for v in by.values()) / total if total else 1
            if (not slots or agree >= 0.8) and apart >= 0.5:
                return True
        return False

    frame = lambda rows, n: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{n} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            want = brute(doc, item)
            if want is not None:
                assert ((d, i) in got) == want, (item, doc)
    assert len(got) >= len(items)


def test_decontamination_slots_must_be_told_apart(spark):
    items = spark.createDataFrame([(1, "so when Tom has 12 apples and buys 5 more from old Mary for 30 coins today")], "item_id long, text string")
    texts = ["so when Jim has 7 apples and buys 7 more from old Jim for 7 coins today", "so when Jim has 7 apples and buys 8 more from old Anna for 7 coins today", "so when 3 has 12 apples and buys 5 more from old 4 for 30 coins today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in decontamination.leaks(docs, items).collect()} == {1}


def test_decontamination_long_texts_and_repeats(spark):
    item = "the quick brown fox jumps over 13 lazy dogs near the river bank"
    docs = spark.createDataFrame([(1, "word " * 100_000 + item), (1, "other"), (2, "word " * 100_000), (3, item), (3, item), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (1, item), (None, item), (2, ""), (3, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()} >= {(1, 1), (3, 1)}


def test_language_duels_against_plain_loops():
    rng = np.random.default_rng(5)
    names = ["a", "b", "c"]
    margins = {f"{x}|{y}": rng.standard_normal(50) for i, x in enumerate(names) for y in names[i + 1 :]}
    best, least = language_id._duel(names, {}, margins)
    for row in range(50):
        won, total, low = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), dict.fromkeys(names, math.inf)
        for pair, m in margins.items():
            x, y = pair.split("|")
            for k, s in ((x, -m[row]), (y, m[row])):
                won[k] += s > 0
                total[k] += min(3, max(-3, s))
                low[k] = min(low[k], s)
        top = max(names, key=lambda k: won[k] + 1e-3 * total[k])
        assert names[best[row]] == top and math.isclose(least[row], low[top])


def test_language_trigrams_against_plain_loops():
    texts = ["Ab c", "", "a1b  c", "ééx", "no"]
    x = language_id.trigrams(*utf8(pa.array(texts)))
    for row, text in zip(x, texts):
        b = [c | 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in text.encode()]
        n = np.zeros(language_id.BINS)
        for p, q, r in zip(b, b[1:], b[2:]):
            if [p, q, r].count(32) < 2:
                h = ((p * 0x9E3779B1) ^ (q * 0x85EBCA6B) ^ (r * 0xC2B2AE35)) & 0xFFFFFFFF
                n[(h * 0x27D4EB2F & 0xFFFFFFFF) >> 20] += 1
        n = np.sqrt(n)
        assert np.allclose(row, n / max(np.linalg.norm(n), 1e-9), atol=1e-6)


def test_language_features_before_the_shuffle_are_those_of_the_texts():
    texts = ["", "aaaa bbbb", "Der Hund und die Katze", None, "é" * 5000, "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 6), pa.array(range(6), pa.int64()), pa.array(texts, pa.string())], ["lang", "order", "text"])
    rows = pa.Table.from_batches(language_id._features([batch])).to_pandas()
    for got, text in zip(language_id._matrix(rows), texts):
        assert np.array_equal(got[:-1], language_id.trigrams(*utf8(pa.array([text], pa.string())))[0]) and got[-1] == 1
    assert rows["bins"].map(len).max() <= 2 * language_id.BINS


def test_language_families_keep_machines_few():
    groups = language_id.families([f"q{i:03}" for i in range(200)] + ["de", "en-GB", "ja"])
    assert groups["germanic"] == ["de", "en-GB"] and groups["cjk"] == ["ja"] and max(map(len, groups.values())) <= language_id.WIDEST
    assert sorted(x for g in groups.values() for x in g) == sorted([f"q{i:03}" for i in range(200)] + ["de", "en-GB", "ja"])
    pairs = lambda n: n * (n - 1) // 2
    assert pairs(len(groups)) + sum(pairs(len(g)) for g in groups.values()) < 1500 and language_id.families([]) == {}


def test_language_of_texts_without_letters(spark):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the house and the river are near", "en"), ("das Haus und der Fluss sind nah", "de"), ("la maison et la rue sont belles", "fr")] * 5)], "doc_id long, text string, lang string")
    model = language_id.learn(train)
    texts = ["²³", "½ 12", "", None, "!?", "the river", "der Fluss"]
    got = [tuple(r) for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").select("lang_pred", "score").collect()]
    assert got[:5] == [("und", 0.0)] * 5 and [g for g, _ in got[5:]] == ["en", "de"]


class Reader(html.parser.HTMLParser):
    """Text of blocks inside article elements, outside nav, aside, footer, script and style."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.line = [], [], []

    def flush(self):
        line = " ".join("".join(self.line).split())
        if line:
            self.out.append(line)
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.line.append(" ")
            return
        if tag in ("p", "h1", "div", "li", "article", "nav", "aside", "footer"):
            self.flush()
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "li", "article", "nav", "aside", "footer"):
            self.flush()
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if "article" in self.stack and not {"nav", "aside", "footer", "script", "style"} & set(self.stack):
            self.line.append(data)


def test_html_against_a_plain_parser():
    rng = random.Random(9)
    pieces = ["a &amp; b", "<b>bold</b>", " two\n words ", "&eacute;", "&#60;x&#62;", "<br>", "<i>i <u>u</u></i>", "1 &lt; 2", "<!-- c -->"]
    for _ in range(150):
        inline = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5)))
        block = lambda: rng.choice([f"<p>{inline()}</p>", f"<div>{inline()}</div>", f"<ul><li>{inline()}</li><li>{inline()}</li></ul>", f"<aside>{inline()}</aside>", "<script>var x = '<p>';</script>"])
        page = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>{inline()}</nav><article><h1>{inline()}</h1>{''.join(block() for _ in range(4))}</article><footer>{inline()}</footer></body></html>"
        reader = Reader()
        reader.feed(page)
        reader.flush()
        assert [t for kind, t in html_extraction.lines(page) if kind == html_extraction.INSIDE] == reader.out, page


def test_html_common_lines_are_longest():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_extraction.shared_lines(a, b)
        kept, at = [a[i] for i in got], 0
        for y in b:
            at += at < len(kept) and kept[at] == y
        assert got == sorted(got) and at == len(kept) == best[-1][-1]


def test_html_differencing_of_open_pages(spark):
    """Pages that mark no article: lines shared with the page of the nearest path go, those of copies and of other hosts don't."""
    page = lambda *lines: "".join(f"<div>{x}</div>" for x in lines)
    data = [
        (1, "http://h/news/a1", page("Top bar", "story one of its own", "Bottom bar")), (2, "http://h/news/a2", page("Top bar", "story two of its own", "Bottom bar")),
        (3, "http://h/zoo/1", page("same whole story", "on both pages")), (4, "http://h/zoo/2", page("same whole story", "on both pages")),
        (5, "http://other/news/a1", page("Top bar", "story five")), (6, None, page("alone")), (7, "http://h/news/a1", page("Top bar", "story one of its own", "Bottom bar")),
    ]
    got = {r["page_id"]: r["text"] for r in html_extraction.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[2] == "story two of its own" and got[3] == got[4] == "same whole story on both pages" and got[5] == "Top bar story five" and got[6] == "alone"


def test_html_differencing_of_marked_pages(spark):
    """Inside a marked article a notice goes that two neighbours share; a passage that articles share, headings and what one lacks stay, and all where there is one neighbour or copies."""
    page = lambda n, *more: f"<nav>m{n}</nav><article><div class='c-{n}'>Get the app now</div><h2 class='t'>Why</h2><div class='body'><p>story {n} of its own and long enough to tell</p><p>a passage of all</p></div>{''.join(more)}</article><div>beside</div>"
    data = [(i, f"http://h/a/{i}", page(i, "<div class='one'>only once</div>" if i == 2 else "")) for i in range(1, 5)]
    data += [(5, "http://two/a/1", page(5)), (6, "http://two/a/2", page(6))]
    data += [(7 + i, f"http://copies/a/{i}", page(7)) for i in range(3)]
    own = lambda n: f"Why story {n} of its own and long enough to tell a passage of all"
    whole = lambda n: f"Get the app now {own(n)}"
    got = {r["page_id"]: r["text"] for r in html_extraction.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[2] == own(2) + " only once" and [got[i] for i in (1, 3, 4)] == [own(i) for i in (1, 3, 4)]
    assert got[5] == whole(5) and got[6] == whole(6)
    assert [got[7 + i] for i in range(3)] == [whole(7)] * 3


def test_html_differencing_needs_both_sides_of_a_folder(spark):
    """Pages that mark no article: what only one neighbour of the folder shares comes back; a copy tells nothing, the next neighbour does."""
    page = lambda *lines: "".join(f"<div>{x}</div>" for x in lines)
    data = [
        (1, "http://h/a/1", page("Bar", "story one of its own")), (2, "http://h/a/2", page("Bar", "story two of its own", "a shared passage")), (3, "http://h/a/3", page("Bar", "a shared passage", "story three of its own")),
        (4, "http://c/a/1", page("Top bar", "a story told twice")), (5, "http://c/a/2", page("Top bar", "a story told twice")), (6, "http://c/a/3", page("Top bar", "another story")),
    ]
    got = {r["page_id"]: r["text"] for r in html_extraction.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[2] == "story two of its own a shared passage"
    assert got[5] == "a story told twice"


def test_html_common_lines_by_bits():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        where = {x: [j for j, y in enumerate(b) if y == x] for x in b}
        plain, got = html_extraction.shared_lines(a, b), html_extraction.shared_by_bits(a, where, len(b))
        kept, at = [a[i] for i in got], 0
        for y in b:
            at += at < len(kept) and kept[at] == y
        assert got == sorted(got) and at == len(kept) == len(plain)
    assert len(html_extraction.shared_lines([1] * 20_000, [1] * 20_001)) == 20_000


def test_html_neighbours_against_a_plain_loop(spark):
    """Pages inside a partition and at its ends meet the neighbours that one sorted list gives."""
    rng = random.Random(8)
    data = []
    for i in range(90):
        notice = f"<div class='n{i}'>{rng.choice(['read on', 'read on', 'read more'])}</div>"
        data.append((i, f"http://h{i % 4}/{rng.choice('ab')}/{i:02d}", f"<article><h1>t{i}</h1><p>story {i} {'long ' * 9}</p>{notice}</article>" if i % 4 else f"<div>{rng.choice(['bar', 'top'])}</div><div>story {i}</div>"))
    data += [(100 + i, f"http://g{i}/a", "<p>x</p>") for i in range(7)]
    pages = sorted((*html_extraction._url(url), i, html_extraction.blocks(page)) for i, url, page in data)
    want = {}
    for at, (host, path, i, found) in enumerate(pages):
        mine = [x for x, p in enumerate(pages) if p[0] == host]
        near = [x for x in (at - 1, at + 1) if x in mine] if at not in (mine[0], mine[-1]) else (mine[1:3] if at == mine[0] else mine[-2:-4:-1])
        near = [(pages[x][1], [line for _, line, _ in pages[x][3]]) for x in near if x != at and x in mine]
        texts = [line for _, line, _ in found]
        units = [(1 if unit else 0) if kind == html_extraction.INSIDE else -1 for kind, _, unit in found]
        gone = html_extraction.gone_lines(path, texts, [len(x) for x in texts], list(range(len(texts))), units, near)
        want[i] = " ".join(x for k, x in enumerate(texts) if k not in gone)
    rows = spark.createDataFrame(data, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = {r["page_id"]: r["text"] for r in html_extraction.main_text(rows).collect()}
            assert got == want and 0 < sum("read on" not in x for x in got.values()) < 90
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_html_long_pages(spark):
    page = "<body><nav>m</nav><article>" + "<p>a b</p>" * 60_000 + "</article></body>"
    r = html_extraction.main_text(spark.createDataFrame([(1, "http://h/1", page), (1, "http://h/1", page)], "page_id long, url string, html string")).collect()
    assert [x["n_chars"] for x in r] == [60_000 * 4 - 1] * 2


def test_pii_posteriors_against_plain_em():
    """The added spans follow from counts of vote patterns alone: EM and the logistic fit written out in loops."""
    counts = {"email:0++++0": 50, "email:0--0-0": 30, "phone:0+++++": 20, "phone:0---0-": 60, "card:00++0+": 5}
    counts = {k: v for k, v in counts.items() if len(k.split(":")[1]) == pii.LABELERS}
    got = pii.fit(counts)
    names = sorted(counts)
    n, votes = [counts[p] for p in names], [p.split(":")[1] for p in names]
    post = [1 / (1 + math.exp(-2.0 * sum("-0+".index(c) - 1 for c in v))) for v in votes]
    for _ in range(50):
        y, o = sum(a * b for a, b in zip(n, post)), sum(a * (1 - b) for a, b in zip(n, post))
        prior, new = (y + 1) / (sum(n) + 2), []
        for v in votes:
            z = math.log(prior / (1 - prior))
            for k, c in enumerate(v):
                yes = (sum(a * b for a, b, w in zip(n, post, votes) if w[k] == c) + 1) / (y + 3)
                no = (sum(a * (1 - b) for a, b, w in zip(n, post, votes) if w[k] == c) + 1) / (o + 3)
                z += math.log(yes / no)
            new.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        post = new
    assert all((got[p] >= 0.5) == (q >= 0.5) for p, q in zip(names, post)) and pii.fit({}) == {}


def _planted() -> tuple[list[str], list[str]]:
    """Texts with one disguised span each, and texts with a look-alike each."""
    word = lambda i: ("alba", "brin", "corto", "delma", "esk")[i % 5]
    card = lambda i: next(c for c in (f"4{i:011d}000{d}" for d in range(10)) if pii.luhn(c))
    good, bad = [], []
    for i in range(120):
        c = card(i * 7919)
        good += [f"contact {word(i)}{i} (at) {word(i + 1)} (dot) com now", f"the {word(i)} said: call {200 + i}-{300 + i}-{4000 + i} today", f"visa card: {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} {word(i)}", f"server: 10[.]{i}[.]0[.]{i + 1} {word(i)}"]
        wrong = c[:15] + str((int(c[15]) + 1) % 10)
        bad += [f"order {wrong[:4]}-{wrong[4:8]}-{wrong[8:12]}-{wrong[12:]}% {word(i)}", f"version 300[.]{i}[.]900[.]{i + 1}a", f"section {word(i)}(at){word(i + 1)}.x{i}y% off", f"invoice {wrong[:4]} {wrong[4:8]} {wrong[8:12]} {wrong[12:]}"]
    return good, bad


def test_pii_classifier_catches_disguised_spans_and_leaves_look_alikes(spark):
    good, bad = _planted()
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_added"] for r in pii.find_pii(docs).collect()}
    assert sum(got[i] > 0 for i in range(len(good))) >= 0.95 * len(good)
    assert sum(got[len(good) + i] > 0 for i in range(len(bad))) <= 0.01 * len(bad)


def test_pii_shapes_enter_the_classifier():
    """Of two kinds of spans with the same votes the one whose surroundings are those of good spans is the likelier; a shape not seen has the mean."""
    assert pii.shape("mail: a@b.c", 6, 11) == "wnms" and pii.shape("(1.2.3.4)", 1, 8) == "bbps" and pii.shape("", 0, 0) == "nnns"
    counts = {"phone:0++++0:lwhm": 900, "phone:0----0:awhm": 900, "phone:0+-0+0:lwhm": 50, "phone:0+-0+0:awhm": 50}
    got = pii.fit(counts)
    assert got["phone:0+-0+0:lwhm"] > got["phone:0+-0+0"] > got["phone:0+-0+0:awhm"]
    text = "call 555-123-4567"
    ((kind, s, e, votes),) = pii.candidates(text, [])
    for p, added in ((0.95, True), (0.5, False)):
        assert bool(pii.spans(text, {pii._pattern(kind, votes): p})[1]) is added


def test_pii_added_spans_are_candidates_that_touch_no_base_span():
    texts = ["mail jane (at) example (dot) com or a@b.de", "card 4111 1111 1111 1111 5500 0000 0000 0004 end", "ip 10 . 0 . 0 . 1 or 10.0.0.1", "tel (415) 555-0100"]
    for accepted in (False, True):
        for text in texts:
            base = pii.base_spans(text)
            model = {pii._pattern(k, v): float(accepted) for k, _, _, v in pii.candidates(text, base)}
            got_base, every = pii.spans(text, model)
            added = [x for x in every if x not in base]
            assert got_base == base and set(base) <= set(every) and bool(added) <= accepted
            ends = sorted((s, e) for _, s, e in added)
            assert all(not (a < e and s < b) for s, e in ends for _, a, b in base) and all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))
            wide = [(k, s, e) for k, s, e, _ in pii.candidates(text, base)]
            assert all(x in wide for x in added)
            if accepted:
                assert all(x in every or any(x[1] < e and s < x[2] for _, s, e in every) for x in wide)


def test_folds_are_crc32_of_the_id_as_text(spark):
    got = {r["doc_id"]: r["f"] for r in spark.range(300).withColumnRenamed("id", "doc_id").withColumn("f", quality.fold("doc_id", 4)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(300)}
