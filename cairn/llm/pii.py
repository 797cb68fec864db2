"""Personal data in texts: base patterns, and further spans by weak supervision.

Base spans are what the contract's patterns find. Wider patterns give candidates, on which regex, gazetteer
and context labelers vote. Expectation-maximisation over the counts of all vote patterns of the corpus
estimates the labelers' reliabilities, a logistic span classifier over votes, kind and the shape of the span
and its surroundings is fitted to the posteriors, and candidates that it accepts and that touch no base span are added."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._shared import session, slices, table

KINDS = ("email", "ip", "card", "phone")
#: Probability from which the classifier adds a span.
ACCEPT = 0.9
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_AT = re.compile(r"@|\(at\)|\[at\]", re.I)
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, in the order of KINDS, then start; linear in the text's length.

    An email is found from its @: its local part is all that may stand before it since the last match."""
    out: list[tuple[str, int, int]] = []
    if not _SOME.search(text):
        return out
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            out.append(("email", start, free))
        at = text.find("@", max(at + 1, free))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return out


_WIDER = {
    "email": re.compile(r"[A-Za-z0-9._+-]{1,64}+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}+){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}+(?: ?\[?\.\]? ?[0-9]{1,3}+){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}+(?:[ .-]?[0-9]{4}+){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}+[ .-]?)?\(?[0-9]{3}+\)?[ .-][0-9]{3}+[ .-][0-9]{4}+(?![0-9])"),
}
#: Gazetteers: top-level domains, first digits of card issuers, words that speak for a kind and words that speak against any.
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca", "mx", "co"}
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "27", "34", "37", "60", "65", "35")
FOR = {
    "email": {"email", "mail", "contact", "write", "courriel", "correo", "kontakt"},
    "ip": {"ip", "host", "server", "address", "ping", "adresse", "servidor"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
}
AGAINST = {"version", "isbn", "issn", "order", "invoice", "page", "section", "no", "nr", "id", "doi", "serial"}
_WORD = re.compile(r"\w+")
LABELERS = 6


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of the wider patterns' leftmost matches; a vote is 1, -1 or 0 (abstains)."""
    if not _SOME.search(text) and not _AT.search(text):
        return []
    out = []
    strict = {k: {(s, e) for kind, s, e in base if kind == k} for k in KINDS}
    for kind in KINDS:
        if kind == "email" and not _AT.search(text):
            continue
        for m in _WIDER[kind].finditer(text):
            s, e = m.span()
            digits = _NOT_DIGITS.sub("", m[0])
            before = {w.lower() for w in _WORD.findall(text[max(0, s - 40) : s])}
            tail = _WORD.findall(m[0])[-1].lower() if kind == "email" else ""
            valid = {"email": lambda: tail in TOP_DOMAINS, "ip": lambda: all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), "card": lambda: luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            known = {"email": lambda: bool(before & FOR[kind]), "ip": lambda: not m[0].startswith(("0.", "255.")), "card": lambda: digits.startswith(ISSUERS), "phone": lambda: digits[0] not in "01" or digits.startswith("00")}[kind]()
            alone = not (text[s - 1 : s].isalnum() or text[e : e + 1].isalnum())
            votes = (
                1 if (s, e) in strict[kind] else 0,
                1 if valid else -1,
                1 if known else -1,
                1 if before & FOR[kind] else -1 if before & AGAINST else 0,
                1 if alone else -1,
                -1 if kind != "email" and text[e : e + 1] in ("%", "€", "$") else 0,
            )
            out.append((kind, s, e, votes))
    return out


def _class(c: str) -> str:
    """The class of a character beside a span: none, letter, digit, white space, label, bracket or quote, other."""
    return "n" if not c else "a" if c.isalpha() else "d" if c.isdigit() else "w" if c.isspace() else "l" if c in ":=#" else "b" if c in "()[]<>{}\"'" else "o"


def shape(text: str, start: int, end: int) -> str:
    """What the classifier sees of a span beside the votes: the characters before and after it, its separators, its length."""
    between = {c for c in text[start:end] if not c.isalnum()}
    own = "b" if between & set("()[]") else "n" if not between else {" ": "w", "-": "h", ".": "p"}.get(min(between), "o") if len(between) == 1 else "m"
    return _class(text[start - 1 : start] if start else "") + _class(text[end : end + 1]) + own + ("s" if end - start < 12 else "m" if end - start < 20 else "l")


def _pattern(kind: str, votes: tuple[int, ...], shape: str = "") -> str:
    return kind + ":" + "".join("-0+"[v + 1] for v in votes) + (shape and ":" + shape)


def _patterns(batches):
    for batch in batches:
        counts: dict[str, int] = {}
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                if text:
                    for kind, s, e, votes in candidates(text, base_spans(text)):
                        counts[p] = counts.get(p := _pattern(kind, votes, shape(text, s, e)), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


def fit(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """P(personal data) of every pattern: EM for the labelers' reliabilities, then a logistic fit to the posteriors.

    Patterns are kind:votes or kind:votes:shape; EM sees the votes only. For shapes that a corpus doesn't hold
    there is the mean of each kind:votes over its shapes."""
    if not counts:
        return {}
    names = sorted(counts)
    n = np.array([counts[p] for p in names], np.float64)
    votes = np.array([["-0+".index(c) for c in p.split(":")[1]] for p in names])
    kinds = np.array([KINDS.index(p.split(":")[0]) for p in names])
    shapes = [np.array([p.split(":")[2][i] if p.count(":") == 2 else "" for p in names]) for i in range(4)]
    cast = np.eye(3)[votes]
    post = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(axis=1)))
    for _ in range(rounds):
        yes = (np.einsum("p,plv->lv", n * post, cast) + 1) / ((n * post).sum() + 3)
        no = (np.einsum("p,plv->lv", n * (1 - post), cast) + 1) / ((n * (1 - post)).sum() + 3)
        prior = ((n * post).sum() + 1) / (n.sum() + 2)
        score = np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", cast, np.log(yes) - np.log(no))
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    x = np.concatenate([np.ones((len(names), 1)), cast[:, :, 0], cast[:, :, 2], np.eye(len(KINDS))[kinds], *(c[:, None] == np.unique(c) for c in shapes if len(np.unique(c)) > 1)], axis=1)
    w, weight = np.zeros(x.shape[1]), n / n.sum() * min(n.sum(), 1000.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - post)) + 0.1 * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    bare = np.array([":".join(name.split(":")[:2]) for name in names])
    votes_only, at = np.unique(bare, return_inverse=True)
    means = np.bincount(at, n * p) / np.bincount(at, n)
    return {**dict(zip(votes_only.tolist(), means.tolist())), **dict(zip(names, p.tolist()))}


def learn(docs: DataFrame, text_column: str = "text") -> dict[str, float]:
    """The span classifier of a corpus: probabilities by pattern.

    Null and empty texts hold no candidates, repeated rows count each time, and an empty table gives an empty
    model; other columns are not read. A kind has at most 96 vote patterns and 882 shapes, so that the counts
    that reach the driver are bounded whatever the corpus; a few hundred occur."""
    session(docs)
    counts = docs.select(F.col(text_column).alias("text")).mapInArrow(_patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return fit({r["pattern"]: r["n"] for r in counts.collect()})


def spans(text: str, model: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, both by kind as in KINDS, then start."""
    base = base_spans(text)
    taken, added = sorted((s, e) for _, s, e in base), []
    for kind, s, e, votes in candidates(text, base):
        likely = model.get(_pattern(kind, votes, shape(text, s, e)), model.get(_pattern(kind, votes), 0.0))
        if likely >= ACCEPT and not any(a < e and s < b for a, b in taken):
            added.append((kind, s, e))
            taken.append((s, e))
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def _reported(model: dict[str, float]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    base, every = spans(text or "", model)
                    n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
                cols = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per row of docs, repeated rows too.

    The counts and base_sha256 (of the joined list) are of the base spans; spans lists base and added
    ones as kind:start:end in code points, end exclusive; n_added counts the added. Null and empty texts
    have none. Other columns are not read. Two passes over the texts, no shuffle but of vote counts."""
    model = learn(docs, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    src = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = src.mapInArrow(_reported(model), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_column)


def _redacted(model: dict[str, float], at: int):
    def run(batches):
        for batch in batches:
            name = batch.schema.names[at]
            for part in slices(batch, name):
                texts = part.column(at).to_pylist()
                for i, text in enumerate(texts):
                    if text:
                        out, end = [], 0
                        for kind, s, e in sorted(spans(text, model)[1], key=lambda x: (x[1], -x[2])):
                            if s >= end:
                                out += [text[end:s], f"[{kind.upper()}]"]
                            end = max(end, e)
                        texts[i] = "".join([*out, text[end:]]) if out else text
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return run


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; of overlapping spans the union is replaced once.

    All columns and rows stay, repeated rows and rows without an id too; null and empty texts stay as they are."""
    model = learn(docs, text_column)
    return docs.mapInArrow(_redacted(model, docs.columns.index(text_column)), docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
