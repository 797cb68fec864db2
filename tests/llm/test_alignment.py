"""Token alignment against a plain loop over whole texts."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cairn.llm import token_alignment as ta

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(texts):
    """The result for each text: both sides encode whole texts, and every pair of every group is listed."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = {v: k for k, v in {c: i for c, i in ta._byte_letters().items()}.items()}
    back = {c: i for i, c in letters.items()}
    names = {i: w for w, i in a.get_vocab().items()}
    found = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        xs = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ys = b.encode(text) if text else []
        bx = [bytes(back[c] for c in names[i]) for i in xs]
        by = [bytes([b.id_to_piece(i).startswith("<0x") and int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ys]
        if not text or b"".join(bx) != raw or b"".join(by) != raw:
            found.append(None)
            continue
        ends = [list(accumulate(map(len, z))) for z in (bx, by)]
        groups, last = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append([ids[bisect_right(e, last) : bisect_right(e, end)] for ids, e in zip((xs, ys), ends)])
            last = end
        found.append((xs, ys, groups))
    count = Counter()
    for f in found:
        count.update({(x, y) for g in f[2] for x in g[0] for y in g[1]} if f else ())
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in f[2] for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in f[2])
        out.append((len(f[0]), len(f[1]), len(f[2]), len(links), sum(count[p] == best[p[0]] for p in links), sum(map(count.__getitem__, links)), hashlib.sha256(text.encode()).hexdigest()))
    return out


EDGES = [
    None, "", " ", "  ", "\n", "a", "a ", "a  b", " lead", "tail   ", "a\n b", "a \n b", "tab\t x", "it's John's 'd", "<|endoftext|> and <s> </s> <unk> <0x41>", "x<|endoftext|>y",
    "übermäßig große Häuser", "日本語のテキスト です", "한국어 문장 👩‍👩‍👧 emoji", "under▁score ▁", "nul\x00 mid \x1c sep", "1234567890 12 34,567.89", "  two  and   three    spaces", " nbsp  em", "same text again", "same text again",
]


def _texts():
    rng = random.Random(4)
    words = ["the", "a", "Antidisestablishment", "ñandú", "co-operate", "x1y2", "...", "==", "don't", "Zürich", "ば", "ß", "  ", "\n\n", "\t", "0xFF", "🙂", "é", "http://a.b/c?d=e"]
    return EDGES + [rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(150)] + ["".join(rng.choices("abcdefgh0123 ", k=30_000))]


@pytest.mark.parametrize("head", [ta.HEAD, 40, 0])
def test_equal_to_whole_texts(spark, head):
    """With all counts sent to tasks, some, and none."""
    texts = _texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pair", "1 AS row_", "2 AS n", "3 AS id_").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in ta.alignment(df, *PATHS, head=head).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_rows_without_id_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (7, "one two"), (7, "one two"), (None, None)], "doc_id int, text string")
    got = ta.alignment(df, *PATHS).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in got) == [(0, 0, 0), (0, 2, 6), (7, 2, 6), (7, 2, 6)]
    empty = ta.alignment(df.where("false"), *PATHS)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_memory_begins_anew(monkeypatch):
    """One text at a time with room for three units, wide groups counted by distinct ids, and all at once."""
    model, texts = ta.aligner(*PATHS)[0], _texts()
    every = ta.align_texts(model, texts, ta.Memory())
    monkeypatch.setattr(ta, "UNITS", 3)
    monkeypatch.setattr(ta, "WIDE", 2)
    memory = ta.Memory()
    for i, t in enumerate(texts):
        numbers, digests, doc, code, n = ta.align_texts(model, [t], memory)
        own = every[2] == i
        assert (numbers[0].tolist(), digests[0]) == (every[0][i].tolist(), every[1][i])
        assert code.tolist() == every[3][own].tolist() and n.tolist() == every[4][own].tolist()
