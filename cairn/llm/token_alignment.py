"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another.

A text is cut into units where a space follows a character that is no white space. No token of either
tokenizer lies across such a cut: A's pre-tokenizer always cuts there, and no piece of B holds a space after
something else (both are checked). So units are encoded once and remembered up to a bound, and groups never
leave a unit.

1. A map gives for each A id the B id of the same bytes. Pairs on it, which is what one-to-one groups are made
   of, are counted in a vector as long as A's vocabulary.
2. Other pairs come from irregular groups only. Tasks count them before they are shuffled.
3. Of the pairs' counts the most frequent HEAD at most are sent to all tasks with the vector; a pair that is
   not among them is in at most one of HEAD / 2 of all occurrences, and only such pairs are joined."""

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._shared import save, session, slices, table

#: Bytes of text in one call of a tokenizer; units and characters of them that a worker remembers before it begins anew; pairs of tokens from which a group is counted by distinct ids.
BATCH_BYTES, UNITS, UNIT_BYTES, WIDE = 1 << 18, 1 << 19, 1 << 25, 1 << 12
#: Pairs that a task counts at once; pairs whose counts are sent to every task (16 bytes each).
BUFFER, HEAD = 1 << 20, 1 << 17
#: Where texts are cut: before a space after a character that is no white space.
_CUT, _BLANKS = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
_SPACE = "▁"
_loaded: dict = {}


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, and the others as letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def bytes_of_a(path: str) -> list[bytes]:
    """What each id of a byte-level .json stands for; special tokens as their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, words = _byte_letters(), dict(spec["model"]["vocab"])
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
    out = [b""] * (max([*words.values(), *special.values()]) + 1)
    for word, i in words.items():
        out[i] = word.encode() if word in special else bytes(map(letters.__getitem__, word))
    return out


def _cuts(path: str) -> bool:
    """Whether a .json has no normalizer and the plain byte-level pre-tokenizer, which begins a piece at a space after other characters."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def bytes_of_b(model) -> list[bytes]:
    """What each id of a sentencepiece model stands for; control tokens as nothing."""
    return [
        b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode()
        for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    ]


class Aligner:
    """Both tokenizers, their tokens' bytes, and the map of A ids to B ids of the same bytes (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = bytes_of_a(path_a), bytes_of_b(self.b)
        if not _cuts(path_a) or any(re.search(rb"[^ ] ", x) for x in self.bytes_b):
            raise ValueError("a token can lie across a space after other characters: texts can't be cut there")
        first = {}
        for i, x in enumerate(self.bytes_b):  # of ids with the same bytes the piece, not the lone byte before it
            first[x] = i
        self.same = np.array([first.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(_SPACE)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of texts that begin with a space, which B adds by itself, but not to nothing."""
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [x or [self.space] for x in self.b.encode([t[1:] for t in texts], num_threads=1)]
        return a, b

    def returned(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether both sides give the text back byte by byte."""
        raw = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))


def aligner(path_a: str, path_b: str) -> tuple[Aligner, "Memory"]:
    """A worker's own; its tasks share what it remembers."""
    key = (path_a, path_b)
    if key not in _loaded:
        _loaded[key] = Aligner(path_a, path_b), Memory()
    return _loaded[key]


def cut(text: str | None) -> list[str]:
    """The units of a space and the text, each without its first character, which is a space."""
    if not text:
        return []
    if text[0] == " " or text[-1].isspace() or _BLANKS.search(text):
        return [u[1:] for u in _CUT.split(" " + text)]
    return text.split(" ")


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + counts[i] - 1, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _summed(row: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of n by (row, code), in that order."""
    if not len(row):
        return row, code, n
    order = np.lexsort((code, row))
    row, code, n = row[order], code[order], n[order]
    starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
    return row[starts], code[starts], np.add.reduceat(n, starts)


def aligned_units(model: Aligner, ends: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Of units laid end to end, which end at the bytes `ends` and have the tokens a and b: per unit the
    numbers (n_a, n_b, n_groups, n_links) and groups as text, and (unit, pair code, how often) arrays."""
    ends_a, ends_b = np.cumsum(model.sizes_a[a]), np.cumsum(model.sizes_b[b])
    shared = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    m = len(shared)
    in_a, in_b, unit = np.bincount(group_a, minlength=m), np.bincount(group_b, minlength=m), np.searchsorted(ends, shared)
    at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    total = lambda n: np.bincount(unit, n, len(ends)).astype(np.int64)
    numbers = np.stack([total(in_a), total(in_b), total(np.ones(m)), total(in_a.astype(float) * in_b)], axis=1)
    wide = in_a * in_b > WIDE
    times = np.where(wide[group_a], 0, in_b[group_a])
    units = [np.repeat(unit[group_a], times)]
    codes = [np.repeat(a, times) << 32 | b[_ragged(at_b[group_a], times)]]
    often = [np.ones(len(codes[0]), np.int64)]
    for g in np.flatnonzero(wide).tolist():  # each pair of ids once, however often it occurs
        (x, n), (y, k) = (np.unique(t[at[g] : at[g] + size[g]], return_counts=True) for t, at, size in ((a, at_a, in_a), (b, at_b, in_b)))
        codes.append((x[:, None] << 32 | y[None, :]).ravel())
        often.append((n[:, None] * k[None, :]).ravel())
        units.append(np.full(len(codes[-1]), unit[g]))
    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[at_a + in_a - 1] = 1
    mark_b[at_b + in_b - 1] = np.where(np.append(unit[1:] != unit[:-1], True), 3, 2) if m else 0
    text = [""] * (2 * len(order))
    text[::2] = map(str, np.concatenate([a, b])[order].tolist())
    text[1::2] = np.array([",", "|", ";", "\n"], object)[np.concatenate([mark_a, mark_b])[order]].tolist()
    return numbers, "".join(text).split("\n")[:-1], *_summed(*map(np.concatenate, (units, codes, often)))


class Memory:
    """What aligned_units tells of each unit, by its place; units that a side doesn't give back are bad."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.places, self.size, self.texts = {}, 0, []
        self.bad, self.numbers, self.lengths = np.zeros(0, bool), np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        self.codes = self.often = np.zeros(0, np.int64)

    def _add(self, units: list[str], numbers, texts: list[str], unit, code, often, bad: bool = False) -> None:
        at = len(self.texts)
        self.places.update(zip(units, range(at, at + len(units))))
        self.texts += texts
        self.bad = np.append(self.bad, np.full(len(units), bad))
        self.numbers = np.concatenate([self.numbers, numbers])
        self.lengths = np.append(self.lengths, np.bincount(unit, minlength=len(units)))
        self.codes, self.often = np.append(self.codes, code), np.append(self.often, often)
        self.first = np.cumsum(self.lengths) - self.lengths

    def learn(self, model: Aligner, units: list[str]) -> None:
        """Units that end in no white space are encoded one after the other in one text, as no token lies across; the others by themselves."""
        parts, size = [[]], 0
        for u in units:
            self.size += len(u)
            if not u or u[-1].isspace():
                parts.insert(0, [u])
                continue
            if parts[-1] and size + len(u) > BATCH_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(u)
            size += len(u) + 1
        self._learn(model, [p for p in parts if p])

    def _learn(self, model: Aligner, parts: list[list[str]]) -> None:
        again = []
        for k in range(0, len(parts), 512):
            some = parts[k : k + 512]
            texts = [" " + " ".join(p) for p in some]
            own, a, b = [], [], []
            for p, t, x, y in zip(some, texts, *model.encode(texts)):
                if model.returned(t, x, y):
                    own += p
                    a += x
                    b += y
                elif len(p) == 1:
                    self._add(p, np.zeros((1, 4), np.int64), [""], *(np.zeros(0, np.int64),) * 3, bad=True)
                else:
                    again += [[u] for u in p]
            if own:
                ends = np.cumsum([len(u.encode()) + 1 for u in own])
                self._add(own, *aligned_units(model, ends, np.array(a, np.int64), np.array(b, np.int64)))
        if again:
            self._learn(model, again)


def align_texts(model: Aligner, texts: list[str], memory: Memory):
    """Of each text (n_a, n_b, n_groups, n_links, sha256 of its groups); and (text, pair code, how often) arrays, each pair of a text once."""
    own = [cut(t) for t in texts]
    every = set().union(*own)
    new = [u for u in every if u not in memory.places]
    if new and (memory.size + sum(map(len, new)) > UNIT_BYTES or len(memory.places) + len(new) > UNITS):
        memory.clear()
        new = list(every)
    memory.learn(model, new)
    sizes = np.array([len(u) for u in own], np.int64)
    at = np.fromiter((memory.places[u] for units in own for u in units), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    good = np.bincount(doc, memory.bad[at], len(texts)) == 0
    numbers = np.zeros((len(texts), 4), np.int64)
    for k in range(4):
        numbers[:, k] = np.bincount(doc, memory.numbers[at, k], len(texts))
    numbers[~good] = 0
    names, to, digests = list(map(memory.texts.__getitem__, at.tolist())), 0, []
    for size, ok in zip(sizes.tolist(), good.tolist()):
        digests.append(hashlib.sha256(";".join(names[to : to + size]).encode()).hexdigest() if ok and size else "")
        to += size
    at, doc = at[good[doc]], doc[good[doc]]
    both, times = np.unique(doc << 32 | at, return_counts=True)
    doc, at = both >> 32, both & 0xFFFFFFFF
    n = memory.lengths[at]
    place = _ragged(memory.first[at], n) if len(at) else at
    return numbers, digests, *_summed(np.repeat(doc, n), memory.codes[place], memory.often[place] * np.repeat(times, n))


def _lists(doc: np.ndarray, n_docs: int, values: np.ndarray, kind) -> pa.ListArray:
    ends = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind)))


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_NAMES = ["id_", *_NUMBERS, "groups_sha256", "same", "same_n", "pairs", "pairs_n"]


def _aligned(path_a: str, path_b: str):
    def run(batches):
        model, memory = aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "text"):
                numbers, digests, doc, code, n = align_texts(model, part.column("text").to_pylist(), memory)
                own, rows = model.same[code >> 32] == code & 0xFFFFFFFF, part.num_rows
                columns = [part.column("id_"), *(pa.array(x) for x in numbers.T), pa.array(digests, pa.string())]
                columns += [_lists(doc[own], rows, code[own] >> 32, np.int32), _lists(doc[own], rows, n[own], np.int64)]
                columns += [_lists(doc[~own], rows, code[~own], np.int64), _lists(doc[~own], rows, n[~own], np.int64)]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return run


def _counted_same(size: int):
    """How many rows of a partition hold each A id on the map."""

    def run(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("same").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["a", "n"])

    return run


def _counted_pairs(batches):
    """How many rows hold each pair, added up over BUFFER pairs or so."""
    held, size = [], 0

    def summed():
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["pair", "n"])

    for batch in batches:
        held.append(batch.column("pairs").flatten().to_numpy())
        size += len(held[-1])
        if size >= BUFFER:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


def _looked_up(same, head, head_n, best, tail: bool):
    """Rows with n_best and count_sum as far as the counts at hand tell; or the pairs whose counts are not at hand."""

    def sums(lists: pa.ListArray, values: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(values)])
        off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ends[off[1:]] - ends[off[:-1]]

    def run(batches):
        for batch in batches:
            pairs, n = batch.column("pairs"), batch.column("pairs_n").flatten().to_numpy()
            code = pairs.flatten().to_numpy()
            at = np.minimum(np.searchsorted(head.value, code), max(len(head.value) - 1, 0))
            known = head.value[at] == code if len(head.value) else np.zeros(len(code), bool)
            if tail:
                off = pairs.offsets.to_numpy()
                rows = np.repeat(batch.column("row_").to_numpy(), np.diff(off))
                yield pa.RecordBatch.from_arrays([pa.array(x[~known]) for x in (rows, code, n)], ["row_", "pair", "times"])
                continue
            a, m = batch.column("same").flatten().to_numpy(), batch.column("same_n").flatten().to_numpy()
            count = np.where(known, head_n.value[at], 0) if len(head.value) else np.zeros(len(code), np.int64)
            won = known & (count == best.value[code >> 32])
            n_best = sums(pairs, n * won) + sums(batch.column("same"), m * (same.value[a] == best.value[a]))
            total = sums(pairs, n * count) + sums(batch.column("same"), m * same.value[a])
            columns = [batch.column(c) for c in ("row_", "id_", *_NUMBERS, "groups_sha256")] + [pa.array(n_best), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["row_", "id_", *_NUMBERS, "groups_sha256", "n_best", "count_sum"])

    return run


def alignment(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", head: int = HEAD) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level BPE of the tokenizers library (.json), path_b: a sentencepiece model with byte
    fallback (.model), at the same place on every worker. A encodes a space and the text, B the text, to
    which it adds the space. Null and empty texts, and texts which a side doesn't give back byte by byte (such
    as those with U+2581, which B takes as a space), have no tokens: zeros and ''. Rows without an id and
    repeated rows are rows of their own, and each counts. A pair's count is the number of rows that hold it
    linked. An empty table gives an empty one. Other columns are not read. A run without spaces is one unit,
    encoded as a whole, so that a task's memory grows with the longest such run.

    Ids of B with the same bytes: the last one is on the map, pairs with the others are irregular ones. What
    reaches the driver is bounded: a count and a maximum for each A id, and `head` counts of pairs."""
    spark = session(docs)
    kind = docs.schema[id_column].dataType.simpleString()
    src = docs.select(F.col(id_column).alias("id_"), F.col(text_column).alias("text"))
    schema = f"id_ {kind}, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string, same array<int>, same_n array<long>, pairs array<long>, pairs_n array<long>"
    rows = save(src.mapInArrow(_aligned(path_a, path_b), schema).withColumn("row_", F.monotonically_increasing_id()))
    size = len(aligner(path_a, path_b)[0].same)
    same, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in rows.select("same").mapInArrow(_counted_same(size), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        same[r["a"]] = r["n"]
    counts = save(rows.select("pairs").mapInArrow(_counted_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    for r in counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = r["n"]
    best = np.maximum(best, same)
    sizes = {r["level"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()}
    least, held = 1 + max(sizes, default=0), 0
    while least and held + sizes.get(least - 1, 0) <= head:
        least -= 1
        held += sizes.get(least, 0)
    frequent = F.floor(F.log2("n")) >= least
    top = counts.where(frequent).toPandas().sort_values("pair")
    sent = [spark.sparkContext.broadcast(x) for x in (same, top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), best)]
    out = rows.mapInArrow(_looked_up(*sent, tail=False), f"row_ long, id_ {kind}, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string, n_best long, count_sum long")
    names = [F.col("id_").alias(id_column), *_NUMBERS, "n_best", "count_sum", "groups_sha256"]
    if not least:
        return out.select(*names)
    rest = rows.select("row_", "pairs", "pairs_n", "same", "same_n").mapInArrow(_looked_up(*sent, tail=True), "row_ long, pair long, times long")
    tops = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, top long")  # a row for each A id at most
    scored = counts.where(~frequent).withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(tops), "a")
    more = rest.join(scored, "pair").groupBy("row_").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("best_"), F.sum(F.col("times") * F.col("n")).alias("sum_"))
    both = out.join(more, "row_", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("best_", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("sum_", F.lit(0))).select(*names)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
