"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, where the tokenizer itself always cuts and no special token can lie
across, so that the lengths of the pieces add up to the length of the whole and long texts are encoded in
bounded memory. What stays whole is a run of letters or of signs without white space (such as unspaced Japanese
or a line of letters only), as the tokenizer takes it as one piece, too. The distinct pieces of an Arrow batch are encoded in batches balanced by bytes,
and their lengths are remembered for the next ones up to a bound in bytes."""

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._shared import session, table

#: Bytes of text in one call of the tokenizer, from how many bytes a piece without white space is cut, and bytes of remembered pieces, after which a worker begins anew.
BATCH_BYTES, PART_BYTES, CACHE_BYTES = 1 << 18, 1 << 14, 1 << 25
_loaded: dict = {}

#: The normalizer and pre-tokenizer of word-level byte BPE, the only pipeline whose boundaries are known here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: That pipeline drops white space, and takes each digit as a token of its own.
_SAFE = re.compile(rb"(?<=[0-9])(?=[0-9])")
#: Special strings that hold no white space and no two digits in a row can't lie across such a boundary.
_ACROSS = re.compile(r"\s|[0-9][0-9]")


def _cuts_are_safe(spec: dict) -> bool:
    return spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _PRE_TOKENIZER and not any(_ACROSS.search(t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or ())


def _tokenizer(path: str):
    """Of a tokenizer's file: the lengths of a list of texts, and whether texts may be cut."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            with open(path, encoding="utf-8") as f:
                safe = _cuts_are_safe(json.load(f))
            _loaded[path] = (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], safe)
    return _loaded[path]


def pieces(text: bytes) -> list[bytes]:
    """The text without white space, cut there and, in longer runs, at the first safe boundary after each PART_BYTES."""
    out = text.split()
    if len(text) > PART_BYTES and max(map(len, out), default=0) > PART_BYTES:
        cut, out = out, []
        for piece in cut:
            at = 0
            while len(piece) - at > PART_BYTES and (m := _SAFE.search(piece, at + PART_BYTES)):
                out.append(piece[at : m.start()])
                at = m.start()
            out.append(piece[at:])
    return out


def _encoded(lengths, texts: list[bytes]) -> list[int]:
    """The length of each text, from calls of about BATCH_BYTES each."""
    out, batch, size = [], [], 0
    for text in texts:
        if batch and size + len(text) > BATCH_BYTES:
            out += lengths(batch)
            batch, size = [], 0
        batch.append(text.decode())
        size += len(text)
    return out + (lengths(batch) if batch else [])


class Memory(dict):
    """Lengths by piece, and the bytes of the pieces."""

    size = 0

    def learn(self, lengths, found: list[bytes]) -> None:
        self.size += sum(map(len, found))
        self.update(zip(found, _encoded(lengths, found)))


def text_lengths(lengths, texts: list[bytes], memory: Memory | None) -> list[int]:
    """Tokens of each text; in pieces if there is a memory for them."""
    if memory is None:
        return _encoded(lengths, texts)
    out, at = [], 0
    while at < len(texts):  # so many texts at once that their pieces fit in memory
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_BYTES * 4):
            size += len(texts[to])
            to += 1
        cut = [pieces(t) for t in texts[at:to]]
        every = set().union(*cut)
        new = [x for x in every if x not in memory]
        if new and memory.size + sum(map(len, new)) > CACHE_BYTES:
            memory.clear()
            memory.size, new = 0, list(every)
        memory.learn(lengths, new)
        out += [sum(map(memory.__getitem__, x)) for x in cut]
        at = to
    return out


def _counted(path: str, id_column: str):
    def run(batches):
        lengths, cut = _tokenizer(path)
        memory = Memory() if cut else None
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            n = text_lengths(lengths, texts, memory)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array([len(x) for x in texts], pa.int64()), pa.array(n, pa.int64())], [id_column, "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: the tokenizer's file (.json or .model), at the same place on every worker. A null text is
    empty: 0 bytes, 0 tokens. Rows without an id and repeated rows are counted each. Other columns of docs
    are not read. Texts are cut only for a .json with the very normalizer and pre-tokenizer above;
    other tokenizers encode whole texts. No shuffle."""
    session(docs)
    kind = docs.schema[id_column].dataType.simpleString()
    src = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    return src.mapInArrow(_counted(path, id_column), f"`{id_column}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
