"""What the training-data operators share: Arrow slices, word and shingle kernels, blocks for comparisons."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.tables import components, dealt_join, forget, save, scratch

__all__ = ["components", "dealt_join", "forget", "save", "scratch"]

#: Bytes of text that one numpy step works on; bounds a task's memory whatever the batch holds.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The session of df, with Arrow batches that stay small when rows are long.

    Plans are run after an operator has returned, so the two limits stay lowered; smaller ones are left as they are."""
    spark = df.sparkSession
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark


def one_label(labels: DataFrame, label: str, id_column: str) -> DataFrame:
    """(id, label_), one row per id: of conflicting labels of an id the least; rows without id or label are left out."""
    return labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(F.col(label).cast("int")).alias("label_"))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.float64))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts; nulls are empty."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = _rng.integers(1, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space, and each text's first word."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink, edge = ~WHITE[raw], np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    np.logical_not(ink[:-1], out=before[1:])
    np.logical_not(ink[1:], out=after[:-1])
    starts = np.flatnonzero(ink & (before | edge[:-1]))
    ends = np.flatnonzero(ink & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_FOLDED[raw] * p[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts])


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within a text, and each text's first one. Shorter texts have none."""
    n = len(hashes) - width + 1
    counts = np.maximum(first[1:] - first[:-1] - width + 1, 0)
    at = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=at[1:])
    if n <= 0 or not at[-1]:
        return np.zeros(0, np.uint64), at
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * _MIX[j]
    keep = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    return mix64(out[keep]), at


class Forest:
    """Union-find over the rows of one block; the smaller index becomes the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def grouped(batches, keys: list[str]):
    """Record batches of a partition sorted by `keys`, regrouped into one table per key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for at, to in zip(starts, starts[1:]):
            key = tuple(c[at] for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


#: Bits of a bitmap, as a power of two: 8 MB, whatever it is made from; and bytes of it that travel as one row.
BITS, CHUNK = 26, 1 << 12


def _chunks(batches):
    """The slots of a partition as the chunks of a bitmap that have a bit set."""
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for b in batches:
        slot = b.column("slot").to_numpy()
        np.bitwise_or.at(bits, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
    rows = bits.reshape(-1, CHUNK)
    some = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["chunk", "bits"])


def _ored(batches):
    for (chunk,), t in grouped(batches, ["chunk"]):
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["chunk", "bits"])


def bitmap(slots: DataFrame) -> np.ndarray:
    """The set of a column `slot` as 2**BITS bits: partitions make bitmaps, tasks unite them, and the driver gets 8 MB at most."""
    schema = "chunk long, bits binary"
    made = slots.mapInArrow(_chunks, schema).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_ored, schema)
    out = np.zeros((1 << (BITS - 3)) // CHUNK * CHUNK, np.uint8).reshape(-1, CHUNK)
    for r in made.collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def row_key(id_: str | Column, digest: str | Column) -> Column:
    """A row's id and the md5 of its text as one string, which no two different rows share."""
    one = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat_ws("|", F.coalesce(one(id_).cast("string"), F.lit("")), one(digest))


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key (a string) isn't in the column gone_key of gone; no column is added or lost.

    A bitmap of fixed size over hashes of keys tells for most rows that they stay; only the others are
    shuffled, with their texts, to meet the keys themselves."""
    spark = docs.sparkSession
    slot = lambda k: F.shiftrightunsigned(F.xxhash64(k), 64 - BITS)
    bits = spark.sparkContext.broadcast(bitmap(gone.select(slot("gone_key").alias("slot"))))

    @F.pandas_udf("boolean")
    def doubtful(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    some = doubtful(slot(key))
    return docs.where(~some).union(docs.where(some).join(gone, key == gone["gone_key"], "left_anti"))


def blocks(df: DataFrame, key: str, row: str, most: int) -> DataFrame:
    """df dealt into blocks for comparisons within `key`: adds block_i <= block_j.

    A group of m rows is cut into c = ceil(m / most) chunks and each row goes to the c blocks that pair
    its chunk with another, so any two rows of a group meet in a block of 2 * most rows or so, and no
    group meets in one task. Rows whose group has no second row are left out."""
    sizes = df.groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
    chunks = dealt_join(df, sizes, key, row).withColumn("chunks", F.ceil(F.col("members") / most).cast("int"))
    mine = F.pmod(F.xxhash64(F.lit(11), row), F.col("chunks")).cast("int")
    return (
        chunks.withColumn("chunk", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("block_i", F.least("chunk", "other"))
        .withColumn("block_j", F.greatest("chunk", "other"))
        .drop("other", "chunks", "members")
    )
