"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Permutations: sigma, an odd multiply-add on 2**32, and pi, a multiply-xorshift-multiply bijection on 2**32.
Coordinate k is the minimum over the shingles of pi(sigma(x) - k): pi shifted circularly by k. All
coordinates come from these two.

1. Each text gives its shingle count, a 128-bit digest of its whole shingle set, the coordinates' low
   bytes, and band hashes (20 bands of 5 at 85 percent, see banding). Documents with one digest are one class (pre-aggregated).
2. Classes that share a band are compared by signature in bounded blocks; a block emits only a spanning
   forest of the pairs whose estimate could still reach the threshold, so groups never become all pairs.
3. Components of those forests are the places where links can be; only their texts are read again, and
   within each, in bounded blocks, pairs are confirmed on full shingle sets, best estimates first and
   only while they join two parts.
4. Components of the confirmed links are the result."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._shared import Forest, blocks, components, dealt_join, forget, grouped, mix64, save, session, slices, table, utf8, window_hashes, word_hashes, words

WIDTH, COORDINATES = 5, 128
#: Most chance that a pair at the threshold shares no band.
MISSED = 8.06e-6
#: Standard deviations of a 128-coordinate estimate that a true link may fall short by (5 in 3.5 million).
SIGMAS = 5.0
#: Classes in a chunk of a block, and shingles that one numpy step takes.
BLOCK, STEP = 256, 1 << 15
_SIGMA = (np.uint32(0x9E3779B1), np.uint32(0x7F4A7C15))
_PI = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def shingles(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Of each text: the sorted distinct hashes of its shingles (one of the whole sequence under WIDTH words)."""
    starts, ends, first = words(raw, off)
    hashes = word_hashes(raw, starts, ends)
    runs, at = window_hashes(hashes, first, WIDTH)
    out = []
    for i in range(len(off) - 1):
        if at[i + 1] > at[i]:
            out.append(np.unique(runs[at[i] : at[i + 1]]))
        elif first[i + 1] > first[i]:
            n = first[i + 1] - first[i]
            out.append(mix64(np.array([window_hashes(hashes[first[i] : first[i + 1]], np.array([0, n]), int(n))[0][0] + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(flat: np.ndarray, at: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash of sets that lie one after another in flat, none empty: one row of k minima each."""
    out = np.full((k, len(at) - 1), 0xFFFFFFFF, np.uint32)
    base = (flat >> np.uint64(32)).astype(np.uint32) * _SIGMA[0] + _SIGMA[1]
    low = np.searchsorted(at, np.arange(0, len(flat), STEP), side="right") - 1
    for i, lo in zip(range(0, len(flat), STEP), low):
        part = base[i : i + STEP]
        hi = int(np.searchsorted(at, i + len(part), side="left"))
        cut = np.maximum(at[lo:hi] - i, 0)
        x, y = np.empty_like(part), np.empty_like(part)
        for j in range(k):
            np.subtract(part, np.uint32(j), out=x)
            np.multiply(x, _PI[0], out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _PI[1], out=x)
            row = out[j, lo:hi]
            np.minimum(row, np.minimum.reduceat(x, cut), out=row)
    return np.ascontiguousarray(out.T)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows of a band) with which a pair at the threshold is missed with a chance of at most MISSED: the longest bands that the coordinates allow."""
    for rows in range(COORDINATES, 0, -1):
        same = (percent / 100) ** rows
        bands = int(np.ceil(np.log(MISSED) / np.log1p(-same))) if same < 1 else 1
        if bands * rows <= COORDINATES:
            return bands, rows
    raise ValueError(f"{COORDINATES} coordinates are too few for a threshold of {percent} percent")


def _signatures(bands: int, rows: int):
    def run(batches):
        yield from _signed(batches, bands, rows)

    return run


def _signed(batches, n_bands: int, n_rows: int):
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingles(*utf8(part.column("text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            low, bands = [b""] * len(sets), [None] * len(sets)
            if full:
                at = np.zeros(len(full) + 1, np.int64)
                np.cumsum([len(sets[i]) for i in full], out=at[1:])
                m = minima(np.concatenate([sets[i] for i in full]), at)
                of = m[:, : n_bands * n_rows].astype(np.uint64).reshape(len(full), n_bands, n_rows)
                key = np.full((len(full), n_bands), 0, np.uint64) + np.arange(1, n_bands + 1, dtype=np.uint64)
                for r in range(n_rows):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + of[:, :, r])
                bytes_, key = m.astype(np.uint8), key.view(np.int64)
                for row, i in enumerate(full):
                    low[i], bands[i] = bytes_[row].tobytes(), key[row]
            known = part.column("id").is_valid().to_pylist()
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if own else None for s, own in zip(sets, known)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(low, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "text_key", "n_shingles", "digest", "low", "bands"],
            )


def _cut(threshold: float) -> int:
    """Equal low bytes of two signatures under which a pair at the threshold practically never is."""
    p = threshold + (1 - threshold) / 256
    return int(np.floor(COORDINATES * p - SIGMAS * np.sqrt(COORDINATES * p * (1 - p))))


def _pairs(t: pa.Table, cut: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, and the pairs that this block has to compare with their equal low bytes, most first."""
    i, j = t.column("block_i")[0].as_py(), t.column("block_j")[0].as_py()
    ids = t.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    chunk = t.column("chunk").to_numpy()[order]
    low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(-1, COORDINATES)[order]
    n, found = len(ids), []
    for x in range(n - 1):
        equal = (low[x + 1 :] == low[x]).sum(axis=1)
        y = np.flatnonzero(equal >= cut)
        if i != j:
            y = y[chunk[x + 1 + y] != chunk[x]]
        if len(y):
            found.append(np.stack([np.full(len(y), x), x + 1 + y, equal[y]]))
    f = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    f = f[:, np.argsort(-f[2], kind="stable")]
    return order, ids, f[0], f[1]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _emit(ids: np.ndarray, edges: list[tuple[int, int]]):
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], schema=_EDGES)


def _roots(ids: np.ndarray, forest: Forest):
    """The forest as edges from each row to its root, the smallest id of its part."""
    return _emit(ids, [(r, x) for x in range(len(ids)) if (r := forest.root(x)) != x])


def _likely(key: str, cut: int):
    def run(batches):
        for _, t in grouped(batches, [key, "block_i", "block_j"]):
            _, ids, xs, ys = _pairs(t, cut)
            forest = Forest(len(ids))
            for x, y in zip(xs.tolist(), ys.tolist()):
                forest.join(x, y)
            yield _roots(ids, forest)

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = int(np.count_nonzero(b[at] == a))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _confirmed(key: str, cut: int, percent: int):
    def run(batches):
        for _, t in grouped(batches, [key, "block_i", "block_j"]):
            order, ids, xs, ys = _pairs(t, cut)
            raw = t.column("shingles").to_pylist()
            sets = [np.frombuffer(raw[i], np.uint64) for i in order]
            forest = Forest(len(ids))
            for x, y in zip(xs.tolist(), ys.tolist()):
                if forest.root(x) != forest.root(y) and _linked(sets[x], sets[y], percent):
                    forest.join(x, y)
            yield _roots(ids, forest)

    return run


def _sets(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingles(*utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])


def _in_blocks(df: DataFrame, key: str, run) -> DataFrame:
    dealt = blocks(df, key, "id", BLOCK).repartition(key, "block_i", "block_j").sortWithinPartitions(key, "block_i", "block_j")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text", text_key: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of docs.

    Words are runs of other than space, tab, CR, LF, VT and FF, with A-Z lower-cased; a document's set is
    its distinct runs of five words, or its whole sequence as one with fewer words. Two documents link
    when 100 * |intersection| >= percent * |union|, counted on full sets; component_id is the smallest
    id reachable and kept says that the row has that id. Null and empty texts have no shingle and are
    their own component. Repeated texts fall in one class before anything is compared. Ids must be
    integers. A row without an id links with nothing, has no component_id and is kept; rows that share an
    id are one document, each with the component of its own text; with text_key a column of that name,
    the md5 of the text (null: of an empty one), tells them apart. Other columns are not read."""
    session(docs)
    kind = docs.schema[id_column].dataType
    key = F.md5(F.coalesce(F.col(text_column), F.lit(""))) if text_key else F.lit(None).cast("string")
    src = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), key.alias("text_key"))
    signed = save(src.mapInArrow(_signatures(*banding(percent)), "id long, text_key string, n_shingles long, digest binary, low binary, bands array<long>"))
    some = signed.where("n_shingles > 0 AND id IS NOT NULL")
    classes = save(some.groupBy("digest").agg(F.min(F.struct("id", "low", "bands")).alias("first")).select("digest", "first.*"))
    cut = _cut(percent / 100)
    banded = classes.select("id", "low", F.explode("bands").alias("band"))
    shared = classes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    met = save(banded.join(shared, "band", "left_semi"))
    joined = components(_in_blocks(met, "band", _likely("band", cut)))
    forget(met)
    places = joined.withColumnsRenamed({"node": "id", "component": "place"})
    sets = src.join(places.select("id"), "id", "left_semi").mapInArrow(_sets, "id long, shingles binary")
    met = save(places.join(classes.select("id", "low"), "id").join(sets, "id"))
    found = components(_in_blocks(met, "place", _confirmed("place", cut, percent))).withColumnsRenamed({"node": "first_id", "component": "component_"})
    forget(met, joined)
    firsts = classes.select("digest", F.col("id").alias("first_id")).join(found, "first_id", "left").select("digest", F.coalesce("component_", "first_id").alias("component_id"))
    out = dealt_join(signed.select("id", *["text_key"] * text_key, "n_shingles", "digest"), firsts, "digest", "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    kept = F.col("id").eqNullSafe(component).alias("kept")
    return out.select(F.col("id").cast(kind).alias(id_column), "n_shingles", component.cast(kind).alias("component_id"), kept, *["text_key"] * text_key)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, root FROM reach JOIN l ON reach.id = l.a), c AS (SELECT id, min(root) AS root FROM reach GROUP BY 1)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""
