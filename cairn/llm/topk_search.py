"""Exact top-k search by inner product over an impact-ordered index, score at a time.

1. Vectors become integers. Equal ones are one class that keeps the k + 1 least ids, as no more can be among
   the best of a query. Classes are dealt into shards of a bounded size by the signs of random projections, and
   each shard is an index of its own: a posting (class, component, value) lies in the segment of its quantised
   impact, and segments lie in descending order of impact. Beside them lies how much norm each class has left
   after each segment.
2. Queries search their home shard first, and the (k + 1)th best score there bounds theirs from below. They
   go on only to shards whose centre and radius don't prove that nothing in them is as good.
3. A task has one shard and one block of queries. It adds up segments from the highest impact down. After
   each, what is left of a class and the norm of the query tell how far a score can still move, so that the
   (k + 1)th best of the least scores rules out classes for good. When few enough are left, and not
   before it is proven that no other can be a member, they are scored exactly.
4. The best k + 1 of each query over all shards, less the query's own row, are the result."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._shared import dealt_join, grouped, save, session, table
from cairn.llm.embedding_dedup import Planes, matrices

#: Classes in a shard, queries in a block, quantised impacts, shards that are told apart at once.
SHARD, QUERIES, LEVELS, SHARDS = 2048, 512, 16, 1024
#: The greatest size of an integer component: sums of 8,192 products stay exact in double precision.
MOST = 1 << 20
#: Pairs whose exact scores are computed at once.
PAIRS = 1 << 15
_INDEX = "bucket long, chunk int, n int, ids array<array<long>>, digests array<binary>, vecs binary, rows binary, dims binary, ends binary, left binary, center binary, radius double"
_FOUND = "digest binary, id long, score long, own boolean"


def _read(scale: int):
    def run(batches):
        for batch in batches:
            column, known = batch.column("vec"), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            lengths = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ends = np.cumsum(lengths)
            use = np.flatnonzero(known & (lengths > 0) & (bad[ends] == bad[ends - lengths]))
            raw = []
            for i in use.tolist():
                x = np.floor(scale * flat[ends[i] - lengths[i] : ends[i]])
                if len(x) > 8192 or np.abs(x).max() > MOST:
                    raise ValueError(f"a vector has more than 8192 components, or one beyond {MOST} / {scale}")
                raw.append(x.astype("<i4").tobytes())
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(use)), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["id", "digest", "vec"])

    return run


def _bucketed(planes: Planes):
    def run(batches):
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            bucket = np.zeros(len(raw), np.int64)
            for rows, x in matrices(raw, "<i4"):
                bucket[rows] = planes.codes(x)[0][:, 0] + (x.shape[1] << 32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("digest", "vec")), pa.array(bucket)], ["digest", "vec", "bucket"])

    return run


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), -1).astype(np.float64)


def postings(x: np.ndarray):
    """Of a shard's matrix the rows and components of its postings in descending order of quantised impact, where each of the LEVELS segments ends, and the norm that each row has left after it (rounded up)."""
    level = (np.abs(x) * LEVELS // (np.abs(x).max(initial=0.0) + 1)).astype(np.int64)
    rows, dims = np.nonzero(x)
    order = np.argsort(-level[rows, dims], kind="stable")
    ends = np.cumsum(np.bincount(LEVELS - 1 - level[rows, dims], minlength=LEVELS))
    left = np.stack([np.sqrt((np.where(level < LEVELS - 1 - s, x, 0.0) ** 2).sum(axis=1)) * (1 + 1e-12) for s in range(LEVELS)])
    return rows[order].astype(np.int32), dims[order].astype(np.int32), ends, left


def _indexed(batches):
    for (bucket, chunk), t in grouped(batches, ["bucket", "chunk"]):
        x = _matrix(t.column("vec"))
        rows, dims, ends, left = postings(x)
        center = x.mean(axis=0)
        radius = float(np.sqrt(((x - center) ** 2).sum(axis=1)).max()) * (1 + 1e-9)
        blobs = [pa.array([b.tobytes()], pa.binary()) for b in (x.astype("<i4"), rows, dims, ends, left, center)]
        lists = [pa.array([t.column(c).to_pylist()], kind) for c, kind in (("ids", pa.list_(pa.list_(pa.int64()))), ("digest", pa.list_(pa.binary())))]
        columns = [pa.array([bucket], pa.int64()), pa.array([chunk], pa.int32()), pa.array([len(x)], pa.int32()), *lists, *blobs, pa.array([radius])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "n", "ids", "digests", "vecs", "rows", "dims", "ends", "left", "center", "radius"])


def members(x: np.ndarray, least: np.ndarray, index, q: np.ndarray, theta: np.ndarray, k: int, tally: list | None = None):
    """(query, row, score) arrays: for each query the k rows of the highest scores of at least its theta, ties by `least`.

    index: as postings() gives it. tally, if given, gets (postings added up, pairs scored, all postings, all pairs)."""
    rows, dims, ends, left = index
    size = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-12)
    alive, acc = np.arange(len(q)), np.zeros((len(x), len(q)))
    found, at, added, scored = [], 0, 0, 0
    for s in range(LEVELS):
        segment = np.zeros_like(x)
        r, d = rows[at : ends[s]], dims[at : ends[s]]
        segment[r, d] = x[r, d]
        acc += segment @ q[alive].T
        added += len(r) * len(alive)
        at = ends[s]
        if 2 * at < len(rows) and s < LEVELS - 1:
            continue  # too early for a proof
        slack = left[s][:, None] * size[alive][None, :] * (1 + 1e-9)
        bound = theta[alive]
        if len(x) > k:
            bound = np.maximum(bound, np.partition(acc - slack, len(x) - k, axis=0)[len(x) - k])
        member = acc + slack >= bound
        few = (member.sum(axis=0) <= max(4 * k, len(x) // 32)) | (s == LEVELS - 1)
        i, j = np.nonzero(member[:, few])
        own = alive[few][j]
        scored += len(i)
        for p in range(0, len(i), PAIRS):
            a, b = i[p : p + PAIRS], own[p : p + PAIRS]
            found.append((b, a, (x[a] * q[b]).sum(axis=1)))
        alive, acc = alive[~few], acc[:, ~few]
        if not len(alive):
            break
    if tally is not None:
        tally.append((added, scored, len(rows) * len(q), len(x) * len(q)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    who, row, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((least[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    start = np.searchsorted(who, who)
    keep = (np.arange(len(who)) - start < k) & (score >= theta[who])
    return who[keep], row[keep], score[keep].astype(np.int64)


def _loaded(shard: dict):
    x = np.frombuffer(shard["vecs"], "<i4").reshape(shard["n"], -1).astype(np.float64)
    left = np.frombuffer(shard["left"], np.float64).reshape(LEVELS, -1)
    return x, (np.frombuffer(shard["rows"], np.int32), np.frombuffer(shard["dims"], np.int32), np.frombuffer(shard["ends"], np.int64), left)


def _searched(k: int):
    """One shard and a block of queries (digest, vec, theta): rows of the k best members' ids, and which are of the query's own class."""

    def run(_, queries: pa.Table, shards: pa.Table) -> pa.Table:
        out = {"digest": [], "id": [], "score": [], "own": []}
        if queries.num_rows and shards.num_rows:
            shard = shards.slice(0, 1).to_pylist()[0]
            x, index = _loaded(shard)
            digests, theta = queries.column("digest").to_pylist(), queries.column("theta").to_numpy()
            least = np.array([ids[0] for ids in shard["ids"]], np.int64)
            for who, row, score in zip(*(c.tolist() for c in members(x, least, index, _matrix(queries.column("vec")), theta, k))):
                ids = shard["ids"][row]
                out["digest"] += [digests[who]] * len(ids)
                out["id"] += ids
                out["score"] += [score] * len(ids)
                out["own"] += [shard["digests"][row] == digests[who]] * len(ids)
        return pa.table({"digest": pa.array(out["digest"], pa.binary()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.int64()), "own": pa.array(out["own"], pa.bool_())})

    return run


def _open_shards(_, queries: pa.Table, shards: pa.Table) -> pa.Table:
    """Pairs of a query and a shard, not its home, whose vectors may score as high as theta."""
    at_q, at_s = [], []
    if queries.num_rows and shards.num_rows:
        homes = np.stack([queries.column(c).to_numpy() for c in ("bucket", "chunk")], axis=1)
        places = np.stack([shards.column(c).to_numpy() for c in ("bucket", "chunk")], axis=1)
        theta, radius = queries.column("theta").to_numpy(), shards.column("radius").to_numpy()
        q = _matrix(queries.column("vec"))
        centers = np.stack([np.frombuffer(c, np.float64) for c in shards.column("center").to_pylist()])
        size = np.sqrt((q * q).sum(axis=1))
        slack = 1e-9 * size[:, None] * (1 + radius + np.sqrt((centers**2).sum(axis=1)))[None, :]
        can = q @ centers.T + size[:, None] * radius[None, :] + slack >= theta[:, None]
        can &= (homes[:, None, :] != places[None, :, :]).any(axis=2)
        at_q, at_s = np.nonzero(can)
    at_q, at_s = pa.array(at_q, pa.int64()), pa.array(at_s, pa.int64())
    own, of = queries.take(at_q), shards.take(at_s)
    return pa.table({"digest": own.column("digest"), "vec": own.column("vec"), "theta": own.column("theta"), "bucket": of.column("bucket"), "chunk": of.column("chunk"), "qb": own.column("qb")})


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; each task drops the others before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("score"), "id", F.desc("own")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k highest scores over all other rows (all, if fewer), ties to the smaller id.

    Component x of a vector becomes floor(scale * x); one beyond 2**20, or more than 8,192 of them, is an error.
    Queries are the rows whose id is divisible by `every`. Vectors that are null, empty, or hold null or
    non-finite components take no part, nor do rows without an id; vectors of different lengths aren't compared.
    Rows that repeat both id and vector are one row; rows that share only the id are rows of their own, so
    that one can be found by the other and each is a query. Ids must be integers. An empty table, and one
    without queries, give an empty result. Other columns are not read."""
    session(vectors)
    src = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec"))
    read = save(src.mapInArrow(_read(scale), "id long, digest binary, vec binary"))
    pairs = save(read.select("digest", "id").distinct())
    few = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("rank") <= k + 1)
    ids = few.groupBy("digest").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vecs = save(read.groupBy("digest").agg(F.min("vec").alias("vec")))
    bits = min(24, max(0, round(math.log2(max(vecs.count(), 1) / SHARD))))
    placed = vecs.mapInArrow(_bucketed(Planes(bits, 1, seed)), "digest binary, vec binary, bucket long")
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("chunks"))
    placed = save(dealt_join(placed, sizes, "bucket", "digest").withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "digest"), F.col("chunks")).cast("int")).drop("chunks"))
    index = save(placed.join(ids, "digest").repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk").mapInArrow(_indexed, _INDEX))

    asked = pairs.where(F.pmod("id", F.lit(every)) == 0)
    own = placed.join(asked.select("digest").distinct(), "digest")
    blocks = max(1, -(-own.count() // QUERIES))
    own = own.withColumn("qb", F.pmod(F.xxhash64(F.lit(6), "digest"), F.lit(blocks)).cast("int"))
    keys = ["bucket", "chunk", "qb"]

    def searched(some: DataFrame) -> DataFrame:
        shards = index.drop("center", "radius").join(some.select(*(F.col(c).alias(c) for c in keys)).distinct(), ["bucket", "chunk"])  # new names for Spark, as both sides come from some
        return some.groupBy(keys).cogroup(shards.groupBy(keys)).applyInArrow(_searched(k + 1), _FOUND)

    home = save(searched(own.withColumn("theta", F.lit(float("-inf")))))
    bound = _best(home, k + 1).groupBy("digest").agg(F.when(F.count("*") > k, F.min("score")).cast("double").alias("theta"))
    known = own.join(bound, "digest", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    wide = F.shiftright("bucket", 32).alias("width")
    told = index.select("bucket", "chunk", "center", "radius", wide)
    parts = max(1, -(-told.count() // SHARDS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.select("*", wide).withColumn("sb", each(parts))
    right = told.withColumn("sb", F.pmod(F.xxhash64("bucket", "chunk"), F.lit(parts)).cast("int")).withColumn("qb", each(blocks))
    still = save(left.groupBy("width", "qb", "sb").cogroup(right.groupBy("width", "qb", "sb")).applyInArrow(_open_shards, "digest binary, vec binary, theta double, bucket long, chunk int, qb int"))
    found = home.union(searched(still))
    best = _best(found, k + 1).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "own"))).alias("best"))
    mine = dealt_join(asked, save(best), "digest", "id")
    others = F.slice(F.filter("best", lambda b: ~(b["own"] & (b["id"] == F.col("id")))), 1, k)
    out = mine.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.minus")).alias("score"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON len(q.e) = len(c.e) AND (q.vec_id <> c.vec_id OR q.e <> c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
