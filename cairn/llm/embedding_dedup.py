"""Near-duplicate vectors: random-hyperplane sign codes in several tables, exact cosine verification, components.

1. Equal vectors are one class with a weight.
2. A class gives a bucket in each table and a sketch of 128 further signs. Only (bucket, id, sketch) is
   shuffled. Buckets are cut into bounded blocks, and of each block the classes stay that have a partner
   whose sketch is near enough; no pair leaves its block.
3. Only these meet their vectors again, and are compared by exact cosines in the same blocks. A pair counts
   in the first table in which it shares a bucket, so that link counts add up. A block emits one row per
   linked class: the weight linked to and its root in the block.
4. Components of those rows are the result.

Signs are those of sums of integers (vectors scaled by a power of two and rounded, hyperplanes rounded) that
are exact in double precision, so that every worker finds the same buckets."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._shared import components, dealt_join, forget, grouped, save, session, table

#: Classes in a chunk of a block; chance to miss a pair that is just at the threshold, a tenth of it by the sketch; classes meant for a bucket.
BLOCK, MISS, BUCKET = 2048, 1e-4, 1024
SKETCH = 128
#: Rows of a product of matrices that are held at once.
STRIP = 256
#: Buckets too large for one block that are sent to every task (16 bytes each); more of them are joined by a shuffle.
HOT = 100_000


def plan(n: int, threshold: float) -> tuple[int, int, int]:
    """Bits of a code so that buckets hold BUCKET classes or so, tables so that MISS holds, and the signs in which sketches of a link may differ."""
    bits = min(32, max(4, round(math.log2(max(n, 1) / BUCKET))))
    differ = math.acos(threshold) / math.pi
    agree = (1 - differ) ** bits
    tables = math.ceil(math.log(0.9 * MISS) / math.log(1 - agree)) if agree < 1 else 1
    tail, cut = 1.0, -1
    while tail > 0.1 * MISS:
        cut += 1
        tail -= math.comb(SKETCH, cut) * differ**cut * (1 - differ) ** (SKETCH - cut)
    return bits, tables, cut


def _read(kind: str):
    def run(batches):
        for batch in batches:
            known = batch.column("id").is_valid().to_pylist()
            column = batch.column("vec")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))
            bad, ink = np.concatenate([[0], np.cumsum(~np.isfinite(flat))]), np.concatenate([[0], np.cumsum(flat != 0)])
            vecs, digests = [None] * batch.num_rows, [None] * batch.num_rows
            at = 0
            for i, to in enumerate(ends.tolist()):
                if known[i] and bad[to] == bad[at] and ink[to] > ink[at]:
                    vecs[i] = flat[at:to].tobytes()
                    digests[i] = hashlib.blake2b(vecs[i], digest_size=16).digest()
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), pa.array(vecs, pa.binary())], ["id", "digest", "vec"])

    return run


def matrices(raw: list[bytes], kind: str):
    """(rows, matrix) for each length of the vectors, scaled by a power of two so that the largest component is below 1."""
    by: dict[int, list[int]] = {}
    for i, x in enumerate(raw):
        by.setdefault(len(x), []).append(i)
    for rows in by.values():
        x = np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), -1).astype(np.float64)
        yield np.array(rows), np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


class Planes:
    """Codes and sketches of scaled vectors, by exact integer sums."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed, self.made = bits, tables, seed, {}

    def signs(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        if d not in self.made:
            self.made[d] = np.rint(np.random.default_rng([self.seed, d]).standard_normal((d, self.bits * self.tables + SKETCH)) * 1024)
        return np.rint(x * (1 << 20)) @ self.made[d] > 0

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row its code in every table, and its sketch as two numbers."""
        s = self.signs(x)
        own = s[:, : self.bits * self.tables].reshape(len(x), self.tables, self.bits)
        return (own * (1 << np.arange(self.bits, dtype=np.int64))).sum(axis=2), np.packbits(s[:, self.bits * self.tables :], axis=1).view(np.int64)


def _coded(planes: Planes, kind: str, sketches: bool):
    def run(batches):
        names = ["bucket", "id", "s0", "s1"] if sketches else ["bucket"]
        for batch in batches:
            for rows, x in matrices(batch.column("vec").to_pylist(), kind):
                codes, sketch = planes.codes(x)
                place = (min(x.shape[1], (1 << 20) - 1) << 42) + (np.arange(planes.tables, dtype=np.int64) << 32)
                columns = [(codes + place).ravel()]
                if sketches:
                    ids = batch.column("id").to_numpy()[rows]
                    columns += [np.repeat(c, planes.tables) for c in (ids, sketch[:, 0], sketch[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def _near(cut: int):
    """The rows of each block that have a partner in it whose sketch differs in at most `cut` signs."""

    def run(batches):
        for (_, i, j), t in grouped(batches, ["bucket", "block_i", "block_j"]):
            s0, s1 = (t.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1"))
            chunk = t.column("chunk").to_numpy()
            hit = np.zeros(len(s0), bool)
            for at in range(0, len(s0), STRIP):
                to = min(at + STRIP, len(s0))
                near = np.bitwise_count(s0[at:to, None] ^ s0[None, at:]) + np.bitwise_count(s1[at:to, None] ^ s1[None, at:]) <= cut
                if i != j:
                    near &= chunk[at:to, None] != chunk[None, at:]
                near &= np.arange(at, to)[:, None] < np.arange(at, len(s0))[None, :]
                hit[at:to] |= near.any(axis=1)
                hit[at:] |= near.any(axis=0)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[hit]) for c in _PLACE], _PLACE)

    return run


_PLACE = ["bucket", "block_i", "block_j", "chunk", "id"]


def _merge(label: np.ndarray, row: int, others: np.ndarray) -> None:
    """Give the parts of row and others the least label among them."""
    own = label[others]
    if (own != label[row]).any():
        parts = np.unique(np.append(own, label[row]))
        label[np.isin(label, parts)] = parts[0]


def _compared(planes: Planes, threshold: float, kind: str):
    def run(batches):
        for (bucket, i, j), t in grouped(batches, ["bucket", "block_i", "block_j"]):
            order = np.argsort(t.column("id").to_numpy(), kind="stable")
            ids, weight, chunk = (t.column(c).to_numpy()[order] for c in ("id", "weight", "chunk"))
            nth = int(bucket) >> 32 & 1023
            for rows, x in matrices(t.column("vec").take(pa.array(order)).to_pylist(), kind):
                codes = planes.codes(x)[0][:, :nth]
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                own, w, c = ids[rows], weight[rows], chunk[rows]
                links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
                for at in range(0, len(rows), STRIP):
                    a, b = np.nonzero(x[at : at + STRIP] @ x[at:].T >= threshold - 1e-12)
                    a, b = a[a < b] + at, b[a < b] + at
                    for k in range(0, len(a), 1 << 16):
                        p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                        good = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                        if i != j:
                            good &= c[p] != c[q]
                        for s in range(nth):
                            good &= codes[p, s] != codes[q, s]
                        p, q = p[good], q[good]
                        np.add.at(links, p, w[q])
                        np.add.at(links, q, w[p])
                        starts = np.flatnonzero(np.diff(p, prepend=-1))
                        for row, others in zip(p[starts].tolist(), np.split(q, starts[1:])):
                            _merge(label, row, others)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(links[some]), pa.array(own[label[some]])], ["id", "n", "root"])

    return run


def _dealt(coded: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows of coded with block_i <= block_j and chunk: a bucket of more than BLOCK rows is cut into chunks, and each of its rows goes to the blocks that pair its chunk with another."""
    hot = save(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK))
    n = hot.count()
    if n > HOT:
        sized = dealt_join(coded, hot, "bucket", "id", "left")
    elif n:
        sized = coded.join(F.broadcast(hot), "bucket", "left")
    else:
        sized = coded.withColumn("members", F.lit(None).cast("long"))
    chunks = F.coalesce(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("int")
    cut = sized.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), "id"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.withColumn("block_i", F.least("chunk", "other")).withColumn("block_j", F.greatest("chunk", "other")).drop("other", "chunks", "members")
    return cut.repartition("bucket", "block_i", "block_j").sortWithinPartitions("bucket", "block_i", "block_j")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, seed: int = 7, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of vectors.

    Two vectors link when their cosine in double precision is at least threshold and they share a code in
    some table: a pair just at the threshold is missed with a chance of MISS, closer ones far less often.
    n_links counts other rows linked directly, component_id is the smallest id reachable, kept says that
    the row has that id. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing, nor do vectors of different lengths. Ids must be integers. A row without an id links with
    nothing, has no component_id and is kept; rows that share an id are rows of their own with one
    component each. Other columns are not read."""
    session(vectors)
    id_kind, element = vectors.schema[id_column].dataType, vectors.schema[vector_column].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    src = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>" if kind == "<f4" else "array<double>").alias("vec"))
    read = save(src.mapInArrow(_read(kind), "id long, digest binary, vec binary"))
    usable = read.where("digest IS NOT NULL")
    classes = save(usable.groupBy("digest").agg(F.min(F.struct("id", "vec")).alias("first"), F.count("*").alias("weight")).select("first.*", "weight", "digest"))
    bits, tables, cut = plan(classes.count(), threshold)
    planes = Planes(bits, tables, seed)
    coded = classes.select("id", "vec").mapInArrow(_coded(planes, kind, True), "bucket long, id long, s0 long, s1 long")
    buckets = classes.select("vec").mapInArrow(_coded(planes, kind, False), "bucket long")
    near = save(_dealt(coded, buckets).mapInArrow(_near(cut), "bucket long, block_i int, block_j int, chunk int, id long"))
    met = near.join(classes.drop("digest"), "id").repartition("bucket", "block_i", "block_j").sortWithinPartitions("bucket", "block_i", "block_j")
    found = save(met.mapInArrow(_compared(planes, threshold, kind), "id long, n long, root long"))
    forget(near)
    reach = components(found, "id", "root").withColumnRenamed("node", "id")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    firsts = (
        classes.select("digest", "id", "weight").join(links, "id", "left").join(reach, "id", "left")
        .select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = dealt_join(read.select("id", "digest"), firsts, "digest", "id", "left")
    return out.select(
        F.col("id").cast(id_kind).alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id")
    ).withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, root FROM reach JOIN l ON reach.id = l.a), c AS (SELECT id, min(root) AS root FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
