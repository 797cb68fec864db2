"""Centroid clustering over a vector-approximation file, in integers.

1. Vectors become integers. Each component is compressed to a cell of 8 bits, with borders at quantiles of a
   bounded sample; each cell's least and greatest value hold for all rows. One table holds cells and full
   vectors as columns, in each file sorted by a page: how near a vector is to the border of which two of the
   first centroids.
2. A round reads cells only. The middles of a vector's cells name a candidate. Tables give for each centroid,
   component and cell the least of its part of the distance, less that to the candidate (whose own interval is
   0), so that the sums bound from below by how much the others are farther. Where all are, before and after
   the centroids moved, and it is the same candidate, nothing is to do.
3. Full vectors are read only from the pages of the other vectors, and compared only for those: what moves is
   taken from one centroid's sum and added to another's. Sums are exact, and so are the floors of their means.

Only k * dims sums a round and the numbers of the hit pages reach the driver. No round shuffles vectors."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._shared import forget, save, session, table

#: Cells of a component, vectors in the sample that sets their borders, levels of nearness to a border, and the greatest size of an integer component: 64 squares of twice as much are below 2**63.
CELLS, SAMPLE, LEVELS, MOST = 256, 20_000, 16, 1 << 27
#: Rows that are compared at once.
STRIP = 1024


def _read(dims: int, scale: int):
    """Integer vectors of the rows whose vector has `dims` finite components."""

    def run(batches):
        for batch in batches:
            column = batch.column("vec")
            lengths = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = np.flatnonzero(lengths == dims)
            x = flat[(np.cumsum(lengths) - lengths)[rows, None] + np.arange(dims)]
            good = np.isfinite(x).all(axis=1)
            x = np.floor(scale * x[good])
            if len(x) and np.abs(x).max() > MOST:
                raise ValueError(f"a component is beyond {MOST} / {scale}")
            raw = [v.tobytes() for v in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column("id_").take(pa.array(rows[good])), pa.array(raw, pa.binary())], ["id_", "vec"])

    return run


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _measured(dims: int):
    """(i, low, high) of each component over a partition."""

    def run(batches):
        low, high = np.full(dims, MOST + 1), np.full(dims, -MOST - 1)
        for batch in batches:
            x = _matrix(batch.column("vec"), dims)
            if len(x):
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.arange(dims, dtype=np.int32), low, high)], ["i", "low", "high"])

    return run


def cell_bounds(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each component the inner borders of its cells, at quantiles of the sample, and the least and greatest value of each cell."""
    borders = np.ceil(np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0)).astype(np.int64).T
    return borders, np.concatenate([low[:, None], borders], axis=1), np.concatenate([borders - 1, high[:, None]], axis=1)


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centroid, exact."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def _strips(x: np.ndarray):
    return (x[at : at + STRIP] for at in range(0, len(x), STRIP))


def _filed(borders: np.ndarray, centers: np.ndarray):
    """Adds to each vector its cells, packed, and its page by the first centroids."""

    def run(batches):
        dims, k = centers.shape[1], len(centers)
        for batch in batches:
            x = _matrix(batch.column("vec"), dims)
            cells = np.stack([np.searchsorted(borders[i], x[:, i], side="right") for i in range(dims)], axis=1).astype(np.uint8)
            d = np.concatenate([distances(s, centers) for s in _strips(x)]) if len(x) else np.zeros((0, k))
            order = np.argsort(d, axis=1, kind="stable")
            first, second = order[:, 0], order[:, min(1, k - 1)]
            near, far = (np.take_along_axis(d, c[:, None], 1)[:, 0].astype(float) for c in (first, second))
            level = np.minimum(LEVELS - 1, LEVELS * 4 * (far - near) / np.maximum(far + near, 1)).astype(np.int64)
            page = level * k * k + np.minimum(first, second) * k + np.maximum(first, second)
            yield pa.RecordBatch.from_arrays([batch.column("id_"), batch.column("vec"), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(page, pa.int32())], ["id_", "vec", "cells", "page"])

    return run


class Intervals:
    """Of a candidate, and for each centroid, component and cell: the least of the part of the distance, less that to the candidate."""

    def __init__(self, centers: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.centers, self.least, self.most, self.made = centers, least, most, {}

    def tables(self, candidate: int) -> np.ndarray:
        if candidate not in self.made:
            own = self.centers[candidate]
            slope, rest = 2 * (own - self.centers)[:, :, None], (self.centers**2 - own**2)[:, :, None]
            self.made[candidate] = np.minimum(slope * self.least + rest, slope * self.most + rest)
        return self.made[candidate]

    def nearest(self, cells: np.ndarray) -> np.ndarray:
        """The centroid that must be the nearest, or -1 where another may be as near."""
        i = np.arange(cells.shape[1])
        candidate = distances((self.least[i, cells] + self.most[i, cells]) // 2, self.centers).argmin(axis=1)
        out = np.full(len(cells), -1)
        for c in np.unique(candidate).tolist():
            rows = np.flatnonzero(candidate == c)
            for other, low in enumerate(self.tables(c)):
                if other != c:
                    rows = rows[low[i, cells[rows]].sum(axis=1) > 0]
            out[rows] = c
        return out


def _cells(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, dims)


def _open(old: Intervals, new: Intervals, cells: np.ndarray) -> np.ndarray:
    """Rows whose cells don't tell that the same centroid is the nearest before and after."""
    out = np.zeros(len(cells), bool)
    for at in range(0, len(cells), STRIP):
        a, b = old.nearest(cells[at : at + STRIP]), new.nearest(cells[at : at + STRIP])
        out[at : at + STRIP] = (a < 0) | (a != b)
    return out


def _hit_pages(old: Intervals, new: Intervals, dims: int):
    def run(batches):
        found: dict[int, int] = {}
        for batch in batches:
            page = batch.column("page").to_numpy()[_open(old, new, _cells(batch.column("cells"), dims))]
            for p, n in zip(*(x.tolist() for x in np.unique(page, return_counts=True))):
                found[p] = found.get(p, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["page", "n"])

    return run


def _emit(n: np.ndarray, sums: np.ndarray):
    k, dims = sums.shape
    c, i = (x.ravel().astype(np.int32) for x in np.indices((k, dims)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, i, np.repeat(n, dims), sums.ravel())], ["c", "i", "n", "total"])


def _sums(centers: np.ndarray):
    """A partition's vectors by their nearest centroid: how many, and sums of components."""

    def run(batches):
        n, sums = np.zeros(len(centers), np.int64), np.zeros(centers.shape, np.int64)
        for batch in batches:
            for x in _strips(_matrix(batch.column("vec"), centers.shape[1])):
                own = distances(x, centers).argmin(axis=1)
                n += np.bincount(own, minlength=len(centers))
                np.add.at(sums, own, x)
        yield from _emit(n, sums)

    return run


def _moves(before: np.ndarray, after: np.ndarray, old: Intervals, new: Intervals):
    """What the sums of _sums change by, from the vectors that their cells leave open."""

    def run(batches):
        n, sums = np.zeros(len(after), np.int64), np.zeros(after.shape, np.int64)
        for batch in batches:
            rows = np.flatnonzero(_open(old, new, _cells(batch.column("cells"), after.shape[1])))
            for x in _strips(_matrix(batch.column("vec").take(pa.array(rows)), after.shape[1])):
                a, b = (distances(x, c).argmin(axis=1) for c in (before, after))
                x, a, b = x[a != b], a[a != b], b[a != b]
                n += np.bincount(b, minlength=len(after)) - np.bincount(a, minlength=len(after))
                np.add.at(sums, b, x)
                np.subtract.at(sums, a, x)
        yield from _emit(n, sums)

    return run


def _assigned(centers: np.ndarray):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                part = batch.slice(at, STRIP)
                d = distances(_matrix(part.column("vec"), centers.shape[1]), centers)
                yield pa.RecordBatch.from_arrays([part.column("id_"), pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1))], ["id_", "cluster", "distance"])

    return run


_TOTALS = "c int, i int, n long, total long"


def _gathered(parts: DataFrame, n: list[int], sums: list[list[int]]) -> None:
    """Add partitions' sums to the driver's, which are whole numbers of any size."""
    for r in parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        sums[r["c"]][r["i"]] += r["total"]
        if r["i"] == 0:
            n[r["c"]] += r["n"]


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:", id_column: str = "vec_id", vector_column: str = "embedding", fetched: list | None = None) -> DataFrame:
    """One row (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept row of vectors.

    Kept are vectors with exactly `dims` components, none null or non-finite; component x becomes
    floor(scale * x), and one beyond 2**27 is an error. The first centroids are the k kept vectors of the least
    sha256 of seed and id, of equal ids the one of the least bytes; with fewer vectors there are fewer. In each
    round vectors go to the nearest centroid (ties: the smaller number), and each centroid that has some
    becomes the floor of their mean. Rows that share an id or a vector count each; rows without an id are kept
    and clustered, but are no first centroid, and a table of only such rows has no result, nor has an empty
    one. Other columns are not read. `fetched`, if given, gets for each round after the first
    (vectors left open by their cells, pages read, vectors). The tables hold 256 * dims * k numbers for each
    candidate: meant for up to some hundred centroids."""
    session(vectors)
    spark, kind = vectors.sparkSession, vectors.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    src = vectors.select(F.col(id_column).alias("id_"), F.col(vector_column).cast("array<double>").alias("vec"))
    read = save(src.mapInArrow(_read(dims, scale), f"id_ {kind}, vec binary"))
    order = F.sha2(F.concat(F.lit(seed), F.col("id_").cast("string")), 256)
    first = read.where("id_ IS NOT NULL").select("vec", order.alias("at")).orderBy("at", "vec").limit(k).collect()
    if not first:
        return spark.createDataFrame([], schema)
    centers = np.array([np.frombuffer(r["vec"], "<i4") for r in first], np.int64)
    k = len(centers)
    measured = read.select("vec").mapInArrow(_measured(dims), "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    total = read.count()
    some = read.select("vec").where(F.pmod(F.xxhash64("id_", "vec"), F.lit(max(1, total // SAMPLE))) == 0).limit(SAMPLE).collect()
    sample = np.array([np.frombuffer(r["vec"], "<i4") for r in some] or centers, np.int64)
    borders, least, most = cell_bounds(sample, *(np.array([r[c] for r in measured]) for c in ("low", "high")))
    filed = save(read.mapInArrow(_filed(borders, centers), f"id_ {kind}, vec binary, cells binary, page int").sortWithinPartitions("page"))
    forget(read)
    n, sums = [0] * k, [[0] * dims for _ in range(k)]
    _gathered(filed.select("vec").mapInArrow(_sums(centers), _TOTALS), n, sums)
    for nth in range(rounds):
        moved = np.array([[s // m for s in row] if m else c.tolist() for c, m, row in zip(centers, n, sums)], np.int64)
        if (moved == centers).all():
            break  # every further round would find the same
        before, centers = centers, moved
        if nth + 1 == rounds:
            break
        old, new = (Intervals(c, least, most) for c in (before, centers))
        hit = filed.select("page", "cells").mapInArrow(_hit_pages(old, new, dims), "page int, n long").groupBy("page").agg(F.sum("n").alias("n")).collect()
        if fetched is not None:
            fetched.append((sum(r["n"] for r in hit), len(hit), total))
        if hit:
            pages = filed.where(F.col("page").isin([r["page"] for r in hit])).select("cells", "vec")
            _gathered(pages.mapInArrow(_moves(before, centers, old, new), _TOTALS), n, sums)
    out = save(filed.select("id_", "vec").mapInArrow(_assigned(centers), f"id_ {kind}, cluster int, distance long"))
    own = {r["cluster"]: r["inertia"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(c, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()) for c in sorted(own)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return out.join(F.broadcast(facts), "cluster").select(F.col("id_").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out, as a list of common table expressions."""
    near = "SELECT v.vec_id, v.e, arg_min(c.c, (list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c.e) + list_dot_product(c.e, c.e), c.c)) AS c FROM v, c{r} c GROUP BY 1, 2"
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(r=r)})",
            f"s{r} AS (SELECT c, i, floor(sum(x) / count(*)) AS m FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY 1, 2)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(g.e, c{r}.e) AS e FROM c{r} LEFT JOIN (SELECT c, list(m ORDER BY i) AS e FROM s{r} GROUP BY 1) g USING (c))",
        ]
    parts.append(f"a{rounds} AS MATERIALIZED ({near.format(r=rounds)})")
    parts.append(f"""d AS (SELECT vec_id, a.c, CAST(list_dot_product(a.e, a.e) - 2 * list_dot_product(a.e, c.e) + list_dot_product(c.e, c.e) AS BIGINT) AS distance,
sha256(array_to_string(list_transform(c.e, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (c))""")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM d"""


ORACLE = _sql()
