"""Every query over the given tables, with its SQL. Doubles are rounded on both sides."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import stats
from cairn.operators import gates, graph, hierarchy, media, models, passes, relational, sampling, vectors
from cairn.operators.tables import dealt_join, shared_dir
from cairn.plans import protocol
from cairn.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


def _rounded(c: str, n: int):
    """Components rounded as SQL does it: one below zero that rounds to zero stays -0.0."""
    return F.transform(c, lambda x: F.signum(x) * F.round(F.abs(x), n))


def _cross(table: str, a: str, b: str) -> str:
    return f"ct AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"


def _chi(table: str, a: str, b: str) -> str:
    return f"""WITH {_cross(table, a, b)},
m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c FROM ct),
x AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc,
      sum(n) * (sum(CAST(n AS DOUBLE) * n / (CAST(r AS DOUBLE) * c)) - 1) AS chi2 FROM m)"""


@query(_chi("documents", "source", "lang") + """
SELECT n, nr AS "rows", nc AS cols, round(chi2, 6) AS chi2, (nr - 1) * (nc - 1) AS dof, round(sqrt(chi2 / (n * (least(nr, nc) - 1))), 6) AS v,
CASE WHEN sqrt(chi2 / (n * (least(nr, nc) - 1))) >= 0.35 THEN 'STOP' WHEN sqrt(chi2 / (n * (least(nr, nc) - 1))) >= 0.2 THEN 'PROCEED_WITH_CAVEAT' ELSE 'PROCEED' END AS verdict FROM x""")
def gate0_confounding(spark, d):
    return gates.confounding(_t(spark, d, "documents"), "source", "lang").withColumn("chi2", _r("chi2")).withColumn("v", _r("v"))


@query(_chi("orders", "o_orderstatus", "o_orderpriority") + ' SELECT n, nr AS "rows", nc AS cols, round(chi2, 6) AS chi2, (nr - 1) * (nc - 1) AS dof FROM x')
def chi2_by_group(spark, d):
    return stats.chi_square(stats.crosstab(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")).withColumn("chi2", _r("chi2"))


@query("SELECT source AS a, lang AS b, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2")
def crosstab_counts(spark, d):
    return stats.crosstab(_t(spark, d, "documents"), "source", "lang")


@query("WITH " + _cross("documents", "source", "lang") + """, grid AS (SELECT a, b FROM (SELECT DISTINCT a FROM ct), (SELECT DISTINCT b FROM ct))
SELECT a, b, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY a) AS DOUBLE), 6) AS fraction FROM grid LEFT JOIN ct USING (a, b)""")
def crosstab_row_fractions(spark, d):
    return relational.row_fractions(stats.crosstab(_t(spark, d, "documents"), "source", "lang")).withColumn("fraction", _r("fraction"))


@query("WITH " + _cross("documents", "source", "lang") + " SELECT a AS source, CAST(sum(n) AS BIGINT) AS n, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS purity FROM ct GROUP BY 1")
def group_purity(spark, d):
    return stats.purity(_t(spark, d, "documents"), "source", "lang").withColumn("purity", _r("purity"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND least(n_chars, 5000) >= 224 AND doc_id IN (SELECT doc_id FROM labels)")
def cohort_filter(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    return relational.cohort(docs, _t(spark, d, "labels"), "doc_id", (F.col("lang") == "en") & (F.least("n_chars", F.lit(5000)) >= 224)).select("doc_id", "source", "n_chars")


@query("SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (lang = 'en' AND n_chars >= 224) AS large, count(*) FILTER (lang = 'en' AND n_chars >= 224 AND source <> 'src0') AS kept FROM documents")
def filter_funnel(spark, d):
    return relational.funnel(_t(spark, d, "documents"), [("english", F.col("lang") == "en"), ("large", F.col("n_chars") >= 224), ("kept", F.col("source") != "src0")])


@query("SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, d):
    have = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return relational.missing_keys(_t(spark, d, "documents").select("doc_id"), have, "doc_id").agg(F.count("*").alias("missing"))


@query("WITH top AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 7) SELECT CASE WHEN source IN (SELECT source FROM top) THEN source ELSE 'Other' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def top_k_other(spark, d):
    return relational.top_k_or_other(_t(spark, d, "documents"), "source", 7).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) < 60")
def small_batches(spark, d):
    return _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n < 60")


@query("WITH s AS (SELECT CAST(c_nationkey AS VARCHAR) AS k, count(*) AS n FROM customer GROUP BY 1) SELECT CASE WHEN n < 60 THEN 'Other' ELSE k END AS batch, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1")
def merge_small_batches(spark, d):
    own = _t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("k"))
    return relational.merge_small(own, "k", 60).groupBy("batch").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'quality' AS "column", round(avg(CASE WHEN quality IS NULL THEN 0 ELSE 1 END), 6) AS rate, count(*) FILTER (quality IS NULL) AS missing FROM j
UNION ALL SELECT 'toxic', round(avg(CASE WHEN toxic IS NULL THEN 0 ELSE 1 END), 6), count(*) FILTER (toxic IS NULL) FROM j""")
def fill_rate(spark, d):
    own = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    return relational.fill_rates(own, ["quality", "toxic"]).withColumn("rate", _r("rate"))


@query("SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM conversations GROUP BY conv_id) GROUP BY 1")
def images_per_lesion(spark, d):
    return relational.group_sizes(_t(spark, d, "conversations"), "conv_id")


@query("""WITH r AS (SELECT min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi FROM events)
SELECT CAST(least(floor((CAST(value AS DOUBLE) - lo) / ((hi - lo) / 60)), 59) AS INTEGER) AS bin, count(*) AS n FROM events, r WHERE value IS NOT NULL GROUP BY 1""")
def value_histogram(spark, d):
    return relational.histogram(_t(spark, d, "events"), "value", 60)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both FROM a FULL JOIN b ON a.k = b.k""")
def overlap_venn(spark, d):
    return relational.overlap(_t(spark, d, "orders").select("o_custkey"), _t(spark, d, "customer").select("c_custkey"))


def _kruskal(f: str) -> str:
    return f"""WITH f AS ({f}), k AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY x) AS t FROM f WHERE g IS NOT NULL AND x IS NOT NULL),
s AS (SELECT g, sum(rk) AS r, count(*) AS m FROM k GROUP BY 1), tie AS (SELECT sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM k), a AS (SELECT count(*) AS groups, CAST(sum(m) AS BIGINT) AS n, sum(r * r / m) AS s, count(*) FILTER (m >= 10) AS able FROM s),
h AS (SELECT groups, n, able, CASE WHEN able >= 2 THEN (12.0 / (CAST(n AS DOUBLE) * (n + 1)) * s - 3.0 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) END AS h FROM a, tie)
SELECT groups, n, round(h, 4) AS h, CASE WHEN able >= 2 THEN groups - 1 END AS dof, able < 2 AS underpowered"""


def _tail(x: str, k: str) -> str:
    """The chi-square tail for an even number of degrees of freedom."""
    return f"round(list_sum(list_transform(range(0, CAST({k} / 2 AS BIGINT)), lambda i: exp(-{x} / 2 + i * ln({x} / 2) - lgamma(i + 1)))), 6)"


@query(_kruskal("SELECT c_mktsegment AS g, c_acctbal AS x FROM customer") + f", {_tail('h', '(groups - 1)')} AS p FROM h")
def kruskal_by_group(spark, d):
    return stats.kruskal(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal").withColumn("h", _r("h", 4)).withColumn("p", _r("p"))


_SMALL = "CASE WHEN s_suppkey <= 4 THEN 'few' WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END"


@query(_kruskal(f"SELECT {_SMALL} AS g, s_acctbal AS x FROM supplier") + f", {_tail('h', '(groups - 1)')} AS p FROM h")
def kruskal_small_group(spark, d):
    """A group of four values counts in the statistic; it only doesn't make the test powerful."""
    own = _t(spark, d, "supplier").select(F.expr(_SMALL).alias("g"), F.col("s_acctbal").alias("x"))
    return stats.kruskal(own, "g", "x").withColumn("h", _r("h", 4)).withColumn("p", _r("p"))


@query(_chi("orders", "o_orderstatus", "o_orderpriority") + f", y AS (SELECT *, (nr - 1) * (nc - 1) AS dof FROM x) SELECT nr AS groups, n, round(chi2, 6) AS chi2, dof, false AS underpowered, {_tail('chi2', 'dof')} AS p FROM y")
def chi2_power_guard(spark, d):
    return stats.chi_square_test(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("chi2", _r("chi2")).withColumn("p", _r("p"))


@query("SELECT count(DISTINCT lang) AS groups, count(*) AS n, -1.0::DOUBLE AS chi2, true AS underpowered FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND toxic IS NOT NULL")
def chi2_underpowered(spark, d):
    own = _t(spark, d, "documents").where("lang = 'en'").select("doc_id", "lang").join(_t(spark, d, "labels"), "doc_id")
    return stats.chi_square_test(own, "lang", "toxic").select("groups", "n", F.coalesce("chi2", F.lit(-1.0)).alias("chi2"), "underpowered")


_ARI = """WITH ct AS (SELECT label AS a, list_position(embedding, list_max(embedding)) % 10 AS b, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1, 2),
s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2.0) AS s FROM ct), x AS (SELECT sum(m * (m - 1) / 2.0) AS sa FROM (SELECT sum(n) AS m FROM ct GROUP BY a)), y AS (SELECT sum(m * (m - 1) / 2.0) AS sb FROM (SELECT sum(n) AS m FROM ct GROUP BY b))
SELECT CAST(n AS BIGINT) AS n, round((s - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 6) AS ari FROM s, x, y"""


@query(_ARI)
def adjusted_rand(spark, d):
    e = _t(spark, d, "embeddings").withColumn("top", F.array_position("embedding", F.array_max("embedding")) % 10)
    return stats.adjusted_rand(e, "label", "top").withColumn("ari", _r("ari"))


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform({_V}, lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", _r(vectors.norm(vectors.double("embedding"))).alias("norm"))


_CENTERS = f"c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2)"


@query(f"WITH {_CENTERS} SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS m FROM c")
def cluster_centroids(spark, d):
    return vectors.group_mean(_t(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "m")).withColumn("m", _r("m"))


_COSINE = f"""WITH {_CENTERS}, v AS (SELECT vec_id, label, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
j AS (SELECT vec_id, v.label AS label, sum(x * m) / ((sqrt(sum(x * x)) + 1e-8) * (sqrt(sum(m * m)) + 1e-8)) AS cosine FROM v JOIN c ON v.label = c.label AND v.i = c.i GROUP BY 1, 2)"""


def _cosines(spark, d):
    e = _t(spark, d, "embeddings")
    c = vectors.group_mean(e, "label", "embedding").select("label", "centroid")
    return dealt_join(e, c, "label", "vec_id").select("vec_id", "label", vectors.dot(vectors.unit(vectors.double("embedding")), vectors.unit(F.col("centroid"))).alias("cosine"))


@query(_COSINE + " SELECT vec_id, label, round(cosine, 6) AS cosine FROM j")
def centroid_cosine(spark, d):
    return _cosines(spark, d).withColumn("cosine", _r("cosine"))


@query(_COSINE + " SELECT label, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM j) WHERE rank <= 3")
def representatives(spark, d):
    return gates.nearest_to_centroid(_cosines(spark, d).withColumn("cosine", _r("cosine", 9)), "label", "cosine", "vec_id", 3).select("label", "vec_id", "rank")


_PAIRS = f"""p AS (SELECT vec_id, label, {_V} AS v FROM embeddings), q AS (SELECT a.vec_id AS id, a.label AS la, b.vec_id AS nb, b.label AS lb,
round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id"""


_VECTORS = f"p AS (SELECT vec_id, {_V} AS v FROM embeddings)"


def _near(spark, d, k):
    p = vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return p, vectors.nearest(p, p.where("id % 20 = 0"), k)


@query(f"WITH {_PAIRS} WHERE a.vec_id % 20 = 0) SELECT id, nb AS neighbor, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS rank FROM q) WHERE rank <= 10")
def knn_topk(spark, d):
    return _near(spark, d, 10)[1].select("id", "neighbor", "rank", _r("distance").alias("distance"))


@query(f"""WITH {_PAIRS} WHERE a.vec_id % 20 = 0), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS rank FROM q) WHERE rank <= 30),
s AS (SELECT avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END) AS same FROM k), e AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS expected FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY label))
SELECT round(same, 6) AS same, round(expected, 6) AS expected, round((1 - same) / (1 - expected), 6) AS mixing FROM s, e""")
def mixing_score(spark, d):
    p, near = _near(spark, d, 30)
    return vectors.mixing(near.select("id", "neighbor"), p.select("id", "label")).select(*(_r(c).alias(c) for c in ("same", "expected", "mixing")))


@query(f"""WITH {_PAIRS}), m AS (SELECT id, la, lb, avg(dist) AS m FROM q GROUP BY 1, 2, 3), s AS (SELECT id, la AS label, max(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b FROM m GROUP BY 1, 2)
SELECT id, CAST(label AS VARCHAR) AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS s FROM s""")
def silhouette_euclid(spark, d):
    return vectors.silhouette(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding", "label")).withColumn("s", _r("s", 5))


@query(f"""WITH {_CENTERS}, v AS (SELECT vec_id, label, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT label, avg(dd) AS s FROM (SELECT vec_id, v.label AS label, sqrt(sum((x - m) * (x - m))) AS dd FROM v JOIN c ON v.label = c.label AND v.i = c.i GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT a.label AS l1, b.label AS l2, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2)
SELECT round(avg(worst), 6) AS db FROM (SELECT l1, max((x.s + y.s) / dist) AS worst FROM g JOIN s x ON x.label = l1 JOIN s y ON y.label = l2 GROUP BY 1)""")
def davies_bouldin(spark, d):
    return vectors.davies_bouldin(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding", "label")).withColumn("db", _r("db"))


_CAPS = """p AS (SELECT source, max(n) / CAST(sum(n) AS DOUBLE) AS purity FROM (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT doc_id, d.source AS source, d.lang AS lang, purity, row_number() OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR))), doc_id) AS nth FROM documents d JOIN p ON d.source = p.source)"""


@query(f"WITH {_CAPS} SELECT doc_id, source FROM r WHERE nth <= CASE WHEN purity >= 0.95 THEN 10 WHEN purity >= 0.7 THEN 20 ELSE nth END")
def balanced_subsample(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    own = dealt_join(docs, stats.purity(docs, "source", "lang").drop("n"), "source", "doc_id")
    return sampling.capped(own, "source", "doc_id", sampling.tier_cap(F.col("purity"), 10, 20)).select("doc_id", "source")


@query("""WITH g AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), k AS (SELECT conv_id, row_number() OVER (ORDER BY md5(concat_ws('|', '1000', CAST(conv_id AS VARCHAR))), conv_id) AS nth FROM g)
SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM k WHERE nth <= round_even(0.8 * (SELECT count(*) FROM g), 0))""")
def bootstrap_group_mask(spark, d):
    return sampling.groups(_t(spark, d, "conversations"), "conv_id", 0.8, 1000).select("conv_id", "turn")


_SWEEP = """SELECT l_linenumber AS ord, count(DISTINCT l_quantity) % 20 AS n_clusters, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS noise_frac, round(stddev_pop(CAST(l_discount AS DOUBLE)), 9) AS silhouette FROM lineitem GROUP BY 1"""


@query(f"WITH s AS ({_SWEEP}) SELECT ord, n_clusters, round(noise_frac, 6) AS noise_frac, round(silhouette, 6) AS silhouette, NOT (n_clusters BETWEEN 2 AND 15 AND noise_frac < 0.3) AS fallback_used FROM s WHERE silhouette IS NOT NULL AND n_clusters >= 2 ORDER BY 5, s.silhouette DESC, ord LIMIT 1")
def select_best_config(spark, d):
    sweep = _t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("ord")).agg((F.countDistinct("l_quantity") % 20).alias("n_clusters"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("noise_frac"), F.round(F.stddev_pop(F.col("l_discount").cast("double")), 9).alias("silhouette"))
    return gates.select_config(sweep, "ord").select("ord", "n_clusters", _r("noise_frac").alias("noise_frac"), _r("silhouette").alias("silhouette"), "fallback_used")


@query("SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, avg(value) >= 0.6 AS is_stable FROM events")
def ari_summary(spark, d):
    s = gates.summary(_t(spark, d, "events"), "value")
    return s.select(*(_r(c).alias(c) for c in ("mean", "std", "min", "max")), "is_stable")


@query("SELECT coalesce(CAST(NULLIF(user_id % 7, 0) AS VARCHAR), 'single-' || CAST(event_id AS VARCHAR)) AS lesion, count(*) AS n FROM events GROUP BY 1")
def lesion_coalesce(spark, d):
    key = F.coalesce(F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 7).cast("string"), F.concat(F.lit("single-"), F.col("event_id").cast("string")))
    return _t(spark, d, "events").groupBy(key.alias("lesion")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'es' AS INTEGER) AS lang_es, CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM documents")
def one_hot_drop_first(spark, d):
    return relational.one_hot(_t(spark, d, "documents").select("doc_id", "lang"), "lang", "lang_").drop("lang")


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 5) AS z FROM customer")
def standardize(spark, d):
    return vectors.standardize(_t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), "c_acctbal").select("c_custkey", _r("z", 5).alias("z"))


@query("SELECT lang, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS fraction FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def value_counts_normalised(spark, d):
    return relational.value_counts(_t(spark, d, "documents"), "lang").withColumn("fraction", _r("fraction"))


@query("SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def factorize(spark, d):
    return relational.codes(_t(spark, d, "documents"), "source")


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS u0, count(*) FILTER (user_id % 3 = 1) AS u1 FROM events GROUP BY 1")
def pivot_grid(spark, d):
    n = _t(spark, d, "events").groupBy("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("u")).agg(F.count("*").alias("n"))
    return relational.pivot_grid(n, "event_type", "u", ["u0", "u1"], "n")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_labels(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT toxic, count(*) AS n, round(avg(n_chars), 6) AS chars FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY 1")
def inner_join_labels(spark, d):
    return _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id").where("toxic IS NOT NULL").groupBy("toxic").agg(F.count("*").alias("n"), _r(F.avg("n_chars")).alias("chars"))


@query("""WITH m AS (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) AS mid FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, coalesce(CAST(quality AS DOUBLE), mid) AS quality FROM documents LEFT JOIN labels USING (doc_id), m""")
def median_fill(spark, d):
    own = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return relational.median_fill(own, "quality")


_EXCLUDE = "WITH " + _cross("documents", "source", "lang") + """, tot AS (SELECT a, sum(n) AS r, max(n) / CAST(sum(n) AS DOUBLE) AS purity FROM ct GROUP BY 1),
ord AS (SELECT a, row_number() OVER (ORDER BY r DESC, a) AS dies FROM tot WHERE purity > 0.58 AND r >= 20), steps AS (SELECT unnest(range(0, (SELECT count(*) + 1 FROM ord))) AS step),
alive AS (SELECT step, ct.a AS a, b, n, sum(n) OVER (PARTITION BY step, ct.a) AS r, sum(n) OVER (PARTITION BY step, b) AS c FROM steps, ct LEFT JOIN ord ON ct.a = ord.a WHERE dies IS NULL OR dies > step),
x AS (SELECT step, CAST(sum(n) AS BIGINT) AS n, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS k, sum(CAST(n AS DOUBLE) * n / (CAST(r AS DOUBLE) * c)) - 1 AS phi FROM alive GROUP BY 1),
v AS (SELECT step, n, CASE WHEN k > 0 THEN sqrt(phi / k) ELSE 0 END AS v, (SELECT count(*) FROM ord) - step AS candidates FROM x), e AS (SELECT min(step) AS last FROM v WHERE v < 0.01 OR candidates = 0)
SELECT step, n, round(v, 6) AS v, candidates, CASE WHEN step < last THEN a END AS dropped FROM v JOIN e ON step <= last LEFT JOIN ord ON dies = step + 1"""


@query(_EXCLUDE)
def remediation_exclusion(spark, d):
    return gates.exclusion_trace(_t(spark, d, "documents"), "source", "lang", stop=0.01, pure=0.58, least=20).withColumn("v", _r("v"))


@query(f"WITH {_CAPS}, s AS (SELECT * FROM (VALUES (0, 200, 400), (1, 100, 300), (2, 50, 200), (3, 30, 150), (4, 20, 100), (5, 10, 75), (6, 5, 50)) t(scheme, pure, mid))" + """,
ct AS (SELECT scheme, source AS a, lang AS b, count(*) AS n FROM r, s WHERE lang IS NOT NULL AND nth <= CASE WHEN purity >= 0.95 THEN pure WHEN purity >= 0.7 THEN mid ELSE nth END GROUP BY 1, 2, 3),
m AS (SELECT *, sum(n) OVER (PARTITION BY scheme, a) AS r, sum(n) OVER (PARTITION BY scheme, b) AS c FROM ct)
SELECT scheme, CAST(sum(n) AS BIGINT) AS n, round(sqrt((sum(CAST(n AS DOUBLE) * n / (CAST(r AS DOUBLE) * c)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS v FROM m GROUP BY 1""")
def remediation_balanced(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    return gates.balanced_schemes(docs, "source", "lang", "doc_id").withColumn("v", _r("v"))


@query()
def pca_projection(spark, d):
    return models.pca(_t(spark, d, "embeddings"), "embedding", 2).select("vec_id", F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"))


@query(f"""WITH RECURSIVE {_VECTORS}, q AS (SELECT a.vec_id AS id, b.vec_id AS nb, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 12) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id),
n AS (SELECT id, nb, dist, r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS r FROM q) WHERE r <= 15), m AS (SELECT avg(dist) AS overall FROM n),
d AS MATERIALIZED (SELECT id, list(dist ORDER BY r) AS d, coalesce(min(dist) FILTER (dist > 0), 0) AS rho, avg(dist) AS own FROM n GROUP BY 1),
h(id, k, low, high, mid) AS (SELECT id, 0, 0.0::DOUBLE, 'inf'::DOUBLE, 1.0::DOUBLE FROM d UNION ALL
SELECT id, k + 1, CASE WHEN s > log2(15) THEN low ELSE mid END, CASE WHEN s > log2(15) THEN mid ELSE high END, CASE WHEN s > log2(15) THEN (low + mid) / 2 WHEN high = 'inf'::DOUBLE THEN mid * 2 ELSE (mid + high) / 2 END
FROM (SELECT h.id AS id, k, low, high, mid, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / mid))) AS s FROM h JOIN d ON d.id = h.id WHERE k < 64)),
w AS (SELECT d.id AS id, rho, greatest(mid, 0.001 * CASE WHEN rho > 0 THEN own ELSE overall END) AS width FROM h JOIN d ON d.id = h.id, m WHERE k = 64),
e AS (SELECT least(n.id, nb) AS a, greatest(n.id, nb) AS b, CASE WHEN dist <= rho OR width = 0 THEN 1 ELSE exp(-(dist - rho) / width) END AS w FROM n JOIN w ON w.id = n.id)
SELECT a, b, round(sum(w) - CASE WHEN count(*) > 1 THEN max(w) * min(w) ELSE 0 END, 6) AS w FROM e GROUP BY 1, 2""")
def neighbor_graph(spark, d):
    """The fuzzy union of each point's 15 nearest."""
    return graph.fuzzy_graph(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding"), 15).withColumn("w", _r("w"))


@query()
def spectral_layout(spark, d):
    """Two directions of that graph, after few rounds; rounded, as signs and far digits depend on the order of sums."""
    own = graph.spectral_layout(graph.fuzzy_graph(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding"), 15), 2, rounds=10)
    return own.withColumn("vec", F.transform("vec", lambda x: F.round(x, 4)))


@query()
def seed_sensitivity(spark, d):
    """Clusters of five seeded projections to eight directions."""
    return models.seed_sensitivity(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding"), 8, [0, 1, 2, 3, 4], 4, 0.25, 5).withColumn("ari", _r("ari"))


@query("SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '0', CAST(vec_id AS VARCHAR))), vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings WHERE label IS NOT NULL")
def probe_folds(spark, d):
    return models.probe_folds(_t(spark, d, "embeddings"), "label", "vec_id").select("vec_id", "label", "fold")


@query()
def batch_probe(spark, d):
    return models.batch_probe(_t(spark, d, "embeddings"), "embedding", "label", "vec_id")


_COMBAT = f"""WITH RECURSIVE f AS (SELECT vec_id, vec_id % 5 AS batch, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT batch, i, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM f GROUP BY 1, 2),
w AS (SELECT *, sum(n * m) OVER (PARTITION BY i) / sum(n) OVER (PARTITION BY i) AS mean, sum(n * v) OVER (PARTITION BY i) / sum(n) OVER (PARTITION BY i) AS pooled FROM s),
g AS (SELECT *, sqrt(pooled) AS sd, CASE WHEN pooled > 0 THEN (m - mean) / sqrt(pooled) ELSE 0 END AS g, CASE WHEN pooled > 0 AND n > 1 THEN v / pooled * n / (n - 1) ELSE 1 END AS d FROM w),
h AS (SELECT *, avg(g) OVER (PARTITION BY batch) AS g0, greatest(var_samp(g) OVER (PARTITION BY batch), 1e-12) AS t2, avg(d) OVER (PARTITION BY batch) AS md, greatest(var_samp(d) OVER (PARTITION BY batch), 1e-12) AS s2 FROM g),
p AS (SELECT *, (2 * s2 + md * md) / s2 AS a, (md * s2 + md * md * md) / s2 AS b FROM h),
e AS (SELECT 0 AS k, batch, i, n, g, d, g0, t2, a, b, g AS gs, d AS ds FROM p UNION ALL
SELECT k + 1, batch, i, n, g, d, g0, t2, a, b, (n * t2 * g + ds * g0) / (n * t2 + ds), ((n - 1) * d + n * (g - (n * t2 * g + ds * g0) / (n * t2 + ds)) ** 2 + 2 * b) / 2 / (n / 2.0 + a - 1) FROM e WHERE k < 30),
c AS (SELECT e.batch AS batch, e.i AS i, mean, sd, gs, greatest(ds, 1e-12) AS ds FROM e JOIN p ON e.batch = p.batch AND e.i = p.i WHERE k = 30)"""
_FIXED = "CASE WHEN sd > 0 THEN ((x - mean) / sd - gs) / sqrt(ds) * sd + mean ELSE x END"


@query(f"{_COMBAT} SELECT vec_id, list(round({_FIXED}, 5) ORDER BY f.i) AS vec FROM f JOIN c ON f.batch = c.batch AND f.i = c.i GROUP BY 1")
def combat(spark, d):
    out = models.combat(_t(spark, d, "embeddings").withColumn("batch", F.col("vec_id") % 5), "vec_id", "embedding", "batch")
    return out.withColumn("vec", _rounded("vec", 5))


@query()
def gated_protocol(spark, d):
    """Gate, remedy, probe, correction and acceptance in one run; batches are made from ids."""
    own = _t(spark, d, "embeddings").withColumn("batch", (F.col("vec_id") % 5).cast("string"))
    verdict = protocol.run(own, "vec_id", "embedding", "batch", "label")[0]
    return verdict.select("confounding", _r("v").alias("v"), "scheme", "n", _r("batch_acc", 3).alias("batch_acc"), "chance", "signal", "used", "passed")


@query()
def harmony(spark, d):
    """Vectors without the batch effects of their soft clusters."""
    out = passes.harmony(_t(spark, d, "embeddings").withColumn("batch", F.col("vec_id") % 5), "vec_id", "embedding", "batch")
    return out.withColumn("vec", F.transform("vec", lambda x: F.round(x, 5)))


@query()
def combat_covariates(spark, d):
    own = _t(spark, d, "embeddings").withColumn("batch", F.col("vec_id") % 5).withColumn("age", F.col("vec_id") % 7).withColumn("sex", (F.col("label") % 2).cast("double"))
    own = own.withColumn("site", F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")))
    return models.combat(own, "vec_id", "embedding", "batch", covariates=["age", "sex", "site"])


_CLUSTERS = f"""WITH RECURSIVE {_PAIRS}), core AS (SELECT id FROM (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS k FROM q) WHERE k = 4 AND dist <= 0.9),
links AS (SELECT id, nb FROM q WHERE dist <= 0.9 AND id IN (SELECT id FROM core) AND nb IN (SELECT id FROM core)), reach(id, root) AS (SELECT id, id FROM core UNION SELECT nb, root FROM reach JOIN links ON reach.id = links.id),
lab AS (SELECT id, min(root) AS root FROM reach GROUP BY 1), big AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS cluster FROM lab GROUP BY 1 HAVING count(*) >= 5)"""


@query(_CLUSTERS + " SELECT e.vec_id AS id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM embeddings e LEFT JOIN lab ON lab.id = e.vec_id LEFT JOIN big ON big.root = lab.root")
def density_clusters(spark, d):
    return models.density_clusters(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding"), 4, 0.9, 5)


def _cut(x: str, source: str, eps: float = 0.9) -> str:
    """Common table expressions that end in {x}out (id, cluster): the cut of 4 neighbours at eps of `source` (vec_id, v); a cluster is its least id."""
    return f"""{x}q AS (SELECT a.vec_id AS id, b.vec_id AS nb, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS dist FROM {source} a JOIN {source} b ON a.vec_id <> b.vec_id),
{x}core AS (SELECT id FROM (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS k FROM {x}q) WHERE k = 4 AND dist <= {eps}),
{x}links AS (SELECT id, nb FROM {x}q WHERE dist <= {eps} AND id IN (SELECT id FROM {x}core) AND nb IN (SELECT id FROM {x}core)),
{x}reach(id, root) AS (SELECT id, id FROM {x}core UNION SELECT l.nb, r.root FROM {x}reach r JOIN {x}links l ON r.id = l.id), {x}lab AS (SELECT id, min(root) AS root FROM {x}reach GROUP BY 1),
{x}big AS (SELECT root FROM {x}lab GROUP BY 1 HAVING count(*) >= 5),
{x}out AS (SELECT s.vec_id AS id, coalesce(b.root, -1) AS cluster FROM {source} s LEFT JOIN {x}lab l ON l.id = s.vec_id LEFT JOIN {x}big b ON b.root = l.root)"""


def _ari(x: str, a: str, b: str) -> str:
    """Common table expressions that end in {x}ari (n, ari) of two tables (id, cluster)."""
    return f"""{x}ct AS (SELECT a.cluster AS a, b.cluster AS b, count(*) AS n FROM {a} a JOIN {b} b USING (id) GROUP BY 1, 2),
{x}s AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * (n - 1) / 2.0) AS s FROM {x}ct), {x}a AS (SELECT sum(m * (m - 1) / 2.0) AS sa FROM (SELECT sum(n) AS m FROM {x}ct GROUP BY a)), {x}b AS (SELECT sum(m * (m - 1) / 2.0) AS sb FROM (SELECT sum(n) AS m FROM {x}ct GROUP BY b)),
{x}ari AS (SELECT n, CASE WHEN abs((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)) < 1e-12 THEN 1.0 ELSE (s - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)) END AS ari FROM {x}s, {x}a, {x}b)"""


def _cut_metrics(x: str, ord_: int, eps: float) -> str:
    return f"""SELECT {ord_} AS ord, 4 AS min_samples, CAST({eps} AS DOUBLE) AS eps, n_clusters, noise_frac, round(CASE WHEN n_clusters >= 2 THEN silhouette END, 5) AS silhouette, round(CASE WHEN n_clusters >= 2 THEN davies_bouldin END, 5) AS davies_bouldin FROM
(SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, round(avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_frac FROM {x}out),
(SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM (SELECT id, max(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b FROM
  (SELECT q.id AS id, o.cluster AS la, t.cluster AS lb, avg(dist) AS m FROM {x}q q JOIN {x}out o ON o.id = q.id JOIN {x}out t ON t.id = q.nb WHERE o.cluster <> -1 AND t.cluster <> -1 GROUP BY 1, 2, 3) GROUP BY 1)),
(SELECT avg(worst) AS davies_bouldin FROM (SELECT g.l1, max((a.s + b.s) / g.far) AS worst FROM
  (SELECT a.cluster AS l1, b.cluster AS l2, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS far FROM {x}c a JOIN {x}c b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY 1, 2) g
  JOIN {x}sp a ON a.cluster = g.l1 JOIN {x}sp b ON b.cluster = g.l2 GROUP BY 1))"""


def _cut_centers(x: str) -> str:
    return f"""{x}f AS (SELECT o.cluster AS cluster, p.vec_id AS id, unnest(p.v) AS v, generate_subscripts(p.v, 1) AS i FROM p JOIN {x}out o ON o.id = p.vec_id WHERE o.cluster <> -1),
{x}c AS (SELECT cluster, i, avg(v) AS m FROM {x}f GROUP BY 1, 2),
{x}sp AS (SELECT cluster, avg(d) AS s FROM (SELECT f.cluster AS cluster, f.id AS id, sqrt(sum((f.v - c.m) * (f.v - c.m))) AS d FROM {x}f f JOIN {x}c c ON c.cluster = f.cluster AND c.i = f.i GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH RECURSIVE {_VECTORS}, {_cut('x', 'p', 0.9)}, {_cut_centers('x')}, {_cut('y', 'p', 1.0)}, {_cut_centers('y')} {_cut_metrics('x', 0, 0.9)} UNION ALL {_cut_metrics('y', 1, 1.0)}")
def cluster_sweep(spark, d):
    """The cuts at two distances of one density tree, with their metrics; select_config picks among such rows."""
    out = models.sweep(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding"), [4], [0.9, 1.0], 5)
    return out.select("ord", "min_samples", "eps", "n_clusters", _r("noise_frac").alias("noise_frac"), _r("silhouette", 5).alias("silhouette"), _r("davies_bouldin", 5).alias("davies_bouldin"))


@query()
def cluster_grid(spark, d):
    """54 cuts: six numbers of neighbours by nine distances, in one pass of distances for forests and one for silhouettes."""
    return models.sweep(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding"), [2, 3, 4, 5, 6, 8], [0.6, 0.7, 0.8, 0.9, 1.0, 1.05, 1.1, 1.15, 1.2], 5)


@query()
def density_hierarchy(spark, d):
    """The clusters of greatest excess of mass, without a distance to be given."""
    return hierarchy.clusters(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding"), 4, 5)


def _share(x: str, seed: int) -> str:
    """Points of a seeded share of whole groups."""
    return f"""{x}g AS (SELECT g, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', CAST(g AS VARCHAR))), g) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT vec_id % 100 AS g FROM embeddings)),
{x}p AS (SELECT vec_id, v FROM p WHERE vec_id % 100 IN (SELECT g FROM {x}g WHERE nth <= round_even(0.8 * n, 0)))"""


@query(f"""WITH RECURSIVE {_VECTORS}, {_cut('w', 'p')}, {_share('x', 1000)}, {_cut('x', 'xp')}, {_ari('x', 'wout', 'xout')}, {_share('y', 1001)}, {_cut('y', 'yp')}, {_ari('y', 'wout', 'yout')}
SELECT 1000 AS seed, n, round(ari, 6) AS ari FROM xari UNION ALL SELECT 1001, n, round(ari, 6) FROM yari""")
def cluster_stability(spark, d):
    """Clusters of two seeded shares of the groups of points against those of all."""
    e = _t(spark, d, "embeddings")
    points = vectors.points(e, "vec_id", "embedding").join(e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100).alias("lesion")), "id")
    return models.stability(points, models.density_clusters(points, 4, 0.9, 5), "lesion", [1000, 1001], 4, 0.9, 5).withColumn("ari", _r("ari"))


@query(f"""{_COMBAT}, raw AS (SELECT vec_id, {_V} AS v FROM embeddings), fx AS (SELECT vec_id, list({_FIXED} ORDER BY f.i) AS v FROM f JOIN c ON f.batch = c.batch AND f.i = c.i GROUP BY 1),
{_cut('x', 'raw')}, {_cut('y', 'fx')}, {_ari('z', 'xout', 'yout')} SELECT n, round(ari, 6) AS ari FROM zari""")
def method_agreement(spark, d):
    """Clusters of the vectors as they are against those after batch correction."""
    e = _t(spark, d, "embeddings")
    fixed = models.combat(e.withColumn("batch", F.col("vec_id") % 5), "vec_id", "embedding", "batch")
    a, b = (models.density_clusters(vectors.points(x, "vec_id", c), 4, 0.9, 5) for x, c in ((e, "embedding"), (fixed, "vec")))
    return models.agreement(a, b).withColumn("ari", _r("ari"))


@query("""WITH own AS (SELECT event_type, CAST(value AS DOUBLE) AS x FROM events WHERE user_id % 7 <> 0 AND value IS NOT NULL AND event_type IS NOT NULL),
r AS (SELECT event_type, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM own), g AS (SELECT sum(r) AS s, count(*) AS m FROM r GROUP BY event_type),
t AS (SELECT sum(n * n * n - n) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM own GROUP BY x)), k AS (SELECT sum(m) AS n, sum(s * s / m) AS s FROM g), med AS (SELECT median(x) AS mid FROM own)
SELECT CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, round(mid, 6) AS median FROM k, t, med""")
def nan_is_no_value(spark, d):
    """Every seventh user's values made NaN: the median and the rank test see the others only."""
    own = _t(spark, d, "events").where("event_type IS NOT NULL").withColumn("x", F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value").cast("double")))
    test = stats.kruskal(own, "event_type", "x").select("n", _r("h").alias("h"))
    return test.join(F.broadcast(relational.median(own, "x").select(_r("median").alias("median"))))


@query("WITH " + _cross("documents", "source", "lang") + """, grid AS (SELECT a, b FROM (SELECT DISTINCT a FROM ct), (SELECT DISTINCT b FROM ct))
SELECT a, b, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY a) AS DOUBLE), 6) AS fraction FROM grid LEFT JOIN ct USING (a, b)""")
def crosstab_row_fractions(spark, d):
    return relational.row_fractions(stats.crosstab(_t(spark, d, "documents"), "source", "lang")).withColumn("fraction", _r("fraction"))


@query("WITH " + _cross("documents", "source", "lang") + " SELECT a AS source, CAST(sum(n) AS BIGINT) AS n, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS purity FROM ct GROUP BY 1")
def group_purity(spark, d):
    return stats.purity(_t(spark, d, "documents"), "source", "lang").withColumn("purity", _r("purity"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND least(n_chars, 5000) >= 224 AND doc_id IN (SELECT doc_id FROM labels)")
def cohort_filter(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    return relational.cohort(docs, _t(spark, d, "labels"), "doc_id", (F.col("lang") == "en") & (F.least("n_chars", F.lit(5000)) >= 224)).select("doc_id", "source", "n_chars")


@query("SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (lang = 'en' AND n_chars >= 224) AS large, count(*) FILTER (lang = 'en' AND n_chars >= 224 AND source <> 'src0') AS kept FROM documents")
def filter_funnel(spark, d):
    return relational.funnel(_t(spark, d, "documents"), [("english", F.col("lang") == "en"), ("large", F.col("n_chars") >= 224), ("kept", F.col("source") != "src0")])


@query("SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, d):
    have = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return relational.missing_keys(_t(spark, d, "documents").select("doc_id"), have, "doc_id").agg(F.count("*").alias("missing"))


@query("WITH top AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 7) SELECT CASE WHEN source IN (SELECT source FROM top) THEN source ELSE 'Other' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def top_k_other(spark, d):
    return relational.top_k_or_other(_t(spark, d, "documents"), "source", 7).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) < 60")
def small_batches(spark, d):
    return _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n < 60")


@query("WITH s AS (SELECT CAST(c_nationkey AS VARCHAR) AS k, count(*) AS n FROM customer GROUP BY 1) SELECT CASE WHEN n < 60 THEN 'Other' ELSE k END AS batch, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1")
def merge_small_batches(spark, d):
    own = _t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("k"))
    return relational.merge_small(own, "k", 60).groupBy("batch").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'quality' AS "column", round(avg(CASE WHEN quality IS NULL THEN 0 ELSE 1 END), 6) AS rate, count(*) FILTER (quality IS NULL) AS missing FROM j
UNION ALL SELECT 'toxic', round(avg(CASE WHEN toxic IS NULL THEN 0 ELSE 1 END), 6), count(*) FILTER (toxic IS NULL) FROM j""")
def fill_rate(spark, d):
    own = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    return relational.fill_rates(own, ["quality", "toxic"]).withColumn("rate", _r("rate"))


@query("SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM conversations GROUP BY conv_id) GROUP BY 1")
def images_per_lesion(spark, d):
    return relational.group_sizes(_t(spark, d, "conversations"), "conv_id")


@query("""WITH r AS (SELECT min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi FROM events)
SELECT CAST(least(floor((CAST(value AS DOUBLE) - lo) / ((hi - lo) / 60)), 59) AS INTEGER) AS bin, count(*) AS n FROM events, r WHERE value IS NOT NULL GROUP BY 1""")
def value_histogram(spark, d):
    return relational.histogram(_t(spark, d, "events"), "value", 60)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both FROM a FULL JOIN b ON a.k = b.k""")
def overlap_venn(spark, d):
    return relational.overlap(_t(spark, d, "orders").select("o_custkey"), _t(spark, d, "customer").select("c_custkey"))


def _kruskal(f: str) -> str:
    return f"""WITH f AS ({f}), k AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY x) AS t FROM f WHERE g IS NOT NULL AND x IS NOT NULL),
s AS (SELECT g, sum(rk) AS r, count(*) AS m FROM k GROUP BY 1), tie AS (SELECT sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM k), a AS (SELECT count(*) AS groups, CAST(sum(m) AS BIGINT) AS n, sum(r * r / m) AS s, count(*) FILTER (m >= 10) AS able FROM s),
h AS (SELECT groups, n, able, CASE WHEN able >= 2 THEN (12.0 / (CAST(n AS DOUBLE) * (n + 1)) * s - 3.0 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) END AS h FROM a, tie)
SELECT groups, n, round(h, 4) AS h, CASE WHEN able >= 2 THEN groups - 1 END AS dof, able < 2 AS underpowered"""


def _tail(x: str, k: str) -> str:
    """The chi-square tail for an even number of degrees of freedom."""
    return f"round(list_sum(list_transform(range(0, CAST({k} / 2 AS BIGINT)), lambda i: exp(-{x} / 2 + i * ln({x} / 2) - lgamma(i + 1)))), 6)"


@query(_kruskal("SELECT c_mktsegment AS g, c_acctbal AS x FROM customer") + f", {_tail('h', '(groups - 1)')} AS p FROM h")
def kruskal_by_group(spark, d):
    return stats.kruskal(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal").withColumn("h", _r("h", 4)).withColumn("p", _r("p"))


_SMALL = "CASE WHEN s_suppkey <= 4 THEN 'few' WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END"


@query(_kruskal(f"SELECT {_SMALL} AS g, s_acctbal AS x FROM supplier") + f", {_tail('h', '(groups - 1)')} AS p FROM h")
def kruskal_small_group(spark, d):
    """A group of four values counts in the statistic; it only doesn't make the test powerful."""
    own = _t(spark, d, "supplier").select(F.expr(_SMALL).alias("g"), F.col("s_acctbal").alias("x"))
    return stats.kruskal(own, "g", "x").withColumn("h", _r("h", 4)).withColumn("p", _r("p"))


@query(_chi("orders", "o_orderstatus", "o_orderpriority") + f", y AS (SELECT *, (nr - 1) * (nc - 1) AS dof FROM x) SELECT nr AS groups, n, round(chi2, 6) AS chi2, dof, false AS underpowered, {_tail('chi2', 'dof')} AS p FROM y")
def chi2_power_guard(spark, d):
    return stats.chi_square_test(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("chi2", _r("chi2")).withColumn("p", _r("p"))


@query("SELECT count(DISTINCT lang) AS groups, count(*) AS n, -1.0::DOUBLE AS chi2, true AS underpowered FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND toxic IS NOT NULL")
def chi2_underpowered(spark, d):
    own = _t(spark, d, "documents").where("lang = 'en'").select("doc_id", "lang").join(_t(spark, d, "labels"), "doc_id")
    return stats.chi_square_test(own, "lang", "toxic").select("groups", "n", F.coalesce("chi2", F.lit(-1.0)).alias("chi2"), "underpowered")


_ARI = """WITH ct AS (SELECT label AS a, list_position(embedding, list_max(embedding)) % 10 AS b, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1, 2),
s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2.0) AS s FROM ct), x AS (SELECT sum(m * (m - 1) / 2.0) AS sa FROM (SELECT sum(n) AS m FROM ct GROUP BY a)), y AS (SELECT sum(m * (m - 1) / 2.0) AS sb FROM (SELECT sum(n) AS m FROM ct GROUP BY b))
SELECT CAST(n AS BIGINT) AS n, round((s - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 6) AS ari FROM s, x, y"""


@query(_ARI)
def adjusted_rand(spark, d):
    e = _t(spark, d, "embeddings").withColumn("top", F.array_position("embedding", F.array_max("embedding")) % 10)
    return stats.adjusted_rand(e, "label", "top").withColumn("ari", _r("ari"))


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform({_V}, lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", _r(vectors.norm(vectors.double("embedding"))).alias("norm"))


_CENTERS = f"c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2)"


@query(f"WITH {_CENTERS} SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS m FROM c")
def cluster_centroids(spark, d):
    return vectors.group_mean(_t(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "m")).withColumn("m", _r("m"))


_COSINE = f"""WITH {_CENTERS}, v AS (SELECT vec_id, label, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
j AS (SELECT vec_id, v.label AS label, sum(x * m) / ((sqrt(sum(x * x)) + 1e-8) * (sqrt(sum(m * m)) + 1e-8)) AS cosine FROM v JOIN c ON v.label = c.label AND v.i = c.i GROUP BY 1, 2)"""


def _cosines(spark, d):
    e = _t(spark, d, "embeddings")
    c = vectors.group_mean(e, "label", "embedding").select("label", "centroid")
    return dealt_join(e, c, "label", "vec_id").select("vec_id", "label", vectors.dot(vectors.unit(vectors.double("embedding")), vectors.unit(F.col("centroid"))).alias("cosine"))


@query(_COSINE + " SELECT vec_id, label, round(cosine, 6) AS cosine FROM j")
def centroid_cosine(spark, d):
    return _cosines(spark, d).withColumn("cosine", _r("cosine"))


@query(_COSINE + " SELECT label, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM j) WHERE rank <= 3")
def representatives(spark, d):
    return gates.nearest_to_centroid(_cosines(spark, d).withColumn("cosine", _r("cosine", 9)), "label", "cosine", "vec_id", 3).select("label", "vec_id", "rank")


_PAIRS = f"""p AS (SELECT vec_id, label, {_V} AS v FROM embeddings), q AS (SELECT a.vec_id AS id, a.label AS la, b.vec_id AS nb, b.label AS lb,
round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id"""


def _near(spark, d, k):
    p = vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return p, vectors.nearest(p, p.where("id % 20 = 0"), k)


@query(f"WITH {_PAIRS} WHERE a.vec_id % 20 = 0) SELECT id, nb AS neighbor, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS rank FROM q) WHERE rank <= 10")
def knn_topk(spark, d):
    return _near(spark, d, 10)[1].select("id", "neighbor", "rank", _r("distance").alias("distance"))


@query(f"""WITH {_PAIRS} WHERE a.vec_id % 20 = 0), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS rank FROM q) WHERE rank <= 30),
s AS (SELECT avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END) AS same FROM k), e AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS expected FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY label))
SELECT round(same, 6) AS same, round(expected, 6) AS expected, round((1 - same) / (1 - expected), 6) AS mixing FROM s, e""")
def mixing_score(spark, d):
    p, near = _near(spark, d, 30)
    return vectors.mixing(near.select("id", "neighbor"), p.select("id", "label")).select(*(_r(c).alias(c) for c in ("same", "expected", "mixing")))


@query(f"""WITH {_PAIRS}), m AS (SELECT id, la, lb, avg(dist) AS m FROM q GROUP BY 1, 2, 3), s AS (SELECT id, la AS label, max(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b FROM m GROUP BY 1, 2)
SELECT id, CAST(label AS VARCHAR) AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS s FROM s""")
def silhouette_euclid(spark, d):
    return vectors.silhouette(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding", "label")).withColumn("s", _r("s", 5))


@query(f"""WITH {_CENTERS}, v AS (SELECT vec_id, label, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT label, avg(dd) AS s FROM (SELECT vec_id, v.label AS label, sqrt(sum((x - m) * (x - m))) AS dd FROM v JOIN c ON v.label = c.label AND v.i = c.i GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT a.label AS l1, b.label AS l2, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2)
SELECT round(avg(worst), 6) AS db FROM (SELECT l1, max((x.s + y.s) / dist) AS worst FROM g JOIN s x ON x.label = l1 JOIN s y ON y.label = l2 GROUP BY 1)""")
def davies_bouldin(spark, d):
    return vectors.davies_bouldin(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding", "label")).withColumn("db", _r("db"))


_CAPS = """p AS (SELECT source, max(n) / CAST(sum(n) AS DOUBLE) AS purity FROM (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT doc_id, d.source AS source, d.lang AS lang, purity, row_number() OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR))), doc_id) AS nth FROM documents d JOIN p ON d.source = p.source)"""


@query(f"WITH {_CAPS} SELECT doc_id, source FROM r WHERE nth <= CASE WHEN purity >= 0.95 THEN 10 WHEN purity >= 0.7 THEN 20 ELSE nth END")
def balanced_subsample(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    own = dealt_join(docs, stats.purity(docs, "source", "lang").drop("n"), "source", "doc_id")
    return sampling.capped(own, "source", "doc_id", sampling.tier_cap(F.col("purity"), 10, 20)).select("doc_id", "source")


@query("""WITH g AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), k AS (SELECT conv_id, row_number() OVER (ORDER BY md5(concat_ws('|', '1000', CAST(conv_id AS VARCHAR))), conv_id) AS nth FROM g)
SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM k WHERE nth <= round_even(0.8 * (SELECT count(*) FROM g), 0))""")
def bootstrap_group_mask(spark, d):
    return sampling.groups(_t(spark, d, "conversations"), "conv_id", 0.8, 1000).select("conv_id", "turn")


_SWEEP = """SELECT l_linenumber AS ord, count(DISTINCT l_quantity) % 20 AS n_clusters, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS noise_frac, round(stddev_pop(CAST(l_discount AS DOUBLE)), 9) AS silhouette FROM lineitem GROUP BY 1"""


@query(f"WITH s AS ({_SWEEP}) SELECT ord, n_clusters, round(noise_frac, 6) AS noise_frac, round(silhouette, 6) AS silhouette, NOT (n_clusters BETWEEN 2 AND 15 AND noise_frac < 0.3) AS fallback_used FROM s WHERE silhouette IS NOT NULL AND n_clusters >= 2 ORDER BY 5, s.silhouette DESC, ord LIMIT 1")
def select_best_config(spark, d):
    sweep = _t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("ord")).agg((F.countDistinct("l_quantity") % 20).alias("n_clusters"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("noise_frac"), F.round(F.stddev_pop(F.col("l_discount").cast("double")), 9).alias("silhouette"))
    return gates.select_config(sweep, "ord").select("ord", "n_clusters", _r("noise_frac").alias("noise_frac"), _r("silhouette").alias("silhouette"), "fallback_used")


@query("SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, avg(value) >= 0.6 AS is_stable FROM events")
def ari_summary(spark, d):
    s = gates.summary(_t(spark, d, "events"), "value")
    return s.select(*(_r(c).alias(c) for c in ("mean", "std", "min", "max")), "is_stable")


@query("SELECT coalesce(CAST(NULLIF(user_id % 7, 0) AS VARCHAR), 'single-' || CAST(event_id AS VARCHAR)) AS lesion, count(*) AS n FROM events GROUP BY 1")
def lesion_coalesce(spark, d):
    key = F.coalesce(F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 7).cast("string"), F.concat(F.lit("single-"), F.col("event_id").cast("string")))
    return _t(spark, d, "events").groupBy(key.alias("lesion")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'es' AS INTEGER) AS lang_es, CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM documents")
def one_hot_drop_first(spark, d):
    return relational.one_hot(_t(spark, d, "documents").select("doc_id", "lang"), "lang", "lang_").drop("lang")


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 5) AS z FROM customer")
def standardize(spark, d):
    return vectors.standardize(_t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), "c_acctbal").select("c_custkey", _r("z", 5).alias("z"))


@query("SELECT lang, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS fraction FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def value_counts_normalised(spark, d):
    return relational.value_counts(_t(spark, d, "documents"), "lang").withColumn("fraction", _r("fraction"))


@query("SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def factorize(spark, d):
    return relational.codes(_t(spark, d, "documents"), "source")


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS u0, count(*) FILTER (user_id % 3 = 1) AS u1 FROM events GROUP BY 1")
def pivot_grid(spark, d):
    n = _t(spark, d, "events").groupBy("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("u")).agg(F.count("*").alias("n"))
    return relational.pivot_grid(n, "event_type", "u", ["u0", "u1"], "n")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_labels(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT toxic, count(*) AS n, round(avg(n_chars), 6) AS chars FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY 1")
def inner_join_labels(spark, d):
    return _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id").where("toxic IS NOT NULL").groupBy("toxic").agg(F.count("*").alias("n"), _r(F.avg("n_chars")).alias("chars"))


@query("""WITH m AS (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) AS mid FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, coalesce(CAST(quality AS DOUBLE), mid) AS quality FROM documents LEFT JOIN labels USING (doc_id), m""")
def median_fill(spark, d):
    own = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return relational.median_fill(own, "quality")


_EXCLUDE = "WITH " + _cross("documents", "source", "lang") + """, tot AS (SELECT a, sum(n) AS r, max(n) / CAST(sum(n) AS DOUBLE) AS purity FROM ct GROUP BY 1),
ord AS (SELECT a, row_number() OVER (ORDER BY r DESC, a) AS dies FROM tot WHERE purity > 0.58 AND r >= 20), steps AS (SELECT unnest(range(0, (SELECT count(*) + 1 FROM ord))) AS step),
alive AS (SELECT step, ct.a AS a, b, n, sum(n) OVER (PARTITION BY step, ct.a) AS r, sum(n) OVER (PARTITION BY step, b) AS c FROM steps, ct LEFT JOIN ord ON ct.a = ord.a WHERE dies IS NULL OR dies > step),
x AS (SELECT step, CAST(sum(n) AS BIGINT) AS n, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS k, sum(CAST(n AS DOUBLE) * n / (CAST(r AS DOUBLE) * c)) - 1 AS phi FROM alive GROUP BY 1),
v AS (SELECT step, n, CASE WHEN k > 0 THEN sqrt(phi / k) ELSE 0 END AS v, (SELECT count(*) FROM ord) - step AS candidates FROM x), e AS (SELECT min(step) AS last FROM v WHERE v < 0.01 OR candidates = 0)
SELECT step, n, round(v, 6) AS v, candidates, CASE WHEN step < last THEN a END AS dropped FROM v JOIN e ON step <= last LEFT JOIN ord ON dies = step + 1"""


@query(_EXCLUDE)
def remediation_exclusion(spark, d):
    return gates.exclusion_trace(_t(spark, d, "documents"), "source", "lang", stop=0.01, pure=0.58, least=20).withColumn("v", _r("v"))


@query(f"WITH {_CAPS}, s AS (SELECT * FROM (VALUES (0, 200, 400), (1, 100, 300), (2, 50, 200), (3, 30, 150), (4, 20, 100), (5, 10, 75), (6, 5, 50)) t(scheme, pure, mid))" + """,
ct AS (SELECT scheme, source AS a, lang AS b, count(*) AS n FROM r, s WHERE lang IS NOT NULL AND nth <= CASE WHEN purity >= 0.95 THEN pure WHEN purity >= 0.7 THEN mid ELSE nth END GROUP BY 1, 2, 3),
m AS (SELECT *, sum(n) OVER (PARTITION BY scheme, a) AS r, sum(n) OVER (PARTITION BY scheme, b) AS c FROM ct)
SELECT scheme, CAST(sum(n) AS BIGINT) AS n, round(sqrt((sum(CAST(n AS DOUBLE) * n / (CAST(r AS DOUBLE) * c)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS v FROM m GROUP BY 1""")
def remediation_balanced(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    return gates.balanced_schemes(docs, "source", "lang", "doc_id").withColumn("v", _r("v"))


@query()
def pca_projection(spark, d):
    return models.pca(_t(spark, d, "embeddings"), "embedding", 2).select("vec_id", F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"))


@query("SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '0', CAST(vec_id AS VARCHAR))), vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings WHERE label IS NOT NULL")
def probe_folds(spark, d):
    return models.probe_folds(_t(spark, d, "embeddings"), "label", "vec_id").select("vec_id", "label", "fold")


@query()
def batch_probe(spark, d):
    return models.batch_probe(_t(spark, d, "embeddings"), "embedding", "label", "vec_id")


@query(f"""WITH RECURSIVE f AS (SELECT vec_id, vec_id % 5 AS batch, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT batch, i, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM f GROUP BY 1, 2),
w AS (SELECT *, sum(n * m) OVER (PARTITION BY i) / sum(n) OVER (PARTITION BY i) AS mean, sum(n * v) OVER (PARTITION BY i) / sum(n) OVER (PARTITION BY i) AS pooled FROM s),
g AS (SELECT *, sqrt(pooled) AS sd, CASE WHEN pooled > 0 THEN (m - mean) / sqrt(pooled) ELSE 0 END AS g, CASE WHEN pooled > 0 AND n > 1 THEN v / pooled * n / (n - 1) ELSE 1 END AS d FROM w),
h AS (SELECT *, avg(g) OVER (PARTITION BY batch) AS g0, greatest(var_samp(g) OVER (PARTITION BY batch), 1e-12) AS t2, avg(d) OVER (PARTITION BY batch) AS md, greatest(var_samp(d) OVER (PARTITION BY batch), 1e-12) AS s2 FROM g),
p AS (SELECT *, (2 * s2 + md * md) / s2 AS a, (md * s2 + md * md * md) / s2 AS b FROM h),
e AS (SELECT 0 AS k, batch, i, n, g, d, g0, t2, a, b, g AS gs, d AS ds FROM p UNION ALL
SELECT k + 1, batch, i, n, g, d, g0, t2, a, b, (n * t2 * g + ds * g0) / (n * t2 + ds), ((n - 1) * d + n * (g - (n * t2 * g + ds * g0) / (n * t2 + ds)) ** 2 + 2 * b) / 2 / (n / 2.0 + a - 1) FROM e WHERE k < 30),
c AS (SELECT e.batch AS batch, e.i AS i, mean, sd, gs, greatest(ds, 1e-12) AS ds FROM e JOIN p ON e.batch = p.batch AND e.i = p.i WHERE k = 30)
SELECT vec_id, list(round(CASE WHEN sd > 0 THEN ((x - mean) / sd - gs) / sqrt(ds) * sd + mean ELSE x END, 5) ORDER BY f.i) AS vec FROM f JOIN c ON f.batch = c.batch AND f.i = c.i GROUP BY 1""")
def combat(spark, d):
    out = models.combat(_t(spark, d, "embeddings").withColumn("batch", F.col("vec_id") % 5), "vec_id", "embedding", "batch")
    return out.withColumn("vec", _rounded("vec", 5))


@query()
def gated_protocol(spark, d):
    """Gate, remedy, probe, correction and acceptance in one run; batches are made from ids."""
    own = _t(spark, d, "embeddings").withColumn("batch", (F.col("vec_id") % 5).cast("string"))
    verdict = protocol.run(own, "vec_id", "embedding", "batch", "label")[0]
    return verdict.select("confounding", _r("v").alias("v"), "scheme", "n", _r("batch_acc", 3).alias("batch_acc"), "chance", "signal", "used", "passed")


@query()
def harmony(spark, d):
    """Vectors without the batch effects of their soft clusters."""
    out = passes.harmony(_t(spark, d, "embeddings").withColumn("batch", F.col("vec_id") % 5), "vec_id", "embedding", "batch")
    return out.withColumn("vec", F.transform("vec", lambda x: F.round(x, 5)))


@query()
def combat_covariates(spark, d):
    own = _t(spark, d, "embeddings").withColumn("batch", F.col("vec_id") % 5).withColumn("age", F.col("vec_id") % 7).withColumn("sex", (F.col("label") % 2).cast("double"))
    own = own.withColumn("site", F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")))
    return models.combat(own, "vec_id", "embedding", "batch", covariates=["age", "sex", "site"])


_CLUSTERS = f"""WITH RECURSIVE {_PAIRS}), core AS (SELECT id FROM (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS k FROM q) WHERE k = 4 AND dist <= 0.9),
links AS (SELECT id, nb FROM q WHERE dist <= 0.9 AND id IN (SELECT id FROM core) AND nb IN (SELECT id FROM core)), reach(id, root) AS (SELECT id, id FROM core UNION SELECT nb, root FROM reach JOIN links ON reach.id = links.id),
lab AS (SELECT id, min(root) AS root FROM reach GROUP BY 1), big AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS cluster FROM lab GROUP BY 1 HAVING count(*) >= 5)"""


@query(_CLUSTERS + " SELECT e.vec_id AS id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM embeddings e LEFT JOIN lab ON lab.id = e.vec_id LEFT JOIN big ON big.root = lab.root")
def density_clusters(spark, d):
    return models.density_clusters(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding"), 4, 0.9, 5)


@query()
def cluster_sweep(spark, d):
    """The cuts at two distances of one density tree, with their metrics; select_config picks among such rows."""
    return models.sweep(vectors.points(_t(spark, d, "embeddings"), "vec_id", "embedding"), [4], [0.9, 1.0], 5)


@query()
def cluster_stability(spark, d):
    """Clusters of two seeded shares of the groups of points against those of all."""
    e = _t(spark, d, "embeddings")
    points = vectors.points(e, "vec_id", "embedding").join(e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100).alias("lesion")), "id")
    return models.stability(points, models.density_clusters(points, 4, 0.9, 5), "lesion", [1000, 1001], 4, 0.9, 5)


@query()
def method_agreement(spark, d):
    """Clusters of the vectors as they are against those after batch correction."""
    e = _t(spark, d, "embeddings")
    fixed = models.combat(e.withColumn("batch", F.col("vec_id") % 5), "vec_id", "embedding", "batch")
    a, b = (models.density_clusters(vectors.points(x, "vec_id", c), 4, 0.9, 5) for x, c in ((e, "embedding"), (fixed, "vec")))
    return models.agreement(a, b)


@query("WITH " + _cross("documents", "source", "lang") + """, grid AS (SELECT a, b FROM (SELECT DISTINCT a FROM ct), (SELECT DISTINCT b FROM ct))
SELECT a, b, coalesce(n, 0) AS n, round_even(coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY a) AS DOUBLE) * 100, 2) AS percent FROM grid LEFT JOIN ct USING (a, b)""")
def crosstab_row_pct(spark, d):
    return relational.row_percent(stats.crosstab(_t(spark, d, "documents"), "source", "lang"))


@query("SELECT source, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY 1")
def filled_counts(spark, d):
    own = _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return relational.filled_counts(own, "source", "quality")


@query('SELECT list(n ORDER BY event_type) AS "values" FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)')
def report_list(spark, d):
    return relational.as_list(_t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")


@query("SELECT list(event_type ORDER BY event_type) AS k, list(n ORDER BY event_type) AS v FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def report_map(spark, d):
    one = relational.as_map(_t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")
    return one.select(F.map_keys("values").alias("k"), F.map_values("values").alias("v"))


@query("SELECT count(*) AS n, count(DISTINCT CASE WHEN label > 0 THEN label END) AS n_clusters, round(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END), 6) AS noise_frac FROM embeddings WHERE label IS NOT NULL")
def cluster_shape(spark, d):
    return gates.cluster_shape(_t(spark, d, "embeddings").select((F.col("label") - 1).alias("c")), "c").withColumn("noise_frac", _r("noise_frac"))


@query("SELECT vec_id, label - 1 AS cluster FROM embeddings WHERE label - 1 <> -1")
def without_noise(spark, d):
    return relational.without_noise(_t(spark, d, "embeddings").select("vec_id", (F.col("label") - 1).alias("cluster")), "cluster")


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src1'")
def single_source(spark, d):
    return relational.single_source(_t(spark, d, "documents").select("doc_id", "n_chars", "source"), "source", "src1", least=5).drop("source")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr', 'xx') ORDER BY doc_id")
def in_set_sorted(spark, d):
    return _t(spark, d, "documents").where(F.col("lang").isin("de", "fr", "xx")).select("doc_id", "lang").orderBy("doc_id")


@query("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src0'")
def not_equal_keeping_null(spark, d):
    return _t(spark, d, "documents").where(~F.col("source").eqNullSafe("src0")).select("doc_id", "source")


@query(f"WITH n AS (SELECT sqrt(list_sum(list_transform({_V}, lambda x: x * x))) AS n FROM embeddings) SELECT count(*) AS n, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (isnan(n)) AS with_nan, count(*) FILTER (n = 0) AS zero, round(avg(n) FILTER (n > 0), 6) AS mean FROM n")
def norm_summary(spark, d):
    return vectors.norm_summary(_t(spark, d, "embeddings"), "embedding").withColumn("mean", _r("mean"))


@query("SELECT row_number() OVER (ORDER BY l.doc_id DESC) AS ord, l.doc_id AS doc_id, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id ORDER BY ord")
def ordered_lookup(spark, d):
    labels = _t(spark, d, "labels")
    ids = relational.before(labels.select("doc_id", (-F.col("doc_id")).alias("place")), "place", F.lit(1), "ord").select("doc_id", (F.col("ord") + 1).alias("ord"))
    return relational.ordered_lookup(ids, _t(spark, d, "documents").select("doc_id", "source"), "doc_id", "ord").select("ord", "doc_id", "source")


@query("SELECT doc_id, len(embedding) AS size FROM documents JOIN embeddings ON doc_id = vec_id")
def lookup_skip_missing(spark, d):
    have = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors.lookup(_t(spark, d, "documents").select("doc_id"), have, "doc_id", "embedding").select("doc_id", F.size("embedding").cast("long").alias("size"))


@query("SELECT doc_id, embedding IS NULL AS missing FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def lookup_null_missing(spark, d):
    have = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors.lookup(_t(spark, d, "documents").select("doc_id"), have, "doc_id", "embedding", "null").select("doc_id", F.col("embedding").isNull().alias("missing"))


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en FROM documents GROUP BY 1")
def map_of_maps_wide(spark, d):
    cells = stats.crosstab(_t(spark, d, "documents"), "source", "lang")
    nested = cells.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m")).select(F.create_map("a", "m").alias("maps"))
    return relational.unnested(nested, "maps", "source", "lang").groupBy("source").pivot("lang", ["de", "en"]).agg(F.first("value")).fillna(0)


@query("SELECT (s - 1) * 3 + l AS ord, s AS step, l / 2.0 AS low, count(*) FILTER (value > l / 2.0 AND user_id % s = 0) AS n FROM events, (SELECT unnest([1, 2]) AS s), (SELECT unnest([0, 1, 2]) AS l) GROUP BY 1, s, l")
def parameter_grid(spark, d):
    """Events that meet every combination of two parameters, in one pass over them."""
    own = _t(spark, d, "events").select("value", "user_id").crossJoin(F.broadcast(relational.grid(spark, step=[1, 2], low=[0.0, 0.5, 1.0])))
    return own.groupBy("ord", "step", "low").agg(F.count(F.when((F.col("value") > F.col("low")) & (F.col("user_id") % F.col("step") == 0), 1)).alias("n"))


@query("SELECT t AS event_type, coalesce(n.u0, -1) AS u0, coalesce(n.u1, -1) AS u1 FROM (SELECT unnest(['click', 'none', 'view']) AS t) LEFT JOIN (SELECT event_type, CASE WHEN count(*) FILTER (user_id % 3 = 0) > 0 THEN count(*) FILTER (user_id % 3 = 0) END AS u0, CASE WHEN count(*) FILTER (user_id % 3 = 1) > 0 THEN count(*) FILTER (user_id % 3 = 1) END AS u1 FROM events GROUP BY 1) n ON n.event_type = t")
def pivot_dense(spark, d):
    n = _t(spark, d, "events").groupBy("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("u")).agg(F.count("*").alias("n"))
    return relational.pivot_grid(n, "event_type", "u", ["u0", "u1"], "n", ["click", "none", "view"]).fillna(-1)


@query("WITH " + _cross("documents", "source", "lang") + """, a AS (SELECT sum(m) / CAST(sum(n) AS DOUBLE) AS accuracy FROM (SELECT max(n) AS m, sum(n) AS n FROM ct GROUP BY a)), c AS (SELECT count(DISTINCT lang) AS n_batches FROM documents)
SELECT round(accuracy, 6) AS accuracy, n_batches, round(1.0 / n_batches, 6) AS chance, CASE WHEN accuracy >= 1.0 / n_batches + 0.1 THEN 'PROCEED' ELSE 'SKIP_HARMONIZATION' END AS verdict FROM a, c""")
def batch_signal(spark, d):
    docs = _t(spark, d, "documents")
    best = stats.crosstab(docs, "source", "lang").groupBy("a").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("accuracy"))
    one = best.join(F.broadcast(gates.chance(docs, "lang")))
    return one.select(_r("accuracy").alias("accuracy"), "n_batches", _r("chance").alias("chance"), gates.batch_signal(F.col("accuracy"), F.col("n_batches")).alias("verdict"))


_METRICS = "SELECT l_returnflag AS name, avg(l_tax) AS batch_acc, avg(l_discount) AS mixing, avg(l_quantity) AS bio_silhouette FROM lineitem GROUP BY 1"
_PASSED = f"WITH m AS ({_METRICS}), p AS (SELECT a.name AS name, a.batch_acc < 0.1 AND a.mixing > r.mixing AND a.bio_silhouette >= 0.85 * r.bio_silhouette AS passed FROM m a JOIN m r ON r.name = 'A' AND a.name <> 'A')"


def _metrics(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.avg("l_tax").alias("batch_acc"), F.avg("l_discount").alias("mixing"), F.avg("l_quantity").alias("bio_silhouette"))


@query(_PASSED + " SELECT name, passed FROM p")
def acceptance_gate(spark, d):
    return gates.accepted(_metrics(spark, d), F.lit(0.0), raw="A")


@query(_PASSED + ", x AS (SELECT bool_or(passed) FILTER (name = 'N') AS a, bool_or(passed) FILTER (name = 'R') AS b FROM p) SELECT CASE WHEN NOT a AND b THEN 'R' ELSE 'N' END AS used, a OR b AS passed FROM x")
def acceptance_retry(spark, d):
    return gates.with_retry(_metrics(spark, d), F.lit(0.0), "N", "R", raw="A")


@query(f"""WITH {_CENTERS}, v AS (SELECT vec_id, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id // 16 AS image, CAST(vec_id % 16 // 4 AS INTEGER) AS "row", CAST(vec_id % 4 AS INTEGER) AS col, round(sum(x * m) / ((sqrt(sum(x * x)) + 1e-8) * (sqrt(sum(m * m)) + 1e-8)), 6) AS similarity FROM v JOIN c ON v.i = c.i WHERE c.label = 0 GROUP BY vec_id""")
def similarity_grid(spark, d):
    e = _t(spark, d, "embeddings")
    center = vectors.group_mean(e.where("label = 0"), "label", "embedding")
    patches = e.select(F.floor(F.col("vec_id") / 16).alias("image"), (F.col("vec_id") % 16).alias("patch"), "embedding")
    return vectors.similarity_grid(patches, center, "image", "patch", "embedding", 4).withColumn("similarity", _r("similarity"))


@query(f"SELECT vec_id, list_transform({_V}, lambda x: round((x / 255.0 - 0.485) / 0.229, 6)) AS x FROM embeddings")
def pixel_normalise(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.transform(media.normalise(vectors.double("embedding"), 0.485, 0.229), lambda x: F.round(x, 6)).alias("x"))


@query("SELECT round(avg(CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate FROM documents")
def fallback_rate(spark, d):
    return media.fallback_rate(_t(spark, d, "documents").select((F.col("lang") != "en").alias("used")), "used").withColumn("fallback_rate", _r("fallback_rate"))


@query("""WITH l AS (SELECT l_shipdate::DATE AS image, avg(l_quantity ** 6) ** (1 / 6.0) AS r, avg((l_discount * 100) ** 6) ** (1 / 6.0) AS g, avg((l_tax * 100) ** 6) ** (1 / 6.0) AS b FROM lineitem GROUP BY 1)
SELECT CAST(image AS VARCHAR) AS image, round(CASE WHEN r > 0 THEN sqrt(r * r + g * g + b * b) / (r * sqrt(3)) END, 5) AS r, round(CASE WHEN g > 0 THEN sqrt(r * r + g * g + b * b) / (g * sqrt(3)) END, 5) AS g, round(CASE WHEN b > 0 THEN sqrt(r * r + g * g + b * b) / (b * sqrt(3)) END, 5) AS b FROM l""")
def shades_of_gray(spark, d):
    pixels = _t(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("image"), F.col("l_quantity").alias("r"), (F.col("l_discount") * 100).alias("g"), (F.col("l_tax") * 100).alias("b"))
    return media.shades_of_gray(pixels, "image", ["r", "g", "b"]).select("image", *(_r(c, 5).alias(c) for c in "rgb"))


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' ELSE 'long' END AS reason FROM documents WHERE NOT n_chars BETWEEN 200 AND 5000")
def bad_rows(spark, d):
    own = _t(spark, d, "documents").select("doc_id", F.col("n_chars").between(200, 5000).alias("ok"), F.col("n_chars").alias("value"), F.when(F.col("n_chars") < 200, "short").otherwise("long").alias("reason"))
    return relational.split_bad(own, "ok", "value", "reason")[1]


def _file(spark) -> str:
    return f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, o_orderdate FROM orders")
def csv_file(spark, d):
    """Orders written as CSV and read back, with NaN for every seventh price."""
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    own, path = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", price.alias("price"), "o_orderdate"), _file(spark)
    files.write_csv(own, path)
    return files.csv(spark, path, own.schema)


@query("SELECT source AS a, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def crosstab_file(spark, d):
    """The crosstab of sources and languages written as a wide CSV and read back."""
    path = _file(spark)
    files.write_crosstab(stats.crosstab(_t(spark, d, "documents"), "source", "lang"), path, ["de", "en", "es", "fr"])
    return files.csv(spark, path, "a string, de long, en long, es long, fr long")


@query("SELECT 'orders' AS name, count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def report_file(spark, d):
    """A report of one row written as nested JSON and read back."""
    one, path = _t(spark, d, "orders").agg(F.lit("orders").alias("name"), F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")), _file(spark)
    files.write_report(one, path, {"price": ["mean", "low", "high"]})
    return files.json(spark, path).select("name", "n", _r("price.mean", 4).alias("mean"), "price.low", "price.high")


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 8")
def keyed_file(spark, d):
    """Events written by a hash of the user, of which one user's are read from one folder."""
    path = _file(spark)
    files.write_keyed(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path, "user_id")
    return files.read_keyed(spark, path, "user_id", 8).drop("user_id")


@query("SELECT vec_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def vectors_file(spark, d):
    """Vectors written one a row and read back."""
    path = _file(spark)
    files.write_vectors(_t(spark, d, "embeddings").select("vec_id", "embedding"), path)
    total = F.aggregate(vectors.double("embedding"), F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("size"), _r(total, 4).alias("total"))


@query("SELECT doc_id, len(embedding) AS size FROM labels JOIN embeddings ON doc_id = vec_id")
def lookup_all_present(spark, d):
    """A subset asserted, then its vectors looked up, where a missing one would be an error."""
    have = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    ids = _t(spark, d, "labels").join(have, "doc_id", "left_semi").select("doc_id")
    relational.require_none(relational.missing_keys(ids, _t(spark, d, "documents"), "doc_id"), "labelled ids have no document")
    return vectors.lookup(ids, have, "doc_id", "embedding", "fail").select("doc_id", F.size("embedding").cast("long").alias("size"))
