"""Queries over rankings, vectors and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import classify as C
from skein.operators import retrieval as R
from skein.plans.sampling_queries import _G, _key, golden_once
from skein.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _corpus(spark, sf_dir):
    """Distinct cleaned replies with the smallest customer tweet that got them."""
    e = table(spark, sf_dir, "exchanges").where("brand_clean is not null and customer_tweet_id is not null")
    return e.groupBy(F.col("brand_clean").alias("text")).agg(F.min("customer_tweet_id").alias("doc_id"))


def _questions(spark, sf_dir):
    """Every labelled message whose id divides by 20."""
    return golden_once(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("text").alias("query"))


_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_BASE = f"""
d AS (SELECT min(customer_tweet_id) AS doc_id, brand_clean AS text FROM exchanges WHERE brand_clean IS NOT NULL AND customer_tweet_id IS NOT NULL GROUP BY brand_clean),
q AS (SELECT id AS qid, text AS query FROM {_G} WHERE id % 20 = 0),
dw AS (SELECT doc_id, {_TOK.format('text')} AS w FROM d),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dw) GROUP BY doc_id, term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_TOK.format('query')}) AS term FROM q WHERE query IS NOT NULL) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS al FROM dw)
"""
_BM25 = "WITH " + _BASE + """, df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
s AS (SELECT qid, doc_id, round(sum(qtf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al)) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)))), 6) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term), n GROUP BY qid, doc_id),
bm AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM s)
"""
_TFIDF = """, p2 AS (SELECT * FROM post WHERE length(term) > 1), idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM p2, n GROUP BY term),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM p2 JOIN idf USING (term)), nd AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
qw AS (SELECT qid, term, (1 + ln(qtf)) * idf AS qw FROM qt JOIN idf USING (term)), nq AS (SELECT qid, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY 1),
ts AS (SELECT qid, doc_id, round(sum(qw * w) / (any_value(norm) * any_value(qnorm)), 6) AS score FROM qw JOIN w USING (term) JOIN nd USING (doc_id) JOIN nq USING (qid) GROUP BY qid, doc_id),
tf AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM ts)
"""


@query("WITH " + _BASE + "SELECT term, count(*) AS df FROM post GROUP BY term")
def bm25_terms(spark, sf_dir):
    return R.term_stats(R.postings(_corpus(spark, sf_dir), "doc_id", "text"))


@query(_BM25 + "SELECT * FROM bm WHERE rank <= 5")
def bm25_top5(spark, sf_dir):
    return R.bm25(_corpus(spark, sf_dir), _questions(spark, sf_dir), 5).select("qid", "doc_id", "score", "rank")


@query(_BM25 + _TFIDF + "SELECT * FROM tf WHERE rank <= 5")
def tfidf_top5(spark, sf_dir):
    return R.tfidf(_corpus(spark, sf_dir), _questions(spark, sf_dir), 5).select("qid", "doc_id", "score", "rank")


@query(_BM25 + _TFIDF + """, u AS (SELECT qid, doc_id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT qid, doc_id, rank FROM tf WHERE rank <= 50),
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM f) WHERE rank <= 5""")
def rrf_top5(spark, sf_dir):
    index, q = R.indexed(_corpus(spark, sf_dir)), _questions(spark, sf_dir)
    return R.fuse([R.bm25(index, q, 50), R.tfidf(index, q, 50)], 5).select("qid", "doc_id", "score", "rank")


_DENSE = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.v, d.v), 6) + 0.0 AS score, q.label AS ql, d.label AS dl FROM e q JOIN e d ON q.vec_id <> d.vec_id {0}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM s)
"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def _dense(spark, sf_dir, queries, k):
    v = _vectors(spark, sf_dir)
    return R.dense(v.select(F.col("vec_id").alias("doc_id"), "vector"), queries.select(F.col("vec_id").alias("qid"), "vector"), k)


@query(_DENSE.format("WHERE q.vec_id % 20 = 0") + "SELECT qid, doc_id, score, rank FROM r WHERE rank <= 4")
def dense_top4(spark, sf_dir):
    return _dense(spark, sf_dir, _vectors(spark, sf_dir).where("vec_id % 20 = 0"), 4).select("qid", "doc_id", "score", "rank")


@query(_DENSE.format("") + """, f AS (SELECT qid, min(CASE WHEN ql = dl THEN rank END) AS first, count(*) FILTER (ql = dl AND rank <= 1) AS n1, count(*) FILTER (ql = dl AND rank <= 3) AS n3, count(*) FILTER (ql = dl AND rank <= 5) AS n5 FROM r WHERE rank <= 5 GROUP BY qid)
SELECT round(sum(n1) / count(*)::DOUBLE, 6) AS p_at_1, round(sum(n3) / (3.0::DOUBLE * count(*)), 6) AS p_at_3, round(sum(n5) / (5.0::DOUBLE * count(*)), 6) AS p_at_5, round(sum(coalesce(1.0::DOUBLE / first, 0)) / count(*), 6) AS mrr, count(*)::INT AS n FROM f""")
def dense_quality(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    r = _dense(spark, sf_dir, v, 5)
    lab = v.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"))
    both = r.join(lab, "qid").join(lab.toDF("doc_id", "dl"), "doc_id")
    return R.quality(both, F.col("ql") == F.col("dl"), v.count())


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.round(F.sqrt(R.dot(F.col("vector"), F.col("vector"))), 4).alias("norm"))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), c AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM c GROUP BY label)
SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / (any_value(na.norm) * any_value(nb.norm)), 5) AS cosine FROM c a JOIN c b USING (pos) JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label WHERE a.label < b.label GROUP BY a.label, b.label""")
def centroid_cosine(spark, sf_dir):
    c = R.centroids(_vectors(spark, sf_dir), "label", "vector")
    n = c.groupBy("label").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    a, b = c.toDF("a", "pos", "ma"), c.toDF("b", "pos", "mb")
    pairs = a.join(b, "pos").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("dot"))  # a row a class and position
    return pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 5).alias("cosine"))


@query(f"SELECT id, (SELECT intent FROM {_G} WHERE intent IS NOT NULL GROUP BY intent ORDER BY count(*) DESC, intent LIMIT 1) AS pred FROM {_G}")
def majority_baseline(spark, sf_dir):
    g = golden_once(spark, sf_dir)
    return g.select("id", F.lit(C.majority(g, "intent")).alias("pred"))


def _labelled(spark, sf_dir):
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "vector", F.col("label").cast("string").alias("y"))


@query(f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::VARCHAR AS y FROM embeddings), f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY {_key('folds', '0', 'id')}, id) - 1) % 5 AS fold FROM e),
l AS (SELECT y, fold, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM f), h AS (SELECT unnest(range(5)) AS held),
c AS (SELECT held, y AS label, pos, avg(x) AS m FROM l JOIN h ON fold <> held GROUP BY ALL), cv AS (SELECT held, label, list(m ORDER BY pos) AS c FROM c GROUP BY ALL),
s AS (SELECT id, y, label, round(list_dot_product(v, c), 6) AS score FROM f JOIN cv ON fold = held)
SELECT id, y, pred FROM (SELECT id, y, label AS pred, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS n FROM s) WHERE n = 1""")
def nearest_centroid_oof(spark, sf_dir):
    return C.nearest_centroid_oof(_labelled(spark, sf_dir)).select("id", "y", "pred")


@query(_DENSE.format("") + """, v AS (SELECT qid, ql, dl::VARCHAR AS pred, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL)
SELECT qid AS id, ql::VARCHAR AS y, pred FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, pred) AS k FROM v) WHERE k = 1""")
def knn5(spark, sf_dir):
    return C.knn(_labelled(spark, sf_dir), 5)


@query()
def logistic_oof(spark, sf_dir):
    return C.logistic_oof(_labelled(spark, sf_dir))


@query()
def kmeans_sweep(spark, sf_dir):
    return C.kmeans_sweep(_labelled(spark, sf_dir), [6, 8, 10, 12, 15, 20, 25, 30])


@query("""SELECT reply, count(*) AS n, min(doc_id) AS first_doc FROM hits WHERE reply IS NOT NULL AND reply <> '' GROUP BY reply HAVING count(*) > 1""")
def duplicate_replies(spark, sf_dir):
    return table(spark, sf_dir, "hits").where("reply is not null and reply <> ''").groupBy("reply").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""WITH h AS (SELECT DISTINCT qid, rank, doc_id FROM hits WHERE rank = 1), e AS (SELECT customer_tweet_id AS doc_id, min(thread_id) AS dt FROM exchanges GROUP BY 1), g AS (SELECT id AS qid, min(thread_id) AS gt FROM golden GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (dt = gt) AS leaked FROM h LEFT JOIN e USING (doc_id) LEFT JOIN g USING (qid)""")
def thread_leak_rate(spark, sf_dir):
    h = table(spark, sf_dir, "hits").where("rank = 1").select("qid", "rank", "doc_id").distinct()
    e = table(spark, sf_dir, "exchanges").groupBy(F.col("customer_tweet_id").alias("doc_id")).agg(F.min("thread_id").alias("dt"))
    g = table(spark, sf_dir, "golden").groupBy(F.col("id").alias("qid")).agg(F.min("thread_id").alias("gt"))
    return h.join(e, "doc_id", "left").join(g, "qid", "left").agg(F.count("*").alias("n"), F.count_if(F.col("dt") == F.col("gt")).alias("leaked"))
