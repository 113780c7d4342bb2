"""Queries that score predictions, drafts and annotators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import classify as C
from skein.operators import evaluation as E
from skein.operators import replay as P
from skein.plans.sampling_queries import _G, golden_once
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


def _hits(spark, sf_dir):
    """One row for each (qid, rank)."""
    return table(spark, sf_dir, "hits").groupBy("qid", "rank").agg(F.min("doc_id").alias("doc_id"), F.min("score").alias("score"), F.min("intent").alias("intent"), F.min("reply").alias("reply"))


def _votes(spark, sf_dir):
    return _hits(spark, sf_dir).where("intent is not null")


def _preds(spark, sf_dir):
    """(id, y, pred, weight): the intent that the hits of a message vote for, against its label."""
    best = E.max_label(_votes(spark, sf_dir), "qid", "intent", F.col("score"))
    return golden_once(spark, sf_dir).select("id", F.col("intent").alias("y")).join(best.withColumnRenamed("qid", "id"), "id")


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "taxonomy").select(F.col("id").alias("label"))


_H = "h AS (SELECT qid, rank, min(doc_id) AS doc_id, min(score) AS score, min(intent) AS intent, min(reply) AS reply FROM hits GROUP BY qid, rank)"
_P = f"""WITH {_H}, v AS (SELECT qid, intent, round(sum(score), 9) AS w FROM h WHERE intent IS NOT NULL GROUP BY ALL),
b AS (SELECT qid AS id, intent AS pred, w FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, intent) AS n FROM v) WHERE n = 1),
p AS (SELECT id, g.intent AS y, pred, w AS weight FROM {_G} g JOIN b USING (id))
"""
_C = _P + """, l AS (SELECT id AS label FROM taxonomy), c AS (SELECT l.label, count(*) FILTER (y = label AND pred = label) AS tp, count(*) FILTER (y <> label AND pred = label) AS fp, count(*) FILTER (y = label AND pred <> label) AS fn
  FROM l LEFT JOIN (SELECT * FROM p WHERE y IS NOT NULL AND pred IS NOT NULL) ON true GROUP BY l.label),
k AS (SELECT label, tp, fp, fn, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM c)
"""
_WLO = "round(coalesce(greatest(((tp / nullif(support, 0)::DOUBLE + 3.8416::DOUBLE / (2.0::DOUBLE * support)) - 1.96::DOUBLE * sqrt((tp / nullif(support, 0)::DOUBLE) * (1 - tp / nullif(support, 0)::DOUBLE) / support + 3.8416::DOUBLE / (4.0::DOUBLE * support * support))) / (1 + 3.8416::DOUBLE / support), 0), 0), 6)"
_WHI = _WLO.replace("greatest(", "least(").replace("- 1.96", "+ 1.96").replace("/ support), 0), 0), 6)", "/ support), 1), 0), 6)")


@query(_P + "SELECT y, pred, count(*) AS n FROM p WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY ALL")
def confusion(spark, sf_dir):
    return E.confusion(_preds(spark, sf_dir))


@query(_P + "SELECT y, pred, count(*) AS n FROM p WHERE y <> pred GROUP BY ALL ORDER BY n DESC, y, pred LIMIT 8")
def confusion_top(spark, sf_dir):
    return E.confusion(_preds(spark, sf_dir)).where("y <> pred").orderBy(F.desc("n"), "y", "pred").limit(8)


@query(_C + f"SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CASE WHEN support = 0 THEN 0 ELSE {_WLO} END AS recall_lo, CASE WHEN support = 0 THEN 0 ELSE {_WHI} END AS recall_hi FROM k")
def per_class_report(spark, sf_dir):
    return E.per_class(_preds(spark, sf_dir), _labels(spark, sf_dir))


@query(_C + "SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(round(f1, 6)), 5) AS macro_f1, round(sum(round(f1, 6) * support) / sum(support)::DOUBLE, 5) AS weighted_f1 FROM k")
def score_summary(spark, sf_dir):
    return E.summary(_preds(spark, sf_dir), _labels(spark, sf_dir))


@query(_P + """, t AS (SELECT intent AS label, count(*) AS n FROM h WHERE intent IS NOT NULL GROUP BY 1), s AS (SELECT y AS label, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY 1)
SELECT label, round((coalesce(t.n, 0) / (SELECT sum(n) FROM t)::DOUBLE) / (s.n / (SELECT sum(n) FROM s)::DOUBLE), 6) AS weight FROM s LEFT JOIN t USING (label)""")
def importance_weights(spark, sf_dir):
    """Share of each intent among all retrieved traffic over its share among labelled messages; 0 where traffic has none."""
    return _weights(spark, sf_dir)


def _weights(spark, sf_dir):
    share = lambda d, c: d.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).select("label", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
    t, s = share(_votes(spark, sf_dir), "intent"), share(_preds(spark, sf_dir), "y")
    return s.join(t.withColumnRenamed("share", "traffic"), "label", "left").select("label", F.round(F.coalesce("traffic", F.lit(0.0)) / F.col("share"), 6).alias("weight"))


@query(_P + """, t AS (SELECT intent AS label, count(*) AS n FROM h WHERE intent IS NOT NULL GROUP BY 1), s AS (SELECT y AS label, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY 1),
u AS (SELECT label, round((coalesce(t.n, 0) / (SELECT sum(n) FROM t)::DOUBLE) / (s.n / (SELECT sum(n) FROM s)::DOUBLE), 6) AS wt FROM s LEFT JOIN t USING (label)),
c AS (SELECT y, pred, count(*) * any_value(wt) AS n FROM p JOIN u ON u.label = y WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY ALL),
f AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT y AS label, CASE WHEN y = pred THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN y <> pred THEN n ELSE 0 END AS fn FROM c UNION ALL SELECT pred, 0, n, 0 FROM c WHERE y <> pred) GROUP BY label HAVING sum(tp) + sum(fn) > 0)
SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 5) AS weighted_macro_f1, count(*) AS n_classes FROM f""")
def weighted_macro_f1(spark, sf_dir):
    return E.weighted_macro_f1(_preds(spark, sf_dir), _weights(spark, sf_dir))


_KAPPA = """, c AS (SELECT a, b, count(*) AS n FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS t FROM c),
m AS (SELECT label, sum(na) AS na, sum(nb) AS nb FROM (SELECT a AS label, n AS na, 0 AS nb FROM c UNION ALL SELECT b, 0, n FROM c) GROUP BY label),
x AS (SELECT (SELECT sum(n) FROM c WHERE a = b) / t AS po, (SELECT sum(na / t * nb / t) FROM m) AS pe, (SELECT sum((na + nb) / t / 2 * (1 - (na + nb) / t / 2)) / (count(*) - 1) FROM m) AS g, t FROM t)
SELECT t::BIGINT AS n, round(po, 6) AS raw, round((po - pe) / (1 - pe), 5) AS kappa, round((po - g) / (1 - g), 5) AS ac1 FROM x"""


@query(_P + ", r AS (SELECT y AS a, pred AS b FROM p)" + _KAPPA)
def agreement(spark, sf_dir):
    return E.agreement(_preds(spark, sf_dir).select(F.col("y").alias("a"), F.col("pred").alias("b")))


_TONE = "least(2, greatest(0, length(text) // 60))"


@query(f"""WITH d AS (SELECT id, drafter, min(text) AS text FROM drafts WHERE coalesce(error, '') = '' AND text IS NOT NULL GROUP BY ALL),
r AS (SELECT a.id, {_TONE.replace('text', 'a.text')} AS a, {_TONE.replace('text', 'b.text')} AS b FROM d a JOIN d b USING (id) WHERE a.drafter = 'nearest' AND b.drafter = 'grounded_llm'),
t AS (SELECT count(*)::DOUBLE AS t FROM r), ra AS (SELECT a, count(*) AS n FROM r GROUP BY a), cb AS (SELECT b, count(*) AS n FROM r GROUP BY b)
SELECT t::BIGINT AS n, round(1 - (SELECT sum((a - b) * (a - b) / 4.0::DOUBLE) FROM r) / (SELECT sum((a - b) * (a - b) / 4.0::DOUBLE * ra.n * cb.n / t) FROM ra, cb), 6) AS weighted_kappa FROM t""")
def weighted_kappa(spark, sf_dir):
    """Length bands of two drafters as ordinal scores from 0 to 2."""
    band = lambda c: F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.length(c) / 60).cast("int")))
    return E.weighted_kappa(_paired_drafts(spark, sf_dir).select(band(F.col("a")).alias("a"), band(F.col("b")).alias("b")), 2)


def _drafts(spark, sf_dir):
    return table(spark, sf_dir, "drafts").where("coalesce(error, '') = '' and text is not null").groupBy("id", "drafter").agg(F.min("text").alias("text"))


def _paired_drafts(spark, sf_dir):
    d = _drafts(spark, sf_dir)
    return d.where("drafter = 'nearest'").select("id", F.col("text").alias("a")).join(d.where("drafter = 'grounded_llm'").select("id", F.col("text").alias("b")), "id")


_PAIR = "WITH d AS (SELECT id, drafter, min(text) AS text FROM drafts WHERE coalesce(error, '') = '' AND text IS NOT NULL GROUP BY ALL), r AS (SELECT a.id, a.text AS a, b.text AS b FROM d a JOIN d b USING (id) WHERE a.drafter = 'nearest' AND b.drafter = 'grounded_llm')"


@query(_PAIR + "SELECT count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (y AND NOT x) AS b_only, count(*) FILTER (NOT x AND NOT y) AS neither FROM (SELECT length(a) <= 90 AS x, length(b) <= 90 AS y FROM r)")
def paired_mcnemar(spark, sf_dir):
    return E.paired_counts(_paired_drafts(spark, sf_dir).select((F.length("a") <= 90).alias("a"), (F.length("b") <= 90).alias("b")))


@query(_PAIR + """, d2 AS (SELECT (length(a) - length(b))::DOUBLE AS d FROM r WHERE length(a) <> length(b)), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d2)
SELECT count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM k""")
def wilcoxon_stat(spark, sf_dir):
    return E.signed_ranks(_paired_drafts(spark, sf_dir).select(F.length("a").cast("double").alias("a"), F.length("b").cast("double").alias("b")))


@query(_P + """, s AS (SELECT y = pred AS positive, weight AS score FROM p WHERE y IS NOT NULL), k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s),
a AS (SELECT count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n0, sum(rk) FILTER (positive) AS rs FROM k)
SELECT n1, n0, round((rs - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0)::DOUBLE, 6) AS auc FROM a""")
def confidence_auc(spark, sf_dir):
    return E.auc(_scored(spark, sf_dir).select(F.col("correct").alias("positive"), F.col("confidence").alias("score")))


def _scored(spark, sf_dir):
    return _preds(spark, sf_dir).where("y is not null").select("id", (F.col("y") == F.col("pred")).alias("correct"), F.col("weight").alias("confidence"))


_RISK = _P + """, s AS (SELECT y = pred AS correct, weight AS confidence FROM p WHERE y IS NOT NULL), c AS (SELECT confidence, count(*) AS k, count(*) FILTER (NOT correct) AS w FROM s GROUP BY 1),
rc AS (SELECT confidence, (sum(k) OVER o)::BIGINT AS n, sum(k) OVER o / (sum(k) OVER ())::DOUBLE AS coverage, sum(w) OVER o / (sum(k) OVER o)::DOUBLE AS risk FROM c WINDOW o AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING))
"""


@query(_RISK + "SELECT confidence, n, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM rc")
def risk_coverage(spark, sf_dir):
    r = E.risk_coverage(_scored(spark, sf_dir))
    return r.select("confidence", "n", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query(_RISK + ", l AS (SELECT coverage, risk, lag(coverage) OVER (ORDER BY coverage) AS c0, lag(risk) OVER (ORDER BY coverage) AS r0 FROM rc) SELECT round(sum((coverage - c0) * (risk + r0) / 2), 6) AS aurc, count(*) AS n_points FROM l")
def aurc(spark, sf_dir):
    return E.aurc(_scored(spark, sf_dir))


_T = [0.0, 0.5, 1.0, 1.5, 2.0]


@query(_P + f""", s AS (SELECT y = pred AS correct, weight AS confidence FROM p WHERE y IS NOT NULL), t AS (SELECT unnest({_T})::DOUBLE AS threshold), g AS (SELECT threshold, count(*) AS n, count(*) FILTER (confidence >= threshold) AS n_auto,
 count(*) FILTER (confidence >= threshold AND NOT correct) AS auto_wrong, count(*) FILTER (confidence < threshold AND NOT correct) AS errors_caught, count(*) FILTER (confidence < threshold AND correct) AS wasted FROM s, t GROUP BY threshold)
SELECT *, round(n_auto / n::DOUBLE, 6) AS coverage, round(auto_wrong / nullif(n_auto, 0)::DOUBLE, 6) AS error_on_auto FROM g""")
def threshold_sweep(spark, sf_dir):
    return E.sweep(_scored(spark, sf_dir), _T)


_POST = _P + ", q AS (SELECT qid, intent, w / sum(w) OVER (PARTITION BY qid) AS p FROM v), z AS (SELECT qid AS id, list(p ORDER BY p DESC) AS ps FROM q GROUP BY qid)"


@query(_POST + "SELECT id, round(ps[1], 6) AS max_prob, round(CASE WHEN len(ps) < 2 THEN 1.0 ELSE ps[1] - ps[2] END, 6) AS margin, round(-list_sum(list_transform(ps, lambda x: x * ln(x))), 6) + 0.0 AS entropy, round(CASE WHEN len(ps) < 2 THEN 1.0 ELSE 1 + list_sum(list_transform(ps, lambda x: x * ln(x))) / ln(len(ps)) END, 6) AS confidence_entropy FROM z")
def posterior_signals(spark, sf_dir):
    v = _votes(spark, sf_dir).groupBy("qid", "intent").agg(F.round(F.sum("score"), 9).alias("w"))
    s = C.signals(v.select(F.col("qid").alias("id"), "intent", (F.col("w") / F.sum("w").over(Window.partitionBy("qid"))).alias("p")))
    return s.withColumn("entropy", F.col("entropy") + 0.0)


@query()
def bootstrap_accuracy(spark, sf_dir):
    return E.bootstrap(_preds(spark, sf_dir), E.table_accuracy, 2000)


@query()
def bootstrap_macro_f1(spark, sf_dir):
    return E.bootstrap(_preds(spark, sf_dir), E.table_macro_f1, 2000)


@query()
def kappa_interval(spark, sf_dir):
    """Of labels against votes, rows resampled."""
    return E.bootstrap(_preds(spark, sf_dir), E.table_kappa, 2000)


@query()
def kappa_cluster_interval(spark, sf_dir):
    """The same with whole threads resampled."""
    g = golden_once(spark, sf_dir).select("id", "thread_id")
    return E.clustered_kappa(_preds(spark, sf_dir).join(g, "id").select(F.col("y").alias("a"), F.col("pred").alias("b"), F.coalesce(F.col("thread_id"), -F.col("id")).alias("cluster")))


@query("""SELECT drafter, CASE WHEN coalesce(error, '') <> '' THEN 'error' WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN regexp_matches(regexp_replace(text, '^\\s*(?:<user>\\s*)+', ''), '<(?:user|url|email|flight|ref|phone|num)>') THEN 'placeholder' ELSE 'valid' END AS validity, count(*) AS n,
 count(*) FILTER (length(text) > 280) AS too_long FROM drafts GROUP BY ALL""")
def completion_validity(spark, sf_dir):
    d = table(spark, sf_dir, "drafts")
    return d.groupBy("drafter", P.validity(F.col("text"), F.col("error")).alias("validity")).agg(F.count("*").alias("n"), F.count_if(F.length("text") > 280).alias("too_long"))


@query("""WITH k AS (SELECT DISTINCT qid, doc_id FROM hits), c AS (SELECT customer_tweet_id AS doc_id, min(brand_clean) AS response FROM exchanges GROUP BY 1)
SELECT count(*) AS requests, count(c.doc_id) AS found, count(*) - count(c.doc_id) AS missed FROM k LEFT JOIN c USING (doc_id)""")
def cache_hits_misses(spark, sf_dir):
    cache = table(spark, sf_dir, "exchanges").groupBy(F.col("customer_tweet_id").alias("doc_id")).agg(F.min("brand_clean").alias("response"))
    r = P.lookup(table(spark, sf_dir, "hits").select("qid", "doc_id").distinct(), cache, "doc_id")
    return r.agg(F.count("*").alias("requests"), F.count_if("cached").alias("found"), F.count_if(~F.col("cached")).alias("missed"))


@query(f"""WITH {_H}, e AS (SELECT qid, doc_id, reply, rank FROM h WHERE reply IS NOT NULL AND trim(reply) <> '')
SELECT qid, list(doc_id ORDER BY rank)[1:4] AS grounded_in, array_to_string(list(concat(rank, '. ', reply) ORDER BY rank)[1:4], chr(10)) AS evidence FROM e GROUP BY qid""")
def draft_evidence(spark, sf_dir):
    """Up to four replies that ground a draft, numbered by rank."""
    e = _hits(spark, sf_dir).where("reply is not null and trim(reply) <> ''").groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "reply"))), 1, 4).alias("e"))
    return e.select("qid", F.col("e.doc_id").alias("grounded_in"), F.array_join(F.transform("e", lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["reply"])), "\n").alias("evidence"))


@query(f"""WITH {_H} SELECT g.id, coalesce(nullif(trim(h.reply), ''), 'canned') AS draft, h.doc_id AS grounded_in, CASE WHEN nullif(trim(h.reply), '') IS NULL THEN 'no retrieval hit' ELSE '' END AS error FROM {_G} g LEFT JOIN h ON h.qid = g.id AND h.rank = 1""")
def nearest_draft(spark, sf_dir):
    h = _hits(spark, sf_dir).where("rank = 1").select(F.col("qid").alias("id"), "doc_id", F.nullif(F.trim("reply"), F.lit("")).alias("reply"))
    return golden_once(spark, sf_dir).select("id").join(h, "id", "left").select("id", F.coalesce("reply", F.lit("canned")).alias("draft"), F.col("doc_id").alias("grounded_in"), F.when(F.col("reply").isNull(), "no retrieval hit").otherwise("").alias("error"))


@query("""WITH a AS (SELECT id, labelled_by, min(intent) AS label FROM golden WHERE intent IS NOT NULL GROUP BY ALL), t AS (SELECT id, count(DISTINCT label) AS n, count(*) AS k FROM a GROUP BY id)
SELECT k, count(*) AS items, count(*) FILTER (n = 1) AS unanimous FROM t GROUP BY k""")
def unanimity(spark, sf_dir):
    a = table(spark, sf_dir, "golden").where("intent is not null").groupBy("id", "labelled_by").agg(F.min("intent").alias("label"))
    t = a.groupBy("id").agg(F.countDistinct("label").alias("n"), F.count("*").alias("k"))
    return t.groupBy("k").agg(F.count("*").alias("items"), F.count_if(F.col("n") == 1).alias("unanimous"))


@query("""WITH a AS (SELECT drafter || '/' || coalesce(intent, '-') AS path, round(avg(length(text)), 3)::VARCHAR AS value FROM drafts WHERE id % 2 = 0 GROUP BY 1), b AS (SELECT drafter || '/' || coalesce(intent, '-') AS path, round(avg(length(text)), 3)::VARCHAR AS value FROM drafts WHERE id % 2 = 1 GROUP BY 1)
SELECT path FROM a FULL JOIN b USING (path) WHERE NOT coalesce(abs(try_cast(a.value AS DOUBLE) - try_cast(b.value AS DOUBLE)) <= 1.0, false) AND a.value IS DISTINCT FROM b.value""")
def results_diff(spark, sf_dir):
    """Mean draft lengths of two result sets that differ by more than one character."""
    d = table(spark, sf_dir, "drafts")
    flat = lambda r: d.where(F.col("id") % 2 == r).groupBy(F.concat("drafter", F.lit("/"), F.coalesce("intent", F.lit("-"))).alias("path")).agg(F.round(F.avg(F.length("text")), 3).cast("string").alias("value"))
    return E.flat_diff(flat(0), flat(1), 1.0).select("path")


_GRID = [round(0.1 * i, 1) for i in range(51)]


@query(_P + f""", s AS (SELECT id, y = pred AS correct, weight AS confidence FROM p WHERE y IS NOT NULL), t AS (SELECT unnest({_GRID})::DOUBLE AS threshold),
g AS (SELECT threshold, id % 2 = 0 AS dev, count(*) AS n, count(*) FILTER (confidence >= threshold) AS n_auto, count(*) FILTER (confidence >= threshold AND NOT correct) AS auto_wrong FROM s, t GROUP BY ALL),
bs AS (SELECT count(*) FILTER (NOT correct) / count(*)::DOUBLE AS base FROM s WHERE id % 2 = 0),
ch AS (SELECT threshold, n_auto AS dev_auto FROM g, bs WHERE dev AND n_auto > 0 AND auto_wrong / n_auto::DOUBLE <= base * 0.9::DOUBLE ORDER BY n_auto DESC, threshold LIMIT 1)
SELECT threshold, dev_auto, n, n_auto, auto_wrong FROM ch JOIN g USING (threshold) WHERE NOT dev""")
def heldout_threshold(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return E.held_out_threshold(s.where("id % 2 = 0"), s.where("id % 2 = 1"), _GRID, 0.9)


@query("""WITH x AS (SELECT qid AS id, rank AS annotator, min(intent) AS label FROM hits WHERE intent IS NOT NULL GROUP BY ALL)
SELECT a.annotator AS a, b.annotator AS b, count(*) AS n, count(*) FILTER (a.label = b.label) AS same, round(count(*) FILTER (a.label = b.label) / count(*)::DOUBLE, 6) AS raw FROM x a JOIN x b ON a.id = b.id AND a.annotator < b.annotator GROUP BY ALL HAVING count(*) >= 20""")
def annotator_pairs(spark, sf_dir):
    """How often two ranks of the hits name the same intent."""
    return E.annotator_pairs(table(spark, sf_dir, "hits").select(F.col("qid").alias("id"), F.col("rank").alias("annotator"), F.col("intent").alias("label")))


_ARM = """WITH d AS (SELECT drafter AS label, count(*) AS support, count(*) FILTER (coalesce(error, '') = '' AND length(text) BETWEEN 1 AND 280) AS tp FROM drafts GROUP BY 1)
"""


@query(_ARM + f"SELECT label AS drafter, support AS n, tp AS good, round(tp / support::DOUBLE, 6) AS rate, {_WLO} AS lo, {_WHI} AS hi FROM d")
def draft_arms(spark, sf_dir):
    return E.arm_summary(table(spark, sf_dir, "drafts"), F.coalesce((F.coalesce("error", F.lit("")) == "") & F.length("text").between(1, 280), F.lit(False)))
