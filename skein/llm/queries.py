"""Queries of the training-data operators; core code never imports this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import consolidate, conversations, encoding, garbled, languages, leakage, private, residue, splits
from skein.sources.tables import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.records(table(spark, sf_dir, "twcs"), table(spark, sf_dir, "golden"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.found(_records(spark, sf_dir))


def p1_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with typed placeholders, and with surrogates, in place of personal information."""
    return private.replaced(_records(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.groups(table(spark, sf_dir, "twcs"), table(spark, sf_dir, "golden"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.records(table(spark, sf_dir, "drafts"), table(spark, sf_dir, "hits"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(_replies(spark, sf_dir))


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each draft and reply is residue, with the slot or phrase that shows it."""
    return residue.scored(_replies(spark, sf_dir))


def p6_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the model fares on hosts it has not seen, against their weak labels."""
    return residue.validation(_replies(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(spark, f"{sf_dir}/twcs.parquet")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled text as restored; lossless is false where something stays lost."""
    return garbled.garbled(table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = languages.exchange_texts(table(spark, sf_dir, "exchanges"))
    return languages.mislabelled(texts).withColumnRenamed("id", "tweet_id")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of each customer text with its language and confidence."""
    texts = languages.exchange_texts(table(spark, sf_dir, "exchanges"))
    return languages.segments(texts).withColumnRenamed("id", "tweet_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(table(spark, sf_dir, "golden"))[1].select("thread_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for each golden row, in the given shares, whole threads only."""
    return splits.assign(table(spark, sf_dir, "golden"))[0]


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits where the rows of even ids come first, and the others meet the table of those."""
    golden = table(spark, sf_dir, "golden")
    return splits.in_batches(golden, F.col("id") % 2 == 0)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {f.__name__: f for f in (p1_found, p1_replaced, p2_found, p3_found, p3_segments, p5_found, p5_splits, p5_batches, p6_found, p6_scores, p6_validation, p7_found, p8_ids, p9_found, p10_found, p10_restored)}
#: t: a row a tweet; down: what a root reaches; low: what leads into a circle, by its smallest tweet
_TREES = """
WITH RECURSIVE t AS (
  SELECT tweet_id AS id, max(in_response_to_tweet_id) AS parent FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1
), down AS (
  SELECT id, id AS root, parent IS NOT NULL AS broken FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t)
  UNION ALL
  SELECT t.id, down.root, down.broken FROM down JOIN t ON t.parent = down.id
), lost AS (
  SELECT id, parent FROM t WHERE id NOT IN (SELECT id FROM down)
), up AS (
  SELECT id, parent AS anc FROM lost UNION SELECT up.id, lost.parent FROM up JOIN lost ON up.anc = lost.id
), low AS (
  SELECT up.id, min(up.anc) AS root FROM up WHERE up.anc IN (SELECT id FROM up WHERE id = anc) GROUP BY up.id
), tree AS (SELECT id, root FROM down UNION ALL SELECT id, root FROM low)
"""
_BLANK = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200D}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{2060}\\x{3000}\\x{FEFF}]+"

ORACLE: dict[str, str] = {
    "p2_found": _TREES + """, g AS (SELECT DISTINCT id, thread_id FROM golden WHERE id IS NOT NULL),
v AS (SELECT id, root FROM tree UNION ALL SELECT DISTINCT id, id FROM g WHERE id NOT IN (SELECT id FROM tree)),
hub AS (SELECT thread_id, min(root) AS hub FROM g JOIN v USING (id) WHERE thread_id IS NOT NULL GROUP BY thread_id),
e AS (SELECT DISTINCT v.root AS a, hub AS b FROM g JOIN v USING (id) JOIN hub USING (thread_id) WHERE v.root <> hub),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT a AS x, a AS y FROM e2 UNION SELECT c.x, e2.b FROM c JOIN e2 ON c.y = e2.a),
m AS (SELECT x, min(y) AS k FROM c GROUP BY x),
l AS (SELECT v.id, coalesce(m.k, v.root) AS k FROM v LEFT JOIN m ON m.x = v.root)
SELECT id AS tweet_id, group_id FROM (SELECT id, min(id) OVER (PARTITION BY k) AS group_id, count(*) OVER (PARTITION BY k) AS n FROM l) WHERE n > 1""",
    "p5_found": """
SELECT thread_id FROM (
  SELECT thread_id, CASE WHEN s IN ('val', 'valid', 'validation', 'dev') THEN 'dev' WHEN s IN ('train', 'test') THEN s END AS split
  FROM (SELECT thread_id, lower(regexp_replace(split, '\\s', '', 'g')) AS s FROM golden WHERE id IS NOT NULL)
) WHERE thread_id IS NOT NULL GROUP BY thread_id HAVING count(DISTINCT split) > 1
""",
    "p7_found": _TREES + f""", r AS (SELECT tweet_id AS id, CASE WHEN regexp_matches(trim(created_at), '^[A-Za-z]{{3}} [A-Za-z]{{3}} [0-9]{{2}} ') THEN epoch(try_strptime(trim(created_at), '%a %b %d %H:%M:%S %z %Y'))::BIGINT
             WHEN regexp_matches(trim(created_at), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]') THEN epoch(try_cast(replace(trim(created_at), 'Z', '+00:00') AS TIMESTAMPTZ))::BIGINT END AS sec,
  coalesce(length(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(?:https?://|www\\.)\\S+', '', 'g'), '@\\w+', '', 'g'), '{_BLANK}', '', 'g')) > 0, false) AS content, coalesce(regexp_full_match(author_id, '[0-9]+'), false) AS customer
  FROM twcs WHERE tweet_id IS NOT NULL), o AS (SELECT id, max(sec) AS sec, bool_or(content) AS content, bool_or(customer) AS customer FROM r GROUP BY id),
k AS (SELECT o.*, d.root, d.broken FROM o JOIN down d USING (id)),
fine AS (SELECT root FROM k GROUP BY root HAVING NOT bool_or(broken) AND count(*) = count(sec) AND bool_or(content AND customer) AND bool_or(content AND NOT customer))
SELECT root AS conversation_id, (row_number() OVER (PARTITION BY root ORDER BY sec, id))::INT AS turn, id AS tweet_id, CASE WHEN customer THEN 'customer' ELSE 'brand' END AS role FROM k JOIN fine USING (root) WHERE content""",
}
