"""Queries over reply trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.hierarchy import PRESENT, hierarchy, paths
from skein.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(table(spark, sf_dir, "twcs"))
    return h.where(F.col("state") == PRESENT).select(F.col("id").alias("tweet_id"), F.col("root").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids from the root down to each tweet; empty on and under cycles."""
    return paths(table(spark, sf_dir, "twcs")).select(F.col("id").alias("tweet_id"), "path")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tweets below a tweet are those of its root with `pre` in (pre, pre + n_below]."""
    h = hierarchy(table(spark, sf_dir, "twcs"))
    return h.select(F.col("id").alias("tweet_id"), F.col("root").alias("root_id"), "pre", F.col("below").alias("n_below"))


def p4_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every cycle; cycle_id is its smallest tweet."""
    h = hierarchy(table(spark, sf_dir, "twcs"))
    return h.where("on_cycle").select(F.col("root").alias("cycle_id"), F.col("id").alias("tweet_id"), F.col("parent").alias("parent_id"))


QUERIES = {f.__name__: f for f in (p4_found, p4_paths, p4_descendants, p4_cycles)}

#: t: a row a tweet; down: what a root reaches; lost: what leads into a circle, up: all above it; ring: the circles
TREES = """
WITH RECURSIVE t AS (
  SELECT tweet_id AS id, max(in_response_to_tweet_id) AS parent FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1
), down AS (
  SELECT id, id AS root, [id] AS path FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t)
  UNION ALL
  SELECT t.id, down.root, list_append(down.path, t.id) FROM down JOIN t ON t.parent = down.id
), lost AS (
  SELECT id, parent FROM t WHERE id NOT IN (SELECT id FROM down)
), up AS (
  SELECT id, parent AS anc FROM lost UNION SELECT up.id, lost.parent FROM up JOIN lost ON up.anc = lost.id
), ring AS (
  SELECT id FROM up WHERE id = anc
), low AS (
  SELECT up.id, min(up.anc) AS root FROM up JOIN ring ON ring.id = up.anc GROUP BY up.id
)
"""

ORACLE = {
    "p4_found": TREES + "SELECT id AS tweet_id, root AS root_id, len(path)::INT - 1 AS depth FROM down WHERE len(path) > 1 UNION ALL SELECT id, root, -1 FROM low",
    "p4_paths": TREES + "SELECT t.id AS tweet_id, coalesce(path, []) AS path FROM t LEFT JOIN down USING (id)",
    "p4_cycles": TREES + "SELECT low.root AS cycle_id, lost.id AS tweet_id, lost.parent AS parent_id FROM lost JOIN ring USING (id) JOIN low USING (id)",
    "p4_descendants": TREES + """, under AS (
  SELECT lost.id, low.root, [lost.id] AS path FROM lost JOIN low USING (id) WHERE lost.id NOT IN (SELECT id FROM ring) AND lost.parent IN (SELECT id FROM ring)
  UNION ALL
  SELECT lost.id, under.root, list_append(under.path, lost.id) FROM under JOIN lost ON lost.parent = under.id
), n AS (SELECT * FROM down UNION ALL SELECT * FROM under),
b AS (SELECT anc AS id, count(*) - 1 AS n_below FROM (SELECT unnest(path) AS anc FROM n) GROUP BY anc)
SELECT id AS tweet_id, root AS root_id, (row_number() OVER (PARTITION BY root ORDER BY path) - 1)::INT AS pre, n_below::INT AS n_below FROM n JOIN b USING (id)
UNION ALL SELECT ring.id, low.root, NULL, NULL FROM ring JOIN low USING (id)""",
}
