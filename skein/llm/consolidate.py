"""Consolidating pairwise matches into groups.

Links are contracted inside blocks of ids, then the giant component of the contracted links is
peeled off by breadth-first joins from the vertex of highest degree, anti-joined away, and the
small components that remain are labelled by minimum propagation.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import contract, min_labels
from skein.session import Scratch

MAX_FRONTIERS = 200  # beyond that what was reached becomes one vertex, and propagation finishes it


def peel(nodes: DataFrame, edges: DataFrame, scratch: Scratch, max_frontiers: int = MAX_FRONTIERS) -> tuple[DataFrame | None, DataFrame]:
    """Members (id) of the component around the highest-degree vertex, and the edges left.

    Vertices are the representatives of nodes; a vertex's degree counts the links of all that was
    contracted into it, so the vertex that holds most of the giant component is where the search
    starts; what lies in one block wholly is labelled already and comes last. Each frontier is joined to the links; what it reaches can only lie in it, in the one
    before or in the next, so the two are anti-joined away and no round reads what earlier ones reached.
    Where max_frontiers rounds do not exhaust the component, the edges left hold one vertex (the
    smallest id reached) in place of all that was reached, so no link is lost.
    """
    inner = nodes.groupBy("rep").agg(F.count("*").alias("links")).select(F.col("rep").alias("v"), "links", F.lit(0).alias("out"))
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = inner.unionAll(both.select(F.col("a").alias("v"), F.lit(1).alias("links"), F.lit(1).alias("out"))).groupBy("v").agg(F.sum("links").alias("degree"), F.max("out").alias("out"))
    top = degree.orderBy(F.desc("out"), F.desc("degree"), "v").limit(1).collect()  # one row
    if not top:
        return None, edges
    pairs = scratch.save(both, "pairs")
    frontier = scratch.save(edges.sparkSession.createDataFrame([(top[0]["v"],)], "id long"), "frontier")
    levels, before = [frontier], None
    for _ in range(max_frontiers):
        step = pairs.join(frontier, pairs.a == frontier.id, "left_semi").select(F.col("b").alias("id")).distinct().join(frontier, "id", "left_anti")
        if before is not None:
            step = step.join(before, "id", "left_anti")
        before, frontier = frontier, scratch.save(step, "frontier")
        if not frontier.limit(1).count():
            break
        levels.append(frontier)
    else:
        reached = scratch.save(functools.reduce(DataFrame.unionAll, levels), "reached")
        scratch.drop(pairs, *levels)
        low = reached.agg(F.min("id")).first()[0]
        mark = reached.select("id", F.lit(low).alias("low"))
        left = edges
        for c in ("a", "b"):
            left = left.join(mark.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("low", c)).drop("low")
        return reached, left.where("a <> b").select("a", "b").distinct()
    reached = scratch.save(functools.reduce(DataFrame.unionAll, levels), "reached")
    scratch.drop(pairs, *levels, frontier)
    return reached, edges.join(reached, edges.a == reached.id, "left_anti")


def group_labels(rows: DataFrame, scratch: Scratch | None = None, max_frontiers: int = MAX_FRONTIERS) -> DataFrame:
    """(id, group_id) of every distinct non-null id of rows (id, link, kind); see graph.contract().

    group_id is the smallest id joined to id directly or through others, and id itself where
    nothing is. Null links, repeated rows and links to ids without a row of the same kind join
    nothing; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(rows.sparkSession, "groups")
    nodes, edges = contract(rows, scratch)
    giant, rest = peel(nodes, edges, scratch, max_frontiers)
    labels = min_labels(rest, scratch).select("id", "label")
    if giant is not None:
        low = giant.agg(F.min("id")).first()[0]
        # where one vertex stands for all that was reached, it has a label and its members take it
        known = labels.where(F.col("id") == low).collect()
        inside = giant.select("id", F.lit(known[0]["label"] if known else low).alias("label"))
        labels = labels.join(giant, "id", "left_anti").unionAll(inside)
    labels = scratch.save(labels, "labels")
    return nodes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("group_id"))


def match_rows(twcs: DataFrame, golden: DataFrame) -> DataFrame:
    """Links of replies (kind 0) and of labelled rows of one thread (kind 1) in the form of contract().

    The rows of a thread are linked to its smallest id, so a thread of n rows gives n links.
    """
    g = golden.where("id is not null").select(F.col("id").cast("long").alias("id"), "thread_id")
    hub = g.where("thread_id is not null").groupBy("thread_id").agg(F.min("id").alias("link"))
    in_thread = g.join(hub, "thread_id", "left").select("id", F.when(F.col("link") != F.col("id"), F.col("link")).alias("link"), F.lit(1).alias("kind"))
    return twcs.select(F.col("tweet_id").cast("long").alias("id"), F.col("in_response_to_tweet_id").cast("long").alias("link"), F.lit(0).alias("kind")).unionAll(in_thread)


def groups(twcs: DataFrame, golden: DataFrame, max_frontiers: int = MAX_FRONTIERS) -> DataFrame:
    """(tweet_id, group_id): one row for each distinct tweet of a group of two or more."""
    scratch = Scratch(twcs.sparkSession, "groups")
    labels = scratch.save(group_labels(match_rows(twcs, golden), scratch, max_frontiers), "all")
    joined = labels.where("id <> group_id")
    heads = joined.select(F.col("group_id").alias("id"), "group_id").distinct()
    return joined.unionAll(heads).select(F.col("id").alias("tweet_id"), "group_id")
