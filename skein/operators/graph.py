"""Connected components and forests over id links.

Every operator here first contracts the links inside blocks of neighbouring ids (the map-side
combine of a union-find) and then works on the few links that leave a block. Ids that lie near
each other tend to be linked, so the rounds of joins run over a small graph; where ids carry no
such order the result is the same and the rounds simply carry more rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import Scratch

BLOCK_SCHEMA = "id long, rep long, link long, kind int, out boolean, seen int, n int"


def block_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links a[i]-b[i]; hooking and shortcutting."""
    p = np.arange(n)
    while len(a):
        pa_, pb = p[a], p[b]
        live = pa_ != pb
        if not live.any():
            break
        a, b, pa_, pb = a[live], b[live], pa_[live], pb[live]
        low, high = np.minimum(pa_, pb), np.maximum(pa_, pb)
        np.minimum.at(p, high, low)
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
    return p


def _contract(batches):
    ids, links, kinds = [], [], []
    for b in batches:
        ids.append(b.column("id").to_numpy(zero_copy_only=False))
        link = b.column("link")
        kind = b.column("kind").to_numpy(zero_copy_only=False)
        has = ~link.is_null().to_numpy(zero_copy_only=False)
        links.append(link.fill_null(0).to_numpy(zero_copy_only=False))
        kinds.append(np.where(has, kind, kind + 100))
    if not ids or not sum(map(len, ids)):
        return
    ids, links, kinds = np.concatenate(ids), np.concatenate(links), np.concatenate(kinds)
    nodes, at = np.unique(ids, return_inverse=True)
    has = kinds < 100
    kind = kinds % 100
    seen = np.zeros(len(nodes), np.int32)  # bit k: the node has a row of kind k
    np.bitwise_or.at(seen, at, (1 << kind).astype(np.int32))
    count = np.bincount(at[kind == 0], minlength=len(nodes)).astype(np.int32)
    to = np.searchsorted(nodes, links)
    to[to == len(nodes)] = 0
    here = has & (nodes[to] == links)
    both = here & ((seen[to] >> kind) & 1).astype(bool)
    p = block_labels(len(nodes), at[both], to[both])
    rep = nodes[p]
    # one row for each node; its link, where it has one, of any row
    link = np.zeros(len(nodes), np.int64)
    lk = np.zeros(len(nodes), bool)
    link[at[has]], lk[at[has]] = links[has], True
    out = np.flatnonzero(has & ~here)
    n = len(nodes)

    def batch(i, r, v, none, k, o, s, c):
        return pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(r), pa.array(v, mask=none), pa.array(k), pa.array(o), pa.array(s), pa.array(c)],
            names=["id", "rep", "link", "kind", "out", "seen", "n"],
        )

    for lo in range(0, n, 200_000):
        s = slice(lo, lo + 200_000)
        m = len(nodes[s])
        yield batch(nodes[s], rep[s], link[s], ~lk[s], np.zeros(m, np.int32), np.zeros(m, bool), seen[s], count[s])
    if len(out):
        pair = np.unique(np.stack([rep[at[out]], links[out], kind[out].astype(np.int64)]), axis=1)
        m = pair.shape[1]
        yield batch(pair[0], pair[0], pair[1], np.zeros(m, bool), pair[2].astype(np.int32), np.ones(m, bool), np.zeros(m, np.int32), np.zeros(m, np.int32))


def contract(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Contract rows (id, link, kind) by blocks of ids.

    A row says that id is a node of that kind and, where link is not null, that it is linked to
    the node link; the link counts only if link has a row of the same kind. Rows with a null id
    are ignored; repeated rows change nothing.

    Returns nodes (id, rep, link, n), one row for each distinct id with its count of rows of kind 0, and edges (a, b) between the
    representatives of blocks. Two ids are joined if their representatives are.
    """
    ready = rows.where("id is not null").repartitionByRange("id")
    both = scratch.save(ready.mapInArrow(_contract, BLOCK_SCHEMA), "blocks")
    nodes = both.where("not out").select("id", "rep", "link", "seen", "n")
    leaving = both.where("out").select(F.col("rep").alias("from"), "link", "kind")
    edges = (
        leaving.join(nodes.select(F.col("id").alias("link"), F.col("rep").alias("to"), "seen"), "link")
        .where("(shiftright(seen, kind) & 1) = 1 and from <> to")
        .select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b"))
        .distinct()
    )
    return nodes.select("id", "rep", "link", "n"), scratch.save(edges, "edges")


def min_labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of every id in edges (a, b); label is the smallest id of the component.

    Minimum propagation with shortcuts: each round a node takes the smallest label among itself
    and its neighbours, hooks its old label to it, and then jumps to its label's label. A round
    pre-aggregates before the shuffle, so a hub costs one row for each task.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    pairs = scratch.save(both.distinct(), "pairs")
    labels = scratch.save(pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        # the smallest label next to each node, offered to the node and to its present label
        offer = pairs.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("m"))
        near = labels.join(offer, "id").select("id", "label", F.least("label", "m").alias("m"))
        hook = near.select("id", "m").unionAll(near.select(F.col("label").alias("id"), "m")).groupBy("id").agg(F.min("m").alias("l1"))
        jump = hook.select(F.col("id").alias("l1"), F.col("l1").alias("l2"))
        new = hook.join(jump, "l1", "left").select("id", F.least("l1", F.coalesce("l2", "l1")).alias("label"))
        old, labels = labels, scratch.save(new, "labels")
        changed = labels.join(old.withColumnRenamed("label", "was"), "id").where("label <> was").limit(1).count()
        scratch.drop(old)
        if not changed:
            scratch.drop(pairs)
            return labels


def components(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, link, n, component) for each distinct id of rows (id, link, kind); see contract().

    component is the smallest id joined to id. Isolated ids are their own component. An empty
    input gives an empty result.
    """
    nodes, edges = contract(rows, scratch)
    labels = min_labels(edges, scratch)
    return nodes.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", "link", "n", F.coalesce("label", "rep").alias("component"))
