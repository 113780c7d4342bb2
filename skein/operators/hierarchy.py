"""Parent-child rows to full hierarchies.

Components are found first, each component is then brought to one task, and an iterative
depth-first traversal with node colouring walks it. Components above `co_locate_rows` rows never
go to one task: they are resolved by pointer doubling, which gives the same columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import components
from skein.session import Scratch

CO_LOCATE_ROWS = 2_000_000  # a task holds about 100 bytes a row of its components
COLUMNS = "id long, parent long, component long, root long, depth int, pre int, below int, state int, on_cycle boolean, root_state int, tree_rows long"
#: of a row: its parent stands in the table, is named but absent, or is not named
PRESENT, ABSENT, NONE = 1, 2, 0
WHITE, GREY, BLACK = 0, 1, 2


def walk(ids: np.ndarray, up: np.ndarray) -> tuple[list, list, list, list, list, list]:
    """Depth-first traversal of one sorted block of ids; up[i] is the index of i's parent, or -1.

    Returns root index, depth, pre-order position within the tree, number of descendants, cycle
    flag, and the traversal order. A node on a cycle, or below one, has depth -1 and its root is the
    smallest index on the cycle. The trees that hang off a cycle are numbered one after the other,
    by their tops; only the nodes of the cycle itself have no position.
    """
    n = len(ids)
    order = np.argsort(up, kind="stable")
    first = np.searchsorted(up[order], np.arange(n + 1)).tolist()
    kids, upl = order.tolist(), up.tolist()
    root, depth, pre, below, ring = [-1] * n, [-1] * n, [-1] * n, [0] * n, [False] * n
    colour, done = bytearray(n), []

    def descend(start: int, flat: bool, at: int = 0) -> int:
        stack = [start]
        while stack:
            i = stack.pop()
            if i < 0:  # all below ~i are done
                i = ~i
                colour[i] = BLACK
                below[i] = at - pre[i] - 1
                continue
            if colour[i] != WHITE and i != start:
                continue
            colour[i] = GREY
            root[i] = root[start]
            pre[i] = at
            at += 1
            stack.append(~i)
            if not flat:
                depth[i] = depth[upl[i]] + 1 if i != start else 0
                done.append(i)
            lo, hi = first[i], first[i + 1]
            if hi > lo:
                stack.extend([k for k in kids[lo:hi][::-1] if colour[k] == WHITE])
        return at

    for s in np.flatnonzero(up < 0).tolist():
        root[s] = s
        descend(s, False)
    for s in range(n):  # what no root reaches leads into a cycle
        if colour[s] != WHITE:
            continue
        trail, i = [], s
        while colour[i] == WHITE:
            colour[i] = GREY
            trail.append(i)
            i = upl[i]
        cycle = trail[trail.index(i) :]  # the link trail[-1] -> i is a back edge and closes a cycle; all below earlier ones is black
        low, at = min(cycle), 0
        for k in trail:
            colour[k] = WHITE
        for k in cycle:
            root[k], ring[k], colour[k] = low, True, BLACK
        for k in sorted(c for k in cycle for c in kids[first[k] : first[k + 1]] if colour[c] == WHITE):
            root[k] = low
            at = descend(k, True, at)
    return root, depth, pre, below, ring, done


def _index(batches):
    ids, links, comps, rows = [], [], [], []
    for b in batches:
        rows.append(b.column("n").to_numpy(zero_copy_only=False))
        ids.append(b.column("id").to_numpy(zero_copy_only=False))
        links.append(b.column("link"))
        comps.append(b.column("component").to_numpy(zero_copy_only=False))
    if not ids or not sum(map(len, ids)):
        return None
    none = np.concatenate([x.is_null().to_numpy(zero_copy_only=False) for x in links])
    link = np.concatenate([x.fill_null(0).to_numpy(zero_copy_only=False) for x in links])
    ids, comps, rows = np.concatenate(ids), np.concatenate(comps), np.concatenate(rows)
    o = np.argsort(ids, kind="stable")
    ids, link, none, comps, rows = ids[o], link[o], none[o], comps[o], rows[o]
    to = np.searchsorted(ids, link)
    to[to == len(ids)] = 0
    found = ~none & (ids[to] == link)
    up = np.where(found, to, -1)
    state = np.where(none, NONE, np.where(found, PRESENT, ABSENT)).astype(np.int32)
    return ids, link, none, comps, up, state, rows


def _traverse(batches):
    got = _index(batches)
    if got is None:
        return
    ids, link, none, comps, up, state, rows = got
    root, depth, pre, below, ring, _ = walk(ids, up)
    root, pre = np.array(root), np.array(pre, np.int32)
    tree = np.bincount(root, weights=rows, minlength=len(ids)).astype(np.int64)
    cols = [ids, link, comps, ids[root], np.array(depth, np.int32), pre, np.array(below, np.int32), state, np.array(ring), state[root], tree[root]]
    masks = {1: none, 5: pre < 0, 6: pre < 0}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for lo in range(0, len(ids), 200_000):
        s = slice(lo, lo + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(c[s], mask=masks[i][s] if i in masks else None) for i, c in enumerate(cols)], names=names)


def _paths(batches):
    got = _index(batches)
    if got is None:
        return
    ids, _, _, _, up, _, _ = got
    _, depth, _, _, ring, done = walk(ids, up)
    stack = np.zeros(max([0, *depth]) + 2, np.int64)
    size, rows, flat, ends = 0, [], [], [0]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))], names=["id", "path"])

    for i in done:  # in pre-order, so the stack always holds the way from the root
        d = depth[i]
        stack[d] = ids[i]
        flat.append(stack[: d + 1].copy())
        rows.append(i)
        size += d + 1
        ends.append(size)
        if size > 1_000_000:
            yield batch()
            size, rows, flat, ends = 0, [], [], [0]
    for i in np.flatnonzero(np.array(depth) < 0).tolist():
        flat.append(np.zeros(0, np.int64))
        rows.append(i)
        ends.append(size)
    yield batch()


def _doubled(big: DataFrame, scratch: Scratch, positions: bool = True) -> DataFrame:
    """The columns of _traverse, for components too large for one task; pre and below only if positions.

    After k rounds a node knows its ancestor 2^k links up, or its root and depth. When no node
    that is still climbing gained one, all that climb lead into cycles; the ancestors they then
    stand on are exactly the nodes of those cycles, whose minimum is found by doubling as well.
    """
    has = big.select(F.col("id").alias("link"), F.lit(True).alias("has"))
    base = big.join(has, "link", "left").select("id", "link", "component", "n", F.when(F.col("link").isNull(), NONE).when(F.col("has"), PRESENT).otherwise(ABSENT).alias("state"))
    base = scratch.save(base, "base")
    jump = scratch.save(base.select("id", F.when(F.col("state") == PRESENT, F.col("link")).otherwise(F.col("id")).alias("anc"), F.when(F.col("state") == PRESENT, 1).otherwise(0).alias("d"), (F.col("state") != PRESENT).alias("top"), F.col("id").alias("low")), "jump")
    n, total = 1, base.count()
    while n <= 2 * total:
        up = jump.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("d").alias("d2"), F.col("top").alias("top2"), F.col("low").alias("low2"))
        new = jump.join(up, "anc").select("id", F.when(F.col("top"), F.col("anc")).otherwise(F.col("anc2")).alias("anc"), F.when(F.col("top"), F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"), (F.col("top") | F.col("top2")).alias("top"), F.least("low", "low2").alias("low"))
        old, jump = jump, scratch.save(new, "jump")
        scratch.drop(old)
        n *= 2
        if not jump.where("not top").limit(1).count():
            break
    ring = jump.where("not top").select(F.col("anc").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    low = jump.join(ring, "id").select(F.col("id").alias("anc"), F.col("low").alias("cycle_low"))
    out = jump.join(low, "anc", "left").join(ring, "id", "left").join(base, "id")
    out = out.select("id", F.col("link").alias("parent"), "component", F.when(F.col("top"), F.col("anc")).otherwise(F.col("cycle_low")).alias("root"), F.when(F.col("top"), F.col("d")).otherwise(-1).cast("int").alias("depth"), F.col("state").cast("int").alias("state"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), "n")
    out = scratch.save(out, "doubled")
    if positions:
        out = out.join(_positions(out, scratch), "id", "left")
    else:
        out = out.withColumns({"pre": F.lit(None).cast("int"), "below": F.lit(None).cast("int")})
    trees = out.groupBy("root").agg(F.sum("n").alias("tree_rows"), F.max(F.when(F.col("id") == F.col("root"), F.col("state"))).alias("root_state"))
    return out.drop("n").join(trees, "root").select(*(c.split()[0] for c in COLUMNS.split(", ")))


def _positions(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, pre, below) as walk() gives them, of all nodes that are not on a cycle, by doubling.

    Without the nodes of cycles the rest is a forest. After k rounds a node has counted what is less
    than 2^k links below it. A node's position is the sum, over the nodes from its top down to
    itself, of what stands before each under its parent; that is doubled the same way.
    """
    ring = nodes.where("on_cycle").select(F.col("id").alias("parent"), F.lit(True).alias("ring"))
    tree = nodes.where("not on_cycle").join(ring, "parent", "left")
    tree = scratch.save(tree.select("id", "root", F.when((F.col("state") == PRESENT) & F.col("ring").isNull(), F.col("parent")).alias("anc")), "forest")

    def climb(now: DataFrame, step) -> DataFrame:
        while now.where("anc is not null").limit(1).count():
            old, now = now, scratch.save(step(now), "climb")
            scratch.drop(old)
        return now

    def count(now: DataFrame) -> DataFrame:
        more = now.where("anc is not null").groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("more"))
        up = now.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"))
        return now.join(more, "id", "left").join(up, "anc", "left").select("id", F.col("anc2").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))

    def add(now: DataFrame) -> DataFrame:
        up = now.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("pre").alias("pre2"))
        return now.join(up, "anc", "left").select("id", F.col("anc2").alias("anc"), (F.col("pre") + F.coalesce("pre2", F.lit(0))).alias("pre"))

    size = climb(scratch.save(tree.select("id", "anc", F.lit(1).cast("long").alias("size")), "sizes"), count).select("id", "size")
    # siblings stand in the order of their ids, and so do the tops of the trees that hang off one cycle
    before = F.coalesce(F.sum("size").over(Window.partitionBy("anc", "above").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tree = tree.join(size, "id").withColumn("above", F.when(F.col("anc").isNull(), F.col("root")))
    pre = climb(scratch.save(tree.select("id", "anc", (before + F.when(F.col("anc").isNull(), 0).otherwise(1)).alias("pre")), "offsets"), add)
    return scratch.save(pre.join(size, "id").select("id", F.col("pre").cast("int").alias("pre"), (F.col("size") - 1).cast("int").alias("below")), "positions")


def split_by_size(comp: DataFrame, co_locate_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of components that fit one task, and the rest, or None where there is no rest."""
    large = comp.groupBy("component").count().where(F.col("count") > co_locate_rows).select("component")
    if not large.limit(1).count():
        return comp, None
    return comp.join(large, "component", "left_anti"), comp.join(large, "component", "left_semi")


def hierarchy(rows: DataFrame, scratch: Scratch | None = None, id_col: str = "tweet_id", parent_col: str = "in_response_to_tweet_id", co_locate_rows: int = CO_LOCATE_ROWS) -> DataFrame:
    """One row for each distinct non-null id: parent, component, root, depth, pre, below, state, on_cycle, root_state, tree_rows.

    A node's parent is the non-null parent among its rows. A root has no parent, or one that is
    absent (state 2); root_state is that of its root, tree_rows counts the rows under that root. Descendants of a node are the nodes of the same root whose `pre` lies in
    (pre, pre + below], at any size of the component; pre and below are null only on a cycle, all
    of whose nodes are below each other. On a cycle, or below one, depth is -1 and root the smallest id of the
    cycle. An empty table gives an empty result; other columns of rows are not read.
    """
    scratch = scratch or Scratch(rows.sparkSession, "hierarchy")
    comp = scratch.save(_components(rows, scratch, id_col, parent_col), "components")
    fits, large = split_by_size(comp, co_locate_rows)
    out = fits.repartition("component").mapInArrow(_traverse, COLUMNS)
    return out if large is None else out.unionByName(_doubled(large, scratch))


def _components(rows: DataFrame, scratch: Scratch, id_col: str, parent_col: str) -> DataFrame:
    return components(rows.select(rows[id_col].cast("long").alias("id"), rows[parent_col].cast("long").alias("link"), F.lit(0).alias("kind")), scratch)


def paths(rows: DataFrame, scratch: Scratch | None = None, id_col: str = "tweet_id", parent_col: str = "in_response_to_tweet_id", co_locate_rows: int = CO_LOCATE_ROWS) -> DataFrame:
    """(id, path): the ids from the root down to id. The path is empty on and under cycles.

    Components above co_locate_rows rows get their paths by climbing one level a round.
    """
    scratch = scratch or Scratch(rows.sparkSession, "paths")
    comp = scratch.save(_components(rows, scratch, id_col, parent_col), "components")
    fits, large = split_by_size(comp, co_locate_rows)
    out = fits.repartition("component").mapInArrow(_paths, "id long, path array<long>")
    if large is None:
        return out
    flat = scratch.save(_doubled(large, scratch, False), "flat")
    level = flat.where("depth = 0").select("id", F.array("id").alias("path"))
    found, depth = [scratch.save(level, "level")], 0
    while found[-1].limit(1).count():
        depth += 1
        up = found[-1].select(F.col("id").alias("parent"), F.col("path").alias("above"))
        found.append(scratch.save(flat.where(F.col("depth") == depth).join(up, "parent").select("id", F.concat("above", F.array("id")).alias("path")), "level"))
    for f in found:
        out = out.unionByName(f)
    return out.unionByName(flat.where("depth < 0").select("id", F.expr("array()").cast("array<long>").alias("path")))
