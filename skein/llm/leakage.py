"""Evaluation texts leaking into training text: a prefix-filtered set join on word shingles.

Shingles of the items are ordered by how many documents hold them, the rarest first. A document
that shares at least t of the S shingles of an item shares at least l of the item's first
S - t + l, for any l up to t; only those prefix tokens join, and l of them must be shared. Pairs
are bounded by length and by position, as l shared tokens must lie within one item-sized window of
the document, and what is left is verified word by word over such windows.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from skein.session import Scratch, small, spread

SHINGLE = 5
#: The share of an item's words that must match in one passage: half, less a tenth of those for altered words.
CONTAINED = 0.45
#: At most one word in so many of a passage of half an item is altered: each costs up to five shingles.
ALTERED = 12
PREFIX = 8  # l: shared prefix tokens asked for, or t where that is less
GAP = 12  # words between two matching stretches of one passage, on either side
SPAN = 1.5  # a passage stands in a window of so many times the item's words, and GAP more
BROADCAST_ROWS = 2_000_000  # item shingles up to this many rows are broadcast (8 bytes each)
CHUNK = 1 << 20  # characters that are hashed at once; a longer text is a chunk of its own
#: Characters that layout puts inside words.
INSIDE = r"[­​-‍⁠﻿]"

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_INSIDE = regex.compile(INSIDE)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def split_words(text: str) -> list[str]:
    """Lower-case words of a text; marks inside words and punctuation are dropped."""
    return _WORD.findall(_INSIDE.sub("", unicodedata.normalize("NFC", text).lower()))


@functools.cache
def _codes() -> np.ndarray:
    """Each character's lower case, 0 between words, 1 for what is dropped inside them."""
    out = np.zeros(0x110000, np.uint32)
    for c in (*range(0x33480), *range(0xE0000, 0xE0200)):  # beyond these no letters, marks or digits are assigned
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LNM":
            out[c] = ord(ch.lower()[0]) + 2
        elif _INSIDE.match(ch):
            out[c] = 1
    return out


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the word hash, and of its inverse, modulo 2**64."""
    up = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)])
    return up(np.uint64(_BASE)), up(np.uint64(pow(_BASE, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word of the texts, in order, with whole arrays: polynomial hashes of the
    characters come from prefix sums. Words are those of split_words()."""
    texts = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts]
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), lens)
    code = _codes()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    kept = code != 1
    if not kept.all():
        of, code = of[kept], code[kept]
    inside = np.r_[False, code > 0, False]
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    up, down = _powers(1 << max(20, int(len(code)).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum(code.astype(np.uint64) * up[: len(code)], dtype=np.uint64)]
    return of[starts], _mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size words."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(_BASE) + words[k : k + n]
    return _mixed(h + np.uint64(size)).view(np.int64)


def _shingler(vocabulary: dict[int, np.ndarray] | None, sizes: tuple[int, ...]):
    """Rows (id, n_words, sh, at) of the shingles of (id, text), of all or of those in a vocabulary by size."""

    def chunks(b):
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        some, held = [], 0
        for i, t in zip(ids, texts):
            if held + len(t) > CHUNK and some:
                yield some
                some, held = [], 0
            some.append((i, t))
            held += len(t)
        if some:
            yield some

    def run(batches):
        for b in batches:
            for part in chunks(b):
                ids = np.array([i for i, _ in part], np.int64)
                of, words = word_hashes([t for _, t in part])
                n = np.bincount(of, minlength=len(ids))
                first = np.r_[0, np.cumsum(n)]
                got = []
                for size in sizes:
                    sh = shingle_hashes(words, size)
                    keep = of[: len(sh)] == of[size - 1 :] if len(sh) else np.zeros(0, bool)
                    if vocabulary is None:
                        if size < SHINGLE:  # of an item its whole, if it is that short
                            keep = keep & (n[of[: len(sh)]] == size)
                    else:
                        v = vocabulary[size]
                        to = np.searchsorted(v, sh)
                        to[to == len(v)] = 0
                        keep = keep & (v[to] == sh) if len(v) else keep & False
                    at = np.flatnonzero(keep)
                    got.append((of[at], sh[at], at - first[of[at]]))
                o, sh, at = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(ids[o]), pa.array(n[o].astype(np.int32)), pa.array(sh), pa.array(at.astype(np.int32))], names=["id", "n_words", "sh", "at"])

    return run


def _shingler_all(size: int):
    """Rows of all shingles of one size, for documents whose items are too many to broadcast."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sh = shingle_hashes(word_hashes([t])[1], size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sh), i)), pa.array(np.full(len(sh), len(sh) + size - 1, np.int32)), pa.array(sh), pa.array(np.arange(len(sh), dtype=np.int32))], names=["id", "n_words", "sh", "at"])

    return run


SHINGLED = "id long, n_words int, sh long, at int"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two short word lists."""
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def passage(item: list[str], starts: dict[tuple, list[int]], doc: list[str], doc_starts: dict[tuple, list[int]], size: int = SHINGLE) -> float:
    """The largest share of the item's words found in order in one passage of the document.

    starts and doc_starts give the positions of each shingle. Matching stretches are the maximal
    runs of equal words around shared shingles; stretches follow each other in both texts with at
    most GAP words between, inside a window of one and a half times the item's words. Of the words
    in a gap those in common count too.
    """
    runs, seen = [], {}
    for s, at in starts.items():
        for d in doc_starts.get(s, ()):
            for i in at:
                seen.setdefault(i - d, []).append(i)
    for shift, at in seen.items():
        at.sort()
        lo = prev = at[0]
        for i in at[1:]:
            if i > prev + 1:
                runs.append((lo, prev + size, lo - shift))
                lo = i
            prev = i
        runs.append((lo, prev + size, lo - shift))
    runs.sort()
    best, most, first = [], 0, []
    for k, (lo, hi, d) in enumerate(runs):
        score, start = hi - lo, d
        for j in range(k - 1, -1, -1):
            lo2, hi2, d2 = runs[j]
            e2 = d2 + hi2 - lo2
            cut = max(0, hi2 - lo, e2 - d)  # words that both stretches cover
            if cut >= hi - lo or lo + cut - hi2 > GAP or d + cut - e2 > GAP or lo2 >= lo or d2 >= d:
                continue
            if d + hi - lo - first[j] > SPAN * len(item) + GAP:
                continue
            got = best[j] + hi - lo - cut
            if got + GAP > score:
                got += _common(item[hi2 : lo + cut], doc[e2 : d + cut])
                if got > score:
                    score, start = got, first[j]
        best.append(score)
        first.append(start)
        most = max(most, score)
    return most / len(item) if item else 0.0


def _positions(w: list[str], size: int = SHINGLE) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for k in range(len(w) - size + 1):
        out.setdefault(tuple(w[k : k + size]), []).append(k)
    return out


def verifier(contained: float):
    def run(frames):
        kept: dict[int, tuple] = {}
        for f in frames:
            doc_ids, item_ids = [], []
            for doc_id, text, pairs in zip(f["doc_id"], f["text"], f["items"]):
                w, at = split_words(text), {}
                for p in pairs:
                    if p["v"] not in kept:
                        if len(kept) > 50_000:
                            kept.clear()
                        iw = split_words(p["item_text"])
                        size = min(SHINGLE, len(iw))
                        kept[p["v"]] = (iw, _positions(iw, size), size)
                    iw, starts, size = kept[p["v"]]
                    if size not in at:
                        at[size] = _positions(w, size)
                    if passage(iw, starts, w, at[size], size) >= (contained if size == SHINGLE else 1):
                        doc_ids.append(doc_id)
                        item_ids.append(p["item_id"])
            yield pd.DataFrame({"doc_id": pd.Series(doc_ids, dtype="int64"), "item_id": pd.Series(item_ids, dtype="int64")})

    return run


def least_shared(n_words, altered: int = ALTERED):
    """t: the shingles that a passage of half of n_words words keeps, one word in `altered` of it changed; 1 at least."""
    half = F.ceil(n_words / 2)
    return F.greatest(F.lit(1), half - (SHINGLE - 1) - SHINGLE * F.floor(half / altered)).cast("int")


def leaks(documents: DataFrame, items: DataFrame, contained: float = CONTAINED, altered: int = ALTERED, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id) for each document in which `contained` of an item's words stand as a passage.

    An item of fewer than five words matches where it stands whole. Null texts, and texts without
    words, match nothing on either side; an item_id with several texts matches where any of them
    does. Repeated rows give one pair; an empty table on either side gives an empty result.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "leaks")
    d = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text")).where("doc_id is not null and text <> ''")
    it = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("item_text")).where("item_id is not null and item_text <> ''").distinct()
    it = it.withColumn("v", F.xxhash64("item_id", "item_text"))
    sizes = tuple(range(1, SHINGLE + 1))
    item_sh = scratch.save(it.select("v", "item_text").mapInArrow(_shingler(None, sizes), SHINGLED).groupBy(F.col("id").alias("v"), "n_words", "sh").agg(F.min("at").alias("pos")), "item_shingles")
    if small(item_sh, BROADCAST_ROWS):
        rows = item_sh.select(F.least("n_words", F.lit(SHINGLE)).alias("size"), "sh").distinct().collect()  # at most BROADCAST_ROWS
        vocabulary = {k: np.sort(np.array([r["sh"] for r in rows if r["size"] == k], np.int64)) for k in sizes}
        sizes = tuple(k for k in sizes if len(vocabulary[k])) or (SHINGLE,)
        doc_sh = spread(d).mapInArrow(_shingler(vocabulary, sizes), SHINGLED)
    else:
        every = {k: item_sh.where(F.least("n_words", F.lit(SHINGLE)) == k).select("sh").distinct() for k in sizes}
        all_of = lambda k: spread(d).mapInArrow(_shingler_all(k), SHINGLED)
        doc_sh = functools.reduce(DataFrame.unionAll, (all_of(k).join(every[k], "sh", "left_semi").select("id", "n_words", "sh", "at") for k in sizes))
    doc_sh = scratch.save(doc_sh, "doc_shingles")
    df = doc_sh.groupBy("sh").agg(F.count("*").alias("df"))
    rare_first = Window.partitionBy("v").orderBy("df", "sh")  # the shingles of one item
    sized = item_sh.join(df, "sh", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("size", F.count("*").over(Window.partitionBy("v"))).withColumn("rank", F.row_number().over(rare_first))
    sized = sized.withColumn("t", F.least(F.col("size").cast("int"), least_shared(F.col("n_words"), altered))).withColumn("l", F.least("t", F.lit(PREFIX)))
    prefix = sized.where(F.col("rank") <= F.col("size") - F.col("t") + F.col("l")).select("sh", "v", F.col("n_words").alias("item_words"), "l")
    # the document is long enough for the passage, and l prefix tokens stand in a window of the item's size
    pairs = doc_sh.join(prefix, "sh").where(F.col("n_words") >= F.col("item_words") * contained)
    pairs = pairs.groupBy(F.col("id").alias("doc_id"), "v").agg(F.first("item_words").alias("item_words"), F.first("l").alias("l"), F.sort_array(F.collect_list("at")).alias("at"))
    within = F.expr(f"exists(sequence(0, size(at) - l), i -> at[i + l - 1] - at[i] <= {SPAN} * item_words + {GAP})")
    bounded = pairs.where(F.size("at") >= F.col("l")).where(within).select("doc_id", "v")
    whole = bounded.join(it, "v").groupBy("doc_id").agg(F.collect_list(F.struct("v", "item_id", "item_text")).alias("items"))
    return d.join(whole, "doc_id").mapInPandas(verifier(contained), "doc_id long, item_id long").distinct()
