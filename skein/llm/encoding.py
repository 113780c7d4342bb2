"""Encoding of texts with a byte-level BPE vocabulary.

A segment tree over the byte positions of a piece keeps the leftmost minimum rank of the pairs of
neighbouring parts; a merge updates the two live neighbours it touches, each in logarithmic time,
so a piece of n bytes takes n log n steps however long it is.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.session import spread

#: Fixed value: the public pattern that splits text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 200_000  # pieces kept by each worker
NO_PAIR = 1 << 62

_loaded: dict[str, tuple] = {}


def default_vocabulary() -> str:
    """Path of byte_bpe_50k where the public vocabularies are installed."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load(path: str) -> tuple[dict[bytes, int], object]:
    """Ranks by bytes, and the compiled piece pattern; read once by each worker."""
    if path not in _loaded:
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = (ranks, regex.compile(PIECES), {})
    return _loaded[path]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: merge the leftmost pair of lowest rank until no pair has a rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NO_PAIR] * (2 * size)
    get = ranks.get
    # a key is rank * n + position: the smallest key is the leftmost pair of lowest rank
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # where the part that starts at i ends
    before = list(range(-1, n - 1))  # start of the part before the one that starts at i

    def put(i: int, key: int) -> None:
        i += size
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            key = a if a < b else b
            if tree[i] == key:
                return
            tree[i] = key
            i >>= 1

    while (low := tree[1]) < NO_PAIR:
        i = low % n
        j = end[i]  # the part at j joins the part at i
        e = end[i] = end[j]
        if e < n:
            before[e] = i
            r = get(piece[i : end[e]])
            put(i, NO_PAIR if r is None else r * n + i)
        else:
            put(i, NO_PAIR)
        if j < n - 1:
            put(j, NO_PAIR)
        h = before[i]
        if h >= 0:
            r = get(piece[h:e])
            put(h, NO_PAIR if r is None else r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def encode(text: str | None, path: str) -> list[int]:
    """Token ids of a text, without special tokens; an empty or null text gives an empty list."""
    if not text:
        return []
    ranks, pieces, cache = load(path)
    out: list[int] = []
    for p in pieces.findall(text):
        ids = cache.get(p)
        if ids is None:
            raw = p.encode("utf-8")
            r = ranks.get(raw)
            ids = [r] if r is not None else merge(raw, ranks)
            if len(cache) >= CACHE:
                cache.clear()
            if len(raw) <= 64:
                cache[p] = ids
        out += ids
    return out


def encoder(path: str):
    def run(batches):
        for b in batches:
            flat, ends = [], [0]
            for t in b.column("text").to_pylist():
                flat += encode(t, path)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return run


def encoded(documents: DataFrame, vocabulary: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every row. Null and empty texts give an empty list; rows are never dropped.

    Strings that look like special tokens are ordinary text. The file `vocabulary` must be
    readable at that path on every executor. Repeated rows come out as often as they go in.
    """
    d = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].alias("text"))
    return spread(d).mapInArrow(encoder(vocabulary or default_vocabulary()), "doc_id long, ids array<int>")
