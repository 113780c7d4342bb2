"""Keyed draws by hash: independent of partitioning and of row order, and repeatable in any engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import GLOBAL_SEED


def seed_for(*purpose: str) -> Column:
    """The seed of a purpose: the first four bytes of sha256("seed:purpose"), big-endian."""
    return F.conv(F.substring(F.sha2(F.lit(":".join([str(GLOBAL_SEED), *purpose])), 256), 1, 8), 16, 10).cast("long")


def draw(purpose: str, *keys: Column) -> Column:
    """A uniform draw in [0, 1) for the keys; null keys draw as the empty string."""
    text = F.concat_ws(":", F.lit(f"{GLOBAL_SEED}:{purpose}"), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def order_key(purpose: str, *keys: Column) -> Column:
    """A random-looking order of rows: sort by it, then by an id."""
    text = F.concat_ws(":", F.lit(f"{GLOBAL_SEED}:{purpose}"), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.sha2(text, 256)


def request_key(**fields: Column) -> Column:
    """The key of a cached request: 32 hex digits over its fields in name order."""
    return F.substring(F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256), 1, 32)


def poisson(u: Column) -> Column:
    """A Poisson(1) count, 0 to 8, for a uniform draw: how often a bootstrap takes a row."""
    out, p, total = F.lit(0), math.exp(-1), math.exp(-1)
    for k in range(1, 9):
        out = F.when(u >= total, k).otherwise(out)
        p /= k
        total += p
    return out


def embedding_key(model: str, tag: str | None, text: Column) -> Column:
    """The key of a cached embedding: model, tag ("-" where texts and queries are embedded alike) and text."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(tag or "-"), text), 256)


def item_hash(message: Column, draft: Column) -> Column:
    """Ten hex digits that change when a message or its draft does; nulls count as empty."""
    return F.substring(F.sha2(F.concat(F.coalesce(message, F.lit("")), F.lit("\n"), F.coalesce(draft, F.lit(""))), 256), 1, 10)
