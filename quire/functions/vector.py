"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIM = 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    def scaled(v: Column) -> Column:
        return let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))

    return let(a.cast("array<double>"), scaled)


def hashing_embedding(text: Column, dim: int = HASH_DIM) -> Column:
    """A deterministic bag-of-words vector: each token counts at its character codes' sum modulo dim."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    code = lambda w: F.aggregate(F.split(w, ""), F.lit(0), lambda s, ch: s + F.ascii(ch)) % dim
    counts = lambda slots: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("double"))
    return normalize(let(F.transform(words, code), counts))
