"""Embeddings without a model, and cosine similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bind import let

#: Dimensions of the hash embedding.
DIMENSION = 384


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    """Cosine with a small constant in the denominator; 0 where a vector is zero."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: dot(p["a"], p["b"]) / (norm(p["a"]) * norm(p["b"]) + F.lit(epsilon)))


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """A unit vector from SHA-256 of "text:counter", each 32 bits mapped to [-1, 1]."""
    blocks = F.sequence(F.lit(0), F.lit(-(-dimension // 8) - 1))
    digits = F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit(":"), i.cast("string")).cast("binary"), 256)), "")
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    raw = let(digits, lambda d: F.transform(places, lambda i: F.conv(F.substring(d, i * 8 + 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) * 2.0 - 1.0))
    return let(raw, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(1.0))))
