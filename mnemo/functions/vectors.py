"""Cosine similarity and scalar quantization on array columns, without user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantization levels by storage kind.
LEVELS = {"SQ8": 255, "SQ4": 15}


def _sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, query: list[float]) -> Column:
    """Similarity in double precision; 0 for a zero norm, another length or a NULL vector."""
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = _sum(F.zip_with(a, q, lambda x, y: x.cast("double") * y))
    own = F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    usable = a.isNotNull() & (F.size(a) == len(query)) & (own > 0) & F.lit(norm > 0)
    return F.when(usable, dot / (own * F.lit(norm or 1.0))).otherwise(F.lit(0.0))


def quantized(a: Column, kind: str) -> Column:
    """The vector after a round trip through per-vector min/max scalar quantization; F32 leaves it."""
    if kind == "F32":
        return a
    levels = float(LEVELS[kind])
    low, high = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    step = (high - low) / levels

    def back(x: Column) -> Column:
        code = F.floor((x.cast("double") - low) / step + 0.5)
        return F.when(step > 0, low + F.least(F.greatest(code, F.lit(0)), F.lit(int(levels))) * step).otherwise(low)

    return F.transform(a, back)


def encoded(a: Column, kind: str) -> Column:
    """The codes of a vector: its least and largest value and, for each value, its level less 128."""
    levels, low, high = float(LEVELS[kind]), F.array_min(a).cast("double"), F.array_max(a).cast("double")
    step = (high - low) / levels
    code = lambda x: F.when(step > 0, F.floor((x.cast("double") - low) / step + 0.5)).otherwise(F.lit(0))
    codes = F.transform(a, lambda x: (F.least(F.greatest(code(x), F.lit(0)), F.lit(int(levels))) - 128).cast("tinyint"))
    return F.when(a.isNotNull(), F.struct(low.cast("float").alias("low"), high.cast("float").alias("high"), codes.alias("codes")))


def decoded(c: Column, kind: str) -> Column:
    """The vector that codes stand for, in double precision."""
    low = c["low"].cast("double")
    step = (c["high"].cast("double") - low) / float(LEVELS[kind])
    return F.transform(c["codes"], lambda x: low + (x.cast("int") + 128) * step)


def storage_bytes(dimension: int, kind: str = "F32") -> int:
    """Bytes of one stored vector: 4 a value, or a code a value and 8 for the range."""
    return {"F32": 4 * dimension, "SQ8": dimension + 8, "SQ4": -(-dimension // 2) + 8}[kind]
