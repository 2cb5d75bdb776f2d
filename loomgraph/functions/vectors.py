"""Vector functions over ARRAY<FLOAT> as Column expressions, summed in double in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    return F.transform(F.arrays_zip(doubles(v).alias("x"), F.array_repeat(norm(v), F.size(v)).alias("n")), lambda p: F.when(p["n"] == 0, p["x"]).otherwise(p["x"] / p["n"]))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def scale(v: Column) -> Column:
    """The int8 scale of a row: its largest magnitude over 127."""
    return F.array_max(F.transform(doubles(v), F.abs)) / 127


def quantize(v: Column) -> Column:
    """The row as whole numbers from -127 to 127."""
    zipped = F.arrays_zip(doubles(v).alias("x"), F.array_repeat(scale(v), F.size(v)).alias("s"))
    return F.transform(zipped, lambda p: F.when(p["s"] == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(p["x"] / p["s"] + 0.5)))).cast("int"))


def dequantize(q: Column, s: Column) -> Column:
    return F.transform(F.arrays_zip(q.alias("q"), F.array_repeat(s, F.size(q)).alias("s")), lambda p: p["q"] * p["s"])
