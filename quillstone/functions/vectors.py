"""Array-of-number expressions; elements are widened to double first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where either has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def relu(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def softmax(c: Column) -> Column:
    """Shares that sum to one; the greatest element is taken off first."""
    e = F.transform(doubles(c), lambda x: F.exp(x - F.array_max(doubles(c))))
    return F.transform(e, lambda x: x / total(e))


def argmax(c: Column) -> Column:
    """Position, from 0, of the first greatest element."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def pad(c: Column, size: int, fill: Column) -> Column:
    """The first ``size`` elements, filled up at the end."""
    cut = F.slice(c, 1, size)
    return F.concat(cut, F.array_repeat(fill, F.lit(size) - F.size(cut)))


def reshape(c: Column, width: int) -> Column:
    """Rows of ``width`` elements each."""
    return F.transform(F.sequence(F.lit(0), (F.size(c) / width).cast("int") - 1), lambda i: F.slice(c, i * width + 1, width))


def transpose(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def calculate(op: Column, a: Column, b: Column) -> Column:
    """a and b added, subtracted, multiplied or divided; division by zero, and an operation of another name, is an error."""
    divided = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(a / b)
    unknown = F.raise_error(F.concat(F.lit("unknown operation: "), op)).cast("double")
    return F.when(op == "add", a + b).when(op == "subtract", a - b).when(op == "multiply", a * b).when(op == "divide", divided).otherwise(unknown)
