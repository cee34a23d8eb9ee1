"""Small symmetric systems as Column expressions: Cholesky factors and solves over array columns.

Matrices are arrays of doubles that hold the lower triangle by rows; cell(i, j) says where an entry is. Their size is known
when the plan is made, their entries are data. A pivot of nothing but rounding leaves its variable out: its coefficient,
and its part of what is explained, are zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of a diagonal entry below which a pivot counts as zero.
TINY = 1e-12


def cell(i: int, j: int) -> int:
    """Position of the entry (i, j) of a symmetric matrix."""
    i, j = max(i, j), min(i, j)
    return i * (i + 1) // 2 + j


def packed(entry, size: int) -> Column:
    """The array of entry(i, j) for the lower triangle."""
    return F.array(*[entry(i, j) for i in range(size) for j in range(i + 1)])


def _empty() -> Column:
    return F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cholesky(a: Column, size: int) -> Column:
    """The lower factor of a packed positive semidefinite matrix."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cell(i, 0)).alias("row"), F.lit(cell(j, 0)).alias("col")) for i in range(size) for j in range(i + 1)]

    def add(l: Column, s: Column) -> Column:
        whole = F.get(a, s["row"] + s["j"])
        left = whole - dot(F.slice(l, s["row"] + 1, s["j"]), F.slice(l, s["col"] + 1, s["j"]))
        pivot = F.get(l, s["col"] + s["j"])
        below = F.when(pivot > 0, left / pivot).otherwise(0.0)
        return F.concat(l, F.array(F.when(s["i"] == s["j"], F.when(left > whole * TINY, F.sqrt(left)).otherwise(0.0)).otherwise(below)))

    return F.aggregate(F.array(*steps), _empty(), add)


def forward(l: Column, b: Column, size: int) -> Column:
    """y of L y = b; the squares of y are what each variable explains beyond those before it."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(cell(i, 0)).alias("row")) for i in range(size)]

    def add(y: Column, s: Column) -> Column:
        pivot = F.get(l, s["row"] + s["i"])
        left = F.get(b, s["i"]) - dot(F.slice(l, s["row"] + 1, s["i"]), y)
        return F.concat(y, F.array(F.when(pivot > 0, left / pivot).otherwise(0.0)))

    return F.aggregate(F.array(*steps), _empty(), add)


def backward(l: Column, y: Column, size: int) -> Column:
    """x of L' x = y, of the leading size variables."""
    below = lambda i: F.array(*[F.lit(cell(k, i)) for k in range(size - 1, i, -1)]).cast("array<int>")
    steps = [F.struct(F.lit(i).alias("i"), F.lit(cell(i, i)).alias("at"), below(i).alias("below")) for i in range(size - 1, -1, -1)]

    def add(x: Column, s: Column) -> Column:
        pivot = F.get(l, s["at"])
        left = F.get(y, s["i"]) - dot(F.transform(s["below"], lambda k: F.get(l, k)), x)
        return F.concat(x, F.array(F.when(pivot > 0, left / pivot).otherwise(0.0)))

    return F.reverse(F.aggregate(F.array(*steps), _empty(), add))


def explained(y: Column, size: int | None = None) -> Column:
    """Sum of squares that the leading size variables explain, from forward()."""
    return F.aggregate(F.slice(y, 1, size) if size is not None else y, F.lit(0.0), lambda s, v: s + v * v)


def inverse_diagonal(l: Column, size: int, of: Sequence[int]) -> list[Column]:
    """Diagonal entries of the inverse of L L'."""
    unit = lambda k: F.array(*[F.lit(float(i == k)) for i in range(size)])
    return [explained(forward(l, unit(k), size)) for k in of]
