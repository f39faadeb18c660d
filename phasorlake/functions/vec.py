"""Array algebra as column expressions. They stay in the JVM, but array lambdas are interpreted: right for
one-shot queries and small vectors; fits use the Arrow kernels of ``operators``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm2(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def divided(a: Column | str, by: Column) -> Column:
    """Entries by a number of the row. It is bound by a lambda of its own: in that of the entries it would be worked out
    for each of them."""
    return F.get(F.transform(F.array(by), lambda n: F.transform(a, lambda v: v / n)), 0)


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def hermitian_abs2(re: Column, im: Column, cre: Column, cim: Column) -> Column:
    """|x . conj(c)|^2 of complex vectors held as two arrays."""
    real = dot(re, cre) + dot(im, cim)
    imag = dot(im, cre) - dot(re, cim)
    return real * real + imag * imag


def even_places(a: Column) -> Column:
    return F.filter(a, lambda _, i: i % 2 == 0)


def odd_places(a: Column) -> Column:
    return F.filter(a, lambda _, i: i % 2 == 1)


def logsumexp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(total(F.transform(a, lambda v: F.exp(v - top))))


def argmax(a: Column) -> Column:
    """Place of the largest value, the first of equal ones, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(part: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (j == part).cast("double"))


def flip_sign(a: Column) -> Column:
    """The vector, negated where more than half of its entries are positive."""
    return F.when(F.size(F.filter(a, lambda v: v > 0)) > F.size(a) / 2, F.transform(a, lambda v: -v)).otherwise(a)


def standard_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def entropy(p: Column) -> Column:
    """-p ln(p + 1e-10), NaN as 0."""
    return F.when(F.isnan(p), 0.0).otherwise(-p * F.log(p + 1e-10))
