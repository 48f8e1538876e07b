"""Scalar expressions that Spark lacks or that need one agreed meaning here."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null; ``greatest`` and ``least`` alone would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, and ``empty`` where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(float(empty)))


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


#: Coefficients of a rational approximation of erfc (fixed values; absolute error below 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function, in code generation rather than a Python worker."""
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    y = t * F.exp(-x * x + poly)
    return F.when(x >= 0, y).otherwise(2.0 - y)


def erfc_sql(x: str) -> str:
    t = f"(1.0/(1.0+0.5*abs({x})))"
    poly = repr(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = f"({poly}*{t}+({c!r}))"
    return f"(CASE WHEN {x} >= 0 THEN {t}*exp(-({x})*({x})+{poly}) ELSE 2.0-{t}*exp(-({x})*({x})+{poly}) END)"


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII string in SQL that has none, bit by bit; the constant is the polynomial's, a fixed value."""
    return f"CAST(xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda y, _: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS BIGINT)"
