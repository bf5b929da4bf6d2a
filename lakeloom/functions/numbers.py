"""Numeric functions and casts with PostgreSQL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _error(when: Column, text: str, otherwise: Column) -> Column:
    return F.when(when, F.raise_error(F.lit(text))).otherwise(otherwise)


def div(x: Column, y: Column) -> Column:
    """Quotient truncated towards zero; a zero divisor raises."""
    q = x / y
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))


def int_divide(x: Column, y: Column) -> Column:
    """``/`` of two integers."""
    return ((x - x % y) / y).cast("bigint")


def mod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return x % y


def round_(x: Column, digits: int | None = None, *, numeric: bool = False) -> Column:
    """Numerics round half away from zero, floats half to even."""
    return F.round(x, digits or 0) if numeric or digits is not None else F.rint(x)


def trunc(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def sqrt(x: Column) -> Column:
    return _error(x < 0, "cannot take square root of a negative number", F.sqrt(x))


def ln(x: Column) -> Column:
    return _error(x <= 0, "cannot take logarithm of zero or a negative number", F.ln(x))


def log(x: Column) -> Column:
    """Base 10."""
    return _error(x <= 0, "cannot take logarithm of zero or a negative number", F.log10(x))


def sind(x: Column) -> Column:
    return F.sin(F.radians(x))


def cosd(x: Column) -> Column:
    return F.cos(F.radians(x))


def tand(x: Column) -> Column:
    return F.tan(F.radians(x))


def cotd(x: Column) -> Column:
    return F.cot(F.radians(x))


def asind(x: Column) -> Column:
    return F.degrees(F.asin(x))


def acosd(x: Column) -> Column:
    return F.degrees(F.acos(x))


def atand(x: Column) -> Column:
    return F.degrees(F.atan(x))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def acosh(x: Column) -> Column:
    return _error(x < 1, "input is out of range", F.acosh(x))


def atanh(x: Column) -> Column:
    return _error((x < -1) | (x > 1), "input is out of range", F.atanh(x))


_INTS = {"int2": "smallint", "int4": "int", "int8": "bigint"}


def to_int(x: Column, kind: str = "int4", *, numeric: bool = False) -> Column:
    """Casts to an integer round: floats half to even, numerics half away from zero."""
    return (F.round(x) if numeric else F.rint(x)).cast(_INTS[kind])


def to_bool(x: Column) -> Column:
    return x != 0


def bit_xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)
