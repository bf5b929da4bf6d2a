"""Array functions with PostgreSQL semantics: nulls are elements, and a null array is not an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_agg(value: Column, *order: Column) -> Column:
    """Aggregate that keeps nulls, in the order of ``order``; null over no rows, as PostgreSQL has it."""
    rows = F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))
    rows = F.sort_array(rows) if order else rows
    return F.when(F.size(rows) > 0, F.transform(rows, lambda x: x["v"]))


def array_append(a: Column, x: Column) -> Column:
    return F.when(a.isNull(), F.array(x)).otherwise(F.array_append(a, x))


def array_prepend(x: Column, a: Column) -> Column:
    return F.when(a.isNull(), F.array(x)).otherwise(F.array_prepend(a, x))


def array_cat(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def array_length(a: Column, dimension: int = 1) -> Column:
    """Length, null for an empty array; only the first dimension exists."""
    return F.nullif(F.size(a), F.lit(0)).cast("int") if dimension == 1 else F.lit(None).cast("int")


def cardinality(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def contains(a: Column, b: Column) -> Column:
    """``a @> b``: every element of b is in a; nulls are never equal."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(F.filter(a, lambda y: y.isNotNull()), x), F.lit(False)))


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def overlaps(a: Column, b: Column) -> Column:
    """``a && b``; null elements meet nothing."""
    return F.arrays_overlap(F.filter(a, lambda y: y.isNotNull()), F.filter(b, lambda y: y.isNotNull()))


def subscript(a: Column, i: Column | int) -> Column:
    """``a[i]``, counted from 1; null outside."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when(i > 0, F.try_element_at(a, F.greatest(i, F.lit(1))))


def slice_of(a: Column, lo: int, hi: int) -> Column:
    """``a[lo:hi]``; empty where nothing is left."""
    lo = max(lo, 1)
    return F.slice(a, lo, max(hi - lo + 1, 0))


def array_position(a: Column, x: Column) -> Column:
    return F.nullif(F.array_position(a, x), F.lit(0)).cast("int")


def array_remove(a: Column, x: Column) -> Column:
    return F.filter(a, lambda y: ~y.eqNullSafe(x))


def array_replace(a: Column, x: Column, y: Column) -> Column:
    return F.transform(a, lambda e: F.when(e.eqNullSafe(x), y).otherwise(e))


def array_to_string(a: Column, delimiter: str, null_text: str | None = None) -> Column:
    return F.array_join(a, delimiter) if null_text is None else F.array_join(a, delimiter, null_text)


def trim_array(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def unnest(a: Column) -> Column:
    return F.explode(a)
