"""Values outside the range that a table can hold: raise, or clamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bounded(c: Column, lo: object, hi: object, policy: str, name: str) -> Column:
    low, high = c < F.lit(lo), c > F.lit(hi)
    if policy == "clamp":
        return F.when(low, F.lit(lo)).when(high, F.lit(hi)).otherwise(c)
    return F.when(low | high, F.raise_error(F.concat(F.lit(f"{name} out of range: "), c.cast("string")))).otherwise(c)


def _within(c: Column, kind: T.DataType, lo: object, hi: object, policy: str, name: str) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _within(x, kind.elementType, lo, hi, policy, name))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _within(x, kind.valueType, lo, hi, policy, name))
    return _bounded(c, lo, hi, policy, name).cast(kind)


def enforce(df: DataFrame, ranges: dict[str, tuple[object, object]], policy: str = "error") -> DataFrame:
    """Keep columns, or the elements of arrays and values of maps, within (lowest, highest). Nulls stay.

    ``policy`` is ``error`` (the query fails at the first value outside) or ``clamp``. A
    dotted name reaches a field of a struct.
    """
    if policy not in ("error", "clamp"):
        raise ValueError(f"policy must be error or clamp, not {policy}")
    for name, (lo, hi) in ranges.items():
        top, _, inner = name.partition(".")
        if not inner:
            df = df.withColumn(top, _within(F.col(f"`{top}`"), df.schema[top].dataType, lo, hi, policy, name))
            continue
        kind: T.DataType = df.schema[top].dataType
        for part in inner.split("."):
            kind = kind[part].dataType
        df = df.withColumn(top, F.when(F.col(top).isNotNull(), F.col(top).withField(inner, _within(F.col(f"{top}.{inner}"), kind, lo, hi, policy, name))))
    return df


def limit_text(c: Column, max_bytes: int, policy: str = "error") -> Column:
    """Texts longer than ``max_bytes`` in UTF-8: raise, or cut after the last whole character that fits."""
    too_long = F.octet_length(c) > max_bytes
    if policy == "error":
        return F.when(too_long, F.raise_error(F.lit(f"text longer than {max_bytes} bytes"))).otherwise(c)
    raw = F.substring(F.encode(c, "UTF-8"), 1, max_bytes)
    whole = F.regexp_replace(F.hex(raw), "(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$", "")
    return F.when(too_long, F.decode(F.unhex(whole), "UTF-8")).otherwise(c)


def limit_binary(c: Column, max_bytes: int, policy: str = "error") -> Column:
    too_long = F.octet_length(c) > max_bytes
    if policy == "error":
        return F.when(too_long, F.raise_error(F.lit(f"value longer than {max_bytes} bytes"))).otherwise(c)
    return F.when(too_long, F.substring(c, 1, max_bytes)).otherwise(c)
