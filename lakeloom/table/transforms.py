"""Hidden partition transforms: identity, truncate, bucket, year, month, day, hour, void."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"\s*(?:(\w+)\s*\(\s*(?:(\d+)\s*,\s*)?\"?(\w+)\"?\s*(?:,\s*(\d+)\s*)?\)|\"?(\w+)\"?)\s*(?:,|$)")


def parse(text: str, columns: list[str]) -> list[dict]:
    """A spec such as ``day(ts), bucket(32, user_id), region`` as a list of transforms."""
    out, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read partitioning from {text[at:]!r}")
        name = (m[1] or "identity").lower()
        column, arg = m[3] or m[5], int(m[2] or m[4]) if (m[2] or m[4]) else None
        if name not in ("identity", "truncate", "bucket", "year", "month", "day", "hour", "void"):
            raise ValueError(f"unknown transform {name}")
        if (name in ("truncate", "bucket")) != (arg is not None) or (arg is not None and arg < 1):
            raise ValueError(f"{name} takes {'a positive number' if name in ('truncate', 'bucket') else 'no number'}")
        if column not in columns:
            raise ValueError(f'column "{column}" does not exist')
        out.append({"transform": name, "arg": arg, "column": column, "name": column if name == "identity" else f"{column}_{name}"})
        at = m.end()
    return out


def _rot(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF


def murmur3(data: bytes) -> int:
    """MurmurHash3, x86, 32 bits, seed 0."""
    h, n = 0, len(data) & ~3
    for (k,) in struct.iter_unpack("<I", data[:n]):
        h = (_rot(h ^ (_rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if tail := data[n:]:
        h ^= _rot(int.from_bytes(tail, "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ (h >> 16)


def bucket_of(value: object, buckets: int) -> int | None:
    """The bucket of one value: integers as eight bytes, text as UTF-8."""
    if value is None:
        return None
    data = struct.pack("<q", value) if isinstance(value, int) and not isinstance(value, bool) else value.encode() if isinstance(value, str) else bytes(value)
    return (murmur3(data) & 0x7FFFFFFF) % buckets


def bucket(c: Column, buckets: int, kind: str) -> Column:
    """The bucket number, by an Arrow-batched function; Spark's own hash has another seed and tail rule."""

    def run(x):
        return pd.Series([None if v is None or v != v else bucket_of(v, buckets) for v in x], dtype="Int32")

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    f = F.pandas_udf(run, "int")
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return F.pandas_udf(_int_bucket(buckets), "int")(c.cast("bigint"), c.isNull())
    if kind == "date":
        return F.pandas_udf(_int_bucket(buckets), "int")(F.unix_date(c).cast("bigint"), c.isNull())
    if kind.startswith("timestamp"):
        return F.pandas_udf(_int_bucket(buckets), "int")(F.unix_micros(c.cast("timestamp")), c.isNull())
    return f(c)


def _int_bucket(buckets: int):
    import numpy as np

    def run(x, missing):
        v = np.where(missing.to_numpy(bool), 0, x.fillna(0).to_numpy()).astype(np.int64).view(np.uint64)
        m = np.uint64(0xFFFFFFFF)
        h = np.zeros(len(v), np.uint64)
        for k in (v & m, v >> np.uint64(32)):
            k = k * np.uint64(0xCC9E2D51) & m
            k = ((k << np.uint64(15)) | (k >> np.uint64(17))) & m
            h = h ^ (k * np.uint64(0x1B873593) & m)
            h = ((h << np.uint64(13)) | (h >> np.uint64(19))) & m
            h = (h * np.uint64(5) + np.uint64(0xE6546B64)) & m
        h = h ^ np.uint64(8)
        h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & m
        h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & m
        h = h ^ (h >> np.uint64(16))
        out = pd.Series((h & np.uint64(0x7FFFFFFF)) % np.uint64(buckets)).astype("Int32")
        out[missing.to_numpy(bool)] = pd.NA
        return out

    run.__annotations__ = {"x": pd.Series, "missing": pd.Series, "return": pd.Series}
    return run


def value(spec: dict, c: Column, kind: str) -> Column:
    """The partition value of a column."""
    t, n = spec["transform"], spec["arg"]
    if t == "identity":
        return c
    if t == "void":
        return F.lit(None).cast("string")
    if t == "year":
        return F.year(c) - 1970
    if t == "month":
        return (F.year(c) - 1970) * 12 + F.month(c) - 1
    if t == "day":
        return F.unix_date(c.cast("date"))
    if t == "hour":
        return F.floor(F.unix_seconds(c.cast("timestamp")) / 3600)
    if t == "truncate":
        return F.substring(c, 1, n) if kind in ("string", "binary") else c - F.pmod(c, F.lit(n))
    return bucket(c, n, kind)


def condition(c: Column, op: str, v: object) -> Column:
    """One comparison as a filter."""
    return {
        "=": lambda: c == v, "<>": lambda: c != v, "<": lambda: c < v, "<=": lambda: c <= v, ">": lambda: c > v, ">=": lambda: c >= v,
        "in": lambda: c.isin(list(v)), "isnull": lambda: c.isNull(), "notnull": lambda: c.isNotNull(),
    }[op]()
