"""Map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def create(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def extract(m: Column, key: Column | object) -> Column:
    """The value of a key, null where there is none."""
    return F.try_element_at(m, key if isinstance(key, Column) else F.lit(key))


def cardinality(m: Column) -> Column:
    return F.when(m.isNotNull(), F.size(m))


def entries(m: Column) -> Column:
    """One row per entry, as columns key and value, by ``inline``."""
    return F.inline(F.map_entries(m))
