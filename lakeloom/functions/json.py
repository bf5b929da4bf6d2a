"""JSON functions: JSON is text, as it is stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(key: str | int) -> str:
    return f"$[{key}]" if isinstance(key, int) else f"$['{key}']" if "'" not in key else f'$["{key}"]'


def get_text(j: Column, key: str | int) -> Column:
    """``j ->> key``: a field or element as text; a negative number counts elements from the end."""
    if isinstance(key, int) and key < 0:
        n = F.json_array_length(j) + key
        elements = F.from_json(j, "array<string>")
        return F.when(n >= 0, F.try_element_at(elements, F.lit(key)))
    if isinstance(key, str) and "'" in key:  # such a key cannot be quoted in a path
        return F.try_element_at(F.from_json(j, "map<string,string>"), F.lit(key))
    return F.get_json_object(j, _path(key))


def get_json(j: Column, key: str | int) -> Column:
    """``j -> key``: a field or element as JSON; a JSON null stays ``null``."""
    v = F.variant_get(F.try_parse_json(j), _path(key), "variant")
    return F.to_json(v)


def array_length(j: Column) -> Column:
    return F.json_array_length(j).cast("bigint")


def is_json(j: Column) -> Column:
    return F.when(j.isNotNull(), F.try_parse_json(j).isNotNull())


def build_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
