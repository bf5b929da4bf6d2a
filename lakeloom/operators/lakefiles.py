"""Data files of lake tables: one row per object, and which are live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """A spelling-independent form of an object's URL.

    Letter case of the scheme and its variants (s3, s3a, s3n) are made one, percent
    escapes are decoded once, empty and ``.`` segments go, ``..`` removes the segment
    before it. Bucket and key keep their case. A broken escape stays as it is; null stays
    null. All JVM-side expressions.
    """
    scheme = F.lower(F.regexp_extract(path, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    scheme = F.when(scheme.isin("s3a", "s3n"), "s3").otherwise(scheme)
    rest = F.regexp_replace(F.trim(path), r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "")
    plus = F.replace(rest, F.lit("+"), F.lit("%2B"))
    rest = F.when(F.contains(rest, F.lit("%")), F.coalesce(F.try_url_decode(plus), rest)).otherwise(rest)
    parts = F.split(rest, "/")
    bucket, key = F.element_at(parts, 1), F.slice(parts, 2, F.size(parts))
    key = F.filter(key, lambda s: (s != "") & (s != "."))
    up = F.aggregate(key, F.expr("cast(array() as array<string>)"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    key = F.when(F.array_contains(key, ".."), up).otherwise(key)
    return F.when(path.isNotNull(), F.concat_ws("/", F.concat(scheme, F.lit(":/")), bucket, F.array_join(key, "/")))


def newest_files(files: DataFrame) -> DataFrame:
    """One row per object of a table: that with the latest ``updated_time``, then the highest ``id``.

    Adds ``object`` (the canonical path). A maximum over structs, so repeats are combined
    before the shuffle and no group is ever sorted as a whole. Defined cases: a null time
    is older than any other; rows with a null path are all kept, as nothing says that they
    are one file, told apart by id; exact repeats count once.
    """
    columns = ["table_name", "id", "path", "row_count", "updated_time", "file_size", "content"]
    f = files.select(*columns).withColumn("object", canonical_path(F.col("path")))
    f = f.withColumn("_key", F.coalesce("object", F.concat(F.lit("?"), F.col("id").cast("string"))))
    rest = [c for c in columns if c not in ("table_name", "updated_time", "id")]
    best = f.groupBy("table_name", "_key").agg(F.max(F.struct("updated_time", "id", *rest, "object")).alias("b"))
    return best.select("table_name", *[F.col(f"b.{c}") for c in ["id", "updated_time", *rest, "object"]])
