"""Results over groups of any size: prefix sums, predecessors, and joins of rows with their groups.

A window over a hot group would put all its rows into one task. Here each group is cut
into pieces first; windows run inside the pieces, and over one summary row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.shared import materialize


def pieces(df: DataFrame) -> int:
    """Into how many pieces to cut a group: as many as a shuffle has partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, group: list[str], order: str, weight: str, total: str = "_before", tie: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """Adds ``total``: the sum of ``weight`` over the rows of the group that come before the row.

    Rows are ordered by ``order``, a non-null bigint spread evenly over its range (a
    hash): the piece of a row is given by its leading digits. ``df`` must give the same
    rows whenever it is read. Ties of ``order`` are broken by the columns of ``tie``.
    """
    n = n or pieces(df)
    cut = df.withColumn("_piece", F.floor((F.col(order).cast("double") / 2.0**63 + 1) / 2 * n))
    sums = cut.groupBy(*group, "_piece").agg(F.sum(weight).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_s_{g}") for g in group], F.col("_piece").alias("_s_piece"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    same: Column = F.col("_piece") == F.col("_s_piece")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    inside = Window.partitionBy(*group, "_piece").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = local.join(starts, same)
    return joined.withColumn(total, F.col("_start") + F.col("_local")).drop("_piece", "_s_piece", "_start", "_local", *[f"_s_{g}" for g in group])


def predecessor(df: DataFrame, group: str, order: str, value: str, block: int = 64) -> DataFrame:
    """Adds ``_prev_order`` and ``_prev``: order and value of the row with the next lower ``order`` (an integer) in the group, null for the lowest.

    (group, order) must be unique. Inside blocks of ``block`` successive numbers by a
    window; the first of a block takes the last row of the nearest block before it, which
    a window over one row per block finds.
    """
    df = materialize(df.withColumn("_block", F.floor(F.col(order) / block)), "ordered")
    w = Window.partitionBy(group, "_block").orderBy(order)
    inside = df.withColumns({"_in_order": F.lag(order).over(w), "_in": F.lag(value).over(w)})
    last = df.groupBy(group, "_block").agg(F.max(order).alias("_last"))
    last = last.select(F.col(group).alias("_lg"), F.col("_block").alias("_lb"), F.lag("_last").over(Window.partitionBy(group).orderBy("_block")).alias("_before"))
    values = df.select(F.col(group).alias("_vg"), F.col(order).alias("_vo"), F.col(value).alias("_vv"))
    firsts = last.filter(F.col("_before").isNotNull()).join(values, F.col("_lg").eqNullSafe(F.col("_vg")) & (F.col("_before") == F.col("_vo")))
    j = inside.join(firsts, F.col(group).eqNullSafe(F.col("_lg")) & (F.col("_block") == F.col("_lb")) & F.col("_in_order").isNull(), "left")
    j = j.withColumns({"_prev_order": F.coalesce("_in_order", "_before"), "_prev": F.coalesce("_in", "_vv")})
    return j.drop("_block", "_in_order", "_in", "_lg", "_lb", "_before", "_vg", "_vo", "_vv")


#: A group with more rows than this is hot: it is spread over several tasks when rows meet their group.
HOT_ROWS = 1_000_000
#: Hot groups up to this many are sent to all executors; there are at most (rows / HOT_ROWS) of them.
HOT_GROUPS = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread_by: str, *, hot_rows: int = HOT_ROWS, salts: int | None = None) -> DataFrame:
    """Rows with the columns of their group (inner join on ``keys``, nulls equal), however many rows one group has.

    ``groups`` has one row per group with its number of rows in ``size``; it is read
    several times, so give a written table. Hot groups are repeated once per salt and their
    rows are dealt out by a hash of ``spread_by``; all others meet in a plain join. With
    more hot groups than may be broadcast, the join relies on AQE's splitting alone.
    """
    salts = salts or pieces(rows)
    other = [c for c in groups.columns if c not in (*keys, size)]
    g = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col(size).alias("_g_size"), *other)
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    hot = g.filter(F.col("_g_size") > hot_rows)
    many = hot.limit(HOT_GROUPS + 1).count()
    if 0 < many <= HOT_GROUPS:
        flags = F.broadcast(hot.select(*[F.col(f"_g_{k}").alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot")))
        among: Column = F.lit(True)
        for k in keys:
            among = among & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        rows = rows.join(flags, among, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(0)).drop("_hot", *[f"_h_{k}" for k in keys])
        g = g.withColumn("_g_salt", F.explode(F.when(F.col("_g_size") > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        same = same & (F.col("_salt") == F.col("_g_salt"))
    return rows.join(g, same).drop("_salt", "_g_salt", "_g_size", *[f"_g_{k}" for k in keys])
