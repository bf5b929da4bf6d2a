"""Relational operators that Spark SQL lacks or spells otherwise, with PostgreSQL semantics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lakeloom.shared import materialize


def pg_order(*keys: Column | str, desc: bool = False) -> list[Column]:
    """Sort keys with PostgreSQL's default place of nulls: last when ascending, first when descending."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return [c.desc_nulls_first() if desc else c.asc_nulls_last() for c in cols]


def distinct_on(df: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """``SELECT DISTINCT ON (on) ... ORDER BY on, order``: the first row of each group. ``order`` should be total; ties are arbitrary."""
    w = Window.partitionBy(*on).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def fetch_with_ties(df: DataFrame, keys: list[tuple[str, bool]], n: int) -> DataFrame:
    """``ORDER BY keys FETCH FIRST n ROWS WITH TIES``; keys are (column, descending), nulls as in PostgreSQL.

    The n-th row's keys are found by a top-k (no full sort, no window over the whole
    table); all rows that do not come after them are kept.
    """
    if n <= 0:
        return df.limit(0)
    order = [k for c, desc in keys for k in pg_order(c, desc=desc)]
    top = df.select(*[F.col(c).alias(f"_k{i}") for i, (c, _) in enumerate(keys)])
    back = [F.col(f"_k{i}").asc_nulls_last() if desc else F.col(f"_k{i}").desc_nulls_first() for i, (_, desc) in enumerate(keys)]
    forth = [k for i, (_, desc) in enumerate(keys) for k in pg_order(f"_k{i}", desc=desc)]
    last = top.orderBy(*forth).limit(n).orderBy(*back).limit(1).first()  # one row
    if last is None:
        return df.limit(0)
    after = F.lit(False)
    for i, (c, desc) in reversed(list(enumerate(keys))):
        mine, theirs = F.col(c), F.lit(last[i]).cast(df.schema[c].dataType)
        beyond = F.coalesce(mine < theirs, mine.isNotNull() & theirs.isNull()) if desc else F.coalesce(mine > theirs, mine.isNull() & theirs.isNotNull())
        after = beyond | (mine.eqNullSafe(theirs) & after)
    return df.filter(~after).orderBy(*order)


def limit_by_query(df: DataFrame, order: list[Column], n: DataFrame) -> DataFrame:
    """``ORDER BY order LIMIT (subquery)``; ``n`` has one row and one number. Runs the subquery first, so the limit is a top-k."""
    rows = n.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row returned by a subquery used as an expression")
    if not rows or rows[0][0] is None:
        return df.orderBy(*order)
    return df.orderBy(*order).limit(int(rows[0][0]))


def percentiles(df: DataFrame, by: list[str], value: str, fractions: list[float], name: str = "q") -> DataFrame:
    """percentile_cont of several fractions per group, as an array: lo + part * (hi - lo) between the two nearest values.

    Equal values are counted before the shuffle, so a group's window sees each value once
    and is sorted on disk if need be. Nulls are left out; a group of nulls alone gives no
    row; without ``by`` there is one group.
    """
    if not all(0 <= f <= 1 for f in fractions):
        raise ValueError("fractions lie between 0 and 1")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    placed = counted.withColumns({"_to": F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(group)})
    at = lambda f: F.lit(float(f)) * (F.col("_all") - 1)
    here = lambda i: F.max(F.when((F.col("_to") - F.col("_n") <= i) & (i < F.col("_to")), F.col("_v")))
    found = placed.groupBy(*by).agg(F.max("_all").alias("_all"), *[x for k, f in enumerate(fractions) for x in (here(F.floor(at(f))).alias(f"_lo{k}"), here(F.ceil(at(f))).alias(f"_hi{k}"))])
    q = [F.col(f"_lo{k}") + (at(f) - F.floor(at(f))) * (F.col(f"_hi{k}") - F.col(f"_lo{k}")) for k, f in enumerate(fractions)]
    return found.select(*by, F.array(*q).alias(name))


def window_exclude(value: Column, how: str, exclude: str, partition: list[str], order: list[str], start: int = Window.unboundedPreceding, end: int = Window.unboundedFollowing) -> Column:
    """An aggregate over a frame ``ROWS BETWEEN start AND end`` with EXCLUDE CURRENT ROW, GROUP, TIES or NO OTHERS.

    ``how`` is sum, count, avg, min or max. Sums and counts over unbounded frames take the
    whole frame's value less that of the excluded rows, without collecting anything; other
    frames collect their rows, so bound them.
    """
    w = Window.partitionBy(*partition).orderBy(*[F.col(o).asc_nulls_last() for o in order])
    frame, peers = w.rowsBetween(start, end), Window.partitionBy(*partition, *order)
    plain: dict[str, Callable] = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
    exclude = exclude.lower()
    if exclude == "no others":
        return plain[how](value).over(frame)
    if how in ("sum", "count", "avg") and start == Window.unboundedPreceding and end == Window.unboundedFollowing:
        one = value.isNotNull().cast("bigint")
        total, n = F.coalesce(F.sum(value).over(frame), F.lit(0)), F.count(value).over(frame)
        own = F.coalesce(value, F.lit(0))
        group, group_n = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
        gone, gone_n = {"current row": (own, one), "group": (group, group_n), "ties": (group - own, group_n - one)}[exclude]
        left, left_n = total - gone, n - gone_n
        return left_n if how == "count" else F.when(left_n > 0, left if how == "sum" else left / left_n)
    rows = F.collect_list(F.struct(F.row_number().over(w).alias("i"), F.struct(*order).alias("p"), value.alias("v"))).over(frame)
    here = F.row_number().over(w)
    me = F.struct(*order)
    keep = {"current row": lambda x: x["i"] != here, "group": lambda x: ~x["p"].eqNullSafe(me), "ties": lambda x: ~x["p"].eqNullSafe(me) | (x["i"] == here)}[exclude]
    kept = F.filter(F.transform(F.filter(rows, keep), lambda x: x["v"]), lambda v: v.isNotNull())
    n = F.size(kept).cast("bigint")
    if how == "count":
        return n
    if how in ("min", "max"):
        return F.array_min(kept) if how == "min" else F.array_max(kept)
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    return F.when(n > 0, total if how == "sum" else total / n)


def recursive_union(base: DataFrame, step: Callable[[DataFrame], DataFrame], *, distinct: bool = True, max_rounds: int = 1_000) -> DataFrame:
    """``WITH RECURSIVE``: ``base`` and, again and again, ``step`` of the rows that were new.

    With ``distinct`` (UNION) only rows never seen go on, so cycles end. Each round is
    written to the shared folder: lineage stays short and a lost executor costs a round.
    """
    seen = materialize(base.distinct() if distinct else base, "recursive")
    new, parts = seen, [seen]
    for _ in range(max_rounds):
        more = step(new)
        if distinct:
            known = parts[0]
            for p in parts[1:]:
                known = known.unionAll(p)
            more = more.subtract(known)  # distinct, too
        new = materialize(more, "recursive")
        if new.isEmpty():
            break
        parts.append(new)
    else:
        raise RuntimeError(f"recursion did not end in {max_rounds} rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows with ``low <= point < high``, by an equi-join on bins of ``width`` instead of a nested loop.

    Each interval is put into all bins that it touches, so choose ``width`` near the usual
    length of an interval. Rows with nulls meet nothing; ``how`` may be inner or left.
    """
    b = F.floor(F.col(point) / width)
    bins = right.filter(F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) < F.col(high)))
    bins = bins.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    l = left.withColumn("_point_bin", b)  # noqa: E741
    return l.join(bins, (F.col("_point_bin") == F.col("_bin")) & (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)), how).drop("_bin", "_point_bin")


def grouping_mask(*columns: str) -> Column:
    """PostgreSQL's ``GROUPING(a, b, ...)``: one bit per column, the last one lowest."""
    out = F.lit(0)
    for c in columns:
        out = out * 2 + F.grouping(c).cast("int")
    return out


def cursor(df: DataFrame, size: int = 1000) -> Iterator[list[Row]]:
    """A forward cursor: rows in batches, fetched partition by partition, never all at once."""
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


UNSUPPORTED = ("MERGE", "ON CONFLICT", "FOR UPDATE", "FOR SHARE", "CTID")


def reject_unsupported(sql: str) -> None:
    """Raise for statements that lake tables do not take, whatever the engine could do with them."""
    upper = " ".join(sql.upper().split())
    for word in UNSUPPORTED:
        if f" {word} " in f" {upper} ":
            raise NotImplementedError(f"{word} is not supported on lake tables")
