"""Filling fixed-capacity containers with items of varying length.

The plan is made over a histogram of lengths, not over items. Lengths are rounded up to
``precision`` leading binary digits, so a group has a bounded number of bins (about
20,000 for 10 digits and the default capacity) whatever the number of its items, and a
container that is full by the histogram never overflows. Best fit over counts then
handles all items of a bin together: containers with the same room left are one class,
and a step fills whole classes. The plan says, of each bin, which ranks go to which
containers; items take their places by joining on their rank within the bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.shared import materialize

CAPACITY = 536_870_912
PRECISION = 10
#: Into how many parts the items of one length are dealt before they are ranked; a fixed number, so that the result does not depend on the session.
SUBGROUPS = 64

PLAN = "bin bigint, lo bigint, hi bigint, container bigint, each bigint"


def rounded_up(size: Column, precision: int) -> Column:
    """``size`` rounded up to a number of ``precision`` + 1 leading binary digits; small numbers stay exact."""
    more = F.greatest(F.length(F.bin(size)) - (precision + 1), F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), more)
    return F.floor((size + step - 1) / step).cast("bigint") * step


def best_fit(histogram: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit by decreasing length over (length, count).

    Returns rows (bin, lo, hi, container, each): of the items of ``bin``, those of ranks
    lo to hi - 1 go to containers from ``container`` on, ``each`` to a container. The work
    depends on the number of lengths, not on that of items or containers.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # rooms left, in order
    held: dict[int, list[tuple[int, int]]] = {}  # room -> runs of containers (first, number)
    made = 0

    def add(room: int, first: int, number: int) -> None:
        if number:
            if room not in held:
                insort(rooms, room)
            held.setdefault(room, []).append((first, number))

    for size, count in sorted(histogram, reverse=True):
        lo = 0
        if size == 0:
            made = max(made, 1)
            plan.append((0, 0, count, 0, count))
            continue
        while lo < count:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                number = -(-(count - lo) // per)
                add(capacity, made, number)
                made += number
                continue
            room = rooms[at]
            first, number = held[room].pop()
            if not held[room]:
                del held[room]
                rooms.pop(at)
            per = min(room // size, count - lo)
            full = min(number, (count - lo) // per)
            plan.append((size, lo, lo + full * per, first, per))
            lo += full * per
            add(room - per * size, first, full)
            add(room, first + full, number - full)
    return plan


def pack(items: DataFrame, group: str, size: str, key: str, *, capacity: int = CAPACITY, precision: int = PRECISION) -> DataFrame:
    """One row per item, or per piece of an item above the capacity: group, key, piece, size, container, room classes by best fit.

    Columns: ``group``, ``key``, ``piece`` (from 0; only pieces of oversized items are
    above 0), ``size`` of the item or piece and ``container``, numbered from 0 within the
    group, null for items of unknown size.

    An item above the capacity is cut into pieces of exactly the capacity, each in a
    container of its own, and a rest that is packed like any other item. ``key`` must be
    unique within the group; ties of length are placed in the order of a hash of the key.
    Hot groups: histograms are combined map-side, ranks are counted inside pieces of a
    bin, and the planner of a group sees at most one row per bin.
    Defined cases: a null or negative size is unknown and gets no container; size 0 takes
    no room and goes to container 0; a null group is a group of its own.
    """
    src = items.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(size).cast("bigint").alias("whole"))
    known = (F.col("whole") >= 0) & F.col("whole").isNotNull()
    full = F.expr(f"whole div {capacity}")
    parts = F.when(known & (F.col("whole") > capacity), F.sequence(F.lit(0).cast("bigint"), F.when(F.col("whole") % capacity == 0, full - 1).otherwise(full))).otherwise(F.array(F.lit(0).cast("bigint")))
    cut = src.withColumn("piece", F.explode(parts))
    cut = cut.withColumn("s", F.when(known, F.least(F.lit(capacity).cast("bigint"), F.col("whole") - F.col("piece") * capacity)))
    cut = cut.withColumn("bin", F.when(F.col("s").isNotNull(), F.least(F.lit(capacity).cast("bigint"), rounded_up(F.col("s"), precision))))  # least skips nulls
    cut = cut.withColumn("sub", F.pmod(F.xxhash64("k", "piece"), F.lit(SUBGROUPS)))
    cut = materialize(cut.select("g", "k", "piece", "s", "bin", "sub"), "packing")

    counts = cut.filter(F.col("bin").isNotNull()).groupBy("g", "bin", "sub").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("g", "bin").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.withColumn("start", before), "starts")
    histogram = starts.groupBy("g", "bin").agg(F.sum("c").alias("c"))
    kind = items.schema[group].dataType.simpleString()

    def plan_one(pdf: pd.DataFrame) -> pd.DataFrame:
        plan = best_fit(list(zip(pdf["bin"].tolist(), pdf["c"].tolist())), capacity)
        out = pd.DataFrame(plan, columns=["bin", "lo", "hi", "container", "each"]).astype("int64")
        out.insert(0, "g", pdf["g"].iloc[0])
        return out

    plan = histogram.groupBy("g").applyInPandas(plan_one, f"g {kind}, {PLAN}")
    # The steps of one bin are joined by the sub-run in which they begin or which they cover.
    s = starts.alias("s")
    p = plan.alias("p")
    meets = F.col("s.g").eqNullSafe(F.col("p.g")) & (F.col("s.bin") == F.col("p.bin")) & (F.col("p.lo") < F.col("s.start") + F.col("s.c")) & (F.col("p.hi") > F.col("s.start"))
    steps = s.join(p, meets).select(F.col("s.g").alias("pg"), F.col("s.bin").alias("pb"), F.col("s.sub").alias("ps"), F.col("s.start").alias("start"), "p.lo", "p.hi", "p.container", "p.each")
    steps = steps.groupBy("pg", "pb", "ps", "start").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "container", "each"))).alias("steps"))
    nth = F.row_number().over(Window.partitionBy("g", "bin", "sub").orderBy("k", "piece")) - 1
    j = cut.withColumn("nth", nth).join(steps, F.col("g").eqNullSafe(F.col("pg")) & (F.col("bin") == F.col("pb")) & (F.col("sub") == F.col("ps")), "left")
    j = j.withColumn("rank", F.col("start") + F.col("nth"))
    step = F.element_at(F.filter("steps", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), 1)
    j = j.withColumn("step", F.when(F.col("steps").isNotNull(), step))
    container = F.col("step.container") + F.expr("(rank - step.lo) div step.each")
    return j.select(F.col("g").alias(group), F.col("k").alias(key), F.col("piece").cast("int").alias("piece"), F.col("s").alias(size), container.alias("container"))
