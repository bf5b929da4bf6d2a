"""Pruning of files by any filter.

The condition is resolved by Catalyst against the table's schema; its tree is then
rewritten, node by node, into a condition on the manifest: whether a file *may* hold a
row that meets it, by the bounds of its columns and the values of hidden partition
transforms. Parts that say nothing about a file (functions of columns, Python functions,
comparisons of two columns) become true, so a file is never lost. Constants stay
expressions of Spark, so whatever folds (casts, intervals, ``current_date()``) prunes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as ClassicColumn

from lakeloom.table import transforms

# Comparisons by their names in Catalyst, with what they are turned round and denied.
COMPARISONS = {"EqualTo": "=", "EqualNullSafe": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
TURNED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
DENIED = {"=": "<>", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
#: Numeric types from narrow to wide; casts towards the wide end keep the order of values.
WIDTH = ("tinyint", "smallint", "int", "bigint", "decimal", "float", "double")


def as_condition(where: Column | str | list[tuple[str, str, object]] | None) -> Column | None:
    """One condition from a Column, SQL text, or a list of (column, operator, value) of which all must hold."""
    if isinstance(where, str):
        return F.expr(where)
    if isinstance(where, list):
        return reduce(lambda a, b: a & b, [transforms.condition(F.col(f"`{n}`"), op, v) for n, op, v in where]) if where else None
    return where


class _Walk:
    def __init__(self, spark: SparkSession, columns: list[dict], specs: list[list[dict]]) -> None:
        self.spark, self.by_name, self.specs = spark, {c["name"]: c for c in columns}, specs

    def may(self, e, deny: bool = False) -> Column:  # noqa: ANN001
        kind = e.getClass().getSimpleName()
        kids = [e.children().apply(i) for i in range(e.children().size())]
        if kind in ("And", "Or"):
            a, b = (self.may(k, deny) for k in kids)
            return a & b if (kind == "And") != deny else a | b
        if kind == "Not":
            return self.may(kids[0], not deny)
        if kind in ("IsNull", "IsNotNull") and (c := self.column(kids[0])):
            return self.nulls(c[0], (kind == "IsNull") != deny)
        if kind in COMPARISONS and not (deny and kind == "EqualNullSafe"):
            op = COMPARISONS[kind]
            for a, b, o in ((kids[0], kids[1], op), (kids[1], kids[0], TURNED[op])):
                if (c := self.column(a)) and self.constant(b):
                    return self.compared(*c, DENIED[o] if deny else o, b)
        if kind == "In" and (c := self.column(kids[0])) and all(map(self.constant, kids[1:])):
            each = [self.compared(*c, "<>" if deny else "=", k) for k in kids[1:]]
            return reduce(lambda a, b: a & b if deny else a | b, each, F.lit(deny))
        if kind == "StartsWith" and not deny and (c := self.column(kids[0])) and self.constant(kids[1]):
            lo, hi = self.bounds(c[0], None)
            p = self.literal(kids[1])
            return self.known(c[0], (F.substring(lo, F.lit(1), F.length(p)) <= p) & (F.substring(hi, F.lit(1), F.length(p)) >= p))
        return F.lit(True)

    def column(self, e) -> tuple[dict, str | None] | None:  # noqa: ANN001
        """(column, type it is cast to) of a column as it is, or under a cast that keeps the order of its values."""
        kind = e.getClass().getSimpleName()
        if kind == "AttributeReference":
            c = self.by_name.get(e.name())
            return (c, None) if c else None
        if kind == "Cast" and e.child().getClass().getSimpleName() == "AttributeReference" and (c := self.by_name.get(e.child().name())):
            old, new = e.child().dataType().simpleString().split("(")[0], e.dataType().simpleString()
            wide = new.split("(")[0]
            if old in WIDTH and wide in WIDTH and WIDTH.index(old) < WIDTH.index(wide) or old == "date" and wide in ("timestamp", "timestamp_ntz"):
                return c, new
        return None

    @staticmethod
    def constant(e) -> bool:  # noqa: ANN001
        return e.foldable() and e.deterministic()

    def literal(self, e) -> Column:  # noqa: ANN001
        """A resolved constant expression as a Column."""
        return ClassicColumn(self.spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))

    @staticmethod
    def bounds(c: dict, cast: str | None) -> tuple[Column, Column]:
        lo, hi = (F.try_element_at(m, F.lit(c["id"])).try_cast(c["type"]) for m in ("lower", "upper"))
        return (lo.try_cast(cast), hi.try_cast(cast)) if cast else (lo, hi)

    @staticmethod
    def known(c: dict, fits: Column) -> Column:
        """True unless the file has this column and ``fits`` is known to be false; an older file may show a default instead."""
        fits = F.coalesce(fits, F.lit(True))
        return fits if c["default"] is None else fits | (F.col("schema_id") < c["since"])

    def nulls(self, c: dict, want: bool) -> Column:
        n = F.try_element_at("nulls", F.lit(c["id"]))
        return self.known(c, n > 0 if want else n < F.col("row_count"))

    def compared(self, c: dict, cast: str | None, op: str, e) -> Column:  # noqa: ANN001
        lo, hi = self.bounds(c, cast)
        v = self.literal(e)
        fits = {"=": (lo <= v) & (hi >= v), "<": lo < v, "<=": lo <= v, ">": hi > v, ">=": hi >= v, "<>": ~((lo == v) & (hi == v))}[op]
        some = F.try_element_at("nulls", F.lit(c["id"])) < F.col("row_count")  # a null meets no comparison
        out = self.known(c, fits) & self.known(c, some)
        if cast is None and op != "<>":
            for n, spec in enumerate(self.specs):
                for p in (p for p in spec if p["id"] == c["id"]):
                    ok = self.partition(p, c["type"], op, e)
                    out = out if ok is None else out & ((F.col("spec_id") != n) | F.coalesce(ok, F.lit(False)))
        return out

    def partition(self, p: dict, kind: str, op: str, e) -> Column | None:  # noqa: ANN001
        have = F.try_element_at("partition", F.lit(p["name"]))
        v = self.literal(e).cast(kind)
        if p["transform"] == "void" or p["transform"] in ("bucket", "truncate", "identity") and op != "=":
            return None  # bounds say as much
        if p["transform"] == "bucket":
            plain = F.unix_date(v) if kind == "date" else F.unix_micros(v.cast("timestamp")) if kind.startswith("timestamp") else v
            x = self.spark.range(1).select(plain).first()[0]
            return None if x is None else have == F.lit(str(transforms.bucket_of(x, p["arg"])))
        want = transforms.value(p, v, kind)
        if op == "=":
            return have.eqNullSafe(want.cast("string")) if p["transform"] != "identity" or kind not in ("float", "double") else None
        return have.cast("bigint") <= want.cast("bigint") if op in ("<", "<=") else have.cast("bigint") >= want.cast("bigint")


def may_hold(spark: SparkSession, schema: T.StructType, columns: list[dict], specs: list[list[dict]], condition: Column) -> Column:
    """Whether a file of the manifest may hold a row that meets ``condition``; columns are those of the table's metadata."""
    plan, walk, out = spark.createDataFrame([], schema).filter(condition)._jdf.queryExecution(), _Walk(spark, columns, specs), F.lit(True)
    # The optimizer unfolds BETWEEN and LIKE and folds constants, but makes sets of long IN lists; so both forms are asked.
    for resolved in (plan.analyzed(), plan.optimizedPlan()):
        while resolved.getClass().getSimpleName() != "Filter" and resolved.children().size():
            resolved = resolved.children().apply(0)
        if resolved.getClass().getSimpleName() == "Filter":
            out = out & walk.may(resolved.condition())
    return out


def pruned(files: DataFrame, schema: T.StructType, state: dict, condition: Column | None) -> DataFrame:
    """The manifest's rows that may matter for a condition; position deletes all do."""
    if condition is None:
        return files
    return files.filter((F.col("content") == 1) | may_hold(files.sparkSession, schema, state["columns"], state["specs"], condition))
