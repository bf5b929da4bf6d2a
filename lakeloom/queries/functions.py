"""Queries of the function library, over real columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import arrays as A
from lakeloom.functions import dates as D
from lakeloom.functions import json as J
from lakeloom.functions import maps as M
from lakeloom.functions import numbers as N
from lakeloom.functions import text as X
from lakeloom.registry import Registry
from lakeloom.sources.tables import table

R = Registry()
c = F.col


class _Lazy:
    """Collects columns of one query; Spark columns are made when the query runs, as they need a session."""

    def __init__(self, name: str, source: str, key: str, doc: str) -> None:
        self.makers: dict[str, object] = {}
        sqls: dict[str, str] = {}
        self.sqls = sqls

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return table(spark, sf, source).select(key, *[f().alias(n) for n, f in self.makers.items()])

        run.__doc__ = doc
        R.queries[name] = run
        self.finish = lambda: R.oracle.__setitem__(name, f"SELECT {key}, " + ", ".join(f"{s} AS {n}" for n, s in sqls.items()) + f" FROM {source}")

    def add(self, name: str, make, sql: str) -> None:
        self.makers[name] = make
        self.sqls[name] = sql
        self.finish()


q = _Lazy("fn_text_trim_pad", "part", "p_partkey", "Trimming and padding.")
q.add("b", lambda: X.btrim(c("p_name"), "rebg"), "trim(p_name, 'rebg')")
q.add("l", lambda: X.ltrim(c("p_name"), "rebs"), "ltrim(p_name, 'rebs')")
q.add("r", lambda: X.rtrim(c("p_name"), "gtk"), "rtrim(p_name, 'gtk')")
q.add("lp", lambda: X.lpad(c("p_brand"), 12, "*-"), "lpad(p_brand, 12, '*-')")
q.add("rp", lambda: X.rpad(c("p_brand"), 5, "*"), "rpad(p_brand, 5, '*')")
q.add("bp", lambda: X.bpchar(c("p_name"), 6), "rpad(left(p_name, 6), 6, ' ')")

q = _Lazy("fn_text_slice", "part", "p_partkey", "Slices, with negative and outlying arguments.")
q.add("l3", lambda: X.left(c("p_name"), 3), "left(p_name, 3)")
q.add("ln", lambda: X.left(c("p_name"), -4), "left(p_name, -4)")
q.add("r3", lambda: X.right(c("p_name"), 3), "right(p_name, 3)")
q.add("rn", lambda: X.right(c("p_name"), -4), "right(p_name, -4)")
q.add("s", lambda: X.substr(c("p_name"), 2, 4), "substr(p_name, 2, 4)")
q.add("s0", lambda: X.substr(c("p_name"), -1, 4), "substr(p_name, 1, 2)")
q.add("sl", lambda: X.substr(c("p_name"), 5), "substr(p_name, 5)")
q.add("sp", lambda: X.split_part(c("p_name"), " ", 2), "split_part(p_name, ' ', 2)")
q.add("sn", lambda: X.split_part(c("p_name"), " ", -1), "split_part(p_name, ' ', -1)")

q = _Lazy("fn_text_regex", "part", "p_partkey", "Regular expressions.")
q.add("first", lambda: X.regexp_replace(c("p_name"), "[aeiou]", "_"), "regexp_replace(p_name, '[aeiou]', '_')")
q.add("every", lambda: X.regexp_replace(c("p_name"), "[aeiou]", "_", "g"), "regexp_replace(p_name, '[aeiou]', '_', 'g')")
q.add("back", lambda: X.regexp_replace(c("p_name"), "([a-z]+) ([a-z]+)", "\\2 \\1"), "regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\\2 \\1')")
q.add("caseless", lambda: X.regexp_like(c("p_brand"), "^BRAND#1", "i"), "regexp_matches(p_brand, '^BRAND#1', 'i')")
q.add("plain", lambda: X.regexp_like(c("p_name"), "ring$"), "regexp_matches(p_name, 'ring$')")

q = _Lazy("fn_text_misc", "customer", "c_custkey", "Other text functions.")
q.add("len", lambda: F.length("c_name").cast("bigint"), "length(c_name)")
q.add("bits", lambda: F.bit_length("c_name").cast("bigint"), "bit_length(c_name)")
q.add("asc", lambda: F.ascii("c_mktsegment"), "ascii(c_mktsegment)")
q.add("ch", lambda: X.chr_(c("c_nationkey") + 945), "chr(c_nationkey + 945)")
q.add("md", lambda: F.md5(c("c_name").cast("binary")), "md5(c_name)")
q.add("pos", lambda: X.position("#", c("c_name")).cast("bigint"), "position('#' IN c_name)")
q.add("strp", lambda: F.instr(c("c_mktsegment"), "U").cast("bigint"), "strpos(c_mktsegment, 'U')")
q.add("rep", lambda: F.repeat(F.substring("c_mktsegment", 1, 2), 3), "repeat(substr(c_mktsegment, 1, 2), 3)")
q.add("repl", lambda: F.replace(c("c_name"), F.lit("0"), F.lit("o")), "replace(c_name, '0', 'o')")
q.add("rev", lambda: F.reverse("c_mktsegment"), "reverse(c_mktsegment)")
q.add("up", lambda: F.upper(F.lower("c_name")), "upper(lower(c_name))")
q.add("st", lambda: X.starts_with(c("c_mktsegment"), "MA"), "starts_with(c_mktsegment, 'MA')")
q.add("cc", lambda: X.concat(c("c_name"), F.lit(None).cast("string"), c("c_nationkey")), "concat(c_name, NULL, c_nationkey)")
q.add("cw", lambda: X.concat_ws("-", c("c_mktsegment"), F.lit(None).cast("string"), c("c_nationkey")), "concat_ws('-', c_mktsegment, NULL, c_nationkey)")
q.add("op", lambda: F.concat(c("c_name"), F.lit("!")), "c_name || '!'")

q = _Lazy("fn_initcap", "part", "p_partkey", "initcap: words are runs of ASCII letters and digits.")
q.add("ic", lambda: X.initcap(F.concat(c("p_name"), F.lit("-X1yZ"))), "upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) || '-X1yz'")

q = _Lazy("fn_math_round_div", "lineitem", "l_orderkey", "Rounding, quotients and remainders.")
q.add("line", lambda: c("l_linenumber"), "l_linenumber")
q.add("part", lambda: c("l_partkey"), "l_partkey")
q.add("r", lambda: N.round_(c("l_extendedprice")), "round_even(l_extendedprice, 0)")
q.add("rn", lambda: N.round_(c("l_extendedprice").cast("decimal(18,2)"), 1).cast("double"), "round(l_extendedprice::DECIMAL(18,2), 1)::DOUBLE")
q.add("t", lambda: N.trunc(-c("l_extendedprice")), "trunc(-l_extendedprice)")
q.add("ce", lambda: N.ceil(c("l_extendedprice")), "ceil(l_extendedprice)")
q.add("fl", lambda: N.floor(-c("l_extendedprice")), "floor(-l_extendedprice)")
q.add("idiv", lambda: N.int_divide(-c("l_partkey"), F.lit(7)), "-l_partkey // 7")
q.add("dv", lambda: N.div(c("l_extendedprice"), F.lit(-7.0)).cast("double"), "trunc(l_extendedprice / -7.0)")
q.add("md", lambda: N.mod(-c("l_partkey"), F.lit(7)), "-l_partkey % 7")
q.add("ab", lambda: F.abs(-c("l_quantity")), "abs(-l_quantity)")

q = _Lazy("fn_math_powers", "part", "p_partkey", "Powers, roots and logarithms.")
for _n, _f, _s in (
    ("sq", lambda: F.round(N.sqrt(c("p_retailprice")), 9), "round(sqrt(p_retailprice), 9)"),
    ("cb", lambda: F.round(F.cbrt("p_retailprice"), 9), "round(cbrt(p_retailprice), 9)"),
    ("ln", lambda: F.round(N.ln(c("p_retailprice")), 9), "round(ln(p_retailprice), 9)"),
    ("lg", lambda: F.round(N.log(c("p_retailprice")), 9), "round(log10(p_retailprice), 9)"),
    ("ex", lambda: F.round(F.exp(c("p_size") / 10), 9), "round(exp(p_size / 10), 9)"),
    ("pw", lambda: F.power(c("p_size").cast("double"), F.lit(3.0)), "power(p_size, 3)::DOUBLE"),
    ("pi", lambda: F.round(F.pi(), 12), "round(pi(), 12)"),
    ("dg", lambda: F.round(F.degrees(c("p_size") / 10), 9), "round(degrees(p_size / 10), 9)"),
    ("ra", lambda: F.round(F.radians(c("p_size").cast("double")), 9), "round(radians(p_size), 9)"),
):
    q.add(_n, _f, _s)

q = _Lazy("fn_math_trig", "part", "p_partkey", "Trigonometry in radians and degrees.")
for _f in ("sin", "cos", "tan", "cot", "atan"):
    q.add(_f, lambda f=_f: F.round(getattr(F, f)(c("p_size").cast("double")), 8), f"round({_f}(p_size), 8)")
for _f in ("asin", "acos"):
    q.add(_f, lambda f=_f: F.round(getattr(F, f)(c("p_size") / 50), 8), f"round({_f}(p_size / 50), 8)")
    q.add(_f + "d", lambda f=_f: F.round(getattr(N, f + "d")(c("p_size") / 50), 7), f"round(degrees({_f}(p_size / 50)), 7)")
for _f in ("sin", "cos", "tan", "cot"):
    q.add(_f + "d", lambda f=_f: F.round(getattr(N, f + "d")(c("p_size").cast("double")), 8), f"round({_f}(radians(p_size)), 8)")
q.add("atand", lambda: F.round(N.atand(c("p_size").cast("double")), 7), "round(degrees(atan(p_size)), 7)")
q.add("at2", lambda: F.round(F.atan2(c("p_size").cast("double"), F.lit(3.0)), 8), "round(atan2(p_size, 3), 8)")
q.add("at2d", lambda: F.round(N.atan2d(c("p_size").cast("double"), F.lit(3.0)), 7), "round(degrees(atan2(p_size, 3)), 7)")

q = _Lazy("fn_math_hyper", "part", "p_partkey", "Hyperbolic functions.")
for _f in ("sinh", "cosh", "tanh", "asinh"):
    q.add(_f, lambda f=_f: F.round(getattr(F, f)(c("p_size") / 10), 8), f"round({_f}(p_size / 10), 8)")
q.add("acosh", lambda: F.round(N.acosh(c("p_size") + 1.0), 8), "round(acosh(p_size + 1), 8)")
q.add("atanh", lambda: F.round(N.atanh(c("p_size") / 60), 8), "round(atanh(p_size / 60), 8)")

q = _Lazy("fn_bitops", "part", "p_partkey", "Bit operators.")
q.add("a", lambda: c("p_partkey").bitwiseAND(c("p_size")), "p_partkey & p_size")
q.add("o", lambda: c("p_partkey").bitwiseOR(c("p_size")), "p_partkey | p_size")
q.add("x", lambda: N.bit_xor(c("p_partkey"), c("p_size")), "xor(p_partkey, p_size::BIGINT)")
q.add("n", lambda: F.bitwise_not("p_partkey"), "~p_partkey")
q.add("sl", lambda: F.shiftleft("p_partkey", 3), "p_partkey << 3")
q.add("sr", lambda: F.shiftright("p_partkey", 2), "p_partkey >> 2")

q = _Lazy("fn_cast_rounding", "lineitem", "l_orderkey", "Casts to integers round.")
q.add("line", lambda: c("l_linenumber"), "l_linenumber")
q.add("part", lambda: c("l_partkey"), "l_partkey")
q.add("i4", lambda: N.to_int(c("l_extendedprice")), "round_even(l_extendedprice, 0)::INT")
q.add("i8", lambda: N.to_int(c("l_quantity") / 2, "int8"), "round_even(l_quantity / 2, 0)::BIGINT")
q.add("nm", lambda: N.to_int((c("l_quantity") / 2).cast("decimal(10,1)"), "int8", numeric=True), "round((l_quantity / 2)::DECIMAL(10,1))::BIGINT")
q.add("tx", lambda: c("l_linenumber").cast("string"), "l_linenumber::VARCHAR")
q.add("bo", lambda: N.to_bool(c("l_linenumber") - 1), "(l_linenumber - 1)::BOOLEAN")
q.add("fl", lambda: c("l_quantity").cast("float"), "l_quantity::FLOAT")
q.add("de", lambda: c("l_discount").cast("decimal(6,3)").cast("double"), "l_discount::DECIMAL(6,3)::DOUBLE")

q = _Lazy("fn_date_trunc", "events", "event_id", "date_trunc, down to microseconds and up to millennia.")
for _f in ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade"):
    q.add(f"t_{_f}", lambda f=_f: D.date_trunc(f, c("ts")), f"date_trunc('{_f}', ts)")
q.add("t_century", lambda: D.date_trunc("century", c("ts")), "make_timestamp(((year(ts) - 1) // 100) * 100 + 1, 1, 1, 0, 0, 0)")
q.add("t_millennium", lambda: D.date_trunc("millennium", c("ts")), "make_timestamp(((year(ts) - 1) // 1000) * 1000 + 1, 1, 1, 0, 0, 0)")

q = _Lazy("fn_date_extract", "events", "event_id", "EXTRACT and date_part.")
for _f in ("year", "month", "day", "hour", "minute", "quarter", "week", "doy", "dow", "isodow", "isoyear", "decade", "century", "millennium", "microseconds"):
    q.add(f"e_{_f}", lambda f=_f: D.extract(f, c("ts")), f"extract({_f} FROM ts)::DOUBLE")
q.add("e_epoch", lambda: F.round(D.extract("epoch", c("ts")), 6), "round(epoch(ts), 6)")
q.add("e_second", lambda: F.round(D.extract("second", c("ts")), 6), "round(extract(microseconds FROM ts) / 1e6, 6)")
q.add("e_ms", lambda: F.round(D.extract("milliseconds", c("ts")), 3), "round(extract(microseconds FROM ts) / 1e3, 3)")

q = _Lazy("fn_date_bin", "events", "event_id", "date_bin.")
q.add("b15", lambda: D.date_bin(900_000_000, c("ts"), F.lit("2001-01-01 00:02:30").cast("timestamp_ntz")), "time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2001-01-01 00:02:30')")
q.add("b7d", lambda: D.date_bin(7 * 86_400_000_000, c("ts"), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")), "time_bucket(INTERVAL '7 days', ts, TIMESTAMP '2030-01-01 00:00:00')")

q = _Lazy("fn_date_arith", "orders", "o_orderkey", "Arithmetic on dates, timestamps and intervals.")
q.add("d", lambda: c("o_orderdate").cast("date"), "o_orderdate::DATE")
q.add("diff", lambda: F.datediff(c("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint"), "o_orderdate::DATE - DATE '1995-01-01'")
q.add("plus", lambda: F.date_add(c("o_orderdate").cast("date"), 45), "o_orderdate::DATE + 45")
q.add("minus", lambda: F.date_sub(c("o_orderdate").cast("date"), 45), "o_orderdate::DATE - 45")
q.add("months", lambda: D.add_interval(c("o_orderdate"), D.interval(1, 3, 4_500_000)), "o_orderdate + INTERVAL '1 month' + INTERVAL '3 days' + INTERVAL '4500 milliseconds'")
q.add("tsdays", lambda: D.subtract_timestamps(c("o_orderdate"), F.lit("1999-01-01 12:00:00").cast("timestamp_ntz"))["days"].cast("bigint"), "trunc(epoch(o_orderdate - TIMESTAMP '1999-01-01 12:00:00') / 86400)::BIGINT")
q.add("longer", lambda: D.interval_key(D.interval(1, 0, 0)) > D.interval_key(D.interval(0, 29, 0)), "INTERVAL '1 month' > INTERVAL '29 days'")
q.add("later", lambda: c("o_orderdate") > F.lit("1998-06-01").cast("date"), "o_orderdate > DATE '1998-06-01'")
q.add("epochdate", lambda: D.to_date_epoch(c("o_orderkey") % 20000 + 0.7), "DATE '1970-01-01' + (o_orderkey % 20000)::INT")
q.add("epochts", lambda: D.to_timestamp_epoch(c("o_orderkey") + 0.25).cast("timestamp_ntz"), "make_timestamp((o_orderkey * 1000000 + 250000)::BIGINT)")

q = _Lazy("fn_time_casts", "events", "event_id", "Times of day, with and without a zone.")
q.add("t", lambda: D.time_of_day(c("ts")), "strftime(ts, '%H:%M:%S.%f')")
q.add("u", lambda: D.time_in_utc(D.time_of_day(c("ts")), F.lit(150)), "strftime(ts - INTERVAL '150 minutes', '%H:%M:%S.%f')")

q = _Lazy("fn_to_char", "events", "event_id", "to_char.")
q.add("iso", lambda: D.to_char(c("ts"), "YYYY-MM-DD HH24:MI:SS.US"), "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')")
q.add("us", lambda: D.to_char(c("ts"), "MM/DD/YY HH12:MI AM"), "strftime(ts, '%m/%d/%y %I:%M %p')")
q.add("names", lambda: D.to_char(c("ts"), "FMMonth FMDay Mon Dy"), "strftime(ts, '%B %A %b %a')")
q.add("padded", lambda: D.to_char(c("ts"), "MONTH|day|"), "rpad(upper(strftime(ts, '%B')), 9, ' ') || '|' || rpad(lower(strftime(ts, '%A')), 9, ' ') || '|'")
q.add("bare", lambda: D.to_char(c("ts"), "FMDD.FMMM.YYYY FMHH24"), "day(ts) || '.' || month(ts) || '.' || year(ts) || ' ' || hour(ts)")
q.add("days", lambda: D.to_char(c("ts"), "DDD D ID IW IYYY Q W WW"), "strftime(ts, '%j') || ' ' || (dayofweek(ts) + 1) || ' ' || isodow(ts) || ' ' || lpad(week(ts)::VARCHAR, 2, '0') || ' ' || isoyear(ts) || ' ' || quarter(ts) || ' ' || ((day(ts) - 1) // 7 + 1) || ' ' || lpad(((dayofyear(ts) - 1) // 7 + 1)::VARCHAR, 2, '0')")
q.add("th", lambda: D.to_char(c("ts"), "FMDDth"), "day(ts) || CASE WHEN day(ts) BETWEEN 11 AND 13 THEN 'th' WHEN day(ts) % 10 = 1 THEN 'st' WHEN day(ts) % 10 = 2 THEN 'nd' WHEN day(ts) % 10 = 3 THEN 'rd' ELSE 'th' END")
q.add("quoted", lambda: D.to_char(c("ts"), '"at" HH24"h"MI, CC Y,YYY'), "'at ' || strftime(ts, '%Hh%M') || ', 21 2,024'")
q.add("ssss", lambda: D.to_char(c("ts"), "SSSS MS FF3"), "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))::VARCHAR || strftime(ts, ' %g %g')")

q = _Lazy("fn_array", "embeddings", "vec_id", "Array functions and operators.")
_e = lambda: F.slice("embedding", 1, 3)
q.add("app", lambda: A.array_append(_e(), c("label").cast("float")), "list_append(embedding[1:3], label::FLOAT)")
q.add("pre", lambda: A.array_prepend(c("label").cast("float"), _e()), "list_prepend(label::FLOAT, embedding[1:3])")
q.add("cat", lambda: A.array_cat(_e(), F.slice("embedding", 4, 2)), "embedding[1:3] || embedding[4:5]")
q.add("len", lambda: A.array_length(c("embedding")).cast("bigint"), "len(embedding)")
q.add("empty", lambda: A.array_length(F.slice("embedding", 1, 0)).cast("bigint"), "NULL::BIGINT")
q.add("card", lambda: A.cardinality(c("embedding")).cast("bigint"), "len(embedding)")
q.add("has", lambda: A.contains(F.array(F.lit(1), F.lit(2), c("label")), F.array(F.lit(2), F.lit(3))), "list_has_all([1, 2, label], [2, 3])")
q.add("isin", lambda: A.contained_by(F.array(c("label")), F.array(F.lit(2), F.lit(3))), "list_has_all([2, 3], [label])")
q.add("meet", lambda: A.overlaps(F.array(c("label"), F.lit(None)), F.array(F.lit(2), F.lit(3))), "list_has_any([label], [2, 3])")
q.add("pos", lambda: A.array_position(F.array(F.lit(5), c("label")), c("label")).cast("bigint"), "list_position([5, label], label)::BIGINT")
q.add("less", lambda: F.array(c("label"), F.lit(1)) < F.array(F.lit(3), F.lit(0)), "[label, 1] < [3, 0]")
q.add("str", lambda: A.array_to_string(F.array(c("label"), F.lit(None), F.lit(7)).cast("array<string>"), ",", "?"), "array_to_string([label::VARCHAR, '?', '7'], ',')")
q.add("trim", lambda: A.trim_array(F.slice("embedding", 1, 3), 2), "embedding[1:1]")
q.add("gone", lambda: A.array_remove(F.array(F.lit(1), F.lit(2), F.lit(1)), F.lit(1)), "[2]")

q = _Lazy("fn_json", "events", "event_id", "JSON operators.")
q.add("k", lambda: J.get_text(c("props"), "k"), "props->>'k'")
q.add("none", lambda: J.get_text(c("props"), "zz"), "props->>'zz'")
q.add("obj", lambda: J.get_json(c("props"), "k"), "(props->'k')::VARCHAR")
q.add("el", lambda: J.get_text(F.concat(F.lit("[1,"), J.get_text(c("props"), "k"), F.lit("]")), 1), "props->>'k'")
q.add("last", lambda: J.get_text(F.concat(F.lit("[1,"), J.get_text(c("props"), "k"), F.lit("]")), -1), "props->>'k'")
q.add("n", lambda: J.array_length(F.lit("[1,2,{}]")), "json_array_length('[1,2,{}]')::BIGINT")
q.add("ok", lambda: J.is_json(c("props")), "json_valid(props)")
q.add("num", lambda: J.get_text(c("props"), "k").cast("int") + 1, "(props->>'k')::INT + 1")

q = _Lazy("fn_map", "customer", "c_custkey", "Map functions.")
_m = lambda: M.create(F.array(F.lit("seg"), c("c_mktsegment")), F.array(c("c_nationkey"), F.lit(7)))
_ms = "map(['seg', c_mktsegment], [c_nationkey, 7])"
q.add("seg", lambda: M.extract(_m(), "seg"), f"{_ms}['seg']")
q.add("dyn", lambda: M.extract(_m(), c("c_mktsegment")), f"{_ms}[c_mktsegment]")
q.add("none", lambda: M.extract(_m(), "absent"), f"{_ms}['absent']")
q.add("n", lambda: M.cardinality(_m()).cast("bigint"), "2::BIGINT")

q = _Lazy("fn_encode_decode", "region", "r_regionkey", "encode and decode.")
q.add("hex", lambda: X.encode(c("r_name").cast("binary"), "hex"), "lower(hex(r_name))")
q.add("b64", lambda: X.encode(c("r_name").cast("binary"), "base64"), "base64(encode(r_name))")
q.add("unhex", lambda: X.decode(F.lower(F.hex("r_name")), "hex").cast("string"), "r_name")
q.add("un64", lambda: X.decode(F.base64("r_name"), "base64").cast("string"), "r_name")
q.add("cat", lambda: F.concat(c("r_name").cast("binary"), c("r_name").cast("binary")).cast("string"), "r_name || r_name")


@R.add("fn_map_entries", "SELECT n_nationkey, unnest(['a', 'b']) AS key, unnest([n_regionkey, n_nationkey]) AS value FROM nation")
def fn_map_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of a map as rows."""
    m = M.create(F.array(F.lit("a"), F.lit("b")), F.array("n_regionkey", "n_nationkey"))
    return table(spark, sf, "nation").select("n_nationkey", M.entries(m))


@R.add("fn_generate_series", "SELECT n_nationkey, unnest(generate_series(n_nationkey, 10, 3))::INT AS x FROM nation")
def fn_generate_series(spark: SparkSession, sf: str) -> DataFrame:
    """A series that keeps its type; none where the step leads away."""
    return table(spark, sf, "nation").select("n_nationkey", D.generate_series(F.col("n_nationkey"), F.lit(10), F.lit(3)).alias("x"))


@R.add("fn_generate_series_ts", "SELECT o_orderkey, unnest(generate_series(o_orderdate, TIMESTAMP '1995-06-01 00:00:00', INTERVAL '1 month')) AS x FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-20 00:00:00' AND day(o_orderdate) < 28")
def fn_generate_series_ts(spark: SparkSession, sf: str) -> DataFrame:
    """A series of timestamps by an interval."""
    o = table(spark, sf, "orders").filter("o_orderdate < TIMESTAMP_NTZ '1995-03-20 00:00:00' AND day(o_orderdate) < 28")
    return o.select("o_orderkey", D.generate_series_ts(F.col("o_orderdate"), F.lit("1995-06-01").cast("timestamp_ntz"), months=1).alias("x"))


@R.add("fn_unnest", "SELECT vec_id, unnest(embedding[1:5]) AS x FROM embeddings")
def fn_unnest(spark: SparkSession, sf: str) -> DataFrame:
    """The elements of an array as rows."""
    return table(spark, sf, "embeddings").select("vec_id", A.unnest(F.slice("embedding", 1, 5)).alias("x"))


@R.add("fn_time_zone", "SELECT event_id, ts + INTERVAL '2 hours' AS there FROM events")
def fn_time_zone(spark: SparkSession, sf: str) -> DataFrame:
    """A UTC time as the local time of a zone with a fixed offset."""
    return table(spark, sf, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("+02:00"), F.col("ts")).alias("there"))


@R.add("fn_interval_storage", "SELECT event_id, (user_id % 5)::INT AS months, (user_id % 40)::INT AS days, ((user_id % 5) * 30 + user_id % 40) > 60 AS long FROM events")
def fn_interval_storage(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals as structs, compared with months of 30 days."""
    i = D.interval((F.col("user_id") % 5).cast("int"), (F.col("user_id") % 40).cast("int"))
    return table(spark, sf, "events").select("event_id", i["months"].alias("months"), i["days"].alias("days"), (D.interval_key(i) > D.interval_key(D.interval(2))).alias("long"))


@R.add("fn_udf_surface", "SELECT p_partkey, p_size * 2 + 1 AS scalar, length(p_name)::BIGINT AS viasql FROM part")
def fn_udf_surface(spark: SparkSession, sf: str) -> DataFrame:
    """User functions: an Arrow-batched Python function and a SQL function."""
    @F.pandas_udf("int")
    def odd(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION name_length(s STRING) RETURNS BIGINT RETURN length(s)")
    table(spark, sf, "part").select("p_partkey", "p_name", odd("p_size").alias("scalar")).createOrReplaceTempView("part_odd")
    return spark.sql("SELECT p_partkey, scalar, name_length(p_name) AS viasql FROM part_odd")


@R.add("fn_udtf_and_grouped", "SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS spread, o_custkey % 3 AS i FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_custkey")
def fn_udtf_and_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """A grouped Arrow-batched aggregate and a table function."""

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    @F.udtf(returnType="i bigint")
    class Remainder:
        def eval(self, k: int):
            if k % 3:
                yield (k % 3,)

    spark.udtf.register("remainder", Remainder)
    table(spark, sf, "orders").groupBy("o_custkey").agg(spread("o_totalprice").alias("spread")).createOrReplaceTempView("order_spread")
    return spark.sql("SELECT o_custkey, spread, i FROM order_spread, LATERAL remainder(o_custkey)")
