import datetime
import math

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import arrays as A
from lakeloom.functions import dates as D
from lakeloom.functions import json as J
from lakeloom.functions import maps as M
from lakeloom.functions import numbers as N
from lakeloom.functions import text as X


def one(spark, make, schema="x int", value=(1,)):
    return spark.createDataFrame([value], schema).select(make().alias("v")).first()[0]


def text(spark, s, make):
    return one(spark, lambda: make(F.col("s")), "s string", (s,))


@pytest.mark.parametrize(
    ("s", "make", "want"),
    [
        ("hello", lambda c: X.substr(c, -1, 4), "he"), ("hello", lambda c: X.substr(c, 0), "hello"), ("hello", lambda c: X.substr(c, 2, 0), ""), (None, lambda c: X.substr(c, 1, 2), None), ("", lambda c: X.left(c, -3), ""),
        ("abc", lambda c: X.right(c, -5), ""), ("abc", lambda c: X.right(c, 9), "abc"), ("hi THOMAS o'neil-x é1a", lambda c: X.initcap(c), "Hi Thomas O'Neil-X é1a"), ("a.b.c", lambda c: X.split_part(c, ".", -1), "c"),
        ("abcabc", lambda c: X.regexp_replace(c, "b", "$1"), "a$1cabc"), ("xxabc\nabc", lambda c: X.regexp_replace(c, "(a)(b)", "[\\2\\1]"), "xx[ba]c\nabc"), ("aAa", lambda c: X.regexp_replace(c, "a", "-", "gi"), "---"),
        ("abc", lambda c: X.regexp_replace(c, "B", "<\\&>", "i"), "a<b>c"), ("xyxtrimyyx", lambda c: X.btrim(c, "xyz"), "trim"), ("abc", lambda c: X.lpad(c, 2), "ab"), ("abc", lambda c: X.lpad(c, 5, ""), "abc"), (None, lambda c: X.concat(c, F.lit("z")), "z"),
        ("6869", lambda c: X.decode(c, "hex").cast("string"), "hi"), ("ab", lambda c: X.bpchar(c, 4), "ab  "),
    ],
)
def test_text(spark, s, make, want):
    assert text(spark, s, make) == want


def test_text_errors(spark):
    with pytest.raises(Exception, match="negative substring"):
        text(spark, "a", lambda c: X.substr(c, 1, -1))
    with pytest.raises(Exception, match="null character"):
        one(spark, lambda: X.chr_(F.col("x") - 1))
    with pytest.raises(ValueError, match="unrecognized encoding"):
        X.encode(F.col("a"), "escape")
    assert one(spark, lambda: X.chr_(F.col("x") + 128511)) == "😀"


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda x: N.round_(x), 2.0), (lambda x: N.round_(x.cast("decimal(5,1)"), numeric=True).cast("double"), 3.0), (lambda x: N.to_int(x), 2), (lambda x: N.to_int(x.cast("decimal(5,1)"), numeric=True), 3), (lambda x: N.trunc(-x), -2.0),
        (lambda x: N.div(-x, F.lit(1.0)).cast("double"), -2.0), (lambda x: N.int_divide(F.lit(-7), F.lit(2)), -3), (lambda x: N.mod(F.lit(-7), F.lit(3)), -1), (lambda x: N.sqrt(x * 10), 5.0), (lambda x: N.log(x * 40), 2.0),
    ],
)
def test_numbers(spark, make, want):
    got = one(spark, lambda: make(F.col("x")), "x double", (2.5,))
    assert got == want


@pytest.mark.parametrize("make", [lambda x: N.sqrt(-x), lambda x: N.ln(x - x), lambda x: N.log(-x), lambda x: N.acosh(x - 2), lambda x: N.atanh(x)])
def test_number_errors(spark, make):
    with pytest.raises(Exception, match="out of range|cannot take"):
        one(spark, lambda: make(F.col("x")), "x double", (2.5,))


TS = datetime.datetime(2001, 2, 28, 3, 4, 5, 678901)


def ts(spark, make, value=TS):
    return one(spark, lambda: make(F.col("t")), "t timestamp_ntz", (value,))


def test_dates(spark):
    assert ts(spark, lambda t: D.date_trunc("century", t)) == datetime.datetime(2001, 1, 1)
    assert ts(spark, lambda t: D.date_trunc("millennium", t), datetime.datetime(2000, 5, 5)) == datetime.datetime(1001, 1, 1)
    assert ts(spark, lambda t: D.date_trunc("decade", t)) == datetime.datetime(2000, 1, 1)
    assert ts(spark, lambda t: D.date_bin(900_000_000, t, F.lit("2020-01-01 00:07:00").cast("timestamp_ntz"))) == datetime.datetime(2001, 2, 28, 2, 52)
    assert ts(spark, lambda t: D.add_interval(t, D.interval(12 * 3 + 0, 1, 1))) == datetime.datetime(2004, 2, 29, 3, 4, 5, 678902)
    assert ts(spark, lambda t: D.add_interval(t, D.interval(-12, 0, 0)), datetime.datetime(2004, 2, 29)) == datetime.datetime(2003, 2, 28)
    assert ts(spark, lambda t: D.extract("epoch", t), datetime.datetime(1969, 12, 31, 23, 59, 59, 500000)) == -0.5
    assert ts(spark, lambda t: D.extract("dow", t), datetime.datetime(2024, 1, 7)) == 0.0 and ts(spark, lambda t: D.extract("isodow", t), datetime.datetime(2024, 1, 7)) == 7.0
    assert ts(spark, lambda t: D.extract("year", t), None) is None
    with pytest.raises(ValueError, match="stride"):
        D.date_bin(0, F.col("t"), F.col("t"))


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("YYYY-MM-DD", "2001-02-28"), ("FMMonth FMDDth", "February 28th"), ("Day|DY", "Wednesday|WED"), ("HH12:MI:SS p.m.", "03:04:05 a.m."), ('"YYYY" YY', "YYYY 01"), ("SSSS MS US FF2", "11045 678 678901 67"),
        ("IYYY-IW-ID", "2001-09-3"), ("CC Q W WW DDD J".replace(" J", ""), "21 1 4 09 059"), ("yyyy/mm/dd hh24", "2001/02/28 03"), ("BC b.c. A.D.", "AD a.d. A.D."), ("Y,YYY", "2,001"), ("TZH:TZM", "+00:00"), ("", ""),
    ],
)
def test_to_char(spark, template, want):
    assert ts(spark, lambda t: D.to_char(t, template)) == want


def test_to_char_suffixes_and_refusals(spark):
    assert ts(spark, lambda t: D.to_char(t, "FMDDDth"), datetime.datetime(2001, 4, 21)) == "111st"
    assert ts(spark, lambda t: D.to_char(t, "DDTH"), datetime.datetime(2001, 4, 12)) == "12TH"
    for bad in ("J", "RM", "TZ"):
        with pytest.raises(NotImplementedError):
            D.to_char(F.col("t"), bad)


def test_intervals_compare_on_thirty_day_months(spark):
    key = lambda *a: one(spark, lambda: D.interval_key(D.interval(*a)))
    assert key(1, 0, 0) == key(0, 30, 0) > key(0, 29, 86_399_999_999) and key(-1, 0, 0) < key(0, 0, 0)
    d = ts(spark, lambda t: D.subtract_timestamps(t, F.lit("2001-03-01 00:00:00").cast("timestamp_ntz")))
    assert (d["months"], d["days"], d["microseconds"]) == (0, 0, -75354321099)


def test_series(spark):
    rows = spark.createDataFrame([(1, 4, 2), (4, 1, 2), (4, 1, -2), (3, 3, 1)], "a int, b int, s int")
    got = [(r[0], r[1]) for r in rows.select("a", D.generate_series(F.col("a"), F.col("b"), F.col("s")).alias("x")).collect()]
    assert got == [(1, 1), (1, 3), (4, 4), (4, 2), (3, 3)]
    with pytest.raises(Exception, match="zero"):
        rows.select(D.generate_series(F.col("a"), F.col("b"), F.col("s") * 0)).collect()


def test_arrays(spark):
    df = spark.createDataFrame([([1, None, 2], [2]), (None, [1]), ([], []), (None, None)], "a array<int>, b array<int>")
    got = lambda make: [r[0] for r in df.select(make(F.col("a"), F.col("b"))).collect()]
    assert got(lambda a, b: A.array_cat(a, b)) == [[1, None, 2, 2], [1], [], None]
    assert got(lambda a, b: A.array_append(a, F.lit(9))) == [[1, None, 2, 9], [9], [9], [9]]
    assert got(lambda a, b: A.array_length(a)) == [3, None, None, None] and got(lambda a, b: A.cardinality(a)) == [3, None, 0, None]
    assert got(lambda a, b: A.contains(a, b)) == [True, False, True, None]
    assert got(lambda a, b: A.overlaps(a, b)) == [True, None, False, None]
    assert got(lambda a, b: A.subscript(a, 0)) == [None] * 4 and got(lambda a, b: A.subscript(a, 3)) == [2, None, None, None]
    assert got(lambda a, b: A.array_replace(a, F.lit(None).cast("int"), F.lit(0)))[0] == [1, 0, 2]


def test_array_agg_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 1, 5), (1, 2, 5)], "g int, o int, v int")
    assert df.groupBy("g").agg(A.array_agg(F.col("v"), F.col("o"))).first()[1] == [5, 5, None]
    assert df.filter("g = 2").agg(A.array_agg(F.col("v"))).first()[0] is None


def test_json_and_maps(spark):
    j = '{"a": {"b": [1, null]}, "x\'y": "t", "n": null}'
    get = lambda make: text(spark, j, make)
    assert get(lambda c: J.get_text(c, "x'y")) == "t" and get(lambda c: J.get_text(c, "n")) is None and get(lambda c: J.get_json(c, "a")) == '{"b":[1,null]}'
    assert text(spark, "[1,2,3]", lambda c: J.get_text(c, -2)) == "2" and text(spark, "[1]", lambda c: J.get_text(c, -2)) is None
    assert text(spark, "{oops", lambda c: J.is_json(c)) is False and text(spark, None, lambda c: J.is_json(c)) is None
    m = M.create(F.array(F.lit("k")), F.array(F.lit(None).cast("int")))
    assert one(spark, lambda: M.extract(m, "k")) is None and one(spark, lambda: M.cardinality(m)) == 1


def test_trigonometry_in_degrees(spark):
    x = lambda make: one(spark, lambda: make(F.col("x")), "x double", (60.0,))
    assert math.isclose(x(N.cosd), 0.5) and math.isclose(x(lambda c: N.asind(c / 120)), 30) and math.isclose(x(lambda c: N.atan2d(c, c)), 45)


def test_parts_of_intervals(spark):
    part = lambda f, *a: one(spark, lambda: D.extract_interval(f, D.interval(*a)))
    assert [part(f, -27, 5, 3_723_500_000) for f in ("year", "month", "day", "hour", "minute", "second")] == [-2.0, -3.0, 5.0, 1.0, 2.0, 3.5]
    assert part("epoch", 13, 1, 500_000) == 31557600 + 2592000 + 86400 + 0.5
    cut = one(spark, lambda: D.date_trunc_interval("hour", D.interval(14, 3, 7_300_000_000)))
    assert tuple(cut) == (14, 3, 7_200_000_000) and tuple(one(spark, lambda: D.date_trunc_interval("year", D.interval(14, 3, 7)))) == (12, 0, 0)
    assert one(spark, lambda: D.time_in_utc(F.lit("00:30:00"), F.lit(60))) == "23:30:00.000000"


def test_percentiles_of_groups(spark):
    import numpy as np
    import pytest

    from lakeloom.operators.relational import percentiles

    rows = [(g, None if i % 9 == 0 else float((i * 7) % 23)) for g in ("a", "b", None) for i in range(40)] + [("only", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in percentiles(df, ["g"], "v", [0.0, 0.33, 0.5, 1.0]).collect()}
    assert set(got) == {"a", "b", None, "only"} and got["only"] == [5.0] * 4
    for g in ("a", "b", None):
        assert np.allclose(got[g], np.percentile([v for k, v in rows if k == g and v is not None], [0, 33, 50, 100]))
    assert percentiles(df, [], "v", [0.5]).count() == 1 and percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        percentiles(df, ["g"], "v", [1.5])
