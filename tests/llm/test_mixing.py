import random

import pytest

from lakeloom.llm.mixing import mix, shares
from lakeloom.llm.tokens import encoder, with_token_counts

DOCS = "doc_id bigint, text string, source string, tokens string, mix_id int"
TARGETS = "mix_id string, source string, target_share double, max_repeats int, size_ratio double"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)


def test_counts_are_those_of_the_tokenizer(spark):
    from lakeloom.llm.tokens import VOCABULARY

    texts = ["", None, "plain words here", "<|endoftext|> ünïcode 123,456\n\n\tx", "a" * 5000]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["n"] for r in with_token_counts(df, ["doc_id"], "text", name="n").collect()}
    enc = encoder(VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)} and got[0] == got[1] == 0 and got[3] > 8


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(1, 40), rng.choice(["Big-Source", " big_source", "BIG SOURCE"])) for i in range(600)]
    rows += [(1000 + i, "word " * rng.randint(1, 40), "small") for i in range(30)] + [(2000, None, "small"), (2001, "", "small"), (2002, "word word", None), (2003, "other", "unused")]
    return docs(spark, rows)


def test_budgets_repeats_and_shares(spark, many):
    targets = spark.createDataFrame([("m", "big_source", 0.5, 3, 0.4), ("m", "small", 0.5, 3, 0.4), ("m", "absent", 0.0, 1, 0.4), ("n", "small", 1.0, 9, 0.1), ("m", "small", 0.5, 3, 0.4)], TARGETS)
    chosen, budgets = mix(many, targets)
    rows = chosen.collect()
    assert all(1 <= r["repeats"] <= 3 for r in rows if r["mix_id"] == "m")
    assert len({(r["mix_id"], r["doc_id"]) for r in rows}) == len(rows) and not {2000, 2001, 2002, 2003} & {r["doc_id"] for r in rows}
    s = {(r["mix_id"], r["source"]): r for r in shares(chosen, budgets).collect()}
    big, small, absent, only = s["m", "big_source"], s["m", "small"], s["m", "absent"], s["n", "small"]
    assert abs(big["reached_tokens"] - big["wanted_tokens"]) <= 21 and not big["capped"]
    assert small["capped"] and small["reached_tokens"] == 3 * sum(r["tokens"] for r in rows if r["mix_id"] == "m" and r["source"] == "small")
    assert (absent["documents"], absent["reached_tokens"]) == (0, 0)
    assert abs(only["reached_tokens"] - only["wanted_tokens"]) <= 21 and only["reached_share"] == 1.0
    assert sum(r["tokens"] * r["repeats"] for r in rows if r["mix_id"] == "n") == only["reached_tokens"]
    repeats = [r["repeats"] for r in rows if r["mix_id"] == "n"]
    assert max(repeats) - min(repeats) <= 1


def test_same_choice_every_time(spark, many):
    targets = spark.createDataFrame([("m", "big_source", 1.0, 1, 0.2)], TARGETS)
    pick = lambda d: sorted(r["doc_id"] for r in mix(d, targets)[0].collect())
    assert pick(many) == pick(many.repartition(7))


def test_empty_tables_and_null_targets(spark, many):
    none = spark.createDataFrame([], TARGETS)
    assert mix(many, none)[0].count() == 0
    some = spark.createDataFrame([("m", "small", 1.0, 2, 0.5), ("m", None, 0.5, 1, 0.5), ("q", "small", None, 2, 0.5)], TARGETS)
    assert mix(docs(spark, []), some)[0].count() == 0
    assert {r["mix_id"] for r in mix(many, some)[0].collect()} == {"m"}
