import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeloom.llm import contamination as C

WORDS = ["the", "of", "a", "crate", "line", "Ärger", "42", "x_y", "ﬁne", "rope", "gate", "tin"]


def brute(docs, items, n=13):
    runs = lambda t: {tuple(w[k : k + n]) for w in [C.words(t)] for k in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, u in items if runs(t) & runs(u)}


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    return {tuple(r) for r in C.leaked_items(d, spark.createDataFrame(items, "item_id bigint, text string"), **options).collect()}


def test_words():
    assert C.words("Ｆoo_BAR, ﬁx-42é\n²x") == ["foo", "bar", "fix", "42é", "2x"] and C.words(None) == C.words("_ -") == []


def random_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, random_text(rng, rng.randint(5, 60))) for i in range(60)]
    docs = [(None if k == 7 else k, random_text(rng, rng.randint(0, 120))) for k in range(150)]
    for k in range(150, 320):  # runs of 10 to 16 words of an item at any place
        w = rng.choice(items)[1].split()
        at, n = rng.randint(0, max(len(w) - 1, 0)), rng.randint(10, 16)
        docs.append((k, f"{random_text(rng, rng.randint(0, 40))} {'; '.join(w[at : at + n]).upper()} {random_text(rng, rng.randint(0, 40))}"))
    docs += [(900, None), (901, ""), (902, " ".join(items[0][1].split() * 400))]
    want = brute(docs, items)
    assert len(want) > 40 and found(spark, docs, items) == want
    assert found(spark, docs + docs[:20], items, shard_items=25) == want


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_retrieval_misses_no_shared_run(seed, n):
    rng = random.Random(seed)
    items = [(i, C.words(random_text(rng, rng.randint(1, 20)))) for i in range(rng.randint(1, 12))]
    texts = [C.words(random_text(rng, rng.randint(0, 40))) for _ in range(4)]
    index = C.Index(items, n, block=3)
    import numpy as np

    ids = np.array([index.vocabulary.get(w, len(index.vocabulary)) for t in texts for w in t], np.int64)
    got = {(d, index.items[i][0]) for d, _, _, i in index.retrieve(ids, np.array([len(t) for t in texts]))}
    runs = lambda w: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    assert {(d, i) for d, t in enumerate(texts) for i, u in items if runs(t) & runs(u)} <= got


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c")]) == set() == found(spark, [(1, "a " * 50)], [])
    assert found(spark, [(1, "a " * 50)], [(1, None), (2, "")]) == set()


def test_how_far_a_leak_goes(spark):
    item = " ".join(f"w{i}" for i in range(30))
    w = item.split()
    docs = [(1, "x " + item + " y"), (2, " ".join(w[:14])), (3, " ".join(w[16:])), (4, " ".join(w[5:18] + ["x"] + w[9:23]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r[0]: tuple(r)[2:] for r in C.leaked_items(df, spark.createDataFrame([(7, item)], "item_id bigint, text string"), detail=True).collect()}
    assert got == {1: (30, 30, True, True), 2: (14, 30, True, False), 3: (14, 30, False, True), 4: (18, 30, False, False)}
