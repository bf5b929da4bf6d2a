import random

import pytest

from lakeloom.llm import truncation as T


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("", T.WHOLE), ("   \n", T.WHOLE), ("All is well.", T.WHOLE), ('He said "no."', T.WHOLE), ("Is it?", T.WHOLE), ("Code:\n```\nselect 1\n```", T.WHOLE), ("Code:\n```\nselect 1", T.CUT),
        ("A tag <a hre", T.CUT), ("An entity &quo", T.CUT), ("Half a char �", T.CUT), ("| a | 1 |", T.WHOLE), ("| a | 1", T.CUT), ("It is a done thing. [more]", T.WHOLE), ("It is a do…", T.PROSE), ("It is done...", T.PROSE), ("Well. More soon [...]", T.PROSE), ("All is well.\n\n(end)", T.WHOLE), ("(end)", T.WHOLE),
        ("Well.\n- one more thing", T.LISTED), ("It is a do", T.PROSE), ("Well.\n\n-- night crew", T.PROSE),
    ],
)
def test_verdict_by_form(text, verdict):
    assert T.look(text)[0] == verdict


def test_sketches_of_a_head_meet_whatever_is_cut_off():
    rng = random.Random(2)
    w = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    for n in (20, 70, 150, 399):
        assert set(T.sketch(w)) & set(T.sketch(w[:n]))
    other = [f"v{rng.randint(0, 5000)}" for _ in range(400)]
    assert not set(T.sketch(w)) & set(T.sketch(other)) and T.sketch(w[:15]) == [] and len(T.sketch(w[:16])) == T.BANDS


def test_shingles_of_short_texts():
    assert len(T.shingles(["a"])) == len(T.shingles(list("abcde"))) == 1 and len(T.shingles(list("abcdefg"))) == 3 and len(T.shingles([])) == 1


def sentences(rng, n):
    return [f"The {rng.choice(['loader', 'reader', 'writer', 'planner'])} {rng.choice(['found', 'missed', 'moved'])} {rng.randint(2, 99)} {rng.choice(['files', 'rows', 'pages'])} {rng.choice(['in time', 'after the release', 'before noon', 'on both sides'])}" for _ in range(n)]


def test_ends_early():
    text = ". ".join(sentences(random.Random(4), 20)) + "."
    assert T.ends_early(text[: len(text) * 2 // 3].rstrip(". "), text) or text[len(text) * 2 // 3] in ". "
    assert not T.ends_early(text, text) and not T.ends_early(text, text[:200]) and not T.ends_early("short one", text)
    half = ". ".join(text.split(". ")[:9]) + "."
    assert not T.ends_early(half, text)  # stops at a full stop
    assert T.ends_early(half[:-4], text) and not T.ends_early("x " * 60, text)


def corpus(rng, n):
    out = []
    for i in range(n):
        s = sentences(rng, rng.randint(4, 9))
        kind = i % 5
        if kind == 0:
            text, cut = ". ".join(s) + ".", False
        elif kind == 1:
            text, cut = "Notes.\n- " + "\n- ".join(s), False
        elif kind == 2:
            text, cut = ". ".join(s) + ".\n\nYours, the crew", False
        else:
            whole = ". ".join(s) + "." if kind == 3 else "Notes.\n- " + "\n- ".join(s)
            at = rng.randint(len(whole) // 2, len(whole) - 30)
            while not (whole[at - 1].isalpha() and whole[at].isalpha()):
                at -= 1
            text, cut = whole[:at], True
        out.append((i, text, ["A-b", "a_b", None][i % 3], cut))
    return out


def test_found_and_shares(spark):
    rows = corpus(random.Random(6), 900)
    rows += [(2000, None, "n", False), (2001, "", "n", False), (2002, rows[3][1], "copy", True), (2003, "done. " * 30_000, "n", False)]
    df = spark.createDataFrame([(*r[:3], "clash", 1) for r in rows], "doc_id bigint, text string, source string, verdict string, words int").repartition(3)
    df = df.unionAll(df.filter("doc_id < 20"))  # repeated rows
    found = [r[0] for r in T.cut_texts(df).collect()]
    assert len(found) == len(set(found))
    want = {r[0] for r in rows if r[3]}
    hit = len(want & set(found))
    assert hit / len(want) >= 0.97 and hit / len(found) >= 0.97
    s = {r["source"]: r for r in T.cut_shares(df, T.cut_texts(df)).collect()}
    assert set(s) == {"a_b", None, "n", "copy"} and s["copy"]["cut_share"] == 1.0 and s["n"]["cut"] == 0


def test_near_copies_tell_list_entries_that_look_whole(spark):
    rng = random.Random(9)
    whole = "Notes.\n- " + "\n- ".join(sentences(rng, 12)) + "\n- The loader found 12 files on both sides of the canal. And that was all."
    cut = whole[: whole.index(" of the canal")]
    df = spark.createDataFrame([(1, whole), (2, cut), (3, cut), (4, "\n- ".join(["Other."] + sentences(rng, 9)))], "doc_id bigint, text string")
    assert sorted(r[0] for r in T.cut_by_copies(df).collect()) == [2, 3]


def test_a_copy_is_found_behind_a_longer_text_with_the_same_head(spark):
    rng = random.Random(3)
    w = lambda c, n: " ".join(f"{c}{rng.randint(0, 9999)}" for _ in range(n))
    head = w("h", 32)
    copy = head + " " + w("b", 28)
    rows = [(1, " ".join(copy.split()[:40])), (2, copy), (3, " ".join(copy.split()[:39]) + " " + copy.split()[39][:-1]), *[(10 + i, head + " " + w(f"c{i}x", 168 + i)) for i in range(5)]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r[0] for r in T.cut_by_copies(df).collect()) == [1, 3]


def test_a_closed_text_is_not_judged_by_a_cut_one_of_the_same_words(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60))
    cut = " ".join(text.split()[:40])
    df = spark.createDataFrame([(1, cut + "."), (2, cut), (3, text), (4, cut)], "doc_id bigint, text string")
    assert sorted(r[0] for r in T.cut_by_copies(df).collect()) == [2, 4]


def test_empty_table(spark):
    assert T.cut_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_tokens_and_their_shapes():
    assert [T.token(t) for t in ("loader", "v2", "a.b_c", "a.b_c_0042", "1234", "ab12cd34", "3141592653")] == ["loader", "<mixed 2>", "a.b_c", "a.a_a_0000", "0000", "<mixed 8>", "<mixed 10>"]
    assert [T.kind(t) for t in ("loader", "17", "v2", "a.b_c", "valid_to", "3141592653", ".")] == ["loader", T.NUMBER, T.NAME, T.NAME, T.NAME, T.NAME, "."]
    assert T.shape_key("loader") is None and T.shape_key("a.b_c_0042") == T.shape_key("x.yy_z_9999") != T.shape_key("x.yy_z_99")


def test_verdicts_do_not_depend_on_how_often_the_corpus_is_copied(spark):
    rows = corpus(random.Random(12), 400)
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id bigint, text string")
    ids = lambda d: {r[0] for r in T.cut_texts(d).collect()}
    one = ids(df)
    many = ids(df.selectExpr("explode(sequence(0, 6)) AS copy", "doc_id", "text").selectExpr("doc_id + copy * 10000 AS doc_id", "text"))
    assert {i for i in many if i < 10000} == one and len(many) == 7 * len(one)


def test_recall_of_cut_near_copies(spark):
    """Cut copies of texts that were edited elsewhere: at least nine in ten are found beside their whole, none that is whole."""
    rng, rows, want = random.Random(5), [], set()
    for i in range(150):
        s = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(6, 14))) for _ in range(14)]
        whole = ". ".join(s) + "."
        w = whole.split()
        edited = w[:]
        edited[rng.randint(40, len(w) - 1)] = "changed"
        rows.append((i, " ".join(edited)))
        at = rng.randint(30, len(w) - 2)
        if w[at].endswith("."):
            at -= 1
        rows.append((1000 + i, " ".join(w[:at]) + " " + w[at][: rng.choice([1, 2, 50])]))
        want.add(1000 + i)
        rows.append((2000 + i, ". ".join(s[:7]) + "."))  # ends with a sentence: whole by its form
    found = {r[0] for r in T.cut_by_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(found & want) >= 0.9 * len(want) and found <= want


def test_sign_offs_links_and_names_at_the_end(spark):
    rng, rows, want = random.Random(11), [], set()
    ends = ["-- night crew", "Thanks, the team", "EOF", "More next week...", "See also: a.shop_items_{:06d}, b.desk_rows_{:06d}", "s3://lake/notes/{:010x}", "(end of note)"]
    for i in range(600):
        s = sentences(rng, rng.randint(3, 6))
        if i % 4 == 0:
            text = ". ".join(s)
            at = rng.randint(len(text) - 40, len(text) - 2)
            while not (text[at - 1].isalpha() and text[at].isalpha()):
                at -= 1
            text = text[:at]
            want.add(i)
        else:
            e = ends[i % len(ends)]
            text = ". ".join(s) + ".\n\n" + e.format(*[rng.randint(0, 900_000) for _ in range(e.count("{"))])
        rows.append((i, text))
    found = {r[0] for r in T.cut_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.02 * len(found)
