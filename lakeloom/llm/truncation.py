"""Texts that were cut off before their end.

Two ways, in this order:

* Near-copies. Min-hash bands over the shingles of each text's head, at head lengths of
  16, 32, 64, ... words, bring a cut text and its longer copy into one bucket whatever was
  cut off. Within a bucket each text meets every longer one that holds the words before
  its end at about that place and goes on there, found by a hash of these words. Pairs whose
  heads have a similarity of 0.8 or more in five-word shingles are aligned at the shorter
  one's end; where the longer copy goes on in the middle of a word or sentence, the
  shorter one was cut.
* Closing words. A text without such a copy is judged by its end. Markup, a table row or
  a code block left open is a cut. A last line with a full stop is none. Every other
  text, prose and list entries alike, is judged by its closing words, the last five
  tokens of its last line and what is known of them from all lines of all texts. A list
  entry is whole if its words, or as many of them as were seen often enough, mostly stand
  before the end of a line or sentence. Prose without a full stop is whole if the line
  mostly ends there, wherever the words before the last one stand: a sign-off is always
  said to its end, a sentence cut short goes on elsewhere, and half a word is finished
  elsewhere. The ends of other texts count for that too, as sign-offs stand nowhere
  else, but not those with the same words before, which are copies of the text itself.
  All of these are shares of counts, so they do not depend on how many texts there are.

Counting is done in batches and combined before each shuffle. Which word runs are worth
counting is told by a bit map of fixed size over the runs that end a text in doubt; a
full bit map costs time, never a case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.contamination import words
from lakeloom.llm.mixing import clean_source
from lakeloom.shared import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 4
FIRST_HEAD = 16
#: Bits of the map of word runs that are worth counting.
MAP_BITS = 1 << 22
#: Of the times that words were seen, the share in which they closed a sentence; below it they do not close.
CLOSES = 0.5
FLUSH = 200_000
#: Tokens counted at a time; bounds the memory of a worker.
CHUNK_TOKENS = 300_000
#: Words sketched at a time.
CHUNK_WORDS = 16_000
#: A run seen less often is asked only if no shorter one was seen so often.
SEEN_LEAST = 3
#: Longest run of closing tokens (the beginning of the line counts as one), and how many tokens before it tell one text's end from another's.
RUN, BEFORE = 6, 12

_TOKEN = re.compile(r"\w+(?:[.'’][^\W\d_]\w*)*|[^\w\s]")
_DIGIT = re.compile(r"\d")
_PART = re.compile(r"[^\W_]+")
_IDENTIFIER = re.compile(r"\w.*[._]|\d")
_LIST = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+\S")
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)
_OPEN_TAG = re.compile(r"<[A-Za-z/!][^<>]*$")
_OPEN_ENTITY = re.compile(r"&#?\w{0,8}$")
#: A short remark in brackets or an ellipsis behind the last words; it decides nothing, the words before it are judged.
_TAIL = re.compile(r"\s*(?:\[[^\[\]\n]{0,20}\]|\([^()\n]{0,20}\)|\.{2,}|…)$")
#: A full stop; the last of several dots is none.
_CLOSED = re.compile(r"(?:(?<!\.)[.!?]|[。！？])['\"”’»)\]*_`]*$")
_ENDING = frozenset(".!?")

#: Verdicts by form; prose and list entries wait for their closing words.
WHOLE, CUT, PROSE, LISTED = 0, 1, 2, 3


def _shape(m: re.Match) -> str:
    t = m[0]
    return "0" * len(t) if t.isdigit() and len(t) <= LONG_NUMBER else "a" if not _DIGIT.search(t) else f"<mixed {len(t)}>"


def token(t: str) -> str:
    """A token as it is, or its shape if it has digits: identifiers are alike if their parts are of one kind and, with digits, of one length."""
    return _PART.sub(_shape, t) if _DIGIT.search(t) else t


#: Longer rows of digits are identifiers, not numbers.
LONG_NUMBER = 7
NUMBER, NAME = "<number>", "<name>"


def kind(t: str) -> str:
    """A token as it counts among closing words: words and marks as they are, numbers as one, identifiers (with digits, dots or underscores) as one."""
    if t.isdigit() and len(t) <= LONG_NUMBER:
        return NUMBER
    return NAME if _IDENTIFIER.search(t) else t


def tokens(line: str) -> list[str]:
    return _TOKEN.findall(line.lower())


def ended(text: str) -> str:
    """A text up to its last words: without blanks, an ellipsis or a remark in brackets behind them, also on a line of its own."""
    s = text.rstrip()
    m = _TAIL.search(s, max(0, len(s) - 40))  # a remark has 22 characters at most
    return s[: m.start()].rstrip() if m else s


def look(text: str) -> tuple[int, list[str], list[str]]:
    """(verdict by form, closing tokens, tokens before these) of a text."""
    s = text.rstrip()
    if not s:
        return WHOLE, [], []
    line = s[s.rfind("\n") + 1 :].strip()
    if ("```" in s or "~~~" in s) and len(_FENCE.findall(s)) % 2:
        return CUT, [], []
    if _FENCE.match(line):
        return WHOLE, [], []
    if s.endswith("\ufffd") or _OPEN_TAG.search(line) or _OPEN_ENTITY.search(line):
        return CUT, [], []
    s = ended(s)
    line = s[s.rfind("\n") + 1 :].strip()
    if line.startswith("|"):
        return (WHOLE if line.endswith("|") and len(line) > 1 else CUT), [], []
    if not line or _CLOSED.search(line) or _FENCE.match(line):
        return WHOLE, [], []
    last = ["\n", *tokens(line)]
    before = tokens(s[: -len(line)][-400:]) if len(last) < RUN + BEFORE else []
    return (LISTED if _LIST.match(line) else PROSE), last[-RUN:], [*before, *last[:-RUN]][-BEFORE:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15

class _Hashes(dict):
    """Hashes by text, kept up to a bound; looked up without a call of Python code once known."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, raw: str) -> int:
        if len(self) > FLUSH:
            self.clear()
        self[raw] = h = self.make(raw)
        return h


def _token_hash(t: str) -> int:
    """The kind of a token in the upper 32 bits, the token or its shape in the lower ones."""
    return xxhash.xxh32_intdigest(kind(t)) << 32 | xxhash.xxh32_intdigest(token(t))


_TOKENS, _WORDS = _Hashes(_token_hash), _Hashes(xxhash.xxh64_intdigest)
_HALF, _NAMED = np.uint64(32), xxhash.xxh32_intdigest(NAME)
_SHAPES = 0x94D049BB133111EB


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _mixed(h: int) -> int:
    h = ((h ^ (h >> 31)) * _P) & _M64
    return _signed(h ^ (h >> 29))


def runs(last: list[str]) -> list[int]:
    """Hashes of the kinds of the last one, two, ... tokens; :func:`_run_keys` makes the same for all positions of a text."""
    out = []
    for k in range(1, len(last) + 1):
        h = 0
        for t in last[-k:]:
            h = (h * _P + (_TOKENS[t] >> 32)) & _M64
        out.append(_mixed((h + k * 0xD1342543DE82EF95) & _M64))
    return out


def shape_key(t: str) -> int | None:
    """Key of an identifier's shape; None for other tokens."""
    return _mixed((_TOKENS[t] + _SHAPES) & _M64) if _TOKENS[t] >> 32 == _NAMED else None


def _run_keys(sums: np.ndarray, k: int) -> np.ndarray:
    return _mix(sums + np.uint64(k * 0xD1342543DE82EF95 & _M64)).view(np.int64)


LOOK = "doc_id bigint, verdict int, context bigint, runs array<bigint>, before array<bigint>, whole boolean, word string, name bigint"


def _looks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, text in zip(b["doc_id"], b["text"]):
            verdict, last, before = look(text or "")
            alone = last[-1] if len(last) == 2 and last[0] == "\n" else None  # the only word of its line
            rows.append((doc, verdict, _hash(*before), runs(last), runs(last[:-1]), alone is not None, alone, shape_key(last[-1]) if last else None))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in LOOK.split(", ")], dtype=object)  # not float, which large hashes do not fit
        yield out.astype({"doc_id": "Int64", "context": "int64", "verdict": "int32", "name": "Int64"})


_LINES = re.compile(_TOKEN.pattern + r"|\n")
_NEWLINE = _token_hash("\n")


def _known(*texts: str) -> np.ndarray:
    return np.array([_token_hash(x) for x in texts], np.uint64)


#: What follows a sentence's last word; the marks that a list entry begins with.
_STOPS, _BULLETS = _known(".", "!", "?"), _known("-", "*", "•", "+")
COUNTS = "run bigint, bare bigint, closes bigint, prose bigint, every bigint"


def _counted(h: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
    """Counts of the runs in the bit map, over tokens of texts laid end to end; 0 stands between texts.

    bare: in prose, before the end of a line; closes: before the end of a line or
    sentence; prose and every: all occurrences, in prose and anywhere.
    """
    line_end = (h == np.uint64(_NEWLINE)) | (h == 0)
    at = np.arange(len(h))
    start = np.maximum.accumulate(np.where(line_end, at, -1)) + 1  # of the line
    nth = at - start
    bullet = np.append(np.isin(h, _BULLETS), [False, False])
    listed = bullet[start] & ~bullet[start + 1]  # two dashes begin no list entry
    after = np.append(h[1:], np.uint64(0))
    ends = after == np.uint64(_NEWLINE)
    closing = ends | np.isin(after, _STOPS)
    alive = ~line_end & (after != 0)  # ends of texts are counted apart
    def held(key: np.ndarray) -> np.ndarray:
        place = key & (MAP_BITS - 1)
        return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)

    named = at[alive & (h >> _HALF == np.uint64(_NAMED))]
    shapes = _mix(h[named] + np.uint64(_SHAPES)).view(np.int64)
    some = held(shapes)
    keys, places = [shapes[some]], [named[some]]
    h = np.where(h == 0, np.uint64(_NEWLINE), h) >> _HALF  # a line's beginning is the end of the line before
    sums, left = np.zeros(len(h), np.uint64), np.flatnonzero(alive)
    for k in range(1, RUN + 1):
        sums = h + np.append(np.uint64(0), sums[:-1]) * np.uint64(_P) if k > 1 else h.copy()
        left = left[nth[left] >= k - 2]
        key = _run_keys(sums[left], k)
        # the map holds all shorter runs of a run, so beyond the first that it lacks no longer one is in it
        some = held(key)
        left = left[some]
        keys.append(key[some])
        places.append(left)
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    where = np.concatenate(places)
    count = lambda flag: np.bincount(inverse, weights=flag[where], minlength=len(found)).astype(np.int64)
    return pd.DataFrame({"run": found, "bare": count(ends & ~listed), "closes": count(closing), "prose": count(~listed), "every": np.bincount(inverse, minlength=len(found))})


def _count_runs(bits: np.ndarray):
    """Counts, over all positions of all texts, of the runs in the bit map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[int] = [0]
        for b in batches:
            for text in b["text"]:
                held += map(_TOKENS.__getitem__, _LINES.findall(ended(text or "").lower()))
                held.append(0)
                if len(held) > CHUNK_TOKENS:
                    yield _counted(np.array(held, np.uint64), bits)
                    held = [0]
        yield _counted(np.array(held, np.uint64), bits)

    return run


# Sketches of heads ---------------------------------------------------------------


_SEEDS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(w: list[str]) -> np.ndarray:
    """Hashes of all runs of five words; of a shorter text, one of the whole."""
    h = np.array([*map(_WORDS.__getitem__, w)] or [0], np.uint64)
    n = max(len(h) - SHINGLE + 1, 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        out = out * np.uint64(0x100000001B3) + h[j : j + n]
    return _mix(out)


def heads(n: int) -> list[int]:
    """Head lengths of a text of n words: 16, 32, ... and nothing above n."""
    out, k = [], FIRST_HEAD
    while k <= n:
        out.append(k)
        k *= 2
    return out


def sketches(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, bucket key) of all texts: one key per band and head length."""
    levels = [heads(len(w)) for w in texts]
    held = [i for i, x in enumerate(levels) if x]
    if not held:
        return np.array([], np.int64), np.array([], np.int64)
    h = np.fromiter((x for i in held for x in map(_WORDS.__getitem__, texts[i])), np.uint64)
    s = np.zeros(len(h), np.uint64)
    for j in range(SHINGLE):  # runs that cross into the next text lie behind its last head and are not used
        s = s * np.uint64(0x100000001B3) + np.append(h[j:], np.zeros(j, np.uint64))
    s = np.append(_mix(s), np.uint64(0))
    lengths = np.array([len(texts[i]) for i in held])
    count = np.array([len(levels[i]) for i in held])
    base = np.cumsum(lengths) - lengths
    # pieces between one head's end and the next one's, and one for the rest of the text
    cuts = np.array([c for i in held for c in [0, *(x - SHINGLE + 1 for x in levels[i])]])
    owner = np.repeat(np.arange(len(held)), count + 1)
    mins = np.minimum.reduceat(s[None, :] * _SEEDS[:, None], base[owner] + cuts, axis=1)  # shingle hashes are uniform already, so an odd factor gives each row an order of its own
    nth = np.arange(len(cuts)) - np.repeat(np.cumsum(count + 1) - (count + 1), count + 1)
    for k in range(1, int(count.max())):
        at = np.flatnonzero(nth == k)
        mins[:, at] = np.minimum(mins[:, at], mins[:, at - 1])
    used = nth < count[owner]
    banded, nth = mins[:, used].reshape(BANDS, ROWS, -1), nth[used]
    key = np.zeros((BANDS, len(nth)), np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x100000001B3) + banded[:, r, :])
    key += (np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(1009) + nth[None, :].astype(np.uint64)) * np.uint64(_P)
    return np.tile(np.array(held)[owner[used]], BANDS), key.view(np.int64).ravel()


def sketch(w: list[str]) -> list[int]:
    """Bucket keys of one text."""
    return sketches([w])[1].tolist()


BUCKET, TAIL, ASKED = 0, 1, 2
#: Words before the last one that a longer copy must hold.
TAIL_WORDS = 4
_INSIDE = np.uint64(0xA24BAED4963EE407)
_GOES_ON = re.compile(r"[ \t]+\w")


def _tails(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of TAIL_WORDS words, by their beginning."""
    out = np.zeros(max(len(h) - TAIL_WORDS + 1, 0), np.uint64)
    for j in range(TAIL_WORDS):
        out = out * np.uint64(0x100000001B3) + h[j : j + len(out)]
    return _mix(out)


def _end_keys(tail: np.ndarray, word: np.ndarray, inside: bool) -> np.ndarray:
    """Keys of a tail and the word after it; ``inside``: of a tail and the beginning of the word after it."""
    return _mix(tail * np.uint64(_P) + word + (_INSIDE if inside else np.uint64(0)))


def _asked(w: list[str], text: str) -> list[tuple[int, np.uint64]]:
    """(kind, key) of what a longer copy of a text must hold: the tail, and the tail with the last word as a part or, unless the text closes, as a whole."""
    if len(w) < FIRST_HEAD:
        return []
    tail = _tails(np.array([*map(_WORDS.__getitem__, w[-TAIL_WORDS - 1 : -1])], np.uint64))
    last = np.array([_WORDS[w[-1]]], np.uint64)
    out = [(TAIL, tail[0]), (ASKED, _end_keys(tail, last, True)[0])]
    return out if _CLOSED.search(text.rstrip()) else [*out, (ASKED, _end_keys(tail, last, False)[0])]


def _content(text: str) -> int:
    """Key of texts that are alike to their last mark; the words alone would not tell a closed end from an open one."""
    return _hash(text.rstrip())


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def flush(ids: list, texts: list[list[str]], asked: list[list], contents: list[int]) -> pd.DataFrame:
        at, key = sketches(texts)
        n, content, ids = np.array([len(w) for w in texts], np.int64), np.array(contents, np.int64), np.array(ids, np.int64)
        kind = np.array([k for x in asked for k, _ in x], np.int64)
        at = np.concatenate([at, np.repeat(np.arange(len(asked)), [len(x) for x in asked])])
        key = np.concatenate([key, np.array([k for x in asked for _, k in x], np.uint64).view(np.int64)])
        kind = np.concatenate([np.zeros(len(key) - len(kind), np.int64), kind])
        return pd.DataFrame({"kind": kind, "bucket": key, "words": n[at], "content": content[at], "doc_id": ids[at]}, dtype="int64")

    ids, texts, asked, contents, size = [], [], [], [], 0
    for b in batches:
        for doc, text in zip(b["doc_id"], b["text"]):
            ids.append(doc)
            texts.append(words(text))
            asked.append(_asked(texts[-1], text or ""))
            contents.append(_content(text or ""))
            size += len(texts[-1])
            if size > CHUNK_WORDS:
                yield flush(ids, texts, asked, contents)
                ids, texts, asked, contents, size = [], [], [], [], 0
    if ids:
        yield flush(ids, texts, asked, contents)


def _bit_map(keys: DataFrame) -> np.ndarray:
    """Bits of the keys of the column ``key``."""
    at = keys.select(F.pmod("key", F.lit(MAP_BITS)).cast("int").alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)  # at most MAP_BITS numbers
    bits = np.zeros(MAP_BITS >> 3, np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _mapped(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = key.view(np.int64) % MAP_BITS
    return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def _holders(bits: np.ndarray):
    """(key, place of the word, words, content, doc_id) wherever a text holds, and goes on after, what the bit map says is asked for."""

    def places(text: str, w: list[str], bits: np.ndarray) -> tuple[list[int], list[int]]:
        h = np.array([*map(_WORDS.__getitem__, w)], np.uint64)
        tail = _tails(h)[: len(w) - TAIL_WORDS]  # before each word from the fifth on
        hit = np.flatnonzero(_mapped(tail, bits))
        if not len(hit):
            return [], []
        key = _end_keys(tail[hit], h[hit + TAIL_WORDS], False)
        held = _mapped(key, bits)
        at, keys = (hit[held] + TAIL_WORDS).tolist(), key[held].view(np.int64).tolist()
        if at:
            ends = [m.end() for m in re.finditer(r"[^\W_]+", text)]
            on = [bool(p < len(ends) and _GOES_ON.match(text, ends[p])) for p in at]
            at, keys = [p for p, x in zip(at, on) if x], [k for k, x in zip(keys, on) if x]
        parts = [(p, w[p][:k]) for p in (hit + TAIL_WORDS).tolist() for k in range(1, len(w[p]))]
        if parts:
            of = np.array([p for p, _ in parts])
            key = _end_keys(tail[of - TAIL_WORDS], np.array([_WORDS[x] for _, x in parts], np.uint64), True)
            held = _mapped(key, bits)
            at, keys = at + of[held].tolist(), keys + key[held].view(np.int64).tolist()
        return at, keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                w = words(text)
                if len(w) > FIRST_HEAD:
                    at, keys = places(text, w, bits)
                    content = _content(text) if at else 0
                    rows += [(k, p, len(w), content, doc) for p, k in zip(at, keys)]
            yield pd.DataFrame(rows, columns=["key", "at", "words", "content", "doc_id"], dtype="int64")

    return run


def ends_early(short: str, long: str) -> bool:
    """Whether ``short`` is, up to its end, a copy of ``long`` that stops in the middle of a word or sentence."""
    a, b = words(short), words(long)
    m = len(a)
    if m >= len(b) or m < FIRST_HEAD:
        return False
    x, y = set(shingles(a[:-1]).tolist()), set(shingles(b[: m - 1]).tolist())
    if len(x & y) < SIMILARITY * len(x | y):
        return False
    tail = a[-5:-1]  # the last word may itself be cut
    slack = max(8, m // 5)
    best = None
    for p in range(max(0, m - 1 - slack), min(len(b) - 1, m - 1 + slack) + 1):
        if b[max(0, p - 4) : p] == tail and b[p].startswith(a[-1]) and (best is None or abs(p - m + 1) < abs(best - m + 1)):
            best = p
    if best is None:
        return False
    if b[best] != a[-1]:
        return True
    at = _position(long, best)
    return bool(re.match(r"[ \t]+\w", long[at:])) and not _CLOSED.search(short.rstrip())


def _position(text: str, nth: int) -> int:
    """End of the nth word (from 0) of a text, in characters of the text as it is."""
    found = list(re.finditer(r"[^\W_]+", text))
    return found[nth].end() if nth < len(found) else len(text)


def cut_by_copies(documents: DataFrame) -> DataFrame:
    """doc_id of texts that stop early beside a longer near-copy."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null")
    sketched = materialize(docs.mapInPandas(_sketches, "kind bigint, bucket bigint, words bigint, content bigint, doc_id bigint"), "sketches")
    # copies of one text count once; what is found for one holds for all
    texts = sketched.groupBy("kind", "bucket", "words", "content").agg(F.min("doc_id").alias("doc_id"))
    shared = texts.filter(F.col("kind") == BUCKET).groupBy(F.col("bucket").alias("_b")).agg(F.min("words").alias("least"), F.max("words").alias("most")).filter("most > least")
    members = texts.filter(F.col("kind") == BUCKET).join(shared, F.col("bucket") == F.col("_b"))
    members = materialize(members.select("bucket", "content", "doc_id", (F.col("words") < F.col("most")).alias("shorter"), (F.col("words") > F.col("least")).alias("longer")), "members")
    short_texts = members.filter("shorter").select(F.col("content").alias("_of")).distinct()
    asks = texts.filter(F.col("kind") != BUCKET).join(short_texts, F.col("content") == F.col("_of"), "left_semi").withColumnRenamed("bucket", "key")
    asks = materialize(asks.select("kind", "key", "words", "content", "doc_id"), "asks")
    bits = _bit_map(asks)
    asks = asks.filter(F.col("kind") == ASKED).drop("kind")
    long_texts = members.filter("longer").groupBy("content").agg(F.min("doc_id").alias("_d")).select("_d")
    held = docs.join(long_texts, F.col("doc_id") == F.col("_d"), "left_semi").mapInPandas(_holders(bits), "key bigint, at bigint, words bigint, content bigint, doc_id bigint").distinct()
    wanted = asks.groupBy(F.col("key").alias("_k")).agg(F.min("words").alias("_least"))
    held = materialize(held.join(wanted, F.col("key") == F.col("_k")).filter(F.col("words") > F.col("_least")).drop("_k", "_least"), "held")
    slack = F.greatest(F.lit(8), F.floor(F.col("words") / 5))
    place = lambda d, which: d.join(members.filter(which).select(F.col("content").alias("_of"), "bucket").distinct(), F.col("content") == F.col("_of")).drop("_of")
    longer = place(held, "longer").select(F.col("key").alias("_k"), F.col("bucket").alias("_b"), "at", F.col("words").alias("_w"), F.col("content").alias("_c"), F.col("doc_id").alias("long_id"))
    pairs = place(asks, "shorter").join(longer, (F.col("key") == F.col("_k")) & (F.col("bucket") == F.col("_b"))).filter((F.col("words") < F.col("_w")) & (F.abs(F.col("at") - F.col("words") + 1) <= slack))
    pairs = materialize(pairs.groupBy("content", "_c").agg(F.min("doc_id").alias("short_id"), F.min("long_id").alias("long_id")), "pairs")
    short = docs.select(F.col("doc_id").alias("_s"), F.col("text").alias("short"))
    long = docs.select(F.col("doc_id").alias("_l"), F.col("text").alias("long"))
    both = pairs.join(short, F.col("short_id") == F.col("_s")).join(long, F.col("long_id") == F.col("_l")).select("content", "short", "long")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"content": [c for c, s, t in zip(b["content"], b["short"], b["long"]) if ends_early(s, t)]}, dtype="int64")

    early = both.mapInPandas(verify, "content bigint").distinct().withColumnRenamed("content", "_e")
    return sketched.filter(F.col("kind") == BUCKET).select("content", "doc_id").join(early, F.col("content") == F.col("_e"), "left_semi").select("doc_id").distinct()


def cut_by_ending(documents: DataFrame) -> DataFrame:
    """doc_id of texts whose end does not close, by form and by the closing words of all texts."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    looks = materialize(docs.mapInPandas(_looks, LOOK), "looks")
    return looks.filter(F.col("verdict") == CUT).select("doc_id").unionAll(_unclosed(docs, looks)).distinct()


def terminality(docs: DataFrame, looks: DataFrame) -> DataFrame:
    """doc_id, closes, seen of every text in doubt: how often its closing words close, of how many times, at the longest run with enough evidence.

    Of prose, the longest run is weighed against all places of the words before its last
    one, with the ends of other texts; shorter runs against their own places inside texts.
    A word alone on its line is weighed against lines that begin with it or with a longer
    word of the same beginning. An identifier at the very end must be one, or of a shape,
    that stands inside texts as often as at their ends, or that most texts with these
    closing words end with: else it may be half of one, and the text gives no row.
    """
    doubt = looks.filter(F.col("verdict").isin(PROSE, LISTED) & (F.size("runs") > 0))
    last, key = F.element_at("runs", -1), lambda what, *c: F.xxhash64(F.lit(what), *c)
    prose = F.col("verdict") == PROSE
    # What each text asks for, as keys of one table of counts.
    plain = F.transform("runs", lambda r, k: F.struct(F.lit("run").alias("role"), k.alias("k"), r.alias("key")))
    ask = lambda role, c: F.struct(F.lit(role).alias("role"), F.lit(-1).alias("k"), c.alias("key"))
    extra = [ask("ahead", F.try_element_at("before", F.lit(-1))), ask("ends", key("end", last)), ask("same", key("same", last, "context")), ask("begun", key("word", "word"))]
    extra += [ask("name", F.col("name")), ask("named", key("named", "name")), ask("so", key("so", last, "name")), ask("all", key("all", last))]
    wants = F.when(prose, F.array(*extra)).otherwise(F.array(*extra[4:]))
    wants = F.filter(wants, lambda w: w["key"].isNotNull() & (~w["role"].isin("so", "all", "named") | F.col("name").isNotNull()) & ((w["role"] != "begun") | F.col("whole")))
    asks = materialize(doubt.select("doc_id", "verdict", "whole", F.size("runs").alias("n"), F.explode(F.concat(plain, wants)).alias("w")).select("doc_id", "verdict", "whole", "n", "w.*"), "asks")

    wanted = doubt.select(F.explode(F.concat("runs", "before", F.array_compact(F.array("name")))).alias("key")).distinct()
    counted = docs.select("text").mapInPandas(_count_runs(_bit_map(wanted)), COUNTS).withColumnRenamed("run", "key").withColumn("n", F.lit(0).cast("bigint"))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("bare", "closes", "prose", "every")]
    ends = asks.filter(F.col("role").isin("ends", "same", "named", "so", "all")).select("key", *none, F.lit(1).cast("bigint").alias("n"))
    starts = docs.select(F.explode(F.split(F.lower("text"), "\n")).alias("l")).select(F.regexp_extract("l", r"^\s*([\p{L}\p{N}]+)", 1).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    begun = starts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring("w", F.lit(1), i))).alias("begun"), "n")
    begun = begun.select(key("word", "begun").alias("key"), *none, "n")
    counts = counted.unionAll(ends).unionAll(begun).groupBy(F.col("key").alias("of")).agg(*[F.sum(c).alias(c + "_") for c in ("bare", "closes", "prose", "every", "n")])

    j = asks.join(counts, F.col("key") == F.col("of"), "left")
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    of = lambda role, c: F.coalesce(F.max(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    longest = prose & (F.col("k") == F.col("n") - 1)
    inner = (F.col("role") == "run") & ~longest
    shorter = F.when(inner, F.struct((F.when(prose, v("prose_")).otherwise(v("every_")) >= SEEN_LEAST).alias("enough"), "k", F.when(prose, v("bare_")).otherwise(v("closes_")).alias("closes"), F.when(prose, v("prose_")).otherwise(v("every_")).alias("seen")))
    g = j.groupBy("doc_id").agg(
        F.max(F.when(shorter["seen"] > 0, shorter)).alias("x"), F.max(F.when(longest & (F.col("role") == "run"), v("bare_"))).alias("bare"), F.max("n").alias("n"), F.bool_or("whole").alias("whole"), F.bool_or(prose).alias("prose"),
        *[of(r, "n_").alias(r) for r in ("ends", "same", "begun", "named", "so", "all")], of("ahead", "prose_").alias("ahead"), of("name", "every_").alias("inside"),
    )
    g = g.filter(~((F.col("inside") < F.col("named")) & (F.col("so") < CLOSES * F.col("all"))))  # the last name may be half of one
    others = F.col("ends") - F.col("same")
    seen = F.when(F.col("whole"), F.greatest(F.col("begun") - F.col("same"), others)).otherwise(F.col("ahead") - F.col("same"))
    full = F.when(F.col("prose") & (seen > 0), F.struct((seen >= SEEN_LEAST).alias("enough"), (F.col("n") - 1).alias("k"), (F.coalesce("bare", F.lit(0)) + others).alias("closes"), seen.alias("seen")))
    best = g.select("doc_id", F.greatest("x", full).alias("x")).filter("x is not null")
    return best.select("doc_id", "x.closes", "x.seen")


def _unclosed(docs: DataFrame, looks: DataFrame) -> DataFrame:
    """doc_id of texts in doubt whose closing words do not close; of words never seen, that is taken for granted."""
    close = terminality(docs, looks).filter(F.col("closes") >= CLOSES * F.col("seen")).select(F.col("doc_id").alias("_d"))
    doubt = looks.filter(F.col("verdict").isin(PROSE, LISTED))
    return doubt.join(close, F.col("doc_id") == F.col("_d"), "left_anti").select("doc_id")


def cut_texts(documents: DataFrame) -> DataFrame:
    """doc_id of every document whose text was cut before its end.

    Reads doc_id (an integer) and text. Defined cases: null, empty and blank texts are
    not cut; a text of fewer than 16 words, or without an id, is judged by its ending alone; repeated rows
    give one row; copies of a cut text are all found; an empty table gives an empty
    result. Whole texts are read for counting, sketching and alignment.
    """
    return cut_by_copies(documents).unionAll(cut_by_ending(documents)).distinct()


def cut_shares(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """Per source (in one spelling; null for unknown): documents, how many were cut, and their share."""
    d = documents.select(F.col("doc_id").alias("_id"), clean_source(F.col("source")).alias("source"))
    j = d.join(cut.select("doc_id").withColumn("_cut", F.lit(1)), F.col("_id") == F.col("doc_id"), "left")
    g = j.groupBy("source").agg(F.count("*").alias("documents"), F.count("_cut").alias("cut"))
    return g.withColumn("cut_share", F.col("cut") / F.col("documents"))
