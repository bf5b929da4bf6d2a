"""Evaluation texts leaking into training text.

Test items are held in an inverted index with BM25 weights and block maxima. Every
passage of every document is a query. A passage holds two runs of ``n`` words and the
next one starts ``n`` + 1 words later, so each run of ``n`` words lies whole in one passage.

The threshold of an item is the least score that any ``n`` consecutive words of it have
against the item itself. A passage that holds a shared run therefore scores at least
that much: retrieving everything above the threshold loses no case. Weights are divided
by their item's threshold, so that one threshold, 1, serves all, and the three bounds of
block-max WAND apply in turn, each for a whole batch of passages at once:

1. the sum of the terms' largest weights anywhere (a passage below 1 meets no item),
2. the sum of their largest weights in each block of items,
3. the exact score of the items of the blocks that are left.

Candidates are verified word by word. The index goes to the executors by a broadcast
of bounded size: at most ``shard_items`` items at a time; more items make more passes
over the documents, which are never shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a shared run, in words.
RUN_WORDS = 13
#: Items in one index: bounds what is sent to each executor (a few MB for a thousand items).
SHARD_ITEMS = 20_000
BLOCK_ITEMS = 16
K1, B = 1.2, 0.75
#: Room for rounding in sums of weights.
EPS = 1e-6
#: Words scored at a time; bounds the memory of a worker.
CHUNK_WORDS = 400_000
CHUNK_PASSAGES = 1_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits after NFKC and lower-casing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


class Index:
    """Inverted index of items with normalised BM25 weights in blocks."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int = RUN_WORDS, block: int = BLOCK_ITEMS) -> None:
        # Items that share passages stand side by side, which makes block maxima tight.
        self.items = sorted((x for x in items if len(x[1]) >= n), key=lambda x: x[1])
        self.n, self.block = n, block
        self.vocabulary: dict[str, int] = {}
        many = len(self.items)
        frequency = Counter(w for _, t in self.items for w in set(t))
        average = sum(len(t) for _, t in self.items) / many if many else 1.0
        term, item, weight = [], [], []
        for i, (_, t) in enumerate(self.items):
            tf = Counter(t)
            w = {x: math.log(1 + (many - frequency[x] + 0.5) / (frequency[x] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(t) / average)) for x, c in tf.items()}
            least = min(sum(w[x] for x in set(t[k : k + n])) for k in range(len(t) - n + 1))
            for x, v in w.items():
                term.append(self.vocabulary.setdefault(x, len(self.vocabulary)))
                item.append(i)
                weight.append(v / least)
        self.blocks = -(-many // block)
        order = np.lexsort((item, term)) if term else np.array([], np.int64)
        self.term, self.item, self.weight = (np.array(x, t)[order] for x, t in ((term, np.int64), (item, np.int64), (weight, np.float64)))
        terms = len(self.vocabulary)
        self.most = np.zeros(terms + 1)
        np.maximum.at(self.most, self.term, self.weight)
        # postings by (term, block): the run of single postings, and its largest weight
        key = self.term * max(self.blocks, 1) + self.item // block
        self.key, self.key_from = np.unique(key, return_index=True)
        self.key_to = np.append(self.key_from[1:], len(key))
        self.key_most = np.maximum.reduceat(self.weight, self.key_from) if len(key) else np.array([])
        self.term_from = np.searchsorted(self.key, np.arange(terms + 1) * max(self.blocks, 1))
        self.term_to = np.append(self.term_from[1:], len(self.key))

    def passages(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of all passages of texts laid end to end in ``ids``."""
        step, size = self.n + 1, 2 * self.n
        count = np.where(lengths >= self.n, np.maximum(-(-(lengths - size) // step), 0) + 1, 0)
        text = np.repeat(np.arange(len(lengths)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        base = (np.cumsum(lengths) - lengths)[text]
        start = base + nth * step
        return text, start, np.minimum(start + size, base + lengths[text])

    def retrieve(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, start, end, item) of all passages whose score reaches an item's threshold."""
        text, start, end = self.passages(ids, lengths)
        if not self.blocks:
            return
        padded = np.append(ids, np.full(2 * self.n, len(self.most) - 1))
        for at in range(0, len(text), CHUNK_PASSAGES):
            t, s, e = (x[at : at + CHUNK_PASSAGES] for x in (text, start, end))
            place = s[:, None] + np.arange(2 * self.n)[None, :]
            terms = np.where(place < e[:, None], padded[place], len(self.most) - 1)
            terms.sort(axis=1)
            fresh = terms < len(self.most) - 1
            fresh[:, 1:] &= terms[:, 1:] != terms[:, :-1]  # a term counts once in a passage
            alive = (self.most[terms] * fresh).sum(axis=1) >= 1 - EPS
            which, column = np.nonzero(fresh[alive])
            yield from self._score(which, terms[alive][which, column], t[alive], s[alive], e[alive])

    def _score(self, which: np.ndarray, terms: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        p, k = self._expand(which, self.term_from[terms], self.term_to[terms])
        cell = p * self.blocks + self.key[k] % self.blocks
        bound = np.bincount(cell, weights=self.key_most[k], minlength=len(text) * self.blocks)
        alive = np.flatnonzero(bound >= 1 - EPS)  # passages with blocks of items that may reach the threshold
        slot = np.full(len(bound), -1)
        slot[alive] = np.arange(len(alive))
        left = slot[cell] >= 0
        at, j = self._expand(slot[cell[left]], self.key_from[k[left]], self.key_to[k[left]])
        score = np.bincount(at * self.block + self.item[j] % self.block, weights=self.weight[j], minlength=len(alive) * self.block)
        for h in np.flatnonzero(score >= 1 - EPS).tolist():
            q, b = divmod(int(alive[h // self.block]), self.blocks)
            yield int(text[q]), int(start[q]), int(end[q]), b * self.block + h % self.block

    @staticmethod
    def _expand(owner: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each owner repeated once per position from first to last, and those positions (or the values there)."""
        n = last - first
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.repeat(owner, n), at if values is None else values[at]


class Verifier:
    """Exact comparison of passages with items; runs are laid out for items that come up."""

    def __init__(self, index: Index) -> None:
        self.index, self.places = index, {}

    def shared(self, passage: list[str], item: int) -> set[int]:
        """Places in the item of the runs that the passage holds as well."""
        n, t = self.index.n, self.index.items[item][1]
        if item not in self.places:
            at: dict[tuple, list[int]] = {}
            for k in range(len(t) - n + 1):
                at.setdefault(tuple(t[k : k + n]), []).append(k)
            self.places[item] = at
        at = self.places[item]
        return {p for k in range(len(passage) - n + 1) for p in at.get(tuple(passage[k : k + n]), ())}


def _search(index: Index, batches: Iterator[pa.RecordBatch], names: list[str], detail: bool) -> Iterator[pa.RecordBatch]:
    verifier, unknown = Verifier(index), len(index.vocabulary)

    def flush(held: list[tuple[object, list[str]]]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(t) for _, t in held], np.int64)
        starts = np.cumsum(lengths) - lengths
        get = index.vocabulary.get
        ids = np.array([get(w, unknown) for _, t in held for w in t], np.int64)
        seen: dict[tuple[int, int], set[int]] = {}
        for d, s, e, i in index.retrieve(ids, lengths):
            if detail or (d, i) not in seen:
                runs = verifier.shared(held[d][1][s - starts[d] : e - starts[d]], i)
                if runs:
                    seen.setdefault((d, i), set()).update(runs)
        if seen:
            columns = [pa.array([held[d][0] for d, _ in seen], pa.int64()), pa.array([index.items[i][0] for _, i in seen], pa.int64())]
            if detail:
                total = [len(index.items[i][1]) - index.n + 1 for _, i in seen]
                covered = [len({p + j for p in runs for j in range(index.n)}) for runs in seen.values()]
                size = [len(index.items[i][1]) for _, i in seen]
                columns += [pa.array(covered, pa.int32()), pa.array(size, pa.int32()), pa.array([0 in runs for runs in seen.values()]), pa.array([t - 1 in runs for t, runs in zip(total, seen.values())])]
            yield pa.RecordBatch.from_arrays(columns, names)

    held, size = [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.append((key, words(text)))
            size += len(held[-1][1])
            if size >= CHUNK_WORDS:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", item_key: str = "item_id", doc_text: str = "text", item_text: str = "text", n: int = RUN_WORDS, shard_items: int = SHARD_ITEMS, detail: bool = False) -> DataFrame:
    """(doc key, item key) of every document and item whose texts share at least ``n`` consecutive words. Keys are integers.

    Defined cases: null and empty texts share nothing; an item or text of fewer than ``n``
    words matches nothing; rows repeated under one key give one row; a null document key
    is kept; no items or no documents give an empty result. Whole texts are read.

    ``detail`` adds how far the leak goes: words_shared (words of the item that lie in
    shared runs), item_words, and whether the item's beginning and its end, where an answer
    stands, are among them.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_key).cast("bigint"), F.col(doc_text))
    schema = f"`{doc_key}` bigint, `{item_key}` bigint" + ", words_shared int, item_words int, from_start boolean, to_end boolean" * detail
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    held_out = items.select(F.col(item_key).cast("bigint"), F.col(item_text)).filter(F.col(item_text).isNotNull())
    shards = max(1, -(-held_out.count() // shard_items))
    found = None
    for s in range(shards):
        mine = held_out.filter(F.pmod(F.xxhash64(F.col(item_key), F.col(item_text)), F.lit(shards)) == s) if shards > 1 else held_out
        index = spark.sparkContext.broadcast(Index([(k, words(t)) for k, t in mine.collect()], n))  # at most about shard_items items
        part = docs.mapInArrow(lambda it, index=index: _search(index.value, it, names, detail), schema)
        found = part if found is None else found.unionAll(part)
    return found.distinct()
