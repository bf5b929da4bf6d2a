"""Mixing sources to target weights, in tokens.

Every document gets a hash-random key. Inside each source, documents stand in the order
of their keys, and a distributed prefix sum of token counts gives the place at which a
source's budget is used up. A source whose budget exceeds its size is used whole several
times, and the cut falls into its last epoch; the number of uses never exceeds
``max_repeats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.tokens import VOCABULARY, with_token_counts
from lakeloom.operators.ordered import running_total
from lakeloom.shared import materialize

#: A mix recipe up to this many rows is sent to all executors; a longer one is joined by a shuffle.
BROADCAST_ROWS = 10_000


def clean_source(source: Column) -> Column:
    """One spelling of a source name: lower case, outer blanks cut, hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def _prepared(documents: DataFrame, vocabulary: str, seed: int) -> DataFrame:
    src = documents.select("doc_id", clean_source(F.col("source")).alias("source"), F.col("text"))
    counted = with_token_counts(src, ["doc_id", "source"], "text", vocabulary=vocabulary)
    return materialize(counted.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id")), "tokens")


def _budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: the wanted tokens, the source's tokens, whole epochs and the rest to cut at."""
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("_have"))
    everything = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    t = targets.select("mix_id", clean_source(F.col("source")).alias("source"), "target_share", "max_repeats", "size_ratio").distinct()
    t = t.join(sizes, "source", "left").withColumn("_have", F.coalesce("_have", F.lit(0).cast("bigint")))
    t = t.withColumn("wanted", F.coalesce(F.col("target_share") * F.col("size_ratio") * F.lit(everything), F.lit(0.0)))
    epochs = F.when(F.col("_have") > 0, F.least(F.floor(F.col("wanted") / F.col("_have")), F.coalesce(F.col("max_repeats"), F.lit(0)).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    t = t.withColumn("_epochs", F.coalesce(epochs, F.lit(0).cast("bigint")))
    rest = F.when(F.col("_epochs") < F.col("max_repeats"), F.col("wanted") - F.col("_epochs") * F.col("_have")).otherwise(F.lit(0.0))
    return t.withColumn("_rest", F.coalesce(rest, F.lit(0.0)))


def mix(documents: DataFrame, targets: DataFrame, *, vocabulary: str = VOCABULARY, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) of every mix.

    ``chosen``: mix_id, doc_id, source, tokens, repeats (how often the document is used,
    at least once). ``shares``: mix_id, source, target_share, wanted_tokens, documents,
    reached_tokens, reached_share (of what the mix reached) and ``capped`` (the source ran
    out of allowed repeats).

    A document at the cut is taken if at least half of it lies before the cut, so each
    source misses its budget by at most half a document. A source that cannot fill its
    budget within ``max_repeats`` gives all it may; the other sources keep their budgets.
    Documents are hash-ordered once per seed, so mixes overlap as much as they can.
    Defined cases: null and empty texts have no tokens and are never chosen; a null source
    belongs to no mix but counts in the size of all documents; each row is a document,
    also a repeated one; repeated rows of ``targets`` count once; a null share, ratio or
    cap gives a budget of nothing; empty tables give empty results.
    """
    docs = _prepared(documents, vocabulary, seed)
    budgets = materialize(_budgets(docs, targets), "budgets")
    placed = running_total(docs.filter((F.col("tokens") > 0) & F.col("source").isNotNull()), ["source"], "_key", "tokens", tie=("doc_id",))
    b = budgets.select("mix_id", F.col("source").alias("_source"), "_epochs", "_rest", F.col("max_repeats").alias("_cap"))
    if budgets.count() <= BROADCAST_ROWS:
        b = F.broadcast(b)
    extra = (F.col("_before") + F.col("tokens") / 2 <= F.col("_rest")) & (F.col("_rest") > 0)
    used = (F.col("_epochs") + F.when(extra & (F.col("_epochs") < F.col("_cap")), 1).otherwise(0)).cast("int")
    chosen = placed.join(b, F.col("source") == F.col("_source")).withColumn("repeats", used).filter("repeats > 0")
    chosen = chosen.select("mix_id", "doc_id", "source", "tokens", "repeats")
    return chosen, budgets


def shares(chosen: DataFrame, budgets: DataFrame) -> DataFrame:
    """What each source of each mix reached; see :func:`mix`."""
    got = chosen.groupBy(F.col("mix_id").alias("_m"), F.col("source").alias("_s")).agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("reached_tokens"))
    j = budgets.join(got, F.col("mix_id").eqNullSafe(F.col("_m")) & (F.col("source") == F.col("_s")), "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("documents", "reached_tokens")})
    whole = j.groupBy(F.col("mix_id").alias("_wm")).agg(F.sum("reached_tokens").alias("_whole"))
    j = j.join(whole, F.col("mix_id").eqNullSafe(F.col("_wm")))
    reached = F.when(F.col("_whole") > 0, F.col("reached_tokens") / F.col("_whole"))
    capped = F.col("wanted") > F.col("_have") * F.col("max_repeats")
    return j.select("mix_id", "source", "target_share", F.round("wanted", 3).alias("wanted_tokens"), "documents", "reached_tokens", reached.alias("reached_share"), capped.alias("capped"))
