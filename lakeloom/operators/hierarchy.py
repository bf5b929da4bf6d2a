"""Parent-child links to full hierarchies (roots, depths, paths, descendants, cycles).

The forest is contracted fragment by fragment. A fragment is a run of at most
``fragment_rows`` neighbouring rows of one partition; inside it every node's chain of
parents is followed (by pointer doubling, in numpy) up to the last node that the
fragment holds. What is left is a smaller quotient forest: of each fragment only the
nodes that a chain of another fragment enters. It is solved the same way, and its
results are then joined back to expand the chains. A chain inside a fragment that
never leaves it is a local cycle; one that only closes over several fragments shows as
a local cycle of a quotient.

Neither a hot group nor a hot parent can overfill a task: contraction is right for any
cut into fragments, so partitions are made by range over (group, node) and read in
bounded runs. From the second level on, rows are ordered so that a random quarter of
the links, at least, falls into one fragment; the quotient therefore shrinks by a
constant factor per level whatever the shape of the forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.shared import materialize

#: Rows of one fragment; bounds a Python worker's memory (about 100 bytes a row without paths).
FRAGMENT_ROWS = 200_000


#: Path entries that a worker holds at a time; the paths of one fragment leave it in pieces of about that size.
PATH_ENTRIES = 1_000_000


def _contract(pdf: pd.DataFrame, paths: bool) -> Iterator[pd.DataFrame]:
    """Follow every chain inside one fragment; the rows keep their form, with the link that leaves the fragment."""
    n = len(pdf)
    codes, _ = pd.factorize(pdf["g"], use_na_sentinel=False)
    at = pd.DataFrame({"c": codes, "k": pdf["n"].to_numpy(np.int64), "i": np.arange(n)})
    to = pd.DataFrame({"c": codes, "k": pdf["p"].to_numpy(np.int64)})
    par = to.merge(at, on=["c", "k"], how="left")["i"].fillna(-1).to_numpy(np.int64)
    par = np.where(pdf["linked"].to_numpy(bool), par, -1)
    wl = pdf["wl"].to_numpy(np.int64)
    nxt = np.where(par >= 0, par, np.arange(n))
    d = np.where(par >= 0, wl + 1, 0)
    for _ in range(max(1, int(n).bit_length() + 1)):
        if (par[nxt] < 0).all():
            break
        d, nxt = d + d[nxt], nxt[nxt]
    cyclic = (par[nxt] >= 0) | pdf["cyc"].to_numpy(bool)[nxt] | pdf["cyc"].to_numpy(bool)
    out = pdf[["g", "n"]].copy()
    out["p"] = pdf["p"].to_numpy(np.int64)[nxt]
    out["linked"] = pdf["linked"].to_numpy(bool)[nxt] & ~cyclic
    out["last"] = pdf["last"].to_numpy()[nxt]
    out["wl"] = np.where(cyclic, 0, d + wl[nxt])
    out["cyc"] = cyclic
    if paths:
        yield from _with_paths(out, pdf["seg"].to_numpy(), np.where(cyclic, -1, par), np.where(cyclic, -1, d), cyclic)
    else:
        yield out


def _with_paths(out: pd.DataFrame, own: np.ndarray, par: np.ndarray, d: np.ndarray, cyclic: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows with the path inside the fragment, in pieces.

    From the deepest rows on, each chain that is not yet covered is laid out once; the
    path of every row on it is a view of its end, so a chain takes as much memory as it
    has links, and only what leaves in one piece is spelt out.
    """
    done, rows, segs, held = cyclic.copy(), [], [], 0
    if cyclic.any():
        yield out[cyclic].assign(seg=[np.zeros(0, np.int64)] * int(cyclic.sum()))
    for i in np.argsort(-d, kind="stable"):
        if done[i]:
            continue
        chain, fresh = [], 0
        at = i
        while at >= 0:
            chain.append(at)
            fresh += not done[at]
            at = par[at]
        flat = np.concatenate([np.asarray(own[c], np.int64) for c in chain])
        place = 0
        for c in chain[:fresh]:  # rows above a covered one are covered
            done[c] = True
            rows.append(c)
            segs.append(flat[place:])
            held += len(flat) - place
            place += len(own[c])
            if held >= PATH_ENTRIES:
                yield out.iloc[rows].assign(seg=segs)
                rows, segs, held = [], [], 0
    if rows:
        yield out.iloc[rows].assign(seg=segs)


def _fragments(batches: Iterator[pd.DataFrame], rows: int, paths: bool) -> Iterator[pd.DataFrame]:
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += len(b)
        if count >= rows:
            yield from _contract(pd.concat(held, ignore_index=True), paths)
            held, count = [], 0
    if held:
        yield from _contract(pd.concat(held, ignore_index=True), paths)


def _contracted(nodes: DataFrame, rows: int, paths: bool) -> DataFrame:
    # A missing parent is a flag beside a number, as pandas would turn a column of large ids with nulls into floats.
    kept = nodes.select("g", "n", F.coalesce("p", F.lit(0)).alias("p"), F.col("p").isNotNull().alias("linked"), "last", "wl", "cyc", *(["seg"] if paths else []))
    done = kept.mapInPandas(lambda it: _fragments(it, rows, paths), kept.schema)
    return done.withColumn("p", F.expr("if(linked, p, null)")).drop("linked")


def _solve(nodes: DataFrame, rows: int, paths: bool, level: int) -> DataFrame:
    """(g, n, root, depth[, up]) of every node of the forest; root is null for nodes whose links never end."""
    local = materialize(_contracted(nodes, rows, paths), f"hierarchy-{level}")
    exits = local.filter(F.col("p").isNotNull()).select(F.col("g").alias("eg"), F.col("p").alias("en")).distinct()
    same = local["g"].eqNullSafe(exits["eg"]) & (local["n"] == exits["en"])
    quotient = local.join(exits, same, "left_semi")
    quotient = materialize(quotient, f"quotient-{level}")
    left = quotient.count()
    if left == 0:
        solved = None
    elif left <= rows:
        one = _contracted(quotient.coalesce(1), rows + 1, paths)
        solved = one.select("g", "n", *_result(F.col("last"), F.col("wl"), F.col("cyc"), F.col("seg") if paths else None))
    else:
        head = lambda c: F.pmod(F.xxhash64("g", c, F.lit(level)), F.lit(2))
        star = F.when((head("n") == 0) & F.col("p").isNotNull() & (head("p") == 1), F.xxhash64("g", "p")).otherwise(F.xxhash64("g", "n"))
        spread = quotient.withColumn("k", star).repartitionByRange("k", "n").sortWithinPartitions("k", "n")
        solved = _solve(spread, rows, paths, level + 1)
    if solved is None:
        return local.select("g", "n", *_result(F.col("last"), F.col("wl"), F.col("cyc"), F.col("seg") if paths else None))
    s = solved.select(F.col("g").alias("sg"), F.col("n").alias("sn"), F.col("root").alias("sroot"), F.col("depth").alias("sdepth"), *([F.col("up").alias("sup")] if paths else []))
    j = local.join(s, local["g"].eqNullSafe(s["sg"]) & (local["p"] == s["sn"]), "left")
    met = F.col("sn").isNotNull()
    cyc = F.col("cyc") | (met & F.col("sroot").isNull())
    root = F.when(met, F.col("sroot")).otherwise(F.col("last"))
    depth = F.when(met, F.col("wl") + 1 + F.col("sdepth")).otherwise(F.col("wl"))
    up = F.when(met, F.concat("seg", "sup")).otherwise(F.col("seg")) if paths else None
    return j.select("g", "n", *_result(root, depth, cyc, up))


def _result(root: Column, depth: Column, cyc: Column, up: Column | None) -> list[Column]:
    out = [F.when(~cyc, root).alias("root"), F.when(~cyc, depth).alias("depth")]
    return out if up is None else [*out, F.when(~cyc, up).alias("up")]


def resolve_hierarchy(df: DataFrame, node: str, parent: str, group: str, *, paths: bool = False, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """One row per distinct (group, node): ``root``, ``depth`` and, on request, ``path`` from the root to the node.

    Node ids are integers. Root is the last node reached by following the parents; a
    parent that is null or names no node of the group ends the chain. Of nodes whose
    chain never ends, root, depth and path are null.

    Defined cases: rows with a null node name nothing and give no row; a null group is a
    group of its own; repeated rows count once, and if they disagree the smallest
    non-null parent holds; a node that is its own parent is a cycle; an empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    kind = df.schema[node].dataType
    base = df.select(F.col(group).alias("g"), F.col(node).cast("bigint").alias("n"), F.col(parent).cast("bigint").alias("p"))
    base = base.filter(F.col("n").isNotNull()).groupBy("g", "n").agg(F.min("p").alias("p"))
    nodes = base.withColumns({"last": F.col("n"), "wl": F.lit(0).cast("bigint"), "cyc": F.lit(False)} | ({"seg": F.array("n")} if paths else {}))
    nodes = nodes.repartitionByRange("g", "n").sortWithinPartitions("g", "n")
    r = _solve(nodes, fragment_rows, paths, 0)
    out = [F.col("g").alias(group), F.col("n").cast(kind).alias(node), F.col("root").cast(kind).alias("root"), F.col("depth").cast("int").alias("depth")]
    return r.select(*out, *([F.reverse("up").cast(T.ArrayType(kind)).alias("path")] if paths else []))


def descendants(resolved: DataFrame, node: str, group: str) -> DataFrame:
    """(group, ancestor, descendant, steps) for every node under every node, from the paths of :func:`resolve_hierarchy`.

    As many rows as the sum of the depths. Nodes whose links never end have no path and give none;
    :func:`all_descendants` has them.
    """
    at = resolved.filter(F.col("path").isNotNull()).select(group, F.col(node).alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("pos", "ancestor"))
    return at.select(group, "ancestor", "descendant", (F.col("depth") - F.col("pos")).cast("int").alias("steps"))


def _cycles(links: DataFrame) -> DataFrame:
    """(g, n, p) of the nodes on cycles, of links (g, n, p) that never end.

    The image of the parent function taken 2^k times shrinks until only the cycles are
    left; it is followed by doubling, so there are as many rounds as the logarithm of the
    longest tail.
    """
    at, left, level = links.select("g", "n", F.col("p").alias("to")), links.count(), 0
    while left:
        image = at.select(F.col("g").alias("ig"), F.col("to").alias("im")).distinct()
        there = at.select(F.col("g").alias("tg"), F.col("n").alias("tn"), F.col("to").alias("far"))
        kept = at.join(image, at["g"].eqNullSafe(F.col("ig")) & (at["n"] == F.col("im")), "left_semi")
        at = materialize(kept.join(there, kept["g"].eqNullSafe(F.col("tg")) & (F.col("to") == F.col("tn"))).select("g", "n", F.col("far").alias("to")), f"image-{level}")
        before, left, level = left, at.count(), level + 1
        if left == before:
            break
    on = at.select(F.col("g").alias("ig"), F.col("n").alias("im"))
    return links.join(on, links["g"].eqNullSafe(F.col("ig")) & (links["n"] == F.col("im")), "left_semi")


def _least_members(cycles: DataFrame) -> DataFrame:
    """(g, n) of the node with the smallest id on each cycle of links (g, n, p)."""
    at, level, changed = cycles.select("g", "n", F.col("p").alias("to"), F.least("n", "p").alias("low")), 0, 1
    while changed:
        there = at.select(F.col("g").alias("tg"), F.col("n").alias("tn"), F.col("to").alias("far"), F.col("low").alias("flow"))
        j = at.join(there, at["g"].eqNullSafe(F.col("tg")) & (F.col("to") == F.col("tn")))
        at = materialize(j.select("g", "n", F.col("far").alias("to"), F.least("low", "flow").alias("low"), (F.col("flow") < F.col("low")).alias("changed")), f"least-{level}")
        changed, level, at = at.filter("changed").count(), level + 1, at.drop("changed")
    return at.filter(F.col("low") == F.col("n")).select("g", "n")


def _cut_links(links: DataFrame, tops: DataFrame, fragment_rows: int) -> DataFrame:
    """The hierarchy of links (g, n, p) with the nodes of ``tops`` (g, n) as roots."""
    t = tops.select(F.col("g").alias("ig"), F.col("n").alias("im"))
    cut = links.join(t, links["g"].eqNullSafe(F.col("ig")) & (links["n"] == F.col("im")), "left").select("g", "n", F.expr("if(im is null, p, null)").alias("p"))
    return materialize(resolve_hierarchy(cut, "n", "p", "g", paths=True, fragment_rows=fragment_rows), "cut")


def all_descendants(df: DataFrame, node: str, parent: str, group: str, *, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """(group, ancestor, descendant, steps, in_cycle) for every node under every node, on and below cycles too.

    Of a node whose links never end, the ancestors are the nodes on its chain up to the
    cycle and all others on the cycle; no node counts as its own descendant. Steps are
    the fewest. ``in_cycle`` says that the ancestor lies on a cycle. Rows are read as by
    :func:`resolve_hierarchy`. As many rows as all chains have steps, up to their first
    repeated node.
    """
    kind = df.schema[node].dataType
    resolved = materialize(resolve_hierarchy(df, node, parent, group, paths=True, fragment_rows=fragment_rows), "resolved")
    ended = descendants(resolved, node, group).withColumn("in_cycle", F.lit(False))

    base = df.select(F.col(group).alias("g"), F.col(node).cast("bigint").alias("n"), F.col(parent).cast("bigint").alias("p"))
    base = base.filter(F.col("n").isNotNull()).groupBy("g", "n").agg(F.min("p").alias("p"))
    endless = resolved.filter(F.col("root").isNull()).select(F.col(group).alias("ig"), F.col(node).cast("bigint").alias("im"))
    links = materialize(base.join(endless, base["g"].eqNullSafe(F.col("ig")) & (base["n"] == F.col("im")), "left_semi"), "endless")
    cycles = materialize(_cycles(links), "cycles")

    hung = _cut_links(links, cycles, fragment_rows)  # the root of each node is where its chain meets the cycle
    chains = descendants(hung, "n", "g").join(cycles.select(F.col("g").alias("cg"), F.col("n").alias("cn")), F.col("g").eqNullSafe(F.col("cg")) & (F.col("ancestor") == F.col("cn")), "left")
    chains = chains.select("g", "ancestor", "descendant", "steps", F.col("cn").isNotNull().alias("in_cycle"))

    ring = _cut_links(cycles, _least_members(cycles), fragment_rows).select("g", "n", F.col("root").alias("ring"), F.col("depth").alias("place"))
    size = ring.groupBy("g", "ring").agg((F.max("place") + 1).alias("size"))
    size = size.select(F.col("g").alias("sg"), F.col("ring").alias("sr"), "size")
    ring = ring.join(size, ring["g"].eqNullSafe(F.col("sg")) & (F.col("ring") == F.col("sr"))).select("g", "n", "ring", "place", "size")
    other = ring.select(F.col("g").alias("og"), F.col("ring").alias("or"), F.col("n").alias("ancestor"), F.col("place").alias("oplace"))
    around = ring.join(other, ring["g"].eqNullSafe(F.col("og")) & (F.col("ring") == F.col("or")) & (F.col("n") != F.col("ancestor")))
    around = around.select(F.col("g").alias("ag"), F.col("n").alias("entry"), "ancestor", F.pmod(F.col("place") - F.col("oplace"), F.col("size")).alias("away"))
    beyond = hung.join(around, hung["g"].eqNullSafe(F.col("ag")) & (F.col("root") == F.col("entry")))
    beyond = beyond.select("g", "ancestor", F.col("n").alias("descendant"), (F.col("depth") + F.col("away")).cast("int").alias("steps"), F.lit(True).alias("in_cycle"))

    below = chains.unionAll(beyond).select(F.col("g").alias(group), F.col("ancestor").cast(kind).alias("ancestor"), F.col("descendant").cast(kind).alias("descendant"), "steps", "in_cycle")
    return ended.unionAll(below)
