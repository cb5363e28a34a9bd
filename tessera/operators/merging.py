"""The ordered merge of all candidates whose traces contain each other.

Candidates stand in the order of size, then depth. The first one takes up every later one whose
trace contains its own or is contained in it, and goes on with the longer trace of the two, which
decides about those after it; then the next that is left does the same. What a candidate can meet that way is
reached over containments, so components of the containment graph don't touch each other. A component of
bounded size is folded in one task by look-ups in its own containments. In a larger one the first candidate is carried to its
end by joins, what it took is removed, and what is left falls into components anew.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.operators.prefix import ordered_totals
from tessera.runtime import stored

#: Characters of the piece by which a trace is looked up in others.
GRAM = 6
#: Candidates and containments of a component that is folded in one task, at most.
FOLD_ROWS, FOLD_PAIRS = 100_000, 1_000_000


def containments(traces: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(inner, outer)``: ids of different traces in ``traces(id, part, trace)``, of one part, the first of which stands in the second.

    Each trace is looked up by the one of its pieces of ``gram`` characters that the fewest traces of the part
    have; shorter traces are looked up as they are.
    """
    length = F.length("trace")

    def pieces(size: int) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), length - size + 1), lambda i: F.substring("trace", i, F.lit(size)))
        return traces.where(length >= size).select("id", "part", "trace", F.explode(F.array_distinct(cut)).alias("piece"))

    # fewer values than characters in a piece
    short = [n for (n,) in traces.where((length > 0) & (length < gram)).select(length).distinct().collect()]
    whole = stored(pieces(gram), "pieces")
    counts = whole.groupBy("part", "piece").agg(F.count("*").alias("n")).hint("merge")
    rarest = whole.join(counts, ["part", "piece"]).groupBy("id").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    asked = traces.join(rarest, "id").unionByName(traces.where((length > 0) & (length < gram)).withColumn("piece", F.col("trace")))
    held = reduce(DataFrame.unionByName, [pieces(n) for n in short], whole)
    inner = asked.select("part", "piece", F.col("id").alias("inner"), F.col("trace").alias("_in"))
    outer = held.select("part", "piece", F.col("id").alias("outer"), F.col("trace").alias("_out"))
    met = inner.join(outer.hint("merge"), ["part", "piece"])
    return met.where((F.length("_in") < F.length("_out")) & F.contains("_out", "_in")).select("inner", "outer")


def _fold(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """``(rank, owner)`` of one component: ``rows(rank, node)``, ``pairs(inner, outer)``."""
    above, below, ranks = defaultdict(list), defaultdict(list), defaultdict(list)
    for a, b in zip(pairs["inner"].tolist(), pairs["outer"].tolist(), strict=True):
        above[a].append(b)
        below[b].append(a)
    ordered = sorted(zip(rows["rank"].tolist(), rows["node"].tolist(), strict=True))
    for rank, node in ordered:
        ranks[node].append(rank)
    owners: dict[int, int] = {}

    def take(node: int, after: int, before: float, owner: int) -> None:
        mine = ranks[node]
        lo, hi = bisect_right(mine, after), bisect_right(mine, before)
        owners.update(dict.fromkeys(mine[lo:hi], owner))
        del mine[lo:hi]

    for first, node in ordered:
        if first in owners:
            continue
        take(node, first - 1, first, first)
        at, now = first, node
        while True:
            # the next candidate with a longer trace, and all shorter ones before it
            ahead = [(mine[k], up) for up in above[now] if (mine := ranks[up]) and (k := bisect_right(mine, at)) < len(mine)]
            step = min(ahead, default=(float("inf"), now))
            for down in (now, *below[now]):
                take(down, at, step[0], first)
            if not ahead:
                break
            at, now = step
            take(now, at - 1, at, first)
    return pd.DataFrame({"rank": list(owners), "owner": list(owners.values())}, dtype="int64")


def _lead(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(rank, owner)``: what the first candidate of each component in the stored ``rows(component, rank, node)`` takes up, itself included."""
    first = rows.groupBy("component").agg(F.min(F.struct("rank", "node")).alias("_first"))
    active = stored(first.select("component", F.col("_first.rank").alias("owner"), F.col("_first.rank").alias("at"), F.col("_first.node").alias("now")), "active")
    taken = [active.select(F.col("owner").alias("rank"), "owner")]
    own = rows.select("rank", "node")
    while not active.isEmpty():
        longer = active.join(pairs, active["now"] == pairs["inner"]).select("component", "at", F.col("outer").alias("node"))
        step = longer.join(own.hint("merge"), "node").where("rank > at").groupBy("component").agg(F.min(F.struct("rank", "node")).alias("_step"))
        active = stored(active.join(step, "component", "left"), "active")
        shorter = active.join(pairs, active["now"] == pairs["outer"]).select("owner", "at", "_step", F.col("inner").alias("node"))
        shorter = shorter.unionByName(active.select("owner", "at", "_step", F.col("now").alias("node")))
        found = shorter.join(own.hint("merge"), "node").where("rank > at AND (_step IS NULL OR rank < _step.rank)").select("rank", "owner")
        grown = active.where("_step IS NOT NULL")
        taken.append(stored(found.unionByName(grown.select(F.col("_step.rank").alias("rank"), "owner")), "taken"))
        active = stored(grown.select("component", "owner", F.col("_step.rank").alias("at"), F.col("_step.node").alias("now")), "active")
    return reduce(DataFrame.unionByName, taken)


def owners(rows: DataFrame, pairs: DataFrame, fold_rows: int = FOLD_ROWS, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """``(rank, owner)``: by which candidate each of the stored ``rows(rank, node)`` is taken up, over the stored ``pairs(inner, outer)`` of nodes."""
    done = []
    left = rows
    while True:
        nodes = stored(left.select("node").distinct(), "nodes")
        edges = pairs.join(nodes.withColumnRenamed("node", "inner"), "inner", "left_semi").join(nodes.withColumnRenamed("node", "outer"), "outer", "left_semi")
        edges = stored(edges.select("inner", "outer"), "containments")
        parts = stored(connected_components(edges, "inner", "outer"), "parts")
        # a trace that nothing contains or is contained in: its first candidate takes all others
        lone = left.join(parts, "node", "left_anti")
        done.append(lone.join(lone.groupBy("node").agg(F.min("rank").alias("owner")).hint("merge"), "node").select("rank", "owner"))
        placed = stored(left.join(parts.hint("merge"), "node").select("component", "rank", "node"), "placed")
        held = edges.join(parts.select(F.col("node").alias("inner"), "component").hint("merge"), "inner").select("component", "inner", "outer")
        sizes = placed.groupBy("component").agg(F.count("*").alias("n")).join(held.groupBy("component").agg(F.count("*").alias("m")), "component")
        sizes = stored(sizes.select("component", ((F.col("n") <= fold_rows) & (F.col("m") <= fold_pairs)).alias("small")), "sizes")
        small, large = (sizes.where(c).select("component") for c in ("small", "NOT small"))
        groups = [f.join(small, "component", "left_semi").groupBy("component") for f in (placed, held)]
        done.append(groups[0].cogroup(groups[1]).applyInPandas(_fold, "rank long, owner long"))
        rest = stored(placed.join(large, "component", "left_semi"), "rest")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        led = stored(_lead(rest, edges), "led")
        done.append(led)
        left = stored(rest.join(led, "rank", "left_anti").select("rank", "node"), "left")


def merge_all(
    rows: DataFrame, by: Sequence[str], trace: str, count: str, size: str, sets: Sequence[str] = (), separator: str = " <- ", flat: str | None = None
) -> DataFrame:
    """``(*by, trace, count, size, merged, *sets)``: every candidate that was not taken up by another, with what it took up.

    Counts add up, ``size`` is the largest (its own), ``trace`` the longest, ``merged`` how many it took, and each column
    of ``sets`` the sorted array of its distinct values. Ties in size and depth go by trace, then by the columns of
    ``sets``. ``flat`` is a trace that has no depth. Null sizes and counts are zero. Candidates
    without a trace, null or empty, stay alone. Groups of ``by``, nulls included, are merged apart. An empty table gives an empty one.
    """
    depth = F.when((F.col(trace) == F.coalesce(F.lit(flat), F.lit(""))) | F.col(trace).isNull(), 0).otherwise(F.size(F.split(trace, f"\\Q{separator}\\E")))
    plain = rows.select(
        F.struct(*by).alias("part") if by else F.lit(0).alias("part"),
        F.coalesce(F.col(trace), F.lit("")).alias("trace"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for c, n in ((count, "n"), (size, "size"))],
        depth.alias("depth"),
        F.struct(*sets).alias("sets") if sets else F.lit(0).alias("sets"),
        F.lit(0).alias("_all"),
        F.lit(1).alias("_one"),
    )
    order: list[Column | str] = [F.desc("size"), F.desc("depth"), F.col("trace"), F.col("sets")]
    ranked = stored(ordered_totals(plain, ["_all"], order, {"rank": "_one"}).drop("_all", "_one"), "ranked")
    traces = stored(ranked.where("trace <> ''").select("part", "trace").distinct().withColumn("id", F.monotonically_increasing_id()), "traces")
    pairs = stored(containments(traces), "pairs")
    nodes = stored(ranked.where("trace <> ''").join(traces.hint("merge"), ["part", "trace"]).select("rank", F.col("id").alias("node")), "candidates")
    owned = ranked.join(owners(nodes, pairs).hint("merge"), "rank", "left").withColumn("owner", F.coalesce("owner", "rank"))
    merged = owned.groupBy("owner").agg(
        F.first("part").alias("part"),  # the same for all
        F.max_by("trace", F.struct(F.length("trace"), "trace")).alias(trace),
        F.sum("n").alias(count),
        F.max("size").alias(size),
        (F.count("*") - 1).alias("merged"),
        *[F.array_sort(F.collect_set(f"sets.{c}")).alias(c) for c in sets],
    )
    return merged.select(*[F.col(f"part.{c}").alias(c) for c in by], trace, count, size, "merged", *sets)
