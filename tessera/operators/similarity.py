"""Similarity of chains: containment joins, classes of similar chains, and ordered merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components


def contains_run(outer: Column, inner: Column) -> Column:
    """Whether ``inner`` stands in ``outer`` as one run."""
    starts = F.sequence(F.lit(0), F.size(outer) - F.size(inner))
    fits = F.size(inner) <= F.size(outer)
    return fits & F.exists(F.when(fits, starts).otherwise(F.array().cast("array<int>")), lambda i: F.slice(outer, i + 1, F.size(inner)) == inner)


def contains_in_order(outer: Column, inner: Column) -> Column:
    """Whether ``inner``'s items stand in ``outer`` in order, others between them allowed."""
    matched = F.aggregate(outer, F.lit(0), lambda at, x: at + F.when(F.get(inner, at) == x, 1).otherwise(0))
    return matched == F.size(inner)


def similar_pairs(chains: DataFrame, chain_id: str, within: Sequence[str], chain: str, how: str = "run") -> DataFrame:
    """``(a, b)``, a < b, of chains one of which contains the other, within equal ``within`` columns.

    Chains containing each other share their ``within`` columns and the shorter one's first item,
    so that item, taken from the shorter and looked up in every item of the longer, is part of the
    join key and no class is paired with itself wholesale. Equal chains are paired through the one
    of least id only: compare classes, not copies.
    """
    test = {"run": contains_run, "order": contains_in_order}[how]
    distinct = chains.groupBy(*within, chain).agg(F.min(chain_id).alias("a"))
    short = distinct.select(*within, F.col("a").alias("sa"), F.col(chain).alias("sc"), F.get(chain, 0).alias("_item"))
    long = distinct.select(*within, F.col("a").alias("la"), F.col(chain).alias("lc"), F.explode(F.array_distinct(chain)).alias("_item"))
    pairs = short.join(long, [*within, "_item"]).where((F.col("sa") != F.col("la")) & (F.size("sc") <= F.size("lc")))
    pairs = pairs.where(test(F.col("lc"), F.col("sc")))
    return pairs.select(F.least("sa", "la").alias("a"), F.greatest("sa", "la").alias("b")).distinct()


def chain_classes(pairs: DataFrame) -> DataFrame:
    """Classes of chains that are similar through others: ``(node, component)``."""
    return connected_components(pairs, "a", "b")


def merge_similar(rows: DataFrame, by: str, order: Sequence[str], trace: str, count: str, size: str, most: int = 20, longest: bool = False) -> DataFrame:
    """Fold each group's first rows, in order, into those whose trace contains theirs or the reverse.

    Counts add up while sizes keep their maximum; the first row of a fold lends its trace, or, with ``longest``, the
    row with the longest chain so far. The result depends on the order, so a group's top ``most``
    rows, which is all that the rule asks for, are folded as one array. ``merging.merge_all`` has no such cut.
    """
    w = Window.partitionBy(by).orderBy(*order)
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    row = F.struct("_n", F.col(trace).alias("t"), F.col(count).cast("long").alias("c"), F.col(size).cast("long").alias("s"))
    items = top.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    items = items.select(by, F.transform("_rows", lambda r: F.struct(r["t"], r["c"], r["s"])).alias("_rows"))

    def links(t: Column) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(" <- "), F.lit("")))

    def fold(kept: Column, row: Column) -> Column:
        meets = F.transform(kept, lambda k: F.contains(k["t"], row["t"]) | F.contains(row["t"], k["t"]))
        at = F.array_position(meets, True)

        def taken(k: Column, i: Column) -> Column:
            longer = F.when(links(row["t"]) > links(k["t"]), row["t"]).otherwise(k["t"]) if longest else k["t"]
            both = F.struct(longer.alias("t"), (k["c"] + row["c"]).alias("c"), F.greatest(k["s"], row["s"]).alias("s"))
            return F.when(i + 1 == at, both).otherwise(k)

        return F.when(at > 0, F.transform(kept, taken)).otherwise(F.concat(kept, F.array(row)))

    folded = items.select(by, F.explode(F.aggregate("_rows", F.slice("_rows", 1, 0), fold)).alias("_kept"))
    return folded.select(by, F.col("_kept.t").alias(trace), F.col("_kept.c").alias(count), F.col("_kept.s").alias(size))
