"""Running totals without a single-task window.

Rows are placed on a line, by an unsigned 31-bit position or by the order of their columns. The
line is cut into buckets, bucket totals (a few rows for each bucket) are accumulated, and a window
inside each bucket does the rest, so no task sees more than one bucket of one group however large
the group is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import parallelism, stored

POSITION_BITS = 31


def hash_position(*cols: Column) -> Column:
    """The top 31 bits of a 64-bit hash: a position for ``bucket_of``."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - POSITION_BITS)


def bucket_of(position: Column, buckets: int) -> Column:
    """Bucket of a position; monotone, so the order of rows does not depend on ``buckets``."""
    return F.shiftright(position * F.lit(buckets).cast("long"), POSITION_BITS)


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    position: str,
    order: Sequence[str],
    totals: Mapping[str, str],
    buckets: int,
) -> DataFrame:
    """Add, for each ``out: weight`` in ``totals``, the sum of ``weight`` over all earlier rows of the group.

    Earlier means by ``position``, then ``order``. Rows that tie in all of these get distinct,
    gapless intervals in an unspecified order. Group keys and positions must not be null; null
    weights count as zero. ``df`` is read twice, so pass a stored or cheap plan.
    """
    cell = df.withColumn("_bucket", bucket_of(F.col(position), buckets))
    return _by_bucket(cell, groups, [position, *order], totals, df.columns)


def ordered_totals(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], totals: Mapping[str, str]) -> DataFrame:
    """The same for any order of columns: a group's rows are dealt to ranges of that order.

    The ranged rows are written once, since sampled range borders must not move between two reads.
    Group keys must not be null.
    """
    ranged = df.repartitionByRange(parallelism(df.sparkSession), *groups, *order).withColumn("_bucket", F.spark_partition_id())
    return _by_bucket(stored(ranged, "ranged"), groups, order, totals, df.columns)


def _by_bucket(cell: DataFrame, groups: Sequence[str], order: Sequence[Column | str], totals: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cell.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(w), F.lit(0))).alias(f"_sum_{o}") for o, w in totals.items()])
    bases = bases.select(
        *keys, *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_base_{o}") for o in totals]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cell.join(bases, on=keys)  # hashed on the same keys as the window: one shuffle serves both
    outs = [
        (F.col(f"_base_{o}") + F.coalesce(F.sum(F.coalesce(F.col(w), F.lit(0))).over(inside), F.lit(0))).alias(o)
        for o, w in totals.items()
    ]
    return joined.select(*columns, *outs)


def ordered_scan(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, str] | None = None, maxima: Mapping[str, str] | None = None
) -> DataFrame:
    """Add sums and maxima of columns over all earlier rows of a group, for any order and groups, nulls included.

    What is carried from one range of the order to the next is a sum or a maximum a group (a maximum of structs that begin
    with the order is the last row of some kind), so a group that holds most rows is many tasks. Sums begin
    at 0 and maxima at null; null weights count as zero. Ties stand in an unspecified order.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    columns = df.columns
    keyed = df.withColumn("_group", F.struct(*[F.col(g) for g in groups], F.lit(0).alias("_none")))
    ranged = stored(keyed.repartitionByRange(parallelism(df.sparkSession), "_group", *order).withColumn("_bucket", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_group", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(F.col(w)).alias(f"_sum_{o}") for o, w in sums.items()] + [F.max(F.col(w)).alias(f"_max_{o}") for o, w in maxima.items()]
    # a row for each range of a group
    bases = ranged.groupBy("_group", "_bucket").agg(*whole)
    carried = [F.sum(f"_sum_{o}").over(before).alias(f"_base_{o}") for o in sums] + [F.max(f"_max_{o}").over(before).alias(f"_base_{o}") for o in maxima]
    joined = ranged.join(bases.select("_group", "_bucket", *carried), ["_group", "_bucket"])
    outs = [(F.coalesce(f"_base_{o}", F.lit(0)) + F.coalesce(F.sum(F.col(w)).over(inside), F.lit(0))).alias(o) for o, w in sums.items()]
    outs += [F.greatest(f"_base_{o}", F.max(F.col(w)).over(inside)).alias(o) for o, w in maxima.items()]
    return joined.select(*columns, *outs)
