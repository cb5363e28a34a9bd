"""Consistent-hash ring with virtual nodes and bounded loads, as DataFrame operations.

Every shard has ``vnodes`` points on a ring of 2^31 positions; a row belongs to the next point
clockwise from its own position. Walking the ring once, each point takes the rows of its arc and
those carried to it, in ring order, until its shard is full; the rest is carried to the next
point, on a second lap too if need be. Capacities add up to the whole, so the balance is exact,
and only rows of overfull shards leave their home.

Arc totals, one row for each point, are all the driver sees. The walk turns them into intervals
of the rows' running total, and rows find their interval by a range join with that small table.

Cases: a null key or text hashes as null and its text counts no bytes. Repeated rows get
different slots. An empty table gives an empty table. A hot key is split, as a row's position
comes from key and text and a full shard passes the rest on. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import POSITION_BITS, hash_position, running_totals
from tessera.runtime import parallelism, stored

LAWS = ("rows", "bytes")


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise; they depend on nothing but the two counts."""
    spots: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            spot = int.from_bytes(hashlib.sha256(f"shard-{shard}-{v}".encode()).digest()[:4]) >> (32 - POSITION_BITS)
            while spot in spots:
                spot = (spot + 1) % (1 << POSITION_BITS)
            spots[spot] = shard
    return sorted(spots.items())


def capacities(total: int, shards: int) -> list[int]:
    """Near-equal whole shares that add up to the total."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(points: Sequence[tuple[int, int]], loads: Sequence[int], room: Sequence[int]) -> list[tuple[int, int, int]]:
    """Intervals (lo, hi, shard) of the running total in ring order.

    ``loads[k]`` arrives at point k; ``loads`` has one more entry, for rows after the last point,
    which are carried to the first point of the next lap.
    """
    room, out, at, carried = list(room), [], 0, 0
    for lap in range(2):
        for k, (_, shard) in enumerate(points):
            carried += loads[k] if lap == 0 else (loads[-1] if k == 0 else 0)
            taken = min(carried, room[shard])
            if taken:
                out.append((at, at + taken, shard))
                at, carried, room[shard] = at + taken, carried - taken, room[shard] - taken
    return out


def by_interval(rows: DataFrame, at: Column, intervals: Sequence[tuple[int, int, int]], names: str, end: int) -> DataFrame:
    """Add the number and the value (``names``: two columns) of the interval [lo, hi) that holds ``at``.

    The line from 0 to ``end`` is cut into cells for an equi-join; ``intervals`` comes from the
    ring's points, so the broadcast table is bounded whatever the data.
    """
    spark, (number, value) = rows.sparkSession, names.split()
    width = max(1, -(-end // 4096))
    plan = spark.createDataFrame([(k, *x) for k, x in enumerate(intervals)], f"{number} int, _lo long, _hi long, {value} int")
    cells = plan.withColumn("_cell", F.explode(F.sequence(F.expr(f"_lo div {width}"), F.expr(f"(_hi - 1) div {width}"))))
    found = rows.withColumn("_x", at.cast("long")).withColumn("_cell", F.expr(f"_x div {width}")).join(F.broadcast(cells), "_cell")
    return found.where("_x >= _lo AND _x < _hi").drop("_x", "_cell", "_lo", "_hi")


def shard_rows(rows: DataFrame, key: Sequence[str], weight: str | None = None, shards: int = 16, vnodes: int = 128) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in its shard) and ``home`` (its shard if none were full).

    Loads are counts of rows, which end at most one apart, or sums of the positive whole-number
    column ``weight``, where a row on a border goes to the earlier shard. ``rows`` is read several
    times: pass a stored table.
    """
    spark = rows.sparkSession
    points = ring_points(shards, vnodes)
    spots = [-1, *[p for p, _ in points], (1 << POSITION_BITS) - 1]
    owners = [s for _, s in points]
    arcs = [(a + 1, b + 1, s) for a, b, s in zip(spots, spots[1:], [*owners, owners[0]], strict=False) if a < b]
    size = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    placed = rows.withColumns({"_at": hash_position(*[F.col(k) for k in key]), "_size": size, "_one": F.lit(1)})
    placed = by_interval(placed, F.col("_at"), arcs, "_arc home", 1 << POSITION_BITS)
    got = {r["_arc"]: r["load"] for r in placed.groupBy("_arc").agg(F.sum("_size").alias("load")).collect()}
    loads = [got.get(k, 0) for k in range(len(points) + 1)]
    intervals = walk(points, loads, capacities(sum(loads), shards))
    ranked = running_totals(placed, [], "_at", [*key], {"_rank": "_one", "_load": "_size"}, 4 * parallelism(spark))
    dealt = by_interval(ranked, F.col("_load"), intervals, "_piece shard", sum(loads))
    pieces = intervals_by_rank(intervals) if weight is None else counted(dealt := stored(dealt, "sharded"))
    filled, shifts = dict.fromkeys(range(shards), 0), []
    for piece, shard, first, rows_in in pieces:
        shifts.append((piece, filled[shard] - first))
        filled[shard] += rows_in
    bases = spark.createDataFrame(shifts, "_piece int, _shift long")
    slot = (F.col("_rank") + F.col("_shift")).alias("slot")
    return dealt.join(F.broadcast(bases), "_piece").select(*rows.columns, "shard", slot, "home")


def intervals_by_rank(intervals: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(piece, shard, first rank, rows) where the running total counts rows."""
    return [(k, shard, lo, hi - lo) for k, (lo, hi, shard) in enumerate(intervals)]


def counted(dealt: DataFrame) -> list[tuple[int, int, int, int]]:
    """The same from the rows: one for each interval."""
    parts = dealt.groupBy("_piece", "shard").agg(F.min("_rank").alias("first"), F.count("*").alias("n")).collect()
    return sorted((r["_piece"], r["shard"], r["first"], r["n"]) for r in parts)
