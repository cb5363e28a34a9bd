"""Packing token pieces into fixed-length sequences by cutting-stock column generation.

Documents are encoded, cut into full pieces and one rest, and the histogram of piece lengths (in
units of ``grain`` tokens, rounded up) goes to the driver: at most ``length / grain`` counts. A
linear program over patterns, multisets of lengths that fit one sequence, is solved by column
generation: it starts from greedy fillings, and the duals of the current patterns price a knapsack,
whose dynamic program yields the best new pattern, until none improves. Pattern counts are rounded down, what is left is packed
greedily by the same histogram, and pieces, ranked inside their length class, are dealt to
pattern slots by arithmetic on their rank. No text or id ever passes through the driver.

Cases: a null text is an empty document, whose only id is the end id. Repeated rows are separate
documents. An empty table gives an empty table. A text longer than a sequence is cut, never
dropped. Other columns of documents are ignored; other columns of pieces are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder
from tessera.operators.prefix import hash_position, running_totals
from tessera.runtime import parallelism, small_batches, spread

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def cut_documents(documents: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Encode ``documents(doc_id, text)``, append ``end_id`` and cut into pieces of at most ``length`` ids."""
    small_batches(documents.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, bytes]] = []
            encoded = encoder(tokenizer).batch(batch.column(1).to_pylist())
            for name, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(name, at, min(length, n - at), n, ids[4 * at : 4 * (at + length)]) for at in range(0, n, length)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"]
            )

    return spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(cut, PIECES)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the multiset of sizes with the most value that fits."""
    worth = np.full(capacity + 1, -np.inf)
    worth[sizes] = values
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        offers = worth[1 : room + 1] + best[room - 1 :: -1][:room]
        k = int(offers.argmax())
        if offers[k] > best[room - 1]:
            best[room], taken[room] = offers[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    place = {int(s): i for i, s in enumerate(sizes)}
    while room:
        if taken[room]:
            pattern[place[int(taken[room])]] += 1
            room -= int(taken[room])
        else:
            room -= 1
    return float(best[capacity]), pattern


def first_patterns(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A basis, patterns as columns, its inverse, and how often each is used: greedy fillings, largest first.

    A filling is used until the demand for one of its sizes is met, and later ones are without that size. So the
    basis is triangular, and its inverse grows a row for each filling.
    """
    left, patterns, use = need.copy(), np.zeros((len(sizes), len(sizes)), dtype=np.int64), np.zeros(len(sizes))
    open_, inverse = np.ones(len(sizes), dtype=bool), np.zeros((len(sizes), len(sizes)))
    for turn in range(len(sizes)):
        fill, room = patterns[:, turn], capacity
        for k in np.flatnonzero(open_)[::-1]:
            if sizes[k] <= room:
                fill[k] = max(1, min(room // sizes[k], int(left[k])))
                room -= fill[k] * sizes[k]
        ratios = np.where(fill > 0, left / np.maximum(fill, 1), np.inf)
        out = int(ratios.argmin())
        use[turn] = ratios[out]
        left = np.maximum(left - use[turn] * fill, 0)
        left[out], open_[out] = 0, False
        inverse[turn, out] = 1.0
        inverse[turn] = (inverse[turn] - patterns[out, :turn] @ inverse[:turn]) / fill[out]
    return patterns, inverse, use


def solve_patterns(demand: dict[int, int], capacity: int, gap: float = 1e-4, max_rounds: int = 2000, smooth: float = 0.9) -> list[tuple[dict[int, int], int]]:
    """Patterns (size: copies) with integer counts that meet ``demand`` (size: pieces) exactly.

    Columns are priced at duals drawn towards the best ones so far, at first each size's share of the
    capacity, since the simplex method's own duals swing widely while patterns are few; where such a price
    finds nothing, the swing is let go by steps. Stops when the linear program's value is within ``gap``, or
    half a sequence, of the best bound that duals have proved; every round's patterns are feasible, so stopping
    early stays exact.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], dtype=np.float64)
    # tiny unequal surpluses keep ratios from tying, which would let the simplex method stall
    patterns, inverse, use = first_patterns(sizes, need + np.linspace(1e-3, 2e-3, len(need)), capacity)
    center = sizes / capacity
    proved, hold = float(center @ need), smooth
    for _ in range(max_rounds):
        if use.sum() - proved <= max(0.5, gap * use.sum()):
            break
        duals = inverse.sum(axis=0)
        asked = hold * center + (1 - hold) * duals
        value, column = best_pattern(asked, sizes, capacity)
        bound = float(asked @ need) / max(value, 1.0)
        if bound > proved:
            proved, center = bound, asked / max(value, 1.0)
        if duals @ column <= 1 + 1e-9:
            if hold == 0:
                break
            hold = hold - 0.3 if hold > 0.3 else 0.0
            continue
        hold = smooth
        step = inverse @ column
        ratios = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        use -= ratios[out] * step
        use[out] = ratios[out]
        patterns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        use = np.maximum(use, 0)
    counts = np.floor(use).astype(np.int64)
    left = need.astype(np.int64) - patterns @ counts
    while (left < 0).any():  # by the surpluses or by rounding errors
        counts[int(np.argmax((patterns[left < 0] * (counts > 0)).sum(axis=0)))] -= 1
        left = need.astype(np.int64) - patterns @ counts
    found = [(patterns[:, k], int(counts[k])) for k in range(len(sizes)) if counts[k]]
    while left.any():  # largest first, as often as the rest allows
        fill, room = np.zeros_like(left), capacity
        for k in range(len(sizes) - 1, -1, -1):
            fill[k] = min(left[k], room // sizes[k])
            room -= fill[k] * sizes[k]
        times = int((left[fill > 0] // fill[fill > 0]).min())
        found.append((fill, times))
        left = left - times * fill
    return [({int(sizes[k]): int(a[k]) for k in np.flatnonzero(a)}, n) for a, n in found]


def pack_pieces(pieces: DataFrame, length: int = 2048, grain: int = 4) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces(doc_id, start, length, ...)``.

    ``pieces`` is read several times: pass a stored table. Lengths are rounded up to ``grain``
    tokens for planning, which costs at most ``grain - 1`` tokens of padding a piece. Pieces are ranked by a hash of
    what tells them apart, contents included, so rows of one id neither share a bucket nor change places between runs.
    """
    spark = pieces.sparkSession
    capacity = length // grain
    apart = [c for c in ("doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids") if c in pieces.columns]
    work = pieces.withColumns(
        {"_units": F.ceil(F.col("length") / grain).cast("int"), "_one": F.lit(1), "_at": hash_position(*map(F.col, apart))}
    )
    # at most length / grain rows
    histogram = {r["_units"]: r["count"] for r in work.groupBy("_units").count().collect()}
    slots, first = [], 0
    dealt = dict.fromkeys(histogram, 0)
    for pattern, times in solve_patterns(histogram, capacity):
        for units, copies in pattern.items():
            slots.append((units, dealt[units], dealt[units] + copies * times, copies, first))
            dealt[units] += copies * times
        first += times
    # the patterns of one histogram: bounded by its length, whatever the data
    plan = spark.createDataFrame(slots, "_units int, _lo long, _hi long, _copies int, _first long")
    ranked = running_totals(work, ["_units"], "_at", apart, {"_rank": "_one"}, 4 * parallelism(spark))
    dealt_out = ranked.join(
        F.broadcast(plan), (ranked["_units"] == plan["_units"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    ).withColumn("sequence_id", F.col("_first") + F.expr("(_rank - _lo) div _copies")).drop(plan["_units"])
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_units"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    return dealt_out.select(*pieces.columns, "sequence_id", offset)
