import random

import numpy as np
import public_tokenizers
import pytest

from tessera.llm.packing import best_pattern, cut_documents, pack_pieces, solve_patterns
from tessera.runtime import stored

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(8))
def test_patterns_meet_demand_exactly(seed):
    rng = random.Random(seed)
    demand = {s: rng.randint(1, 10 ** rng.randint(0, 4)) for s in rng.sample(range(1, 65), rng.randint(1, 40))}
    patterns = solve_patterns(demand, 64)
    made: dict[int, int] = {}
    for pattern, times in patterns:
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            made[s] = made.get(s, 0) + n * times
    assert made == demand
    assert sum(t for _, t in patterns) <= best_fit(demand, 64) + 2


def best_fit(demand, capacity):
    """Sequences that best-fit decreasing opens."""
    rooms, opened = [0] * (capacity + 1), 0
    for size in sorted(demand, reverse=True):
        for _ in range(demand[size]):
            room = next((r for r in range(size, capacity + 1) if rooms[r]), None)
            if room is None:
                opened, room = opened + 1, capacity
            else:
                rooms[room] -= 1
            rooms[room - size] += 1
    return opened


def test_no_demand():
    assert solve_patterns({}, 64) == []


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        values = rng.random(4)
        best = [0.0] * 21
        for room in range(1, 21):
            best[room] = max([best[room - 1], *[best[room - s] + v for s, v in zip(sizes, values, strict=True) if s <= room]])
        value, pattern = best_pattern(values, sizes, 20)
        assert abs(value - best[20]) < 1e-9 and abs(pattern @ values - value) < 1e-9 and pattern @ sizes <= 20


def test_every_id_lies_in_one_piece(documents):
    pieces = stored(cut_documents(documents, BYTE, 1, length=64), "pieces")
    packed = pack_pieces(pieces, length=64, grain=4).collect()
    assert len(packed) == pieces.count() and "ids" in packed[0]
    by_sequence: dict[int, list] = {}
    for r in packed:
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 64
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 64
    used = sum(n for spans in by_sequence.values() for _, n in spans)
    assert used >= 0.93 * 64 * len(by_sequence)
    tokens = documents.count()  # every document ends with one end id
    assert sum(r["ids"][-4:] == b"\1\0\0\0" and r["start"] + r["length"] == r["doc_tokens"] for r in packed) == tokens


def test_empty_table(empty):
    assert pack_pieces(stored(cut_documents(empty, BYTE, 1), "pieces")).count() == 0


def test_little_padding_and_few_rounds():
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(1, 1500, 20_000), np.full(9_000, 2048), rng.integers(1, 60, 8_000)])
    demand = {int(u): int(n) for u, n in zip(*np.unique(-(-lengths // 4), return_counts=True), strict=True)}
    plan = solve_patterns(demand, 512)
    made = {}
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 512
        for s, n in pattern.items():
            made[s] = made.get(s, 0) + n * times
    assert made == demand
    assert sum(t for _, t in plan) <= 1.005 * lengths.sum() / 2048


def test_places_do_not_depend_on_the_order_of_rows_where_ids_repeat(spark):
    rows = [(1, 0, 5 + k % 90, 5 + k % 90, 1000 + k) for k in range(300)]

    def places(rows):
        frame = spark.createDataFrame(rows, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long").repartition(3)
        return sorted(map(tuple, pack_pieces(stored(frame, "pieces"), length=128).collect()))

    assert places(rows) == places(rows[::-1])
