"""The merge of all candidates against the same rule walked one by one."""

import random

import pytest

from tessera.operators import merging as M

SCHEMA = "g string, trace string, n long, size long, name string, kind string"


def brute(rows):
    out = []
    for group in {r[0] for r in rows}:
        mine = [(g, t or "", n or 0, s or 0, name, kind) for g, t, n, s, name, kind in rows if g == group]
        depth = lambda t: 0 if t in ("", "(none)") else len(t.split(" <- "))
        mine.sort(key=lambda r: (-r[3], -depth(r[1]), r[1], r[4], r[5]))
        used = set()
        for k, row in enumerate(mine):
            if k in used:
                continue
            trace, n, names, kinds, merged = row[1], row[2], {row[4]}, {row[5]}, 0
            for j in range(k + 1, len(mine)):
                other = mine[j][1]
                if j not in used and trace and other and (trace in other or other in trace):
                    used.add(j)
                    trace, n, merged = max(trace, other, key=len), n + mine[j][2], merged + 1
                    names.add(mine[j][4])
                    kinds.add(mine[j][5])
            out.append((group, trace, n, row[3], merged, tuple(sorted(names)), tuple(sorted(kinds))))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r["g"], r["trace"], r["n"], r["size"], r["merged"], tuple(r["name"]), tuple(r["kind"])) for r in frame.collect()), key=repr)


def made(seed, n=120):
    pick = random.Random(seed)
    trace = lambda: " <- ".join(pick.choice(["a", "b", "ab", "core", "zz"]) for _ in range(pick.randint(1, 5)))
    return [
        (pick.choice(["x", None]), pick.choice([trace(), trace(), trace(), "", None, "(none)"]), pick.choice([1, 2, None]), pick.choice([5, 9, 9, 40, None]), pick.choice("pq"), pick.choice("uv"))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_the_walk(spark, seed):
    rows = made(seed)
    assert found(M.merge_all(spark.createDataFrame(rows, SCHEMA), ["g"], "trace", "n", "size", ["name", "kind"], flat="(none)")) == brute(rows)


@pytest.mark.parametrize("bound", [(4, 1_000), (1_000, 3)])
def test_large_components_are_merged_by_joins(spark, monkeypatch, bound):
    monkeypatch.setattr(M.owners, "__defaults__", bound)
    rows = made(7, 40)
    assert found(M.merge_all(spark.createDataFrame(rows, SCHEMA), ["g"], "trace", "n", "size", ["name", "kind"], flat="(none)")) == brute(rows)


def test_growing_traces_reach_what_the_first_did_not(spark):
    rows = [("x", "b", 1, 9, "p", "u"), ("x", "a <- b <- c", 1, 8, "q", "u"), ("x", "a", 1, 7, "p", "v"), ("x", "c <- d", 1, 6, "p", "u")]
    merged = found(M.merge_all(spark.createDataFrame(rows, SCHEMA), ["g"], "trace", "n", "size", ["name", "kind"]))
    assert merged == [("x", "a <- b <- c", 3, 9, 2, ("p", "q"), ("u", "v")), ("x", "c <- d", 1, 6, 0, ("p",), ("u",))] == brute(rows)


def test_one_trace_everywhere_no_groups_and_no_rows(spark):
    rows = [("x", "same <- trace", 1, k % 7, "p", "u") for k in range(500)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in M.merge_all(frame, [], "trace", "n", "size").collect()] == [("same <- trace", 500, 6, 499)]
    assert M.merge_all(frame.limit(0), ["g"], "trace", "n", "size", ["name"]).count() == 0
