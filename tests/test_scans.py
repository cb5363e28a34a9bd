"""Scans, budgets, sums over trees and index changes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import prefix as P
from tessera.operators import relational as R


def rows_of(seed, n=300):
    pick = random.Random(seed)
    # one group, a null, holds most rows
    return [(None if pick.random() < 0.7 else pick.choice("ab"), k, pick.choice([None, 1, 5, 40, 90])) for k in range(n)]


def test_sums_and_maxima_of_earlier_rows(spark):
    rows = rows_of(1)
    found = P.ordered_scan(spark.createDataFrame(rows, "g string, k int, v int").repartition(3), ["g"], ["k"], {"s": "v"}, {"m": "v"}).collect()
    for g in (None, "a", "b"):
        total, most = 0, None
        for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["k"]):
            assert (r["s"], r["m"]) == (total, most)
            total, most = total + (r["v"] or 0), max((x for x in (most, r["v"]) if x is not None), default=None)
    assert len(found) == len(rows)
    assert P.ordered_scan(spark.createDataFrame([], "g string, k int, v int"), ["g"], ["k"], {"s": "v"}).count() == 0


def test_sessions_of_null_groups(spark):
    rows = [(None, 1, "a"), (None, 2, "open"), (None, 3, "a"), ("u", 1, "open")]
    found = R.sessions(spark.createDataFrame(rows, "u string, i int, k string"), ["u"], ["i"], F.col("k") == "open")
    assert sorted(((r["u"] or "", r["i"], r["session"]) for r in found.collect())) == [("", 1, 0), ("", 2, 1), ("", 3, 1), ("u", 1, 1)]


@pytest.mark.parametrize(("most", "budget"), [(3, 100), (1, 5), (50, 130), (0, 10)])
def test_joint_budget_skips_and_goes_on(spark, most, budget):
    rows = rows_of(2, 60)
    found = R.joint_budget(spark.createDataFrame(rows, "g string, k int, v int"), "g", ["k"], "v", min(most, 8), budget)
    expected = set()
    for g in (None, "a", "b"):
        n = total = 0
        for _, k, v in (r for r in rows if r[0] == g and r[2] is not None):
            if n < min(most, 8) and total + v <= budget:
                n, total = n + 1, total + v
                expected.add((g, k, v))
    assert {tuple(r) for r in found.collect()} == expected


def test_loose_releases(spark):
    took = [("e", "net.conn"), ("e", "conn"), ("e", "other.thing"), ("f", "conn"), (None, "x"), ("e", None), ("e", "conn")]
    gave = [("e", "my.conn"), ("f", "nothing"), (None, "x")]
    found = R.unpaired_loose(spark.createDataFrame(took, "ev string, ob string"), spark.createDataFrame(gave, "ev string, ob string"), "ev", "ob")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("e", "net.conn"), ("e", "other.thing"), ("f", "conn"), (None, "x"), ("e", None)], key=repr)


def test_index_changes_settle(spark):
    known = spark.createDataFrame([("a", 4), ("b", 9), ("gone", 2)], "path string, number long")
    rows = spark.createDataFrame([("b",), ("a",), ("d",), ("c",), ("c",), (None,)], "path string")
    found = {tuple(r) for r in R.assign_ids(known, rows, "path").collect()}
    assert found == {("a", 4, "kept"), ("b", 9, "kept"), ("gone", 2, "removed"), ("c", 10, "added"), ("d", 11, "added")}
    second = R.assign_ids(spark.createDataFrame([r[:2] for r in found if r[2] != "removed"], "path string, number long"), rows, "path")
    assert {r["change"] for r in second.collect()} == {"kept"}
    first = R.assign_ids(known.limit(0), rows, "path").collect()
    assert {(r["path"], r["number"]) for r in first} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_sums_over_random_trees(spark):
    pick = random.Random(3)
    parent = {("g", k): pick.randrange(k) for k in range(1, 60)} | {("h", k): k - 1 for k in range(1, 40)}
    nodes = [("g", k, pick.choice("xyz"), k) for k in range(60)] + [("h", k, "xy"[k % 2], 1) for k in range(40)]

    def up(g, k):
        while (g, k) in parent:
            k = parent[g, k]
            yield k

    name = {(g, k): n for g, k, n, _ in nodes}
    tree = spark.createDataFrame([(g, k, p) for (g, k), p in parent.items()], "graph string, node long, parent long")
    frame = spark.createDataFrame(nodes, "graph string, node long, name string, size long")
    sums = {(g, k): 0 for g, k, *_ in nodes}
    for g, k, _, size in nodes:
        for a in (k, *up(g, k)):
            sums[g, a] += size
    assert {(r["graph"], r["node"]): r["retained"] for r in G.subtree_sums(tree, frame).collect()} == sums
    expected = {}
    for g, k, n, size in nodes:
        count, total = expected.get((g, n), (0, 0))
        expected[g, n] = (count + 1, total + size * all(name[g, a] != n for a in up(g, k)))
    assert {(r["graph"], r["name"]): (r["n"], r["retained"]) for r in G.topmost_sums(tree, frame).collect()} == expected


def test_a_chain_of_a_hundred_thousand_nodes(spark):
    chain = spark.range(1, 100_000).select(F.lit("c").alias("graph"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    nodes = spark.range(100_000).select(F.lit("c").alias("graph"), F.col("id").alias("node"), F.lit(2).alias("size"))
    assert G.subtree_sums(chain, nodes).where("retained <> 2 * (100000 - node)").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_and_cycles_in_them(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(16), pick.randrange(16)) for _ in range(22)] + [(20, 20), (21, 22), (None, 3)]
    real = {(a, b) for a, b in edges if a is not None}
    names = {x for e in real for x in e}
    reach = {a: {a} for a in names}
    for _ in names:
        reach = {a: set.union(seen, *({b for x, b in real if x == m} for m in seen)) for a, seen in reach.items()}
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in G.strong_components(frame, "a", "b").collect()}
    assert found == {a: min(b for b in reach[a] if a in reach[b]) for a in names}
    plain, strong = ({tuple(r["nodes"]) for r in G.cycles(frame, "a", "b", 5, strong=s).collect()} for s in (False, True))
    assert plain == strong and (20,) in strong
