"""Operators on small tables with nulls, ties, repeats and no rows, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import graph as G
from tessera.operators import relational as R
from tessera.operators import retrieval as T
from tessera.operators import similarity as M
from tessera.operators.prefix import hash_position, running_totals


def values(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("a", 1, 10), ("a", 2, 30), ("b", 3, 40), ("b", 3, 40), (None, 4, 5), ("c", 5, None), ("d", 6, 0)]
    return spark.createDataFrame(rows, "k string, t int, v int")


def test_latest_takes_the_last_of_each_key(sales):
    assert values(R.latest_by(sales, ["k"], ["t"], ["t", "v"]), "k", "t", "v") == [("a", 2, 30), ("b", 3, 40), ("c", 5, None), ("d", 6, 0), (None, 4, 5)]


def test_shares_add_up_and_count_every_row(sales):
    shared = R.share_of_total(sales.groupBy("k").agg(F.sum("v").alias("v")), "v").collect()
    assert sum(r["share"] or 0 for r in shared) == pytest.approx(100)
    top = R.top_shares(sales, ["k"], F.coalesce("v", F.lit(0)), 10, 1, ["k"]).collect()
    assert [(r["k"], r["total"], r["n"]) for r in top] == [("b", 80, 2)]


def test_versions_are_compared_both_ways(spark):
    before = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, v int")
    now = spark.createDataFrame([("y", 2), ("z", 1), ("w", 5)], "k string, v int")
    got = values(R.compare_versions(before, now, "k", "v"), "k", "before", "now", "delta", "status")
    assert got == [("w", 0, 5, 5, "new"), ("x", 1, 0, -1, "removed"), ("y", 2, 2, 0, "unchanged"), ("z", 3, 1, -2, "decreased")]


def test_cumulative_share_takes_the_row_that_crosses(spark):
    rows = spark.createDataFrame([("a", 40), ("b", 30), ("c", 20), ("d", 10)], "k string, v int")
    got = R.cumulative_share(rows, "v", [F.desc("v")], 0.5)
    assert values(got, "k", "running") == [("a", 40), ("b", 70)]


def test_budgets_cut_and_skip(spark):
    rows = spark.createDataFrame([("g", 1, "aaaa"), ("g", 2, "bbbb"), ("g", 3, "cc"), ("h", 1, "x")], "g string, o int, s string")
    assert values(R.within_budget(rows, ["g"], ["o"], "s", 6), "g", "s") == [("g", "aaaa"), ("g", "bb"), ("h", "x")]
    sized = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4), ("g", 4, 1)], "g string, o int, n long")
    assert values(R.joint_budget(sized, "g", ["o"], "n", 2, 10), "o", "n") == [(1, 5), (3, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_ranges_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    points = [(k, rng.randint(-50, 50)) for k in range(40)]
    ranges = [(k, lo, lo + rng.randint(1, 30)) for k in range(10) for lo in [rng.randint(-50, 50)]]
    got = R.in_range(spark.createDataFrame(points, "p int, x int"), F.col("x"), spark.createDataFrame(ranges, "r int, lo int, hi int"), "lo", "hi", 16)
    assert values(got, "p", "r") == sorted(((p, r) for p, x in points for r, lo, hi in ranges if lo <= x < hi), key=repr)


def test_sessions_tails_and_last_blocks(spark):
    rows = spark.createDataFrame([("u", i, m) for i, m in enumerate("abMcdMef")] + [("w", 0, "z")], "u string, i int, m string")
    marked = F.col("m") == "M"
    assert [r["session"] for r in R.sessions(rows, ["u"], ["i"], marked).where("u = 'u'").orderBy("i").collect()] == [0, 0, 1, 1, 1, 2, 2, 2]
    assert values(R.tail_before_last(rows, ["u"], ["i"], marked, 3), "i", "back") == [(3, 3), (4, 2), (5, 1)]
    assert values(R.after_last(rows, ["u"], ["i"], marked), "u", "i") == [("u", 5), ("u", 6), ("u", 7), ("w", 0)]


def test_unpaired_keys_may_be_null(spark):
    took = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, at int")
    gave = spark.createDataFrame([("a", 0), (None, 5)], "k string, t int")
    assert values(R.unpaired(took, gave, ["k"]), "k") == [("c",)]
    assert values(R.unpaired(took, gave, ["k"], ("at", "t")), "k") == [("a",), ("c",)]


def test_even_split_drops_the_rest(spark):
    rows = spark.createDataFrame([("i", "p", 10), ("i", "q", 10), ("i", "q", 10), ("i", "r", 10), ("j", None, 7)], "item string, owner string, size long")
    assert values(R.even_split(rows, "item", "owner", "size"), "owner", "attributed", "items") == [("p", 3, 1), ("q", 3, 1), ("r", 3, 1)]


def test_even_split_counts_no_rows_where_they_are_read(spark):
    """Equal pairs meet after the rows are dealt to tasks, and an item with many owners is in many of these."""
    made = [("hot", k % 300, 90_000) for k in range(900)] + [(f"i{k % 50}", k % 7, 1000 + k % 50) for k in range(400)] + [("z", None, 5), (None, 3, 5), ("none", 4, None)]
    split = R.even_split(spark.createDataFrame(made, "item string, owner long, size long"), "item", "owner", "size")
    owners = {i: {o for j, o, _ in made if j == i and o is not None} for i, *_ in made if i}
    expected = {}
    for i, o, s in {x for x in made if x[0] and x[1] is not None}:
        total, items = expected.get(o, (None, 0))
        expected[o] = (total if s is None else (total or 0) + s // len(owners[i]), items + 1)
    assert {r[0]: (r[1], r[2]) for r in split.collect()} == expected
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert all("Aggregate" not in part for part in plan.split("_cell#")[-1:]) and plan.count("REPARTITION_BY_NUM") >= 2



@pytest.mark.parametrize("buckets", [1, 7])
def test_running_totals_tile_the_line(spark, buckets):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 5).alias("w")).withColumn("at", hash_position("id"))
    got = running_totals(rows, ["g"], "at", ["id"], {"sum": "w"}, buckets).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values(["sum", "w"])
        ordered = part.sort_values(["at", "id"])
        assert (ordered["sum"] == ordered["w"].cumsum() - ordered["w"]).all()


def naive_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed,shape", [(0, "random"), (1, "random"), (2, "path"), (3, "star")])
def test_components(spark, seed, shape):
    rng = random.Random(seed)
    if shape == "random":
        edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    elif shape == "path":
        names = rng.sample(range(1000), 60)
        edges = list(itertools.pairwise(names))
    else:
        edges = [(999, k) for k in range(50)]
    got = G.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), "a", "b")
    assert dict(values(got, "node", "component")) == naive_components(edges)


def test_graph_walks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (4, None)], "a long, b long")
    anchors = spark.createDataFrame([(1,)], "anchor long")
    assert values(G.reachable(edges, "a", "b", anchors, 2), "node", "depth") == [(1, 0), (2, 1), (3, 2)]
    assert values(G.reachable(edges, "a", "b", anchors, 1, both_ways=True), "node", "depth") == [(1, 0), (2, 1), (3, 1)]
    paths = G.shortest_paths(edges, "a", "b", spark.createDataFrame([(1,)], "node long"), 5)
    assert {r["node"]: r["path"] for r in paths.collect() if r["node"]}[4] == [1, 2, 3, 4]
    assert sorted(r["nodes"] for r in G.cycles(edges, "a", "b", 4).collect()) == [[1, 2, 3], [5]]


def test_dominators(spark):
    # a diamond: neither arm dominates what lies below both
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], "a long, b long").withColumn("g", F.lit("x"))
    got = G.dominators(edges, "g", "a", "b", F.lit(0))
    assert dict(values(got, "node", "parent")) == {1: 0, 2: 0, 3: 0, 4: 3}


def test_only_topmost_nodes_of_a_name_are_summed(spark):
    tree = spark.createDataFrame([("x", 1, 0), ("x", 2, 1), ("x", 3, 2), ("x", 4, 0)], "graph string, node long, parent long")
    nodes = spark.createDataFrame([("x", 0, "root", 9), ("x", 1, "A", 6), ("x", 2, "B", 5), ("x", 3, "A", 4), ("x", 4, "A", 2)], "graph string, node long, name string, size long")
    assert values(G.topmost_sums(tree, nodes), "name", "n", "retained") == [("A", 3, 8), ("B", 1, 5), ("root", 1, 9)]


def runs(outer, inner):
    return any(outer[i : i + len(inner)] == inner for i in range(len(outer) - len(inner) + 1))


def in_order(outer, inner):
    rest = iter(outer)
    return all(x in rest for x in inner)


@pytest.mark.parametrize("how,test", [("run", runs), ("order", in_order)])
def test_similar_chains_against_all_pairs(spark, how, test):
    rng = random.Random(5)
    chains = {tuple(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(40)}
    rows = [(k, "r", list(c)) for k, c in enumerate(sorted(chains))]
    got = M.similar_pairs(spark.createDataFrame(rows, "id long, root string, chain array<string>"), "id", ["root"], "chain", how)
    expected = [(i, j) for i, _, a in rows for j, _, b in rows if i < j and (test(a, b) or test(b, a))]
    assert values(got, "a", "b") == sorted(expected, key=repr)


def test_merging_keeps_the_largest_size(spark):
    rows = spark.createDataFrame([("g", 1, "a <- b", 1, 10), ("g", 2, "a <- b <- c", 2, 30), ("g", 3, "x", 4, 5)], "g string, o int, trace string, n long, size long")
    assert values(M.merge_similar(rows, "g", ["o"], "trace", "n", "size"), "trace", "n", "size") == [("a <- b", 3, 30), ("x", 4, 5)]
    assert values(M.merge_similar(rows, "g", ["o"], "trace", "n", "size", longest=True), "trace", "n", "size") == [("a <- b <- c", 3, 30), ("x", 4, 5)]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "List view", "a scrolling list of items"), (2, "Grid", "lists are not matched"), (3, "list", None)], "id int, title string, body string")
    scored = docs.withColumn("score", T.relevance(F.col("title"), F.coalesce("body", F.lit("")), {"list": 2}))
    assert values(scored, "id", "score") == [(1, 8), (2, 0), (3, 16)]
    assert values(T.relative_cutoff(scored, "score", slack=8, part=0.72), "id") == [(3,)]
    assert [r["id"] for r in T.diverse_top(scored.withColumn("t", F.lit("x")), "t", [F.desc("score")], 2, 5).collect()] == [3, 1]
    text = "# One\nbody\n```py\nx = 1\n```\n## Two\n"
    row = spark.createDataFrame([(text,)], "t string").select(T.code_blocks(F.col("t")).alias("code"), T.sections(F.col("t")).alias("heads")).first()
    assert row["code"] == ["x = 1\n"] and row["heads"] == ["One", "Two"]


def test_scalars(spark):
    one = spark.range(1)

    def of(column):
        return one.select(column.alias("x")).first()["x"]

    assert of(S.hex_address(F.lit(-1).cast("long"))) == "0xffffffffffffffff"
    assert str(of(S.unsigned(F.lit(-1).cast("long")))) == "18446744073709551615"
    assert [of(S.parse_address(F.lit(t))) for t in ("0x10", "010", "ff", "zz")] == ["16", "10", "255", None]
    assert [of(S.column_label(F.lit(n))) for n in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]
    assert of(S.size_text(F.lit(1536))) == "1.50 KB" and of(S.growth_text(F.lit(4), F.lit(5))) == "+25.0%"
    assert of(S.process_short_name(F.lit("com.example.application"))) == "ple.application"
    assert str(of(S.parse_time(F.lit("2024/01/02-03:04:05")))) == "2024-01-02 03:04:05" and of(S.parse_time(F.lit("soon"))) is None
    assert of(S.registers(F.lit("x0:0000000000000001 x1:00000000000000ff x0:0000000000000002"))) == {"x1": "00000000000000ff", "x0": "0000000000000002"}
    assert of(S.address_is_text(F.lit("0x6162636465666768"))) and not of(S.address_is_text(F.lit("0x1")))
    assert of(S.media_format(F.lit(bytearray(b"\x00\x00\x00\x18ftypmp42")))) == "mp4" and of(S.media_format(F.lit(bytearray(b"none")))) == "unknown"
    assert of(S.mixed_tokens(F.lit("The List 列表组件 list"))) == ["list", "列表组件"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, t int, v int")
    assert R.latest_by(none, ["k"], ["t"], ["v"]).count() == 0
    assert R.top_shares(none, ["k"], F.col("v"), 1, 5, ["k"]).count() == 0
    assert R.compare_versions(none.select("k", "v"), none.select("k", "v"), "k", "v").count() == 0
    assert G.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    assert M.similar_pairs(spark.createDataFrame([], "id long, root string, chain array<string>"), "id", ["root"], "chain").count() == 0
