"""Dominators found by joins against removing each node in turn."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G


def brute(edges):
    """``(graph, node, parent)``: the dominator of most dominators."""
    out = set()
    for graph in {g for g, *_ in edges if g is not None}:
        mine = [(a, b) for g, a, b in edges if g == graph and a is not None and b is not None]

        def reached(without=None):
            seen, todo = {0}, [0]
            while todo:
                at = todo.pop()
                for a, b in mine:
                    if a == at and b not in seen and b != without:
                        seen.add(b)
                        todo.append(b)
            return seen

        whole = reached()
        over = {n: {d for d in whole if d != n and (d == 0 or n not in reached(d))} for n in whole if n}
        out |= {(graph, n, max(ds, key=lambda d: len(over.get(d, ())))) for n, ds in over.items()}
    return out


def random_edges(seed, graphs=("p", "q"), nodes=14, each=26):
    pick = random.Random(seed)
    made = [(g, pick.randrange(nodes), pick.randrange(nodes)) for g in graphs for _ in range(each)]
    return made + made[:3] + [(g, 0, 1) for g in graphs] + [(None, 0, 3), ("p", None, 2), ("q", 4, None), ("p", 77, 78)]


@pytest.mark.parametrize(("seed", "fold"), [(1, 0), (2, 0), (3, 0), (1, 1_000), (4, 30)])
def test_dominators_of_random_graphs(spark, seed, fold):
    edges = random_edges(seed) + ([("r", 0, 5), ("r", 5, 6), ("r", 0, 6)] if fold == 30 else [])
    found = G.dominators(spark.createDataFrame(edges, "g string, a long, b long"), "g", "a", "b", F.lit(0), fold_edges=fold)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(edges)


def test_ladder_and_no_edges(spark):
    """Two sides joined at every tenth step: only the joints dominate."""
    edges = [(1, 0, 1)]
    for k in range(1, 40):
        edges += [(1, k, k + 1)] if k % 10 else [(1, k, k + 1), (1, k, 1000 + k), (1, 1000 + k, k + 5)]
    frame = spark.createDataFrame(edges, "g int, a long, b long")
    assert {tuple(r) for r in G.dominators(frame, "g", "a", "b", F.lit(0), fold_edges=0).collect()} == brute(edges)
    assert G.dominators(frame.limit(0), "g", "a", "b", F.lit(0), fold_edges=0).count() == 0
    with pytest.raises(RuntimeError):
        G.dominators(frame, "g", "a", "b", F.lit(0), fold_edges=0, max_depth=3)


def test_nearest_common_ancestors(spark):
    parent = {0: 0, **{k: (k - 1) // 2 for k in range(1, 200)}, **{k: k - 1 for k in range(200, 260)}}
    tree = G.with_depths(spark.createDataFrame(list(parent.items()), "node long, parent long"))
    pick = random.Random(5)
    pairs = [(k, pick.randrange(260), pick.randrange(260)) for k in range(150)] + [(150, 7, 7), (151, 0, 259), (152, 258, 200)]

    def up(n):
        return [n, *(up(parent[n]) if parent[n] != n else [])]

    found = G.nearest_common_ancestors(spark.createDataFrame(pairs, "k long, a long, b long"), tree).collect()
    assert {(r["k"], r["top"], r["depth"]) for r in found} == {
        (k, top := next(x for x in up(a) if x in set(up(b))), len(up(top)) - 1) for k, a, b in pairs
    }


def test_tree_starts_anywhere(spark):
    """Least nodes before in a cycle, below what isn't reached, or deeper than need be."""
    edges = [(1, 0, 9), (1, 9, 5), (1, 5, 3), (1, 3, 4), (1, 4, 5), (1, 5, 4), (1, 2, 8), (1, 9, 8), (1, 8, 7), (1, 1, 7), (1, 1, 2), (1, 6, 0), (1, 7, 0)]
    frame = spark.createDataFrame(edges, "g int, a long, b long")
    assert {tuple(r) for r in G.dominators(frame, "g", "a", "b", F.lit(0), fold_edges=0).collect()} == brute(edges)


def test_layers_are_solved_in_few_passes(spark, monkeypatch):
    """Nodes reached from below several children of the root need no common ancestors, and few tables of edges are written."""
    written = []
    monkeypatch.setattr(G, "stored", lambda df, label, keep=G.stored: (written.append(label), keep(df, label))[1])
    edges = [(1, 0, k) for k in range(1, 9)] + [(1, 1 + k % 8, 10 + k) for k in range(40)] + [(1, 10 + k % 40, 60 + k % 7) for k in range(90)]
    frame = spark.createDataFrame(edges, "g int, a long, b long")
    assert {tuple(r) for r in G.dominators(frame, "g", "a", "b", F.lit(0), fold_edges=0).collect()} == brute(edges)
    assert len(written) <= 12 and "pairs" not in written
