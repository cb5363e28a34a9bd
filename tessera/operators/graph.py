"""Graph operators as iterated DataFrame joins."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import ordered_scan
from tessera.runtime import broadcast_up_to, discard, stored

#: Edges of a graph that is solved in one task, at most.
FOLD_EDGES = 1_000_000


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 200) -> DataFrame:
    """Return ``(node, component)``: each node named in an edge with the smallest node it can reach.

    Labels spread along edges and are then replaced by their own label's label, so the number of
    rounds follows the logarithm of the longest path in practice. Both steps are joins followed
    by a partial minimum: a hub's edges are summed before they meet, and the join itself can be
    split by adaptive execution. Each round is written to the shared folder, and the one before removed. Edges with a null end are
    ignored; an empty input gives an empty result; self loops give one-node components.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = last = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    for _ in range(max_rounds):
        offered = (
            both.join(labels, both["u"] == labels["node"])
            .groupBy("v")
            .agg(F.min("label").alias("offer"))
        )
        hooked = stored(
            labels.join(offered, labels["node"] == offered["v"], "left").select(
                "node", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label")
            ),
            "hooked",
        )
        hop = hooked.select(F.col("node").alias("at"), F.col("label").alias("next"))
        new = stored(
            hooked.join(hop, hooked["label"] == hop["at"], "left").select(
                "node", "old", F.least("label", F.coalesce("next", "label")).alias("label")
            ),
            "labels",
        )
        discard(hooked, last)
        labels, last = new.select("node", "label"), new
        if new.where("old <> label").isEmpty():
            discard(both)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def reachable(edges: DataFrame, src: str, dst: str, anchors: DataFrame, max_depth: int, both_ways: bool = False) -> DataFrame:
    """``(anchor, node, depth)``: nodes reached from ``anchors(anchor)`` in at most ``max_depth`` steps, at the least depth.

    One join a level; only nodes new to an anchor go on, so cycles end by themselves.
    """
    step = edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to"))
    if both_ways:
        step = step.unionByName(step.select(F.col("_to").alias("_from"), F.col("_from").alias("_to")))
    step = stored(step.where("_from IS NOT NULL AND _to IS NOT NULL").distinct(), "steps")
    seen = stored(anchors.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("depth")).distinct(), "seen")
    edge = seen
    for depth in range(1, max_depth + 1):
        ahead = edge.join(step, edge["node"] == step["_from"]).select("anchor", F.col("_to").alias("node")).distinct()
        edge = stored(ahead.join(seen.select("anchor", "node"), ["anchor", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def shortest_paths(edges: DataFrame, src: str, dst: str, sources: DataFrame, max_depth: int, allowed: Column | None = None) -> DataFrame:
    """``(node, distance, path)`` from the nearest of ``sources(node)`` over allowed edges, source first.

    Of equally short paths that through the smallest previous node is taken.
    """
    usable = edges.where(allowed) if allowed is not None else edges
    step = stored(usable.select(F.col(src).alias("_from"), F.col(dst).alias("_to")).distinct(), "steps")
    found = stored(sources.select("node", F.lit(0).alias("distance"), F.array("node").alias("path")).dropDuplicates(["node"]), "paths")
    edge = found
    for distance in range(1, max_depth + 1):
        ahead = edge.join(step, edge["node"] == step["_from"]).groupBy("_to").agg(F.min_by("path", "_from").alias("_path"))
        new = ahead.join(found.select(F.col("node").alias("_to")), "_to", "left_anti")
        edge = stored(new.select(F.col("_to").alias("node"), F.lit(distance).alias("distance"), F.concat("_path", F.array("_to")).alias("path")), "level")
        if edge.isEmpty():
            break
        found = found.unionByName(edge)
    return found


def strong_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 1000) -> DataFrame:
    """``(node, component)``: each node named in an edge with the smallest node that it reaches and that reaches it.

    In a pass nodes without an edge in or out among those left are components by themselves and go. Every node then takes the
    smallest label of all that reach it as its colour, and what reaches a colour's first node within the colour is a component. A
    pass settles one component of each colour. Edges with a null end are ignored. More than ``max_rounds`` rounds of any kind are an error.
    """
    left = stored(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct(), "edges")
    named = stored(left.select(F.col("u").alias("node")).unionByName(left.select(F.col("v").alias("node"))).distinct(), "named")
    left = stored(left.where("u <> v"), "edges")
    settled = []
    for _ in range(max_rounds):
        for _ in range(max_rounds):
            both = left.select(F.col("u").alias("node")).distinct().join(left.select(F.col("v").alias("node")).distinct(), "node", "left_semi")
            inner = stored(both, "inner")
            kept = stored(left.join(inner.withColumnRenamed("node", "u"), "u", "left_semi").join(inner.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v"), "edges")
            if kept.count() == left.count():
                break
            left = kept
        if kept.isEmpty():
            break
        colours = _least_before(kept, inner, max_rounds)
        # edges within a colour, backwards, from its first node
        tinted = kept.join(colours.select(F.col("node").alias("u"), F.col("label").alias("_u")), "u").join(colours.select(F.col("node").alias("v"), F.col("label").alias("_v")), "v")
        back = stored(tinted.where("_u = _v").select(F.col("v").alias("_from"), F.col("u").alias("_to")), "back")
        found = stored(colours.where("node = label").select("node", F.col("label").alias("component")), "found")
        edge = found
        for _ in range(max_rounds):
            ahead = edge.join(back, edge["node"] == back["_from"]).select(F.col("_to").alias("node"), "component").distinct()
            edge = stored(ahead.join(found, "node", "left_anti"), "level")
            if edge.isEmpty():
                break
            found = stored(found.unionByName(edge), "found")
        settled.append(found)
        gone = found.select("node")
        left = stored(kept.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"), "edges")
    else:
        raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")
    if not settled:
        return named.withColumn("component", F.col("node"))
    whole = reduce(DataFrame.unionByName, settled)
    return named.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _least_before(edges: DataFrame, nodes: DataFrame, max_rounds: int) -> DataFrame:
    """``(node, label)``: the smallest node that reaches each of ``nodes(node)``, itself included, over the stored ``edges(u, v)``."""
    labels = stored(nodes.withColumn("label", F.col("node")), "labels")
    for _ in range(max_rounds):
        offered = edges.join(labels, edges["u"] == labels["node"]).groupBy("v").agg(F.min("label").alias("_offer"))
        new = labels.join(offered, labels["node"] == offered["v"], "left")
        new = stored(new.select("node", F.least("label", "_offer").alias("label"), (F.col("_offer") < F.col("label")).alias("_moved")), "labels")
        discard(labels)
        if new.where("_moved").isEmpty():
            return new.select("node", "label")
        labels = new
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def cycles(edges: DataFrame, src: str, dst: str, max_length: int, strong: bool = False) -> DataFrame:
    """``(nodes)``: the node sets, as sorted arrays, of simple cycles of at most ``max_length`` edges.

    Paths start at their smallest node, so each cycle is walked from one place only. The length
    bound keeps the enumeration, exponential in general, finite and small. With ``strong`` only edges within a
    strong component are walked, as no other is in a cycle.
    """
    step = stored(edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to")).where("_from IS NOT NULL AND _to IS NOT NULL").distinct(), "steps")
    if strong:
        parts = stored(strong_components(step, "_from", "_to"), "components")
        ends = [parts.select(F.col("node").alias(c), F.col("component").alias(f"_c{c}")) for c in ("_from", "_to")]
        step = stored(step.join(ends[0], "_from").join(ends[1], "_to").where("_c_from = _c_to").select("_from", "_to"), "steps")
    paths = step.where("_to >= _from").select(F.array("_from").alias("path"), F.col("_to").alias("_next"))
    closed = None
    for _ in range(max_length):
        done = paths.where(F.col("_next") == F.get("path", 0)).select(F.array_sort("path").alias("nodes"))
        closed = done if closed is None else closed.unionByName(done)
        open_ = paths.where((F.col("_next") > F.get("path", 0)) & ~F.array_contains("path", F.col("_next")))
        open_ = stored(open_.select(F.concat("path", F.array("_next")).alias("path"), F.col("_next").alias("_at")), "walks")
        if open_.isEmpty():
            break
        paths = open_.join(step, open_["_at"] == step["_from"]).select("path", F.col("_to").alias("_next"))
    return closed.distinct()


def dominators(edges: DataFrame, graph: str, src: str, dst: str, root: Column, fold_edges: int = FOLD_EDGES, max_depth: int = 10_000) -> DataFrame:
    """``(graph, node, parent)``: immediate dominators of the nodes reachable from each graph's root.

    A graph of at most ``fold_edges`` edges, repeats included, is one group, solved in a task. Larger ones are solved by joins
    (``dominators_by_joins``), where dominators more than ``max_depth`` deep are an error. Edges with a null end or
    graph are ignored, repeated edges change nothing, an edge without a root, null, belongs to no graph.
    """
    ids = edges.select(F.col(graph).alias("graph"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), root.cast("long").alias("root"))
    ids = stored(ids.dropna(), "edges")
    sizes = stored(ids.groupBy("graph").agg((F.count("*") <= fold_edges).alias("small")), "sizes")
    kind = ids.schema["graph"].dataType.simpleString()
    small = ids.join(sizes.where("small"), "graph", "left_semi").distinct()
    folded = small.groupBy("graph").applyInPandas(_fold_dominators, f"graph {kind}, node long, parent long")
    large = sizes.where("NOT small")
    if large.isEmpty():
        return folded
    return folded.unionByName(dominators_by_joins(ids.join(large, "graph", "left_semi"), max_depth))


def _fold_dominators(frame: pd.DataFrame) -> pd.DataFrame:
    """One graph by the iterative algorithm of Cooper, Harvey and Kennedy over the nodes in reverse postorder."""
    following: dict[int, list[int]] = {}
    for a, b in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True):
        following.setdefault(a, []).append(b)
    start = int(frame["root"].iloc[0])
    order: list[int] = []
    seen, stack = {start}, [(start, iter(sorted(following.get(start, []))))]
    while stack:
        node, rest = stack[-1]
        for b in rest:
            if b not in seen:
                seen.add(b)
                stack.append((b, iter(sorted(following.get(b, [])))))
                break
        else:
            order.append(node)
            stack.pop()
    rank = {n: i for i, n in enumerate(order)}
    before: dict[int, list[int]] = {}
    for a in order:
        for b in following.get(a, []):
            before.setdefault(b, []).append(a)
    over = {start: start}
    changed = True
    while changed:
        changed = False
        for node in reversed(order[:-1]):
            known = [p for p in before[node] if p in over]
            best = known[0]
            for p in known[1:]:
                a, b = p, best
                while a != b:
                    while rank[a] < rank[b]:
                        a = over[a]
                    while rank[b] < rank[a]:
                        b = over[b]
                best = a
            if over.get(node) != best:
                over[node], changed = best, True
    nodes = [n for n in order if n != start]
    return pd.DataFrame({"graph": frame["graph"].iloc[0], "node": nodes, "parent": [over[n] for n in nodes]})


def nearest_common_ancestors(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """The stored ``pairs(..., a, b)`` of nodes of one tree with their nearest common ancestor as ``top`` and its ``depth``.

    ``tree(node, parent, depth)`` is stored, roots are their own parents. Ancestors 1, 2, 4, ... steps up are found by
    doubling, so a pair takes as many joins as the logarithm of the depth, however far its ancestor is.
    """
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    lifts = [tree.select("node", "parent")]
    while 1 << len(lifts) <= deepest:
        low = lifts[-1].select(F.col("parent").alias("_mid"), "node")
        high = lifts[-1].select(F.col("node").alias("_mid"), "parent")
        lifts.append(stored(low.join(high.hint("merge"), "_mid").select("node", "parent"), "lift"))
    depths = tree.select("node", "depth")

    def with_up(rows: DataFrame, name: str, lift: DataFrame) -> DataFrame:
        return rows.join(lift.select(F.col("node").alias(name), F.col("parent").alias(f"_up_{name}")).hint("merge"), name)

    rows = pairs
    for end in "ab":
        rows = rows.join(depths.select(F.col("node").alias(end), F.col("depth").alias(f"_{end}")).hint("merge"), end)
    # the deeper one is a; what it is deeper by is walked up bit by bit
    deeper = F.col("_a") >= F.col("_b")
    rows = rows.withColumns({"_x": F.when(deeper, F.col("a")).otherwise(F.col("b")), "_y": F.when(deeper, F.col("b")).otherwise(F.col("a")), "_gap": F.abs(F.col("_a") - F.col("_b"))})
    rows = rows.drop("a", "b", "_a", "_b").withColumnsRenamed({"_x": "a", "_y": "b"})
    for k, lift in reversed(list(enumerate(lifts))):
        far = F.col("_gap") >= 1 << k
        walked = with_up(rows.where(far), "a", lift).withColumn("a", F.col("_up_a")).drop("_up_a").withColumn("_gap", F.col("_gap") - (1 << k))
        rows = stored(rows.where(~far).unionByName(walked), "even")
    for lift in reversed(lifts):
        apart = with_up(with_up(rows.where("a <> b"), "a", lift), "b", lift)
        move = F.col("_up_a") != F.col("_up_b")
        apart = apart.withColumns({"a": F.when(move, F.col("_up_a")).otherwise(F.col("a")), "b": F.when(move, F.col("_up_b")).otherwise(F.col("b"))})
        rows = stored(rows.where("a = b").unionByName(apart.drop("_up_a", "_up_b")), "near")
    met = rows.where("a = b").withColumn("top", F.col("a")).unionByName(with_up(rows.where("a <> b"), "a", lifts[0]).withColumnRenamed("_up_a", "top"))
    return met.drop("a", "b", "_gap").join(depths.withColumnRenamed("node", "top").hint("merge"), "top")


def dominators_by_joins(edges: DataFrame, max_depth: int) -> DataFrame:
    """``(graph, node, parent)`` of the stored ``edges(graph, src, dst, root)`` without gathering a graph.

    It starts from a tree of edges (``spanning_tree``), in which every dominator of a node is above it. A node with one node before it
    hangs below that for good, and one that is reached from below two children of the root hangs on the root for good, so one join
    with the child of the root above each source settles these. For the others, in a round each is hung
    below the nearest common ancestor of all nodes with an edge to it, which takes it up at most to its
    dominator. In the order of a walk that is the ancestor of the first and the last of these, so edges send two
    numbers a node. The tree in which no node moves is that of the dominators.
    """
    plain = edges.where("src <> dst AND dst <> root")
    tree = spanning_tree(plain)
    # edges from a root need no join, which would send them all to one task
    above = tree.select("graph", F.col("node").alias("src"), "top").hint("merge")
    under = plain.where("src <> root").join(above, ["graph", "src"]).select("graph", "dst", "root", "src", "top")
    under = under.unionByName(plain.where("src = root").withColumn("top", F.col("root")))
    ends = [f(c).alias(f"_{n}_{c}") for c in ("src", "top") for n, f in (("min", F.min), ("max", F.max))]
    spans = under.groupBy("graph", F.col("dst").alias("node"), "root").agg(*ends)
    settled = F.when(F.expr("_min_src = _max_src"), F.col("_min_src")).when(F.expr("_min_top <> _max_top OR _min_top = root"), F.col("root"))
    over = stored(spans.select("graph", "node", "root", settled.alias("parent")), "over")
    open_ = stored(over.where("parent IS NULL").select("graph", "node"), "open")
    if not open_.isEmpty():
        old = tree.select("graph", "node", F.col("parent").alias("_old")).hint("merge")
        over = over.join(old, ["graph", "node"]).select("graph", "node", "root", F.coalesce("parent", "_old").alias("parent"))
        left = plain.join(broadcast_up_to(open_.withColumnRenamed("node", "dst"), FOLD_EDGES), ["graph", "dst"], "left_semi")
        over = _raised(stored(over, "over"), stored(left.select("graph", "src", "dst"), "left"))
    if _deepest(tree) > max_depth and _deepest(_under_root(stored(over, "over"))) > max_depth:
        raise RuntimeError(f"dominators are more than {max_depth} deep")
    return over.select("graph", "node", "parent")


def _deepest(tree: DataFrame) -> int:
    return tree.agg(F.max("depth")).first()[0] or 0


def spanning_tree(edges: DataFrame) -> DataFrame:
    """``(graph, node, parent, root, top, depth)``: the nodes that ``edges(graph, src, dst, root)`` lead to from their root, each below one with an edge to it; ``top`` is the child of the root that it stands under.

    Each node hangs on the root, or else on the least node with an edge to it. That may leave some in cycles or below what isn't
    reached; those of them with an edge from a reached node are hung there, with all that hangs on them, until there are none.
    """
    least = F.when(F.max(F.col("src") == F.col("root")), F.col("root")).otherwise(F.min("src"))
    up = stored(edges.groupBy("graph", F.col("dst").alias("node"), "root").agg(least.alias("parent")), "up")
    everything = up.count()
    while True:
        tree = _under_root(up)
        if tree.count() == everything:
            return tree
        known = tree.select("graph", F.col("node").alias("src")).unionByName(edges.select("graph", F.col("root").alias("src")).distinct())
        lost = stored(up.join(tree.select("graph", "node").hint("merge"), ["graph", "node"], "left_anti"), "lost")
        ahead = edges.join(broadcast_up_to(lost.select("graph", F.col("node").alias("dst")), FOLD_EDGES), ["graph", "dst"], "left_semi")
        ahead = ahead.join(known.hint("merge"), ["graph", "src"], "left_semi").groupBy("graph", F.col("dst").alias("node")).agg(F.min("src").alias("_new"))
        ahead = stored(ahead, "ahead")
        if ahead.isEmpty():
            return tree
        hung = lost.join(ahead.hint("merge"), ["graph", "node"], "left").withColumn("parent", F.coalesce("_new", "parent")).drop("_new")
        up = stored(tree.select(*up.columns).unionByName(hung.select(*up.columns)), "up")


def _under_root(up: DataFrame) -> DataFrame:
    """The rows of the stored ``up(graph, node, root, parent)`` whose parents lead to the root, with ``top`` and ``depth``, in as many rounds as the logarithm of the depth."""
    at, top = F.when(F.col("parent") != F.col("root"), F.col("parent")), F.when(F.col("parent") == F.col("root"), F.col("node"))
    walk = stored(up.withColumns({"_at": at, "top": top, "depth": F.lit(1).cast("long")}), "walk")
    done = walk.where("top IS NOT NULL").count()
    while not walk.where("top IS NULL").isEmpty():
        ahead = walk.select("graph", F.col("node").alias("_at"), F.col("_at").alias("_next"), F.col("top").alias("_top"), F.col("depth").alias("_more")).hint("merge")
        moved = walk.where("top IS NULL").join(ahead, ["graph", "_at"]).select(
            *up.columns, F.col("_next").alias("_at"), F.col("_top").alias("top"), (F.col("depth") + F.col("_more")).alias("depth")
        )
        new = stored(walk.where("top IS NOT NULL").unionByName(moved), "walk")
        discard(walk)
        walk, before = new, done
        done = walk.where("top IS NOT NULL").count()
        # nodes just beyond the distance of the last round would have come in this one
        if done == before:
            break
    return walk.where("top IS NOT NULL").drop("_at")


def _raised(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """The stored ``tree(graph, node, root, parent)`` with the ends of the stored ``edges(graph, src, dst)`` hung ever higher, until each is below the nearest common ancestor of all nodes with an edge to it."""
    while True:
        roots = tree.select("graph", F.col("root").alias("node")).distinct()
        placed, _ = walk_order(tree, tree.select("graph", "node").unionByName(roots))
        placed = stored(placed, "placed")
        named = lambda node, place: placed.select("graph", F.col("node").alias(node), F.col("place").alias(place)).hint("merge")
        steps = tree.join(named("parent", "_b"), ["graph", "parent"]).join(named("node", "_a"), ["graph", "node"]).select(F.col("_a").alias("node"), F.col("_b").alias("parent"))
        tops = roots.join(named("node", "_a"), ["graph", "node"]).select(F.col("_a").alias("node"), F.col("_a").alias("parent"))
        numbered = with_depths(steps.unionByName(tops))
        spans = edges.join(named("src", "_at"), ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(F.min("_at").alias("a"), F.max("_at").alias("b"))
        met = nearest_common_ancestors(stored(spans, "spans"), numbered).select("graph", "node", F.col("top").alias("_b"))
        new = stored(met.join(named("_new", "_b"), ["graph", "_b"]).select("graph", "node", "_new"), "over")
        both = stored(tree.join(new.hint("merge"), ["graph", "node"], "left"), "over")
        moved = both.where("_new <> parent")
        tree = both.withColumn("parent", F.coalesce("_new", "parent")).drop("_new")
        if moved.isEmpty():
            return tree


def with_depths(tree: DataFrame) -> DataFrame:
    """``(node, parent, depth)`` of ``tree(node, parent)``, whose roots are their own parents, in as many rounds as the logarithm of the depth."""
    base = stored(tree.select("node", "parent"), "tree")
    walk = stored(base.select("node", F.col("parent").alias("_at"), F.when(F.col("parent") == F.col("node"), 0).otherwise(1).alias("depth")), "walk")
    while True:
        ahead = walk.select(F.col("node").alias("_at"), F.col("_at").alias("_next"), F.col("depth").alias("_more"))
        new = stored(walk.join(ahead.hint("merge"), "_at").select("node", F.col("_next").alias("_at"), (F.col("depth") + F.col("_more")).alias("depth"), (F.col("_more") > 0).alias("_moved")), "walk")
        if new.where("_moved").isEmpty():
            return stored(base.join(new.select("node", "depth").hint("merge"), "node"), "tree")
        walk = new.drop("_moved")


def topmost_sums(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph, name, n, retained)``: all nodes of a name counted, but sizes summed only where no
    ancestor in the dominator tree has the same name.

    ``tree(graph, node, parent)``, ``nodes(graph, node, name, size)``, where size is the retained one. In the order of a walk
    from the root a node's descendants are those that follow within its subtree's length. So a node has an
    ancestor of its name exactly if one that stands before it under that name reaches as far. The walk's places come from sums up the
    tree by doubling, and the reach is a maximum over earlier rows of the name.
    """
    up = stored(tree.select("graph", "node", "parent"), "tree")
    named = stored(nodes.select("graph", "node", "name", F.col("size").cast("long").alias("size")), "nodes")
    ends = up.select("graph", "node").unionByName(up.select("graph", F.col("parent").alias("node"))).unionByName(named.select("graph", "node")).distinct()
    placed, lengths = walk_order(up, ends)
    known = named.join(placed, ["graph", "node"]).join(lengths, ["graph", "node"]).withColumn("_end", F.col("place") + F.col("length"))
    reach = ordered_scan(known, ["graph", "name"], ["place"], maxima={"_reach": "_end"})
    return reach.groupBy("graph", "name").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("_reach") > F.col("place"), 0).otherwise(F.col("size"))).alias("retained")
    )


def walk_order(up: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(graph, node, place)``, the places of the distinct ``ends(graph, node)`` in a walk from each root, one graph behind another, and ``(graph, node, length)``, how many of them a subtree has; ``up(graph, node, parent)`` is stored."""
    lengths = stored(subtree_sums(up, ends.withColumn("size", F.lit(1))).withColumnRenamed("retained", "length"), "lengths")
    # a child's place behind its parent: one, and all that stands below earlier children
    siblings = ordered_scan(up.select("graph", "node", "parent").join(lengths, ["graph", "node"]), ["graph", "parent"], ["node"], {"_before": "length"})
    steps = ends.join(siblings.select("graph", "node", "parent", (F.col("_before") + 1).alias("place")), ["graph", "node"], "left")
    # roots follow one another
    tops = ordered_scan(steps.where("parent IS NULL").select("graph", "node").join(lengths, ["graph", "node"]), [], ["graph", "node"], {"place": "length"})
    walk = steps.where("parent IS NOT NULL").select("graph", "node", "parent", "place").unionByName(
        tops.select("graph", "node", F.lit(None).cast(up.schema["parent"].dataType).alias("parent"), "place")
    )
    return sums_to_root(stored(walk, "walk")), lengths


def sums_to_root(walk: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(graph, node, place)``: the sum of ``place`` from each node of the stored ``walk(graph, node, parent, place)`` up to its root, by doubling."""
    for _ in range(max_rounds):
        above = walk.select("graph", F.col("node").alias("parent"), F.col("parent").alias("_next"), F.col("place").alias("_more"))
        new = walk.join(above.hint("merge"), ["graph", "parent"], "left")
        new = stored(new.select("graph", "node", F.col("_next").alias("parent"), (F.col("place") + F.coalesce("_more", F.lit(0))).alias("place")), "walk")
        discard(walk)
        walk = new
        if walk.where("parent IS NOT NULL").isEmpty():
            return walk.select("graph", "node", "place")
    raise RuntimeError("the tree has a cycle")


def subtree_sums(tree: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(graph, node, retained)``: the size of each node and all that it dominates.

    ``tree(graph, node, parent)``, ``nodes(graph, node, size)``. A round doubles the distance: what stands up to twice as far below a node is
    what it has, and what the nodes just that far below it have. So a chain of a million nodes takes twenty rounds.
    """
    up = stored(tree.select("graph", "node", "parent"), "tree")
    total = stored(nodes.groupBy("graph", "node").agg(F.sum("size").alias("size")), "sizes")
    for _ in range(max_rounds):
        below = total.join(up.hint("merge"), ["graph", "node"]).groupBy("graph", F.col("parent").alias("node")).agg(F.sum("size").alias("size"))
        new = stored(total.unionByName(below).groupBy("graph", "node").agg(F.sum("size").alias("size")), "sizes")
        above = up.select("graph", F.col("node").alias("parent"), F.col("parent").alias("_next"))
        ahead = stored(up.join(above.hint("merge"), ["graph", "parent"]).select("graph", "node", F.col("_next").alias("parent")), "tree")
        discard(total, up)
        total, up = new, ahead
        if up.isEmpty():
            return total.withColumnRenamed("size", "retained")
    raise RuntimeError("the tree has a cycle")


def signatures(edges: DataFrame, src: str, name: str, left_out: Column) -> DataFrame:
    """``(src, signature)``: the sorted distinct names of a node's edges, some kinds of edges left out."""
    return edges.where(~F.coalesce(left_out, F.lit(False))).groupBy(src).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("signature"))


def best_two_hops(first: DataFrame, second: DataFrame, score: Column) -> DataFrame:
    """``(src, via, dst, score)``: for each start the two-step path of most score, ties to the smallest via and dst.

    ``first(src, via, ...)`` and ``second(via, dst, ...)``; ``score`` may use the columns of both. The
    join is followed by a partial aggregate, so a start with many paths sends one row a task.
    """
    paths = first.join(second, "via").withColumn("_score", score)
    best = F.max_by(F.struct("via", "dst", F.col("_score").alias("score")), F.struct(F.col("_score"), -F.col("via"), -F.col("dst")))
    return paths.groupBy("src").agg(best.alias("_best")).select("src", "_best.*")
