"""SimHash near-duplicates found with vantage-point trees.

A fingerprint's near ones differ in at most ``RADIUS`` bits. Distinct fingerprints are dealt to
the leaves of a vantage-point tree: a node holds a vantage fingerprint and a distance, nearer
ones go inside and farther ones outside, and by the triangle inequality only inside fingerprints
within ``RADIUS`` of the border can have a near one outside, so those go to both sides. Any two
near fingerprints then share a leaf. Leaves are groups of a shuffle; each is searched exactly by
splitting it further with the same rule. A leaf reports a spanning set of its links, and
components of these are the answer.

The tree is fitted on about ``SAMPLE`` fingerprints at most (those with the least hash); every
fingerprint is indexed by it and the result is exact whatever the sample. Leaves number one for
``LEAF_ROWS`` distinct fingerprints, so they grow in number, not in size.

Cases: null, empty and blank texts have fingerprint zero and link like any other. Fewer than
three words make one shingle. Repeated rows are kept. Null ids take part but never name a
component unless it has no other. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.operators.prefix import POSITION_BITS, hash_position
from tessera.runtime import broadcast_up_to, discard, small_batches, spread, stored

WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints that shape the tree (16 a leaf, within these bounds), rows wanted in a leaf, and the
#: most leaves. The tree, sent to every task, thus stays below 3 MB. With more than 268 million distinct
#: fingerprints leaves grow, at 8 bytes a row; each is split further where it is searched.
LEAST_SAMPLE, SAMPLE, LEAF_ROWS, MOST_LEAVES = 65_536, 1_048_576, 4_096, 65_536

#: Words of a shingle and the least Jaccard similarity, as a fraction, of similar texts.
SIMILAR_WORDS, LEAST = 5, (4, 5)
#: Row numbers, of eight bytes, that are broadcast at most; more are met in a shuffled join.
BROADCAST_ROWS = 2_000_000
#: How many frequent shingles every task knows, and orders by their counts; all others come before them and are met in a
#: shuffled join, so pairs don't depend on it.
COMMON = 1_048_576
#: Sets of the last texts that a task keeps while it compares pairs, and the longest text whose set is kept.
KEPT_SETS, KEPT_BYTES = 256, 65_536

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Majority bits of the hashes of all word shingles, repeats included, as an unsigned integer."""
    parts = (text or b"").lower().split()  # bytes: A-Z only, and cut at the six ASCII blanks
    if not parts:
        return 0
    shingles = zip(*[parts[k:] for k in range(words)], strict=False) if len(parts) >= words else [parts]
    hashes = np.fromiter(map(_hash, map(b" ".join, shingles)), dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = WORDS, carry: str | None = None) -> DataFrame:
    """``(doc_id, fp)`` of ``documents(doc_id, text)``; fp holds the 64 bits as a signed long.

    ``carry`` names a column to keep.
    """
    small_batches(documents.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *batch.schema.names[2:]])

    carried = [carry] if carry else []
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"), *carried)
    kinds = "".join(f", {c} {documents.schema[c].dataType.simpleString()}" for c in carried)
    return spread(rows).mapInArrow(prints, f"doc_id long, fp long{kinds}")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int64)


def choose_split(points: np.ndarray, radius: int, tries: int = 8) -> tuple[np.uint64, int, int] | None:
    """The vantage point and border among a few candidates that leave the larger side smallest.

    Returns (vantage, border, rows of the larger side), or None if no split makes both sides smaller.
    """
    best = None
    for at in np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int):
        away = distance(points, points[at])
        counts = np.bincount(away, minlength=66)
        inside = np.cumsum(counts)
        for border in {int(np.median(away)), int(np.median(away)) - 1, int(np.quantile(away, 0.35))}:
            if border < 0:
                continue
            near = int(inside[border])
            both = near - (int(inside[border - radius]) if border >= radius else 0)
            larger = max(near, len(points) - near + both)
            if larger < len(points) and (best is None or larger < best[2]):
                best = (points[at], border, larger)
    return best


def build_tree(points: np.ndarray, leaves: int, radius: int = RADIUS) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, border, inside, outside); a child below zero is the leaf ``-1 - child``."""
    nodes: list[list[int]] = []
    open_: list[tuple[int, int, int, int, np.ndarray]] = [(-len(points), 0, -1, 0, points)]  # largest first: ..., parent, side, rows
    made = done = 0
    while open_ and done + len(open_) < leaves:
        *_, parent, side, rows = heapq.heappop(open_)
        split = choose_split(rows, radius) if len(rows) >= 16 else None
        if split is None:
            if parent >= 0:
                nodes[parent][2 + side] = -1 - done
            done += 1
            continue
        vantage, border, _ = split
        away = distance(rows, vantage)
        me = len(nodes)
        nodes.append([int(vantage), border, 0, 0])
        if parent >= 0:
            nodes[parent][2 + side] = me
        for k, part in enumerate((rows[away <= border], rows[away > border - radius])):
            made += 1  # tells ties apart
            heapq.heappush(open_, (-len(part), made, me, k, part))
    for *_, parent, side, _ in sorted(open_, key=lambda o: o[1]):
        if parent >= 0:
            nodes[parent][2 + side] = -1 - done
        done += 1
    return [tuple(n) for n in nodes]


def leaves_of(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for each leaf that a fingerprint belongs to."""
    rows, leaves = [], []
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        at, mine = todo.pop()
        if not len(mine):
            continue
        if at < 0:
            rows.append(mine)
            leaves.append(np.full(len(mine), -1 - at, dtype=np.int64))
            continue
        vantage, border, inside, outside = nodes[at]
        away = distance(points[mine], np.uint64(vantage))
        todo += [(inside, mine[away <= border]), (outside, mine[away > border - radius])]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def spanning_links(points: np.ndarray, radius: int = RADIUS, dense: int = 256) -> np.ndarray:
    """For each fingerprint the position of its component's first one, by exact search."""
    return spanning_forest(points, radius, dense)[0]


def spanning_forest(points: np.ndarray, radius: int = RADIUS, dense: int = 256) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The same, and the pairs of near fingerprints that hold the components together."""
    parent, held = np.arange(len(points)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    todo = [np.arange(len(points))]
    while todo:
        mine = todo.pop()
        if len(mine) < 2:
            continue
        split = choose_split(points[mine], radius) if len(mine) > dense else None
        # a split that hardly shrinks anything would copy rows for nothing
        if split is not None and split[2] < 0.9 * len(mine):
            away = distance(points[mine], split[0])
            todo += [mine[away <= split[1]], mine[away > split[1] - radius]]
            continue
        for at in range(0, len(mine), dense):
            block = mine[at : at + dense]
            for other in range(at, len(mine), 4096):
                against = mine[other : other + 4096]
                i, j = np.nonzero(distance(points[block][:, None], points[against][None, :]) <= radius)
                a, b = block[i], against[j]
                new = parent[a] != parent[b]
                for pair in zip(a[new].tolist(), b[new].tolist(), strict=True):
                    x, y = map(root, pair)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        held.append(pair)
    return np.array([root(x) for x in range(len(points))], dtype=np.int64), held


def near_links(distinct: DataFrame, radius: int = RADIUS, direct: bool = False) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of ``distinct(fp)`` within ``radius`` bits.

    With ``direct`` every link is such a pair itself; without, it may be the ends of a chain, which components settle faster.
    """
    size = distinct.count()
    leaves = max(1, min(MOST_LEAVES, size // LEAF_ROWS))
    tree = []
    if leaves > 1:
        # a hash below a cutoff picks about as many as wanted, from each task its share
        share = min(1.0, min(SAMPLE, max(LEAST_SAMPLE, 16 * leaves)) / size)
        picked = distinct.where(hash_position(F.col("fp")) < int(share * (1 << POSITION_BITS))).select("fp").toArrow()
        tree = build_tree(np.sort(picked.column("fp").to_numpy()).view(np.uint64), leaves, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            rows, where = leaves_of(signed.view(np.uint64), tree, radius)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(signed[rows])], names=["leaf", "fp"])

    def search(rows: pa.Table) -> pa.Table:
        signed = np.unique(rows.column("fp").to_numpy())
        firsts, held = spanning_forest(signed.view(np.uint64), radius)
        if direct:
            ends = np.array(held, dtype=np.int64).reshape(-1, 2)
            return pa.table({"a": pa.array(signed[ends[:, 0]]), "b": pa.array(signed[ends[:, 1]])})
        linked = firsts != np.arange(len(signed))
        return pa.table({"a": pa.array(signed[linked]), "b": pa.array(signed[firsts[linked]])})

    dealt = distinct.select("fp").mapInArrow(deal, "leaf long, fp long")
    return dealt.groupBy("leaf").applyInArrow(search, "a long, b long")


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, part)``: each fingerprint of ``prints(fp)`` with the least fingerprint of its component."""
    distinct = stored(prints.groupBy("fp").agg(F.count("*").alias("rows")), "distinct")
    parts = connected_components(near_links(distinct, radius), "a", "b")
    return distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("part"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id reachable over links of near fingerprints."""
    prints = stored(fingerprints(documents, words), "fingerprints")
    classes = stored(near_classes(prints, radius), "classes")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(classes, "fp")
    least = firsts.groupBy("part").agg(F.min("first").alias("component_id"))
    by_print = classes.join(least, "part").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(documents: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest doc_id, null ids last."""
    whole = documents.select("doc_id", "text", F.struct(*documents.columns).alias("document"))
    rows = stored(fingerprints(whole, words, carry="document").withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    classes = near_classes(rows.select("fp"), radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = rows.select("doc_id", "fp", "row").join(classes, "fp").groupBy("part").agg(first).select(F.col("first.row").alias("row"))
    return rows.select("row", "document").join(kept, "row", "left_semi").select("document.*")


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles in order; a text of fewer words is one shingle, a blank one has none."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    shingles = zip(*[parts[k:] for k in range(words)], strict=False) if len(parts) >= words else [parts]
    return np.unique(np.fromiter(map(_hash, map(b" ".join, shingles)), dtype=np.uint64))


def similar(x: np.ndarray, y: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sets without repeats have a Jaccard similarity of ``least`` at least."""
    met = len(np.intersect1d(x, y, assume_unique=True))
    return met * least[1] >= least[0] * (len(x) + len(y) - met)


def rarest(own: np.ndarray, common: np.ndarray, counts: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """So many of a set's rarest shingles that any set as similar as ``least`` has one of them among its own rarest.

    They come in two parts: those not known as common, and those that are.
    """
    weight = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, counts[at], 0)
    first = np.lexsort((own, weight))[: prefix_length(len(own), least)]
    known = weight[first] > 0
    return own[first[~known]], own[first[known]]


def prefix_length(n: int, least: tuple[int, int]) -> int:
    return n + least[0] * -n // least[1] + 1 if n else 0


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles of all ``texts(text)``, ``COMMON`` at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(text.as_py(), words) for text in batch.column(0)]
            keys, n = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    # most shingles stand in one text, so a task that reads texts would only hold its keys to no end
    dealt = texts.mapInArrow(cut, "key long, n long").repartition("key")
    counted = dealt.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    kept = stored(counted.orderBy(F.desc("n"), "key").limit(COMMON), "common")
    top = kept.toArrow()
    discard(kept)
    keys, counts = (top.column(c).to_numpy() for c in ("key", "n"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def near_pairs(prints: DataFrame) -> DataFrame:
    """Stored pairs ``(a, b)`` of ids of the stored ``prints(id, fp)`` that the vantage-point tree finds near: the first of each fingerprint
    with those of its near ones, and with the others of the same fingerprint."""
    firsts = stored(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "firsts")
    # one fingerprint may have a large share of the ids, or be near that many others, so the smaller sides are broadcast
    found = stored(near_links(firsts, direct=True), "near")
    half = stored(firsts.select(F.col("fp").alias("a"), F.col("first").alias("_a")).join(broadcast_up_to(found, BROADCAST_ROWS), "a"), "near")
    across = firsts.select(F.col("fp").alias("b"), F.col("first").alias("_b")).join(broadcast_up_to(half, BROADCAST_ROWS), "b")
    shared = stored(firsts.where("n > 1").select("fp", "first"), "shared")
    same = prints.join(broadcast_up_to(shared, BROADCAST_ROWS), "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return stored(across.select(F.col("_a").alias("a"), F.col("_b").alias("b")).unionByName(same), "candidates")


def similar_links(rows: DataFrame, distinct: DataFrame, near: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of sets in ``distinct(id, n, prefix, known)`` with a Jaccard
    similarity of ``least`` at least; ``rows(row, text)`` has the text of each id.

    The stored pairs ``near(a, b)`` are compared first, and removed. What they miss is found exactly: every set meets only one set that shares a rare shingle, that with the fewest rarer ones, which is the most
    like the others. Pairs that this leaves in different components are then all compared, so a large group of near
    copies is not paired with itself wholesale. Where a shingle stands in a set's order of rarity
    bounds what two sets can have in common from there on, and pairs that fall short are not made.
    No group is gathered: shingles known as common, ``COMMON`` at most, are aggregated before the shuffle and their
    firsts broadcast; the others meet theirs in a join that reads the same shuffle twice.
    """
    up, down = least

    def entries(name: str, before: Column) -> DataFrame:
        return distinct.select("id", "n", before.alias("_before"), F.posexplode(name).alias("at", "key")).select(
            "id", "n", (F.col("at") + F.col("_before")).alias("at"), "key"
        )

    def with_first(found: DataFrame, small: bool) -> DataFrame:
        firsts = found.groupBy("key").agg(F.min(F.struct("at", "id", "n")).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        return found.join(F.broadcast(firsts) if small else firsts.hint("merge"), "key").select("key", "first", "id", "n", "at")

    hot, others = entries("known", F.size("prefix")), entries("prefix", F.lit(0)).repartition("key")
    shared = stored(with_first(hot, True).unionByName(with_first(others, False)), "shared")

    def can_be(an: Column, a_at: Column, bn: Column, b_at: Column) -> Column:
        """Whether sets of these sizes can be similar whose first common shingle stands at these places."""
        return (up + down) * F.least(an - a_at, bn - b_at) >= up * (an + bn)

    def enough(met: Column, an: Column, bn: Column) -> Column:
        """Whether sets of these sizes with so many rare shingles in common can be similar: the rest of each is one less than ``least`` of it."""
        rest = [F.expr(f"({up} * {n} + {down - 1}) div {down} - 1") for n in ("an", "bn")]
        return (up + down) * (met + F.greatest(*rest)) >= up * (an + bn)

    def ends(pairs: DataFrame) -> DataFrame:
        """The ids of the stored ``pairs(a, b)``."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        return broadcast_up_to(stored(ids, "ids"), BROADCAST_ROWS)

    def verified(asked: DataFrame) -> DataFrame:
        """Those of the stored pairs ``(a, b)`` that are similar; the pairs are removed.

        Texts travel, not their sets, which are longer and do not compress.
        """
        texts = rows.select(F.col("row").alias("id"), F.col("text").cast("string").cast("binary")).join(ends(asked), "id", "left_semi")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = lru_cache(KEPT_SETS)(partial(shingle_set, words=words))
            for batch in batches:
                pairs = zip(*[[t.as_py() for t in batch.column(c)] for c in (2, 3)], strict=True)
                near = [similar(*[(kept if len(t) <= KEPT_BYTES else kept.__wrapped__)(t) for t in pair], least) for pair in pairs]
                yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

        met = asked
        for end, name in (("a", "x"), ("b", "y")):
            met = met.join(texts.select(F.col("id").alias(end), F.col("text").alias(name)), end)
        met = met.select("a", "b", *[F.coalesce(c, F.lit(b"")).alias(c) for c in "xy"])
        links = stored(met.mapInArrow(compare, "a long, b long"), "links")
        discard(asked)
        return links

    rare = distinct.select("id", F.concat("prefix", "known").alias("rare"))

    def likely(pairs: DataFrame) -> DataFrame:
        """The distinct ones of the pairs ``(a, an, b, bn)`` that share enough rare shingles, written."""
        found = pairs = stored(pairs.distinct(), "pairs")
        some = rare.join(ends(pairs), "id", "left_semi")
        for end in "ab":
            pairs = pairs.join(some.select(F.col("id").alias(end), F.col("rare").alias(f"{end}rare")), end)
        met = F.size(F.array_intersect("arare", "brare"))
        asked = stored(pairs.where(enough(met, F.col("an"), F.col("bn"))).select("a", "b"), "candidates")
        discard(found)
        return asked

    possible = can_be(F.col("first.n"), F.col("first.at"), F.col("n"), F.col("at"))
    stars = shared.where(possible & (F.col("id") != F.col("first.id")))
    links = verified(near).unionByName(verified(likely(stars.select(F.col("first.id").alias("a"), F.col("first.n").alias("an"), F.col("id").alias("b"), F.col("n").alias("bn")))))
    parts = connected_components(links, "a", "b")
    placed = shared.join(parts, shared["id"] == parts["node"], "left").select("key", "id", "n", "at", F.coalesce("component", "id").alias("part"))
    split = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    placed = stored(placed.join(split, "key", "left_semi"), "placed")
    discard(shared)
    left, right = (placed.select("key", *[F.col(c).alias(s + c) for c in ("id", "n", "at", "part")]) for s in "ab")
    across = left.join(right, "key").where("apart <> bpart AND aid < bid")
    pairs = across.where(can_be(F.col("an"), F.col("aat"), F.col("bn"), F.col("bat")))
    more = verified(likely(pairs.select(F.col("aid").alias("a"), "an", F.col("bid").alias("b"), "bn")))
    discard(placed)
    return links.unionByName(more)


def drop_similar(documents: DataFrame, words: int = SIMILAR_WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """``documents`` with one row, that of the smallest doc_id, null ids last, of each group of similar texts.

    Groups are the components of all pairs whose sets of word shingles have a Jaccard similarity of
    ``least`` (a fraction) at least. The vantage-point tree over the texts' fingerprints gives the first pairs, which are then
    compared exactly. Fingerprints of similar texts may lie farther apart, so an exact search adds what the tree misses: sets this similar share one of their rarest
    shingles in any common order of all shingles, so sets that share none need no comparing. The
    order, by the counts of the most frequent ones in all texts, is a matter of speed only.
    """
    small_batches(documents.sparkSession)
    common, counts = common_shingles(documents.select(F.col("text").cast("string").cast("binary").alias("text")), words)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            parts = list(zip(*[rarest(s, common, counts, least) for s in own], strict=True)) or [(), ()]
            prefix, known = (pa.array([x.view(np.int64) for x in part], pa.list_(pa.int64())) for part in parts)
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), same, pa.array(prints.view(np.int64)), pa.array([len(s) for s in own], pa.int64()), prefix, known, batch.column(2)],
                names=["doc_id", "same", "fp", "n", "prefix", "known", "document"],
            )

    whole = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"), F.struct(*documents.columns).alias("document"))
    kind = whole.schema["document"].dataType.simpleString()
    made = spread(whole).mapInArrow(sets, f"doc_id long, same binary, fp long, n long, prefix array<long>, known array<long>, document {kind}")
    rows = stored(made.withColumn("row", F.monotonically_increasing_id()), "sets")
    # of equal sets the first stands for all; the others' row numbers are left out, so no set is shuffled or written again
    heads = stored(rows.groupBy("same").agg(F.min("row").alias("id")), "heads")
    copies = stored(rows.select("same", "row").join(heads, "same").where("row <> id").select("row"), "copies")
    distinct = rows.select("row", "fp", "n", "prefix", "known").join(broadcast_up_to(copies, BROADCAST_ROWS), "row", "left_anti").withColumnRenamed("row", "id")
    near = near_pairs(stored(distinct.select("id", "fp"), "prints"))
    links = similar_links(rows.select("row", F.col("document.text").alias("text")), distinct, near, words, least)
    parts = connected_components(links, "a", "b")
    classes = heads.join(parts, F.col("id") == parts["node"], "left").select("same", F.coalesce("component", "id").alias("part"))
    placed = rows.select("doc_id", "same", "row").join(classes, "same").select("part", F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = placed.groupBy("part").agg(F.min(F.struct("none", "doc_id", "row"))["row"].alias("first"))
    dropped = stored(placed.join(firsts, "part").where("row <> first").select("row"), "dropped")
    return rows.select("row", "document").join(broadcast_up_to(dropped, BROADCAST_ROWS), "row", "left_anti").select("document.*")
