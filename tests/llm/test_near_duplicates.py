import re

import numpy as np
import pytest
import xxhash

from tessera.llm.near_duplicates import as_hex, build_tree, drop_near_duplicates, drop_similar, leaves_of, near_duplicates, spanning_links


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(points):
    parent = list(range(len(points)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for j in range(i):
            if bin(int(a) ^ int(points[j])).count("1") <= 2 and root(i) != root(j):
                a_, b_ = sorted((root(i), root(j)))
                parent[b_] = a_
    return [root(k) for k in range(len(points))]


def clustered(seed, n, spread):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)
    points = base[rng.integers(0, len(base), n)]
    for _ in range(spread):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(points)


@pytest.mark.parametrize("seed,n,spread", [(0, 300, 1), (1, 300, 2), (2, 400, 3), (3, 1, 1), (4, 200, 0)])
def test_exact_search_against_all_pairs(seed, n, spread):
    points = clustered(seed, n, spread)
    assert spanning_links(points, dense=32).tolist() == slow_classes(points)


@pytest.mark.parametrize("seed", range(4))
def test_near_fingerprints_share_a_leaf(seed):
    points = clustered(seed, 500, 2)
    tree = build_tree(np.random.default_rng(seed).permutation(points)[:200], 10)
    rows, leaves = leaves_of(points, tree)
    of = {}
    for r, leaf in zip(rows.tolist(), leaves.tolist(), strict=True):
        of.setdefault(r, set()).add(leaf)
    assert set(of) == set(range(len(points))) and len(set(leaves.tolist())) > 1
    for i in range(len(points)):
        for j in range(i):
            if bin(int(points[i]) ^ int(points[j])).count("1") <= 2:
                assert of[i] & of[j]


def test_documents(documents):
    got = near_duplicates(documents).select("doc_id", as_hex("fp").alias("hex"), "component_id").collect()
    expected = [(r["doc_id"], slow_fingerprint(r["text"])) for r in documents.select("doc_id", "text").collect()]
    assert sorted((r["doc_id"] or -1, r["hex"]) for r in got) == sorted((d or -1, f"{f:016x}") for d, f in expected)
    prints = [f for _, f in expected]
    classes = slow_classes(np.array(prints, dtype=np.uint64))
    least = {}
    for (d, _), c in zip(expected, classes, strict=True):
        least[c] = min(x for x in (least.get(c), d) if x is not None) if (least.get(c), d) != (None, None) else None
    want = sorted((d or -1, least[c] or -1) for (d, _), c in zip(expected, classes, strict=True))
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == want


def test_one_document_of_each_group_stays(documents):
    kept = drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, 1, 3, 4, 6, 7, 8, 10]


def test_empty_table(empty):
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_many_fingerprints_over_leaves(spark, monkeypatch):
    import tessera.llm.near_duplicates as near

    monkeypatch.setattr(near, "LEAF_ROWS", 64)
    monkeypatch.setattr(near, "LEAST_SAMPLE", 200)
    points = clustered(9, 900, 2)
    rows = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = {r["fp"]: r["part"] for r in near.near_classes(rows).collect()}
    classes = {}
    for p, c in zip(points.view(np.int64).tolist(), slow_classes(points), strict=True):
        classes.setdefault(c, set()).add(p)
    parts = {}
    for p, c in got.items():
        parts.setdefault(c, set()).add(p)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, classes.values()))


def slow_similar(texts, words=5):
    """Ids of the first document of each component of pairs with a Jaccard similarity of 0.8, by all pairs."""
    sets = []
    for _, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(texts):
        least[root(k)] = min(d, least.get(root(k), d))
    return sorted(least.values())


def edited(seed, n):
    """Texts of 60 to 90 words, most of them with a few words of an earlier one changed, cut or put between, and a common passage."""
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(30)]
    made = []
    for k in range(n):
        if k < n // 4:
            words = [f"w{rng.integers(0, 4000)}" for _ in range(int(rng.integers(60, 90)))] + passage * (k % 2)
        else:
            words = list(made[int(rng.integers(0, len(made)))])
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(words)))
                words[at : at + int(rng.integers(0, 2))] = [f"x{rng.integers(0, 4000)}"] * int(rng.integers(0, 2))
        made.append(words)
    return [(int(d), " ".join(w)) for d, w in zip(rng.permutation(n), made, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_similar_texts_against_all_pairs(spark, seed):
    texts = edited(seed, 160)
    got = sorted(r["doc_id"] for r in drop_similar(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == slow_similar(texts)


def test_near_copies_leave_the_corpus(spark):
    """Two words of a hundred changed: ten of 96 shingles differ, and far more than two bits."""
    import corpus_pipeline

    words = [f"w{k * 7919 % 4001}" for k in range(100)]
    changed = [f"y{k}" if k in (30, 70) else w for k, w in enumerate(words)]
    other = [f"y{k}" if k % 12 == 5 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((words, changed, other))], "doc_id long, text string")
    assert drop_near_duplicates(docs).count() == 3
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]
    assert slow_similar([tuple(r) for r in docs.collect()]) == [0, 2]


def test_similar_texts_go_through_the_tree(spark, monkeypatch):
    """The tree's pairs are near ones themselves, and reach the exact check before the search for the rest."""
    import tessera.llm.near_duplicates as near

    seen = {}

    def watched(rows, distinct, pairs, *rest):
        seen["pairs"], seen["prints"] = pairs.collect(), {r["id"]: r["fp"] for r in distinct.select("id", "fp").collect()}
        return plain(rows, distinct, pairs, *rest)

    plain = near.similar_links
    monkeypatch.setattr(near, "similar_links", watched)
    texts = edited(3, 160)
    texts += [(1000 + k, " ".join(f"w{k}" for k in range(400)) + f" z{k}") for k in range(12)]
    assert sorted(r["doc_id"] for r in drop_similar(spark.createDataFrame(texts, "doc_id long, text string")).collect()) == slow_similar(texts)
    bits = [bin((seen["prints"][r["a"]] ^ seen["prints"][r["b"]]) & (1 << 64) - 1).count("1") for r in seen["pairs"]]
    assert len(bits) > 10 and max(bits) <= near.RADIUS


def test_frequent_shingles_are_counted_in_all_texts(spark):
    """They were counted in a quarter of the texts, 8,192 at least."""
    from tessera.llm.near_duplicates import common_shingles

    texts = spark.range(20_000).selectExpr("concat('p q r s t ', id, if(id % 2 = 0, ' u v w x y', '')) AS text").selectExpr("cast(text AS binary) AS text")
    keys, counts = common_shingles(texts, 5)
    hashes = {xxhash.xxh64_intdigest(s, 42): n for s, n in ((b"p q r s t", 20_000), (b"u v w x y", 10_000))}
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == hashes


@pytest.mark.parametrize("known", [0, 3, 40])
def test_pairs_do_not_depend_on_the_shingles_known_as_frequent(spark, monkeypatch, known):
    import tessera.llm.near_duplicates as near

    monkeypatch.setattr(near, "COMMON", known)
    texts = edited(5, 120) + [(1000, ""), (1001, " ")]
    assert sorted(r["doc_id"] for r in drop_similar(spark.createDataFrame(texts, "doc_id long, text string")).collect()) == slow_similar(texts)
