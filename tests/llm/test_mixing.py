import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix, mixed_documents, permute, place_documents, plan_slots, source_targets, text_mark, word_count
from tessera.runtime import stored


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop sources at their limit, share the rest again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, rest, free = {}, float(sum(sizes.values())), list(names)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100, None: 50}, {"a": 1000, "b": 1, "c": 2, "d": 500, "é": 7, "z": 0}, {"only": 12},
        {"s0": 30_000, "s1": 5, "s2": 5, "s3": 40, "s4": 1_000, None: 3},
    ],
)
def test_targets_match_brute_force(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    assert got == pytest.approx(slow_targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(n):
    images = permute(np.arange(n), n, key=0xFEDCBA9876543210)
    assert sorted(images.tolist()) == list(range(n))
    assert n < 100 or images.tolist() != permute(np.arange(n), n, key=1).tolist()


@pytest.fixture(scope="module")
def corpus(spark):
    sizes = [(k, ("a", "b", "b", "c", None)[k % 5] if k % 7 else "a", (k * 37) % 91) for k in range(400)]
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("w"), i.cast("string"))), "  ")
    rows = spark.createDataFrame(sizes, "doc_id long, source string, n int")
    made = rows.select("doc_id", F.when(F.col("n") > 0, words).alias("text"), F.lit("en").alias("lang"), "source", F.lit(0).cast("long").alias("n_chars"), F.lit("x").alias("row"))
    return stored(made, "corpus")


def mixed(corpus):
    sized = stored(corpus.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    targets = stored(source_targets(sized), "targets")
    placed = stored(place_documents(sized, targets).withColumn("row", F.monotonically_increasing_id()), "placed")
    return placed, targets, mix(placed, plan_slots(targets, block_words=16, shard_slots=8), block_words=16)


def test_sources_meet_their_targets_and_no_document_is_taken_too_often(corpus):
    placed, targets, spans = mixed(corpus)
    taken = spans.groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    rows = placed.join(taken, "row", "left").fillna(0, ["taken"]).toPandas()
    assert len(rows) == 400 and (rows["taken"] <= 3 * rows["size"]).all()
    by_source = rows.groupby("source_number")["taken"].sum().to_dict()
    for r in targets.collect():
        assert abs(by_source[r["number"]] - r["target"]) <= 1
    # a pass takes every word of its source once before the next begins
    covered = spans.groupBy("row", "pass", "lo").count().where("count > 1").count()
    assert covered == 0


def test_shards_draw_near_their_expectation_and_reruns_agree(corpus):
    placed, targets, spans = mixed(corpus)
    slots = plan_slots(targets, block_words=16, shard_slots=8)
    assert slots.groupBy("shard").count().where("count > 8").count() == 0
    again = plan_slots(targets, block_words=16, shard_slots=8)
    assert slots.exceptAll(again).count() == 0
    first = placed.join(spans, "row").groupBy("doc_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("t"))
    placed2, _, spans2 = mixed(corpus.repartition(5))
    second = placed2.join(spans2, "row").groupBy("doc_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("t"))
    assert first.exceptAll(second).count() == 0 and first.count() == second.count()


def test_mixed_documents_hold_the_taken_words(corpus):
    got = mixed_documents(corpus, block_words=16)
    assert got.columns == corpus.columns
    words = got.select("source", word_count(F.col("text")).alias("n"), (F.col("n_chars") == F.char_length("text")).alias("same"))
    sums = {r["source"]: r["n"] for r in words.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    sizes = {r["source"]: r["n"] for r in corpus.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()}
    targets = slow_targets(sizes)
    assert all(abs(sums[s] - targets[s]) <= 1 for s in sizes) and words.where("NOT same").count() == 0


def test_odd_rows(documents):
    got = mixed_documents(documents)
    assert got.columns == documents.columns and got.where("text IS NULL OR trim(text) = ''").count() == 0


def test_empty_table(empty):
    assert mixed_documents(empty).count() == 0


def test_reruns_agree_where_ids_repeat(spark):
    rows = [(1 if k % 2 else k, "ab"[k % 3 == 0], f"w{k} " * (k % 50)) for k in range(240)]

    def taken(rows):
        frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
        sized = stored(frame.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"), text_mark(F.col("text"))), "sized")
        targets = stored(source_targets(sized), "targets")
        placed = stored(place_documents(sized, targets).withColumn("row", F.monotonically_increasing_id()), "placed")
        sums = mix(placed, plan_slots(targets, 16, 8), 16).groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
        return sorted((r["doc_id"], r["text"], r["n"]) for r in placed.join(sums, "row").collect())

    assert taken(rows) == taken(rows[::-1]) == taken(rows[100:] + rows[:100])


def test_words_taken_match_brute_force(corpus):
    """Each slot laid over its source's stream word by word."""
    placed, targets, spans = mixed(corpus)
    streams, got = {}, {}
    for r in placed.collect():
        for k in range(r["size"]):
            streams[r["source_number"], r["first_word"] + k] = (r["row"], k)
    wanted = {}
    for s in plan_slots(targets, block_words=16, shard_slots=8).collect():
        for at in range(16 * s["block"], 16 * s["block"] + s["words"]):
            wanted[streams[s["source_number"], at]] = wanted.get(streams[s["source_number"], at], 0) + 1
    for r in spans.collect():
        for k in range(r["lo"], r["hi"]):
            got[r["row"], k] = got.get((r["row"], k), 0) + 1
    assert got == wanted and max(got.values()) <= 3
