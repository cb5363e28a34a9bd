"""The inverted index against scores by expressions over every text."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import inverted as I
from tessera.operators import retrieval as T

DOCS = [
    (1, "Text Input", "a text input, input text; input"), (2, "input", "Nothing of it"), (3, None, None), (4, "", "INPUT_x input2 inputs"),
    (5, "列表组件", "使用列表组件和列表 list"), (6, "List", "the list of lists; 表组"), (7, "text", "text  INPUT text-input"), (8, "a", "a a a a"), (9, "x", "é input é"),
]
FIELDS = {"body": F.col, "title": F.col}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "postings")
    docs = spark.createDataFrame(DOCS, "id long, title string, text string").withColumns({"key": F.lit("x"), "term": F.lit("y"), "field": F.lit("z")})
    I.write_index(docs, "id", {"body": F.col("text"), "title": F.col("title")}, path)
    return docs, path


def scores(spark, path, words):
    asked = spark.createDataFrame(words, "query int, word string, weight int")
    found = I.indexed_relevance(I.asked_postings(spark, path, asked), asked, {"body": 1, "title": 3}, {"title": 5})
    return {(r["query"], r["key"]): r["score"] for r in found.collect()}


def test_scores_are_those_of_the_expression(spark, index):
    docs, path = index
    words = {"input": 4, "text": 2, "list": 7, "a": 1, "input2": 3, "absent": 9}
    expected = docs.select("id", T.relevance(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), words).alias("s")).where("s > 0")
    assert scores(spark, path, [(1, w, n) for w, n in words.items()] + [(1, "list", 7)]) == {(1, r["id"]): r["s"] for r in expected.collect()}


def test_phrases_and_long_cjk_words(spark, index):
    _, path = index
    found = scores(spark, path, [(1, "text input", 1), (2, "列表组件", 1), (3, "表组", 1), (4, "a a", 1), (5, "input text input", 1), (6, "Input", 1)])
    assert {k: v for k, v in found.items() if k[0] == 1} == {(1, 1): 1 + 3 + 5, (1, 7): 1}
    assert {k: v for k, v in found.items() if k[0] == 2} == {(2, 5): 1 + 3 + 5}
    assert {k: v for k, v in found.items() if k[0] == 3} == {(3, 5): 1 + 3, (3, 6): 1}
    assert {k: v for k, v in found.items() if k[0] in (4, 5)} == {(4, 8): 1, (5, 1): 1, (5, 7): 1}
    assert (6, 2) in found and found[6, 2] == 3 + 5


def test_other_folders_are_not_read(spark, index):
    _, path = index
    asked = spark.createDataFrame([(1, "input", 1)], "query int, word string, weight int")
    read = I.asked_postings(spark, path, asked)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert {r["term"] for r in read.collect()} == {"input"}
    assert I.asked_postings(spark, path, asked.limit(0)).count() == 0


def test_places_repeats_and_odd_rows(spark, tmp_path):
    rows = [(1, "b a b"), (1, "a"), (None, "a"), (2, None)]
    found = I.postings(spark.createDataFrame(rows, "k long, t string"), "k", {"t": F.col("t")}).collect()
    assert sorted((r["term"], r["key"] or 0, r["places"]) for r in found) == [("a", 0, [0]), ("a", 1, [0]), ("a", 1, [1]), ("b", 1, [0, 2])]
    I.write_index(spark.createDataFrame([], "k long, t string"), "k", {"t": F.col("t")}, str(tmp_path / "none"))


@pytest.mark.parametrize("word", ["", "?!", "text 列表", None])
def test_words_without_terms_are_refused(spark, word):
    with pytest.raises(Exception, match="not a word"):
        I.word_terms(spark.createDataFrame([(1, word, 1)], "query int, word string, weight int")).collect()


def test_token_counts_count_texts_once(spark):
    rows = [("list lists list a1 a1 the",), ("a1",), (None,), ("",)]
    found = {r["token"]: (r["n"], r["documents"]) for r in T.token_counts(spark.createDataFrame(rows, "text string")).collect()}
    words = [w for (t,) in rows for w in (t or "").split() if w in ("list", "lists", "a1")]
    assert {k: v for k, v in found.items() if k in words} == {k: (n, sum(k in (t or "").split() for (t,) in rows)) for k, n in Counter(words).items()}


def test_terms_of_a_long_cjk_text_take_time_in_proportion(spark):
    """Split anew for each of its letters, 60,000 letters took minutes."""
    texts = [("表" * 60_000,), ("Ab_1 表組x𠀀表组 ÉK ab_1",), ("",), (None,)]
    docs = spark.createDataFrame(texts, "text string").withColumn("id", F.monotonically_increasing_id())
    began = time.monotonic()
    by_expression = docs.select("id", F.inline(I.terms_of(F.col("text")))).groupBy("id", "term").agg(F.array_sort(F.collect_list("place")).alias("places"))
    expected = {(r["id"], r["term"], tuple(r["places"])) for r in by_expression.collect()}
    assert time.monotonic() - began < 30
    got = {(r["key"], r["term"], tuple(r["places"])) for r in I.postings(docs, "id", {"body": F.col("text")}).collect()}
    assert got == expected and len(got) > 5


def test_scores_meet_by_document_only(spark, index):
    """Hits of every query that asks for a term were shuffled, so what was written grew with documents times queries."""
    _, path = index
    asked = spark.createDataFrame([(k, w, 1) for k in range(50) for w in ("input", "text input")], "query int, word string, weight int")
    found = I.indexed_relevance(I.asked_postings(spark, path, asked), asked, {"body": 1}, {})
    assert len(found.collect()) == 50 * 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r" Exchange hashpartitioning\((.*)", plan)
    assert any(d.startswith("key#") for d in dealt) and not any("query#" in d and "key#" in d for d in dealt)


def test_repeated_rows_count_once(spark, tmp_path):
    """Equal texts of a key lie in the files of several tasks; a null key is one document."""
    rows = [(k, t) for k, t in [(1, "Ab cd"), (1, "Ab cd"), (1, "x ab"), (None, "ab cd"), (2, None)] for _ in range(20)]
    path = str(tmp_path / "index")
    I.write_index(spark.createDataFrame(rows, "k long, t string").repartition(7), "k", {"t": F.col("t")}, path)
    asked = spark.createDataFrame([(1, "ab", 3), (1, "ab cd", 5)], "query int, word string, weight int")
    found = I.indexed_relevance(I.asked_postings(spark, path, asked), asked, {"t": 1}, {"t": 2})
    assert {r["key"]: r["score"] for r in found.collect()} == {1: 3 + 3 + 5 * 3, None: 3 + 5 * 3}


def test_long_documents_are_cut_into_segments(spark, monkeypatch):
    """A batch holds a bounded number of places, whatever its texts; all are written."""
    monkeypatch.setattr(I, "SEGMENT_PLACES", 50)
    docs = spark.createDataFrame([(k, "a b a " * 20) for k in range(30)], "k long, t string").coalesce(1)
    found = I.postings(docs, "k", {"t": F.col("t")}).collect()
    assert sorted((r["term"], r["key"], len(r["places"])) for r in found) == sorted((t, k, n) for k in range(30) for t, n in (("a", 40), ("b", 20)))


def test_an_index_is_written_without_a_shuffle(spark, tmp_path):
    """Postings were ranged, which made them twice, wrote some five times the texts and spilled as much."""
    docs = spark.range(400).select("id", F.lit("a b c").alias("t")).repartition(8)  # as many pieces as cores, or more
    path, tracker = str(tmp_path / "index"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("index", "")
    I.write_index(docs, "id", {"t": F.col("t")}, path)
    spark.sparkContext.setJobGroup("none", "")
    stages = {s for j in tracker.getJobIdsForGroup("index") for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) <= 3  # the shuffle of this test, with adaptive planning once more, and the write
    assert spark.read.parquet(path).groupBy("term").agg(F.sum(F.size("items")).alias("n")).where("n = 400").count() == 3
