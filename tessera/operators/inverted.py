"""An inverted index of texts, and scores of queries that read only the postings of the words asked for.

A posting is a term in a field of one document, with all its places there. Terms are runs of ASCII letters,
digits and underscores in lower case, placed by their number in the text, and pairs of neighbouring CJK characters,
placed by character. A word is one term or several in a row: a phrase, or a longer CJK word. The index is
Parquet, dealt to folders by a hash of the term. Within a folder each task that wrote it has a file of its own
documents in order of terms, so a term that most documents have is many files' work and other folders are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import bound
from tessera.runtime import broadcast_up_to, small_batches, spread, width

#: Folders of an index.
BUCKETS = 64
#: Places that a task holds before it writes a segment of postings, and words or terms that are broadcast at most.
SEGMENT_PLACES, BROADCAST_ROWS = 1_000_000, 500_000
_CJK = "[一-鿿]"
_LATIN, _CJK_RUN = re.compile("[a-z0-9_]+"), re.compile(f"{_CJK}{{2,}}")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def terms_of(text: Column) -> Column:
    """``array<struct<term, place>>`` of a text; null has none."""
    none = F.array().cast("array<struct<term:string,place:int>>")
    latin = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w, i: F.struct(w.alias("term"), i.alias("place")))

    def pairs(letters: Column) -> Column:
        return F.transform(letters, lambda c, i: F.struct(F.concat(c, F.coalesce(F.get(letters, i + 1), F.lit(""))).alias("term"), i.alias("place")))

    # the letters are bound: split at each of them, a text would take time in the square of its length
    found = F.filter(bound(F.split(text, ""), pairs), lambda p: p["term"].rlike(f"^{_CJK}{{2}}$"))
    cjk = F.when(text.rlike(f"{_CJK}{{2}}"), found).otherwise(none)
    return F.when(text.isNotNull(), F.concat(latin, cjk)).otherwise(none)


def _gathered(text: str, lower: str) -> dict[str, list[int]]:
    """The places of each term of a text, the same as ``terms_of`` gives; ``lower`` is the text in lower case."""
    places: dict[str, list[int]] = {}
    for place, word in enumerate(_LATIN.findall(lower)):
        places.setdefault(word, []).append(place)
    for run in _CJK_RUN.finditer(text):
        for at in range(run.start(), run.end() - 1):
            places.setdefault(text[at : at + 2], []).append(at)
    return places


def _segments(documents: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """``(term, field, items)``: the postings of a term in a field of some neighbouring documents, each ``(key, whole, places)``."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), text.cast("string").alias("text")) for name, text in fields.items()])
    texts = spread(documents.select(F.col(key).alias("key"), each.alias("_each"))).select("key", F.inline("_each")).where("text IS NOT NULL")
    texts = texts.withColumn("lower", F.lower("text")).withColumn("whole", F.xxhash64("lower"))
    kind = texts.schema["key"].dataType.simpleString()
    small_batches(documents.sparkSession)

    def segment(batch: pa.RecordBatch, found: dict[tuple[str, str], tuple[list[int], list[list[int]]]]) -> pa.RecordBatch:
        rows = pa.array(list(chain.from_iterable(r for r, _ in found.values())), pa.int64())
        ends = list(accumulate((len(r) for r, _ in found.values()), initial=0))
        lists = list(chain.from_iterable(at for _, at in found.values()))
        places = pa.array(list(chain.from_iterable(lists)), pa.int32())
        places = pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32()), places)
        items = pa.StructArray.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), places], names=["key", "whole", "places"])
        named = [pa.array([name[k] for name in found], pa.string()) for k in (1, 0)]
        return pa.RecordBatch.from_arrays([*named, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["term", "field", "items"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = {}, 0
            for row in range(batch.num_rows):
                field, text, lower = (batch.column(k)[row].as_py() for k in (1, 3, 4))
                for term, at in _gathered(text, lower).items():
                    rows, places = found.setdefault((field, term), ([], []))
                    rows.append(row)
                    places.append(at)
                    held += len(at)
                if held >= SEGMENT_PLACES:
                    yield segment(batch, found)
                    found, held = {}, 0
            yield segment(batch, found)

    schema = f"term string, field string, items array<struct<key: {kind}, whole: bigint, places: array<int>>>"
    return texts.select("key", "field", "whole", "text", "lower").mapInArrow(gathered, schema)


def postings(documents: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """``(term, key, field, whole, places)``: ``whole`` is a hash of the field's text in lower case, ``places`` sorted.

    Rows of one key count as one document; null keys are one, too. A key's equal texts give equal postings, which count once.
    """
    return _segments(documents, key, fields).select("term", "field", F.inline("items")).select("term", "key", "field", "whole", "places")


def write_index(documents: DataFrame, key: str, fields: Mapping[str, Column], path: str) -> None:
    """Write the postings of ``documents`` as an index at ``path``, in place of any other there.

    Each task writes those of the documents that it reads, so nothing but texts of a small input is shuffled.
    """
    made = _segments(documents, key, fields).withColumn("bucket", _bucket(F.col("term")))
    made.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)


def word_terms(words: DataFrame) -> DataFrame:
    """``words(query, word, weight)``, repeated ones once, with ``terms``; a word with no term, or of both kinds, is an error."""
    terms = terms_of(F.col("word"))
    odd = (F.size(terms) == 0) | (F.col("word").rlike(f"{_CJK}{{2}}") & F.col("word").rlike("(?i)[a-z0-9_]"))
    sure = F.when(odd, F.raise_error(F.concat(F.lit("not a word of one kind: "), F.coalesce("word", F.lit("null"))))).otherwise(terms)
    return words.select("query", "word", "weight").distinct().withColumn("terms", sure)


def asked_postings(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """The postings at ``path`` whose term is in a word of ``words(..., word)``; other folders are not read."""
    terms = words.select(F.explode(terms_of(F.col("word"))["term"]).alias("term")).distinct()
    buckets = [b for (b,) in terms.select(_bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
    index = spark.read.parquet(path)
    asked = index.where(F.col("bucket").isin(buckets) if buckets else F.lit(False)).join(broadcast_up_to(terms, BROADCAST_ROWS), "term", "left_semi")
    return asked.select("term", "field", F.inline("items")).select("term", "key", "field", "whole", "places")


def indexed_relevance(found: DataFrame, words: DataFrame, bonus: Mapping[str, int], exact: Mapping[str, int]) -> DataFrame:
    """``(query, key, score)`` of the documents that have a word of a query.

    ``found(term, key, field, whole, places)`` are postings, of which repeated ones count once. A word of ``words(query, word, weight)``
    gives its weight times the field's ``bonus`` where the field has it, and as often the field's ``exact`` where it is the field's whole text.

    Postings meet by document before they meet the queries: what is shuffled grows with the documents' asked terms, not with the
    queries that ask for each, and a document's scores are summed in one task.
    """
    asked = word_terms(words).withColumns({"n_terms": F.size("terms"), "_equal": F.xxhash64(F.lower("word"))})
    parts = asked.select("query", "word", "weight", "n_terms", "_equal", F.inline("terms")).withColumnRenamed("place", "_off")

    tasks = width(found.select("key"))

    def met(rows: DataFrame, which: str) -> DataFrame:
        """Distinct ``rows`` with the words that they are asked for by, dealt by document."""
        some = parts.where(which)
        dealt = rows.join(broadcast_up_to(some.select("term").distinct(), BROADCAST_ROWS), "term", "left_semi").repartition(tasks, "key")
        return dealt.dropDuplicates(["term", "key", "field", "whole"]).join(broadcast_up_to(some, BROADCAST_ROWS), "term")

    own = ["query", "word", "weight", "_equal", "key", "field", "whole"]
    single = met(found.drop("places"), "n_terms = 1")
    several = met(found, "n_terms > 1").withColumn("_starts", F.transform("places", lambda p: p - F.col("_off")))
    # as many arrays as the word has terms
    gathered = several.groupBy(*own, "n_terms").agg(F.collect_list("_starts").alias("_all"))
    shared = F.aggregate(F.slice("_all", 2, F.size("_all")), F.element_at("_all", 1), F.array_intersect)
    phrases = gathered.where((F.size("_all") == F.col("n_terms")) & (F.size(shared) > 0))

    def by_field(values: Mapping[str, int]) -> Column:
        return reduce(lambda rest, kv: F.when(F.col("field") == kv[0], kv[1]).otherwise(rest), values.items(), F.lit(0))

    equal = F.when(F.col("whole") == F.col("_equal"), by_field(exact)).otherwise(0)
    score = F.sum(F.col("weight") * (by_field(bonus) + equal)).alias("score")
    # summed before they are put together, so that no hit is moved
    sums = [hits.groupBy("query", "key").agg(score) for hits in (single, phrases)]
    return sums[0].unionByName(sums[1]).groupBy("query", "key").agg(F.sum("score").alias("score"))
