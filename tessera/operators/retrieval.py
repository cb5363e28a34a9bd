"""Lexical retrieval: token statistics, additive scores, cutoffs, diversity, topic groups, sections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import has_word, latin_tokens


def token_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(token, n, documents)``, stop words left out.

    A document's tokens are sorted in its row and the first of each is marked, so one shuffle of partial sums counts both.
    """
    tokens = documents.select(F.sort_array(latin_tokens(F.col(text))).alias("_tokens"))
    marked = F.transform("_tokens", lambda t, i: F.struct(t.alias("token"), ((i == 0) | (F.get("_tokens", i - 1) != t)).cast("long").alias("first")))
    return tokens.select(F.inline(marked)).groupBy("token").agg(F.count("*").alias("n"), F.sum("first").alias("documents"))


def relevance(title: Column, body: Column, words: Mapping[str, int], title_bonus: int = 3, exact_bonus: int = 5) -> Column:
    """Sum over words of their weight if the text has them, more if the title has, most if it is the word."""
    score = F.lit(0)
    for word, weight in words.items():
        score = score + F.when(has_word(body, word), weight).otherwise(0)
        score = score + F.when(has_word(title, word), title_bonus * weight).otherwise(0)
        score = score + F.when(F.lower(title) == word.lower(), exact_bonus * weight).otherwise(0)
    return score


def relative_cutoff(scored: DataFrame, score: str, slack: int = 30, part: float = 0.72) -> DataFrame:
    """Rows not far below the top: score >= max(top - slack, whole part of top * part)."""
    top = scored.agg(F.max(score).alias("_top"))
    least = F.greatest(F.col("_top") - slack, F.floor(F.col("_top") * part))
    return scored.crossJoin(F.broadcast(top)).where(F.col(score) >= least).drop("_top")


def diverse_top(scored: DataFrame, topic: str, order: Sequence[Column | str], per_topic: int, k: int) -> DataFrame:
    """The best k rows with at most ``per_topic`` of each topic."""
    w = Window.partitionBy(topic).orderBy(*order)
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_topic).drop("_n").orderBy(*order).limit(k)


def rerank(lexical: Column, *features: tuple[Column, float]) -> Column:
    """A weighted sum of scores in [0, 1], to four places."""
    total = lexical
    for value, weight in features:
        total = total + value * weight
    return F.round(total, 4)


def topic_groups(scored: DataFrame, topic: str, score: str, tie: str, kind: str, bonus: int) -> DataFrame:
    """One row a topic: its primary row, how many support it, and a score with a bonus for each kind."""
    best = F.max_by(F.col(tie), F.struct(F.col(score), -F.col(tie))).alias("primary")
    return scored.groupBy(topic).agg(
        best,
        (F.count("*") - 1).alias("support"),
        (F.max(score) + bonus * (F.countDistinct(kind) - 1)).alias("group_score"),
    )


def code_blocks(text: Column, fence: str = "```") -> Column:
    """The bodies of fenced blocks, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s){fence}\w*\n(.*?){fence}"), F.lit(1))


def sections(text: Column) -> Column:
    """Headings' titles of a Markdown text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6} +(.+)$"), F.lit(1))


def expand(words: DataFrame, synonyms: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with the synonyms of each added once: ``synonyms(word, other)``."""
    more = words.join(synonyms, word).select(F.col("other").alias(word))
    return words.select(word).unionByName(more).distinct()
