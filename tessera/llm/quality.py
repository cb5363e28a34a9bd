"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds.

Each rule rejects documents whose ratio exceeds a cutoff. For every stratum (language) the cutoffs
of a grid are tried from lenient to strict on the documents labelled good: a cutoff is valid if
the one-sided Clopper-Pearson bound on its false rejections, at a confidence shared out over all
rules and strata (Bonferroni), stays below the rule's share of ``limit``. False rejections never
fall as cutoffs get stricter, so testing in that order needs no correction for the grid. Among
valid cutoffs the one that rejects most bad documents, net of good ones, is taken; a stratum with
too few labels gets none. All labelled rows count; everything is built-in DataFrame functions.

Cases: a null or empty text has no words and fails the base rules. A null language is a stratum of
its own. Repeated rows are kept; repeated or conflicting labels of a document each count, as does
a label for each row of a repeated document; labels without a document or with a null do not. An
empty table gives an empty table, and empty labels no cutoffs. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import broadcast_up_to, spread, stored

#: Most good documents of a stratum that all rules together may reject, and the chance of exceeding it.
LIMIT, RISK = 0.05, 0.1
#: Bad documents that must go for each good one.
PRICE = 20
#: Ids of labelled documents, of eight bytes, that are broadcast at most; more are met in a shuffled join.
BROADCAST_ROWS = 2_000_000
#: Cutoffs tried for a rule.
STEPS = 40


@dataclass(frozen=True)
class Rule:
    """Reject where part / whole > cutoff, for cutoffs in ``STEPS`` steps from ``high`` down to ``low``."""

    name: str
    part: str
    whole: str
    low: float
    high: float

    def rejected_from(self) -> Column:
        """The first step, from lenient to strict, whose cutoff rejects the row; STEPS + 1 if none does.

        Labelled rows are counted and all rows judged by this one number, so rounding can't part them.
        """
        ratio = F.try_divide(F.col(self.part), F.col(self.whole))
        first = F.floor((F.lit(self.high) - ratio) * (STEPS / (self.high - self.low))) + 1
        return F.greatest(F.lit(0), F.least(F.lit(STEPS + 1), first)).cast("int")


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.0, 4.0),
    Rule("dup_lines", "n_dup_lines", "n_lines", 0.0, 1.0),
    Rule("repeats", "n_repeat_words", "n_words", 0.0, 1.0),
    Rule("word_length", "word_chars", "n_words", 4.0, 16.0),
)

# The six ASCII blanks that end a word, and symbol characters.
_BLANKS = r"' \t\n\u000B\u000C\r'"
_SPLIT = r"'[\\x20\\x09-\\x0D]+'"
_NO_SYMBOLS = "'[^#*$%&|<>]+'"

_WORDS = f"IF(btrim(t, {_BLANKS}) = '', CAST(array() AS array<string>), split(btrim(t, {_BLANKS}), {_SPLIT}))"
_LINES = rf"filter(split(t, '\n'), l -> btrim(l, {_BLANKS}) <> '')"
#: Windows are told apart by a 64-bit hash of their three words; each array is bound to a name once.
_REPEATS = """
    transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
      IF(size(array_distinct(h)) = size(h), 0L,
        transform(array(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
          transform(array(sort_array(transform(
              filter(s, (e, j) -> (j > 0 AND s[greatest(j - 1, 0)].x = e.x) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].x = e.x)),
              e -> e.i))), p ->
            aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1), x + 3) - x)), 0L, (a, b) -> a + b))[0])[0]))[0]
"""
_FEATURES = f"""
    transform(array({_WORDS}), w -> transform(array({_LINES}), l -> named_struct(
      'n_words', CAST(size(w) AS bigint),
      'word_chars', CAST(char_length(array_join(w, '')) AS bigint),
      'n_symbols', CAST(char_length(regexp_replace(t, {_NO_SYMBOLS}, '')) AS bigint),
      'n_lines', CAST(size(l) AS bigint),
      'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS bigint),
      'n_repeat_words', IF(size(w) < 3, 0L, {_REPEATS})))[0])[0]
"""


def features(documents: DataFrame, whole: bool = False) -> DataFrame:
    """Counts of each whole text of ``documents(doc_id, text, lang)``, with ``base_failed``.

    ``whole`` also keeps the document as it came, as the struct ``document``.
    """
    carried = ["document"] if whole else []
    texts = documents.select(
        *[F.struct(*documents.columns).alias(c) for c in carried],
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
    )
    counts = spread(texts).select("doc_id", "stratum", *carried, F.expr(_FEATURES).alias("f")).select("doc_id", "stratum", *carried, "f.*")
    return counts.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def most_allowed(n: Column, limit: float, risk: float | Column) -> Column:
    """The most false rejections among ``n`` whose upper bound at ``risk`` is within ``limit``; -1 if none.

    That is the largest k with P(X <= k) <= risk for X binomial(n, limit), summed in logarithms.
    """
    odds = F.log(F.lit(limit / (1 - limit)))
    start = F.struct((n * F.log1p(F.lit(-limit))).alias("term"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("most"))

    def add(s: Column, k: Column) -> Column:
        total = s["sum"] + F.exp(s["term"])
        following = s["term"] + F.when(k < n, F.log((n - k) / (k + 1)) + odds).otherwise(F.lit(float("-inf")))
        return F.struct(following.alias("term"), total.alias("sum"), F.when(total <= risk, k).otherwise(s["most"]).alias("most"))

    # beyond the expected count the sum exceeds a half
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * limit).cast("long")), start, add, lambda s: s["most"])


def cutoffs(rows: DataFrame, labels: DataFrame, limit: float = LIMIT, risk: float = RISK, price: float = PRICE) -> DataFrame:
    """``(stratum, <rule>...)``: the chosen step of each rule's cutoffs, null for none."""
    held = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("quality").cast("int").alias("_q")).where("_q IN (0, 1)")
    tried = rows.where("NOT base_failed").join(held, rows["doc_id"] == held["_doc"])
    steps = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), r.rejected_from().alias("step")) for r in RULES])).alias("s")
    cells = tried.select("stratum", "_q", steps).groupBy("stratum", "s.rule", "s.step").agg(
        F.sum("_q").alias("good"), F.sum(1 - F.col("_q")).alias("bad")
    )
    # from here on a row for each stratum, rule and step: small
    by_rule = cells.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("step", "good", "bad")).alias("cells")
    )
    tests = F.lit(len(RULES)) * F.size("strata")
    strata = by_rule.agg(F.collect_set("stratum").alias("strata"))
    share = limit / len(RULES)
    by_rule = by_rule.crossJoin(F.broadcast(strata)).select(  # one row, for the number of tests
        "stratum", "rule", "cells", most_allowed(F.col("n"), share, F.lit(risk) / tests).alias("most")
    )

    def upto(name: str, step: Column) -> Column:
        picked = F.filter("cells", lambda c: c["step"] <= step)
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, c: a + c[name])

    candidates = by_rule.select("stratum", "rule", "most", "cells", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("step")).select(
        "stratum", "rule", "most", "step", upto("good", F.col("step")).alias("good"), upto("bad", F.col("step")).alias("bad")
    )
    gain = F.col("bad") - price * F.col("good")
    best = candidates.where((F.col("good") <= F.col("most")) & (gain > 0)).groupBy("stratum", "rule").agg(
        F.max_by("step", F.struct(gain, -F.col("step"))).alias("step")
    )
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("step"))).alias(r.name) for r in RULES])


def judge(documents: DataFrame, labels: DataFrame, limit: float = LIMIT, risk: float = RISK, whole: bool = False) -> DataFrame:
    """``features`` with the ``verdicts`` of the rules (names of those that reject) and ``kept``.

    With ``whole`` nothing but the labelled documents' counts is written.
    """
    if whole:
        # whole documents are not written for their labels' sake: labelled ones are counted for the cutoffs, then all in passing
        ids = labels.select(F.col("doc_id").cast("long").alias("_doc")).distinct()
        held = documents.join(broadcast_up_to(ids, BROADCAST_ROWS), F.col("doc_id").cast("long") == F.col("_doc"), "left_semi")
        rows, labelled = features(documents, whole), stored(features(held), "labelled")
    else:
        rows = labelled = stored(features(documents), "quality")
    chosen = stored(cutoffs(labelled, labels, limit, risk), "cutoffs")
    chosen = chosen.select(F.col("stratum").alias("_stratum"), *[F.col(r.name).alias(f"_{r.name}") for r in RULES])
    rejects = [F.when(r.rejected_from() <= F.col(f"_{r.name}"), F.lit(r.name)) for r in RULES]
    judged = rows.join(chosen, rows["stratum"] == chosen["_stratum"], "left").withColumn("verdicts", F.array_compact(F.array(*rejects)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("verdicts") == 0)).select(*rows.columns, "verdicts", "kept")
