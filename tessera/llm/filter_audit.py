"""What each of five filters removes, in every order of the five.

Texts are scanned where they lie in Arrow's buffers: a table gives the class of each byte (blank,
capital, symbol, inner byte of a character), prefix sums of the classes are read off at the documents' ends,
and a word begins where a byte that is no blank follows a blank or the document's start. Prefix sums of
bytes weighted with powers of an odd number hash all words at once. Sorted by document and hash,
a word counts as distinct unless it has the hash of the one before; words with equal hashes are
then compared byte by byte, and a document in which two differ is counted by a set of its words.

The failed filters of a document are a mask. Copies are known by a digest of the text. All rows with the
same mask, part, labels and digest are counted before they meet their digest's others, so a text
that a third of all rows share is a few rows a task. What is left, a count for each part,
mask and pair of labels, is held against the 120 orders.

Cases: a null text is an empty one, a null lang the part of the empty string. A null doc_id has no
label, and is never the smaller id nor has one. Rows that repeat an id count each; with equal texts
neither is the other's copy. Labels that repeat count once. An empty table gives an empty one. Other
columns are ignored. Texts of any length are scanned in blocks; only a document's word hashes are held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import small_batches, spread

#: Bytes scanned at once, and pairs of words compared at once.
BLOCK, PAIRS = 1 << 20, 1 << 16
_BLANK, _CAPITAL, _SYMBOL, _INNER = 1, 2, 4, 8
_MULTIPLIER = 0x9E3779B97F4A7C15
_COUNTS = ("n_chars", "n_capitals", "n_symbols", "n_words", "n_distinct")

FILTERS = "ABCDE"
#: Whether a document fails: too few words, too few distinct ones, too many capitals, any symbol. ``E`` is the copy of a smaller id.
FAILS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "n_symbols > 0",
}


def _classes() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] = _BLANK
    kinds[ord("A") : ord("Z") + 1] = _CAPITAL
    kinds[list(b"#$%&*|")] = _SYMBOL
    kinds[0x80:0xC0] = _INNER
    return kinds


_CLASSES = _classes()


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and those of its inverse."""
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    up, down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, dtype=np.uint64))) for x in (_MULTIPLIER, inverse))
    return up, down


class _Words:
    """Documents, hashes, places and lengths of words, in the order of the documents."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def distinct(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many different words each document has."""
        n = len(offsets) - 1
        if not any(len(x[0]) for x in self.parts):
            return np.zeros(n, dtype=np.int64)
        owner, hashes, begins, lengths = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((hashes, owner))
        owner, hashes, begins, lengths = owner[order], hashes[order], begins[order], lengths[order]
        again = np.append(False, (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1]))
        counts = np.bincount(owner[~again], minlength=n)
        at = np.flatnonzero(again)
        odd = [owner[at[lengths[at] != lengths[at - 1]]]]
        at = at[lengths[at] == lengths[at - 1]]
        for pair in range(0, len(at), PAIRS):
            mine = at[pair : pair + PAIRS]
            sizes = lengths[mine]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            same = data[np.repeat(begins[mine], sizes) + within] == data[np.repeat(begins[mine - 1], sizes) + within]
            if not same.all():
                odd.append(owner[np.repeat(mine, sizes)[~same]])
        for k in np.unique(np.concatenate(odd)).tolist():  # hashes met by chance
            counts[k] = len(set(data[offsets[k] : offsets[k + 1]].tobytes().split()))
        return counts


def _scan(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, sums: np.ndarray, words: _Words) -> None:
    """Add what ``data[lo:hi]`` holds to the documents' sums and words; no word goes on beyond a block unless a document ends there."""
    kinds = _CLASSES[data[lo:hi]]
    edges = np.clip(offsets, lo, hi) - lo
    blank = (kinds & _BLANK).astype(bool)
    cut = np.zeros(hi - lo + 1, dtype=bool)
    cut[edges] = cut[0] = cut[-1] = True
    before, after = np.append(True, blank[:-1]) | cut[:-1], np.append(blank[1:], True) | cut[1:]
    begins, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    for k, flags in enumerate(((kinds & _INNER) == 0, kinds & _CAPITAL != 0, kinds & _SYMBOL != 0)):
        sums[k] += np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[edges])
    owner = np.searchsorted(offsets, lo + begins, side="right") - 1
    sums[3] += np.bincount(owner, minlength=len(offsets) - 1)
    up, down = (x[: hi - lo] for x in _powers(max(BLOCK, hi - lo)))
    hashed = np.append(np.uint64(0), np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up))
    words.parts.append((owner, (hashed[ends] - hashed[begins]) * down[begins], lo + begins, ends - begins))


def _ends(data: np.ndarray, lo: int, hi: int, block: int) -> Iterator[int]:
    """Ends of blocks of a long document, each behind a blank where there is one."""
    at = lo
    while hi - at > block:
        step = at + block
        while step < hi:  # a word longer than a block stays whole
            found = np.flatnonzero(_CLASSES[data[step : min(hi, step + block)]] == _BLANK)
            if len(found):
                step += int(found[0]) + 1
                break
            step = min(hi, step + block)
        at = step
        yield at
    if at < hi:
        yield hi


def text_counts(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Rows of characters, capitals, symbols, words and distinct words of the texts ``data[offsets[k]:offsets[k + 1]]``."""
    out = np.zeros((5, len(offsets) - 1), dtype=np.int64)
    first = 0
    while first < out.shape[1]:
        # as many documents as fit a block, one at least
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block, side="right")) - 1)
        mine, sums, words = offsets[first : last + 1], np.zeros((4, last - first), dtype=np.int64), _Words()
        lo = int(mine[0])
        for hi in _ends(data, lo, int(mine[-1]), block):
            _scan(data, mine, lo, hi, sums, words)
            lo = hi
        out[:4, first:last], out[4, first:last] = sums, words.distinct(data, mine)
        first = last
    return out


def scan_texts(documents: DataFrame) -> DataFrame:
    """``(doc_id, part, n_chars, n_capitals, n_symbols, n_words, n_distinct, digest)`` of ``documents(doc_id, text, lang)``, in one pass."""
    small_batches(documents.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            _, ends, content = texts.buffers()
            offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(content, dtype=np.uint8) if content else np.empty(0, dtype=np.uint8)
            counts = [pa.array(x) for x in text_counts(data, offsets)]
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *counts, pa.array(digests, pa.binary())], names=["doc_id", "part", *_COUNTS, "digest"]
            )

    rows = documents.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    )
    kinds = ", ".join(f"{c} long" for c in _COUNTS)
    return spread(rows).mapInArrow(scan, f"doc_id long, part string, {kinds}, digest binary")


def failed_masks(documents: DataFrame, labels: DataFrame, fails: dict[str, str] = FAILS) -> DataFrame:
    """``(part, failed, good, toxic, n)``: how many documents of a part and pair of labels fail just the filters ``failed``, a sorted string of letters."""
    failed = F.concat(*[F.when(F.expr(condition), letter).otherwise("") for letter, condition in fails.items()])
    scanned = scan_texts(documents).select("doc_id", "part", failed.alias("failed"), "digest")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    named = scanned.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    kind = ["part", "failed", "good", "toxic"]
    by_id = named.groupBy("digest", "doc_id", *kind).agg(F.count("*").alias("n"))
    # rows of the smallest id are no copies, and those without an id never are
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    by_text = by_id.groupBy("digest", *kind).agg(F.sum("n").alias("n"), first, nameless)
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    # one text has one mask, so a digest has no more rows here than there are parts and pairs of labels
    originals = F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = by_text.withColumn("originals", originals).groupBy(*kind).agg(F.sum("n").alias("n"), F.sum("originals").alias("originals"))
    both = F.array(
        F.struct("failed", F.col("originals").alias("n")), F.struct(F.concat("failed", F.lit("E")).alias("failed"), (F.col("n") - F.col("originals")).alias("n"))
    )
    return split.select("part", "good", "toxic", F.explode(both).alias("_both")).select("part", "_both.failed", "good", "toxic", "_both.n")


def audit_filters(documents: DataFrame, labels: DataFrame, fails: dict[str, str] = FAILS) -> DataFrame:
    """What each filter does in each place of each order, by part.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``;
    shapley is what the step's filter removes in all orders together.
    """
    letters = [*fails, "E"]
    orders = ["".join(p) for p in permutations(letters)]
    masks = failed_masks(documents, labels, fails)
    placed = masks.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))
    )
    ahead, upto, own = (F.expr(f"substring(filter_order, {a}, {b})") for a, b in ((1, "step - 1"), (1, "step"), ("step", 1)))

    def free(part: Column) -> Column:
        """Whether none of these filters is failed."""
        return F.length(F.call_function("translate", part, F.col("failed"), F.lit(""))) == F.length(part)

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    here = free(ahead) & ~free(own)
    # of the orders of the filters that a document fails, each one comes first equally often
    share = F.when(~free(own), F.col("n") * len(orders) / F.length("failed")).otherwise(0).cast("long")
    return placed.groupBy("part", "filter_order", "step").agg(
        count(free(upto)).alias("kept"),
        count(here).alias("removed"),
        count(~free(ahead) & ~free(own)).alias("redundant"),
        count(F.col("failed") == own).alias("unique_fails"),
        count(here & F.col("good")).alias("good_lost"),
        count(here & F.col("toxic")).alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )
