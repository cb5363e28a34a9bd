"""Mixing sources to target weights over fixed-length blocks.

Each source's documents, in a pseudorandom order, form one stream of words that is cut into blocks
of ``block_words``. The mix is a row of output slots, one block each, cut into output shards. A
shard draws its slots' sources from a multinomial distribution with the target weights; draws are
then settled against the exact quotas, surplus slots of one source going to sources still owed.
A source's slots are numbered over all shards; number ``j`` is the ``j mod n``-th entry of a
pseudorandom permutation of its ``n`` blocks, keyed by the source and the pass, so every block is
read once before any is read again, and blocks are joined by that index. The last slot of a source
takes only the words still owed, and a source's short last block comes last in each pass, so the
words taken meet the target to the word. Everything follows from hashes of ``seed``: reruns agree.

Cases: a null or blank text has size zero, and takes nothing. A null source is a source, after all
others. Repeated rows are separate documents; only equal ones may change places between runs. Targets never exceed three times a source's size,
so no document exceeds three times its own. An empty table gives an empty table. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import hash_position, running_totals
from tessera.runtime import parallelism, small_batches, stored

_WORD = re.compile(r"[^\x20\x09-\x0D]+")

BLOCK_WORDS, SHARD_SLOTS, SEED, MOST_TIMES = 256, 1024, 17, 3
#: Slots that a task makes at most, about, and at once.
TASK_SLOTS, BATCH_SLOTS = 1 << 20, 1 << 15


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_TIMES) -> DataFrame:
    """``(source, number, weight, source_size, target)`` for ``sized(source, size)``.

    Sources get the weights in turn, by code point with null last. With r = most * size / weight,
    the sources that end at their limit are the first ones in order of r: those whose r is
    below the share, by weight, of what the earlier ones leave. Windows run over one row a source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # UTF-8 bytes sort like code points
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = totals.withColumn("number", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("number") % len(weights)))
    ratio = F.lit(most) * F.col("source_size") / F.col("weight")
    by_ratio = Window.orderBy("_ratio", "number")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shared = ranked.withColumn("_ratio", ratio).withColumns(
        {
            "_all": F.sum("source_size").over(whole),
            "_weights": F.sum("weight").over(whole),
            "_given": F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0)),
            "_used": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    share = shared.withColumn("_share", (F.col("_all") - F.col("_given")) / (F.col("_weights") - F.col("_used")))
    share = share.withColumn("_free", F.col("_ratio") > F.col("_share"))
    level = share.withColumn("_level", F.min(F.when(F.col("_free"), F.struct("_ratio", "number", "_share"))).over(whole)["_share"])
    limit = (F.lit(most) * F.col("source_size")).cast("double")
    target = F.when(F.col("_free"), F.least(limit, F.col("weight") * F.col("_level"))).otherwise(limit)
    return level.select("source", "number", "weight", "source_size", target.alias("target"))


def permute(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of ``j`` under a pseudorandom permutation of range(n): a keyed Feistel network on the
    next even power of two, applied again while the image lies outside."""
    half = max(1, -(-(max(n - 1, 1)).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            mixed = (right + np.uint64((key + turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(31)) & mask)
        return (left << np.uint64(half)) | right

    out = once(j.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def plan_slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``(shard, source_number, pass, block, words)``: the mix's slots, ``words`` of a block each.

    ``targets`` has one row for each source and is brought to the driver; draws and slots are made
    on executors, a shard at a time.
    """
    spark = targets.sparkSession
    quotas = []
    for r in sorted(targets.collect(), key=lambda r: r["number"]):
        owed, size = int(round(r["target"])), int(r["source_size"] or 0)
        blocks = -(-size // block_words)
        if owed and size:
            passes, rest = divmod(owed, size)
            quotas.append((r["number"], size, blocks, passes, rest, passes * blocks + -(-rest // block_words), owed))
    total = sum(q[5] for q in quotas)
    shards = -(-total // shard_slots)
    chances = np.array([q[5] for q in quotas], dtype=np.float64) / max(total, 1)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                slots = min(shard_slots, total - shard * shard_slots)
                counts = np.random.Generator(np.random.Philox(key=seed, counter=shard << 64)).multinomial(slots, chances)
                yield pd.DataFrame({"shard": shard, "q": np.arange(len(quotas)), "n": counts})

    drawn = stored(spark.range(0, shards, 1, max(1, min(parallelism(spark), shards))).mapInPandas(draw, "shard long, q int, n long"), "draws")
    got = {r["q"]: r["n"] for r in drawn.groupBy("q").agg(F.sum("n").alias("n")).collect()}
    # surplus draws, laid end to end over the sources that drew too many, are dealt to those owed
    surplus_at, owed_at, given, wanted = [], [], 0, 0
    for k, q in enumerate(quotas):
        n = int(got.get(k, 0))
        surplus_at.append(given)
        given += max(0, n - q[5])
        owed_at.append((wanted, k, min(n, q[5])))
        wanted += max(0, q[5] - n)
    starts = np.array([o[0] for o in owed_at] or [0])

    # numbering a source's draws over shards: one row for each shard and source, by running totals
    numbered = drawn.withColumns({"_at": F.shiftleft(F.col("shard"), 31) / F.lit(max(shards, 1)), "_shard": F.col("shard")})
    numbered = numbered.withColumn("_at", F.col("_at").cast("long"))
    numbered = running_totals(numbered, ["q"], "_at", ["shard"], {"first": "n"}, max(1, min(shards, 4 * parallelism(spark))))

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held = [], 0
        for frame in frames:
            for shard, q, n, first in frame[["shard", "q", "n", "first"]].itertuples(index=False):
                ordinals = np.arange(first, first + n)
                kept = ordinals < quotas[q][5]
                parts = [(q, ordinals[kept])] if kept.any() else []
                if not kept.all():
                    place = surplus_at[q] + ordinals[~kept] - quotas[q][5]
                    which = np.searchsorted(starts, place, side="right") - 1
                    for w in np.unique(which):
                        at, k, had = owed_at[w]
                        parts.append((k, had + place[which == w] - at))
                for k, number in parts:
                    made.append(slot_rows(shard, quotas[k], number))
                    held += len(number)
                if held >= BATCH_SLOTS:
                    yield pd.concat(made)
                    made, held = [], 0
        if made:
            yield pd.concat(made)

    def slot_rows(shard: int, quota: tuple[int, ...], number: np.ndarray) -> pd.DataFrame:
        source, size, blocks, passes, rest, _, _ = quota
        turn, j = np.divmod(number, blocks)
        whole = size // block_words  # blocks of full length; a shorter one is last in every pass
        block = j.copy()
        for t in np.unique(turn):
            mine = (turn == t) & (j < whole)
            block[mine] = permute(j[mine], whole, hash_key(seed, source, int(t))) if mine.any() else block[mine]
        words = np.where(block < whole, block_words, size - whole * block_words)
        last = turn == passes
        words = np.where(last, np.minimum(words, rest - j * block_words), words)
        return pd.DataFrame({"shard": shard, "source_number": source, "pass": turn, "block": block, "words": words})

    # a draw is a small row but makes many slots, so tasks are counted by slots
    tasks = max(1, min(shards, max(parallelism(spark), total // TASK_SLOTS)))
    return numbered.where("n > 0").repartition(tasks, "shard").mapInPandas(slots, "shard long, source_number int, pass int, block long, words long")


def hash_key(*parts: int) -> int:
    key = 0x243F6A8885A308D3
    for p in parts:
        key = ((key ^ (p + 1)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        key ^= key >> 32
    return key


def text_mark(text: Column) -> Column:
    """A hash of the text, which tells apart rows of one id."""
    return F.xxhash64(text).alias("mark")


def place_documents(documents: DataFrame, targets: DataFrame, seed: int = SEED, apart: Sequence[str] = ("doc_id", "size", "mark")) -> DataFrame:
    """Add ``source_number`` and ``first_word``, the place of a document in its source's stream.

    The place comes from the columns ``apart`` that there are, whatever the order of rows: give a mark of the text
    where ids may repeat, so that only rows that are equal throughout may change places.

    ``documents(doc_id, source, size, ...)`` is read several times; pass a stored table. A third
    of all rows may share one source: the stream is numbered by running totals over hash buckets.
    """
    keyed = documents.join(
        targets.select(F.col("source").alias("_source"), F.col("number").alias("source_number")), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    apart = [c for c in apart if c in documents.columns]
    keyed = keyed.withColumn("_at", hash_position(F.lit(seed), *map(F.col, apart)))
    spark = documents.sparkSession
    return running_totals(keyed, ["source_number"], "_at", apart, {"first_word": "size"}, 4 * parallelism(spark)).drop("_at")


def mix(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(row, lo, hi, shard, pass)``: the words [lo, hi) of a document that each slot takes.

    ``placed`` has a unique ``row`` beside ``source_number``, ``first_word`` and ``size``. Documents
    are cut where blocks end and joined to slots by source and block, so no key is hot.
    """
    first = F.expr(f"first_word div {block_words}")
    last = F.expr(f"(first_word + size - 1) div {block_words}")
    cut = placed.where("size > 0").select("row", "source_number", "first_word", "size", F.explode(F.sequence(first, last)).alias("block"))
    spans = cut.select(
        "row", "source_number", "block", "first_word",
        F.greatest(F.col("first_word"), F.col("block") * block_words).alias("lo"),
        F.least(F.col("first_word") + F.col("size"), (F.col("block") + 1) * block_words).alias("hi"),
    )
    # Spark would guess the slots' size from that of the few draws they come from, and broadcast them
    joined = spans.join(slots.hint("merge"), ["source_number", "block"]).withColumn("hi", F.least("hi", F.col("block") * block_words + F.col("words")))
    return joined.where("lo < hi").select(
        "row", (F.col("lo") - F.col("first_word")).alias("lo"), (F.col("hi") - F.col("first_word")).alias("hi"), "shard", "pass"
    )


def mixed_documents(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of ``documents``: a row for each pass that takes words of a document.

    A pass that takes the whole document keeps its text as it is; otherwise the text is the taken
    stretches, each as it stands in the source, joined by a line break. ``n_chars`` follows the text.
    """
    small_batches(documents.sparkSession)
    columns = documents.columns
    rows = stored(
        documents.select(
            F.struct(*columns).alias("document"), "doc_id", F.col("source").cast("string"), word_count(F.col("text")).alias("size"), text_mark(F.col("text"))
        )
        .withColumn("row", F.monotonically_increasing_id()),
        "mix-rows",
    )
    sized = rows.select("doc_id", "source", "size", "mark", "row")
    targets = stored(source_targets(sized), "targets")
    placed = stored(place_documents(sized, targets), "placed")
    spans = mix(placed, plan_slots(targets, block_words), block_words)
    # bounded by the blocks of one document and the passes over it
    by_row = spans.groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    taken = by_row.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pass", "spans"))).alias("passes"))
    joined = rows.select("row", "size", "document").join(taken, "row").select("size", "passes", F.col("document.text").alias("text"), "document")

    def cut(text: str, size: int, spans: list[dict[str, int]]) -> str:
        ranges: list[list[int]] = []
        for s in spans:
            if ranges and ranges[-1][1] == s["lo"]:
                ranges[-1][1] = s["hi"]
            else:
                ranges.append([s["lo"], s["hi"]])
        if ranges == [[0, size]]:
            return text
        at = [m.span() for m in _WORD.finditer(text)]
        return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in ranges)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, passes, texts = (batch.column(k).to_pylist() for k in range(3))
            made = [(k, cut(texts[k], sizes[k], p["spans"])) for k in range(len(texts)) for p in passes[k]]
            which = pa.array([k for k, _ in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(which), pa.array([t for _, t in made], pa.string())], names=["document", "cut"])

    kind = rows.schema["document"].dataType.simpleString()
    out = joined.mapInArrow(build, f"document {kind}, cut string")
    new = {"text": F.col("cut"), "n_chars": F.char_length("cut").cast("long")}
    return out.select(*[new.get(c, F.col(f"document.{c}")).alias(c) for c in columns])
