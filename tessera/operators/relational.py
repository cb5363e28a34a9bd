"""Share, rank, difference and budget operators used by every diagnostic report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import growth_status
from tessera.operators.merging import containments
from tessera.operators.prefix import ordered_scan, ordered_totals
from tessera.runtime import parallelism, stored, width


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the last row of each key: a partial aggregate, no sort."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")


def net_by_key(rows: DataFrame, key: str, came: Column, went: Column) -> DataFrame:
    """What came minus what went for each key, never below zero."""
    net = F.sum(F.coalesce(came, F.lit(0))) - F.sum(F.coalesce(went, F.lit(0)))
    return rows.groupBy(key).agg(F.greatest(net, F.lit(0)).alias("net"))


def share_of_total(grouped: DataFrame, value: str) -> DataFrame:
    """Add ``share``, the percentage of the whole.

    The whole is one row, joined to the groups, so the groups never meet in one task as they
    would in a window without partitions.
    """
    whole = grouped.agg(F.sum(value).alias("_whole"))
    return grouped.crossJoin(F.broadcast(whole)).withColumn("share", F.col(value) * 100.0 / F.col("_whole")).drop("_whole")


def top_shares(rows: DataFrame, keys: Sequence[str], value: Column, least: float, k: int, tie: Sequence[str]) -> DataFrame:
    """The k largest groups whose share is at least ``least`` percent; the share counts every row."""
    grouped = rows.groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return share_of_total(grouped, "total").where(F.col("share") >= least).orderBy(F.desc("total"), *tie).limit(k)


def compare_versions(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two ``(key, value)`` tables with a growth status; missing counts as zero."""
    old, new = before.select(key, F.col(value).alias("_old")), now.select(key, F.col(value).alias("_new"))
    return old.join(new, key, "full_outer").select(
        key,
        F.coalesce("_old", F.lit(0)).alias("before"),
        F.coalesce("_new", F.lit(0)).alias("now"),
        (F.coalesce("_new", F.lit(0)) - F.coalesce("_old", F.lit(0))).alias("delta"),
        growth_status(F.col("_old"), F.col("_new")).alias("status"),
    )


def ranked_where(rows: DataFrame, condition: Column, order: Sequence[Column | str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add a running number of the rows that meet the condition, in order; null for the others."""
    counted = rows.withColumn("_met", F.when(condition, 1).otherwise(0).cast("long"))
    ranked = ordered_totals(counted, by, order, {"_before": "_met"})
    return ranked.withColumn(name, F.when(F.col("_met") == 1, F.col("_before") + 1)).drop("_met", "_before")


def cumulative_share(grouped: DataFrame, value: str, order: Sequence[Column | str], upto: float) -> DataFrame:
    """The leading groups whose running share reaches ``upto``, the one that crosses it included."""
    running = ordered_totals(grouped, [], order, {"_before": value})
    whole = running.agg(F.sum(value).alias("_whole"))
    leading = running.crossJoin(F.broadcast(whole)).where(F.col("_before") < F.col("_whole") * upto)  # one row
    return leading.withColumn("running", F.col("_before") + F.col(value)).drop("_whole", "_before")


def first_per_group(rows: DataFrame, groups: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """At most n rows of each group, with their ``rank``; Spark cuts groups before it shuffles them."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sessions(rows: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    """Add ``session``: 0 before the first opening row of a group, then one more at each."""
    opened = ordered_scan(rows.withColumn("_open", F.when(opens, 1).otherwise(0)), by, order, {"_before": "_open"})
    return opened.withColumn("session", F.col("_before") + F.col("_open")).drop("_before", "_open")


def tail_before_last(rows: DataFrame, by: Sequence[str], order: Sequence[str], marked: Column, n: int) -> DataFrame:
    """The last n rows of each group that end with its last marked row; ``back`` counts from it, 1 first."""
    at = F.struct(*order)
    last = rows.where(marked).groupBy(*by).agg(F.max(at).alias("_last"))
    upto = rows.join(last, list(by)).where(at <= F.col("_last")).drop("_last")
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return upto.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def after_last(rows: DataFrame, by: Sequence[str], order: Sequence[str], banner: Column) -> DataFrame:
    """The rows of each group from its last banner on; all rows where there is none."""
    at = F.struct(*order)
    last = rows.where(banner).groupBy(*by).agg(F.max(at).alias("_last"))
    return rows.join(last, list(by), "left").where(F.col("_last").isNull() | (at >= F.col("_last"))).drop("_last")


def within_budget(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], text: str, budget: int) -> DataFrame:
    """Leading texts of each group up to a budget of characters, the last one cut to what is left."""
    spent = ordered_scan(rows.withColumn("_length", F.char_length(text)), by, order, {"_spent": "_length"})
    left = F.lit(budget) - F.col("_spent")
    return spent.where(left > 0).withColumn(text, F.substring(F.col(text), F.lit(1), left.cast("int"))).drop("_spent", "_length")


def in_range(points: DataFrame, at: Column, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points joined to the ranges [low, high) that hold them.

    Both sides are dealt by cells of ``width``, so this is an equi-join whatever the ranges' sizes.
    """
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return (
        points.withColumn("_at", at).withColumn("_cell", F.floor(F.col("_at") / width)).join(cells, "_cell")
        .where((F.col("_at") >= F.col(low)) & (F.col("_at") < F.col(high))).drop("_cell", "_at")
    )


def unpaired(acquired: DataFrame, released: DataFrame, keys: Sequence[str], after: tuple[str, str] | None = None) -> DataFrame:
    """Acquisitions without a release of the same key, and after them if ``after`` names both times.

    A later release exists exactly if the last one of the key is later, so a key has one row on that side.
    """
    own = [F.col(k).alias(f"_{k}") for k in keys]
    r = released.groupBy(*own).agg(F.max(after[1]).alias("_after")) if after else released.select(*own).distinct()
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if after:
        match.append(F.col("_after") > F.col(after[0]))
    return acquired.join(r, match, "left_anti")


def unpaired_loose(acquired: DataFrame, released: DataFrame, event: str, name: str) -> DataFrame:
    """Acquisitions without a release of the same event whose name equals theirs, contains it or is contained in it.

    Names that contain each other are found among the distinct names of an event by pieces of them
    (``merging.containments``), so no event's rows are compared with one another. Rows with a null event or name have no release.
    """
    sides = [f.select(F.col(event).cast("string").alias("part"), F.col(name).cast("string").alias("trace")).dropna().distinct() for f in (acquired, released)]
    names = stored(sides[0].unionByName(sides[1]).distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    gone = stored(sides[1].join(names, ["part", "trace"]).select("id"), "released")
    pairs = stored(containments(names), "pairs")
    over = pairs.join(gone.withColumnRenamed("id", "outer"), "outer").select(F.col("inner").alias("id"))
    under = pairs.join(gone.withColumnRenamed("id", "inner"), "inner").select(F.col("outer").alias("id"))
    matched = names.join(gone.unionByName(over).unionByName(under).distinct(), "id").select(F.col("part").alias("_event"), F.col("trace").alias("_name"))
    keys = (F.col(event).cast("string") == F.col("_event")) & (F.col(name).cast("string") == F.col("_name"))
    return acquired.join(matched.hint("merge"), keys, "left_anti")


def assign_ids(known: DataFrame, rows: DataFrame, key: str, number: str = "number") -> DataFrame:
    """The change set ``(key, number, change)`` of an index ``known(key, number)`` whose rows are now those of ``rows(key)``.

    Kept keys keep their number, added ones get the next free numbers in the order of the keys, and removed ones are
    named with theirs, which are not given again while they are the largest ever given. Nothing is written, so this is the dry run; the
    rows with ``change`` kept or added are the new index, and on them a second run changes nothing. Null keys are ignored, repeated ones count once.
    """
    old = known.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(number).cast("long").alias(number))
    now = rows.select(key).where(F.col(key).isNotNull()).distinct()
    both = old.join(now.withColumn("_now", F.lit(True)), key, "left")
    kept = both.select(key, number, F.when(F.col("_now"), "kept").otherwise("removed").alias("change"))
    added = ordered_scan(now.join(old, key, "left_anti").withColumn("_one", F.lit(1)), [], [key], {"_rank": "_one"})
    top = known.agg((F.coalesce(F.max(number), F.lit(-1)) + 1).cast("long").alias("_free"))  # one row
    numbered = added.crossJoin(F.broadcast(top)).select(key, (F.col("_free") + F.col("_rank")).alias(number), F.lit("added").alias("change"))
    return kept.unionByName(numbered)


def even_split(shared: DataFrame, item: str, owner: str, size: str) -> DataFrame:
    """Each item's size dealt evenly to its distinct owners, the rest of the division dropped, summed by owner.

    Rows are dealt by item and a cell of the owner to as many tasks as their number asks for, before anything is counted: nearly every
    pair is distinct, so counting where they are read would hold all rows of a task. What meets by item alone is a row a cell.
    """
    cell = F.pmod(F.xxhash64(owner), F.lit(parallelism(shared.sparkSession))).alias("_cell")
    rows = stored(shared.select(item, owner, size, cell), "shared")
    tasks = width(rows)
    owned = rows.repartition(tasks, item, "_cell").distinct()
    counts = owned.groupBy(item, "_cell").agg(F.max(size).alias("_size"), F.count(owner).alias("_n")).repartition(tasks, item)
    whole = Window.partitionBy(item)
    parts = counts.select(item, "_cell", F.max("_size").over(whole).alias("_size"), F.sum("_n").over(whole).alias("_n"))
    dealt = owned.where(F.col(owner).isNotNull()).select(item, "_cell", owner).join(parts.hint("merge"), [item, "_cell"])
    return dealt.groupBy(owner).agg(F.sum(F.expr("_size div _n")).alias("attributed"), F.count("*").alias("items"))


def joint_budget(rows: DataFrame, by: str, order: Sequence[str], size: str, most: int, budget: int) -> DataFrame:
    """Rows taken in order while count and size budgets last; a row that doesn't fit is skipped, not an end.

    The next row that fits what is left is a minimum over the rows behind the last one taken, so ``most`` rounds of partial
    minima take them, however many rows a group has. Null sizes don't fit. Rows equal in order and size are told apart by no one.
    """
    place = F.struct(*order, F.col(size).alias("_size"), "_row")
    kept = stored(rows.where(F.col(size).isNotNull()).select(by, *order, size).withColumn("_row", F.monotonically_increasing_id()), "offers")
    offers = kept.select(F.col(by).alias("_by"), place.alias("_place"))
    state = stored(offers.where(F.col("_place._size") <= budget).groupBy("_by").agg(F.min("_place").alias("_last")), "taken") if most > 0 else None
    taken = []
    left = F.lit(budget) - F.col("_last._size")
    while state is not None and not state.isEmpty():
        taken.append(state.select("_by", "_last"))
        if len(taken) == most:
            break
        held = state.select(F.col("_by").alias("_own"), "_last", (F.col("_left") if "_left" in state.columns else left).alias("_left"))
        fits = offers.join(held, F.col("_by").eqNullSafe(F.col("_own"))).where((F.col("_place") > F.col("_last")) & (F.col("_place._size") <= F.col("_left")))
        ahead = fits.groupBy("_by").agg(F.min("_place").alias("_last"), F.first("_left").alias("_left"))
        state = stored(ahead.withColumn("_left", F.col("_left") - F.col("_last._size")), "taken")
    if not taken:
        return rows.select(by, *order, size).where(F.lit(False))
    return reduce(DataFrame.unionByName, taken).select(F.col("_by").alias(by), *[F.col(f"_last.{c}").alias(c) for c in order], F.col("_last._size").alias(size))


def first_present(rows: DataFrame, names: Sequence[str], default: Column | None = None) -> Column:
    """The first value that is not null among those of the named columns that the table has."""
    there = [F.col(n) for n in names if n in rows.columns] + ([default] if default is not None else [])
    if not there:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return F.coalesce(*there)


def lookup_first(rows: DataFrame, keys: Sequence[str], value: str, tables: Sequence[DataFrame]) -> DataFrame:
    """Add ``value`` from the first of several tables ``(*keys, value)`` that knows the key; null if none does.

    The tables become one of a row a key before the one join, however many they are.
    """
    known = None
    for rank, t in enumerate(tables):
        part = t.select(*keys, F.col(value).alias("_value"), F.lit(rank).alias("_rank")).where(F.col("_value").isNotNull())
        known = part if known is None else known.unionByName(part)
    picked = known.groupBy(*keys).agg(F.min_by("_value", F.struct("_rank", "_value")).alias(value))
    return rows.join(picked, list(keys), "left")


def wildcard_join(left: DataFrame, right: DataFrame, exact: str, loose: str, wildcard: object) -> DataFrame:
    """Pairs equal in ``exact`` and either equal in ``loose`` or with the wildcard there on the right.

    Two equi-joins, disjoint by the right side, in place of one join on an OR. The right side's columns
    other than these two must have other names than the left's.
    """
    r = right.withColumnRenamed(loose, "_loose")
    named = left.join(r.where(F.col("_loose") != F.lit(wildcard)).withColumnRenamed("_loose", loose), [exact, loose])
    any_ = left.join(r.where(F.col("_loose") == F.lit(wildcard)).drop("_loose"), exact)
    return named.unionByName(any_.select(*named.columns))


def bucket_summary(rows: DataFrame, keys: Sequence[str], member: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows, distinct members and the values of the latest row of each bucket."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(member).alias("members"), last).select(*keys, "n", "members", "_last.*")


def attached(rows: DataFrame, key: str, more: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """``rows`` with the ordered list of what belongs to each, empty if nothing does."""
    item = F.struct(F.col(order), F.col(value).alias("_v"))
    lists = more.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_v"]).alias(name))
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
