"""Queries over the driver's tables, one or more for each family of operators, with DuckDB equivalents.

Money is summed in whole cents, so sums don't depend on their order.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import crashes as CR
from tessera.functions import media as V
from tessera.functions import predicates as P
from tessera.functions import scalars as S
from tessera.operators import containers as CN
from tessera.operators import graph as G
from tessera.operators import inverted as I
from tessera.operators import merging as MG
from tessera.operators import relational as R
from tessera.operators import retrieval as T
from tessera.operators import similarity as M
from tessera.runtime import shared_dir, stored, table, width
from tessera.sources import logs as LG
from tessera.sources import ranges as RG
from tessera.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


# --- traces: latest event, shares, signatures, lookups


@query(
    """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1"""
)
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query(
    """
    WITH g AS (SELECT l_partkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total, count(*) AS n FROM lineitem GROUP BY l_partkey),
    s AS (SELECT *, CAST(total AS DOUBLE) * 100.0 / CAST(sum(total) OVER () AS DOUBLE) AS share FROM g)
    SELECT l_partkey, CAST(total AS BIGINT) AS total, n, share FROM s WHERE share >= 0.001 ORDER BY total DESC, l_partkey LIMIT 5"""
)
def topk_share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_shares(table(spark, sf_dir, "lineitem"), ["l_partkey"], cents("l_extendedprice"), 0.001, 5, ["l_partkey"])


@query(
    """
    SELECT l_suppkey || '|' || l_returnflag || '|' || CAST(CAST(l_quantity AS BIGINT) & -8 AS VARCHAR) AS signature, count(*) AS n,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, min(l_orderkey * 10 + l_linenumber) AS first_row
    FROM lineitem GROUP BY 1"""
)
def stack_signature_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("long")
    key = F.concat_ws("|", "l_suppkey", "l_returnflag", S.masked(quantity, 3).cast("string"))
    rows = table(spark, sf_dir, "lineitem").withColumns({"signature": key, "q": quantity})
    return rows.groupBy("signature").agg(
        F.count("*").alias("n"), F.sum("q").alias("total"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_row")
    )


@query(
    """
    SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem
    WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'R') AND l_discount > l_tax AND l_quantity IS NOT NULL"""
)
def live_filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O' AND l_returnflag IN ('A', 'R') AND l_discount > l_tax AND l_quantity IS NOT NULL")
    return live.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), cents("l_extendedprice").alias("cents"))


@query(
    """
    SELECT l_suppkey, greatest(CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END)
      - sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT), 0) AS net FROM lineitem GROUP BY l_suppkey"""
)
def clamped_net_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("long")
    flag = F.col("l_returnflag")
    return R.net_by_key(table(spark, sf_dir, "lineitem"), "l_suppkey", F.when(flag == "N", quantity), F.when(flag == "R", quantity))


@query(
    """
    SELECT r.r_name, n.n_name, coalesce(s.s_name, '') AS s_name FROM region r
    LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey AND n.n_nationkey < 20
    LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000"""
)
def chain_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    joined = region.join(nation, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("n_nationkey") < 20), "left")
    joined = joined.join(supplier, (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("s_acctbal") > 5000), "left")
    return joined.select("r_name", "n_name", F.coalesce("s_name", F.lit("")).alias("s_name"))


@query(
    """
    SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (
      SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'MACHINERY' AND c_acctbal > 8000)"""
)
def semi_wanted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal > 8000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi")


@query(
    """
    WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
    SELECT w.word, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM w JOIN lineitem ON l_partkey = p_partkey GROUP BY w.word"""
)
def exploded_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return words.join(lines, F.col("l_partkey") == F.col("p_partkey")).groupBy("word").agg(F.sum("n").alias("lines"), F.sum("q").alias("quantity"))


@query(
    """
    SELECT c_custkey, CASE WHEN o.n IS NULL THEN 'no orders' WHEN l.n IS NULL THEN 'no lines' ELSE 'found' END AS reason,
      coalesce(o.n, 0) AS orders, coalesce(l.n, 0) AS lines FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      WHERE o_orderstatus = 'P' AND l_returnflag = 'R' GROUP BY 1) l ON l.o_custkey = c_custkey"""
)
def association_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    by_order = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o_n"))
    by_line = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("k").alias("l_n"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(by_order, "c_custkey", "left").join(by_line, "c_custkey", "left")
    reason = F.when(F.col("o_n").isNull(), "no orders").when(F.col("l_n").isNull(), "no lines").otherwise("found")
    return joined.select("c_custkey", reason.alias("reason"), F.coalesce("o_n", F.lit(0)).alias("orders"), F.coalesce("l_n", F.lit(0)).alias("lines"))


@query(
    """
    SELECT s_nationkey, array_to_string(list_sort(list(s_suppkey)), ',') AS suppliers, count(*) AS n FROM supplier GROUP BY s_nationkey"""
)
def inverse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_sort(F.collect_list("s_suppkey"))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat_ws(",", ids.cast("array<string>")).alias("suppliers"), F.count("*").alias("n"))


@query(
    """
    SELECT a.p_partkey AS seed, b.p_partkey AS same FROM part a JOIN part b
    ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.p_size <= 2"""
)
def same_name_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    seeds = part.where("p_size <= 2").select(F.col("p_partkey").alias("seed"), "p_name", "p_brand")
    return seeds.join(part.select("p_name", "p_brand", F.col("p_partkey").alias("same")), ["p_name", "p_brand"]).where("seed <> same").select("seed", "same")


# --- versions: differences, growth, roll-ups

_SLICES = """
    b AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1),
    c AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1),
    d AS (SELECT coalesce(b.l_partkey, c.l_partkey) AS l_partkey, coalesce(b.q, 0) AS before, coalesce(c.q, 0) AS now,
      coalesce(c.q, 0) - coalesce(b.q, 0) AS delta,
      CASE WHEN b.q IS NULL THEN 'new' WHEN c.q IS NULL THEN 'removed' WHEN c.q > b.q THEN 'increased'
        WHEN c.q < b.q THEN 'decreased' ELSE 'unchanged' END AS status
      FROM b FULL OUTER JOIN c ON b.l_partkey = c.l_partkey)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("q"), F.year("l_shipdate").alias("y"))
    slices = [lines.where(F.col("y") == y).groupBy("l_partkey").agg(F.sum("q").alias("q")) for y in (1997, 1998)]
    return R.compare_versions(*slices, "l_partkey", "q")


@query(f"WITH {_SLICES} SELECT * FROM d")
def version_diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


@query(
    f"""WITH {_SLICES}, r AS (SELECT l_partkey, delta, CASE WHEN delta > 0 THEN
      CAST(sum(CASE WHEN delta > 0 THEN 1 END) OVER (ORDER BY delta DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS growth_rank FROM d)
    SELECT * FROM r"""
)
def conditional_growth_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = _versions(spark, sf_dir).select("l_partkey", "delta")
    return R.ranked_where(grown, F.col("delta") > 0, [F.desc("delta"), "l_partkey"], "growth_rank")


@query(
    f"""WITH {_SLICES} SELECT l_partkey, status, delta, row_number() OVER (PARTITION BY status ORDER BY delta DESC, now DESC, l_partkey) AS status_rank
    FROM d WHERE status IN ('new', 'increased')"""
)
def rank_within_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two statuses hold all rows, so a window by status would be two tasks
    rows = _versions(spark, sf_dir).where(F.col("status").isin("new", "increased"))
    ranked = R.ranked_where(rows, F.lit(True), [F.desc("delta"), F.desc("now"), "l_partkey"], "status_rank", ["status"])
    return ranked.select("l_partkey", "status", "delta", "status_rank")


@query(
    f"""WITH {_SLICES}, n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT d.l_partkey, round(delta * (1 + ln(greatest(1, n.n))), 4) AS score FROM d JOIN n ON d.l_partkey = n.l_partkey
    WHERE delta > 0 ORDER BY delta DESC, n.n DESC, d.l_partkey LIMIT 50"""
)
def occurrence_weighted_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    grown = _versions(spark, sf_dir).where("delta > 0").join(seen, "l_partkey").orderBy(F.desc("delta"), F.desc("n"), "l_partkey").limit(50)
    return grown.select("l_partkey", F.round(F.col("delta") * S.occurrence_weight(F.col("n")), 4).alias("score"))


@query(
    """
    WITH s AS (SELECT l_suppkey, month(l_shipdate) AS snap, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem
      WHERE year(l_shipdate) = 1997 GROUP BY 1, 2)
    SELECT l_suppkey, count(*) AS present, CAST(sum(q) AS BIGINT) AS total, max(q) AS largest,
      CAST(sum(q) AS DOUBLE) / (SELECT count(DISTINCT snap) FROM s) AS avg_all, CAST(sum(q) AS DOUBLE) / count(*) AS avg_present
    FROM s GROUP BY l_suppkey"""
)
def rollup_two_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == 1997)
    snaps = lines.groupBy("l_suppkey", F.month("l_shipdate").alias("snap")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    whole = snaps.agg(F.countDistinct("snap").alias("snaps"))
    grouped = snaps.groupBy("l_suppkey").agg(F.count("*").alias("present"), F.sum("q").alias("total"), F.max("q").alias("largest"))
    averages = {"avg_all": F.col("total") / F.col("snaps"), "avg_present": F.col("total") / F.col("present")}
    return grouped.crossJoin(F.broadcast(whole)).withColumns(averages).drop("snaps")


@query(
    """
    SELECT o_custkey, y, o_orderkey, cents FROM (
      SELECT o_custkey, year(o_orderdate) AS y, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
        row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1"""
)
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").cast("long").alias("y"), "o_orderkey", cents("o_totalprice").alias("cents"), (-F.col("o_orderkey")).alias("tie"), "o_totalprice"
    )
    return R.latest_by(rows, ["o_custkey", "y"], ["o_totalprice", "tie"], ["o_orderkey", "cents"])


@query(
    """
    SELECT year(o_orderdate) AS version, count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total,
      CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS largest, min(o_orderkey) AS first_order FROM orders GROUP BY 1"""
)
def version_side_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("version"), "o_custkey", "o_orderkey", cents("o_totalprice").alias("c"))
    return rows.groupBy("version").agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.sum("c").alias("total"), F.max("c").alias("largest"),
        F.min("o_orderkey").alias("first_order"),
    )


@query(
    """
    SELECT o_custkey, count(DISTINCT o_orderpriority) AS chains, array_to_string(list_sort(list(DISTINCT year(o_orderdate))), ',') AS versions
    FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2"""
)
def distinct_chain_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.countDistinct("o_orderpriority").alias("chains"), F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("v")
    )
    return grouped.where("chains >= 2").select("o_custkey", "chains", F.concat_ws(",", F.col("v").cast("array<string>")).alias("versions"))


@query(
    """
    WITH s AS (SELECT l_partkey % 50 AS alias, l_partkey, month(l_shipdate) AS snap, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, min(l_linenumber) AS rank_
      FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1, 2, 3)
    SELECT snap, alias, CAST(sum(q) AS BIGINT) AS total, CAST(min(rank_) AS BIGINT) AS best_rank, count(DISTINCT l_partkey) AS variants,
      arg_max(l_partkey, q * 100000 - l_partkey) AS representative FROM s GROUP BY 1, 2"""
)
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == 1998)
    snaps = lines.groupBy("l_partkey", F.month("l_shipdate").cast("long").alias("snap")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"), F.min("l_linenumber").cast("long").alias("r")
    )
    return snaps.groupBy("snap", (F.col("l_partkey") % 50).alias("alias")).agg(
        F.sum("q").alias("total"), F.min("r").alias("best_rank"), F.countDistinct("l_partkey").alias("variants"),
        F.max_by("l_partkey", F.col("q") * 100000 - F.col("l_partkey")).alias("representative"),
    )


# --- shares, caps and attribution


@query(
    """
    WITH g AS (SELECT p_brand, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS total FROM part GROUP BY 1),
    r AS (SELECT *, CAST(sum(total) OVER (ORDER BY total DESC, p_brand ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, sum(total) OVER () AS whole FROM g)
    SELECT p_brand, total, running FROM r WHERE running - total < whole * 0.5"""
)
def cumulative_half_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(cents("p_retailprice")).alias("total"))
    return R.cumulative_share(grouped, "total", [F.desc("total"), "p_brand"], 0.5)


@query(
    """
    SELECT p_type, p_partkey, CAST(rn AS INTEGER) AS rank FROM (
      SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 2"""
)
def per_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_group(table(spark, sf_dir, "part"), ["p_type"], [F.desc("p_retailprice"), "p_partkey"], 2).select("p_type", "p_partkey", "rank")


@query(
    """
    WITH g AS (SELECT CASE WHEN regexp_matches(event_type, '^(click|view)$') THEN 'browse' WHEN regexp_matches(event_type, 'purch') THEN 'buy'
      WHEN regexp_matches(event_type, 'err') THEN 'fault' ELSE 'other' END AS bucket, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1)
    SELECT bucket, total, n, CAST(total AS DOUBLE) * 100.0 / CAST(sum(total) OVER () AS DOUBLE) AS share FROM g"""
)
def regex_bucket_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    bucket = F.when(kind.rlike("^(click|view)$"), "browse").when(kind.rlike("purch"), "buy").when(kind.rlike("err"), "fault").otherwise("other")
    grouped = table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.sum(cents("value")).alias("total"), F.count("*").alias("n"))
    return R.share_of_total(grouped, "total")


@query(
    """
    WITH g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), s AS (SELECT p_brand, n, CAST(n AS DOUBLE) / sum(n) OVER () AS rate, count(*) OVER () AS kinds FROM g)
    SELECT p_brand, n FROM s WHERE rate * 2 * kinds > 2.2"""
)
def dominant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    whole = grouped.agg(F.sum("n").alias("whole"), F.count("*").alias("kinds"))
    rate = F.col("n") / F.col("whole")
    return grouped.crossJoin(F.broadcast(whole)).where(rate * 2 * F.col("kinds") > 2.2).select("p_brand", "n")


@query(
    """
    WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    n AS (SELECT l_orderkey, count(*) AS n FROM o GROUP BY 1)
    SELECT l_suppkey, CAST(sum(size // n) AS BIGINT) AS attributed, count(*) AS items FROM o JOIN n ON n.l_orderkey = o.l_orderkey GROUP BY l_suppkey"""
)
def even_split_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), cents("o_totalprice").alias("size"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    # orders that are broadcast, or sorted in few tasks, would take memory that grows with them
    tasks = width(lines)
    shared = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "l_orderkey").hint("merge"), "l_orderkey")
    return R.even_split(shared, "l_orderkey", "l_suppkey", "size")


@query(
    """
    WITH a AS (SELECT p_size, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE year(l_shipdate) = 1996 AND l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1),
    z AS (SELECT p_size, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE year(l_shipdate) = 2000 AND l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1)
    SELECT z.p_size, z.n - coalesce(a.n, 0) AS growth FROM z LEFT JOIN a ON a.p_size = z.p_size"""
)
def size_class_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").join(part, "l_partkey")
    first, last = (lines.where(F.year("l_shipdate") == y).groupBy("p_size").agg(F.count("*").alias(n)) for y, n in ((1996, "a"), (2000, "z")))
    return last.join(first, "p_size", "left").select("p_size", (F.col("z") - F.coalesce("a", F.lit(0))).alias("growth"))


@query(
    """
    WITH g AS (SELECT l_returnflag, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, CAST(sum(q) AS BIGINT) AS total, arg_max(l_suppkey, q * 1000000 - l_suppkey) AS top_channel FROM g GROUP BY 1"""
)
def top_channel_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    top = F.max_by("l_suppkey", F.col("q") * 1000000 - F.col("l_suppkey")).alias("top_channel")
    return grouped.groupBy("l_returnflag").agg(F.sum("q").alias("total"), top)


@query(
    """
    WITH v AS (SELECT user_id, CASE WHEN event_type = 'error' AND value > 20 THEN 'Critical' WHEN event_type = 'error' THEN 'Major' ELSE 'Minor' END AS s FROM events)
    SELECT user_id, count(*) FILTER (s = 'Critical') AS critical, count(*) FILTER (s = 'Major') AS major, count(*) FILTER (s = 'Minor') AS minor,
      CASE min(CASE s WHEN 'Critical' THEN 0 WHEN 'Major' THEN 1 ELSE 2 END) WHEN 0 THEN 'Critical' WHEN 1 THEN 'Major' ELSE 'Minor' END AS worst FROM v GROUP BY 1"""
)
def severity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["Critical", "Major", "Minor"]
    error = F.col("event_type") == "error"
    rated = table(spark, sf_dir, "events").select("user_id", F.when(error & (F.col("value") > 20), 0).when(error, 1).otherwise(2).alias("s"))
    counts = [F.count(F.when(F.col("s") == k, 1)).alias(n.lower()) for k, n in enumerate(order)]
    return rated.groupBy("user_id").agg(*counts, F.get(F.array(*map(F.lit, order)), F.min("s")).alias("worst"))


# --- line-oriented operators


@query(
    """
    SELECT user_id, event_id, CAST(coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 END)
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS session FROM events"""
)
def marker_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return R.sessions(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("user_id", "event_id", "session")


@query(
    """
    WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY 1),
    b AS (SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id DESC) AS back FROM events e JOIN l ON l.user_id = e.user_id AND e.event_id <= l.last)
    SELECT user_id, event_id, CAST(back AS INTEGER) AS back FROM b WHERE back <= 15"""
)
def tail_before_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return R.tail_before_last(rows, ["user_id"], ["event_id"], F.col("event_type") == "error", 15).select("user_id", "event_id", "back")


@query(
    """
    WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'signup' AND value > 40 GROUP BY 1)
    SELECT e.user_id, e.event_id FROM events e LEFT JOIN l ON l.user_id = e.user_id WHERE l.last IS NULL OR e.event_id >= l.last"""
)
def last_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return R.after_last(rows, ["user_id"], ["event_id"], (F.col("event_type") == "signup") & (F.col("value") > 40)).select("user_id", "event_id")


@query(
    """
    WITH s AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM conversations)
    SELECT conv_id, turn, substr(text, 1, CAST(600 - spent AS BIGINT)) AS text FROM s WHERE spent < 600"""
)
def budgeted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return R.within_budget(rows, ["conv_id"], ["turn"], "text", 600)


@query(
    """
    SELECT conv_id, turn, array_to_string(string_split(text, chr(10))[1:3], ' | ') AS frames, len(string_split(text, chr(10))) - least(3, len(string_split(text, chr(10)))) AS omitted FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 20"""
)
def bounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.first_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 20)
    lines = F.split("text", "\n")
    frames = F.array_join(F.slice(lines, 1, 3), " | ").alias("frames")
    return rows.select("conv_id", "turn", frames, (F.size(lines) - F.least(F.lit(3), F.size(lines))).cast("long").alias("omitted"))


@query(
    """
    WITH r AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand, p_type) AS rank FROM r)
    SELECT p_brand, p_type, rank, CASE WHEN rank > 26 THEN chr(CAST(64 + (rank - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (rank - 1) % 26 AS INTEGER)) AS label,
      (rank - 1) % 10 AS colour FROM k WHERE rank <= 100"""
)
def family_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    top = grouped.orderBy(F.desc("n"), "p_brand", "p_type").limit(100)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand", "p_type")).cast("long"))
    return ranked.select("p_brand", "p_type", "rank", S.column_label(F.col("rank")).alias("label"), ((F.col("rank") - 1) % 10).alias("colour"))


@query(
    """
    WITH r AS (SELECT n_nationkey, n_nationkey * 400 AS low, n_nationkey * 400 + 300 AS high FROM nation)
    SELECT c_custkey, n_nationkey AS region_no FROM customer JOIN r ON CAST(floor(c_acctbal) AS BIGINT) >= low AND CAST(floor(c_acctbal) AS BIGINT) < high"""
)
def range_bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    ranges = table(spark, sf_dir, "nation").select(key.alias("region_no"), (key * 400).alias("low"), (key * 400 + 300).alias("high"))
    points = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return R.in_range(points, F.floor("c_acctbal"), ranges, "low", "high", 500).select("c_custkey", F.col("region_no").cast("int").alias("region_no"))


@query(
    """
    SELECT user_id, event_id FROM events a WHERE event_type = 'signup' AND NOT EXISTS (
      SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts > a.ts)"""
)
def unpaired_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    # a release after an acquisition exists exactly if the last release is after it, so one row a key is enough
    last = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("released"))
    return R.unpaired(events.where("event_type = 'signup'"), last, ["user_id"], ("ts", "released")).select("user_id", "event_id")


@query(
    """
    WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
    s AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS k, 0 AS n, CAST(0 AS BIGINT) AS total, false AS hit FROM r
      UNION ALL SELECT r.conv_id, r.turn, r.size, r.k, n + CAST(n < 4 AND total + r.size <= 1500 AS INTEGER),
        total + CASE WHEN n < 4 AND total + r.size <= 1500 THEN r.size ELSE 0 END, n < 4 AND total + r.size <= 1500
      FROM s JOIN r ON r.conv_id = s.conv_id AND r.k = s.k + 1)
    SELECT conv_id, turn, size FROM s WHERE hit"""
)
def joint_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("size"))
    return R.joint_budget(rows, "conv_id", ["turn"], "size", 4, 1500)


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def recency_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    now = events.agg(F.max("ts").alias("_now"))
    return E.recent(events.crossJoin(F.broadcast(now)), "ts", F.col("_now"), "30 MINUTES").select("event_id", "user_id")


@query(
    """
    SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"""
)
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = E.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 day", "10 minutes")
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# --- sets


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def key_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    fulfilled = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(fulfilled, "c_custkey", "left_anti")


@query(
    """
    SELECT kind, count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT 'customer' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1"""
)
def union_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [
        table(spark, sf_dir, n).select(F.lit(n).alias("kind"), F.col(c).alias("k")) for n, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))
    ]
    return sides[0].unionByName(sides[1]).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"))


@query(
    """
    SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount = 0.1"""
)
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_quantity > 49").select("l_partkey", "l_suppkey").unionByName(lines.where("l_discount = 0.1D").select("l_partkey", "l_suppkey")).distinct()


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


# --- graphs over (part -> supplier modulo) and nation chains

_NATION_EDGES = "e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation)"


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    return n.select("src", ((F.col("src") * 7 + 3) % 25).alias("dst")).unionByName(n.select("src", ((F.col("src") * 3 + 1) % 25).alias("dst"))).distinct()


@query(
    f"""WITH RECURSIVE {_NATION_EDGES}, r AS (SELECT 0 AS anchor, 0 AS node, 0 AS depth UNION ALL SELECT anchor, dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 3)
    SELECT anchor, node, min(depth) AS depth FROM r GROUP BY 1, 2"""
)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = spark.range(1).select(F.col("id").cast("int").alias("anchor"))
    return G.reachable(_nation_edges(spark, sf_dir), "src", "dst", anchor, 3)


@query(
    f"""WITH RECURSIVE {_NATION_EDGES}, r AS (SELECT 0 AS node, 0 AS distance UNION ALL SELECT dst, distance + 1 FROM r JOIN e ON e.src = r.node WHERE distance < 6)
    SELECT node, min(distance) AS distance FROM r GROUP BY 1"""
)
def shortest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.range(1).select(F.col("id").cast("int").alias("node"))
    return G.shortest_paths(_nation_edges(spark, sf_dir), "src", "dst", source, 6).select("node", "distance")


@query(
    f"""WITH RECURSIVE {_NATION_EDGES}, w AS (SELECT src AS head, dst AS cur, [src] AS path FROM e WHERE dst >= src
      UNION ALL SELECT head, e.dst, list_append(path, cur) FROM w JOIN e ON e.src = w.cur WHERE cur > head AND NOT list_contains(path, cur) AND len(path) < 4)
    SELECT DISTINCT array_to_string(list_sort(path), ',') AS members, len(path) AS length FROM w WHERE cur = head"""
)
def cycle_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.cycles(_nation_edges(spark, sf_dir), "src", "dst", 4)
    return found.select(F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("members"), F.size("nodes").cast("long").alias("length")).distinct()


@query(
    """
    WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS u, l_suppkey + 100000000000 AS v FROM lineitem),
    b AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    r(node, c) USING KEY (node) AS (SELECT u, least(u, min(v)) FROM b GROUP BY u
      UNION SELECT b.v, min(r.c) FROM r JOIN b ON b.u = r.node JOIN recurring.r AS known ON known.node = b.v WHERE r.c < known.c GROUP BY b.v)
    SELECT node, c AS component FROM r"""
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return G.connected_components(lines.select("l_partkey", (F.col("l_suppkey") + 100000000000).alias("s")), "l_partkey", "s")


@query(
    """
    WITH e AS (
      SELECT 0 AS src, c_custkey * 4 + 1 AS dst, 1 AS layer FROM customer
      UNION SELECT o_custkey * 4 + 1, o_orderkey * 4 + 2, 2 FROM orders
      UNION SELECT l_orderkey * 4 + 2, l_partkey * 4 + 3, 3 FROM lineitem
      UNION SELECT l_partkey * 4 + 3, (l_suppkey + 1) * 4, 4 FROM lineitem),
    d1 AS (SELECT DISTINCT dst AS node, 0 AS d FROM e WHERE layer = 1),
    r2 AS (SELECT e.* FROM e WHERE layer = 2 AND src IN (SELECT node FROM d1)),
    d2 AS (SELECT dst AS node, d FROM r2 JOIN (SELECT node, d FROM d1 UNION SELECT node, node FROM d1) x ON node = src GROUP BY dst, d
      HAVING count(*) = (SELECT count(*) FROM r2 y WHERE y.dst = r2.dst)),
    r3 AS (SELECT e.* FROM e WHERE layer = 3 AND src IN (SELECT node FROM d2)),
    d3 AS (SELECT dst AS node, d FROM r3 JOIN (SELECT node, d FROM d2 UNION SELECT node, node FROM d2) x ON node = src GROUP BY dst, d
      HAVING count(*) = (SELECT count(*) FROM r3 y WHERE y.dst = r3.dst)),
    r4 AS (SELECT e.* FROM e WHERE layer = 4 AND src IN (SELECT node FROM d3)),
    d4 AS (SELECT dst AS node, d FROM r4 JOIN (SELECT node, d FROM d3 UNION SELECT node, node FROM d3) x ON node = src GROUP BY dst, d
      HAVING count(*) = (SELECT count(*) FROM r4 y WHERE y.dst = r4.dst)),
    d AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4),
    k AS (SELECT node, count(*) AS depth FROM d GROUP BY node)
    SELECT 1 AS graph, d.node, arg_max(d.d, coalesce(k.depth, 0)) AS parent FROM d LEFT JOIN k ON k.node = d.d GROUP BY d.node"""
)
def dominator_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, orders, parts and suppliers, held by one root through one another; solved by joins."""
    customers, orders, lines = (table(spark, sf_dir, name) for name in ("customer", "orders", "lineitem"))
    customer, order, part = F.col("o_custkey") * 4 + 1, F.col("l_orderkey") * 4 + 2, F.col("l_partkey") * 4 + 3
    steps = [
        customers.select(F.lit(0).cast("long").alias("src"), (F.col("c_custkey") * 4 + 1).alias("dst")),
        orders.select(customer.alias("src"), (F.col("o_orderkey") * 4 + 2).alias("dst")),
        lines.select(order.alias("src"), part.alias("dst")),
        lines.select(part.alias("src"), ((F.col("l_suppkey") + 1) * 4).alias("dst")),
    ]
    edges = reduce(DataFrame.unionByName, steps).withColumn("graph", F.lit(1))
    return G.dominators(edges, "graph", "src", "dst", F.lit(0), fold_edges=0)


@query(
    """
    WITH RECURSIVE n AS (SELECT p_partkey AS node, p_brand AS name, CAST(p_size AS BIGINT) AS size FROM part),
    a AS (SELECT node, name, node // 3 AS up FROM n WHERE node > 0 UNION ALL SELECT node, name, up // 3 FROM a WHERE up > 0),
    covered AS (SELECT DISTINCT a.node FROM a JOIN n ON n.node = a.up AND n.name = a.name)
    SELECT 1 AS graph, name, count(*) AS n, CAST(sum(CASE WHEN covered.node IS NULL THEN size ELSE 0 END) AS BIGINT) AS retained
    FROM n LEFT JOIN covered USING (node) GROUP BY name"""
)
def topmost_class_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, under the one whose key is a third of its own."""
    part = table(spark, sf_dir, "part").withColumn("graph", F.lit(1))
    edges = part.where("p_partkey > 0").select("graph", F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    nodes = part.select("graph", F.col("p_partkey").alias("node"), F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("size"))
    return G.topmost_sums(edges, nodes)


# --- similarity of chains: the roles of conversations, and token lists

_CHAINS = "SELECT conv_id, list(role ORDER BY turn) AS chain FROM conversations GROUP BY conv_id"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("chain"))


@query(
    f"""WITH c AS ({_CHAINS}), d AS (SELECT chain, min(conv_id) AS id FROM c GROUP BY 1)
    SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM d a JOIN d b ON a.id <> b.id
    WHERE contains(array_to_string(b.chain, ',') || ',', array_to_string(a.chain, ',') || ',')"""
)
def contiguous_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.similar_pairs(_chains(spark, sf_dir).withColumn("one", F.lit(1)), "conv_id", ["one"], "chain", "run")


@query(
    f"""WITH c AS ({_CHAINS}), d AS (SELECT chain, min(conv_id) AS id, list_transform(chain, lambda x: x[1:1]) AS letters FROM c GROUP BY 1)
    SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM d a JOIN d b ON a.id <> b.id
    WHERE regexp_matches(array_to_string(b.letters, ''), array_to_string(a.letters, '.*'))"""
)
def ordered_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.similar_pairs(_chains(spark, sf_dir).withColumn("one", F.lit(1)), "conv_id", ["one"], "chain", "order")


_CANDIDATES = """l AS (SELECT l_orderkey, string_agg(l_linestatus, ' <- ' ORDER BY l_linenumber, l_linestatus) AS trace FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, trace, count(*) AS n, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS size
      FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line states of all orders as traces, counted for each priority and status."""
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus")))
    traces = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(line, lambda x: x["l_linestatus"]), " <- ").alias("trace"))
    orders = table(spark, sf_dir, "orders").join(traces, F.col("o_orderkey") == F.col("l_orderkey"))
    kinds = [F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "trace"]
    return orders.groupBy(*kinds).agg(F.count("*").alias("n"), F.max(cents("o_totalprice")).alias("size"))


@query(
    f"""WITH {_CANDIDATES},
    g AS (SELECT priority, trace, CAST(sum(n) AS BIGINT) AS n, max(size) AS size FROM c GROUP BY 1, 2),
    top AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY priority ORDER BY size DESC, trace) <= 20),
    lists AS (SELECT priority, list({{'t': trace, 'n': n, 's': size, 'kept': CAST([] AS STRUCT(t VARCHAR, n BIGINT, s BIGINT)[])}} ORDER BY size DESC, trace) AS rows FROM top GROUP BY 1),
    folded AS (
      SELECT priority, unnest(list_reduce(list_prepend({{'t': '', 'n': 0, 's': 0, 'kept': CAST([] AS STRUCT(t VARCHAR, n BIGINT, s BIGINT)[])}}, rows), lambda a, x:
        {{'t': '', 'n': 0, 's': 0, 'kept': CASE
          WHEN list_position(list_transform(a.kept, lambda k: contains(k.t, x.t) OR contains(x.t, k.t)), true) > 0 THEN
            list_transform(a.kept, lambda k, i: CASE
              WHEN i = list_position(list_transform(a.kept, lambda m: contains(m.t, x.t) OR contains(x.t, m.t)), true)
              THEN {{'t': k.t, 'n': k.n + x.n, 's': greatest(k.s, x.s)}} ELSE k END)
          ELSE list_append(a.kept, {{'t': x.t, 'n': x.n, 's': x.s}}) END}}).kept) AS k FROM lists)
    SELECT priority, k.t AS trace, k.n AS n, k.s AS size FROM folded"""
)
def merged_similar_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each priority the twenty candidates of most size, folded in order; the first of a fold lends its trace."""
    rows = _candidates(spark, sf_dir).groupBy("priority", "trace").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    return M.merge_similar(rows.withColumn("down", -F.col("size")), "priority", ["down", "trace"], "trace", "n", "size")


@query(
    f"""WITH RECURSIVE {_CANDIDATES},
    s AS (SELECT *, row_number() OVER (ORDER BY size DESC, len(string_split(trace, ' <- ')) DESC, trace, priority, status) AS i FROM c),
    a AS (SELECT list({{'t': trace, 'n': n, 's': size, 'm': CAST(0 AS BIGINT), 'p': [priority], 'q': [status], 'i': i, 'rest': CAST([] AS BIGINT[])}} ORDER BY i) AS rows FROM s),
    r AS (
      SELECT rows, CAST(range(1, len(rows) + 1) AS BIGINT[]) AS rest, rows[1] AS parent, false AS done FROM a
      UNION ALL
      SELECT rows, new.rest, new, true FROM (
        SELECT rows, list_reduce(list_select(rows, rest), lambda x, y: CASE WHEN contains(x.t, y.t) OR contains(y.t, x.t)
          THEN {{'t': CASE WHEN len(y.t) > len(x.t) THEN y.t ELSE x.t END, 'n': x.n + y.n, 's': x.s, 'm': x.m + 1, 'p': list_concat(x.p, y.p), 'q': list_concat(x.q, y.q), 'i': x.i, 'rest': x.rest}}
          ELSE {{'t': x.t, 'n': x.n, 's': x.s, 'm': x.m, 'p': x.p, 'q': x.q, 'i': x.i, 'rest': list_append(x.rest, y.i)}} END) AS new
        FROM r WHERE len(rest) > 0))
    SELECT parent.t AS trace, CAST(parent.n AS BIGINT) AS n, parent.s AS size, parent.m AS merged,
      list_sort(list_distinct(parent.p)) AS priority, list_sort(list_distinct(parent.q)) AS status FROM r WHERE done"""
)
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates merged, without a cut: each keeps the longest trace and the names of what it took."""
    return MG.merge_all(_candidates(spark, sf_dir), [], "trace", "n", "size", ["priority", "status"])


# --- retrieval

_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@query(
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_]*')) AS token FROM documents)
    SELECT token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t WHERE token NOT IN ({_STOP}) GROUP BY token"""
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.token_counts(table(spark, sf_dir, "documents"))


@query(
    """
    WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark),
    words AS (
      SELECT DISTINCT item_id, unnest(w) AS word, 1 AS weight FROM t
      UNION SELECT item_id, w[1] || ' ' || w[2], 5 FROM t WHERE len(w) > 1
      UNION SELECT item_id, 'src' || (item_id % 8), 2 FROM t),
    d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), ' ') || ' ' AS body, lower(coalesce(source, '')) AS title FROM documents),
    s AS (
      SELECT item_id, doc_id, sum(weight * (CASE WHEN contains(body, ' ' || word || ' ') THEN 1 ELSE 0 END + CASE WHEN title = word THEN 8 ELSE 0 END)) AS score
      FROM words, d GROUP BY 1, 2)
    SELECT item_id, doc_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 3"""
)
def indexed_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents for each benchmark item's words, first two words in a row, and source, by an inverted index."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    I.write_index(documents, "doc_id", {"body": F.col("text"), "title": F.col("source")}, path)
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    split = items.select("item_id", tokens.alias("w"))
    first = F.when(F.size("w") > 1, F.array(F.struct(F.concat_ws(" ", F.get("w", 0), F.get("w", 1)).alias("word"), F.lit(5).alias("weight")))).otherwise(F.array())
    source = F.array(F.struct(F.concat(F.lit("src"), (F.col("item_id") % 8).cast("string")).alias("word"), F.lit(2).alias("weight")))
    each = F.concat(F.transform("w", lambda w: F.struct(w.alias("word"), F.lit(1).alias("weight"))), first, source)
    words = stored(split.select(F.col("item_id").alias("query"), F.inline(each)).distinct(), "words")
    scored = I.indexed_relevance(I.asked_postings(spark, path, words), words, {"body": 1, "title": 3}, {"title": 5})
    best = R.first_per_group(scored.where("score > 0"), ["query"], [F.desc("score"), "key"], 3)
    return best.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score")


_WORDS = {"ring": 5, "bolt": 3, "red": 2, "blue": 2, "small": 1}
_SCORE = " + ".join(
    f"CASE WHEN regexp_matches(' ' || lower(p_name) || ' ', '[^a-z0-9_]{w}[^a-z0-9_]') THEN {n} ELSE 0 END"
    f" + CASE WHEN regexp_matches(' ' || lower(p_type) || ' ', '[^a-z0-9_]{w}[^a-z0-9_]') THEN {3 * n} ELSE 0 END"
    f" + CASE WHEN lower(p_type) = '{w}' THEN {5 * n} ELSE 0 END"
    for w, n in _WORDS.items()
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("score", T.relevance(F.col("p_type"), F.col("p_name"), _WORDS))


@query(f"WITH s AS (SELECT p_partkey, {_SCORE} AS score FROM part) SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 200")
def additive_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(200).select("p_partkey", "score")


@query(
    f"""WITH s AS (SELECT p_partkey, {_SCORE} AS score FROM part), m AS (SELECT max(score) AS top FROM s)
    SELECT p_partkey, score FROM s, m WHERE score >= greatest(top - 3, CAST(floor(top * 0.72) AS BIGINT))"""
)
def relative_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.relative_cutoff(_scored(spark, sf_dir).select("p_partkey", "score"), "score", 3, 0.72)


@query(
    f"""WITH s AS (SELECT p_partkey, p_brand, {_SCORE} AS score FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS n FROM s)
    SELECT p_partkey, p_brand, score FROM r WHERE n <= 2 ORDER BY score DESC, p_partkey LIMIT 12"""
)
def diverse_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.diverse_top(_scored(spark, sf_dir).select("p_partkey", "p_brand", "score"), "p_brand", [F.desc("score"), "p_partkey"], 2, 12)


@query(
    f"""WITH s AS (SELECT p_partkey, p_brand, p_type, {_SCORE} AS score FROM part)
    SELECT p_brand, arg_max(p_partkey, score * 1000000 - p_partkey) AS "primary", count(*) - 1 AS support, max(score) + 2 * (count(DISTINCT p_type) - 1) AS group_score FROM s WHERE score > 0 GROUP BY 1"""
)
def topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.topic_groups(_scored(spark, sf_dir).where("score > 0"), "p_brand", "score", "p_partkey", "p_type", 2)


@query(
    r"""
    WITH d AS (SELECT page_id, regexp_extract_all(replace(replace(html, '<p>', '```' || chr(10)), '</p>', '```'), '(?s)```\w*\n(.*?)```', 1) AS b FROM pages)
    SELECT page_id, len(b) AS blocks, coalesce(b[1], '') AS first FROM d"""
)
def code_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of pages, written as fenced blocks."""
    fenced = F.replace(F.replace("html", F.lit("<p>"), F.lit("```\n")), F.lit("</p>"), F.lit("```"))
    found = T.code_blocks(fenced)
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("blocks"), F.coalesce(F.get(found, 0), F.lit("")).alias("first"))


# --- scalar functions


@query(
    """
    SELECT o_orderkey, '0x' || lower(printf('%X', o_orderkey)) AS hex, CAST(floor(o_totalprice) AS BIGINT) & -256 AS masked,
      CASE WHEN o_totalprice < 1024 THEN 'B' WHEN o_totalprice < 1048576 THEN 'KB' ELSE 'MB' END AS unit FROM orders"""
)
def address_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.hex_address(F.col("o_orderkey")).alias("hex"), S.masked(size, 8).alias("masked"),
        F.element_at(F.split(S.size_text(size), " "), -1).alias("unit"),
    )


@query(
    """
    SELECT c_custkey, regexp_replace(c_name, '[0-9]+$', 'xxx') AS masked, left('proc' || c_name, 15) AS short, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS compact,
      replace(replace(replace('<' || c_mktsegment || '&"', '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS safe,
      c_custkey % 5 * CASE c_nationkey % 3 WHEN 0 THEN 1048576 WHEN 1 THEN 1024 ELSE 1 END AS kb FROM customer"""
)
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    unit = F.get(F.array(F.lit("gb"), F.lit("MB"), F.lit("kB")), F.col("c_nationkey") % 3)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.trailing_digits_masked(name).alias("masked"), S.process_short_name(F.concat(F.lit("proc"), name)).alias("short"),
        S.compact_name(name).alias("compact"), S.html_escaped(F.concat(F.lit("<"), "c_mktsegment", F.lit('&"'))).alias("safe"),
        S.kilobytes(F.col("c_custkey") % 5, unit).cast("long").alias("kb"),
    )


@query(
    """
    SELECT event_id, date_trunc('second', ts) AS parsed, epoch_us(ts) // 1000 AS ms FROM events"""
)
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd-HH:mm:ss", "yyyyMMddHHmmss"]
    written = F.date_format("ts", layouts[0])
    for k in (1, 2):
        written = F.when(F.col("event_id") % 3 == k, F.date_format("ts", layouts[k])).otherwise(written)
    return table(spark, sf_dir, "events").select("event_id", S.parse_time(written).alias("parsed"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def regex_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = LG.fields(F.col("props"), {"k": r'"k": *([0-9]+)'})
    return table(spark, sf_dir, "events").select("event_id", *found).withColumn("k", F.col("k").cast("long"))


@query(
    """
    WITH t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    m AS (SELECT user_id, n, last_value(CASE event_type WHEN 'purchase' THEN 'bought' WHEN 'signup' THEN 'joined' END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM t)
    SELECT section, count(*) AS lines, count(DISTINCT user_id) AS logs, CAST(max(n) AS BIGINT) AS last_line FROM m GROUP BY section"""
)
def log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user with a line an event, cut into lines and told by marker lines which section each is in."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"])
    logs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(in_order, "\n").alias("text"))
    told = LG.sections(LG.lines(logs), ["user_id"], {"bought": "^purchase$", "joined": "^signup$"})
    return told.groupBy("section").agg(
        F.count("*").alias("lines"), F.countDistinct("user_id").alias("logs"), F.max("line_no").cast("long").alias("last_line")
    )


@query(
    """
    WITH t AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    m AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM t)
    SELECT user_id, block, count(*) - 1 AS below, max(event_id) FILTER (event_type = 'purchase') AS header FROM m WHERE block > 0 GROUP BY 1, 2"""
)
def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase in a user's log with the events below it."""
    written = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: F.concat_ws(" ", e["event_type"], e["event_id"]))
    logs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(written, "\n").alias("text"))
    found = LG.blocks(LG.lines(logs), ["user_id"], "^purchase ")
    return found.select("user_id", "block", F.size("body").cast("long").alias("below"), F.split("header", " ")[1].cast("long").alias("header"))


@query(
    """
    SELECT conv_id, array_to_string(list_reverse(list(role ORDER BY turn)), ' -> ') AS chain, count(*) AS depth FROM conversations GROUP BY conv_id"""
)
def chain_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("conv_id", S.chain_text(F.col("chain")).alias("chain"), S.chain_depth(F.array_join("chain", " <- ")).cast("long").alias("depth"))


@query(
    """
    SELECT upper(lang) AS lang, count(*) AS sections, count(*) FILTER (n_chars > 1000) AS long, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1"""
)
def section_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.upper("lang").alias("lang")).agg(
        F.count("*").alias("sections"), F.count(F.when(F.col("n_chars") > 1000, 1)).alias("long"), F.countDistinct("source").alias("sources"),
        F.sum("n_chars").alias("chars"),
    )


@query(
    """
    WITH f AS (SELECT conv_id, min(turn) FILTER (role <> 'system') AS t FROM conversations GROUP BY 1)
    SELECT c.role, count(*) AS snapshots, count(*) * 300 AS estimated_ms FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.t GROUP BY 1"""
)
def sampled_stack_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by("role", "turn").alias("role")
    outer = table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(first)
    return outer.groupBy("role").agg(F.count("*").alias("snapshots")).withColumn("estimated_ms", F.col("snapshots") * 300)


# --- classifiers and flags


def _picked(names: tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int"))


_NAMES = ("String", "js_map", "src/pages/Index.ets:12", "(system)", "HiddenClass(NonMovable)", "Promise", "Widget", "entry:7", "jsarray")
_KINDS = ("object", "closure", "array", "js_set")
_PICK = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


@query(
    f"""
    WITH n AS (SELECT p_partkey, {_PICK}[p_partkey % 9 + 1] AS name, ['object', 'closure', 'array', 'js_set'][p_size % 4 + 1] AS kind FROM part),
    b AS (SELECT *, name IN ('src/pages/Index.ets:12', 'entry:7') AS business FROM n)
    SELECT business, CASE WHEN name LIKE 'HiddenClass%' THEN 'none' WHEN name = 'Promise' THEN 'promise'
      WHEN kind IN ('js_set', 'array') OR name = 'jsarray' THEN 'path' WHEN kind = 'closure' THEN 'name' ELSE 'name_path' END AS strategy,
      count(*) AS n FROM b GROUP BY ALL"""
)
def object_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(_picked(_NAMES, F.col("p_partkey")).alias("name"), _picked(_KINDS, F.col("p_size")).alias("kind"))
    classed = names.select(P.is_business_object(F.col("name")).alias("business"), P.cluster_strategy(F.col("name"), F.col("kind")).alias("strategy"))
    return classed.groupBy("business", "strategy").agg(F.count("*").alias("n"))


@query(
    """
    SELECT event_id, concat_ws(',', CASE WHEN value > 85 THEN 'cpu_high' END, CASE WHEN event_id % 1600 > 0 AND event_id % 1600 < 800 THEN 'memory_low' END,
      CASE WHEN event_id % 9 > 5 THEN 'thermal_throttled' END, CASE WHEN event_id % 9 BETWEEN 4 AND 5 THEN 'thermal_warm' END,
      CASE WHEN user_id % 5 > 3 THEN 'task_blocks_queue' END) AS flags FROM events"""
)
def resource_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    flags = P.resource_flags(F.col("value"), e % 1600, e % 9, F.col("user_id") % 5)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(flags, ",").alias("flags"))


_REQUESTS = ("", " with the NDK", " lazyforeach list", " on a surface", " page transition", " NDK and @State", " deprecated call")


@query(
    """
    WITH r AS (SELECT conv_id, turn, (conv_id + turn) % 7 AS k FROM conversations)
    SELECT conv_id, turn, CASE WHEN k IN (3, 5) THEN 'both' WHEN k = 1 THEN 'native' ELSE 'script' END AS domain,
      CASE WHEN k IN (1, 2, 5, 6) THEN 'must' WHEN k = 4 THEN 'should' ELSE 'skip' END AS need FROM r"""
)
def request_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    request = F.concat(F.lit("how to do it"), _picked(_REQUESTS, F.col("conv_id") + F.col("turn")))
    return rows.select("conv_id", "turn", P.request_domain(request).alias("domain"), P.search_need(request).alias("need"))


@query(
    """
    WITH a AS (SELECT o_orderkey, o_orderkey % 5000 * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 1234567890123 END AS address FROM orders)
    SELECT o_orderkey, CASE WHEN address = 0 THEN 'null_base' WHEN address < 4096 THEN 'null_base_offset' END AS note,
      regexp_matches(printf('%016x', address), '^(?:..)*(?:[2-6][0-9a-f]|7[0-9a-e]){4}') AS has_text FROM a"""
)
def crash_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = (F.col("o_orderkey") % 5000 * F.when(F.col("o_orderkey") % 2 == 0, F.lit(1)).otherwise(F.lit(1234567890123))).cast("decimal(20,0)")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.address_note(address).alias("note"), P.has_ascii_run(address).alias("has_text"))


@query(
    f"""WITH RECURSIVE {_NATION_EDGES}, d AS (SELECT 0 AS node, 0 AS k UNION ALL SELECT dst, k + 1 FROM d JOIN e ON e.src = d.node WHERE k < 2),
    u AS (SELECT 0 AS node, 0 AS k UNION ALL SELECT src, k + 1 FROM u JOIN e ON e.dst = u.node WHERE k < 2),
    f AS (SELECT n_nationkey AS node, n_nationkey IN (SELECT node FROM u) AS up, n_nationkey IN (SELECT node FROM d) AS down FROM nation)
    SELECT node, CASE WHEN node = 0 THEN 'fault' WHEN node % 10 = 0 THEN 'fault_process' WHEN up AND down THEN 'in_cycle' WHEN up THEN 'upstream'
      WHEN down THEN 'downstream' ELSE 'chain' END AS role FROM f"""
)
def thread_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(_nation_edges(spark, sf_dir), "waits")
    fault = spark.range(1).select(F.col("id").cast("int").alias("anchor"))
    down = G.reachable(edges, "src", "dst", fault, 2).select("node", F.lit(True).alias("down"))
    up = G.reachable(edges, "dst", "src", fault, 2).select("node", F.lit(True).alias("up"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")).join(up, "node", "left").join(down, "node", "left")
    return nodes.select("node", P.graph_role(F.col("node") == 0, F.col("node") % 10 == 0, F.col("up"), F.col("down")).alias("role"))


_FORMATS, _FINDINGS = ("mp4", "avi", "wav", None), ("none", "missing_moov", "extension_mismatch")


@query(
    """
    WITH m AS (SELECT page_id, page_id % 4 AS k, page_id % 3 AS f, page_id % 5 = 0 AS cut FROM pages),
    d AS (SELECT *, cut OR f = 1 AS damaged FROM m)
    SELECT page_id, concat_ws(',', CASE WHEN k = 3 OR (k IN (0, 2) AND damaged) THEN '5400103' END,
      CASE WHEN k = 3 OR k = 1 OR damaged OR f = 2 THEN '5400106' END) AS codes FROM d"""
)
def media_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    codes = P.media_error_codes(_picked(_FORMATS, p), F.array(_picked(_FINDINGS, p)), p % 5 == 0)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(codes, ",").alias("codes"))


# --- lookups, trees and two-step paths


@query(
    """
    SELECT event_type, user_id % 10 AS bucket, count(*) AS n, count(DISTINCT user_id) AS members, arg_max(event_id, (ts, event_id)) AS event_id
    FROM events GROUP BY 1, 2"""
)
def stack_bucket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)
    return R.bucket_summary(events, ["event_type", "bucket"], "user_id", ["ts", "event_id"], ["event_id"])


@query(
    """
    SELECT c.c_custkey, coalesce(s.s_name, n.n_name) AS name FROM customer c
    LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_custkey"""
)
def name_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("name"))
    return R.lookup_first(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], "name", [suppliers, nations])


@query(
    """
    WITH l AS (SELECT event_id, user_id % 20 AS pid, event_id % 3 AS tid FROM events), r AS (SELECT n_nationkey AS pid, n_regionkey % 3 AS tid, n_name FROM nation)
    SELECT event_id, n_name FROM l JOIN r ON l.pid = r.pid AND (l.tid = r.tid OR r.tid = 0)"""
)
def wildcard_wait_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("pid"), (F.col("event_id") % 3).alias("tid"))
    n = table(spark, sf_dir, "nation")
    right = n.select(F.col("n_nationkey").cast("long").alias("pid"), (F.col("n_regionkey") % 3).cast("long").alias("tid"), "n_name")
    return R.wildcard_join(left, right, "pid", "tid", 0).select("event_id", "n_name")


@query(
    """
    SELECT s.s_suppkey, coalesce(array_to_string(list(l.l_partkey ORDER BY l.l_partkey) FILTER (l.l_partkey IS NOT NULL), ','), '') AS parts FROM supplier s
    LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 45) l ON l.l_suppkey = s.s_suppkey GROUP BY 1"""
)
def attached_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.09D AND l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct()
    found = R.attached(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", lines, "l_partkey", "l_partkey", "parts")
    return found.select("s_suppkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query(
    """
    WITH RECURSIVE t AS (SELECT p_partkey AS node, p_partkey // 3 AS parent, CAST(p_size AS BIGINT) AS size FROM part),
    a AS (SELECT node AS up, size FROM t UNION ALL SELECT up // 3, size FROM a WHERE up > 0)
    SELECT up AS node, CAST(sum(size) AS BIGINT) AS retained FROM a GROUP BY 1"""
)
def retained_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.lit(1).alias("graph"), F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("size"))
    tree = nodes.where("node > 0").select("graph", "node", F.expr("node div 3").alias("parent"))
    return G.subtree_sums(tree, nodes).select("node", "retained")


@query(
    """
    SELECT l_suppkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS signature
    FROM lineitem WHERE NOT (l_returnflag = 'R') GROUP BY 1"""
)
def edge_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("kind"), "l_returnflag")
    return G.signatures(lines, "l_suppkey", "kind", F.col("l_returnflag") == "R")


@query(
    """
    WITH p AS (SELECT o_custkey AS src, l_orderkey AS via, l_partkey AS dst,
      CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'F' THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 3 ELSE 0 END AS score
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT src, via, dst, score FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, via, dst) = 1"""
)
def two_hop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("via"), "o_orderstatus")
    second = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("via"), F.col("l_partkey").alias("dst"), "l_returnflag")
    status = F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return G.best_two_hops(first, second, status + F.when(F.col("l_returnflag") == "A", 3).otherwise(0))


def _media_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as the payload of a file: its format by the key's last digit, then whole, cut by a byte or followed by five."""
    for batch in batches:
        made = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            body = (text or "").encode() or b"x"
            cut = lambda size: [body[at : at + size] for at in range(0, len(body), size)]  # noqa: B023,E731
            box = lambda kind, inner: struct.pack(">I4s", 8 + len(inner), kind) + inner
            chunk = lambda kind, inner: kind + struct.pack("<I", len(inner)) + inner + b"\0" * (len(inner) % 2)
            form = lambda kind, inner: b"RIFF" + struct.pack("<I", 4 + len(inner)) + kind + inner
            element = lambda name, inner: name + (1 << 56 | len(inner)).to_bytes(8) + inner
            match key % 10:
                case 0:
                    file = box(b"ftyp", b"isom0000") + box(b"moov", b"none") + box(b"mdat", body)
                case 1:
                    file = form(b"WAVE", chunk(b"fmt ", bytes(16)) + chunk(b"data", body))
                case 2:
                    file = form(b"AVI ", chunk(b"LIST", b"none") + chunk(b"JUNK", body))
                case 3:
                    file = b"\x1a\x45\xdf\xa3\x80" + element(b"\x18\x53\x80\x67", element(b"\x16\x54\xae\x6b", body))
                case 4:
                    file = b"".join(b"\x47" + x.ljust(187, b"\xff") for x in cut(187))
                case 5:
                    file = b"".join(
                        bytes([0xFF, 0xF1, 0x50, 0x80 | (n := 7 + len(x)) >> 11, n >> 3 & 255, (n & 7) << 5 | 0x1F, 0xFC]) + x for x in cut(1_000)
                    )
                case 6:
                    file = b"ID3\3\0\0\0\0\0\x0a" + bytes(10) + b"".join(b"\xff\xfb\x90\0" + x.ljust(413, b"\0") for x in cut(413))
                case 7:
                    file = b"fLaC\0" + (34).to_bytes(3) + bytes(34) + b"\x84" + len(body).to_bytes(3) + body
                case 8:
                    file = b"".join(
                        b"OggS\0" + bytes(21) + bytes([len(x) // 255 + 1]) + b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) + x for x in cut(4_000)
                    )
                case _:
                    file = b"#!AMR\n" + b"".join(b"\x3c" + x.ljust(31, b"\0") for x in cut(31))
            made.append([file, file[:-1], file + (b"H" if key % 10 == 9 else b"\0") * 5][key // 10 % 3])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "content"])


@query(
    """
    WITH p AS (SELECT page_id, page_id % 10 AS f, page_id // 10 % 3 AS h, greatest(1, strlen(coalesce(html, ''))) AS n FROM pages),
    s AS (
      SELECT *, CASE f WHEN 4 THEN (n + 186) // 187 WHEN 5 THEN (n + 999) // 1000 WHEN 6 THEN (n + 412) // 413 WHEN 8 THEN (n + 3999) // 4000 WHEN 9 THEN (n + 30) // 31 END AS c,
        ['mp4', 'riff', 'riff', 'matroska', 'ts', 'adts', 'mp3', 'flac', 'ogg', 'amr'][f + 1] AS kind FROM p),
    t AS (
      SELECT *, CASE f WHEN 0 THEN n + 36 WHEN 1 THEN n + n % 2 + 44 WHEN 2 THEN n + n % 2 + 32 WHEN 3 THEN n + 29 WHEN 4 THEN 188 * c WHEN 5 THEN n + 7 * c
        WHEN 6 THEN 20 + 417 * c WHEN 7 THEN n + 46 WHEN 8 THEN n + 27 * c + (c - 1) * 16 + (n - 4000 * (c - 1)) // 255 + 1 ELSE 6 + 32 * c END AS whole,
        CASE f WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN c - CASE WHEN h = 1 THEN 1 ELSE 0 END WHEN 6 THEN c + 1 WHEN 7 THEN 2 ELSE c END AS n_parts FROM s)
    SELECT page_id, kind, CAST(whole + CASE h WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 5 END AS BIGINT) AS size, CAST(n_parts AS BIGINT) AS n_parts,
      CASE WHEN f = 4 OR (f = 7 AND h <> 1) THEN NULL ELSE CAST(whole AS BIGINT) END AS declared,
      CASE WHEN f = 4 OR (f = 7 AND h <> 1) THEN 'unknown' WHEN h = 0 THEN 'complete' WHEN h = 1 THEN 'truncated' ELSE 'oversized' END AS verdict,
      CASE WHEN f = 0 AND h = 1 THEN 'atom_size_overflow' WHEN f = 1 AND h = 2 THEN 'wav_trailing_data' WHEN f = 4 AND c < 5 THEN 'ts_sync_failure' ELSE '' END AS found FROM t"""
)
def media_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten container formats written from all pages, walked by their own lengths."""
    files = table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(_media_files, "page_id long, content binary")
    walked = CN.walk_media(files, "page_id")
    return walked.select("page_id", "kind", "size", F.size("parts").cast("long").alias("n_parts"), "declared", "verdict", F.array_join("found", ",").alias("found"))


@query(
    """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'truncated' ELSE 'oversized' END AS verdict,
      CASE WHEN page_id % 3 = 2 THEN 'wav_trailing_data' ELSE '' END AS found,
      strlen(html) + 12 AS actual, strlen(html) + 12 + CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE -5 END AS declared FROM pages"""
)
def media_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("html") + 12
    declared = size + F.get(F.array(F.lit(0), F.lit(10), F.lit(-5)), (F.col("page_id") % 3).cast("int")) - 8
    octets = [F.lpad(F.hex(F.shiftright(declared, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]
    riff = F.concat(F.lit(bytearray(b"RIFF")), F.unhex(F.concat(*octets)), F.lit(bytearray(b"WAVE")), F.col("html").cast("binary"))
    files = table(spark, sf_dir, "pages").select("page_id", riff.alias("content"))
    kind, content, none = S.media_format(F.col("content")), F.col("content"), F.array().cast("array<struct<kind:string,start:long,end:long>>")
    said = V.declared_size(kind, content, none)
    return files.select(
        "page_id", V.size_verdict(said, F.octet_length("content")).alias("verdict"), F.array_join(V.findings(kind, content, none), ",").alias("found"),
        F.octet_length("content").cast("long").alias("actual"), said.alias("declared"),
    )


@query(
    f"""WITH {_CANDIDATES}, r AS (SELECT DISTINCT priority, trace FROM c WHERE status = 'P' AND length(trace) >= 31)
    SELECT priority, trace FROM c WHERE status = 'O' AND NOT EXISTS (
      SELECT 1 FROM r WHERE r.priority = c.priority AND (r.trace = c.trace OR contains(r.trace, c.trace) OR contains(c.trace, r.trace)))"""
)
def unpaired_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line states of open orders that those of no long pending order of the priority contain, or are contained in."""
    rows = stored(_candidates(spark, sf_dir), "traces")
    return R.unpaired_loose(rows.where("status = 'O'"), rows.where("status = 'P' AND length(trace) >= 31"), "priority", "trace").select("priority", "trace")


@query(
    """
    WITH k AS (SELECT c_name, c_custkey AS number FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT DISTINCT c_name FROM customer JOIN orders ON o_custkey = c_custkey),
    a AS (SELECT c_name, row_number() OVER (ORDER BY c_name) AS r FROM n WHERE c_name NOT IN (SELECT c_name FROM k))
    SELECT c_name, number, CASE WHEN c_name IN (SELECT c_name FROM n) THEN 'kept' ELSE 'removed' END AS change FROM k
    UNION ALL SELECT c_name, (SELECT max(number) FROM k) + r, 'added' FROM a"""
)
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two thirds of the customers, brought to those with orders: what a run would change."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    known = customers.where("c_custkey % 3 <> 0").select("c_name", F.col("c_custkey").alias("number"))
    now = customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return R.assign_ids(known, now, "c_name")


@query(
    """
    WITH RECURSIVE l AS (SELECT o_custkey * 2 AS c, l_suppkey * 2 + 1 AS s, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    e AS (SELECT DISTINCT c AS u, s AS v FROM l WHERE q = 50 UNION SELECT DISTINCT s, c FROM l WHERE q = 1),
    n AS (SELECT u AS node FROM e UNION SELECT v FROM e),
    r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
    SELECT n.node, least(n.node, min(b.v)) AS component FROM n LEFT JOIN (SELECT x.u, x.v FROM r x JOIN r y ON y.u = x.v AND y.v = x.u) b ON b.u = n.node GROUP BY n.node"""
)
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to suppliers over the largest lines, and back over the smallest."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    customer, supplier = F.col("o_custkey") * 2, F.col("l_suppkey") * 2 + 1
    there = lines.where("l_quantity = 50").select(customer.alias("u"), supplier.alias("v"))
    return G.strong_components(there.unionByName(lines.where("l_quantity = 1").select(supplier.alias("u"), customer.alias("v"))), "u", "v")


# --- files written from the tables and read back


#: Events of a snapshot, about, where there are more than one a task.
_SNAPSHOT_EVENTS = 250_000


def _snapshot_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of a task as the comma-separated records of one heap snapshot: each a node of its value, named by type and properties."""
    meta = {"node_fields": ["type", "name", "id", "self_size", "edge_count"], "node_types": ["object"]}
    at, names = 0, []
    for batch in batches:
        ids, sizes, kinds, props = (c.to_pylist() for c in batch.columns)
        flat = [str(x) for k, row in enumerate(zip(ids, sizes, strict=True)) for x in (0, at + k, *row, 0)]
        if flat and not at:
            flat[0] = json.dumps({"snapshot": {"meta": meta}})[:-1] + ', "nodes":[' + flat[0]
        names += [json.dumps(f"{a} {b}") for a, b in zip(kinds, props, strict=True)]
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(flat, pa.string())], names=["value"])
    if names:
        names[0] = '"strings":[' + names[0]
        names[-1] += "]}"
        # the bracket that closes the nodes is a record of its own, an empty element
        yield pa.RecordBatch.from_arrays([pa.array(["0]", *names], pa.string())], names=["value"])


@query(
    """SELECT event_id AS node_id, CAST(round(value * 100) AS BIGINT) AS size, 'object' AS type, event_type || ' ' || props AS name FROM events"""
)
def snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, written as heap snapshots of one JSON object each and read back in byte ranges; more events are more snapshots, as a task holds the names of one."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/snapshots-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", cents("value"), "event_type", "props")
    # by key, since rows dealt in turn are sorted first
    events = events.repartition(width(events, _SNAPSHOT_EVENTS), "event_id")
    events.mapInArrow(_snapshot_records, "value string").write.option("lineSep", ",").text(path)
    nodes = RG.snapshot_nodes(RG.json_elements(spark, path))
    return nodes.where("node_id IS NOT NULL").select("node_id", "size", "type", "name")


# Values that the crash records are made of, picked by the lines of an order.
_LIBRARIES = (
    "libc.so", "libark_jsruntime.so", "libuv.so", "libace_napi.z.so", "libapp.so", "libsqlite.z.so", "libipc_core.z.so", "ld-musl-aarch64.so.1",
)
_FUNCTIONS = (
    "napi_wrap", "uv_run", "ConcurrentMarker", "pthread_mutex_lock", "EvacuateObject", "uv_queue_work", "main", "JSFunction::Call", "napi_delete_reference",
)


#: Crash records of a log, which is read as one text of some 7 MB.
_LOG_RECORDS = 20_000


def _crash_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash record of each order in one text: its state says the signal, its lines are the stack. More lines are more tasks."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.repartition(width(lines), "l_orderkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    called = F.concat(pick(_LIBRARIES, F.col("l_suppkey")), F.lit("("), pick(_FUNCTIONS, F.col("l_partkey")), F.lit("+"), F.col("l_linenumber").cast("string"), F.lit(")"))
    stack = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", called.alias("called")).alias("_f")).groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list("_f")), lambda f, i: F.concat(F.lit("#"), i.cast("string"), F.lit(" pc 00ab /system/lib64/"), f["called"])).alias("frames")
    )
    signal = F.when(F.col("o_orderstatus") == "O", "SIGSEGV(SEGV_MAPERR)").when(F.col("o_orderstatus") == "F", "SIGBUS(BUS_OBJERR)").otherwise("SIGABRT(SI_TKILL)")
    thread = F.when(F.col("o_orderpriority").startswith("1"), "OS_GC_Thread").when(F.col("o_orderpriority").startswith("2"), "OS_FFRT_2_1").otherwise("main")
    message = F.when(F.col("o_custkey") % 7 == 0, "Fatal: ecma_vm cannot run in multi-thread!").otherwise("none")
    record = F.concat_ws(
        "\n", F.concat(F.lit("Order:"), F.col("o_orderkey")), F.concat(F.lit("Reason:Signal:"), signal, F.lit("@0x"), F.lower(F.hex("o_orderkey"))),
        F.concat(F.lit("Tid:1, Name:"), thread), F.concat(F.lit("LastFatalMessage:"), message), F.array_join("frames", "\n"),
    )
    # a small file of orders may be many rows, which every task would hold if they were broadcast
    return orders.join(stack.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select(record.alias("value"))


def _crash_sql() -> str:
    """The same records, searched for the same evidence and causes by DuckDB."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda values: f"[{', '.join(map(quoted, values))}]"
    part = {"signal": "signal", "code": "code", "thread": "thread", "message": "message", "stack": "array_to_string(frames, chr(10))", "top frame": "frames[1]"}
    part["native frame"] = f"list_filter(frames, lambda f: regexp_matches(f, {quoted(CR.NATIVE_FRAME)}))[1]"
    facts = {name: f"coalesce(regexp_matches({part[p]}, {quoted(x)}), false)" for p, found in CR.EVIDENCE.items() for name, x in found.items()}
    facts |= {"address": "true", "null_page": f"o_orderkey <= {CR.NULL_PAGE}", "text_address": "false"}
    facts["runtime_only"] = f"len(list_filter(frames, lambda f: NOT regexp_matches(f, {quoted(CR.COLLECTOR_FRAME)}))) = 0"
    causes = ", ".join(
        f"CASE WHEN {' OR '.join('(' + ' AND '.join(facts[f] for f in way) + ')' for way in ways)} THEN {quoted(cause)} END" for cause, ways in CR.CAUSES.items()
    )
    return f"""
    WITH f AS (
      SELECT l_orderkey, list({listed(_LIBRARIES)}[l_suppkey % {len(_LIBRARIES)} + 1] || '(' || {listed(_FUNCTIONS)}[l_partkey % {len(_FUNCTIONS)} + 1] || '+' || l_linenumber || ')'
        ORDER BY l_linenumber, l_partkey, l_suppkey) AS called FROM lineitem GROUP BY 1),
    r AS (
      SELECT o_orderkey, list_transform(called, lambda c, i: '#' || (i - 1) || ' pc 00ab /system/lib64/' || c) AS frames,
        CASE o_orderstatus WHEN 'O' THEN 'SIGSEGV' WHEN 'F' THEN 'SIGBUS' ELSE 'SIGABRT' END AS signal,
        CASE o_orderstatus WHEN 'O' THEN 'SEGV_MAPERR' WHEN 'F' THEN 'BUS_OBJERR' ELSE 'SI_TKILL' END AS code,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'OS_GC_Thread' WHEN '2' THEN 'OS_FFRT_2_1' ELSE 'main' END AS thread,
        CASE WHEN o_custkey % 7 = 0 THEN 'Fatal: ecma_vm cannot run in multi-thread!' ELSE 'none' END AS message
      FROM orders JOIN f ON l_orderkey = o_orderkey)
    SELECT o_orderkey AS order_key, signal, len(frames) AS n_frames, concat_ws(',', {causes}) AS causes,
      list_filter(frames, lambda f: NOT regexp_matches(f, {quoted(P.RUNTIME_FRAME)}))[1] AS caller,
      len(list_filter(frames, lambda f: regexp_matches(f, {quoted(P.SYSTEM_LIBRARY)}) AND regexp_matches(f, {quoted(P.LOCK_WAIT)}))) > 0 AS waits FROM r"""


@query(_crash_sql())
def crash_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as crash records in compressed logs, read back, cut into blocks and searched for causes, callers and waits."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/logs-{uuid.uuid4().hex}"
    _crash_logs(spark, sf_dir).write.option("compression", "gzip").option("maxRecordsPerFile", _LOG_RECORDS).text(path)
    records = LG.text_blocks(LG.read_logs(spark, path, r"^part-.*\.gz$").select("text"), r"^Order:\d+$")
    text, frames = F.array_join("body", "\n"), F.filter("body", lambda x: x.startswith("#"))
    key, thread, message, reason = LG.fields(
        F.concat_ws("\n", "header", text), {"order_key": r"Order:(\d+)", "thread": r"Name:(\S+)", "message": "LastFatalMessage:(.*)", "reason": "Reason:(.*)"}
    )
    found = records.select(key, thread, message, reason, frames.alias("frames"))
    said = P.reason_parts(F.col("reason"))
    facts = CR.crash_facts(F.col("frames"), F.col("message"), said["signal"], said["code"], said["address"], F.col("thread"))
    return found.select(
        F.col("order_key").cast("long"), said["signal"].alias("signal"), F.size("frames").cast("long").alias("n_frames"),
        F.array_join(CR.crash_causes(facts), ",").alias("causes"), P.first_caller(F.col("frames")).alias("caller"), P.waits_for_lock(F.col("frames")).alias("waits"),
    )
