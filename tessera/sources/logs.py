"""Text logs as DataFrames: discovery, decoding, lines, sections and header-led blocks."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import bound, name_time
from tessera.runtime import small_batches

# Encodings tried in order; the last never fails.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")


def decode(data: bytes | None) -> str:
    """The text of a file, unpacked if it is gzip."""
    if data and data.startswith(b"\x1f\x8b"):
        data = gzip.decompress(data)
    for encoding in ENCODINGS:
        try:
            return (data or b"").decode(encoding)
        except UnicodeDecodeError:
            continue
    return (data or b"").decode("utf-8", errors="replace")


def read_logs(spark: SparkSession, path: str, name_pattern: str = ".*", head_pattern: str | None = None, head_bytes: int = 16384) -> DataFrame:
    """``(path, name, time, text)`` of files below ``path`` by name and, if asked, by their first bytes.

    Names and heads are tested by Spark before any text is decoded in Python, where a task holds one text at
    a time. ``time`` is what the name says, or else the file's modification time.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").rlike(name_pattern))
    if head_pattern:
        files = files.where(F.substring("content", 1, head_bytes).cast("string").rlike(head_pattern))

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(len(frame)):
                one = frame.iloc[k : k + 1]
                yield one.assign(text=one["content"].map(decode)).drop(columns="content")

    dated = files.select("path", "name", F.coalesce(name_time(F.col("name")), F.col("modificationTime").cast("timestamp_ntz")).alias("time"), "content")
    return dated.mapInPandas(texts, "path string, name string, time timestamp_ntz, text string")


def newest_group(files: DataFrame, key_pattern: str, kinds: Mapping[str, str]) -> DataFrame:
    """Files grouped by a key in their name, a column of paths for each kind; the largest group first."""
    keyed = files.withColumn("key", F.regexp_extract("name", key_pattern, 1)).where("key <> ''")
    paths = [F.max(F.when(F.col("name").rlike(p), F.col("path"))).alias(k) for k, p in kinds.items()]
    return keyed.groupBy("key").agg(F.count("*").alias("files"), *paths).orderBy(F.desc("files"), "key")


def lines(logs: DataFrame, text: str = "text") -> DataFrame:
    """One row a line with its number from 1."""
    kept = [c for c in logs.columns if c != text]
    return logs.select(*kept, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def sections(rows: DataFrame, by: Sequence[str], markers: Mapping[str, str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Add ``section``: the name of the last marker line at or above, null before the first."""
    name = F.lit(None).cast("string")
    for section, pattern in markers.items():
        name = F.when(F.col(line).rlike(pattern), section).otherwise(name)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(name, ignorenulls=True).over(w))


def blocks(rows: DataFrame, by: Sequence[str], header: str, order: str = "line_no", line: str = "line") -> DataFrame:
    """Lines below each header, in order, as ``(header, body)``; lines above the first are left out."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    opened = rows.withColumn("_block", F.sum(F.col(line).rlike(header).cast("int")).over(w)).where("_block > 0")
    body = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line])
    grouped = opened.groupBy(*by, "_block").agg(body.alias("_lines"))
    return grouped.select(*by, F.col("_block").alias("block"), F.get("_lines", 0).alias("header"), F.slice("_lines", 2, 1 << 30).alias("body"))


def text_blocks(logs: DataFrame, header: str, text: str = "text") -> DataFrame:
    """The ``blocks`` of each row's text, cut where the text is: nothing is shuffled, and a task holds one text and its lines."""
    kept = [c for c in logs.columns if c != text]

    def cut(lines: Column) -> Column:
        found = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(header), i)), F.isnotnull)
        return bound(found, lambda starts: F.transform(starts, lambda at, k: block(lines, at, F.coalesce(F.get(starts, k + 1), F.size(lines)), k)))

    def block(lines: Column, at: Column, end: Column, k: Column) -> Column:
        return F.struct((k + 1).cast("long").alias("block"), F.get(lines, at).alias("header"), F.slice(lines, at + 2, end - at - 1).alias("body"))

    return logs.select(*kept, F.inline(bound(F.split(text, r"\r?\n"), cut)))


def header_table(rows: DataFrame, header: Column, line: str = "line") -> Column:
    """Cells of a line named by a header line whose column order may vary."""
    return F.map_from_arrays(F.split(F.trim(header), r"\s+"), F.slice(F.split(F.trim(F.col(line)), r"\s+"), 1, F.size(F.split(F.trim(header), r"\s+"))))


def fields(text: Column, patterns: Mapping[str, str]) -> list[Column]:
    """First captures, null where a pattern doesn't match."""
    return [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias(n) for n, p in patterns.items()]


# Lines of wait-graph, stack and memory-map records.
WAIT = r"(\d+):(\d+) to (\d+):(\d+) code ([0-9a-zA-Z]+) wait:([0-9.]+) s"
FRAME = r"#(\d+) pc ([0-9a-f]+) ([^\s(]+)(?:\(([^)+]*)(?:\+(\d+))?\))?"
MAP = r"^([0-9a-f]+)-([0-9a-f]+)\s+(\S+)\s+\S+\s+\S+\s+\S+\s*(.*)$"


def wait_edges(rows: DataFrame, line: str = "line") -> DataFrame:
    names = ["src_pid", "src_tid", "dst_pid", "dst_tid", "code", "wait_s"]
    found = rows.where(F.col(line).rlike(WAIT)).select("*", *[F.regexp_extract(line, WAIT, k + 1).alias(n) for k, n in enumerate(names)])
    return found.withColumn("wait_s", F.col("wait_s").cast("double"))


def stack_frames(rows: DataFrame, line: str = "line") -> DataFrame:
    names = ["depth", "pc", "file", "function", "offset"]
    found = rows.where(F.col(line).rlike(FRAME)).select("*", *[F.regexp_extract(line, FRAME, k + 1).alias(n) for k, n in enumerate(names)])
    return found.withColumns({"depth": F.col("depth").cast("int"), "offset": F.expr("try_cast(offset AS bigint)")})


def memory_maps(rows: DataFrame, line: str = "line") -> DataFrame:
    """Intervals [low, high) as decimals, since addresses are unsigned."""
    found = rows.where(F.col(line).rlike(MAP))
    ends = [F.conv(F.regexp_extract(line, MAP, k + 1), 16, 10).cast("decimal(20,0)").alias(n) for k, n in enumerate(["low", "high"])]
    return found.select("*", *ends, F.regexp_extract(line, MAP, 3).alias("perms"), F.regexp_extract(line, MAP, 4).alias("file"))
