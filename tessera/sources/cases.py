"""Inputs and outputs of one analysis: address maps, cluster files, files by role, and reports."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tessera.functions.scalars import parse_address

_PAIR = r"^\s*((?:0x)?[0-9a-fA-F]+)\s+(\d+)(?:\s.*)?$"


def read_address_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(address, node, copies)`` of lines "hex-address node-id rest", and ``(path, line)`` of lines that are not.

    Empty lines and lines that start with # are neither. Addresses are decimal text, as they are unsigned.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    lines = lines.where("trim(line) <> '' AND NOT ltrim(line) LIKE '#%'")
    bare = F.regexp_replace(F.lower(F.regexp_extract("line", _PAIR, 1)), "^0x", "")
    pairs = lines.where(F.col("line").rlike(_PAIR)).select(
        parse_address(F.concat(F.lit("0x"), bare)).alias("address"), F.regexp_extract("line", _PAIR, 2).try_cast("long").alias("node")
    )
    good = pairs.where("address IS NOT NULL AND node IS NOT NULL").groupBy("address", "node").agg(F.count("*").alias("copies"))
    return good, lines.where(~F.col("line").rlike(_PAIR))


CLUSTERS = (
    "candidates array<struct<rank:int,category:string,key:string,strategy:string,group_names:array<string>,count:long,total_retained_size:long,"
    "distance:int,root_type:string,root_id:string,"
    "path_entries:array<struct<node_id:string,name:string,retained_size:long,distance:int>>>>"
)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """One row a candidate of a cluster file, with the entries of its path."""
    found = spark.read.schema(CLUSTERS).option("multiLine", "true").json(path)
    return found.select(F.col("_metadata.file_path").alias("path"), F.inline("candidates"))


def seeds(clusters: DataFrame) -> DataFrame:
    """``(node, sources)``: the nodes that paths start from, and the keys of the clusters that they stand for."""
    at = clusters.select("key", F.explode(F.filter("path_entries", lambda e: e["distance"] == 0)).alias("e"))
    return at.groupBy(F.col("e.node_id").try_cast("long").alias("node")).agg(F.array_sort(F.collect_set("key")).alias("sources"))


def files_by_role(spark: SparkSession, path: str, roles: Mapping[str, str]) -> dict[str, str]:
    """The one file below ``path`` for each role's name pattern; anything but one is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    picked = {role: F.when(name.rlike(pattern), F.col("path")) for role, pattern in roles.items()}
    counts = [F.count(c).alias(f"n_{role}") for role, c in picked.items()]
    row = files.agg(*counts, *[F.min(c).alias(role) for role, c in picked.items()]).first()
    for role in roles:
        if row[f"n_{role}"] != 1:
            raise ValueError(f"{row[f'n_{role}']} files for {role} below {path}, where one is needed")
    return {role: row[role] for role in roles}


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def report_columns(rows: DataFrame) -> list[Column]:
    """Columns under lower-case names, decimals as text, so that no JSON reader loses digits."""
    text = {f.name for f in rows.schema if isinstance(f.dataType, DecimalType)}
    return [(F.col(f"`{c}`").cast("string") if c in text else F.col(f"`{c}`")).alias(snake(c)) for c in rows.columns]


def write_report(rows: DataFrame, path: str, least: int = 0) -> None:
    """Write JSON lines under Spark's commit protocol; fewer than ``least`` rows are an error, and nothing is written."""
    if least and rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows for {path}")
    rows.select(*report_columns(rows)).write.mode("overwrite").json(path)
