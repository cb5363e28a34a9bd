"""Markdown documents with a front matter block, as catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def front_matter(text: Column) -> Column:
    """``key: value`` lines between the opening and closing rules, as a map; the last of a repeated key counts."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    entry = lambda x: F.struct(
        F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2").alias("v")
    )
    return F.aggregate(
        F.transform(pairs, entry),
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])),
    )


def truthy(value: Column) -> Column:
    """Whether a text spells yes."""
    return F.lower(F.trim(value)).isin("true", "yes", "on", "1")


def read_catalog(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """``(path, name, description, fields)``; without a description, the first line of prose stands in."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    meta = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"), front_matter(F.col("value")).alias("fields"))
    body = F.regexp_replace(F.col("text"), r"(?s)\A---\r?\n.*?\r?\n---\s*", "")
    prose = F.regexp_extract(body, r"(?m)^(?!#|\s*$|```)(.+)$", 1)
    described = F.coalesce(F.nullif(F.col("fields")["description"], F.lit("")), prose)
    return meta.select(
        "path", F.coalesce(F.col("fields")["name"], F.element_at(F.split("path", "/"), -2)).alias("name"),
        F.trim(F.regexp_replace(described, r"\s+", " ")).alias("description"), "fields",
    )
