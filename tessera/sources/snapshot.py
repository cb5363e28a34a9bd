"""Heap snapshots: flat integer arrays of nodes and edges, as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "snapshot struct<meta:struct<node_fields:array<string>,node_types:array<string>,edge_fields:array<string>,edge_types:array<string>>>, "
    "nodes array<long>, edges array<long>, strings array<string>, objectIdMap map<string,long>"
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row a file. A snapshot is one JSON document and must fit one worker."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path).withColumn("graph", F.input_file_name())


def _field(array: str, fields: str, name: str, row: str) -> F.Column:
    at = F.array_position(F.col(fields), F.lit(name)).cast("int") - 1
    return F.get(F.col(array), (F.col(row) * F.size(fields) + at).cast("int"))


def nodes(snapshots: DataFrame) -> DataFrame:
    """``(graph, node, node_id, type, name, size, edge_count, first_edge)``; the field count comes from the metadata."""
    flat = snapshots.select(
        "graph", "nodes", "strings", F.col("snapshot.meta.node_fields").alias("fields"), F.col("snapshot.meta.node_types").alias("types")
    )
    rows = flat.withColumn("node", F.explode(F.sequence(F.lit(0), (F.size("nodes") / F.size("fields")).cast("int") - 1)))
    read = {n: _field("nodes", "fields", f, "node") for n, f in (("node_id", "id"), ("size", "self_size"), ("edge_count", "edge_count"))}
    kind, name = _field("nodes", "fields", "type", "node"), _field("nodes", "fields", "name", "node")
    return rows.select(
        "graph", F.col("node").cast("long").alias("node"), *[c.alias(n) for n, c in read.items()],
        F.get("types", kind.cast("int")).alias("type"), F.get("strings", name.cast("int")).alias("name"),
    )


def edges(snapshots: DataFrame) -> DataFrame:
    """``(graph, src, dst, type, name, repaired)``; a target that is null, out of range or misaligned becomes node 0."""
    per_node = "transform(sequence(0, CAST(size(nodes) / size(nf) AS int) - 1), i -> nodes[i * size(nf) + CAST(array_position(nf, 'edge_count') AS int) - 1])"
    flat = snapshots.select(
        "graph", "nodes", "edges", "strings", F.col("snapshot.meta.node_fields").alias("nf"), F.col("snapshot.meta.edge_fields").alias("fields"),
        F.col("snapshot.meta.edge_types").alias("types"),
    )
    owners = flat.withColumn("_owners", F.expr(f"flatten(transform({per_node}, (n, i) -> array_repeat(CAST(i AS bigint), CAST(n AS int))))"))
    rows = owners.select("graph", "nodes", "nf", "edges", "strings", "fields", "types", F.posexplode("_owners").alias("edge", "src"))
    to, kind = _field("edges", "fields", "to_node", "edge"), _field("edges", "fields", "type", "edge")
    name = _field("edges", "fields", "name_or_index", "edge")
    good = to.isNotNull() & (to >= 0) & (to < F.size("nodes")) & (to % F.size("nf") == 0)
    kind_name = F.get("types", kind.cast("int"))
    return rows.select(
        "graph", "src", F.when(good, (to / F.size("nf")).cast("long")).otherwise(0).alias("dst"), kind_name.alias("type"),
        F.when(kind_name.isin("element", "hidden"), name.cast("string")).otherwise(F.get("strings", name.cast("int"))).alias("name"),
        (~good).alias("repaired"),
    )


def strong(edge_rows: DataFrame) -> DataFrame:
    """Edges that keep their target alive."""
    return edge_rows.where("type <> 'weak' AND NOT coalesce(name, '') RLIKE '(?i)weak(map|set|ref)'")
