"""One large JSON object read in byte ranges: the elements of its arrays, wherever Spark cuts the file.

Spark's text reader cuts a file at commas, so a range begins after one, but a comma may stand in a string or in
something nested. What a range does to the reader's state is a function of whether it begins in a string; two scans
of the range tell its end for both cases, and composing these few functions along a file gives every range its true
beginning. A second scan then emits elements, numbered from where the range began, and a fold over the ranges' ends
says which array that was and how far it had come. Elements that ranges cut are put together again.

Names of arrays may hold no comma. A file may end in a comma. Files without arrays give nothing. Ranges are as
long as ``spark.sql.files.maxPartitionBytes`` says.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import small_batches, stored, width

_TOKEN = re.compile(r'\\.|["\[\]{}]', re.DOTALL)
_SPECIAL = re.compile(r'["\[\]{}]')
Element = tuple[str | None, int, str, bool, bool]


def ending(records: Iterable[str], in_string: bool) -> tuple[bool, int]:
    """Whether the text of ``records``, each with a comma behind it, ends in a string, and by how much it is deeper then."""
    depth = 0
    for record in records:
        for token in _TOKEN.findall(record) if _SPECIAL.search(record) else ():
            if token == '"':
                in_string = not in_string
            elif not in_string and len(token) == 1:
                depth += 1 if token in "[{" else -1
    return in_string, depth


def elements_of(records: Iterable[str], in_string: bool, depth: int) -> Iterator[Element | tuple[bool, str | None, int]]:
    """``(array, number, text, begins before, goes on)`` of the elements in one range, and at last ``(opened, array, number)``.

    ``array`` is None, and numbers count from the range's beginning, until an array opens or closes in it.
    """
    array, number, opened = None, 0, False
    buffer: list[str] = []
    before = in_string or depth > 2

    def element(goes_on: bool = False) -> Element:
        nonlocal before
        made = (array, number, ",".join(buffer), before, goes_on)
        buffer.clear()
        before = False
        return made

    for record in records:
        start = 0
        if in_string or _SPECIAL.search(record):
            name, quote = None, 0
            for found in _TOKEN.finditer(record):
                token = found.group()
                if token == '"':
                    if in_string and depth == 1:
                        name = record[quote : found.start()]
                    in_string, quote = not in_string, found.end()
                elif in_string or len(token) > 1:
                    continue
                elif token in "[{":
                    depth += 1
                    if depth == 2:
                        array, number, opened, start, before = name, 0, True, found.end(), False
                        buffer.clear()
                else:
                    depth -= 1
                    if depth == 1:
                        buffer.append(record[start : found.start()])
                        if before or "".join(buffer).strip():
                            yield element()
                        buffer.clear()
                        array, number, opened, before = None, 0, True, False
        if depth >= 2:
            buffer.append(record[start:])
            if depth == 2 and not in_string:
                yield element()
                number += 1
    if buffer:
        yield element(goes_on=True)
    yield opened, array, number


def _ranges(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The records of each range, whose keys are the first ``width`` columns."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    for key, mine in groupby(rows(), key=lambda r: r[:width]):
        yield key, (r[width] for r in mine)


def _batched(rows: Iterable[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _begin(frame: pd.DataFrame) -> pd.DataFrame:
    """Composes the ranges' functions along one file."""
    frame = frame.sort_values("block")
    inside, depth, out = False, 0, []
    for row in frame.itertuples():
        out.append((row.file, row.block, inside, depth))
        inside, depth = (row.inside_1, depth + row.depth_1) if inside else (row.inside_0, depth + row.depth_0)
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth"])


def _carry(frame: pd.DataFrame) -> pd.DataFrame:
    """Array and number at the beginning of each range of one file."""
    frame = frame.sort_values("block")
    array, number, out = None, 0, []
    for row in frame.itertuples():
        out.append((row.file, row.block, array, number))
        array, number = (row.array, row.number) if row.opened else (array, number + row.number)
    return pd.DataFrame(out, columns=["file", "block", "at_array", "at_number"])


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, array, number, text)``: the elements, as they are written, of all arrays and objects that the objects in the files at ``path`` hold.

    Entries of an inner object are elements too, with their keys.
    """
    small_batches(spark, rows=10_000)
    text = spark.read.option("lineSep", ",").text(path)
    records = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("file", pa.string()), ("block", pa.int64()), ("inside_0", pa.bool_()), ("depth_0", pa.int64()), ("inside_1", pa.bool_()), ("depth_1", pa.int64())]

        def both() -> Iterator[tuple]:
            for key, mine in _ranges(batches, 2):
                state = [(False, 0), (True, 0)]
                for record in mine:
                    if _SPECIAL.search(record):
                        state = [(lambda s, d: (s, depth + d))(*ending([record], inside)) for inside, depth in state]
                yield (*key, *state[0], *state[1])

        yield from _batched(both(), pa.schema(kinds))

    functions = records.mapInArrow(ends, "file string, block long, inside_0 boolean, depth_0 long, inside_1 boolean, depth_1 long")
    # a row a range, and as many in a group as a file has ranges
    begins = functions.groupBy("file").applyInPandas(_begin, "file string, block long, inside boolean, depth long")
    known = records.join(F.broadcast(stored(begins, "begins")), ["file", "block"]).select("file", "block", "inside", "depth", "value")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("file", pa.string()), ("block", pa.int64()), ("opened", pa.bool_()), ("array", pa.string()), ("number", pa.int64()), ("text", pa.string()), ("cut", pa.bool_())]

        def rows() -> Iterator[tuple]:
            for (file, block, inside, depth), mine in _ranges(batches, 4):
                for made in elements_of(mine, inside, depth):
                    if len(made) == 3:
                        yield file, block, made[0], made[1], made[2], None, False
                    else:
                        yield file, block, None, made[0], made[1], made[2], made[3] or made[4]

        yield from _batched(rows(), pa.schema(kinds))

    found = stored(known.mapInArrow(cut, "file string, block long, opened boolean, array string, number long, text string, cut boolean"), "elements")
    carried = found.where("text IS NULL").groupBy("file").applyInPandas(_carry, "file string, block long, at_array string, at_number long")
    placed = found.where("text IS NOT NULL").join(F.broadcast(stored(carried, "carried")), ["file", "block"])
    # numbers of an array that was open before count on from there
    late = F.col("array").isNull()
    placed = placed.select(
        "file", "block", "text", "cut", F.coalesce("array", "at_array").alias("array"), (F.col("number") + F.when(late, F.col("at_number")).otherwise(0)).alias("number")
    )
    own = ["file", "array", "number"]
    pieces = placed.where("cut").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("_pieces"))
    joined = pieces.select(*own, F.array_join(F.transform("_pieces", lambda p: p["text"]), ",").alias("text"))
    return placed.where("NOT cut").select(*own, "text").unionByName(joined)


_META = "meta struct<node_fields:array<string>,node_types:array<string>>"


def snapshot_nodes(elements: DataFrame) -> DataFrame:
    """``(graph, node, node_id, size, edge_count, type, name)`` of heap snapshots, from their ``json_elements``; the same as ``snapshot.nodes`` of whole ones."""
    kept = stored(elements, "snapshot")
    meta = kept.where("array = 'snapshot'").select("file", F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), _META)["meta"].alias("meta")).where("meta IS NOT NULL")
    fields, types = (F.broadcast(meta.select("file", F.col(f"meta.node_{n}").alias(n))) for n in ("fields", "types"))  # a row a file
    flat = kept.where("array = 'nodes'").join(fields, "file").withColumn("node", F.expr("number div size(fields)"))
    field, value = F.expr("fields[CAST(number % size(fields) AS int)]"), F.trim("text").cast("long")
    read = {"node_id": "id", "size": "self_size", "edge_count": "edge_count", "_type": "type", "_name": "name"}
    # dealt to as many tasks as the elements ask for before they meet, since a task that reads them would hold all of its nodes
    flat = flat.select("file", "node", field.alias("_field"), value.alias("_value")).repartition(width(kept), "file", "node")
    rows = flat.groupBy("file", "node").agg(*[F.max(F.when(F.col("_field") == f, F.col("_value"))).alias(n) for n, f in read.items()])
    # a text is an element of a JSON array by itself
    strings = kept.where("array = 'strings'").select("file", F.col("number").alias("_name"), F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")[0].alias("name"))
    named = rows.join(strings.hint("merge"), ["file", "_name"], "left").join(types, "file")
    return named.select(F.col("file").alias("graph"), "node", "node_id", "size", "edge_count", F.get("types", F.col("_type").cast("int")).alias("type"), "name")
