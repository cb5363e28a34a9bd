"""Checks of media files' headers as built-in expressions: sizes declared against sizes found. ``operators.containers`` walks whole files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.predicates import matched


def little_endian(content: Column, at: Column, width: int) -> Column:
    octets = [F.hex(F.substring(content, at + k, F.lit(1))) for k in range(width, 0, -1)]
    return F.when(F.octet_length(content) >= at + width, F.conv(F.concat(*octets), 16, 10).cast("long"))


def declared_size(kind: Column, content: Column, boxes: Column) -> Column:
    """The size that a RIFF header or the last box of an ISO file declares; null for other formats."""
    return F.when(kind == "riff", little_endian(content, F.lit(4), 4) + 8).when(kind == "mp4", F.array_max(F.transform(boxes, lambda b: b["end"])))


def size_verdict(declared: Column, actual: Column) -> Column:
    """truncated, oversized or complete; unknown where nothing is declared."""
    return F.when(declared.isNull(), "unknown").when(actual < declared, "truncated").when(actual > declared, "oversized").otherwise("complete")


def findings(kind: Column, content: Column, boxes: Column) -> Column:
    """What is wrong with a file's structure, by name."""
    size = F.octet_length(content)
    return matched(
        {
            "zero_filled": (size > 0) & (F.octet_length(F.ltrim(content.cast("string"), F.lit("\0"))) == 0),
            "missing_moov": (kind == "mp4") & ~F.exists(boxes, lambda b: b["kind"] == "moov"),
            "atom_size_overflow": (kind == "mp4") & F.exists(boxes, lambda b: b["end"] > size),
            "wav_trailing_data": (kind == "riff") & (size > little_endian(content, F.lit(4), 4) + 8),
        }
    )
