"""Walks of media containers from their bytes: parts in order, the size that is declared, what is wrong.

Ten formats are walked by the lengths that they state: ISO boxes, RIFF chunks, EBML elements with their
variable-length numbers, FLAC blocks, Ogg pages, and the packets or frames of TS, ADTS, MP3 and AMR, which are found
again after bytes that belong to none. A walk reads headers only and goes forward only, so it takes time in
proportion to the parts, plus what it must skip to find the next.

Cases: a null file has null parts and findings. Parts may end beyond the file, which then counts as truncated; a walk ends
at the first header that can't be one, or with frames looks for the next. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.media import size_verdict
from tessera.functions.scalars import media_format
from tessera.runtime import small_batches

Part = tuple[str, int, int]
#: Parts, declared end, findings.
Walk = tuple[list[Part], int | None, list[str]]


def iso(data: bytes) -> Walk:
    parts, at, n = [], 0, len(data)
    while at + 8 <= n:
        size, body = int.from_bytes(data[at : at + 4]), 8
        if size == 1 and at + 16 <= n:
            size, body = int.from_bytes(data[at + 8 : at + 16]), 16
        end = n if size == 0 else at + size
        if end < at + body:
            break
        parts.append((data[at + 4 : at + 8].decode("latin-1"), at, end))
        at = end
    found = [] if any(p[0] == "moov" for p in parts) else ["missing_moov"]
    return parts, parts[-1][2] if parts else None, found + ["atom_size_overflow"] * (at > n)


def riff(data: bytes) -> Walk:
    parts, at, n = [], 12, len(data)
    declared = 8 + int.from_bytes(data[4:8], "little") if n >= 8 else None
    wave = data[8:12] == b"WAVE"
    if wave and n < 44:
        return parts, declared, ["header_too_short"]
    while at + 8 <= n:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        parts.append((data[at : at + 4].decode("latin-1"), at, at + 8 + size))
        at += 8 + size + size % 2  # chunks begin at even places
    ends = {kind: end + end % 2 for kind, _, end in parts}
    found = [f"wav_missing_{k.strip()}" for k in ("fmt ", "data") if k not in ends] + ["wav_trailing_data"] * (ends.get("data", n) < n)
    return parts, declared, found if wave else []


#: Identifiers of an EBML segment and of its tracks.
SEGMENT, TRACKS = "18538067", "1654AE6B"


def _number(data: bytes, at: int, widest: int) -> tuple[int, int, bool]:
    """A variable-length number: how many bytes, its value without the mark, and whether all its bits are set; no bytes if there is none."""
    if at >= len(data) or (width := 9 - data[at].bit_length()) > widest or at + width > len(data):
        return 0, 0, False
    value = int.from_bytes(data[at : at + width]) & ((1 << 7 * width) - 1)
    return width, value, value == (1 << 7 * width) - 1


def ebml(data: bytes) -> Walk:
    parts, at, n, inside = [], 0, len(data), 0
    ends = []
    while at < n:
        width, _, _ = _number(data, at, 4)
        more, size, unknown = _number(data, at + width, 8) if width else (0, 0, False)
        if not more:
            break
        name, body = data[at : at + width].hex().upper(), at + width + more
        end = (inside or n) if unknown else body + size
        parts.append((name, at, end))
        if name == SEGMENT and not inside:
            inside, at = end, body
            ends.append(end)
            continue
        at = end
        if inside and at >= inside:
            at, inside = max(at, inside), 0
        elif not inside:
            ends.append(end)
    names = {p[0] for p in parts}
    found = ["missing_segment"] if SEGMENT not in names else ["missing_tracks"] * (TRACKS not in names)
    return parts, max(ends, default=None), found


def flac(data: bytes) -> Walk:
    parts, at, n = [], 4, len(data)
    if n < 8:
        return parts, None, ["header_too_short"]
    while at + 4 <= n:
        end = at + 4 + int.from_bytes(data[at + 1 : at + 4])
        parts.append((str(data[at] & 0x7F), at, end))
        if data[at] & 0x80:
            at = end
            break
        at = end
    # what follows the blocks doesn't say how long it is
    return parts, at if at > n else None, ["flac_missing_streaminfo"] * (parts[0][0] != "0")


def _frames(data: bytes, at: int, kind: str, length: Callable[[bytes, int], int], mark: bytes, sure: bool = False) -> list[Part]:
    """Frames from ``at`` on; where none begins, the next is looked for by its first bytes. ``sure``: after a gap another must follow it."""
    parts, n, lost = [], len(data), False
    while 0 <= at < n:
        size = length(data, at)
        if size and not (lost and sure and at + size < n and not length(data, at + size)):
            parts.append((kind, at, at + size))
            at, lost = at + size, False
        else:
            at, lost = data.find(mark, at + 1), True
    return parts


def _ending(parts: list[Part]) -> int | None:
    return parts[-1][2] if parts else None


def ts(data: bytes) -> Walk:
    n = len(data)
    parts = _frames(data, 0, "packet", lambda d, at: 188 if d[at] == 0x47 and at + 188 <= n else 0, b"\x47", sure=True)
    return parts, None, ["ts_sync_failure"] * (sum(data[at] == 0x47 for at in range(0, min(n, 1880), 188)) < 5)


def _adts_frame(data: bytes, at: int) -> int:
    if at + 7 > len(data) or data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
        return 0
    size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
    return size if size >= 7 else 0


def adts(data: bytes) -> Walk:
    if len(data) < 7:
        return [], None, ["header_too_short"]
    parts = _frames(data, 0, "frame", _adts_frame, b"\xff", sure=True)
    if not _adts_frame(data, 0):
        return parts, _ending(parts), ["aac_sync_failed"]
    return parts, _ending(parts), ["aac_invalid_sample_rate"] * ((data[2] >> 2) & 15 > 12)


# Kilobits a second of MPEG audio by version and layer, and samples a second.
_BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = (44_100, 48_000, 32_000)


def _mpeg_frame(data: bytes, at: int) -> int:
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return 0
    version, layer, bits, rate, pad = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3), data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return 0
    speed, hertz = 1000 * _BITRATES[1 if version == 3 else 2, layer][bits - 1], _RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    if layer == 1:
        return (12 * speed // hertz + pad) * 4
    return (72 if layer == 3 and version != 3 else 144) * speed // hertz + pad


def mp3(data: bytes) -> Walk:
    parts, at = [], 0
    if data[:3] == b"ID3":
        if len(data) < 10:
            return parts, None, ["id3_truncated"]
        at = 10 + sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
        parts.append(("ID3", 0, at))
    frames = _frames(data, at, "frame", _mpeg_frame, b"\xff", sure=True)
    late = not frames or frames[0][1] > at + 4_096
    return parts + frames, _ending(parts + frames), ["mp3_sync_failed"] * late


def _ogg_page(data: bytes, at: int) -> int:
    if data[at : at + 4] != b"OggS" or at + 27 > len(data):
        return 0
    return 27 + data[at + 26] + sum(data[at + 27 : at + 27 + data[at + 26]])


def ogg(data: bytes) -> Walk:
    if len(data) < 27:
        return [], None, ["header_too_short"]
    parts = _frames(data, 0, "page", _ogg_page, b"OggS")
    return parts, _ending(parts), ["ogg_bad_version"] * (data[4] != 0) + ["ogg_empty_page"] * (data[26] == 0)


# Bytes of an AMR frame by its mode, narrow and wide band.
_NARROW = {0: 13, 1: 14, 2: 16, 3: 18, 4: 20, 5: 21, 6: 27, 7: 32, 8: 6, 15: 1}
_WIDE = {0: 18, 1: 24, 2: 33, 3: 37, 4: 41, 5: 47, 6: 51, 7: 59, 8: 61, 9: 6, 14: 1, 15: 1}


def amr(data: bytes) -> Walk:
    modes, at = (_WIDE, 9) if data[:9] == b"#!AMR-WB\n" else (_NARROW, 6)
    if data[:at] not in (b"#!AMR-WB\n", b"#!AMR\n"):
        return [], None, ["amr_header_incomplete"]
    parts = []
    while at < len(data) and (size := modes.get(data[at] >> 3 & 15)):
        parts.append(("frame", at, at + size))
        at += size
    return parts, _ending(parts), []


WALKS: dict[str, Callable[[bytes], Walk]] = {
    "mp4": iso, "riff": riff, "matroska": ebml, "flac": flac, "ogg": ogg, "ts": ts, "adts": adts, "mp3": mp3, "amr": amr,
}
_PARTS = "array<struct<kind:string,start:long,end:long>>"


def walk_media(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``(key, kind, size, parts, declared, found, skipped, verdict)`` of each file; ``skipped`` bytes lie in no packet, frame or page.

    Files of a format that is not known have no parts. The formats are told by the leading bytes.
    """
    small_batches(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, kind string, size long, parts {_PARTS}, declared long, found array<string>, skipped long"
    part_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not raw.is_valid:
                    rows.append((None, None, None, None, None))
                    continue
                data = raw.as_py()
                parts, declared, found = WALKS[name](data) if name in WALKS else ([], None, [])
                zero = bool(data) and not np.frombuffer(data, dtype=np.uint8).any()
                inside = sum(min(end, len(data)) - start for _, start, end in parts)
                skipped = len(data) - inside if name in ("ts", "adts", "mp3", "ogg") else 0
                shown = [{"kind": k, "start": a, "end": b} for k, a, b in parts]
                rows.append((len(data), shown, declared, ["zero_filled"] * zero + found, skipped))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), part_type, pa.int64(), pa.list_(pa.string()), pa.int64()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=[key, "kind", "size", "parts", "declared", "found", "skipped"])

    rows = files.select(key, media_format(F.col(content)).alias("kind"), F.col(content).cast("binary"))
    return rows.mapInArrow(walked, schema).withColumn("verdict", size_verdict(F.col("declared"), F.col("size")))
