"""ISO media containers: writing payloads as samples, and reading structure without decoding.

``container`` wraps a payload in ``ftyp``, ``moov`` and ``mdat`` boxes as one track of fixed-size
8-bit samples. ``describe`` walks the nested boxes of any such file, decodes its sample tables
(stsd, stts, stsc, stsz, stco/co64, stss) and yields, for each track, codec, duration and the byte range of every
key frame; payload bytes are located by the tables and never interpreted.

Cases: a null payload counts as empty and is padded to one sample. Truncated boxes, unknown
boxes and missing tables give what was found so far, never an error: counts are believed only as far as
there are bytes or samples for them, and places outside the file are no samples. Fragments (moof)
add their samples to the movie's tracks. Edit lists are not applied. Equal payloads give equal
files. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import small_batches, spread

SAMPLE_BYTES, SAMPLES_PER_CHUNK, KEY_EVERY, TIMESCALE, CODEC, FILLER = 576, 64, 32, 48_000, b"raw ", b"\xff"
#: Boxes of ISO/IEC 14496-12 that hold other boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}

MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, codec string, duration_s double, n_samples long, "
    "keyframes array<struct<start:long,end:long>>, "
    "tracks array<struct<codec:string,duration_s:double,n_samples:long,keyframes:array<struct<start:long,end:long>>>>, payload binary"
)


def padded(payload: bytes | None, unit: int = SAMPLE_BYTES) -> bytes:
    """The payload with bytes 255 appended up to a positive multiple of ``unit``."""
    payload = payload or b""
    return payload + FILLER * (max(1, -(-len(payload) // unit)) * unit - len(payload))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def container(payload: bytes, sample: int = SAMPLE_BYTES, per_chunk: int = SAMPLES_PER_CHUNK, key_every: int = KEY_EVERY) -> bytes:
    """A file with the payload's whole samples; its length must be a multiple of ``sample``."""
    n = len(payload) // sample
    chunks = -(-n // per_chunk)
    runs = [(1, per_chunk, 1)] if n % per_chunk == 0 else ([(1, per_chunk, 1)] if chunks > 1 else []) + [(chunks, n % per_chunk, 1)]
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = n * sample
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def movie(first: int) -> bytes:
        offsets = (np.arange(chunks) * (per_chunk * sample) + first).astype(">u8")
        keys = np.arange(1, n + 1, key_every, dtype=">u4")
        entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, sample)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", sample, n)),
            _full(b"co64", struct.pack(">I", chunks), offsets.tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, length, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables),
        )
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(8), bytes(8), matrix, bytes(8), flags=7)
        top = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, length, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", top, _box(b"trak", track, media))

    first = len(head) + len(movie(0)) + 16
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    return b"".join([head, movie(first), data, payload])


@dataclass
class Track:
    """What the tables of one track say."""

    codec: str = ""
    timescale: int = 0
    ticks: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    runs: list[tuple[int, int]] = field(default_factory=list)
    keys: np.ndarray | None = None
    # starts, ends and keys of the samples of each run of a fragment
    extra: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def starts(self) -> np.ndarray:
        """The file position of every sample whose chunk and size are known, of the movie first and then of its fragments."""
        per_chunk = np.zeros(len(self.offsets), np.int64)
        for k, (first, count) in enumerate(self.runs):
            last = self.runs[k + 1][0] - 1 if k + 1 < len(self.runs) else len(self.offsets)
            per_chunk[max(0, first - 1) : max(0, last)] = min(count, len(self.sizes))
        # no more chunks or samples than there are sizes
        ends = np.minimum(np.cumsum(np.minimum(per_chunk, len(self.sizes)), dtype=np.float64), len(self.sizes)).astype(np.int64)
        chunk = np.repeat(np.arange(len(self.offsets)), np.diff(ends, prepend=0))
        sizes = self.sizes[: len(chunk)]
        stops = np.cumsum(sizes)
        new = np.flatnonzero(np.diff(chunk, prepend=-1))
        before = stops - sizes
        return self.offsets[chunk] + before - np.repeat(before[new], np.diff(np.append(new, len(chunk))))

    def samples(self, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, whether a key frame) of the samples, with ``length`` of those that lie in a file of so many bytes."""
        starts = self.starts()
        keys = np.ones(len(starts), bool)
        if self.keys is not None:
            keys[:] = False
            keys[self.keys[(self.keys >= 1) & (self.keys <= len(starts))] - 1] = True
        ends = starts + self.sizes[: len(starts)]
        starts, ends, keys = (np.concatenate([a, *more]) for a, more in zip((starts, ends, keys), zip(*self.extra) if self.extra else ((),) * 3, strict=True))
        inside = (starts >= 0) & (ends >= starts) & (ends <= (length if length is not None else np.iinfo(np.int64).max))
        return starts[inside], ends[inside], keys[inside]

    def key_ranges(self, length: int | None = None) -> list[tuple[int, int]]:
        starts, ends, keys = self.samples(length)
        return list(zip(starts[keys].tolist(), ends[keys].tolist(), strict=True))


def boxes(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes that lie whole in data[lo:hi]."""
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1 and body + 8 <= hi:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        end = hi if size == 0 else lo + size
        if end > hi or end < body:
            return
        yield kind, body, end
        lo = end


def _array(data: bytes, kind: str, count: int, at: int, end: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    found = np.frombuffer(data, kind, max(0, min(count, (end - at) // width)), at)
    # places that no file reaches would turn negative
    return np.minimum(found.astype(np.uint64), np.uint64(1 << 61)).astype(np.int64)


#: Flags of track fragment headers and runs, and of a sample that is no key frame.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
RUN_OFFSET, FIRST_FLAGS, RUN_FIELDS, NO_KEY = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800), 0x10000
#: A place beyond any file.
FAR = 1 << 61


def describe(data: bytes) -> list[Track]:
    """The tracks of a file, in order, from its box structure alone.

    All runs of fragments together have no more samples without a table, nor more bytes in them, than the file has bytes.
    """
    tracks: list[Track] = []
    numbered: dict[int, list[Track]] = {}
    # a track's sample size and flags where a fragment is silent
    defaults: dict[int, tuple[int, int]] = {}
    left = {"samples": len(data), "bytes": len(data)}
    # the fragment that the walk is in: start of its moof, its track, and (base, size, flags, end of its last run)
    fragment: dict[str, int | Track | None] = {"moof": 0, "track": None}

    def table(kind: bytes, at: int, end: int) -> None:
        if end - at < 8 or not tracks:
            return
        track, count = tracks[-1], struct.unpack_from(">I", data, at + 4)[0]
        if kind == b"stsd" and end - at >= 16:
            track.codec = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"tkhd":
            place = at + (20 if data[at] == 1 else 12)
            if place + 4 <= end:
                numbered.setdefault(struct.unpack_from(">I", data, place)[0], []).append(track)
        elif kind == b"mdhd":
            wide = data[at] == 1
            if end - at >= (32 if wide else 20):
                track.timescale, track.ticks = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"stsz" and end - at >= 12:
            n = struct.unpack_from(">I", data, at + 8)[0]
            # a fixed size costs no table, so bound its count by what the file can hold
            track.sizes = np.full(min(n, len(data) // count), count, np.int64) if count else _array(data, ">u4", n, at + 12, end)
        elif kind in (b"stco", b"co64"):
            track.offsets = _array(data, ">u4" if kind == b"stco" else ">u8", count, at + 8, end)
        elif kind == b"stss":
            track.keys = _array(data, ">u4", count, at + 8, end)
        elif kind == b"stsc":
            rows = _array(data, ">u4", 3 * count, at + 8, end)
            track.runs = [(int(a), int(b)) for a, b in rows[: len(rows) // 3 * 3].reshape(-1, 3)[:, :2]]
        elif kind == b"trex" and end - at >= 24:
            size, flags = struct.unpack_from(">II", data, at + 16)
            defaults[count] = (size, flags)
        elif kind == b"tfhd":
            header(at, end, count)
        elif kind == b"trun":
            run(at, end, count)

    def header(at: int, end: int, number: int) -> None:
        flags, place = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, at + 8
        size, mark = defaults.get(number, (0, 0))
        fragment.update(track=numbered.get(number, [None])[0], base=fragment["moof"], size=size, flags=mark, done=None)
        for flag, name, width in ((BASE_OFFSET, "base", 8), (DESCRIPTION, "", 4), (DURATION, "", 4), (SIZE, "size", 4), (FLAGS, "flags", 4)):
            if flags & flag and place + width <= end:
                if name:
                    fragment[name] = int.from_bytes(data[place : place + width])
                place += width

    def run(at: int, end: int, count: int) -> None:
        track = fragment["track"]
        if track is None:
            return
        flags, place, first = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, at + 8, None
        start = fragment["base"] if fragment["done"] is None else fragment["done"]
        if flags & RUN_OFFSET and place + 4 <= end:
            start, place = fragment["base"] + struct.unpack_from(">i", data, place)[0], place + 4
        if flags & FIRST_FLAGS and place + 4 <= end:
            first, place = struct.unpack_from(">I", data, place)[0], place + 4
        present = [f for f in RUN_FIELDS if flags & f]
        size, flag = fragment["size"], fragment["flags"]
        # without a table every sample takes its default size, so the file bounds the count
        n = min(count, (end - place) // (4 * len(present)) if present else min(left["samples"], left["bytes"] // size if size else count))
        if not present:
            left.update(samples=left["samples"] - n, bytes=left["bytes"] - n * size)
        rows = np.frombuffer(data, ">u4", n * len(present), place).reshape(n, len(present)).astype(np.int64) if present else np.empty((n, 0), np.int64)
        sizes = rows[:, present.index(RUN_FIELDS[1])] if RUN_FIELDS[1] in present else np.full(n, size, np.int64)
        marks = rows[:, present.index(RUN_FIELDS[2])] if RUN_FIELDS[2] in present else np.full(n, flag, np.int64)
        if n and first is not None and RUN_FIELDS[2] not in present:
            marks[0] = first
        # places that no file reaches stay out of it
        ends = max(-FAR, min(FAR, start)) + np.cumsum(sizes)
        starts = ends - sizes
        inside = (starts >= 0) & (ends <= len(data))
        track.extra.append((starts[inside], ends[inside], marks[inside] & NO_KEY == 0))
        fragment["done"] = int(ends[-1]) if n else start

    # a stack, as boxes may nest as deep as the file is long
    todo = [boxes(data, 0, len(data))]
    while todo:
        found = next(todo[-1], None)
        if found is None:
            todo.pop()
            continue
        kind, at, end = found
        if kind == b"trak":
            tracks.append(Track())
        elif kind == b"moof":
            fragment.update(moof=at - 8, track=None)
        if kind in NESTED:
            todo.append(boxes(data, at, end))
        else:
            table(kind, at, end)
    return tracks


def to_media(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: the UTF-8 bytes of ``documents(doc_id, text)`` in a container each."""
    small_batches(documents.sparkSession, 256)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t or b"") for t in texts], pa.int64()),
                    pa.array([container(padded(t)) for t in texts], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "media"],
            )

    return spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))).mapInArrow(wrap, MEDIA)


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", _RANGES)]))


def seconds(track: Track) -> float | None:
    return track.ticks / track.timescale if track.timescale else None


def ranges(track: Track, data: bytes) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in track.key_ranges(len(data))]


def of_track(track: Track, data: bytes) -> dict[str, object]:
    return {"codec": track.codec, "duration_s": seconds(track), "n_samples": len(track.samples(len(data))[0]), "keyframes": ranges(track, data)}


def media_features(media: DataFrame, payload: bool = True) -> DataFrame:
    """Structure and digests of ``media(doc_id, n_bytes, media)``, read back through the sample tables.

    Digests and payload are those of the first track; ``tracks`` describes each. ``payload`` keeps the stored bytes as a column.
    """
    small_batches(media.sparkSession, 256)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = data or b""
                tracks = describe(data) or [Track()]
                track = tracks[0]
                starts, ends, _ = track.samples(len(data))
                # neighbouring samples are copied as one slice
                cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
                lows, highs = starts[np.r_[0, cut]] if len(starts) else [], ends[np.r_[cut - 1, len(ends) - 1]] if len(ends) else []
                body = b"".join(data[a:b] for a, b in zip(lows, highs, strict=True))
                rows.append(
                    (
                        name, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(data),
                        hashlib.sha256(data).hexdigest(), track.codec, seconds(track), len(starts),
                        ranges(track, data), [of_track(t, data) for t in tracks], body if payload else None,
                    )
                )
            kinds = [
                pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                pa.int64(), _RANGES, _TRACKS, pa.binary(),
            ]
            names = [f.split()[0] for f in FEATURES.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(features, FEATURES)
