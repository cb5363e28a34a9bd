import struct
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import media as M
from tessera.operators import containers as W
from tessera.operators.containers import walk_media


def box(kind, body, size=None):
    return struct.pack(">I4s", 8 + len(body) if size is None else size, kind) + body


WIDE = struct.pack(">I4sQ", 1, b"mdat", 16 + 5) + b"12345"
FTYP = box(b"ftyp", b"isom0000")
RIFF = b"RIFF" + struct.pack("<I", 4 + 24 + 8 + 300) + b"WAVEfmt " + struct.pack("<I", 16) + bytes(16) + b"data" + struct.pack("<I", 300) + b"x" * 300
CASES = {
    "whole": (FTYP + box(b"moov", b"m" * 9) + WIDE, "complete", [], ["ftyp", "moov", "mdat"]),
    "open": (FTYP + box(b"moov", b"m") + box(b"mdat", b"123", size=0), "complete", [], ["ftyp", "moov", "mdat"]),
    "cut": (FTYP + box(b"moov", b"m" * 9)[:-4], "truncated", ["atom_size_overflow"], ["ftyp", "moov"]),
    "no movie": (FTYP + WIDE, "complete", ["missing_moov"], ["ftyp", "mdat"]),
    "wav": (RIFF, "complete", [], ["fmt ", "data"]),
    "wav cut": (RIFF[:-7], "truncated", [], ["fmt ", "data"]),
    "wav more": (RIFF + b"tail", "oversized", ["wav_trailing_data"], ["fmt ", "data"]),
    "zeros": (b"\0" * 40, "unknown", ["zero_filled"], []),
    "empty": (b"", "unknown", [], []),
    "none": (None, "unknown", None, None),
}


@pytest.fixture(scope="module")
def checked(spark):
    rows = spark.createDataFrame([(k, None if c[0] is None else bytearray(c[0])) for k, c in CASES.items()], "name string, content binary")
    made = walk_media(rows, "name").join(rows, "name")
    out = made.select(
        "name", F.transform("parts", lambda b: b["kind"]).alias("kinds"), "found", "verdict", "parts", "kind",
        M.findings(F.col("kind"), F.col("content"), F.col("parts")).alias("expressed"),
        M.size_verdict(M.declared_size(F.col("kind"), F.col("content"), F.col("parts")), F.octet_length("content")).alias("said"),
    )
    return {r["name"]: r for r in out.collect()}


@pytest.mark.parametrize("name", CASES)
def test_structure(checked, name):
    _, verdict, found, kinds = CASES[name]
    row = checked[name]
    assert (row["verdict"], row["found"], row["kinds"]) == (verdict, found, kinds)
    if row["kind"] == "mp4" or name == "zeros":
        assert (row["said"], row["expressed"]) == (verdict, found)


def test_files_of_many_boxes_are_walked_whole():
    file = b"\0\0\0\x08ftyp" + b"\0\0\0\x08moof" * 700 + b"\0\0\0\x08moov"
    parts, declared, found = W.iso(file)
    assert [p[0] for p in parts] == ["ftyp", *["moof"] * 700, "moov"] and declared == len(file) and not found


def test_a_large_file_of_few_boxes_takes_no_time():
    file = FTYP + box(b"moov", b"m") + box(b"mdat", bytes(64 << 20))
    began = time.perf_counter()
    assert len(W.iso(file)[0]) == 3
    assert time.perf_counter() - began < 0.5


JUNK = bytes(range(1, 40))


def adts(body):
    n = 7 + len(body)
    return bytes([0xFF, 0xF1, 0x50, 0x80 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 0x1F, 0xFC]) + body


def test_frames_are_found_again_after_a_gap():
    packets = [b"\x47" + bytes([k] * 187) for k in range(8)]
    parts, declared, found = W.ts(b"".join(packets[:5]) + JUNK + b"\x47" + b"".join(packets[5:]))
    assert len(parts) == 8 and declared is None and not found and parts[5][1] == 5 * 188 + len(JUNK) + 1
    frames = [adts(bytes([k] * (50 + k))) for k in range(6)]
    parts, declared, found = W.adts(b"".join(frames[:3]) + b"\xff\x01" + JUNK + b"".join(frames[3:]))
    assert len(parts) == 6 and not found and declared == parts[-1][2]
    mpeg = [b"\xff\xfb\x90\x00" + bytes([k] * 413) for k in range(4)]
    parts, declared, found = W.mp3(b"ID3\3\0\0\0\0\0\x03abc" + JUNK + b"".join(mpeg))
    assert [p[0] for p in parts] == ["ID3", *["frame"] * 4] and not found and parts[1][1] == 13 + len(JUNK)
    page = lambda body: b"OggS\0" + bytes(21) + bytes([1, len(body)]) + body
    parts, declared, found = W.ogg(page(b"one") + b"Ogg" + page(b"three"))
    assert [b - a for _, a, b in parts] == [31, 33] and not found


def test_odd_headers():
    assert W.adts(b"\xff\xf1")[2] == ["header_too_short"] and W.adts(JUNK)[2] == ["aac_sync_failed"]
    assert W.adts(bytes([0xFF, 0xF1, 0x3C, 0x80, 1, 0x1F, 0xFC]) + b"x")[2] == ["aac_invalid_sample_rate"]
    assert W.mp3(b"ID3")[2] == ["id3_truncated"] and W.mp3(JUNK)[2] == ["mp3_sync_failed"]
    assert W.flac(b"fLaC")[2] == ["header_too_short"] and W.flac(b"fLaC\x84\0\0\x01xx")[2] == ["flac_missing_streaminfo"]
    assert W.ogg(b"OggS" + bytes(30))[2] == ["ogg_empty_page"] and W.ogg(b"OggS\1" + bytes(21) + b"\1\0")[2] == ["ogg_bad_version"]
    assert W.amr(b"#!AMR")[2] == ["amr_header_incomplete"] and len(W.amr(b"#!AMR-WB\n" + b"\x04" + bytes(17))[0]) == 1
    assert W.ebml(b"\x1a\x45\xdf\xa3\x80")[2] == ["missing_segment"] and W.ebml(b"\x18\x53\x80\x67\xff")[2] == ["missing_tracks"]
    # a segment of unknown length goes to the end, and so does what it holds
    parts, declared, found = W.ebml(b"\x1a\x45\xdf\xa3\x80\x18\x53\x80\x67\xff\x16\x54\xae\x6b\x82ab")
    assert [p[0] for p in parts] == ["1A45DFA3", W.SEGMENT, W.TRACKS] and declared == 17 and not found
    for walk in W.WALKS.values():
        for data in (b"", b"\0", b"\xff" * 300, b"RIFF", JUNK * 20, b"OggS" * 100, b"\x47" * 4_000):
            walk(data)


@pytest.mark.parametrize("piece", [b"\xff\xf1\x50\x80", b"\xff\xfb\x90\x00", b"OggS", b"\x47", b"\xff"])
def test_hostile_frames_take_time_in_proportion(piece):
    file = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    for walk in (W.adts, W.mp3, W.ogg, W.ts):
        walk(file)
    assert time.perf_counter() - began < 5
