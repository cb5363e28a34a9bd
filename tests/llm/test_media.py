import hashlib
import struct
import time
import zlib

import pytest

from tessera.llm.media import container, describe, media_features, padded, to_media


@pytest.mark.parametrize("n", [0, 1, 576, 577, 576 * 64, 576 * 65, 576 * 200 + 3])
def test_payload_is_found_by_the_tables(n):
    payload = padded(bytes(k % 251 for k in range(n)))
    file = container(payload)
    (track,) = describe(file)
    starts = track.starts().tolist()
    assert b"".join(file[s : s + 576] for s in starts) == payload
    assert track.codec == "raw " and track.ticks == len(payload)
    keys = track.key_ranges()
    assert keys[0] == (starts[0], starts[0] + 576) and len(keys) == -(-len(starts) // 32)


def test_variable_samples_small_offsets_and_strange_boxes():
    def box(kind, body):
        return struct.pack(">I4s", 8 + len(body), kind) + body

    stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1) + box(b"avc1", bytes(8)))
        + box(b"stsz", struct.pack(">IIIIII", 0, 0, 3, 5, 7, 9)) + box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 2, 1))
        + box(b"stco", struct.pack(">IIII", 0, 2, 100, 200)) + box(b"stss", struct.pack(">IIII", 0, 2, 1, 3)))
    file = box(b"free", b"xx") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl)))) + b"\0\0"
    (track,) = describe(file)
    assert track.codec == "avc1" and track.starts().tolist() == [100, 105, 200] and track.key_ranges() == [(100, 105), (200, 209)]


@pytest.mark.parametrize("cut", range(0, 700, 23))
def test_truncated_files_never_fail(cut):
    describe(container(padded(b"abc"))[:cut])


def test_documents(documents):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media_features(to_media(documents)).collect()}
    for r in documents.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = padded(raw)
        row = got[(r["doc_id"], hashlib.sha256(payload).hexdigest())]
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert row["payload"] == payload and row["media_sha256"] == hashlib.sha256(container(payload)).hexdigest()


def test_empty_table(empty):
    assert media_features(to_media(empty)).count() == 0


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def movie(*tables, number=1):
    head = box(b"tkhd", struct.pack(">IIII", 0, 0, 0, number))
    return box(b"trak", head, box(b"mdia", box(b"minf", box(b"stbl", *tables))))


def test_hostile_tables_never_fail(spark):
    stsz = box(b"stsz", struct.pack(">III", 0, 4, 3))
    wide = box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 0xFFFFFFFF, 1))
    many = box(b"stco", struct.pack(">IIII", 0, 2, 20, 40))
    far = box(b"co64", struct.pack(">IIQQ", 0, 2, (1 << 63) + 5, (1 << 64) - 1))
    nested = b""
    for _ in range(3_000):
        nested = box(b"moov", nested)
    files = [
        box(b"moov", movie(stsz, wide, many)), box(b"moov", movie(stsz, wide, far)), nested, None, b"", b"\0" * 100,
        box(b"moov", movie(stsz, box(b"stsc", struct.pack(">IIIIIIII", 0, 2, 9, 9, 1, 1, 2, 1)), many)),
        box(b"moov", movie(box(b"stsz", struct.pack(">III", 0, 1, 0xFFFFFFFF)), wide, box(b"stco", struct.pack(">II", 0, 0xFFFFFFFF)))),
    ]
    rows = spark.createDataFrame([(k, 0, f) for k, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media_features(rows).collect()}
    assert len(got) == len(files)
    assert [tuple(k) for k in got[0]["keyframes"]] == [(20, 24), (24, 28), (28, 32)] and got[0]["payload_bytes"] == 12
    assert got[1]["n_samples"] == 0 and got[1]["payload_bytes"] == 0


def test_all_tracks_and_fragments():
    """A movie of two tracks without samples, and a fragment with a run of each."""
    stsd = lambda codec: box(b"stsd", struct.pack(">II", 0, 1), box(codec, bytes(8)))
    trex = box(b"trex", struct.pack(">IIIIII", 0, 2, 1, 10, 7, 0x10000))
    moov = box(b"moov", movie(stsd(b"avc1"), number=1), movie(stsd(b"mp4a"), number=2), box(b"mvex", trex))
    ftyp = box(b"ftyp", b"isom")

    def moof(first, second):
        one = box(b"traf", box(b"tfhd", struct.pack(">II", 0x020000, 1)), box(b"trun", struct.pack(">IIiIII", 0x205, 2, first, 0, 5, 6)))
        two = box(b"traf", box(b"tfhd", struct.pack(">II", 0x020000, 2)), box(b"trun", struct.pack(">IIi", 0x1, 2, second)))
        return box(b"moof", one, two)

    size = len(moof(0, 0))
    file = ftyp + moov + moof(size + 8, size + 8 + 11) + box(b"mdat", bytes(11 + 14))
    video, sound = describe(file)
    at = len(ftyp) + len(moov) + size + 8
    assert (video.codec, sound.codec) == ("avc1", "mp4a")
    assert list(zip(*[x.tolist() for x in video.samples(len(file))], strict=True)) == [(at, at + 5, True), (at + 5, at + 11, True)]
    assert list(zip(*[x.tolist() for x in sound.samples(len(file))], strict=True)) == [(at + 11, at + 18, False), (at + 18, at + 25, False)]


@pytest.mark.parametrize("size", [0, 1, 10])
def test_many_runs_without_tables_are_bounded_together(size):
    """Four hundred runs that each claim every byte of the file: no more samples in all than bytes, and no time."""
    moov = box(b"moov", movie(number=1), box(b"mvex", box(b"trex", struct.pack(">IIIIII", 0, 1, 1, 0, size, 0))))
    runs = [box(b"trun", struct.pack(">III", 1, 0xFFFFFFFF, 0)) for _ in range(400)]
    file = moov + box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0, 1)), *runs)) + bytes(20_000)
    began = time.perf_counter()
    (track,) = describe(file)
    assert time.perf_counter() - began < 0.5
    assert 0 < len(track.samples(len(file))[0]) <= len(file)


def test_many_tracks_and_headers_take_time_in_proportion():
    moov = box(b"moov", *[movie(number=k % 5) for k in range(3_000)], box(b"mvex", *[box(b"trex", struct.pack(">IIIIII", 0, 4, 1, 0, 9, 0))] * 3_000))
    heads = box(b"moof", *[box(b"traf", box(b"tfhd", struct.pack(">II", 0, 4)))] * 3_000)
    began = time.perf_counter()
    assert len(describe(moov + heads)) == 3_000
    assert time.perf_counter() - began < 2
