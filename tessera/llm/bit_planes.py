"""Token ids as bit-plane shuffled, compressed blocks with a chunk index.

Documents are ordered by id, encoded, and their ids laid end to end. A *segment* is a file image
holding whole documents; inside it the ids are cut into blocks of a fixed number of ids, each
block is transposed into byte planes (or bit planes), each plane is compressed with zstandard,
and an index in the header gives the place of every plane, so any block can be read alone.
Segments are the rows of a Parquet table in the shared folder, which commits whole tasks and so
survives lost executors.

Segment layout, little-endian::

    magic 8s | kind u4 (0 byte, 1 bit planes) | block ids u4 | documents u4 | ids u8 | blocks u4 | planes u4
    documents x (ids u4) | blocks x planes x (offset u8, length u4) | compressed planes

Cases: a null text is an empty document and still gets the end id. Repeated ``doc_id`` rows stay
separate documents, ordered by text. A null ``doc_id`` sorts first. An empty table gives an empty
table. A document longer than a segment gets a segment of its own. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder
from tessera.runtime import parallelism, small_batches, stored

MAGIC = b"IDPLANE1"
_HEAD = struct.Struct("<8sIIIQII")
_PLACE = np.dtype([("offset", "<u8"), ("length", "<u4")])
#: Ids in one block, and ids after which a segment is closed.
BLOCK_IDS, SEGMENT_IDS = 1 << 16, 1 << 20

SEGMENTS = "shard int, segment int, shard_start long, n_ids long, n_docs long, first_doc long, last_doc long, doc_ids array<long>, image binary"
DOCUMENTS = "doc_id long, shard int, segment int, in_shard long, n_tokens long, ids binary"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Four byte planes, or 32 bit planes, of unsigned 32-bit ids."""
    octets = np.ascontiguousarray(ids.astype("<u4", copy=False)).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, k].tobytes() for k in range(4)]
    spread = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(spread[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        octets = np.packbits(spread, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def write_segment(lengths: list[int], ids: bytes, bits: bool = False, block_ids: int = BLOCK_IDS) -> bytes:
    """A segment image of documents with these lengths and, end to end, these ids."""
    flat = np.frombuffer(ids, "<u4")
    press = zstandard.ZstdCompressor(level=1)
    planes = [
        press.compress(plane) for at in range(0, len(flat), block_ids) for plane in to_planes(flat[at : at + block_ids], bits)
    ]
    width = 32 if bits else 4
    blocks = -(-len(flat) // block_ids)
    index = np.zeros(len(planes), _PLACE)
    index["length"] = [len(p) for p in planes]
    index["offset"] = np.concatenate([[0], np.cumsum(index["length"], dtype="u8")[:-1]]) if planes else []
    head = _HEAD.pack(MAGIC, int(bits), block_ids, len(lengths), len(flat), blocks, width)
    return b"".join([head, np.array(lengths, "<u4").tobytes(), index.tobytes(), *planes])


def read_segment(image: bytes, only_block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, ids) of an image; ids of one block only if asked for."""
    magic, bits, block_ids, documents, total, blocks, width = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a segment of id planes")
    lengths = np.frombuffer(image, "<u4", documents, _HEAD.size)
    at = _HEAD.size + 4 * documents
    index = np.frombuffer(image, _PLACE, blocks * width, at).reshape(blocks, width)
    body = memoryview(image)[at + index.nbytes :]
    expand = zstandard.ZstdDecompressor()
    parts = []
    for b in range(blocks) if only_block is None else [only_block]:
        n = min(block_ids, total - b * block_ids)
        planes = [expand.decompress(body[int(o) : int(o) + int(k)]) for o, k in index[b].tolist()]
        parts.append(from_planes(planes, n, bool(bits)))
    return lengths, np.concatenate(parts) if parts else np.empty(0, "<u4")


def write_ids(
    documents: DataFrame, tokenizer: str, end_id: int, bits: bool = False, block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS
) -> DataFrame:
    """Encode ``documents(doc_id, text)`` and return the stored table of segments, in id order.

    ``end_id`` follows each document. Shards are ranges of ``doc_id``; ``shard_start`` counts the
    shard's ids before the segment. One range shuffle of the texts is the only exchange.
    """
    spark = documents.sparkSession
    small_batches(spark)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal names, lengths, parts, held, segment, start
            image = write_segment(lengths, b"".join(parts), bits, block_ids)
            row = pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                    "shard_start": pa.array([start], pa.int64()), "n_ids": pa.array([held], pa.int64()),
                    "n_docs": pa.array([len(names)], pa.int64()), "first_doc": pa.array([names[0]], pa.int64()),
                    "last_doc": pa.array([names[-1]], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())),
                    "image": pa.array([image], pa.binary()),
                }
            )
            segment, start = segment + 1, start + held
            names, lengths, parts, held = [], [], [], 0
            return row

        for batch in batches:
            ids = batch.column(0).to_pylist()
            encoded = encoder(tokenizer).batch(batch.column(1).to_pylist())
            for name, got in zip(ids, encoded, strict=True):
                n = len(got) // 4 + 1
                if names and held + n > segment_ids:
                    yield close()
                names.append(name)
                lengths.append(n)
                parts += [got, end]
                held += n
        if names:
            yield close()

    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(parallelism(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(encode, SEGMENTS), "id-planes", codec="uncompressed")


def read_ids(segments: DataFrame) -> DataFrame:
    """Documents of stored segments: doc_id, start (ids of all documents before it), n_tokens, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, ids = read_segment(row["image"])
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                for lo in range(0, len(lengths), 512):
                    hi = min(lo + 512, len(lengths))
                    first = int(begins[lo])
                    raw = ids[first : int(ends[hi - 1])].tobytes()
                    bounds = 4 * (np.append(begins[lo:hi], ends[hi - 1]) - first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["doc_ids"][lo:hi], pa.int64()),
                            pa.array([row["shard"]] * (hi - lo), pa.int32()),
                            pa.array([row["segment"]] * (hi - lo), pa.int32()),
                            pa.array(row["shard_start"] + begins[lo:hi], pa.int64()),
                            pa.array(lengths[lo:hi], pa.int64()),
                            pa.array([raw[int(a) : int(b)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "shard", "segment", "in_shard", "n_tokens", "ids"],
                    )

    spark = segments.sparkSession
    # one row for each shard, that is for each write task: small however many documents there are
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    small_batches(spark)
    rows = segments.select("shard", "segment", "shard_start", "doc_ids", "image").mapInArrow(decode, DOCUMENTS)
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "shard", "segment", "ids"
    )
