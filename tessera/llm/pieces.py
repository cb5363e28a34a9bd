"""SentencePiece ids of whole texts, each piece with its bytes in the source.

A text is normalised here, by the model's own compiled character map: at each place the longest
key that the text goes on with is replaced, and every byte of the result remembers the source byte
where its character began. The result is cut where no piece of the model goes on: before each word mark that
follows another character, and between a letter and a character that stands beside a letter in no piece (a model with pieces
across word marks is encoded uncut). Each word is segmented once by the sentencepiece library, under a copy of the model that normalises nothing,
and then remembered. Piece lengths, summed up, are places in the normalised text, and the
remembered source places at these are the bounds of the pieces: piece ``k`` has the source bytes
``bounds[k]`` to ``bounds[k + 1]``. Bounds never fall back; they leave out only blanks that the
model strips at the ends. Of the byte pieces of one character the last one has its bytes.

Cases: null and empty texts have no pieces and one bound, 0. Texts of any length are encoded whole, repeated
rows are kept, other columns are ignored, an empty table gives an empty table. Models with
user-defined symbols or word marks behind words are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import small_batches, spread

#: Words remembered by one Python worker, and the longest that is remembered, in characters; this bounds the memory.
REMEMBERED, LONGEST = 400_000, 40
#: Bytes of texts that are encoded at once, unless one is longer.
AT_ONCE = 4 << 20
#: The mark that stands for a blank in pieces.
MARK = "▁"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_BLANK = 0x20
#: Kinds of pieces in a model file.
_UNKNOWN, _USER_DEFINED, _BYTE = 2, 4, 6


def character_map(blob: bytes) -> dict[str, bytes]:
    """Keys and replacements of a compiled character map: the size of a double-array trie, its units, then strings that end in zero."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, strings = np.frombuffer(blob[4 : 4 + size], dtype="<u4").astype(np.int64), blob[4 + size :]
    # a unit: its label (and bit 31 of values), whether a value hangs below (bit 8), and how far its children are
    labels, valued = units & 0x800000FF, (units >> 8) & 1
    ahead = (units >> 10) << ((units & 0x200) >> 6)
    octets, found = np.arange(1, 256), {}
    todo = [(b"", int(ahead[0]))]
    while todo:
        key, base = todo.pop()
        places = base ^ octets
        inside = places < len(units)
        for octet in octets[inside][labels[places[inside]] == octets[inside]].tolist():
            at = base ^ octet
            below = at ^ int(ahead[at])
            longer = key + bytes([octet])
            if valued[at]:
                start = int(units[below]) & 0x7FFFFFFF
                found[longer.decode()] = strings[start : strings.index(0, start)]
            todo.append((longer, below))
    return found


class Normaliser:
    """The normalisation of one model, with the source place of each byte of the result."""

    def __init__(self, spec):
        self._map = character_map(spec.precompiled_charsmap)
        self._longest = max(map(len, self._map), default=0)
        self._prefix, self._strip, self._escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        # a key can only begin at one of these characters, a longer one only with one of those behind
        alone = "".join(map(re.escape, sorted({k for k in self._map if len(k) == 1})))
        first, second = ("".join(map(re.escape, sorted({k[at] for k in self._map if len(k) > 1}))) for at in (0, 1))
        ways = ([f"[{alone}]"] if alone else []) + ([f"[{first}](?=[{second}])"] if first else [])
        self._begins = re.compile("|".join(ways)) if ways else None

    def _replaced(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        octets = np.frombuffer(raw, dtype=np.uint8)
        starts = np.where((octets & 0xC0) != 0x80, np.arange(len(octets)), 0)
        places = np.maximum.accumulate(starts) if len(starts) else starts
        if self._begins is None:
            return raw, places
        text = raw.decode()
        chars = np.append(np.flatnonzero((octets & 0xC0) != 0x80), len(octets))
        parts, where, done, at = [], [], 0, 0
        while found := self._begins.search(text, at):
            start = found.start()
            for length in range(min(self._longest, len(text) - start), 0, -1):
                new = self._map.get(text[start : start + length])
                if new is not None:
                    lo, hi = int(chars[start]), int(chars[start + length])
                    parts += [raw[done:lo], new]
                    where += [places[done:lo], np.full(len(new), lo)]
                    done, at = hi, start + length
                    break
            else:
                at = start + 1
        return b"".join([*parts, raw[done:]]), np.concatenate([*where, places[done:]])

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and for the end, its place in ``raw``."""
        body, places = self._replaced(raw)
        octets, end = np.frombuffer(body, dtype=np.uint8), len(raw)
        if self._strip:
            blank = octets == _BLANK
            kept = ~(blank & np.append(True, blank[:-1])) if len(blank) else blank
            if kept.any() and blank[last := int(np.flatnonzero(kept)[-1])]:
                kept[last], end = False, int(places[last])
            octets, places = octets[kept], places[kept]
            body = octets.tobytes()
        if not body:
            return b"", np.zeros(1, dtype=np.int64)
        if self._prefix:
            body, places = b" " + body, np.append(places[0], places)
        if self._escape:
            wide = np.where(np.frombuffer(body, dtype=np.uint8) == _BLANK, len(MARK.encode()), 1)
            body, places = body.replace(b" ", MARK.encode()), np.repeat(places, wide)
        return body, np.append(places, end)


def word_pattern(pieces: list[str]) -> re.Pattern:
    """Cuts a normalised text into parts that no piece goes across."""
    beside = set("".join(re.findall(f"[{_LETTER}]([^{_LETTER}])", "\0".join(pieces)) + re.findall(f"([^{_LETTER}])(?=[{_LETTER}])", "\0".join(pieces))))
    others = "".join(re.escape(c) for c in map(chr, [0x0A, *range(0x21, 0x7F)]) if c not in beside and not re.match(f"[{_LETTER}]", c))
    apart = f"{MARK}*+[{_LETTER}]++(?=[{others}{MARK}]|\\Z)|{MARK}*+[{others}]++(?=[{_LETTER}{MARK}]|\\Z)|" if others else ""
    return re.compile(f"{apart}{MARK}*+[^{MARK}]++|{MARK}++")


class PieceEncoder:
    """Ids and source bounds of whole texts under one model."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.whole = SentencePieceProcessor(model_proto=model)
        own = proto.ModelProto.FromString(model)
        if own.trainer_spec.treat_whitespace_as_suffix or any(p.type == _USER_DEFINED for p in own.pieces):
            raise ValueError("models with user-defined symbols or marks behind words are not supported")
        self._normalise = Normaliser(own.normalizer_spec)
        self._lengths = np.array([1 if p.type == _BYTE else len(p.piece.encode()) for p in own.pieces], dtype=np.int32)
        self._unknown = next(k for k, p in enumerate(own.pieces) if p.type == _UNKNOWN)
        names = [p.piece for p in own.pieces if p.type != _BYTE]
        self._words = None if any(MARK in n.lstrip(MARK) for n in names) else word_pattern(names)
        own.normalizer_spec.CopyFrom(
            proto.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=True)
        )
        self._plain = SentencePieceProcessor(model_proto=own.SerializeToString())
        self._known: dict[str, bytes] = {}
        self._remembered = remembered

    def _segment(self, words: list[str]) -> list[bytes]:
        """Pairs of id and length of each word's pieces."""
        found = self._plain.encode(words, num_threads=1)
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32)
        pairs = np.stack([ids, self._lengths[ids]], axis=1)
        ends = np.cumsum([0, *map(len, found)])
        if (ids == self._unknown).any():
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(ids == self._unknown), side="right") - 1).tolist():
                own, names = ids[ends[k] : ends[k + 1]], self._plain.encode(words[k], out_type=str)
                unknown = own == self._unknown  # as long as what it stands for
                pairs[ends[k] : ends[k + 1], 1][unknown] = np.array([len(n.encode()) for n in names])[unknown]
        raw = pairs.tobytes()
        return [raw[8 * a : 8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def batch(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(ids, bounds)`` of each text; None counts as an empty text."""
        made = [self._normalise(t or b"") for t in texts]
        cut = [self._words.findall(body.decode()) if self._words else [body.decode()] if body else [] for body, _ in made]
        known = self._known
        new = list(set().union(*cut).difference(known))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(zip(part, self._segment(part), strict=True))
        out = []
        for words, (body, places) in zip(cut, made, strict=True):
            ids, lengths = np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32).reshape(-1, 2).T
            ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
            if ends[-1] != len(body):
                raise RuntimeError("the pieces do not make up the normalised text")
            out.append((ids, places[ends].astype(np.int32)))
        for word in new if len(known) > self._remembered else [w for w in new if len(w) > LONGEST]:
            del known[word]
        return out


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each model file and Python worker."""
    with open(path, "rb") as file:
        return PieceEncoder(file.read())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))


def _portions(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text or b"") > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or b"")
    yield part


def encode_pieces(documents: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """``(doc_id, ids, bounds)`` of ``documents(doc_id, text)`` under the model file at ``path``, in one pass.

    With ``decode`` also the library's text of the ids, as ``decoded``.
    """
    small_batches(documents.sparkSession)
    names = ["doc_id", "ids", "bounds", *["decoded"] * decode]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(path)
        for batch in batches:
            done = 0
            for part in _portions([t.as_py() for t in batch.column(1)]) if batch.num_rows else ():
                ids, bounds = zip(*own.batch(part), strict=True)
                columns = [batch.column(0).slice(done, len(part)), _lists(ids), _lists(bounds)]
                if decode:
                    columns.append(pa.array([own.whole.decode(x.tolist()) if len(x) else "" for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done += len(part)

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return spread(rows).mapInArrow(encode, f"doc_id long, ids array<int>, bounds array<int>{', decoded string' * decode}")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with the library's text of each row's ids as ``decoded``."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(path).whole
        for batch in batches:
            found = [own.decode(x) if x else "" for x in (i.as_py() for i in batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, ids array<int>, decoded string")
