import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bit_planes import from_planes, read_ids, read_segment, to_planes, write_ids, write_segment
from tessera.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = [
    "a \n b", "a  b", "  ", "\n\n x", " 's it's  \n", "don't 12 34!! ¼½ <|endoftext|> a", "é́ é ́a b", "", None, "x <|startoftext|>y",
    "Σας ΣΑΣ ΑΣ\nb\t c", "word.Word,word-word_word", "***%%% &&&.\n\n\nEnd.", "ﬁ ǅ İstanbul ẞ", "a b  c", "日本語 テキスト", "x" * 300,
    "tail ", "\x1ca.\x1cb", "≮ a", "'re 're're",
]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cut_texts_give_the_ids_of_whole_texts(path):
    plain = Tokenizer.from_file(path)
    encoder = Encoder(path, remembered=5)
    for _ in range(2):  # the second time from memory
        got = encoder.batch(TEXTS)
        for text, ids in zip(TEXTS, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 100])
def test_planes_and_segments_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (from_planes(to_planes(ids, bits), n, bits) == ids).all()
    lengths = [n // 3, n - n // 3]
    image = write_segment(lengths, ids.tobytes(), bits, block_ids=16)
    got_lengths, got = read_segment(image)
    assert got_lengths.tolist() == lengths and (got == ids).all()
    if n > 32:
        assert (read_segment(image, only_block=1)[1] == ids[16:32]).all()


def test_foreign_bytes_are_refused():
    with pytest.raises(ValueError):
        read_segment(b"\0" * 64)


@pytest.mark.parametrize("segment_ids", [8, 1 << 20])
def test_documents_come_back_in_order(documents, segment_ids):
    plain = Tokenizer.from_file(WORD)
    got = read_ids(write_ids(documents, WORD, 2, block_ids=64, segment_ids=segment_ids)).collect()
    expected = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in documents.select("doc_id", "text").collect()])
    at = 0
    for row, (known, doc_id, text) in zip(sorted(got, key=lambda r: r["start"]), expected, strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id if known else None, at, len(ids))
        assert zlib.crc32(row["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table(empty):
    assert read_ids(write_ids(empty, WORD, 2)).count() == 0
