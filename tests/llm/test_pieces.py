import hashlib
from functools import lru_cache

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from tessera.llm.pieces import PieceEncoder, character_map, decode_pieces, encode_pieces
from tessera.llm.queries import PIECE_MODEL, op13_pieces, tokenizer_path

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", " ", "   ", "a", " a", "a ", "  two  blanks ", "▁mark", "a▁b ▁ c", "tab\tand\nline\r\n", "日本語テキスト 🙂🙂", "ﬁne ｗｉｄｅ ½ Å á é̂",
    " no break　wide", "​zero​", "<s> </s> <unk> <0x41>", "¨ umlaut ¨", "x" * 3000, "word " * 2000, "\x00\x01 \x7f", "가각 가", "don't 12 3.4",
]


@pytest.fixture(scope="module")
def model():
    with open(tokenizer_path(PIECE_MODEL), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def mapped(model):
    """The same pieces behind a compiled character map that also strips blanks."""
    own = proto.ModelProto.FromString(model)
    rules = proto.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).normalizer_spec
    own.normalizer_spec.CopyFrom(rules)
    own.normalizer_spec.add_dummy_prefix = own.normalizer_spec.remove_extra_whitespaces = True
    return own.SerializeToString()


@lru_cache
def encoders(bytes_of_model):
    return PieceEncoder(bytes_of_model), sentencepiece.SentencePieceProcessor(model_proto=bytes_of_model)


def compare(bytes_of_model, texts):
    own, library = encoders(bytes_of_model)
    for text, (ids, bounds) in zip(texts, own.batch([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text), text
        found = library.encode(text, out_type="proto").pieces
        raw = text.encode()
        spans = [(p.begin, p.end) for p in found]
        assert list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) == spans, text
        assert b"".join(raw[a:b] for a, b in spans) == raw[int(bounds[0]) : int(bounds[-1])]


def test_ids_and_spans_are_the_librarys(model):
    compare(model, TEXTS)


def test_character_map_is_applied_as_the_library_does(mapped):
    compare(mapped, TEXTS)


def test_compiled_map_has_its_longest_keys(mapped):
    table = character_map(proto.ModelProto.FromString(mapped).normalizer_spec.precompiled_charsmap)
    assert table["ﬁ"] == b"fi" and table["　"] == b" " and table["​"] in (b"", b" ")
    assert table["é"] == "é".encode() and max(map(len, table)) > 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab ▁\ń ﬁ½語🙂é가.")), max_size=30), min_size=1, max_size=4))
def test_any_text(model, mapped, texts):
    compare(model, texts)
    compare(mapped, texts)


def test_unknown_characters_without_byte_pieces(model):
    own = proto.ModelProto.FromString(model)
    own.trainer_spec.byte_fallback = False
    for piece in own.pieces:
        if piece.type == 6:
            piece.type = 1
    compare(own.SerializeToString(), ["a 🙂🙂 b", "語🙂", "plain"])


def test_unsupported_models_are_refused(model):
    own = proto.ModelProto.FromString(model)
    own.pieces[500].type = 4
    with pytest.raises(ValueError):
        PieceEncoder(own.SerializeToString())


def test_words_are_forgotten_beyond_the_bound(model):
    own = PieceEncoder(model, remembered=3)
    assert own.batch([b"some words of a text"])[0][0].tolist() == own.batch([b"some words of a text"])[0][0].tolist()
    assert len(own._known) <= 3


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = op13_pieces(spark, SF).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row["doc_id"]])
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), digest(",".join(map(str, ids))))
        assert row["decoded_sha256"] == digest(library.decode(ids) if ids else "")
        assert row["n_bytes"] == len(texts[row["doc_id"]].encode())


def test_odd_rows(spark, documents, empty):
    path = tokenizer_path(PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = decode_pieces(encode_pieces(documents, path), path).collect()
    expected = [(r["doc_id"], library.encode(r["text"] or "")) for r in documents.collect()]
    assert sorted(map(repr, ((r["doc_id"], r["ids"]) for r in found))) == sorted(map(repr, expected))
    assert {r["decoded"] for r in found if not r["ids"]} == {""}
    assert encode_pieces(empty, path).count() == 0
