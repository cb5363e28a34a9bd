"""The numbered queries over whole small tables, against direct computations in plain Python."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm.queries import BYTE_END, BYTE_TOKENIZER, ORACLE_SQL, QUERIES, WORD_END, WORD_TOKENIZER, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def token_ids(texts, name, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, end], "<u4") for d, t in texts.items()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1_ids_read_back(spark, texts):
    ids, start, expected = token_ids(texts, WORD_TOKENIZER, WORD_END), 0, {}
    for d in sorted(texts):
        expected[d] = (start, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        start += len(ids[d])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op1_bit_planes")} == expected


def test_op2_pieces_cover_every_id_with_little_padding(spark, texts):
    ids = token_ids(texts, BYTE_TOKENIZER, BYTE_END)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op2_packing"):
        d = r["doc_id"]
        assert r["doc_tokens"] == len(ids[d]) and r["ids_crc32"] == zlib.crc32(ids[d][r["start"] : r["start"] + r["length"]].tobytes())
        pieces[d].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, got in pieces.items():
        got.sort()
        assert got[0][0] == 0 and sum(n for _, n in got) == len(ids[d]) and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))
    assert set(pieces) == set(ids)
    for got in sequences.values():
        got.sort()
        assert got[0][0] == 0 and sum(got[-1]) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))
    least = math.ceil(sum(map(len, ids.values())) / 2048)
    assert len(sequences) <= 1.03 * least + 2


def test_op5_balance(spark, texts):
    got = rows(spark, "op5_ring_sharding")
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op6_payloads_read_back(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op6_media")}
    assert set(got) == set(texts)
    for d, t in texts.items():
        body = t.encode()
        body += b"\xff" * (max(1, -(-len(body) // 576)) * 576 - len(body))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))
        assert r["media_bytes"] > len(body) and r["feature"].startswith("raw;")


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_op8_base_spans(spark, texts):
    got = rows(spark, "op8_personal_data")
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(b.startswith(k) for b in base) for k in BASE]
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])


def test_op10_sources_come_near_their_targets(spark, texts):
    got = rows(spark, "op10_mixing")
    assert {r["doc_id"]: r["size"] for r in got} == {d: len(WORD.findall(t)) for d, t in texts.items()}
    by_source = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source[r["source"]].append(r)
    for group in by_source.values():
        assert {r["source_size"] for r in group} == {sum(r["size"] for r in group)}
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= 1
    assert sum(g[0]["target"] for g in by_source.values()) == pytest.approx(sum(r["size"] for r in got))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    frame = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == sorted(found.fetchall(), key=repr)
