import hashlib
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.llm.warc import assemble, mark_revisits, parse, read_records, record, write_archives

BIG = "<html>" + "é" * 60 + "</html>"
ROWS = [
    (3, "http://a/3", BIG), (7, "http://a/7", BIG), (5, None, BIG), (4, "http://a/4", "short"), (6, "http://a/6", "short"), (8, "x\r\ny: z", None),
    (9, "http://a/9", "WARC/1.1\r\n\r\n" * 400), (None, "http://none", BIG), (3, "http://a/3", BIG), (10, "http://a/10", "<p>" + "long " * 400_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "payload": F.lit("y"), "type": F.lit("z")})


def expected():
    out = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        least = min((p for p, _, h in ROWS if h == html and p is not None), default=None) if len(body) >= 100 else page
        kind = "response" if page == least or len(body) < 100 else "revisit"
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), kind, least if kind == "revisit" else None))
    return sorted(out, key=repr)


def test_captures_match_brute_force(pages):
    archives = write_archives(pages, archive_bytes=4096)
    records = read_records(archives)
    got = assemble(records)
    rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()]
    assert sorted(rows, key=repr) == expected()
    for r in got.collect():
        assert r["request"]["record_id"] != r["metadata"]["record_id"] and r["response"]["archive"]
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload"] is None
    assert records.count() == 3 * len(ROWS)
    assert {r["target"] for r in got.select("target").collect()} >= {"", "x%0D%0Ay: z"}


def test_records_stand_alone_in_an_image(pages):
    for row in write_archives(pages, archive_bytes=4096).collect():
        image = bytes(row["image"])
        found = list(parse(image))
        for (offset, fields, block), following in zip(found, [*found[1:], (len(image), {}, b"")], strict=True):
            alone = list(parse(image[offset : following[0]]))
            assert len(alone) == 1 and alone[0][1:] == (fields, block)
            uuid.UUID(fields["warc-record-id"][10:-1])


def test_damage_is_an_error():
    image = record([("WARC-Type", "metadata")], b"x" * 50)
    with pytest.raises(ValueError):
        list(parse(image[:-5]))


def test_copies_refer_to_the_smallest(pages):
    marks = {(r["page_id"], r["url"]): r["refers_to"] for r in mark_revisits(pages).select("page_id", "url", "refers_to").collect()}
    assert marks[(7, "http://a/7")] == 3 and marks[(3, "http://a/3")] is None and marks[(4, "http://a/4")] is None and marks[(None, "http://none")] == 3


def test_empty_table(pages):
    assert assemble(read_records(write_archives(pages.limit(0)))).count() == 0


def test_revisits_name_their_response_by_the_standard_fields(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3", BIG), (4, "http://b/4", BIG + "x"), (4, "http://b/4", BIG + "x"), (9, "http://b/9", BIG + "x")]
    found = read_records(write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    by_id = {r["record_id"]: r for r in found}
    assert len(by_id) == 3 * len(rows)
    revisits = [r for r in found if r["type"] == "revisit"]
    assert len(revisits) == 3
    for r in revisits:
        assert r["headers"]["warc-profile"].endswith("identical-payload-digest") and r["headers"]["warc-refers-to-date"]
        if r["target"] == "http://b/9":
            # two rows are its first page: neither is named
            assert r["refers_to"] is None and r["headers"]["warc-refers-to-target-uri"] == "http://b/4"
        else:
            first = by_id[r["refers_to"]]
            assert first["type"] == "response" and first["target"] == r["headers"]["warc-refers-to-target-uri"] == "http://a/1"


def test_block_digests_hold(pages):
    for row in write_archives(pages).collect():
        for _, fields, block in parse(bytes(row["image"])):
            assert fields["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()


def test_reading_takes_time_in_proportion():
    one = record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:x>")], b"GET / HTTP/1.1\r\n\r\n")

    def seconds(n):
        start = time.perf_counter()
        assert sum(1 for _ in parse(one * n)) == n
        return time.perf_counter() - start

    seconds(500)
    assert seconds(40_000) < 30 * max(seconds(4_000), 0.02)
