"""WARC archives of pages: writing records, reading them back, and joining them into captures.

Each page becomes a request, a response or revisit, and a metadata record, each compressed on its
own and laid end to end in archive images of a few megabytes, which are the rows of a Parquet
table in the shared folder. A page whose payload equals that of a page with a smaller id, and is
long enough, is a revisit of the one with the smallest id. Reading walks the records of an image;
requests and metadata are then joined to their response by their concurrent-to identifiers.

Cases: a null html is an empty payload; a null url an empty target. Rows with equal page_id and
equal payload all count as the smallest, and all are responses. A null page_id never is the
smallest unless all are null, and then none is a revisit. Where several rows are the first page, revisits give its target, not its record. An empty table gives an empty table.
Other columns are ignored. Truncated archives are an error; records without a response make no
capture.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import small_batches, stored

#: Payloads shorter than this are always stored; bytes after which an archive image is closed.
LEAST_PAYLOAD, ARCHIVE_BYTES = 100, 4 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID(int=0)

RECORD = (
    "archive string, offset long, record_id string, type string, concurrent_to string, refers_to string, target string, "
    "page_id long, first_page long, payload_digest string, payload_bytes long, headers map<string,string>, payload binary, block binary"
)


def mark_revisits(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``pages(page_id, url, html)`` with payload, digest, and the page it revisits, with its url, or null.

    ``single`` tells whether the page visited first has one row only, so that its record can be named.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long_ones = rows.where(F.octet_length("payload") >= least).select("page_id", "url", F.col("digest").alias("_digest"))
    # null ids are no candidates for the first
    least_row = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    firsts = long_ones.groupBy("_digest", "page_id").agg(least_row.alias("row"), F.count("*").alias("rows"))
    firsts = firsts.groupBy("_digest").agg(F.min("row").alias("_first"), F.min_by("rows", "page_id").alias("_rows"), F.sum("rows").alias("_n"))
    joined = rows.join(firsts.where("_n > 1"), rows["digest"] == F.col("_digest"), "left")
    again = ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(again, F.col("_first.page_id")).alias("refers_to"), F.when(again, F.col("_first.url")).alias("first_url"),
        F.coalesce(F.col("_rows") == 1, F.lit(True)).alias("single"),
    )


def record_name(kind: str, page_id: int | None, digest: str, at: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {page_id} {digest} {at}')}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One compressed record."""
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def capture_records(
    page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, first_url: str | None, single: bool, at: str
) -> list[bytes]:
    """Request, response or revisit, and metadata of one page. ``at`` tells repeated rows apart.

    A revisit names the record that it refers to, with its target and date; the record's name is left out where repeated
    rows share it. A first page of one row is named by its id and digest alone, so that others can name it.
    """
    target = one_line(url)
    if refers_to is None and single:
        at = ""
    me = record_name("response", page_id, digest, at)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    answer = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", me), *common,
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    note = f"page_id: {'' if page_id is None else page_id}\r\n"
    if refers_to is not None:
        answer += [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", one_line(first_url or "")), ("WARC-Refers-To-Date", DATE)]
        answer += [("WARC-Refers-To", record_name("response", refers_to, digest, ""))] if single else []
        note += f"same_payload_as_page: {refers_to}\r\n"
    get = f"GET {target} HTTP/1.1\r\n\r\n".encode()
    return [
        record(
            [("WARC-Type", "request"), ("WARC-Record-ID", record_name("request", page_id, digest, at)), *common, ("WARC-Concurrent-To", me),
             ("Content-Type", "application/http; msgtype=request")], get,
        ),
        record(answer, http + payload if refers_to is None else http),
        record(
            [("WARC-Type", "metadata"), ("WARC-Record-ID", record_name("metadata", page_id, digest, at)), *common, ("WARC-Concurrent-To", me),
             ("Content-Type", "application/warc-fields")], note.encode(),
        ),
    ]


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The stored table ``(archive, image)`` of the pages' records."""
    small_batches(pages.sparkSession, 256)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, row, parts, held = TaskContext.get().partitionId(), 0, 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{task:06d}-{n:06d}.warc.gz"], "image": [b"".join(parts)]})

        for batch in batches:
            for page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                records = capture_records(*page, at=f"{task}-{row}")
                parts += records
                held, row = held + sum(map(len, records)), row + 1
                if held >= archive_bytes:
                    yield close()
                    parts, held, n = [], 0, n + 1
        if parts:
            yield close()

    return stored(mark_revisits(pages).mapInArrow(write, "archive string, image binary"), "archives", codec="uncompressed")


def parse(image: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields with lower-case names, block) of each record of an archive image.

    A record is expanded from slices that double, so what lies behind it is copied no more than it is itself.
    """
    view, at = memoryview(image), 0
    while at < len(view):
        expand, parts, done, step = zlib.decompressobj(31), [], at, 1024
        while not expand.eof and done < len(view):
            parts.append(expand.decompress(view[done : done + step]))
            done, step = min(done + step, len(view)), 2 * step
        data = b"".join(parts)
        if not expand.eof or not data.startswith(b"WARC/"):
            raise ValueError(f"no whole record at byte {at}")
        head, _, body = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        yield at, fields, body[: int(fields["content-length"])]
        at = done - len(expand.unused_data)


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of stored archives, with its HTTP payload where it has one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [
            pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
            pa.map_(pa.string(), pa.string()), pa.binary(), pa.binary(),
        ]
        names = [f.split()[0] for f in RECORD.split(", ")]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for archive, image in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = []
                for offset, fields, block in parse(image):
                    kind = fields["warc-type"]
                    page = first = digest = length = payload = None
                    if kind == "metadata":
                        notes = dict(line.split(": ", 1) for line in block.decode().splitlines())
                        page, first = (int(p) if (p := notes.get(k)) else None for k in ("page_id", "same_payload_as_page"))
                        block_out = block
                    elif kind == "request":
                        block_out = block
                    else:
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        if kind == "response":
                            if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"damaged payload in {archive} at byte {offset}")
                        else:
                            payload = None
                        block_out = head
                    found.append(
                        (
                            archive, offset, fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"),
                            fields["warc-target-uri"], page, first, digest, length, list(fields.items()), payload, block_out,
                        )
                    )
                    if len(found) == 256:
                        yield rows(found)
                        found = []
                if found:
                    yield rows(found)

    spark = archives.sparkSession
    small_batches(spark, 256)
    return archives.select("archive", "image").mapInArrow(read, RECORD)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row for each capture: its response or revisit joined with its request and metadata.

    The three meet under the response's identifier, which the other two name as concurrent to theirs.
    They stand together in an archive, so they mostly meet before the one shuffle, and archives are read
    once. Identifiers are unique, so no key is hot. Of several requests of a capture one is taken.
    """
    main = F.col("type").isin("response", "revisit")

    def of(condition: Column, value: Column | str) -> Column:
        return F.first(F.when(condition, value), ignorenulls=True)

    def nested(kind: str) -> Column:
        return of(F.col("type") == kind, F.struct("record_id", "archive", "offset", "headers", "block")).alias(kind)

    keep = [of(main, F.col("payload")).alias("payload")] if payload else []
    captures = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        of(main, F.col("target")).alias("target"),
        of(main, F.col("type")).alias("record_type"),
        of(main, F.col("payload_digest")).alias("payload_digest"),
        of(main, F.col("payload_bytes")).alias("payload_bytes"),
        of(main, F.col("refers_to")).alias("refers_to_record"),
        of(F.col("type") == "metadata", F.col("first_page")).alias("refers_to"),
        of(main, F.struct("archive", "offset", "headers", F.col("block").alias("http"))).alias("response"),
        *keep,
        nested("request"),
        nested("metadata"),
        of(F.col("type") == "metadata", F.col("page_id")).alias("page_id"),
    )
    return captures.where("record_type IS NOT NULL")
