"""WARC archives from and to a chunked record table.

A payload is a sequence of rows (record id, chunk number), none longer than ``CHUNK`` bytes.  A
payload of one chunk is one record; a longer one is a record and ``continuation`` records, as
the format has it for segments.  Records go to archives of bounded size: Spark's text
writer appends the two line ends that close a record, so an archive is a plain WARC file, and any
file system that Spark writes to will do.  The reader inflates and parses archives as
streams, carries the digest of each payload from chunk to chunk, and passes on data only of
payloads with several chunks, whose digests a second pass carries over their rows in order.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.storage import home, join_checked, join_groups, materialize, rows_of

CHUNK = 1 << 20
RUN = 16
ARCHIVE = 16 << 20
REVISIT_FROM = 100
_END = "\r\n"
_SCHEMA = "row string, page_id long, type string, refers_to long, chunk int, last boolean, payload_bytes long, payload_digest string, data binary"


def to_chunks(payload: str | F.Column, size: int = CHUNK) -> F.Column:
    """An array of the pieces of a binary column, at least one; ``posexplode`` makes the table's rows of it."""
    p = F.col(payload) if isinstance(payload, str) else payload
    last = F.greatest(F.lit(0), F.ceil(F.length(p) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(p, i * size + 1, F.lit(size)))


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, first`` of the pages that revisit another: of equal payloads of at least 100 bytes, all but those with the smallest page_id (null last)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = materialize(pages.select(F.col("page_id").cast("long").alias("page_id"), F.length(payload).alias("n"), F.sha2(payload, 256).alias("digest")).filter(F.col("n") >= REVISIT_FROM).select("page_id", "digest"))
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    return join_groups(rows, materialize(groups), "digest", "copies", rows_of(rows)).filter("not (page_id <=> first)").select("page_id", "digest", "first").distinct()


def _key() -> F.Column:
    return F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), "digest")


def records(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``row, part, record``: the bytes of each WARC record, without the line ends that close it."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", "").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("at"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload"))
    again = materialize(revisits(pages).select(_key().alias("_key"), "first", F.lit(True).alias("again")))
    p = join_checked(p.withColumn("_key", _key()), again, "_key", "left")
    p = p.withColumn("again", F.coalesce("again", F.lit(False))).withColumn("row", F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest", "at")))
    chunks = p.select("*", F.posexplode(F.when(F.col("again"), F.array(F.lit(b""))).otherwise(to_chunks("payload", chunk))).alias("part", "data")).drop("payload")
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / chunk))
    chunks = chunks.withColumn("parts", F.when(F.col("again"), F.lit(1).cast("long")).otherwise(parts))

    def name(row, part):
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("#", row, part.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    part = F.col("part")
    http = F.when(part == 0, F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("size").cast("string"), F.lit(_END * 2))).otherwise("")
    kind = F.when(F.col("again"), "revisit").when(part == 0, "response").otherwise("continuation")

    def line(key, value, when=None):
        text = F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit(_END))
        return F.coalesce(text if when is None else F.when(when, text).otherwise(""), F.lit(""))

    split = F.col("parts") > 1
    head = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", name(F.col("row"), part)),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")), part == 0),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("again")),
        line("X-Row", F.col("row")),
        line("X-Page-ID", F.col("page_id")),
        line("X-Refers-To-Page-ID", F.col("first"), F.col("again")),
        line("WARC-Segment-Number", part + 1, split),
        line("WARC-Segment-Origin-ID", name(F.col("row"), F.lit(0)), part > 0),
        line("WARC-Segment-Total-Length", F.col("size"), split & (part + 1 == F.col("parts"))),
        line("Content-Length", F.length(http.cast("binary")) + F.length("data")),
        F.lit(_END),
        http,
    )
    return chunks.select("row", "part", F.concat(head.cast("binary"), F.col("data")).alias("record"))


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, archive: int = ARCHIVE) -> None:
    """Write gzipped WARC archives of about ``archive`` bytes of payload each; sixteen chunks of a record stay together."""
    total = pages.agg(F.sum(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    placed = records(pages, chunk).repartition(max(1, -(-total // archive)), "row", F.floor(F.col("part") / RUN)).sortWithinPartitions("row", "part")
    placed.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip").text(path)


def parse(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Stream of (header, piece of the block, whether it is the block's last) over the records of an archive; at most one piece and a header are held."""
    held = bytearray()
    more = True

    def fill():
        nonlocal more
        got = next(blocks, None)
        if got is None:
            more = False
        else:
            held.extend(got)

    while True:
        while b"\r\n\r\n" not in held and more:
            fill()
        cut = held.find(b"\r\n\r\n")
        if cut < 0:
            return
        head = dict(line.split(": ", 1) for line in held[:cut].decode().split(_END)[1:])
        del held[: cut + 4]
        left = int(head["Content-Length"])
        while True:
            while not held and left and more:
                fill()
            piece = bytes(held[:left])
            del held[: len(piece)]
            left -= len(piece)
            yield head, piece, not left
            if not left or not (held or more):
                break
        while len(held) < 4 and more:
            fill()
        del held[:4]


def _inflated(content: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    stream = zlib.decompressobj(31)
    for at in range(0, len(content), step):
        if out := stream.decompress(content[at : at + step]):
            yield out


def _scan(content: memoryview) -> Iterator[dict]:
    """Rows of the record table of one archive; data only where a payload has several chunks."""
    digest, size, kept, body = hashlib.sha256(), 0, bytearray(), bytearray()
    open_head = True
    for head, piece, last in parse(_inflated(content)):
        segmented = "WARC-Segment-Number" in head
        first = head["WARC-Type"] != "continuation"
        if first and open_head:
            body += piece
            cut = body.find(b"\r\n\r\n")
            if cut < 0:
                continue
            http, piece, open_head = bytes(body[:cut]), bytes(body[cut + 4 :]), False
        digest.update(piece)
        size += len(piece)
        if segmented:
            kept += piece
        if last:
            revisit = head["WARC-Type"] == "revisit"
            told = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:]) if first else {}
            yield {
                "row": head["X-Row"],
                "page_id": int(head["X-Page-ID"]) if "X-Page-ID" in head else None,
                "type": head["WARC-Type"],
                "refers_to": int(head["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in head else None,
                "chunk": int(head.get("WARC-Segment-Number", 1)) - 1,
                "last": not segmented or "WARC-Segment-Total-Length" in head,
                "payload_bytes": int(told[b"Content-Length"]) if revisit else size,
                "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else None if segmented else digest.hexdigest(),
                "data": bytes(kept) if segmented else None,
            }
            digest, size, kept, body, open_head = hashlib.sha256(), 0, bytearray(), bytearray(), True


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives below ``path``."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in _scan(memoryview(content.as_buffer())):
                    rows.append(row)
                    held += len(row["data"] or b"")
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _SCHEMA)


_ARROW = pa.schema([("row", pa.string()), ("page_id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])
_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digests(chunks: DataFrame) -> DataFrame:
    """One row per payload of several chunks: its digest and length, carried over its rows in order."""
    ordered = chunks.select("row", "chunk", "page_id", "last", "data").repartition("row").sortWithinPartitions("row", "chunk")

    def run(batches):
        held, digest, size = None, None, 0
        for batch in batches:
            for row, page, last, data in zip(*(batch.column(i) for i in (0, 2, 3, 4)), strict=True):
                if row.as_py() != held:
                    held, digest, size = row.as_py(), hashlib.sha256(), 0
                digest.update(data.as_buffer())
                size += len(data.as_buffer())
                if last.as_py():
                    yield pa.RecordBatch.from_pylist([{"page_id": page.as_py(), "payload_bytes": size, "payload_digest": digest.hexdigest(), "record_type": "response", "refers_to": None}], schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return ordered.mapInArrow(run, _OUT)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record, digests computed from the archived bytes (a revisit's from its header)."""
    chunks = materialize(read_chunks(spark, path))
    whole = chunks.filter("data is null").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
    return whole.unionByName(digests(chunks.filter("data is not null")))


def round_trip(pages: DataFrame, chunk: int = CHUNK, archive: int = ARCHIVE) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back; see ``read_archives``.

    Null html is an empty payload, a null url an empty one.  Rows with the same page_id
    and payload are all responses when theirs is the smallest page_id.  A null page_id is last,
    and refers_to is null where only null page_ids share a payload.  Repeated rows each have
    a record; an empty table gives no rows; other columns are ignored.
    """
    path = f"{home(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, chunk, archive)
    return read_archives(pages.sparkSession, path)
