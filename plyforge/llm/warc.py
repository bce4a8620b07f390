"""WARC archives: writing with payload deduplication, and reading with segment reassembly.

Writing. Pages become WARC/1.1 records whose block is an HTTP response in chunked transfer
framing. Of equal payloads one page is the response and the others are revisit records that
refer to it. A block longer than SEGMENT_BYTES is cut: the first segment is the record, the
rest are continuation records with the origin's identifier and their number, the last also
with the total length. Archives are written by Spark's text writer with the record separator
as line separator, so a lost task leaves no half archive, on any file system Spark writes to;
the number of records in a file bounds its size.

Reading. Each archive is parsed by Content-Length. Continuations are grouped by origin,
ordered by number and checked for gaps and the total length; then the HTTP header is taken
off and the chunked framing decoded. Revisits take their payload's size and digest from the
record that they refer to.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import broadcast_if_small, fresh_path, staged, table

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: A record has at most a segment and its header, so this bounds an archive to about 8 MB.
RECORDS_PER_ARCHIVE = 512
SEPARATOR = "\r\n\r\n"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class WarcError(ValueError):
    pass


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; extensions and trailers are read over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise WarcError("chunk size without line end")
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError as e:
            raise WarcError("bad chunk size") from e
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise WarcError("chunk without its end")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response message, its transfer framing decoded."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("HTTP header without end")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and value.strip().lower() == b"chunked":
            return dechunked(body)
    return body


def record_id(page_id: int | None, segment: int = 1, copy: int = 0) -> str:
    name = f"page {page_id} segment {segment}" + (f" copy {copy}" if copy else "")
    name = hashlib.md5(name.encode(), usedforsecurity=False).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name)}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES, copy: int = 0
) -> Iterator[bytes]:
    """The records of one page, without the separators that follow them; refers_to names the response that it revisits."""
    own_id = record_id(page_id, 1, copy)
    uri = "".join(c if 0x20 < ord(c) != 0x7F else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    common = [
        ("WARC-Record-ID", own_id),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *[("X-Page-ID", page_id)] * (page_id is not None),
    ]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", refers_to), ("WARC-Profile", profile)], b"")
        return
    block = _HTTP + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), *common, ("Content-Type", "application/http; msgtype=response")]
    yield _record(first + [("WARC-Segment-Number", 1)] * (len(parts) > 1), parts[0])
    for number, part in enumerate(parts[1:], 2):
        own = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", record_id(page_id, number, copy)),
            ("WARC-Date", "2024-01-01T00:00:00Z"),
            ("WARC-Segment-Origin-ID", own_id),
            ("WARC-Segment-Number", number),
        ]
        yield _record(own + [("WARC-Segment-Total-Length", len(block))] * (number == len(parts)), part)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; field names in lower case."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/1.", at):
            raise WarcError(f"no WARC record at byte {at}")
        lines = content[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise WarcError(f"record at byte {at} doesn't end where its length says")
        yield fields, content[start:stop]
        at = stop + 4


def _numbered(own: DataFrame) -> DataFrame:
    """The rows with copy: 0, but numbers of their own for rows without page_id and those that share one.

    Only these rows are written on the way, so that their numbers are the same wherever they
    are read. No window gathers the rows of one page_id.
    """
    repeats = staged(own.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or page_id is null"), "repeats")
    if repeats.isEmpty():
        return own.withColumn("copy", F.lit(0).cast("long"))
    ids = broadcast_if_small(repeats.select(F.col("page_id").alias("_page")), repeats.count(), 20)
    match = F.col("page_id").eqNullSafe(F.col("_page"))
    copies = own.join(ids, match, "left_semi").withColumn("copy", F.monotonically_increasing_id() + 1)
    return own.join(ids, match, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(staged(copies, "copies"))


def _roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, copy, and _first, the (page_id, minus copy) of the response that a revisit refers to."""
    own = _numbered(pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")))
    sha = F.sha2("payload", 256).alias("_sha")
    place = F.struct(F.col("page_id"), (-F.col("copy")).alias("copy"))
    known = F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_bytes)
    shared = own.where(known).select(place.alias("_place"), sha).groupBy("_sha").agg(F.max("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shared = staged(shared.where("_n > 1"), "payloads")
    joined = own.withColumn("_sha", sha).join(broadcast_if_small(shared, shared.count(), 250), "_sha", "left")
    refers = F.when(F.col("page_id").isNotNull() & (F.col("_first") != place), F.col("_first"))
    return joined.select("page_id", "url", "payload", "copy", refers["page_id"].alias("refers_to"), (-refers["copy"]).alias("refers_copy"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for each page below path.

    Of pages with equal payloads of at least min_bytes, the largest page_id's is the response
    and the others revisit it. A null html is an empty payload, a null url a URN of the page.
    Rows that share a page_id have records of their own, as have rows without one, which are
    responses all, with no page in their fields.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part, out = batch.slice(k, 200), []
                for row in part.to_pylist():
                    digest = base64.b32encode(hashlib.sha1(row["payload"], usedforsecurity=False).digest()).decode()
                    refers = None if row["refers_to"] is None else record_id(row["refers_to"], 1, row["refers_copy"])
                    out += page_records(row["page_id"], row["url"], row["payload"], digest, refers, segment_bytes, row["copy"])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (
        _roles(pages, min_bytes)
        .mapInArrow(made, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("maxRecordsPerFile", RECORDS_PER_ARCHIVE)
        .text(path)
    )


_RECORD = (
    "record_id string, type string, page_id long, uri string, digest string, refers_to string,"
    " origin string, segment int, total long, block binary"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, segments apart."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda fields, name: int(fields[name]) if name in fields else None
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in parse_archive(content.as_py()):
                    origin = f.get("warc-segment-origin-id")
                    segment = number(f, "warc-segment-number")
                    rows.append(
                        {
                            "record_id": f["warc-record-id"],
                            "type": f["warc-type"],
                            "page_id": number(f, "x-page-id"),
                            "uri": f.get("warc-target-uri"),
                            "digest": f.get("warc-payload-digest"),
                            "refers_to": f.get("warc-refers-to"),
                            "origin": origin or (f["warc-record-id"] if segment else None),
                            "segment": segment,
                            "total": number(f, "warc-segment-total-length"),
                            "block": block,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    text = pa.string()
    schema = pa.schema(
        [("record_id", text), ("type", text), ("page_id", pa.int64()), ("uri", text), ("digest", text), ("refers_to", text)]
        + [("origin", text), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parsed, _RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: segments of one origin in order, with problem naming what is wrong with a set of them.

    A set is whole if its numbers run from 1 without gaps and the last one's total length is
    that of all blocks. Only segments are shuffled; a record's segments fit in memory as the
    record must.
    """
    head = ("record_id", "type", "page_id", "uri", "digest", "refers_to")
    single = records.where("segment is null").select(*head, "block", F.lit(None).cast("string").alias("problem"))
    parts = F.sort_array(F.collect_list(F.struct("segment", "total", "block")))
    first = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in head]
    sets = records.where("segment is not null").groupBy("origin").agg(*first, parts.alias("parts"))
    n = F.size("parts")
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p["block"]))
    gapless = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), n)
    total = F.element_at("parts", -1)["total"]
    problem = (
        F.when(~gapless, F.lit("segments are missing or repeat"))
        .when(total.isNull(), F.lit("the last segment has no total length"))
        .when(total != length, F.lit("the total length is not that of the segments"))
    )
    # As hex text, since only text joins in one step; a concat a segment would copy the block each time.
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    whole = sets.select(*[F.coalesce(c, "origin") if c == "record_id" else c for c in head], block.alias("block"), problem.alias("problem"))
    return single.unionByName(whole.toDF(*head, "block", "problem"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, type, page_id, uri, digest, refers_to, payload, problem of each whole record below path.

    payload is decoded for responses that are whole; problem says why another has none.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                payloads, problems = [], []
                for kind, block, problem in zip(*(part.column(c).to_pylist() for c in ("type", "block", "problem")), strict=True):
                    payload = None
                    if kind == "response" and problem is None:
                        try:
                            payload = http_payload(block)
                        except WarcError as e:
                            problem = str(e)
                    payloads.append(payload)
                    problems.append(problem)
                arrays = [part.column(c) for c in names] + [pa.array(payloads, pa.binary()), pa.array(problems, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "payload", "problem"])

    names = ["record_id", "type", "page_id", "uri", "digest", "refers_to"]
    return reassembled(read_records(spark, path)).mapInArrow(
        decoded, "record_id string, type string, page_id long, uri string, digest string, refers_to string, payload binary, problem string"
    )


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 of the SHA-1 of payload."""
    sha = F.sha1(payload)
    letters = []
    for k in range(8):
        twenty = F.conv(F.substring(sha, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_ALPHABET), F.shiftright(twenty, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


NAME = "op8_warc"
ORACLE_SQL = f"""
WITH own AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
    FROM pages
)
SELECT page_id,
       octet_length(payload)::BIGINT AS payload_bytes,
       array_to_string([substr('{_ALPHABET}', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)
                        FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM own
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path).select(
        "record_id",
        "type",
        "page_id",
        "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("record_id", F.lit(": "), "problem"))).alias("problem"),
    )
    read = staged(read, "records")
    responses = read.where("type = 'response'")
    origin = responses.select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes"), "payload_digest")
    revisits = (
        read.where("type = 'revisit'")
        .select("page_id", "refers_to")
        .join(origin, F.col("refers_to") == F.col("_id"))
        .select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("_page").alias("refers_to"))
    )
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    ).unionByName(revisits)
