"""WARC archives: pages written as segmented records by Spark's text writer, and read back into whole payloads.

``write_archives`` makes one record a page. A payload that several pages share is stored once, by the page of the largest id, and the
others are ``revisit`` records that refer to its record. A block (HTTP head and chunked body) of more than ``segment`` bytes is cut:
its first part is segment 1 of the record, the others are ``continuation`` records with the record's id as origin and their number,
the last one with the total length. Every record is a row of bytes and the blank line after a record is Spark's line separator, so
archives lie wherever Spark can write, with a bounded number of records a file.

``read_archives`` takes each archive apart by its content lengths. A record whose segments follow one another in one archive is put
together where it is read, so that no payload is dealt for it. The segments of all others are dealt by origin, sorted by segment number
and gone through in a stream: numbers must follow one another and the lengths add up to the stated total; then the HTTP head goes
and the chunks are taken out of their framing. Archives are read once for each of the two ways, which costs less than to deal every
payload. A task holds one archive or one batch of records, and the one payload that is being put together.

Defined results: a null html is an empty payload; empty payloads and those under ``least`` bytes are all responses; of repeated rows
with one page_id one is the response, the others revisit it; a null page_id is smaller than all others and stays null; a null url
leaves out the target URI, blanks and control characters in one are percent-encoded; an empty table gives archives without records.
Only page_id, url and html are read, so other columns cannot clash. Copies of one payload, however many, are dealt over many tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import by_key, materialise, null_join, numbered, shared_folder

# The format's version, line end and the profile of a revisit.
VERSION = b"WARC/1.1"
END = b"\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

#: Bytes of a block's part, bytes of a chunk, records a file: an archive holds 64 MB at most before it is compressed.
SEGMENT = 16 * 1024
CHUNK = 4096
RECORDS = 4096
SALTS = 16


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[at : at + size]), payload[at : at + size]) for at in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """What chunked framing holds; chunk extensions and trailers go. A frame that is cut off or malformed is an error."""
    out, at = [], 0
    while True:
        end = body.index(END, at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = END.join([VERSION, *(name + b": " + value for name, value in [*fields, (b"Content-Length", b"%d" % len(block))])])
    return head + END + END + block


def _id(key: str) -> bytes:
    return b"<urn:uuid:%b>" % str(uuid.UUID(hashlib.md5(key.encode()).hexdigest())).encode()


def records_of(page_id: int | None, url: str | None, payload: bytes, sha1: str, key: str, refers: str | None, segment: int) -> Iterator[bytes]:
    """The records of one page; ``key`` names its record, ``refers`` the one that it revisits."""
    own = [(b"WARC-Date", DATE), (b"WARC-Payload-Digest", b"sha1:" + sha1.encode())]
    if page_id is not None:
        own.append((b"Page-ID", b"%d" % page_id))
    if url is not None:
        own.append((b"WARC-Target-URI", re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass"))))
    if refers is not None:
        yield _record([(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", _id(key)), (b"WARC-Refers-To", _id(refers)), (b"WARC-Profile", PROFILE), *own], b"")
        return
    block = HTTP_HEAD + chunked(payload)
    kind = [(b"Content-Type", b"application/http; msgtype=response"), *own]
    first = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", _id(key))]
    if len(block) <= segment:
        yield _record([*first, *kind], block)
        return
    yield _record([*first, (b"WARC-Segment-Number", b"1"), *kind], block[:segment])
    count = -(-len(block) // segment)
    for k in range(2, count + 1):
        more = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", _id(f"{key}/{k}")), (b"WARC-Date", DATE), (b"WARC-Segment-Origin-ID", _id(key)), (b"WARC-Segment-Number", b"%d" % k)]
        if k == count:
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield _record(more, block[(k - 1) * segment : k * segment])


def with_roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, sha1, key, refers): ``key`` names each row's record, ``refers`` the record that has the same payload, if the row revisits one."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    # of each shared payload the largest page_id, and how many rows have it; counted in each task first
    per = rows.where("digest is not null").groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    lead = per.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("members")).where("members > 1")
    lead = materialise(lead.select("digest", F.lit(True).alias("shared"), F.col("top.page_id").alias("lead"), F.col("top.n").alias("tied")))
    joined = null_join(rows, lead, ["digest"], "left", SALTS)
    leads = F.col("page_id").eqNullSafe(F.col("lead"))
    roles = joined.withColumn("idx", F.lit(0).cast("long"))
    if not lead.where("tied > 1").isEmpty():
        # rows that repeat the leading page, if there are any, are numbered among themselves: the first of them leads
        repeats = F.coalesce(leads & (F.col("tied") > 1), F.lit(False))
        tied = numbered(materialise(joined.where(repeats)), ["digest"], [F.col("url").asc_nulls_first()])
        roles = roles.where(~repeats).unionByName(tied.drop("n"))
    group = F.concat(F.lit("shared/"), F.col("digest"))
    revisits = F.coalesce(F.col("shared") & (~leads | (F.col("idx") > 0)), F.lit(False))
    own = F.concat_ws("/", F.lit("own"), F.col("page_id").cast("string"), F.sha1("payload"), F.monotonically_increasing_id().cast("string"))
    key = F.when(F.col("shared") & ~revisits, group).otherwise(own)
    return roles.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), key.alias("key"), F.when(revisits, group).alias("refers"))


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT, least: int = 1000, records: int = RECORDS) -> None:
    """A record for each row of ``pages(page_id, url, html)``, in compressed archives under ``folder``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns)), strict=True):
                for record in records_of(row[0], row[1], row[2].as_py(), row[3], row[4], row[5], segment):
                    out.append(record)
                    size += len(record)
                    if size >= 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    found = with_roles(pages, least).mapInArrow(cut, "value binary")
    writer = found.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records)
    writer.text(folder)


FIELDS = "record_id string, record_type string, page_id long, refers string, stated string, origin string, segment int, total long, block binary"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def parsed(archive: bytes) -> Iterator[tuple]:
    """The records of one archive, as ``FIELDS``; a record that is cut off is an error."""
    at = 0
    while at < len(archive):
        end = archive.index(END + END, at)
        first, *lines = archive[at:end].split(END)
        if first != VERSION:
            raise ValueError("no record begins here")
        head = dict(line.split(b": ", 1) for line in lines)
        size = int(head[b"Content-Length"])
        at = end + 4 + size + 4
        if archive[at - 4 : at] != END + END:
            raise ValueError("a record does not end where its length says")
        text = lambda name: head[name].decode() if name in head else None  # noqa: B023, E731
        number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
        record_id = text(b"WARC-Record-ID")
        yield (
            record_id, text(b"WARC-Type"), number(b"Page-ID"), text(b"WARC-Refers-To"), (text(b"WARC-Payload-Digest") or "").removeprefix("sha1:") or None,
            text(b"WARC-Segment-Origin-ID") or record_id, number(b"WARC-Segment-Number"), number(b"WARC-Segment-Total-Length"), archive[end + 4 : end + 4 + size],
        )


def gathered(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The records of one archive as they are, but where all segments of a record follow one another: these are one record without a number, and one of type ``gathered`` and number 0 that tells so."""
    held = []
    for row in rows:
        if held and row[1] == "continuation" and row[5] == held[0][0] and row[6] == len(held) + 1:
            held.append(row)
            if row[7] is None:
                continue
            if sum(len(r[8]) for r in held) == row[7]:
                first = held[0]
                held = [(*first[:6], None, None, b"".join(r[8] for r in held)), (first[0], "gathered", None, None, None, first[0], 0, None, b"")]
            yield from held
            held = []
            continue
        yield from held
        held = [row] if row[1] != "continuation" and row[6] == 1 else []
        if not held:
            yield row
    yield from held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def _read(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Of each archive the records that are ``whole``, or those that are not and what was gathered."""
    text = pa.string()
    schema = pa.schema(list(zip(NAMES, [text, text, pa.int64(), text, text, text, pa.int32(), pa.int64(), pa.binary()], strict=True)))
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            data = content.as_py()
            for row in gathered(parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)):
                if (row[6] is None and row[1] != "continuation") != whole:
                    continue
                rows.append(row)
                size += len(row[-1])
                if size >= 1 << 24:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            yield _batch(rows, schema)


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, out of its framing if it is chunked."""
    head, _, body = block.partition(END + END)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def assembled(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(record_id, record_type, page_id, refers, stated, payload) of records that come origin by origin in the order of their segments.

    Segments that are missing, repeated or shorter than the total says are an error, as is a continuation without its first segment.
    What was gathered elsewhere comes before its origin's other rows, of which there must be none.
    """
    held, parts, gone = None, [], ()

    def whole() -> tuple:
        block = b"".join(parts)
        if held[6] is not None and held[7] != len(block):
            raise ValueError(f"record {held[0]}: {len(block)} bytes of {held[7]}")
        payload = payload_of(block) if held[1] == "response" else block
        return (*held[:5], payload)

    for row in rows:
        if row[5] == gone:
            raise ValueError(f"segment {row[6]} of {row[5]} comes again")
        if row[1] == "gathered":
            gone = row[5]
        elif row[1] != "continuation":
            if held is not None:
                yield whole()
            held, parts = list(row[:8]), [row[8]]
            if row[6] not in (None, 1):
                raise ValueError(f"record {row[0]} begins with segment {row[6]}")
        elif held is None or row[5] != held[0] or row[6] != len(parts) + 1 or held[6] is None:
            raise ValueError(f"segment {row[6]} of {row[5]} does not follow the one before")
        else:
            parts.append(row[8])
            held[7] = row[7] if row[7] is not None else held[7]
    if held is not None:
        yield whole()


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(zip([*NAMES[:5], "payload"], [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()], strict=True)))
    rows, size = [], 0
    for row in assembled(tuple(c[k].as_py() for c in batch.columns) for batch in batches for k in range(batch.num_rows)):
        rows.append(row)
        size += len(row[-1])
        if size >= 1 << 24:
            yield _batch(rows, schema)
            rows, size = [], 0
    yield _batch(rows, schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, record_type, page_id, refers, stated, payload) of every record under ``folder``; revisits have an empty payload and the digest that they state."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    fields = "record_id string, record_type string, page_id long, refers string, stated string, payload binary"
    whole = files.mapInArrow(lambda batches: _assemble(_read(batches, True)), fields)
    dealt = files.mapInArrow(lambda batches: _read(batches, False), FIELDS).repartition("origin").sortWithinPartitions("origin", F.coalesce("segment", F.lit(1)))
    return whole.union(dealt.mapInArrow(_assemble, fields))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, digest_holds) of every record: what was read, or what the record that it refers to holds."""
    found = read_archives(spark, folder)
    found = found.select("record_id", "record_type", "page_id", "refers", "stated", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    found = materialise(found)
    own = found.where("record_type = 'response'")
    revisits = found.where("record_type = 'revisit'").select(F.col("refers").alias("record_id"), "page_id", "stated")
    members = revisits.groupBy("record_id").agg(F.count(F.lit(1)).alias("members"))
    per = materialise(own.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").join(members, "record_id"))
    met = by_key(revisits, per, "record_id", "members")
    held = F.col("stated").eqNullSafe(F.col("payload_digest")).alias("digest_holds")
    responses = own.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), held)
    return responses.union(met.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit"), "refers_to", held))


def op13_warc(pages: DataFrame) -> DataFrame:
    """The contract's row for every page: written, read back, and what the archives say."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder)
    return read_pages(spark, folder)


def oracle() -> str:
    """The same rows in DuckDB SQL, from the pages themselves."""
    return """with p as (select page_id, encode(coalesce(html, '')) as b from pages),
    g as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest, case when octet_length(b) >= 1000 then row_number() over (partition by b order by page_id desc) else 1 end as k,
      first(page_id) over (partition by b order by page_id desc) as lead from p)
    select page_id, payload_bytes, payload_digest, case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then lead end as refers_to, true as digest_holds from g"""
