"""WARC archives: a writer with revisit records and a reader that salvages what a damaged file still holds.

Writing. Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest id is the response, the others
revisit it. Each record is one gzip member. Spark's text writer puts the members of a partition into one file: the last byte of
a member, the high byte of its size field, is 0 for members below 16 MB and serves as the line separator, so files are plain
concatenated members, committed like any other output; a larger record is several members.

Reading. Files are read member by member (or, without gzip, record by record). A member that fails to inflate, or a record whose
version line, length or digest is wrong, is not the end: the reader looks for the next member or version line that begins a
valid record, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.llm.tables import written
from gustline.llm.words import in_slices
from gustline.session import fresh_folder

LEAST_REVISIT = 1000
# Input bytes per member; the size field's high byte stays 0 below 16 MB.
MEMBER_BYTES = 8 << 20
# Payload bytes per file on average; a file is read by one task.
FILE_BYTES = 16 << 20
# Rows of repeated payloads are broadcast up to this many (80 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
# Records and payload bytes handed over at once by the reader.
BATCH_RECORDS, BATCH_BYTES = 500, 4 << 20
READ_BYTES = 1 << 14
# File names and comments in gzip headers are shorter.
LONGEST_NAME = 1 << 12
VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def sha1_text(payload: bytes) -> str:
    """Digest as WARC headers carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed record. Line breaks inside a header value become blanks."""
    lines = [f"{name}: {re.sub(r'[\r\n]+', ' ', value)}" for name, value in [*headers, ("Content-Length", str(len(block)))]]
    return VERSION + "\r\n".join(lines).encode() + END + block + END


def members(raw: bytes, level: int = 6) -> bytes:
    """A record as gzip members, each of which ends with a zero byte."""
    out = []
    for at in range(0, len(raw), MEMBER_BYTES):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append(packer.compress(raw[at : at + MEMBER_BYTES]) + packer.flush())
    return b"".join(out)


def record_id(key: int | None, url: str | None) -> str:
    """The same row gets the same record id in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url}')}>"


def _records(level: int):
    def run(batches):
        for batch in in_slices(batches, 2):
            out = []
            for key, url, payload, target in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                payload = payload or b""
                headers = [
                    ("WARC-Record-ID", record_id(key, url)), ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", sha1_text(payload)),
                    ("X-Page-ID", "" if key is None else str(key)),
                ]
                if target is None:
                    raw = record([("WARC-Type", "response"), *headers, ("WARC-Block-Digest", sha1_text(payload))], payload)
                else:
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", str(target))]
                    raw = record([("WARC-Type", "revisit"), *headers, ("WARC-Block-Digest", sha1_text(b""))], b"")
                # the text writer adds the last byte
                out.append(members(raw, level)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return run


def write_warc(
    df: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", level: int = 6
) -> None:
    """One record per row into the folder ``path``; the payload is the text in UTF-8, NULL is empty.

    Payloads below ``LEAST_REVISIT`` bytes are always responses. Rows that repeat id and payload: one is the response if the
    payload is long enough, the others revisit it. A NULL id cannot be referred to: such rows are responses. An empty table
    gives a folder without records.
    """
    rows = df.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{url_column}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_column}`").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    long = (F.length("payload") >= LEAST_REVISIT) & F.col("id").isNotNull()
    # payloads stay where they are: only ids and digests of repeated payloads travel
    groups = rows.where(long).groupBy("digest").agg(F.max("id").alias("target"), F.count("*").alias("n")).where("n > 1")
    narrow = rows.where(long).select("id", F.col("digest").alias("_digest"))
    targets = narrow.join(groups, F.col("_digest") == F.col("digest")).select(F.col("id").alias("_id"), "_digest", "target")
    targets = written(targets.distinct(), "warc-targets")
    # without many repeats the payloads need no shuffle at all
    side = F.broadcast(targets) if targets.count() <= BROADCAST_ROWS else targets
    rows = rows.join(side, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("id", "url", "payload", F.when(F.col("target") != F.col("id"), F.col("target")).alias("target"))
    size = df.agg(F.avg(F.octet_length(F.col(f"`{payload_column}`")))).first()[0] or 0
    lines = rows.mapInArrow(_records(level), "member binary").select(F.col("member").cast("string").alias("value"))
    # a file is read by one task, so it is rolled before it gets long
    writer = lines.write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, int(FILE_BYTES // max(1, size))))
    writer.text(path)


def _is_member(data: memoryview, at: int) -> bool:
    """Whether a gzip header can begin here. Names in it end within LONGEST_NAME bytes, so a false start is not read to the end."""
    if len(data) < at + 18 or data[at + 3] & 0xE0:
        return False
    flags, place = data[at + 3], at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            length = bytes(data[place : place + LONGEST_NAME]).find(b"\0")
            if length < 0:
                return False
            place += length + 1
    return place < len(data)


def _inflate(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """The member that begins at ``at`` and where it ends, or None if it is damaged."""
    if not _is_member(data, at):
        return None
    reader, out = zlib.decompressobj(31), []
    while not reader.eof and at < len(data):
        part = data[at : at + READ_BYTES]
        try:
            out.append(reader.decompress(part))
        except zlib.error:
            return None
        at += len(part)
    return (b"".join(out), at - len(reader.unused_data)) if reader.eof else None


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """Headers (names in lower case), block and end of the record at ``at``; None unless all checks hold."""
    version = _VERSION_LINE.match(raw, at)
    if not version:
        return None
    headers, at = {}, version.end()
    while True:
        # a false start is read up to its first line that is no header, such as the next version line
        line_end = raw.find(b"\r\n", at)
        if line_end < 0:
            return None
        if line_end == at:
            break
        name, colon, value = raw[at:line_end].partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        at = line_end + 2
    length = headers.get("content-length", "")
    if not length.isdigit():
        return None
    start = at + 2
    end = start + int(length)
    if raw[end : end + len(END)] != END:
        return None
    block = raw[start:end]
    if headers.get("warc-block-digest", sha1_text(block)) != sha1_text(block):
        return None
    return headers, block, end + len(END)


def _gzip_record(data: memoryview, at: int) -> tuple[dict, bytes, int] | None:
    """A record in one or more members."""
    raw, end = b"", at
    while True:
        found = _inflate(data, end)
        if found is None:
            return None
        raw, end = raw + found[0], found[1]
        if not _VERSION_LINE.match(raw):
            return None
        parsed = parse_record(raw)
        if parsed and parsed[2] == len(raw):
            return parsed[0], parsed[1], end
        # only a record that fills its members goes on in the next one
        if len(found[0]) < MEMBER_BYTES or bytes(data[end : end + 3]) != GZIP:
            return None


def salvage(data: bytes):
    """Yield ``("record", start, end, headers, block)`` and ``("gap", start, end, reason)`` in file order.

    An empty file yields nothing; a file without a single valid record is one gap.
    """
    view, at, gap_from, reason = memoryview(data), 0, None, ""
    # places of the next member and version line, kept until they are passed
    member = version = -1
    while at < len(data):
        if data[at : at + 3] == GZIP:
            found = _gzip_record(view, at)
            problem = "damaged member"
        else:
            found = parse_record(data, at)
            problem = "damaged record"
        if found:
            if gap_from is not None:
                yield "gap", gap_from, at, reason
                gap_from = None
            yield "record", at, found[2], found[0], found[1]
            at = found[2]
            continue
        if gap_from is None:
            gap_from, reason = at, problem
        if member <= at:
            place = data.find(GZIP, at + 1)
            member = len(data) if place < 0 else place
        if version <= at:
            line = _VERSION_LINE.search(data, at + 1)
            version = line.start() if line else len(data)
        at = min(member, version)
    if gap_from is not None:
        yield "gap", gap_from, len(data), reason


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    names = ["path", "start", "end", "headers", "block", "gap"]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _read(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, held = [], 0
            for found in salvage(content.as_py()):
                if found[0] == "gap":
                    rows.append((path, found[1], found[2], None, None, found[3]))
                else:
                    rows.append((path, found[1], found[2], list(found[3].items()), found[4], None))
                    held += len(found[4])
                if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``path, start, end, headers, block, gap`` of all files of a folder: a record has headers and block, a quarantined gap its
    reason. Damaged files give what they still hold."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    schema = "path string, start long, end long, headers map<string,string>, block binary, gap string"
    return files.mapInArrow(_read, schema)


def archived_pages(records: DataFrame) -> DataFrame:
    """Per record: ``page_id, payload_bytes, payload_digest`` (hex), ``record_type, refers_to``; a revisit takes the payload size
    of the response it refers to. A response whose payload does not match its payload digest was dropped by the reader."""
    rows = records.where("gap is null").select(
        F.expr("try_cast(headers['x-page-id'] as bigint)").alias("page_id"),
        F.length("block").cast("long").alias("bytes"),
        F.when(F.col("headers")["warc-type"] == "response", F.sha1("block")).alias("own"),
        F.col("headers")["warc-payload-digest"].alias("digest"), F.col("headers")["warc-type"].alias("record_type"),
        F.expr("try_cast(headers['x-refers-to-page-id'] as bigint)").alias("refers_to"),
    )
    responses = rows.where("record_type = 'response'").select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), F.col("own").alias("_own")
    )
    # only responses that something refers to are needed, once each
    wanted = rows.where("refers_to is not null").select(F.col("refers_to").alias("_page"), F.col("digest").alias("_digest")).distinct()
    responses = responses.join(wanted, ["_page", "_digest"], "left_semi").dropDuplicates(["_page", "_digest"])
    rows = rows.join(responses, (F.col("refers_to") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return rows.select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.coalesce("own", "_own").alias("payload_digest"), "record_type", "refers_to",
    )


def round_trip(df: DataFrame) -> DataFrame:
    """Write an archive of ``pages`` to the shared folder and read it back; odd rows as in :func:`write_warc`. Very long pages are records
    of several members; repeated rows are records of their own; an empty table gives an empty result; other columns are not read."""
    path = fresh_folder(df.sparkSession, "warc")
    write_warc(df, path)
    return archived_pages(read_warc(df.sparkSession, path))
