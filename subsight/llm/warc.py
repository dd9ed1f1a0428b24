"""WARC archives in Zstandard: written by Spark's own committer, read back and checked.

An archive begins with a skippable frame that holds its compression dictionary
(magic 0x184D2A5D); then comes one frame per record. Archives are written through
Spark's text writer, a run of whole frames a row. The line separator it puts after
each row is an empty skippable frame, which every Zstandard reader passes over.
So archives commit and retry like any Spark output and can lie in any store.
The writer begins a new file after a fixed number of rows; an archive that is
full before is filled up with empty rows, so a new one begins when bytes say so.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote_from_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.sources.tables import shared_dir

# Fixed values of the formats.
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "2024-01-01T00:00:00Z"
#: Eight ASCII bytes: a skippable frame of length 0.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")

MIN_REVISIT_BYTES = 1000
LEVEL = 3
#: A dictionary is trained on the first records of its own archive, so many and so many bytes at most.
DICTIONARY_RECORDS = 64
DICTIONARY_SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 1 << 15
#: No frame may unfold to more than this.
MAX_RECORD_BYTES = 1 << 30
#: An archive ends with the record that takes it to so many bytes: one task reads it whole.
ARCHIVE_BYTES = 1 << 28
#: Frames are gathered to rows of at least so many bytes.
ROW_BYTES = 1 << 18


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Choose each page's record type: ``(page_id, url, payload, digest, record_type, refers_to)``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` the one with
    the largest ``page_id`` is the response and the others revisit it. A null
    payload is empty. Pages that share the largest id are all responses; a null
    id is smaller than any other, and where all are null all are responses.
    Payloads are joined to one row per repeated payload; a payload that a large
    part of the pages share is split over tasks by adaptive skew handling, and
    its count is summed before the shuffle.
    """
    rows = pages.select(
        "page_id",
        "url",
        F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    groups = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    revisits = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(groups, "digest", "left").select(
        "page_id",
        "url",
        F.when(revisits, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("_first")).alias("refers_to"),
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def _base32(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode("ascii")


def record_bytes(row: dict) -> bytes:
    """One WARC record: headers, the HTTP response (without body for a revisit), two line ends."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode("ascii")
    block = http + (row["payload"] or b"")
    lines = [
        VERSION.decode("ascii"),
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_record_id(row['page_id'])}",
        f"WARC-Date: {DATE}",
    ]
    if row["url"] is not None:
        # Printable ASCII stays; blanks, controls and other bytes are percent-encoded.
        safe = "".join(chr(c) for c in range(33, 127) if c != 37)
        raw = row["url"].encode("utf-8", "surrogateescape").replace(b"%", b"\0")
        lines.append("WARC-Target-URI: " + quote_from_bytes(raw, safe=safe).replace("%00", "%"))
    lines.append(f"WARC-Payload-Digest: {_base32(row['digest'])}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {_record_id(row['refers_to'])}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few or too small samples to learn from
        return None


def _archives_of(records: Iterator[bytes], archive_bytes: int) -> Iterator[tuple[bytes, bool]]:
    """``(frames, ends)``: each archive's dictionary frame, if any, then a frame per record; ``ends`` marks its last but for the last of all."""
    waiting: list[bytes] = []
    compressor, waiting_bytes, written = None, 0, 0

    def opened() -> bytes:
        nonlocal compressor, waiting_bytes
        learnt = _dictionary([r[:16384] for r in waiting])
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=learnt, write_content_size=True)
        frames = [compressor.compress(r) for r in waiting]
        if learnt is not None:
            body = learnt.as_bytes()
            frames.insert(0, struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
        waiting.clear()
        waiting_bytes = 0
        return b"".join(frames)

    for record in records:
        if compressor is None:
            waiting.append(record)
            waiting_bytes += len(record)
            if len(waiting) < DICTIONARY_RECORDS and waiting_bytes < min(DICTIONARY_SAMPLE_BYTES, archive_bytes):
                continue
            frames = opened()
        else:
            frames = compressor.compress(record)
        written += len(frames)
        ends = written >= archive_bytes
        if ends:
            compressor, written = None, 0
        yield frames, ends
    if waiting:
        yield opened(), False


def _archive_writer(archive_bytes: int, row_bytes: int, rows_per_file: int):
    """Rows of whole frames; an archive that ends is filled up to ``rows_per_file`` with empty rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def as_batch(values: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["frames"])

        def records() -> Iterator[bytes]:
            for batch in batches:
                names = batch.schema.names
                for values in zip(*batch.columns):
                    yield record_bytes({n: v.as_py() for n, v in zip(names, values)})

        waiting, size, rows = [], 0, 0
        for frames, ends in _archives_of(records(), archive_bytes):
            waiting.append(frames)
            size += len(frames)
            if ends or size >= row_bytes:
                yield as_batch([b"".join(waiting)])
                waiting, size, rows = [], 0, rows + 1
            if ends:
                yield as_batch([b""] * (rows_per_file - rows))
                rows = 0
        if waiting:
            yield as_batch([b"".join(waiting)])

    return write


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records of ``plan_records`` as archives, one or more per partition of ``records``.

    An archive is as large as ``archive_bytes`` and its last record at most, whatever
    the number and evenness of the partitions.
    """
    row_bytes = min(ROW_BYTES, archive_bytes)
    # An archive has at most so many rows, and always ends within them.
    rows_per_file = archive_bytes // row_bytes + 1
    frames = records.mapInArrow(_archive_writer(archive_bytes, row_bytes, rows_per_file), "frames binary")
    frames.select(F.col("frames").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option(
        "maxRecordsPerFile", rows_per_file
    ).text(path)


def frames_of(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """``(magic, frame)`` for each frame, found from the block headers without unfolding anything."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError(f"{len(data) - at} bytes left over after the last frame")
        magic, length = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            end = at + 8 + length
        elif magic == FRAME_MAGIC:
            head = data[at : at + 18]
            end = at + zstandard.frame_header_size(head)
            last = False
            while not last:
                if end + 3 > len(data):
                    raise ValueError("a frame is cut off")
                header = int.from_bytes(data[end : end + 3], "little")
                last, kind = bool(header & 1), header >> 1 & 3
                if kind == 3:
                    raise ValueError("a block of reserved type")
                end += 3 + (1 if kind == 1 else header >> 3)
            end += 4 * zstandard.get_frame_parameters(head).has_checksum
        else:
            raise ValueError(f"no frame begins with {magic:#x}")
        if end > len(data):
            raise ValueError("a frame is cut off")
        yield magic, data[at:end]
        at = end


def _unfolded(decompressor: zstandard.ZstdDecompressor, frame: memoryview) -> bytes:
    with decompressor.stream_reader(frame) as stream:
        record = stream.read(MAX_RECORD_BYTES + 1)
    if len(record) > MAX_RECORD_BYTES:
        raise ValueError(f"a record of over {MAX_RECORD_BYTES} bytes")
    return record


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record; a ValueError tells what is wrong with it."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC/1.0 or WARC/1.1 header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"a malformed header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    missing = [n for n in REQUIRED if n not in headers]
    if missing:
        raise ValueError(f"no {', '.join(missing)}")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    http, gap, body = rest[:length].partition(b"\r\n\r\n")
    declared = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return {"headers": headers, "payload": rest[:length], "payload_bytes": length, "digest": None}
    if not gap or declared is None:
        raise ValueError("no HTTP header with a length")
    digest = headers.get("warc-payload-digest", "")
    if not re.fullmatch(r"sha1:[A-Z2-7]{32}", digest):
        raise ValueError("no SHA-1 payload digest")
    wanted = base64.b32decode(digest[5:]).hex()
    if kind == "response" and len(body) != int(declared[1]):
        raise ValueError(f"the HTTP length is {int(declared[1])}, the payload has {len(body)} bytes")
    if kind == "response" and hashlib.sha1(body).hexdigest() != wanted:
        raise ValueError("the payload does not match its digest")
    if kind == "revisit" and (body or "warc-refers-to" not in headers):
        raise ValueError("a revisit needs WARC-Refers-To and has no body")
    payload = body if kind == "response" else None
    return {"headers": headers, "payload": payload, "payload_bytes": int(declared[1]), "digest": wanted}


READ_SCHEMA = (
    "archive string, record_no bigint, page_id bigint, url string, record_type string,"
    " refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, error string"
)


def records_of(data: bytes, archive: str) -> Iterator[tuple]:
    """Rows of ``READ_SCHEMA`` for one archive; a broken record is a row with ``error``.

    The dictionary is taken from the archive's first frame, folded or plain.
    Damage to the frames themselves gives one last error row.
    """
    decompressor, number = zstandard.ZstdDecompressor(), 0
    try:
        for i, (magic, frame) in enumerate(frames_of(memoryview(data))):
            if i == 0 and magic == DICTIONARY_MAGIC:
                body = bytes(frame[8:])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = _unfolded(zstandard.ZstdDecompressor(), memoryview(body))
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            if magic != FRAME_MAGIC:
                continue
            number += 1
            try:
                found = parse_record(_unfolded(decompressor, frame))
            except (ValueError, zstandard.ZstdError) as wrong:
                yield (archive, number, *[None] * 7, str(wrong))
                continue
            head = found["headers"]
            yield (
                archive,
                number,
                _page_of(head["warc-record-id"]),
                head.get("warc-target-uri"),
                head["warc-type"],
                _page_of(head.get("warc-refers-to")),
                found["payload_bytes"],
                found["digest"],
                found["payload"],
                None,
            )
    except (ValueError, zstandard.ZstdError) as wrong:
        yield (archive, number + 1, *[None] * 7, str(wrong))


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
_BATCH_BYTES = 8 << 20


def _reader(with_payload: bool, strict: bool):
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for path, content in zip(*batch.columns):
                for row in records_of(content.as_py(), path.as_py()):
                    if strict and row[-1]:
                        raise ValueError(f"{row[0]}, record {row[1]}: {row[-1]}")
                    rows.append(row if with_payload else (*row[:8], None, row[9]))
                    size += 200 + len(rows[-1][8] or b"")
                    if size >= _BATCH_BYTES:
                        yield flushed()
                        rows, size = [], 0
        if rows:
            yield flushed()

    return read


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """Read Zstandard WARC archives: one row per record, columns of ``READ_SCHEMA``.

    Header syntax, required headers, block length, HTTP length and payload
    digest are checked. ``strict`` fails on the first broken record; otherwise it
    becomes a row with ``error``. An archive is read whole by one task; those of
    ``write_warc`` are bounded.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(with_payload, strict), READ_SCHEMA)


def through_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to archives in the shared folder and read the archives back.

    Rows come back as often as they were given, with null ids and urls kept as
    nulls. Empty tables give an empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    path = folder or shared_dir(spark)
    write_warc(plan_records(pages), path)
    return read_warc(spark, path, with_payload=False)
