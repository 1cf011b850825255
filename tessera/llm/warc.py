"""WARC (operator 6): a dictionary-compressed writer and its reader.

Each archive starts with a skippable frame that embeds a Zstandard dictionary built from the archive's
own records; then comes one independent frame per record.  Spark's text sink writes the archives
through its commit protocol to any file system Spark can reach: a row is a few frames, and the line
separator is an empty skippable frame, which decoders pass over.  Archives are rolled after so many
rows, and each begins with the dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import work

DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
FRAME_MAGIC = 0xFD2FB528
#: Records of an archive that its dictionary is built from, in bytes, and the dictionary's size.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 32 << 10
LEVEL = 3
#: Compressed bytes that fill a row (a longer record is a row of its own) and rows of an archive.
ROW_BYTES, ARCHIVE_ROWS = 1 << 20, 256
#: Rows of the table of repeated payloads up to which it is broadcast (about 100 bytes each).
BROADCAST_ROWS = 50_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page: str | None, sha: str) -> str:
    return f"<urn:page:{quote(page, safe='')}>" if page is not None else f"<urn:nopage:{sha}>"


def record(page: str | None, url: str | None, payload: bytes, revisit: bool, refers: str | None, date: str) -> bytes:
    """One WARC record.  A revisit has the payload's HTTP head, with its full length, and no payload."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else _uri(page, sha)[1:-1]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page, sha)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers, sha)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower-cased names) and block of a record, checked for shape."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its header")
    return fields | {"block": rest[:n]}


def _page(uri: str | None) -> str | None:
    return unquote(uri[len("<urn:page:") : -1]) if uri and uri.startswith("<urn:page:") else None


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES):
    """A trained dictionary; with too few records to train one, their own bytes as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its header and block headers."""
    magic, described = struct.unpack_from("<IB", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME_MAGIC:
        raise ValueError("not a frame")
    single, checksum = described >> 5 & 1, described >> 2 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[described & 3] + ((1 if single else 0), 2, 4, 8)[described >> 6]
    while True:
        b = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if b >> 1 & 3 == 1 else b >> 3)
        if b & 1:
            return at + 4 * checksum


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed one by one with the dictionary it starts with."""
    import zstandard

    view, at, plain = memoryview(data).cast("B"), 0, None
    while at < len(view):
        end = frame_end(view, at)
        magic = struct.unpack_from("<I", view, at)[0]
        if magic == DICTIONARY_MAGIC:
            body = bytes(view[at + 8 : end])
            if body[:4] == struct.pack("<I", FRAME_MAGIC):
                body = zstandard.ZstdDecompressor().decompress(body)
            plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        elif magic == FRAME_MAGIC:
            yield (plain or zstandard.ZstdDecompressor()).decompress(view[at:end])
        at = end


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = LEVEL, row_bytes: int = ROW_BYTES, archive_rows: int = ARCHIVE_ROWS) -> None:
    """Writes one record per row of ``pages`` under ``path``, in archives of about ``archive_rows`` MB.

    Of the rows with equal payloads of at least ``min_bytes`` bytes, that with the largest id is a
    response and the others revisit it; all smaller ones are responses.  A null payload is empty, a
    null id sorts below all ids and gets a record name of its own, a null url is replaced by the
    record's name.  Rows that repeat the largest id of their payload are responses too.  Payloads are
    compared by their SHA-1.  An empty table gives no archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    repeated = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("id").alias("first")).where("n > 1").select(F.col("sha").alias("same"), "first", F.lit(True).alias("again"))
    repeated = work.written(repeated, "repeated")
    if repeated.count() <= BROADCAST_ROWS:  # else a sort-merge join, whose skewed keys are split
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, F.col("sha") == F.col("same"), "left")
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first").cast("string")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def records():
            for batch in batches:
                for a in range(0, batch.num_rows, 64):
                    for row in batch.slice(a, 64).to_pylist():
                        yield record(row["id"], row["url"], row["payload"], row["revisit"], row["first"], date)

        stream, held, size = records(), [], 0
        for r in stream:
            held.append(r)
            size += len(r)
            if size >= SAMPLE_BYTES:
                break
        if not held:
            return
        trained = build_dictionary(held)
        body = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
        packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
        out, size, n_rows = [lead], 0, 0
        for part in (held, stream):
            for r in part:
                out.append(packer.compress(r))
                size += len(out[-1])
                if size >= row_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])
                    n_rows += 1
                    out, size = [lead] if n_rows % archive_rows == 0 else [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])

    packed = rows.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY_FRAME).option("compression", "none").option("maxRecordsPerFile", archive_rows).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to, payload): one row per record,
    digests of responses computed anew and held against the header.  ``payload`` is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for data in frames(content.as_buffer()):
                    r = parse(data)
                    head, _, payload = r["block"].partition(b"\r\n\r\n")
                    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    sha = r["warc-payload-digest"].removeprefix("sha1:")
                    full = r["warc-type"] == "response"
                    if full and (len(payload) != size or digest(payload) != sha):
                        raise ValueError(f"payload of {r['warc-record-id']} is damaged")
                    rows.append((_page(r["warc-record-id"]), r["warc-target-uri"], size, sha, r["warc-type"], _page(r.get("warc-refers-to")), payload if full else None))
                    if len(rows) >= 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return found.mapInArrow(read, "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, reads them back, and returns per record the
    id, payload_bytes, payload_digest, record_type and refers_to."""
    spark = pages.sparkSession
    path = work.new_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes)
    kind = pages.schema[id_col].dataType
    if not work.exists(spark, path, "part-*"):
        empty = spark.createDataFrame([], "payload_bytes bigint, payload_digest string, record_type string")
        return empty.select(F.lit(None).cast(kind).alias(id_col), "*", F.lit(None).cast(kind).alias("refers_to"))
    return read_archives(spark, path).select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
