"""Operator 8, WARC archives in Zstandard frames with a shared dictionary.

An archive opens with a skippable frame that holds a dictionary trained on its first payloads; then each record
is one frame. The reader loads the dictionary, decodes frame by frame in time proportional to the archive, and
checks version line, header syntax, lengths and digests. Archives travel as rows of path, length and content,
the columns of Spark's binaryFile source, so the reader takes files and tables alike, and a lost task's archives
are written again by the commit protocol.

Of records with equal payloads of at least LEAST bytes, the one with the smallest id is a response, others
revisit it; rows that repeat this id are responses, too. A null payload is empty; a null id revisits the least
known id, or is a response if there is none; an empty table gives no archive; columns other than the three are
not read. A damaged record gives a row with its error, and reading goes on behind it where a frame boundary is known.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Bytes of a payload that may be revisited; compressed bytes and records after which an archive is closed;
#: bytes of payloads that its dictionary is trained on, and the dictionary's size.
LEAST, ARCHIVE_BYTES, ARCHIVE_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 100, 8 << 20, 20_000, 1 << 20, 16 << 10

# The frame magics of the Zstandard and WARC/Zstandard formats.
DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit whose block is the HTTP header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"") if refers_to is None else head
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def archives(records: Iterator[bytes], level: int = 3) -> Iterator[tuple[bytes, int]]:
    """(archive, its records)."""
    records = iter(records)
    while True:
        held, size = [], 0
        for r in records:
            held.append(r)
            size += len(r)
            if size >= TRAIN_BYTES:
                break
        if not held:
            return
        out, dictionary = [], None
        if len(held) >= 16:
            try:
                dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in held])
            except zstandard.ZstdError:
                pass  # too little to learn from: the archive goes without
        if dictionary is not None:
            data = dictionary.as_bytes()
            out.append(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
        out += map(press.compress, held)
        n, size = len(held), sum(map(len, out))
        while size < ARCHIVE_BYTES and n < ARCHIVE_RECORDS and (r := next(records, None)) is not None:
            out.append(press.compress(r))
            n, size = n + 1, size + len(out[-1])
        yield b"".join(out), n


def frames(data: bytes) -> Iterator[bytes | Exception]:
    """Each frame's content, by the dictionary of the leading skippable frame. A damaged frame ends the archive."""
    at, dictionary = 0, None
    view = memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        (size,) = struct.unpack_from("<I", data, 4)
        own = data[8 : 8 + size]
        if len(own) < size:
            yield ValueError("dictionary is cut off")
            return
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(own) if own[:4] == ZSTD_MAGIC else own)
        at = 8 + size
    press = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if at + 8 <= len(data) and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one, out, step = press.decompressobj(), [], 1 << 12
        try:
            while not one.eof:
                if at >= len(data):
                    raise ValueError("frame is cut off")
                out.append(one.decompress(view[at : at + step]))
                at, step = min(at + step, len(data)), min(2 * step, 1 << 20)
        except (zstandard.ZstdError, ValueError) as e:
            yield e
            return
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record; ValueError if it isn't well formed."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("malformed header line")
        fields[name.strip().lower().decode()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = int(fields["content-length"]) if fields["content-length"].isdecimal() else -1
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("length differs from Content-Length")
    block = rest[:size]
    if (d := fields.get("warc-block-digest", "")).startswith("sha256:") and d[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    return fields, block


def _id(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdecimal() else None


def page(data: bytes) -> dict:
    """What a record says of its page: ids, size and digest of the whole payload, kind."""
    fields, block = parse(data)
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no HTTP header")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        own = hashlib.sha256(payload).hexdigest()
        if digest and digest != own:
            raise ValueError("payload digest differs")
        size, digest = len(payload), own
    else:
        size = int(http.get(b"content-length", b"0"))
    return {"page_id": _id(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _id(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "url": fields.get("warc-target-uri"), "error": None}


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, error string"


def read_archives(files: DataFrame) -> DataFrame:
    """A row a record of archives in column content (a binaryFile frame, or write_archives' table)."""

    def rows(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("error", pa.string())])
        for b in batches:
            for x in b.column(0):
                out = []
                for data in frames(x.as_py() or b""):
                    try:
                        if isinstance(data, Exception):
                            raise ValueError(str(data))
                        out.append(page(data))
                    except ValueError as e:
                        out.append(dict.fromkeys(schema.names) | {"record_type": "invalid", "error": str(e)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("content").mapInArrow(rows, READ)


def write_archives(pages: DataFrame, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """path, length and content of the archives of page_id, url and html, written to the shared folder."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    firsts = own.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    # a hot payload's rows are split by Spark's skew join; its side has one row a digest
    dealt = own.join(firsts, "digest", "left").withColumn("refers_to", F.expr("CASE WHEN first IS NOT NULL AND NOT first <=> page_id THEN first END"))
    # a revisit needs no payload
    dealt = dealt.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "digest", "refers_to")

    def rows(batches):
        part = TaskContext.get().partitionId()

        def records():
            for b in batches:
                for i, u, h, n, d, r in zip(*(b.column(k) for k in range(6)), strict=True):
                    yield record(i.as_py(), u.as_py(), h.as_buffer().to_pybytes() if h.is_valid else None, n.as_py(), d.as_py(), r.as_py(), date)

        for k, (data, n) in enumerate(archives(records())):
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{k:05d}.warc.zst"]), pa.array([len(data)], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["path", "length", "records", "content"])

    return materialize(dealt.mapInArrow(rows, "path string, length long, records long, content binary"), "archives")


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
