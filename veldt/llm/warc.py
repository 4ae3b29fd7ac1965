"""WARC archives in Zstandard frames: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary;
every record follows as a frame of its own, compressed with it. The reader takes the
dictionary from that frame, decodes frame by frame from a stream, and checks the version
line, the mandatory fields, the block length, the record's end and, for whole payloads,
the digest; anything else raises ``WarcError``. Archives of other writers are read too:
version 1.0 or 1.1, field names in any case, folded fields, any record id (``page_id`` is
null unless the id names a page), HTTP without a length, further skippable frames, no
dictionary at all; records of other types are checked and passed over.

A task writes one archive: first under a name of its attempt, then moved over the name of
its partition, so a lost executor's archive is written again in whole and never read in
part. Archives lie in the shared folder; both sides stream them.

Odd input: a null payload is empty; empty payloads are payloads; a null url leaves out
the target field; of equal payloads all rows with the least page_id are responses (an id
names one record); where all ids of a payload are null, all are responses; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import shared_dir, written

DICT_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return "<urn:page:-->" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: str | None) -> int | None:
    """The page that a record id names; of other writers' ids, none."""
    name = urn[10:-1] if urn is not None and urn.startswith("<urn:page:") and urn.endswith(">") else ""
    return int(name) if name.removeprefix("-").isascii() and name.removeprefix("-").isdigit() else None


def record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool, payload_digest: str, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", f"sha1:{payload_digest}"))
    if is_revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> Iterator[tuple[str, str]]:
    """(lower-case name, value) of header lines; a line that begins with a blank goes on with the one before."""
    lines: list[bytes] = []
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and lines:
            lines[-1] += b" " + line.strip()
        else:
            lines.append(line)
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"field {line[:40]!r}")
        try:
            yield name.decode().lower(), value.strip().decode()
        except UnicodeDecodeError as e:
            raise WarcError(f"field {line[:40]!r} is not UTF-8") from e


def _length(value: str) -> int:
    if not (value.isascii() and value.isdigit()):
        raise WarcError("Content-Length is no number")
    return int(value)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (by lower-case name) and block of one record, validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in VERSIONS:
        raise WarcError(f"version line {version[:40]!r}")
    fields: dict[str, str] = {}
    for name, value in _fields(lines):
        if name in fields and name != "warc-concurrent-to":
            raise WarcError(f"{name} is named twice")
        fields[name] = value
    for name in MANDATORY:
        if name.lower() not in fields:
            raise WarcError(f"{name} is missing")
    n = _length(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, {n} announced")
    return fields, rest[:n]


def _sha1(fields: dict[str, str]) -> str | None:
    method, _, named = fields.get("warc-payload-digest", "").partition(":")
    if method.lower() == "sha1" and len(named) != 32:
        raise WarcError("payload digest")
    return named.upper() if method.lower() == "sha1" else None


def read_record(raw: bytes) -> tuple[int | None, int | None, str | None, str, int | None, bytes | None] | None:
    """page_id, payload bytes, digest, record type, refers_to, payload (None for a revisit); None for other types."""
    fields, block = parse(raw)
    kind, named = fields["warc-type"], _sha1(fields)
    if kind not in ("response", "revisit"):
        return None
    page = _page(fields["warc-record-id"])
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if kind == "response" and not fields.get("content-type", "").lower().startswith("application/http"):
        n, payload = len(block), block  # the payload as it is
    elif not gap or not status.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    else:
        lengths = {v for k, v in _http_fields(lines) if k == "content-length"}
        if len(lengths) > 1:
            raise WarcError("HTTP Content-Length is named twice")
        n = _length(lengths.pop()) if lengths else None
    if kind == "revisit":
        if payload or "warc-profile" not in fields:
            raise WarcError("malformed revisit")
        return page, n, named, kind, _page(fields.get("warc-refers-to")), None
    if n is not None and len(payload) != n:
        raise WarcError(f"payload of {len(payload)} bytes, {n} announced")
    found = digest(payload)
    if named is not None and found != named:
        raise WarcError("payload digest differs")
    return page, len(payload), found, kind, None, payload


def _http_fields(lines: bytes) -> Iterator[tuple[str, str]]:
    """Servers send what they like: only well-formed lines count."""
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            yield name.strip().decode("latin-1").lower(), value.strip().decode("latin-1")


def train(samples: list[bytes], size: int) -> bytes:
    """A raw-content dictionary: pieces of different sample payloads, the likeliest to recur last (nearest)."""
    record_ = record(0, "http://", b"", None, False, digest(b""), "2024-01-01T00:00:00Z")
    pieces = [p[: max(64, size // 64)] for p in dict.fromkeys(samples) if p]
    return (b"".join(pieces) + record_)[-size:]


def frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """Decoded records of one archive, one per frame."""
    left, ctx, first = b"", zstandard.ZstdDecompressor(), True
    while True:
        while len(left) < 8 and (more := stream.read(chunk)):
            left += more
        if not left and not first:
            return
        if len(left) < 8:
            raise WarcError("frame cut short" if left else "empty archive")
        magic, size = struct.unpack("<II", left[:8])
        if magic in SKIPPABLE:
            while len(left) < 8 + size:
                more = stream.read(max(chunk, 8 + size - len(left)))
                if not more:
                    raise WarcError("skippable frame cut short")
                left += more
            body, left = left[8 : 8 + size], left[8 + size :]
            if magic == DICT_MAGIC and first:
                try:
                    if body[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                        body = zstandard.ZstdDecompressor().decompress(body)
                    ctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                except zstandard.ZstdError as e:
                    raise WarcError(f"dictionary: {e}") from e
            first = False
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"frame {magic:#x}")
        first = False
        one, out = ctx.decompressobj(), []
        while True:
            try:
                out.append(one.decompress(left))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame: {e}") from e
            if one.eof:
                left = one.unused_data
                break
            left = stream.read(chunk)
            if not left:
                raise WarcError("last frame cut short")
        yield b"".join(out)


def _write(batches: Iterator[pa.RecordBatch], folder: str, dictionary: bytes, date: str, level: int) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    part = TaskContext.get().partitionId()
    final, mine = f"{root}/part-{part:06d}.warc.zst", f"{root}/.{part:06d}-{uuid.uuid4().hex}"
    ctx = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
    n = 0
    out = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if out is None:
                    out = store.open_output_stream(mine, compression=None)
                    out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
                payload = row["html"] or b""
                revisit = row["first"] is not None and row["page_id"] != row["first"]
                out.write(ctx.compress(record(row["page_id"], row["url"], payload, row["first"], revisit, digest(payload), date)))
                n += 1
    if out is not None:
        out.close()
        store.move(mine, final)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], names=["part", "records"])


def write_archives(pages: DataFrame, dictionary_size: int = 65536, samples: int = 200, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> tuple[str, int]:
    """Writes page_id, url, html as archives; -> (folder, records). The dictionary is fitted on ``samples`` payloads at most."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    some = [bytes(r[0])[:16384] for r in pages.select(body).limit(samples).collect()]
    dictionary = train(some, dictionary_size)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha1(body).alias("digest"))
    least = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marked = rows.join(least, "digest", "left").select("page_id", "url", "html", "first")
    done = written(marked.mapInArrow(partial(_write, folder=folder, dictionary=dictionary, date=date, level=level), "part int, records long"), "warc-parts")
    return folder, done.agg(F.sum("records")).first()[0] or 0


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            uri = path if "://" in path else "file://" + path.removeprefix("file:")
            store, name = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(name, compression=None) as stream:
                rows: list[tuple] = []
                for raw in frames(stream):
                    row = read_record(raw)
                    if row is None:
                        continue
                    rows.append(row)
                    if len(rows) >= 256:
                        yield _batch(rows, payloads)
                        rows = []
                if rows:
                    yield _batch(rows, payloads)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    n = 6 if payloads else 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:n], kinds[:n], strict=True)], names=names[:n])


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every response and revisit under ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")
    n = max(1, min(10_000, files.count()))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return files.repartition(n, "path").mapInArrow(partial(_read, payloads=payloads), schema)
