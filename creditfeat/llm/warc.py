"""WARC archives in Zstandard: writer and reader.

An archive begins with a skippable frame that holds its dictionary; then comes one frame for each
record, so a record can be read from its offset alone. The reader loads the dictionary from the
leading frame, decodes frame by frame as a stream, and checks version, headers, block length, block
digest and payload digest of every record.

Tasks write archives straight to the shared folder under names of their own attempt. Only archives
of attempts that succeeded are listed in the staged manifest, so a lost executor leaves at most files
that nobody reads.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat.llm.common import pick, ship_package, stage

DICTIONARY_FRAME = 0x184D2A5D
_VERSIONS = (b"WARC/1.0", b"WARC/1.1")
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """``roll_bytes``: compressed size at which a task starts the next archive; ``sample_bytes``:
    of an archive's first records, what its dictionary is trained on; ``least_bytes``: payloads from
    this size on are stored once."""

    roll_bytes: int = 64 << 20
    sample_bytes: int = 1 << 20
    dictionary_bytes: int = 32 << 10
    level: int = 3
    least_bytes: int = 1000
    date: str = "1970-01-01T00:00:00Z"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _target(url: str | None, page_id: int | None) -> str:
    """The address with blanks and control characters escaped, so that it can't end a header."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str
) -> bytes:
    """A response with its payload, or, with ``refers_to``, a revisit that has the HTTP header only."""
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    )
    if refers_to is None:
        block += payload or b""
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": _target(url, page_id),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": "sha1:" + hashlib.sha1(block).hexdigest(),
        "WARC-Payload-Digest": "sha1:" + digest,
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        headers |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": _IDENTICAL}
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], how: Archive) -> bytes:
    """A dictionary trained on the samples; of too few, their end as raw content."""
    try:
        return zstandard.train_dictionary(how.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-how.dictionary_bytes :]


def write_archives(records: DataFrame, folder: str, how: Archive = Archive()) -> DataFrame:
    """Write ``records`` (page_id, url, payload, payload_bytes, payload_digest, refers_to) and return
    the staged manifest: ``path``, ``records``, ``bytes``. Memory holds one batch, and the sample of a
    dictionary."""
    ship_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        stem = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        listed: list[tuple[str, int, int]] = []

        def raw() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    yield record_bytes(*row, how.date)

        def write(samples: list[bytes], rest: Iterator[bytes]) -> None:
            name = f"pages-{stem}-{len(listed):04d}.warc.zst"
            content = _dictionary(samples, how)
            squeeze = zstandard.ZstdCompressor(
                level=how.level, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True
            )
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
                count = 0
                for record in _chained(samples, rest):
                    out.write(squeeze.compress(record))
                    count += 1
                    if out.tell() >= how.roll_bytes:
                        break
                size = out.tell()
            listed.append((f"{folder}/{name}", count, size))

        rest = raw()
        while True:
            samples: list[bytes] = []
            held = 0
            for record in rest:
                samples.append(record)
                held += len(record)
                if held >= how.sample_bytes:
                    break
            if not samples:
                break
            while samples:  # more than once if an archive is full within its sample
                write(samples, rest)
                samples = samples[listed[-1][1] :]
        columns = list(zip(*listed, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "records", "bytes"]
        )

    order = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
    manifest = records.select(*order).mapInArrow(run, "path string, records bigint, bytes bigint")
    return stage(manifest, "archives")


def _chained(samples: list[bytes], rest: Iterator[bytes]) -> Iterator[bytes]:
    yield from samples
    yield from rest


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def frames(stream, chunk_bytes: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every frame after the dictionary frame."""
    head = stream.read(8)
    dictionary, at = None, 0
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        content = stream.read(size)
        if len(content) != size:
            raise WarcError("the dictionary frame is cut off")
        if content[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        dictionary, at, held = zstandard.ZstdCompressionDict(content), 8 + size, b""
    else:
        held = head
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while held or (held := stream.read(chunk_bytes)):
        parts, one, used = [], decoder.decompressobj(), 0
        while True:
            parts.append(one.decompress(held))
            used += len(held)
            if one.eof:
                break
            held = stream.read(chunk_bytes)
            if not held:
                raise WarcError(f"the frame at {at} is cut off")
        held = one.unused_data
        yield at, b"".join(parts)
        at += used - len(held)


def _header_block(data: bytes, what: str) -> tuple[bytes, dict[str, str], bytes]:
    """First line, headers by lower-case name, and what follows the empty line."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError(f"{what} has no end of headers")
    first, *lines = data[:end].split(b"\r\n")
    headers = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{what} has a broken header line")
        headers[name.lower()] = value.strip()
    return first, headers, data[end + 4 :]


def parse_record(data: bytes) -> dict:
    """The fields of one record; ``WarcError`` if a header, length or digest is wrong."""
    first, headers, rest = _header_block(data, "the record")
    if first not in _VERSIONS:
        raise WarcError(f"unknown version {first[:20]!r}")
    if missing := [name for name in _REQUIRED if name not in headers]:
        raise WarcError(f"headers are missing: {missing}")
    if not headers["content-length"].isdigit():
        raise WarcError("the length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, its header says {size}")
    block = rest[:size]
    if (told := headers.get("warc-block-digest")) and told != "sha1:" + hashlib.sha1(block).hexdigest():
        raise WarcError("the block digest is wrong")
    _, http, payload = _header_block(block, "the HTTP block")
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers or not told:
            raise WarcError("a revisit needs a reference and a digest and has no payload")
        length = int(http.get("content-length", "-1"))
    else:
        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if told and told != digest or int(http.get("content-length", length)) != length:
            raise WarcError("the payload doesn't fit its digest or length")
        told = digest
    return {
        "record_id": headers["warc-record-id"],
        "record_type": headers["warc-type"],
        "date": headers["warc-date"],
        "target_uri": headers.get("warc-target-uri"),
        "payload": payload,
        "payload_bytes": length,
        "payload_digest": told,
        "refers_to": headers.get("warc-refers-to"),
    }


_FIELDS = [
    ("path", pa.string()),
    ("offset", pa.int64()),
    ("record_id", pa.string()),
    ("record_type", pa.string()),
    ("date", pa.string()),
    ("target_uri", pa.string()),
    ("payload", pa.binary()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("refers_to", pa.string()),
]


def read_archives(files: DataFrame, payloads: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """All records of the archives in ``files`` (``path``), an archive at a time in each task.

    A broken archive or record ends the job with ``WarcError`` and its place. ``payloads=False``
    checks payloads but leaves them out of the result. No archives give an empty result.
    """
    ship_package(files.sparkSession)
    fields = [f for f in _FIELDS if payloads or f[0] != "payload"]

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[name] for r in rows], kind) for name, kind in fields], [f[0] for f in fields]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p.as_py() for batch in batches for p in batch.column(0)):
            fs, name = _open(path)
            rows, held = [], 0
            with fs.open_input_stream(name) as stream:
                for at, data in frames(stream):
                    try:
                        record = parse_record(data)
                    except (WarcError, ValueError) as e:
                        raise WarcError(f"{path} at {at}: {e}") from None
                    rows.append({"path": path, "offset": at} | record)
                    held += len(data) if payloads else 500
                    if held >= batch_bytes:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)

    types = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    kind = ", ".join(f"`{name}` {types[t]}" for name, t in fields)
    spread = files.select("path").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, kind)


def plan_records(pages: DataFrame, how: Archive = Archive()) -> DataFrame:
    """What to write for every row of ``pages`` (page_id, url, html).

    Null html is an empty payload. Of equal payloads of at least ``least_bytes`` the row with the
    largest page_id is the response and others revisit it; rows that repeat that very id are
    responses too, as are all where every id is null. Further columns are ignored.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pick(pages, page_id="bigint", url="string", html="string").select(
        "page_id",
        "url",
        body.alias("payload"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"),
    )
    # One narrow row for each group, so pages are shuffled once; hot groups are split by the join.
    shared = (
        rows.filter(F.col("payload_bytes") >= how.least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("_last"), F.count("*").alias("_rows"))
        .filter((F.col("_rows") > 1) & F.col("_last").isNotNull())
        .drop("_rows")
    )
    joined = rows.join(shared, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= how.least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_last")) & F.col("_last").isNotNull()
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, F.col("_last")).alias("refers_to"),
    )


def page_of(record_id: str):
    """The page_id inside a record id of this writer, null for pages without one."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the archives that match a path or glob, found by Spark without reading them."""
    return spark.read.format("binaryFile").load(path).select("path")
