"""WARC archives: a writer that turns equal payloads into revisits, and a splittable reader.

Writer: one gzip member per record. Of records with equal payloads of at least `least_bytes` bytes the one with
the smallest page_id is the response and the others are revisits that refer to it. Files are immutable and
named by attempt; only those in the committed manifest are read.

Reader: a task gets a byte range of a file. It looks for the gzip magic from the range's start, takes a place
for a member only if what it decodes to begins like a WARC record and its checksum holds, and owns the records
that start inside its range, reading on past the end for the last one. So any split of a file gives each
record once. Members follow each other without a gap: from the first one on, and from the file's start, a task requires
that each ends where the next begins, looks at the head of the first member behind its range, and fails with file and
offset otherwise, so that no damaged record goes missing.

Defined cases: a null html is the empty payload; a null page_id is written as such, is never referred to and
never refers to itself; rows that repeat the smallest page_id of a payload are all responses; urls are kept with
control characters percent-encoded; other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, open_fs, stage, write_file

_MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _name(page_id) -> str:
    return "none" if page_id is None else str(page_id)


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member holding a response record, or a revisit without the payload when refers_to is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_name(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.insert(5, f"WARC-Refers-To: <urn:page:{_name(refers_to)}>")
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, out: str | None = None, most_bytes: int = 64 << 20
) -> DataFrame:
    """Write pages as archives; returns the manifest: file, size."""
    folder = out or new_dir(pages.sparkSession, "warc")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = own.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    firsts = keyed.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    joined = keyed.join(firsts.select("sha", "n", "first"), ["sha", "n"], "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))

    def run(batches):
        import pyarrow as pa

        files, parts, held = [], [], 0

        def close():
            name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            data = b"".join(parts)
            write_file(name, data)
            files.append({"file": name, "size": len(data)})

        for batch in batches:
            for p, u, h, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(record(p, u, h.encode(), r))
                held += len(parts[-1])
                if held >= most_bytes:
                    close()
                    parts, held = [], 0
        if parts:
            close()
        yield pa.RecordBatch.from_pylist(files, pa.schema([("file", pa.string()), ("size", pa.int64())]))

    rows = joined.select("page_id", "url", "html", refers.alias("refers_to"))
    return stage(rows.mapInArrow(run, "file string, size long"), "warc-manifest")


class DamagedArchive(ValueError):
    """A place in an archive where a record should begin, or does, but cannot be read."""


def members(uri: str, start: int, end: int, step: int = 1 << 20, strict: bool = False):
    """(offset, bytes) of each WARC record whose gzip member starts in [start, end) of the file.

    strict: bytes that belong to no readable record raise DamagedArchive instead of being passed over.
    """
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(start)
        base, data, at = start, f.read(end - start + 2), 0  # two more bytes: a magic may straddle the end

        def more() -> bool:
            nonlocal data
            f.seek(base + len(data))
            new = f.read(step)
            data += new
            return bool(new)

        def opened(at: int):
            """(unpacker, first bytes, place behind what was fed) of a record's member at a place, else None."""
            unpacker, first, fed = zlib.decompressobj(31), b"", at
            try:
                while not unpacker.eof and len(first) < 7 and (fed < len(data) or more()):
                    first += unpacker.decompress(data[fed : fed + 512])
                    fed = min(fed + 512, len(data))
            except zlib.error:
                return None
            return (unpacker, first, fed) if first.startswith(b"WARC/1.") else None

        due = strict and start == 0  # a record must begin right here
        while True:
            found = at if due else data.find(_MAGIC, at)
            if found < 0 or base + found >= end:
                if due and base + at < size and opened(at) is None:
                    raise DamagedArchive(f"{uri}: no record at byte {base + at}")
                return
            at = found
            member = opened(at)
            if member is None:
                if due:
                    raise DamagedArchive(f"{uri}: no record at byte {base + at}")
                at += 1
                continue
            unpacker, first, fed = member
            out = [first]
            try:
                while not unpacker.eof:
                    if fed >= len(data) and not more():
                        raise zlib.error("cut off")
                    out.append(unpacker.decompress(data[fed : fed + (1 << 16)]))  # in steps: what is left over is copied
                    fed = min(fed + (1 << 16), len(data))
            except zlib.error as e:
                if strict:
                    raise DamagedArchive(f"{uri}: the record at byte {base + at} cannot be read: {e}") from e
                at += 1
                continue
            yield base + at, b"".join(out)
            at, due = fed - len(unpacker.unused_data), strict


def parse(raw: bytes) -> dict:
    """Type, ids, length and digest of a record; a response's payload is checked against its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    payload = None
    if kind == "response":
        payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        n, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest:
            raise ValueError(f"digest of {fields['WARC-Record-ID']} differs: {own}, {digest}")
    name = lambda x: None if x is None or x.endswith(":none>") else int(x.removeprefix("<urn:page:").rstrip(">"))
    return {
        "page_id": name(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": n, "payload_digest": digest,
        "record_type": kind, "refers_to": name(fields.get("WARC-Refers-To")), "payload": payload,
    }


def read_archives(manifest: DataFrame, *, split_bytes: int = 4 << 20, payloads: bool = False) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload].

    A file that is shorter or longer than the manifest says, or holds bytes that are no record, fails the read.
    """
    ranges = manifest.where("size > 0").select("file", F.col("size").alias("total"), F.explode(F.expr(f"sequence(0L, size - 1, {split_bytes}L)")).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + split_bytes, "total").alias("stop"), "total")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["url", "payload"] * payloads]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads

    def run(batches):
        import pyarrow as pa

        kinds = {"payload_digest": pa.string(), "record_type": pa.string(), "url": pa.string(), "payload": pa.binary()}
        form = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
        for batch in batches:
            for uri, start, stop, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = open_fs(uri)
                if (size := fs.get_file_info(path).size) != total:
                    raise DamagedArchive(f"{uri}: {size} bytes, the manifest says {total}")
                rows, held = [], 0
                for _, raw in members(uri, start, stop, strict=True):
                    row = parse(raw)
                    rows.append({n: row[n] for n in names})
                    held += len(raw)
                    if held >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, form)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, form)

    total = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    return ranges.repartition(max(1, min(int(total), 20_000))).mapInArrow(run, schema)
