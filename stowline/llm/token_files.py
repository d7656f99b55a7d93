"""Token ids of documents in Simple-8b files, in ascending id order, and their vectorised reader.

Each task of a range partitioning by doc_id writes one immutable file (more, when it holds over `most_ids`
ids): a header, coded blocks, then a footer with the blocks' word offsets and the documents' ids and lengths.
File names are unique to an attempt, and only names that a committed manifest lists are ever read, so tasks
that run twice or on lost executors do no harm. Files are read whole-footer first, blocks as needed.

Layout, little-endian: magic, block size (uint32), then coded words (uint64); the footer holds arrays of
uint64 word offsets, uint32 lengths and the doc_ids (int64, with a null flag byte each); the last 40 bytes are
five uint64: number of words, blocks, values, documents, and the footer's position.

Defined cases: null and empty texts hold the end id alone; a null doc_id sorts first; repeated doc_ids stay
separate entries, in the order of their texts; other columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import new_dir, open_fs, read_range, stage, task_pieces, write_file
from .pretokens import PretokenCoder, chunks

MAGIC = b"S8BTOK01"
_CODERS: dict = {}


def _as_bytes(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Writer:
    """Gathers documents and codes their ids a whole number of blocks at a time."""

    def __init__(self):
        self.parts, self.pending, self.held = [MAGIC + struct.pack("<I", simple8b.BLOCK) + b"\0\0\0\0"], [], 0
        self.offsets, self.words, self.values = [np.zeros(1, np.int64)], 0, 0
        self.ids, self.nulls, self.lengths = [], [], []

    def add(self, doc_id, data: bytes) -> None:
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(data) // 4)
        self.pending.append(data)
        self.held += len(data) // 4
        if self.held >= 2_000_000:
            self._code(False)

    def _code(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.pending), dtype="<u4")
        n = len(values) if last else len(values) // simple8b.BLOCK * simple8b.BLOCK
        if n:
            words, offsets = simple8b.encode(values[:n])
            self.parts.append(words.astype("<u8").tobytes())
            self.offsets.append(offsets[1:] + self.words)
            self.words += len(words)
            self.values += n
        self.pending, self.held = [values[n:].tobytes()], len(values) - n

    def finish(self) -> bytes:
        self._code(True)
        offsets = np.concatenate(self.offsets)
        foot = [offsets.astype("<u8").tobytes(), np.array(self.lengths, "<u4").tobytes(), np.array(self.ids, "<i8").tobytes(), np.array(self.nulls, np.uint8).tobytes()]
        body = b"".join(self.parts)
        return body + b"".join(foot) + struct.pack("<5Q", self.words, len(offsets) - 1, self.values, len(self.ids), len(body))


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    out: str | None = None,
    most_ids: int = 16_000_000,
    cache_size: int = 400_000,
) -> DataFrame:
    """Encode, append end_id to each document, write files; returns the manifest: file order, name, documents, ids."""
    spark = docs.sparkSession
    folder = out or new_dir(spark, "tokens")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder = _CODERS.get(tokenizer_path)
        if coder is None:
            coder = _CODERS[tokenizer_path] = PretokenCoder(tokenizer_path, _as_bytes, limit=cache_size)
        part, end = TaskContext.get().partitionId(), _as_bytes([end_id])
        rows, writer = [], _Writer()

        def close():
            name = f"{folder}/part-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.s8b"
            write_file(name, writer.finish())
            rows.append((part, len(rows), name, len(writer.ids), writer.values))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            for piece in chunks(texts):
                for values in coder.chunk(piece):
                    writer.add(ids[at], b"".join(values) + end)
                    at += 1
                    if writer.values + writer.held >= most_ids:
                        close()
                        writer = _Writer()
        if writer.ids:
            close()
        schema = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = picked.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(run, "part int, piece int, file string, n_docs long, n_ids long")
    return stage(files, "token-manifest")


def read_file(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, null flags, lengths, all ids) of one file."""
    fs, path = open_fs(uri)
    size = fs.get_file_info(path).size
    n_words, n_blocks, n, n_docs, foot_at = struct.unpack("<5Q", read_range(uri, size - 40, 40))
    foot = read_range(uri, foot_at, size - 40 - foot_at)
    if read_range(uri, 0, 8) != MAGIC:
        raise ValueError(f"not a token file: {uri}")
    cut = np.cumsum([0, 8 * (n_blocks + 1), 4 * n_docs, 8 * n_docs, n_docs])
    offsets, lengths, ids, nulls = (np.frombuffer(foot[a:b], t) for a, b, t in zip(cut, cut[1:], ("<u8", "<u4", "<i8", "u1"), strict=False))
    at, step, out = offsets.astype(np.int64), 4096, []
    for b in range(0, n_blocks, step):  # some blocks at a time, to bound memory
        e = min(b + step, n_blocks)
        words = np.frombuffer(read_range(uri, 16 + 8 * int(at[b]), 8 * int(at[e] - at[b])), "<u8")
        have = min(n, e * simple8b.BLOCK) - b * simple8b.BLOCK
        out.append(simple8b.decode(words, at[b : e + 1] - at[b], have).astype("<u4"))
    return ids, nulls, lengths, np.concatenate(out) if out else np.zeros(0, "<u4")


def read_token_files(spark: SparkSession, manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Per document in file order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32[, ids].

    The driver adds up the files' totals (one number per file) for their starts.
    """
    rows, base = [], 0
    for r in manifest.orderBy("part", "piece").select("file", "n_ids").collect():
        rows.append((r.file, base))
        base += r.n_ids

    def run(frames):
        import pandas as pd

        for frame in frames:
            for uri, start in zip(frame["file"], frame["start"], strict=True):
                ids, nulls, lengths, values = read_file(uri)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                for a in range(0, len(ids), 2000):
                    s, e = starts[a : a + 2000], ends[a : a + 2000]
                    got = {
                        "doc_id": pd.array([None if z else int(x) for x, z in zip(ids[a : a + 2000], nulls[a : a + 2000], strict=True)], dtype="Int64"),
                        "start": s + start,
                        "n_tokens": e - s,
                        "ids_crc32": [zlib.crc32(values[x:y].tobytes()) for x, y in zip(s, e, strict=True)],
                    }
                    if with_ids:
                        got["ids"] = [values[x:y].astype(np.int64) for x, y in zip(s, e, strict=True)]
                    yield pd.DataFrame(got)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return task_pieces(spark, rows, "file string, start long").mapInPandas(run, schema)
