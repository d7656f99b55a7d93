"""Character n-gram model with modified Kneser-Ney smoothing, counted by Spark, kept in sorted hash arrays.

A gram is `ORDER` code points in one 64-bit integer, 16 bits each (code points beyond that become U+FFFD). Each
task counts its own texts in bounded memory, Spark adds the counts up; continuation counts, discounts, context
totals and probabilities are DataFrame aggregates and joins over the distinct grams. store() keeps every counted gram:
its arrays are dealt by hash into files of the shared folder, and workers look their texts' grams up file by file.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, open_fs, stage

ORDER = 4
_START, _END = 2, 3


def codes(text: str) -> np.ndarray:
    """A text's code points with the marks before its start and after its end, as uint64."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.empty(len(c) + ORDER, dtype=np.uint64)
    out[: ORDER - 1], out[-1] = _START, _END
    out[ORDER - 1 : -1] = np.where(c > 0xFFFF, 0xFFFD, c)
    return out


def grams(c: np.ndarray) -> np.ndarray:
    """The grams of ORDER consecutive codes; entry k predicts code k + ORDER - 1."""
    out = np.zeros(len(c) - ORDER + 1, dtype=np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | c[k : len(c) - ORDER + 1 + k]
    return out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams of all texts, first gram of each text, number of grams of each text)."""
    own = [grams(codes(t)) for t in texts]
    n = np.array([len(g) for g in own], dtype=np.int64)
    return (np.concatenate(own) if own else np.zeros(0, np.uint64)), np.cumsum(n) - n, n


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    uniq, back = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(back, weights=counts, minlength=len(uniq)).astype(np.int64)


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all texts; a null text is left out."""

    def run(batches):
        import pyarrow as pa

        held: list = []
        for batch in batches:
            texts, at, size = batch.column(0).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > 1_000_000 or i + 1 == len(texts):
                    held.append(np.unique(joined(texts[at : i + 1])[0], return_counts=True))
                    if len(held) > 8:
                        held = [_merge(held)]
                    at, size = i + 1, 0
        if held:
            k, n = _merge(held)
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], ["gram", "n"])

    picked = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"))
    return picked.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class StoredModel:
    """Every gram of the model: per order a folder of files, a gram's file given by its hash's first bits."""

    probs: list[tuple[str, int]] = field(default_factory=list)  # (folder, bits) of order 1, 2, ...
    backs: list[tuple[str, int]] = field(default_factory=list)  # contexts of length 0, 1, ...
    floor: float = -20.0

    def log_probs(self, g: np.ndarray) -> np.ndarray:
        """log p of each gram's last code, given those before it."""
        keys, back = np.unique(g, return_inverse=True)
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            own = keys[todo] if k == ORDER else keys[todo] & np.uint64((1 << 16 * k) - 1)
            found, value = _find(*self.probs[k - 1], own)
            out[todo[found]] += value[found]
            todo, own = todo[~found], own[~found]
            if not len(todo):
                return out[back]
            known, weight = _find(*self.backs[k - 1], own >> np.uint64(16))
            out[todo[known]] += weight[known]
        out[todo] += self.floor  # codes never seen
        return out[back]


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs, as uint64; no two longs share one."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = turn((turn(x * p2, 31) * p1) ^ (p5 + np.uint64(42 + 8)), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


#: Files a worker keeps in memory, up to _HELD_BYTES; those used last stay.
_held: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()
_HELD_BYTES = 96 << 20


def _file(folder: str, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    name = f"{folder}/bucket={bucket}"
    if name in _held:
        _held.move_to_end(name)
        return _held[name]
    store, path = open_fs(name)
    files = [f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    got = [pq.read_table(store.open_input_file(f), columns=["h", "value"], use_threads=False) for f in files]
    t = pa.concat_tables(got) if got else pa.table({"h": pa.array([], pa.int64()), "value": pa.array([], pa.float32())})
    h = t.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    _held[name] = h[order], t.column("value").to_numpy()[order]
    while len(_held) > 1 and sum(a.nbytes + b.nbytes for a, b in _held.values()) > _HELD_BYTES:
        _held.popitem(last=False)
    return _held[name] if name in _held else (h[order], t.column("value").to_numpy()[order])


def _find(folder: str, bits: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, out = np.zeros(len(keys), bool), np.zeros(len(keys))
    h = spark_hash(keys)
    order = np.argsort(h)
    h = h[order]
    ends = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for bucket in np.flatnonzero(np.diff(ends)):
        own = slice(ends[bucket], ends[bucket + 1])
        hashes, values = _file(folder, int(bucket))
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, h[own]), len(hashes) - 1)
            found[order[own]], out[order[own]] = hashes[at] == h[own], values[at]
    return found, out


def _files(df: DataFrame) -> tuple[str, int]:
    """Write (key, value) to files of about 2^18 grams each, 16 at least."""
    folder, bits = new_dir(df.sparkSession, "model"), max(4, (df.count() >> 18).bit_length())
    t = df.select(F.xxhash64("key").alias("h"), F.col("value").cast("float").alias("value"))
    t = t.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    t.repartition(1 << bits, "bucket").write.partitionBy("bucket").parquet(folder)
    return folder, bits


def store(docs: DataFrame, *, text: str = "text") -> StoredModel:
    """Count all texts as one language and estimate the model with all grams."""
    model = StoredModel()
    for probs, backs in _estimate(docs, text):
        model.probs.append(_files(probs))
        model.backs.append(_files(backs))
    return model


def _estimate(docs: DataFrame, text: str):
    """Per order from 1 up: (log probabilities, log back-off weights) as (key, value), of all grams."""
    tables = {ORDER: stage(count_grams(docs, text), "grams")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct grams one longer that end alike
        mask = F.lit((1 << 16 * k) - 1)
        tables[k] = stage(tables[k + 1].groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count("*").alias("n")), "grams")
    lower = None
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("ctx", F.shiftrightunsigned("gram", 16))
        of = lambda i: F.sum((F.col("n") == i).cast("double"))
        d = t.agg(*(of(i).alias(f"n{i}") for i in (1, 2, 3, 4)), F.count("*").alias("distinct"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        usable = F.col("n1") * F.col("n2") * F.col("n3") * F.col("n4") > 0
        ratio = lambda i: i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))  # noqa: B023, E731
        # fixed fall-back discounts where a count of counts is zero
        d = d.select("distinct", *(F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(float(i)), ratio(i)))).otherwise(0.5 * i).alias(f"d{i}") for i in (1, 2, 3)))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.crossJoin(F.broadcast(d)).withColumn("own", F.col("n") - cut)  # one row
        contexts = t.groupBy("ctx").agg(F.sum("n").alias("all"), F.sum("own").alias("given"))
        contexts = stage(contexts.select("ctx", "all", (1.0 - F.col("given") / F.col("all")).alias("rest")), "contexts")
        kept = t.join(contexts, "ctx")
        if lower is None:
            base = F.lit(1.0) / (F.col("distinct") + 1)
        else:  # the suffix of a counted gram is counted in its own order
            kept = kept.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)))
            kept = kept.join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("base")), "tail")
            base = F.col("base")
        lower = stage(kept.select("gram", (F.col("own") / F.col("all") + F.col("rest") * base).alias("p")), "probabilities")
        yield lower.select(F.col("gram").alias("key"), F.log("p").alias("value")), contexts.select(F.col("ctx").alias("key"), F.log(F.greatest("rest", F.lit(1e-9))).alias("value"))
