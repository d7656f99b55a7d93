"""Near-duplicates by SimHash at the similarity of word shingles: wide fingerprints find candidates, shingle sets decide.

A row's fingerprint is a SimHash of its set of 5-word shingles, as wide as the search needs. Two sets of similarity s
agree in a bit with a chance of at least 1 - acos(2s / (1 + s)) / pi (0.8485 at 0.8), so 64 bits cannot tell 0.8 from
less, and blocks that meet for certain would be a few bits long. The fingerprint is cut into one block a table instead:
blocks are two bits longer than the rows' number, so that few meet by chance, and there are so many that a pair of
similarity 0.8 meets in none with a chance of `MISSED`; a closer pair is missed less often (at 0.85 about 1e-5). Rows that meet are
compared by the Hamming distance of 128 further bits, with a limit five standard deviations above the mean at 0.8.
What is left is verified on its shingle sets, as in `minhash.linked`, so nothing below the similarity is a link.

Rows with equal shingle sets are one node. The chances hold for sets of some size; at 4 shingles of 5 a bit agrees
with 0.8125, and one such pair in twenty is missed.

Defined cases as in `minhash`: null and empty texts are equal; a text shorter than a shingle is one; case is folded in
ASCII; rows with a null doc_id take no part; repeated rows and doc_ids each get a row; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage
from .minhash import linked, node, shingles
from .simhash import keep_smallest, text_hash

#: Chance that a pair of just the wanted similarity meets in no block.
MISSED = 1e-3
#: Bits that the Hamming check compares; blocks are cut from the bits behind them.
CHECKED = 128


@dataclass(frozen=True)
class Search:
    """bits: of a block; blocks: their number; limit: most differing bits of CHECKED."""

    bits: int
    blocks: int
    limit: int

    @property
    def words(self) -> int:
        return -(-(CHECKED + self.bits * self.blocks) // 64)


def search(rows: int, tenths: int) -> Search:
    agree = 1 - math.acos(2 * tenths / (10 + tenths)) / math.pi
    bits = min(31, max(12, math.ceil(math.log2(max(rows, 2))) + 2))
    blocks = math.ceil(math.log(MISSED) / math.log1p(-(agree**bits))) if agree < 1 else 1
    return Search(bits, blocks, math.ceil(CHECKED * (1 - agree) + 5 * math.sqrt(CHECKED * agree * (1 - agree))))


def fingerprint(own: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits as 0 and 1: a bit is set if it is set in over half the shingles' hashes, each stretched to words (SplitMix64)."""
    total = np.zeros(64 * words, dtype=np.int64)
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(own), 128):
        z = own[a : a + 128, None] + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        total += np.unpackbits(z.astype(">u8", copy=False).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (2 * total > len(own)).astype(np.uint8)


def fingerprints(docs: DataFrame, shingle: int, how: Search) -> DataFrame:
    """docs: doc_id, text. Per row doc_id, __text_hash (0 for null), node, the checked bits as two longs, and an int a block (none without shingles)."""

    def run(batches):
        import pyarrow as pa

        value = 1 << np.arange(how.bits, dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                names, checked, blocks = [], [], []
                for text in part.column(2).to_pylist():
                    own = shingles(text, shingle)
                    bits = fingerprint(own, how.words)
                    names.append(node(own))
                    checked.append(np.packbits(bits[:CHECKED]).view(np.int64))
                    cut = bits[CHECKED : CHECKED + how.bits * how.blocks].reshape(how.blocks, how.bits)
                    blocks.append((cut @ value).astype(np.int32) if len(own) else np.zeros(0, np.int32))
                left, right = np.array(checked).T.copy()
                columns = [*part.columns[:2], pa.array(names, pa.string()), pa.array(left), pa.array(right), pa.array(blocks, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "__text_hash", "node", "f0", "f1", "blocks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash("text"), "text").mapInArrow(run, f"doc_id {kind}, __text_hash long, node string, f0 long, f1 long, blocks array<int>")


def _near(a: str, b: str, limit: int) -> Column:
    far = [F.bit_count(F.col(f"{a}.f{x}").bitwiseXOR(F.col(f"{b}.f{x}"))) for x in (0, 1)]
    return far[0] + far[1] <= limit


def met(classes: DataFrame, how: Search) -> DataFrame:
    """classes: (node, f0, f1, blocks). Returns (node, k): the nodes that agree in a block, of those within the limit of another there."""
    ids = classes.select(F.xxhash64("node").alias("id"), "node", "f0", "f1", "blocks")
    keyed = ids.select("id", F.posexplode("blocks").alias("table", "value")).select("id", F.shiftleft(F.col("table").cast("long"), 31).bitwiseOR(F.col("value")).alias("k"))
    keyed = keyed.withColumn("n", F.count("*").over(W.partitionBy("k"))).where("n > 1")
    held = stage(stage(keyed, "simhash-keys").join(ids.select("id", "f0", "f1"), "id").select("k", "n", "id", "f0", "f1"), "simhash-held")
    rest, found = held, None
    for turn in range(2):  # each key's members against one of them
        heads = rest.groupBy("k").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("o"), "id", "f0", "f1")).alias("h")).select("k", "h.id", "h.f0", "h.f1")
        seen = rest.alias("a").join(heads.alias("b"), "k").where("a.id <> b.id")
        seen = stage(seen.select("k", "n", "a.id", "a.f0", "a.f1", F.col("b.id").alias("head"), _near("a", "b", how.limit).alias("near")), "simhash-seen")
        hits = seen.where("near").select("k", "id").union(seen.where("near").select("k", F.col("head").alias("id")).distinct())
        found = hits if found is None else found.union(hits)
        # a key of two holds no other pair; in the second turn heads without a hit have not met those of the first
        alone = seen.groupBy("k").agg(F.max("near").alias("hit"), F.first("head").alias("id")).where("not hit")
        rest = seen.where("not near and n > 2").select("k", "n", "id", "f0", "f1")
        if turn:
            whole = held.join(heads.select("k", "id").join(seen.select("k").distinct(), "k", "left_anti").union(alone.select("k", "id")), ["k", "id"], "left_semi")
            rest = rest.unionByName(whole)
    pairs = rest.alias("a").join(held.where("n > 2").alias("b"), "k").where(F.col("a.id") != F.col("b.id")).where(_near("a", "b", how.limit))
    found = found.union(pairs.select("k", F.explode(F.array("a.id", "b.id")).alias("id"))).distinct()
    return found.join(ids.select("id", "node"), "id").select("node", "k")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, tenths: int = 8) -> DataFrame:
    """Per row with a doc_id: doc_id, __text_hash, component_id (the smallest doc_id reachable over pairs of similarity tenths/10), __root."""
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    how = search(picked.count(), tenths)
    marked = stage(fingerprints(picked, shingle, how), "simhash-wide")
    firsts = [F.first(c).alias(c) for c in ("f0", "f1", "blocks")]
    classes = stage(marked.groupBy("node").agg(F.min("doc_id").alias("first"), *firsts), "simhash-classes")
    keyed = stage(met(classes, how), "simhash-near")
    return linked(picked, marked.select("doc_id", "__text_hash", "node"), classes.select("node", "first"), keyed, shingle, tenths)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates, as simhash.keep_one."""
    return keep_smallest(docs, near_duplicates(docs, **options), options.get("doc_id", "doc_id"), options.get("text", "text"))
