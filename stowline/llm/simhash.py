"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints, then a Hamming check.

A fingerprint is cut into B blocks. Two that differ in at most d bits agree in B - d blocks at least, so each
choice of B - d blocks is a table, its bits the key, and close pairs meet under some key. Equal fingerprints
count once. Members of a key are dealt into sub-groups of bounded size, every pair of sub-groups meets in a
task row of its own, and there a vectorised Hamming check yields a spanning forest of the links: what a group
emits is linear in its members, and no link between different fingerprints is lost for the components.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows and doc_ids
each get a row; a null doc_id gets a row and names a component only if all its members are null; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, repeats included (XXH64, seed 42)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    total, n = np.zeros(64, dtype=np.int64), len(grams)
    for a in range(0, n, 8192):
        part = grams[a : a + 8192]
        h = np.fromiter((xxh64_intdigest(g, 42) for g in part), dtype=">u8", count=len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def text_hash(text: str):
    """__text_hash: tells rows with the same id apart; 0 for a null text."""
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("__text_hash")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """Per row: doc_id, __text_hash, fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp)], ["doc_id", "__text_hash", "fp"])

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.select("doc_id", text_hash("text"), "text").mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, __text_hash long, fp long")


def tables(distance: int, blocks: int) -> list[int]:
    """A 64-bit mask per table: the bits of each choice of blocks - distance blocks."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(bits, blocks - distance)]


def forest(left: np.ndarray, right: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within left (right None), or between left and right."""
    other = left if right is None else right
    nodes = left if right is None else np.concatenate([left, right])
    parent: dict[int, int] = {int(x): int(x) for x in nodes}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a in left:
        near = other[np.bitwise_count(other ^ a) <= distance]
        for b in near:
            ra, rb = root(int(a)), root(int(b))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((int(a), int(b)))
    return out


def links(fps: DataFrame, *, distance: int = 4, blocks: int | None = None, group: int = 256) -> DataFrame:
    """fps: distinct fp. Returns (u, v): links that join the same fingerprints as all links within `distance`.

    blocks: by default so many that a key is rarely shared by chance; a matter of speed alone.
    """
    if blocks is None:
        n = fps.count()
        blocks = distance + (2 if n < 1 << 25 else 3 if n < 1 << 32 else 4)
    masks = tables(distance, blocks)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(_signed(m))).alias("k")) for t, m in enumerate(masks)])).alias("x"))
    keyed = keyed.select("fp", "x.k")
    # a key's members go to `parts` sub-groups; each pair of sub-groups is one row of work
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(sizes, "k").withColumn("parts", F.ceil(F.col("n") / group).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp", "k"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    rows = dealt.select("fp", "k", "mine", F.explode(pairs).alias("p")).select("fp", "k", "p.i", "p.j", "mine")
    met = rows.groupBy("k", "i", "j").agg(F.collect_set(F.when(F.col("mine") == F.col("i"), F.col("fp"))).alias("a"), F.collect_set(F.when(F.col("mine") != F.col("i"), F.col("fp"))).alias("b"))
    met = met.where("size(a) + size(b) > 1 and (i = j or size(a) * size(b) > 0)")

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for i, j, a, b in zip(frame["i"], frame["j"], frame["a"], frame["b"], strict=True):
                a, b = (np.asarray(x, dtype=np.int64).view(np.uint64) for x in (a, b))
                out += forest(a, None if i == j else b, distance)
            uv = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"u": uv[:, 0], "v": uv[:, 1]})

    return met.select("i", "j", "a", "b").mapInPandas(run, "u long, v long").distinct()


def _signed(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, blocks: int | None = None
) -> DataFrame:
    """Per row: doc_id, __text_hash, fp, component_id (the smallest doc_id reachable over links, itself included), __root (the component)."""
    marked = stage(fingerprints(docs, doc_id, text, shingle), "simhash")
    classes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes.select("fp"), distance=distance, blocks=blocks))
    owned = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    owned = stage(owned, "simhash-roots")
    heads = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(owned.join(heads, "root").select("fp", "component_id", F.col("root").alias("__root")), "simhash-named")
    return marked.join(named, "fp").select("doc_id", "__text_hash", "fp", "component_id", "__root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, all columns unchanged.

    That row has the component's smallest doc_id; of several such rows the one with the smallest text hash, and of rows
    equal in both, one. Rows that share an id but not a component are judged each on its own; rows with a null doc_id stay.
    """
    return keep_smallest(docs, near_duplicates(docs, **options), options.get("doc_id", "doc_id"), options.get("text", "text"))


def keep_smallest(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """keep_one() for components found as (doc_id, __text_hash, component_id, __root); ids that repeat may name several.

    Equal texts are in one component, so (doc_id, text hash) tells rows apart that have different fates.
    """
    marked = found.where("doc_id is not null").groupBy("__root", "component_id", "doc_id", "__text_hash").count()
    marked = stage(marked, "near-marked")
    firsts = marked.where("doc_id = component_id").groupBy("__root").agg(F.min("__text_hash").alias("least"))
    judged = marked.join(firsts, "__root").withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col("__text_hash") == F.col("least")))
    judged = stage(judged.select(F.col("doc_id").alias("__doc_id"), "__text_hash", "stays", "count"), "near-kept")
    own = lambda c: F.col(f"d.`{c}`")  # noqa: E731  docs may have columns of any name
    same = (own(doc_id) == F.col("x.__doc_id")) & (F.coalesce(F.xxhash64(own(text)), F.lit(0)) == F.col("x.__text_hash"))
    left = docs.alias("d").join(judged.where("not stays").alias("x"), same, "left_anti")
    again = judged.where("stays and count > 1")
    if again.isEmpty():
        return left
    once = left.alias("d").join(again.alias("x"), same, "left_anti")
    names = [f"`{c}`" for c in docs.columns]
    both = left.alias("d").join(again.alias("x"), same, "left_semi").select(F.col(f"`{doc_id}`").alias("__doc_id"), F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)).alias("__text_hash"), F.struct(*names).alias("__row"))
    one = both.groupBy("__doc_id", "__text_hash").agg(F.first("__row").alias("__row"))
    return once.unionByName(one.select(*[F.col(f"__row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)]))
