"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, shingle sets decide.

Rows with equal shingle sets are one node. Nodes that agree in a band of `ROWS` minima meet under its key; with
`BANDS` bands a pair of similarity 0.8 meets nowhere with probability 3e-6, a closer one less. Every pair that meets
is verified on its shingle sets unless verified links join its nodes already: first each key's members against one
of them, twice; then keys whose members still belong to several components are compared in blocks of bounded size,
each pair of blocks in a row of work of its own that gives a spanning forest. No pairs are written out.

Defined cases: null and empty texts are equal; a text shorter than a shingle is one; case is folded in ASCII; rows
with a null doc_id take no part; repeated rows and doc_ids each get a row; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components
from .simhash import _LOWER, keep_smallest, text_hash

BANDS, ROWS = 32, 5


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes (XXH64, seed 42) of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    return np.unique(np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=len(grams)))


def node(own: np.ndarray) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(own.tobytes())


def bands(own: np.ndarray) -> list[int]:
    """A signed key per band; sets without shingles have none."""
    from xxhash import xxh64_intdigest

    if not len(own):
        return []
    draw = np.random.default_rng(42)
    times, plus = (draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    times |= np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(own), 1024):
        h = own[a : a + 1024, None] * times + plus
        least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0))
    keys = [xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _signatures(docs: DataFrame, shingle: int, with_set: bool) -> DataFrame:
    """docs: doc_id, text. Per row doc_id, __text_hash (0 for null), node, and the band keys or the shingle set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingles(t, shingle) for t in part.column(2).to_pylist()]
                own = [s.view(np.int64) for s in sets] if with_set else [bands(s) for s in sets]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(map(node, sets), pa.string()), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "__text_hash", "node", "own"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash("text"), "text").mapInArrow(run, f"doc_id {kind}, __text_hash long, node string, own array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Of the pairs (u, v) those whose sets share at least tenths/10 of their union."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(zero_copy_only=False), b[i].values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(10 * both >= tenths * (len(x) + len(y) - both))
            import pyarrow as pa

            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    met = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b")
    return met.mapInArrow(run, "u string, v string")


#: Bytes of shingle sets in a block.
BLOCK_BYTES = 2 << 20
_TILE = 256


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left shares with each of right (sets of sorted ids)."""
    cols = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(cols), 16384):  # so many columns at a time
        part = cols[at : at + 16384]
        both = []
        for side in (left, right):
            m = np.zeros((len(side), len(part)), dtype=np.float32)
            for r, own in enumerate(side):
                m[r, np.searchsorted(part, np.intersect1d(own, part, assume_unique=True))] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return out


def forest(left: list[tuple], right: list[tuple] | None, tenths: int) -> list[tuple[str, str]]:
    """(node, component, set) of two blocks, or of one: links that join what all pairs of similarity tenths/10 join."""
    every = left + (right or [])
    values, back = np.unique(np.concatenate([s for _, _, s in every]), return_inverse=True)
    shared = np.bincount(back, minlength=len(values)) > 1  # what one set alone holds is in no intersection
    ends = np.cumsum([0] + [len(s) for _, _, s in every])
    ids = [b[shared[b]] for b in (back[x:y] for x, y in zip(ends, ends[1:], strict=False))]
    size = np.diff(ends)
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out, n = [], len(left)
    for a in range(0, n, _TILE):
        for b in range(a, n, _TILE) if right is None else range(n, len(every), _TILE):
            own, other = range(a, min(a + _TILE, n)), range(b, min(b + _TILE, n if right is None else len(every)))
            both = _common([ids[x] for x in own], [ids[y] for y in other])
            near = 10 * both >= tenths * (size[own.start : own.stop, None] + size[None, other.start : other.stop] - both)
            for x, y in np.argwhere(near):
                u, v = every[own[x]], every[other[y]]
                if own[x] != other[y] and (ru := root(u[1])) != (rv := root(v[1])):
                    parent[max(ru, rv)] = min(ru, rv)
                    out.append((min(u[0], v[0]), max(u[0], v[0])))
    return out


def _met_in_blocks(held: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """held: (k, node, root). Links between components under the same key, (u, v).

    Keys that lead to the same nodes again and again (a large group of near copies agrees in many bands) are compared as
    one group of all nodes that such keys join, where that moves fewer bytes than key by key.
    """
    mixed = held.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("head")).where("lo <> hi").select("k", "head")
    own = held.join(mixed, "k").join(sets.select("node", (8 * F.size("own")).cast("long").alias("bytes")), "node")
    own = stage(own, "minhash-mixed")
    wide = components(own.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")))
    wide = wide.toDF("node", "family")
    blocks = lambda b: F.ceil(F.greatest(b, F.lit(1)) / BLOCK_BYTES)
    by_key = own.groupBy("k").agg(F.sum("bytes").alias("b"), F.min("head").alias("node")).withColumn("moves", F.col("b") * blocks(F.col("b"))).join(wide, "node").groupBy("family").agg(F.sum("moves").alias("by_key"))
    nodes = own.select("node", "root", "bytes").distinct().join(wide, "node")
    plan = nodes.groupBy("family").agg(F.sum("bytes").alias("b")).join(by_key, "family").select("family", (F.col("b") * blocks(F.col("b")) <= F.col("by_key")).alias("whole"))
    plan = stage(plan, "minhash-plan")
    whole = nodes.join(plan.where("whole"), "family").select(F.concat(F.lit("f"), "family").alias("g"), "node", "root", "bytes")
    keys = own.join(wide, "node").join(plan.where("not whole"), "family").select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("g"), "node", "root", "bytes")
    member = stage(whole.unionByName(keys), "minhash-members")
    parts = member.groupBy("g").agg(blocks(F.sum("bytes")).cast("int").alias("parts"))
    dealt = member.join(parts, "g").withColumn("mine", F.pmod(F.xxhash64("node", "g"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    rows = dealt.join(sets, "node").select("g", F.explode(pairs).alias("p"), "mine", "node", "root", "own").select("g", "p.i", "p.j", "mine", "node", "root", "own")

    def run(batches):
        import pyarrow as pa

        def links(key, rows):
            _, i, j = key
            left, right = [r[1:] for r in rows if r[0] == i], None if i == j else [r[1:] for r in rows if r[0] == j]
            got = forest(left, right, tenths) if left and (right or len(left) > 1) and (i == j or right) else []
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], ["u", "v"])

        key, rows = None, []
        for batch in batches:
            g, i, j, mine, node, root = (c.to_pylist() for c in batch.columns[:6])
            for r, own in enumerate(batch.column(6)):
                if key != (g[r], i[r], j[r]):
                    if rows:
                        yield links(key, rows)
                    key, rows = (g[r], i[r], j[r]), []
                rows.append((mine[r], node[r], root[r], own.values.to_numpy(zero_copy_only=False).copy()))
        if rows:
            yield links(key, rows)

    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "u string, v string").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, tenths: int = 8) -> DataFrame:
    """Per row with a doc_id: doc_id, __text_hash, component_id (the smallest doc_id reachable over pairs of similarity tenths/10), __root."""
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    marked = stage(_signatures(picked, shingle, False), "minhash")
    classes = stage(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("own").alias("own")), "minhash-classes")
    keyed = classes.select("node", F.explode("own").alias("k"))
    keyed = stage(keyed.join(keyed.groupBy("k").count().where("count > 1").select("k"), "k"), "minhash-keys")
    return linked(picked, marked, classes, keyed, shingle, tenths)


def linked(picked: DataFrame, marked: DataFrame, classes: DataFrame, keyed: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """near_duplicates() of candidates: keyed has (node, k), and nodes under the same key are compared on their shingle sets.

    picked: doc_id, text; marked: (doc_id, __text_hash, node) of each row; classes: (node, first), its smallest doc_id.
    """
    wanted = stage(keyed.select("node").distinct().join(classes, "node").select("node", "first"), "minhash-wanted")
    rows = picked.join(wanted.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = _signatures(rows, shingle, True).join(wanted.select("node"), "node", "left_semi")
    sets = stage(sets.groupBy("node").agg(F.first("own").alias("own")), "minhash-sets")
    links = roots = None
    for turn in range(3):
        held = keyed if roots is None else keyed.join(roots, "node", "left")
        held = held.select("node", "k", (F.col("node") if roots is None else F.coalesce("root", "node")).alias("root"))
        if turn < 2:  # each key's members against one of them
            heads = held.groupBy("k").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("head"), F.col("root").alias("of"))).alias("h"))
            ends = held.join(heads, "k").where("root <> h.of").select(F.col("node").alias("a"), F.col("h.head").alias("b"))
            pairs = ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
            good = stage(_verified(pairs, sets, tenths), "minhash-links")
        else:  # what is left between components
            good = stage(_met_in_blocks(held, sets, tenths), "minhash-links")
        links = good if links is None else links.union(good)
        roots = components(links)
    owned = stage(classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "minhash-roots")
    named = owned.join(owned.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id", F.col("root").alias("__root"))
    return marked.select("doc_id", "__text_hash", "node").join(named, "node").select("doc_id", "__text_hash", "component_id", "__root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates, as simhash.keep_one."""
    return keep_smallest(docs, near_duplicates(docs, **options), options.get("doc_id", "doc_id"), options.get("text", "text"))
