"""Benchmark decontamination with DataFrame functions only.

Benchmark texts become windows of normalised words; their hashes form a set that goes out with the plan as long
as it is small (`most_hashes`, a proven bound), and each document's token windows are scanned inside its row. A larger set
goes out as a broadcast hash table that the documents' windows stream past (up to `most_broadcast` windows, about 100 MB);
beyond that the windows' hashes, never their words, meet the benchmark's in a shuffle join. What hits the set is verified by
the words themselves against the benchmark's windows, and hits become spans of words.

Words: A-Z lower-cased, then runs of letters and digits of ASCII and of any non-ASCII character. A window is
`size` consecutive words of an item; an item with fewer, but not none, is one window.

Defined cases: null and empty texts have no words and are clean; an item without words has no window; item ids
are compared as strings (null as the empty string), and items that share an id count once; repeated rows each
get a row; other columns are ignored (kept unchanged by decontaminate); an empty documents table gives an
empty result and an empty benchmark finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# The separators between words, before and after lower-casing.
_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_WORD = rf"([^{_SEPARATORS}]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The normalised words of a text, an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(1))


def windows(benchmark: DataFrame, size: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, gram, len, ends): the distinct windows of each item; ends holds the hashes of its first and last word."""
    own = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    cut = F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.slice("w", i, size)))
    cut = cut.when(F.size("w") > 0, F.array("w")).otherwise(F.expr("cast(array() as array<array<string>>)"))
    each = own.select("item", F.explode(cut).alias("g"))
    return each.select("item", F.array_join("g", " ").alias("gram"), F.size("g").alias("len")).distinct()


def _hash(n: int, at: str) -> str:
    """SQL for the hash of the n word hashes from position `at` (zero-based) of column h."""
    return "xxhash64(" + ", ".join(f"get(h, {at} + {k})" for k in range(n)) + ")"


def _in(values: list[int]) -> str:
    return "IN (" + ", ".join("(-9223372036854775807L - 1L)" if v == -(1 << 63) else f"{v}L" for v in values) + ")"


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    size: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_hashes: int = 50_000,
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """Per row: __doc_id, __text_hash, n_words, words_hit (sorted positions), items (sorted ids)."""
    grams = windows(benchmark, size, item_id, item_text)
    hashed = F.expr("transform(split(gram, ' '), w -> xxhash64(w))")
    grams = stage(grams.withColumn("h", hashed), "benchmark-windows")
    lengths = sorted(r.len for r in grams.select("len").distinct().collect())  # `size` rows at most
    own_id, own_text = F.col(f"`{doc_id}`"), F.col(f"`{text}`")  # docs may have columns of any name
    base = docs.select(own_id.alias("__doc_id"), F.xxhash64(own_text).alias("__text_hash"), words(own_text).alias("w"))
    base = base.select("*", F.size("w").cast("long").alias("n_words"), F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    n_grams = grams.count()
    small = n_grams <= most_hashes
    found = []
    for n in lengths:
        if small:
            own = grams.where(F.col("len") == n)
            ends = own.select(F.expr("get(h, 0)").alias("a"), F.expr(f"get(h, {n - 1})").alias("b"), F.expr(_hash(n, "0")).alias("x")).collect()
            a, b, x = (sorted({r[k] for r in ends}) for k in ("a", "b", "x"))
            test = f"get(h, i) {_in(a)} AND get(h, i + {n - 1}) {_in(b)} AND {_hash(n, 'i')} {_in(x)}"
            found.append(f"if(size(w) < {n}, array(), transform(filter(sequence(0, size(w) - {n}), i -> {test}), i -> named_struct('pos', i, 'len', {n})))")
        else:
            found.append(f"if(size(w) < {n}, array(), transform(sequence(0, size(w) - {n}), i -> named_struct('pos', i, 'len', {n}, 'x', {_hash(n, 'i')})))")
    at = F.expr("concat(" + ", ".join(found) + ")") if found else F.expr("cast(array() as array<struct<pos:int,len:int>>)")
    if not small and found:  # places by hash, per document; the texts are read once more below
        wanted = None
        for n in lengths:
            own = grams.where(F.col("len") == n).select("len", F.expr(_hash(n, "0")).alias("x"))
            wanted = own if wanted is None else wanted.union(own)
        wanted = wanted.distinct()
        wanted = F.broadcast(wanted) if n_grams <= most_broadcast else wanted
        places = base.select("__doc_id", "__text_hash", F.explode(at).alias("p")).select("__doc_id", "__text_hash", "p.*")
        met = places.join(wanted, ["len", "x"]).groupBy("__doc_id", "__text_hash").agg(F.collect_set(F.struct("pos", "len")).alias("at"))
        met = stage(met.toDF("__id", "__hash", "at"), "window-places")
        base = base.join(met, F.col("__doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left").drop("__id", "__hash")
        at = F.coalesce("at", F.expr("cast(array() as array<struct<pos:int,len:int>>)"))
    gram = lambda p: F.array_join(F.slice("w", p["pos"] + 1, p["len"]), " ")
    hits = F.transform(at, lambda p: F.struct(p["pos"].alias("pos"), p["len"].alias("len"), gram(p).alias("gram")))
    # one scan of the texts: counts and the few windows that hit, under a row number that is fixed once written
    marked = stage(base.select("__doc_id", "__text_hash", "n_words", hits.alias("hits"), F.monotonically_increasing_id().alias("__row")), "window-hits")
    each = marked.select("__row", F.explode("hits").alias("x")).select("__row", "x.*")
    true = each.join(grams.select("gram", "item"), "gram")
    span = F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)
    per_row = true.groupBy("__row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(span)))).alias("words_hit"), F.array_sort(F.collect_set("item")).alias("items")
    )
    none = "cast(array() as array<{}>)"
    return marked.drop("hits").join(per_row, "__row", "left").select(
        "__doc_id", "__text_hash", "n_words", F.coalesce("words_hit", F.expr(none.format("int"))).alias("words_hit"), F.coalesce("items", F.expr(none.format("string"))).alias("items")
    )


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = occurrences(docs, benchmark, **options)
    n_hit = F.size("words_hit").cast("long")
    return found.select(
        F.col("__doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents, or (remove='spans') with the hit words and the separators before them cut out."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    bad = occurrences(docs, benchmark, **options).where(F.size("words_hit") > 0).dropDuplicates(["__doc_id", "__text_hash"])
    own = lambda c: F.col(f"d.`{c}`")  # noqa: E731  docs may have columns of any name
    same = own(doc_id).eqNullSafe(F.col("b.__doc_id")) & (F.xxhash64(own(text)) == F.col("b.__text_hash"))
    if remove == "documents":
        return docs.alias("d").join(bad.alias("b"), same, "left_anti")
    pieces = F.regexp_extract_all(own(text), F.lit(rf"([{_SEPARATORS}]*[^{_SEPARATORS}]+)"), F.lit(1))
    tail = F.regexp_extract(own(text), rf"([{_SEPARATORS}]*)\z", 1)
    kept = F.filter(F.transform(pieces, lambda p, i: F.when(~F.array_contains(F.col("b.words_hit"), i), p)), lambda p: p.isNotNull())
    new = F.when(F.col("b.__text_hash").isNull(), own(text)).otherwise(F.concat(F.array_join(kept, ""), tail))
    return docs.alias("d").join(bad.alias("b"), same, "left").select(*[(new if c == text else own(c)).alias(c) for c in docs.columns])
