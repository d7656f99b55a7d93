"""Line dedup by a log-template tree.

A line is parsed at fixed depth: its number of tokens, then its leading tokens; tokens with a digit are variable
fields and read as a wildcard. Under that leaf a template is the line's token sequence with the wildcards. For
lines of at least `long_line` tokens the tree generalises further: the tokens behind the leading ones are cut into
`parts` runs, and each run in turn may be a variable field, so that lines of one leaf which differ within one run
share a template. This is a rule of the line alone, so the templates do not depend on the order of lines, and
counting them needs only sums. A template is known by 128 bits, of which no two texts are known to agree.

A template that occurs in at least `min_docs` documents recurs: its lines are dropped from every document but the
first (the smallest doc_id), so that one instance of the text stays in the corpus.

Defined cases: lines of fewer than `min_tokens` tokens always stay; null and empty texts stay as they are; of
documents with the same doc_id all keep a template that has this id as its first; a null doc_id is first only if
all are; texts that lose all their lines become empty; a length column, where there is one, is set to the new length;
other columns are kept unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

_DIGIT = re.compile(r"\d")
WILDCARD = "<*>"


def templates(line: str, *, min_tokens: int = 3, depth: int = 2, long_line: int = 12, parts: int = 4) -> list[bytes]:
    """The keys of the templates that a line falls under (16 bytes), none for short lines."""
    from xxhash import xxh3_128_digest

    tokens = line.split()
    n = len(tokens)
    if n < min_tokens:
        return []
    if _DIGIT.search(line):
        masked = [WILDCARD if _DIGIT.search(t) else t for t in tokens]
        if 2 * masked.count(WILDCARD) <= n:  # else there is too little left to tell a template
            tokens = masked
    keys = [xxh3_128_digest(" ".join(tokens), n)]
    if n >= long_line:
        head = xxh3_128_digest(" ".join(tokens[:depth]), n)
        cuts = [depth + (n - depth) * k // parts for k in range(parts + 1)]
        runs = [xxh3_128_digest(" ".join(tokens[a:b]), k) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        for k in range(parts):
            keys.append(xxh3_128_digest(head + b"".join(runs[:k]) + b"*" + b"".join(runs[k + 1 :]), n))
    return keys


def line_templates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **shape) -> DataFrame:
    """One row per line and template: doc_id, __text_hash, line (zero-based), key, once (1 at a key's first line in the document)."""

    def run(batches):
        import pyarrow as pa

        form = None
        for batch in batches:
            form = form or pa.schema([("doc_id", batch.schema.field(0).type), ("__text_hash", pa.int64()), ("line", pa.int32()), ("key", pa.binary()), ("once", pa.int32())])
            out: list[list] = [[], [], [], [], []]
            for d, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: set[bytes] = set()
                for i, line in enumerate(t.split("\n")):
                    for k in templates(line, **shape):
                        for column, value in zip(out, (d, h, i, k, int(k not in seen)), strict=True):
                            column.append(value)
                        seen.add(k)
                if len(out[0]) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, form, strict=True)], schema=form)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, form, strict=True)], schema=form)

    col = lambda c: F.col(f"`{c}`")  # noqa: E731  docs may have columns of any name
    picked = docs.where(col(text).isNotNull()).select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("__text_hash"), col(text).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, __text_hash long, line int, key binary, once int")


def recurring_lines(docs: DataFrame, *, min_docs: int = 2, **options) -> DataFrame:
    """(doc_id, __text_hash, lines): the lines to drop of each document that loses any."""
    own = stage(line_templates(docs, **options), "line-templates")
    counted = own.groupBy("key").agg(F.sum("once").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    again = stage(counted.select("key", "first"), "recurring-templates")
    hit = own.join(again, "key").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return stage(hit.groupBy("doc_id", "__text_hash").agg(F.collect_set("line").alias("lines")), "recurring-lines")


def drop_recurring(docs: DataFrame, *, length: str = "n_chars", **options) -> DataFrame:
    """docs with the recurring lines cut out; the column `length`, if there is one, holds the new number of characters."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    drop = recurring_lines(docs, **options).toDF("__doc_id", "__text_hash", "__lines")
    own = lambda c: F.col(f"d.`{c}`")  # noqa: E731  docs may have columns of any name
    same = own(doc_id).eqNullSafe(F.col("x.__doc_id")) & (F.xxhash64(own(text)) == F.col("x.__text_hash"))
    cut = F.col("x.__lines").isNotNull()
    new = F.array_join(F.filter(F.split(own(text), "\n", -1), lambda x, i: ~F.array_contains(F.col("x.__lines"), i)), "\n")
    changed = {text: new}
    if length in docs.columns:
        changed[length] = F.char_length(new).cast(dict(docs.dtypes)[length])
    wide = docs.alias("d").join(drop.alias("x"), same, "left")
    return wide.select(*[(F.when(cut, changed[c]).otherwise(own(c)) if c in changed else own(c)).alias(c) for c in docs.columns])
