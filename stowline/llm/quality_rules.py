"""Quality rules: plain counts per document, then language-specific perplexity bands.

The perplexity is per letter: what all characters of a text cost, over its letters and digits, so that marks between
words add to it. The bands are the median of the log perplexity of a language's documents that pass the plain
rules, plus and minus `width` robust deviations (median absolute deviation times 1.4826, at least `least`), over
all documents by way of a histogram. A language with fewer than `least_docs` such documents takes the band of all
languages' documents together, so that none goes unjudged; without any such document nothing is kept anyway.

Words are runs of anything but blank, tab and the other ASCII white space. Defined cases: a null text has no
words and fails; a null language is 'und'; repeated rows each get a row; other columns are ignored (kept
unchanged by keep_good); ids may be of any type; an empty table gives an empty table. Whole texts are read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_model
from .common import stage

_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: One model serves all languages, since a few letters tell the language: so a document that changes
#: its language is no outlier. The bands are language-specific.
_BIN = 1000  # histogram bins per unit of log perplexity


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly the six ASCII white-space bytes
    n = len(words)
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if x.encode("utf-8", "surrogatepass").split()]
        dup = len(full) - len(set(full))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        hit = np.fromiter((times[w] > 1 for w in windows), dtype=bool, count=len(windows))
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : k + len(hit)] |= hit
        repeated = int(covered.sum())
    return n, len(text) - blanks, len(_SYMBOLS.findall(text)), dup, repeated


@functools.cache
def _letters() -> np.ndarray:
    """By code point below 65536 whether it is a letter or number."""
    return np.array([chr(k).isalnum() for k in range(1 << 16)], dtype=np.int64)


def scores(docs: DataFrame, model: ngram_model.StoredModel, *, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang, __text_hash, the five counts and log_ppl (per letter or digit, end mark included)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            counts = np.array([text_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            ppl = np.zeros(len(texts))
            at, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 1_000_000 or i + 1 == len(texts):
                    g, first, _ = ngram_model.joined([x or "" for x in texts[at : i + 1]])
                    letters = np.add.reduceat(_letters()[(g & np.uint64(0xFFFF)).astype(np.int64)], first)
                    ppl[at : i + 1] = -np.add.reduceat(own.log_probs(g), first) / np.maximum(letters, 1)
                    at, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(counts[:, k]) for k in range(5)), pa.array(ppl)], ["doc_id", "lang", "__text_hash", *names, "log_ppl"])

    col = lambda c: F.col(f"`{c}`")  # noqa: E731  docs may have columns of any name
    picked = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(lang), F.lit("und")).alias("lang"), F.xxhash64(col(text)).alias("__text_hash"), col(text).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang string, __text_hash long, " + ", ".join(f"{n} long" for n in names) + ", log_ppl double")


def bands(scored: DataFrame, *, width: float = 6.0, least: float = 0.03, least_docs: int = 20) -> DataFrame:
    """(lang, low, high): the band of log perplexity of each language that has enough documents, and under null that of all."""
    seen = scored.where("not base_failed").groupBy("lang", F.round(F.col("log_ppl") * _BIN).cast("long").alias("bin")).count()
    seen = stage(seen, "perplexities")
    seen = seen.unionByName(seen.groupBy("bin").agg(F.sum("count").alias("count")).withColumn("lang", F.lit(None).cast("string")))
    middle = seen.groupBy("lang").agg(F.expr("percentile(bin, 0.5, count)").alias("mid"), F.sum("count").alias("docs"))
    away = seen.join(middle.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang"))).withColumn("off", F.abs(F.col("bin") - F.col("mid")))
    spread = away.groupBy("lang", "mid", "docs").agg(F.expr("percentile(off, 0.5, count)").alias("mad"))
    half = width * F.greatest(F.lit(least), 1.4826 * F.col("mad") / _BIN)
    enough = (F.col("docs") >= least_docs) | F.col("lang").isNull()
    return stage(spread.where(enough).select("lang", (F.col("mid") / _BIN - half).alias("low"), (F.col("mid") / _BIN + half).alias("high")), "bands")


def judge(docs: DataFrame, *, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", min_words: int = 50, width: float = 6.0) -> DataFrame:
    """Per row: doc_id, the counts, log_ppl, low, high, base_failed, kept; also lang and __text_hash."""
    model = ngram_model.store(docs, text=text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stage(scores(docs, model, doc_id=doc_id, lang=lang, text=text).withColumn("base_failed", failed), "quality")
    found = bands(scored, width=width)
    own, every = found.where("lang is not null"), found.where("lang is null").agg(F.max("low").alias("all_low"), F.max("high").alias("all_high"))
    own = F.broadcast(own) if own.count() <= 10_000 else own  # a band per language
    both = scored.join(own, "lang", "left").crossJoin(F.broadcast(every))  # one row
    both = both.withColumns({"low": F.coalesce("low", "all_low"), "high": F.coalesce("high", "all_high")}).drop("all_low", "all_high")
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & inside)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """docs without the rejected documents, all columns unchanged."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    bad = judge(docs, **options).where("not kept").select(F.col("doc_id").alias("__doc_id"), F.coalesce("__text_hash", F.lit(0)).alias("__text_hash")).distinct()
    own = lambda c: F.col(f"d.`{c}`")  # noqa: E731  docs may have columns of any name
    same = own(doc_id).eqNullSafe(F.col("b.__doc_id")) & (F.coalesce(F.xxhash64(own(text)), F.lit(0)) == F.col("b.__text_hash"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
