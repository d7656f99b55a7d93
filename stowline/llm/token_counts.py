"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens, broadcast once; its size is
bounded by `table_size`. Tier two is each Python worker's cache: a miss is encoded by the library once and
kept, in bounded memory. Pre-tokens are never shuffled: to choose the frequent ones each task counts all of
its own texts into one summary row of at most `per_task` entries, and a tree of tasks adds the summaries up.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each on their own;
columns other than the id and the text are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import MOST_KEPT, PretokenCoder, chunks, pretokens

_CODERS: dict = {}


#: Summaries merged by one task of a level of the tree, and its levels: up to 1,048,576 tasks end in one summary.
FAN_IN, LEVELS = 32, 4


def _task_counts(per_task: int, held: int = 200_000):
    """mapInPandas function: one row with a task's most frequent pre-tokens. Memory stays bounded: beyond `held` the rarest go."""

    def run(frames):
        import pandas as pd

        seen: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                if text:
                    seen.update([w for w in pretokens(text) if len(w) <= MOST_KEPT])
                if len(seen) > held:
                    seen = Counter(dict(seen.most_common(held // 4)))
        top = seen.most_common(per_task)
        if top:  # an empty frame has no text column
            yield pd.DataFrame({"words": [[w for w, _ in top]], "n": [[n for _, n in top]]})

    return run


def _summed(rows, most: int) -> list[tuple[str, int]]:
    """The `most` most frequent pre-tokens of (words, n) summaries, ties by the pre-token."""
    total: Counter = Counter()
    first = lambda: sorted(total.items(), key=lambda p: (-p[1], p[0]))[:most]
    for words, counts in rows:
        for w, n in zip(words, counts, strict=True):
            total[w] += int(n)
        if len(total) > 8 * most:
            total = Counter(dict(first()))
    return first()


def _merge(most: int):
    def run(frame):
        import pandas as pd

        top = _summed(zip(frame["words"], frame["n"], strict=True), most)
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "words": [[w for w, _ in top]], "n": [[n for _, n in top]]})

    return run


def frequent_pretokens(docs: DataFrame, text: str = "text", table_size: int = 32768, per_task: int = 4096) -> list[str]:
    """At most table_size pre-tokens, the most frequent by the tasks' summaries; ties by the pre-token.

    A summary is one row; summaries are merged as a tree of FAN_IN and cut to table_size at each level, so no task
    and not the driver sees more than FAN_IN of them (the driver one for each 1,048,576 tasks).
    """
    rows = docs.select(F.col(text).alias("text")).mapInPandas(_task_counts(per_task), "words array<string>, n array<long>")
    rows = rows.withColumn("part", F.spark_partition_id().cast("long"))
    for _ in range(LEVELS):
        up = rows.withColumn("part", F.floor(F.col("part") / FAN_IN))
        rows = up.groupBy("part").applyInPandas(_merge(table_size), "part long, words array<string>, n array<long>")
    return [w for w, _ in _summed([(r.words, r.n) for r in rows.collect()], table_size)]


def compact(words: list[str], tokenizer_path: str) -> tuple[str, bytes]:
    """The table as one string of words and one byte per length; words of over 255 tokens are left out."""
    coder = PretokenCoder(tokenizer_path, len)
    kept = [(w, n) for w in words if (n := coder.cache[w]) < 256]
    return "\n".join(w for w, _ in kept), bytes(n for _, n in kept)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 2048,
    table_size: int = 32768,
    cache_size: int = 400_000,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(compact(frequent_pretokens(docs, text, table_size), tokenizer_path))

    def run(frames):
        import pandas as pd

        words, lengths = table.value
        key = (tokenizer_path, len(words), hash(words))
        coder = _CODERS.get(key)
        if coder is None:
            fixed = dict(zip(words.split("\n"), lengths, strict=False)) if lengths else {}
            _CODERS.clear()
            coder = _CODERS[key] = PretokenCoder(tokenizer_path, len, fixed, cache_size)
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            counts = [sum(v) for part in chunks(texts) for v in coder.chunk(part)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts})

    kind = dict(docs.dtypes)[doc_id]
    picked = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    out = picked.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
