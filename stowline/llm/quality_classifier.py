"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are documents labelled 1, the unlabelled class is web text without a label, and the class prior
is estimated from these two alone (`estimate_prior`); labels other than 1 only keep their rows out of both. A small network over counts of the whole text is
fitted by minimising  pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])  with the logistic loss, so that its
sigmoid estimates the probability of label 1.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: neither their labels nor their texts are trained on.
The fit uses at most `most_positive` and `most_unlabelled` rows, those with the smallest hash of their id; scoring
reads every text.

Defined cases: null and empty texts are scored like any other (all features 0); a null doc_id counts as the empty
text, so is held out; of contradicting labels the smallest counts, null labels count as none; repeated rows each
get a row; other columns are ignored; without any positive the score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>"
_SHOUT = b"!?"
_MARKS = b".,;:'\"()[]{}-_/\\"
_HIGH = bytes(range(128, 256))
_END = re.compile(rb"[^\w\s.,;:!?'\"()\x80-\xff-]")
N_FEATURES = 16


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * N_FEATURES
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    times = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], strict=False))
    again = sum(v for v in pairs.values() if v > 1) / max(1, n - 1)
    return [
        math.log1p(n), size / n, len(times) / n, times.most_common(1)[0][1] / n, again,
        share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_SHOUT), share(_MARKS), share(_HIGH),
        len(set(lines)) / len(lines), math.log1p(len(lines)) / math.log1p(n), len(zlib.compress(raw, 1)) / (size + 16),
        sum(w[-1] in _SYMBOLS or w[-1] in _SHOUT for w in words) / n, len(_END.findall(raw)) / size,
    ]


@dataclass
class PuModel:
    """A one-layer network on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _sig(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def pu_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of logits and its descent gradients by fp and fu.

    Where the negative part turns below 0 the gradients are those of minus this part, as the method demands.
    """
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    value = prior * np.logaddexp(0, -fp).mean() + max(0.0, negative)
    if negative >= 0:
        return value, np.full(len(fp), -prior / len(fp)), _sig(fu) / len(fu)
    return value, prior * _sig(fp) / len(fp), -_sig(fu) / len(fu)


def apart_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic risk of telling positives from unlabelled rows, both classes weighed alike; the prior plays no part."""
    return np.logaddexp(0, -fp).mean() + np.logaddexp(0, fu).mean(), -_sig(-fp) / len(fp), _sig(fu) / len(fu)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, risk=pu_risk, hidden: int = 16, steps: int = 800, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> PuModel:
    """Minimise the risk by Adam."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]) if len(positive) else np.zeros((1, N_FEATURES))
    model = PuModel(both.mean(0), both.std(0) + 1e-6, rng.normal(0, 0.3, (both.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, prior)
    if not len(positive) or not len(unlabelled):
        return model
    xp, xu = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (positive, unlabelled))
    params = [model.w1, model.b1, rng.normal(0, 0.3, hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        hp, hu = np.tanh(xp @ params[0] + params[1]), np.tanh(xu @ params[0] + params[1])
        _, gp, gu = risk(hp @ params[2] + params[3], hu @ params[2] + params[3], prior)
        grads = [np.zeros_like(p) for p in params]
        for x, h, g in ((xp, hp, gp), (xu, hu, gu)):
            inner = np.outer(g, params[2]) * (1 - h * h)
            grads[0] += x.T @ inner
            grads[1] += inner.sum(0)
            grads[2] += h.T @ g
            grads[3] += g.sum()
        lr = rate * 0.5 * (1 + math.cos(math.pi * step / steps))
        for k, g in enumerate(grads):
            g = g + decay * params[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, *, steps: int = 150, delta: float = 0.1, seed: int = 7) -> float:
    """The share of positives among the unlabelled rows, from positives and unlabelled rows alone (best-bin estimate).

    A classifier tells positives from unlabelled rows, fitted on one half and scoring the other. Among the rows
    scored highest, let q_p and q_u be the shares of positives and of unlabelled rows: q_u / q_p is at least the
    prior, and near it where the bin holds few negatives. The bin is the one whose upper confidence bound is least.
    """
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    rng = np.random.default_rng(seed)
    halves = [rng.permutation(len(x)) % 2 for x in (positive, unlabelled)]
    p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in (0, 1):
        told = fit_pu(positive[halves[0] != k], unlabelled[halves[1] != k], 0.5, risk=apart_risk, steps=steps)
        p[halves[0] == k], u[halves[1] == k] = told.logits(positive[halves[0] == k]), told.logits(unlabelled[halves[1] == k])
    p, u = np.sort(p), np.sort(u)
    q_p = 1 - np.arange(len(p)) / len(p)  # bins that begin at each positive's score
    q_u = 1 - np.searchsorted(u, p, "left") / len(u)
    slack = sum(math.sqrt(math.log(4 / delta) / (2 * len(x))) for x in (p, u))
    best = np.argmin((q_u + 1.01 * slack) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def _vectors(docs: DataFrame, keep: str) -> DataFrame:
    """(keep, x) per row of (keep, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]  # one text at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], [keep, "x"])

    return docs.mapInArrow(run, f"{keep} long, x array<double>")


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _least_hash(ids: DataFrame, most: int) -> int:
    """The `most`-th smallest hash of the ids: rows at or below it are the sample."""
    h = ids.select(F.xxhash64("doc_id", F.lit(11)).alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return -(1 << 63) if h is None else h


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_positive: int = 20_000, most_unlabelled: int = 20_000) -> PuModel:
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(~held_out("doc_id"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where(F.col("y").isNotNull() & ~held_out("doc_id"))
    marks = stage(marks.groupBy("doc_id").agg(F.min("y").alias("y")), "labels")
    trusted = marks.where("y = 1").select("doc_id")
    free = stage(own.select("doc_id").join(marks, "doc_id", "left_anti"), "unlabelled")
    sampled = []
    for ids, most in ((trusted, most_positive), (free, most_unlabelled)):
        bound = _least_hash(ids, most)
        below = F.xxhash64("doc_id", F.lit(11)) <= F.lit(bound)
        few = F.broadcast(ids.where(below).distinct())  # at most `most` ids by the choice of bound, so no text is shuffled
        rows = own.where(below).join(few, "doc_id", "left_semi")
        got = stage(_vectors(rows.select("doc_id", "text"), "doc_id"), "features").orderBy("doc_id", "x").limit(most).toArrow()
        sampled.append(np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, N_FEATURES))
    return fit_pu(*sampled, estimate_prior(*sampled))


def score(docs: DataFrame, model: PuModel, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], ["doc_id", "score"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
