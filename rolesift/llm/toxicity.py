"""Toxicity by maximum-scoring segments of token log-odds.

Training, on a bounded sample of labelled rows: tokens are counted by the
different contexts (neighbouring tokens) they have in toxic and in other texts,
so that copies of a text count once. The share of toxic contexts gets a
two-category Dirichlet prior whose mean is the share of the token's four-letter
prefix, which in turn is drawn to the share of all tokens; the log-odds against
the latter, drawn to zero by their standard deviation, are the token's score,
also where negative; positive ones under ``LEAST`` are mostly chance and count as
no evidence. A token with no evidence either way scores the mean log-odds
of the clean contexts' tokens, which is negative, so that a segment ends where
nothing toxic follows; should the clean tokens' mean score not be negative, this
drift is lowered until it is.

Scoring, over every whole text: one linear scan finds all maximal scoring
segments. Their scores are normalised for text length by the extreme-value law
of maximal segments, lambda * S - ln(K * n): lambda is the root of the score
distribution of clean tokens, K comes from clean texts. What is over zero is
significant. A logistic curve over the best and the summed evidence, fitted on
sampled rows that the token counts have not seen, gives the score from 0 to 1.

Defined results: null and empty texts have no segment and the score of such
texts; labels of one doc_id are merged by their maximum, null labels ignored;
repeated rows are scored each; without labels of both kinds all scores are the
share of label 1 (0 without labels). Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

TOKEN = re.compile(r"[^\W_]+")
PREFIX = 4
#: Prior weights: of the prefix's share for a token, of the base share for a prefix.
PRIOR_TOKEN, PRIOR_PREFIX = 3.0, 3.0
#: Score of a token without evidence where no model says more, and the least distance of it from zero.
NEUTRAL = -0.1
#: Positive log-odds that count as evidence.
LEAST = 1.5


def segments(hits: list[tuple[int, float]], neutral: float = NEUTRAL) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first token, end token), left to right.

    ``hits`` are the tokens with scores of their own, in order; every other
    scores ``neutral``.
    """
    steps = []
    total, last = 0.0, 0
    for at, score in hits:
        left = total + neutral * (at - last)
        total, last = left + score, at + 1
        if score > 0:
            steps.append((at, left, total))
    return _maximal(steps)


def _maximal(steps: Iterable[tuple[int, float, float]]) -> list[tuple[float, int, int]]:
    """Ruzzo and Tompa's scan over (token, sum before it, sum after it) of the tokens with positive scores."""
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    for at, left, right in steps:
        first = at
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, at + 1))
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
    return [(r - b, s, e) for b, r, s, e in found]


class Weights(dict):
    """Scores of tokens; one that is not listed has its prefix's, or ``neutral``."""

    def __init__(self, tokens: dict[str, float], prefixes: dict[str, float], neutral: float = NEUTRAL):
        super().__init__(tokens)
        self.prefixes, self.neutral = prefixes, neutral

    def __missing__(self, token: str) -> float:
        return self.prefixes.get(token[:PREFIX], self.neutral)


def evidence(text: str | None, weights: Weights) -> tuple[int, list[tuple[float, int, int]]]:
    """Number of tokens of a text, and its maximal segments."""
    tokens = TOKEN.findall((text or "").lower())
    scores = [weights[t] for t in tokens]
    sums = list(accumulate(scores, initial=0.0))
    return len(tokens), _maximal((k, sums[k], sums[k + 1]) for k, s in enumerate(scores) if s > 0)


def features(n: int, found: list[tuple[float, int, int]], lam: float, ln_k: float) -> tuple[float, float]:
    """Normalised score of the best segment (-10 without any), and the sum of all significant ones."""
    level = ln_k + math.log(max(n, 1))
    best = max((lam * s - level for s, _, _ in found), default=-10.0)
    return max(-10.0, min(best, 30.0)), math.log1p(sum(max(0.0, lam * s - level) for s, _, _ in found))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients by Newton steps, with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.r_[0.0, w[1:]]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[ridge] * (len(w) - 1)]), x.T @ (y - p) - pull)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _share(toxic, total, prior, weight):
    return (toxic + weight * prior) / (total + weight)


def token_table(texts: DataFrame, most: int = 500_000) -> tuple[Weights, float, float]:
    """Scores from rows (text, toxic); lambda of the clean tokens; base share of toxic contexts.

    At most ``most`` tokens are listed, since each needs over that part of all
    contexts; so the table that the driver sends out is bounded.
    """
    once = texts.groupBy(F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    words = once.select("toxic", F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda x: x != "").alias("w"))
    rows = words.select("toxic", "w", F.posexplode("w").alias("p", "word"))
    rows = rows.select("word", "toxic", F.xxhash64(F.get("w", F.col("p") - 1), F.get("w", F.col("p") + 1)).alias("c"))
    counts = written(
        rows.groupBy("word", "c").agg(F.avg("toxic").alias("toxic")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not total.n:
        return Weights({}, {}), 1.0, 0.0
    base = _share(total.t, total.n, 0.5, 1.0)
    least = max(3, total.n / most)
    prefixes = counts.groupBy(F.substring("word", 1, PREFIX).alias("q")).agg(F.sum("t").alias("qt"), F.sum("n").alias("qn"))

    def odds(toxic, total, prior, weight):
        """Log-odds against the base share."""
        a, b = toxic + weight * prior, total - toxic + weight * (1 - prior)
        return F.log(a / b) - F.log(F.lit(base / (1 - base))), F.sqrt(1 / a + 1 / b)

    def drawn(odds_and_error):
        """Log-odds drawn to zero by their standard deviation; positive ones under ``LEAST`` are none."""
        o, e = odds_and_error
        return F.when(o - e >= LEAST, o - e).otherwise(F.least(o + e, F.lit(0.0)))

    pre = prefixes.withColumn("qs", _share(F.col("qt"), F.col("qn"), base, PRIOR_PREFIX))
    pre = pre.withColumn("ps", F.when(F.col("qn") >= least, drawn(odds(F.col("qt"), F.col("qn"), F.lit(base), PRIOR_PREFIX))).otherwise(F.lit(0.0)))
    every = written(
        counts.withColumn("q", F.substring("word", 1, PREFIX)).join(pre, "q").select(
            "word", "q", "ps", (F.col("n") - F.col("t")).alias("clean"), (F.col("n") >= least).alias("listed"),
            odds(F.col("t"), F.col("n"), F.col("qs"), PRIOR_TOKEN)[0].alias("o"), drawn(odds(F.col("t"), F.col("n"), F.col("qs"), PRIOR_TOKEN)).alias("s"),
        )
    )
    # A listed token has its own score; it has to be named where that is not the one of its prefix.
    tokens = {r.word: r.s for r in every.where("listed and (s <> 0 or ps <> 0)").select("word", "s").collect()}
    pre_listed = {r.q: r.ps for r in every.where("ps <> 0").select("q", "ps").distinct().collect()}
    clean = max(1e-9, total.n - total.t)
    drift = min(NEUTRAL, every.agg(F.sum(F.col("clean") * F.col("o"))).first()[0] / clean)
    # Scores of clean tokens: those with evidence by their score, and the part of all others.
    score = F.when(F.col("listed"), F.col("s")).otherwise(F.col("ps"))
    scored = every.select(F.round(score, 3).alias("s"), "clean").groupBy("s").agg(F.sum("clean").alias("c")).collect()
    known = [(r.s, r.c / clean) for r in scored if r.s]
    rest = max(1e-9, 1 - sum(c for _, c in known))
    mean = sum(s * c for s, c in known)
    drift = min(drift, (NEUTRAL - mean) / rest)
    tokens = {w: s or drift for w, s in tokens.items()}

    def over(lam: float) -> float:
        return sum(c * math.exp(min(lam * s, 600.0)) for s, c in known) + rest * math.exp(lam * drift) - 1

    low, high = 1e-3, 1.0
    while over(high) < 0 and high < 16:
        high *= 2
    if over(high) > 0 and over(low) < 0:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if over(mid) > 0 else (mid, high)
    return Weights(tokens, pre_listed, drift), high if over(low) < 0 else 1.0, base


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> dict:
    """The model: token scores, lambda, ln K and the logistic curve.

    ``labels``: doc_id, toxic of the rows to learn from; about ``sample_rows``
    of them, picked by a hash of doc_id, are used. Two thirds give the token
    counts, the rest the constants of the extreme-value law and the curve.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    part = min(1.0, sample_rows / n) if n else 1.0
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    # The bound of the sample makes this side small.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = written(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    weights, lam, _ = token_table(rows.where(~held).select("text", "toxic"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [evidence(t.as_py(), weights) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array([[s for s, _, _ in f] for _, f in out], pa.list_(pa.float64()))],
                names=["toxic", "n", "s"],
            )

    seen = rows.where(held).select("text", F.col("toxic").cast("long")).mapInArrow(look, "toxic long, n long, s array<double>").collect()
    # For the expected maximum: ln K = mean(lambda * S - ln n) less Euler's constant.
    chance = [lam * max(r.s) - math.log(max(r.n, 1)) for r in seen if not r.toxic and r.s]
    clean = sum(not r.toxic for r in seen)
    ln_k = min(0.0, (sum(chance) / len(chance) - 0.5772 + math.log(len(chance) / clean)) if len(chance) >= 20 else math.log(0.01))
    x = np.array([features(r.n, [(s, 0, 0) for s in r.s], lam, ln_k) for r in seen]).reshape(-1, 2)
    y = np.array([r.toxic for r in seen], float)
    share = float(y.mean()) if len(y) else 0.0
    curve = _logistic(x, y) if 0 < share < 1 else None
    return {"weights": weights, "lam": lam, "ln_k": ln_k, "curve": curve, "share": share}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, and the significant passages as token spans with their scores."""
    shared = docs.sparkSession.sparkContext.broadcast(
        {"tokens": dict(model["weights"]), "prefixes": model["weights"].prefixes, "neutral": model["weights"].neutral, **{k: model[k] for k in ("lam", "ln_k", "curve", "share")}}
    )

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = Weights(m["tokens"], m["prefixes"], m["neutral"])
        for batch in batches:
            scores, passages = [], []
            for value in batch.column(1):
                n, found = evidence(value.as_py(), weights)
                x = features(n, found, m["lam"], m["ln_k"])
                z = None if m["curve"] is None else m["curve"][0] + m["curve"][1] * x[0] + m["curve"][2] * x[1]
                scores.append(m["share"] if z is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                level = m["ln_k"] + math.log(max(n, 1))
                passages.append([{"start": s, "end": e, "score": v} for v, s, e in found if m["lam"] * v > level])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"]
            )

    kind = "array<struct<start:bigint,end:bigint,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id long, score double, passages {kind}")
