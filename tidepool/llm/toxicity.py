"""Operator 2: toxicity by maximum-scoring segments.

Words, and their first four and five letters, are counted by hashed bucket (tables of fixed size), once for each labelled
document that has them, so that a word repeated in one document is no more than one occurrence. A bucket's score is its log-odds ratio under a Dirichlet prior, shrunk to zero where it isn't significant. A linear scan
finds all maximal segments of a text by these scores less a drift. Extreme-value statistics of the labelled clean
documents say how high a segment scores by chance in a text of that length; what the significant segments score beyond
that adds up to the document's evidence, which a logistic curve turns into a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

BUCKETS = 1 << 18
WORD = re.compile(r"[^\W_]+").findall
WORDS = re.compile(r"[^\W_]+").finditer
DRIFT = 0.5
PRIOR = 2.0  # pseudo-tokens of each bucket, dealt to the classes by their sizes
LEAST_Z = 3.0
LEAST_SEEN = 12  # documents from which a word, or its first five letters, speak for themselves
MOST_P = 0.01  # of a significant segment
SEGMENTS = "array<struct<start:int,end:int,score:double,p:double>>"
EULER = 0.5772156649015329


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4, F.lit(0))


def buckets(word: str) -> tuple[int, int, int]:
    """Of the whole word, of its first five letters and of its first four."""
    w = word.lower()
    of = lambda s, n: n * BUCKETS + zlib.crc32(s.encode()) % BUCKETS
    return of(w, 0), of(w[:5], 1), of(w[:4], 2)


def count_words(labelled: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): words of labelled(text, toxic), once a document, by bucket; a task sends each bucket once at most."""

    def run(batches):
        found = np.zeros((2, 3 * BUCKETS), np.int64)
        seen = (Counter(), Counter())

        def flush():
            for of, words in zip(found, seen):
                if words:
                    at = np.array([buckets(w) for w in words])
                    np.add.at(of, at, np.fromiter(words.values(), np.int64, len(words))[:, None])
                    words.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic].update(set(WORD(text.as_py() or "")))
                if len(seen[toxic]) > 300_000:
                    flush()
        flush()
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[1, at]), pa.array(found[0, at])], ["bucket", "toxic", "clean"])

    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    return rows.mapInArrow(run, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds ratio with a Dirichlet prior for each bucket, times 1 - (LEAST_Z / z)^2, or zero below LEAST_Z; NaN
    where a word or five letters were seen too rarely."""
    n1, n0 = max(toxic[:BUCKETS].sum(), 1), max(clean[:BUCKETS].sum(), 1)
    a1, a0 = PRIOR * n1 / (n1 + n0), PRIOR * n0 / (n1 + n0)
    ratio = np.log((toxic + a1) / (n1 + a1)) - np.log((clean + a0) / (n0 + a0))
    z = ratio / np.sqrt(1 / (toxic + a1) + 1 / (clean + a0))
    out = ratio * np.maximum(0, 1 - (LEAST_Z / np.maximum(np.abs(z), 1e-9)) ** 2)
    out[: 2 * BUCKETS][(toxic + clean)[: 2 * BUCKETS] < LEAST_SEEN] = np.nan
    return out.astype(np.float32)


class Scores(dict):
    """Score less drift by word: the word's own if it was seen often enough, else its first letters'. Bounded memory."""

    def __init__(self, weights: np.ndarray, most: int = 300_000):
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        score = next(float(s) for s in self.weights[list(buckets(word))] if s == s) - DRIFT
        self[word] = score
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass: each segment's score is highest among all that
    overlap it, and it is no part of one that scores more. Negative stretches only enter through running sums."""
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    before: list[int] = []  # for each: the last earlier one with a lower sum before it
    for i in np.flatnonzero(scores > 0).tolist():
        start, low, high = i, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = before[j]
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:], before[j:]
        found.append((start, i + 1, low, high))
        before.append(j)
    return [(s, e, float(hi - lo)) for s, e, lo, hi in found]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    decay: float  # lambda: chance of a segment falls by exp(-lambda) a point
    log_k: float
    slope: float
    offset: float

    def noise(self, words: int) -> float:
        return self.log_k + math.log(max(words, 1))

    def evidence(self, segments, words: int) -> tuple[float, list]:
        """Sum over significant segments of what they score beyond chance, and these segments with their p."""
        out, total = [], 0.0
        for s, e, score in segments:
            beyond = self.decay * score - self.noise(words)
            p = -math.expm1(-math.exp(min(-beyond, 50)))
            if p <= MOST_P:
                out.append((s, e, score, p))
                total += beyond
        return total, out

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def solve_decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of mean(exp(decay * score)) = 1; 1 where there is none."""
    p = counts / max(counts.sum(), 1)
    f = lambda x: (p * np.exp(x * values)).sum() - 1
    if not (values > 0).any() or (p * values).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1e-6
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def fit_logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (at least 0) and offset of a logistic curve for counts of either class at each x, a little regularised."""
    a, b, n = 0.1, 0.0, toxic + clean
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        ga, gb = ((n * p - toxic) * x).sum() + 0.1 * a, (n * p - toxic).sum() + 0.01 * b
        haa, hab, hbb = (w * x * x).sum() + 0.1, (w * x).sum(), w.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(0.0, a - max(-1.0, min(1.0, da))), b - max(-2.0, min(2.0, db))
    return a, b


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labels(doc_id, toxic) of documents whose fold isn't 2: words from folds 0 and 1, calibration from 3.

    A document's toxic label is the largest it has; null labels are left out. Without labels of both kinds the model
    gives every text the share of toxic labels (0 without labels).
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).filter("fold != 2")
    # labels grow with the documents, without a bound: a merge at every size, not a broadcast while they are few
    rows = settle(docs.select("doc_id", "text").filter(fold(F.col("doc_id")) != 2).join(known.hint("merge"), "doc_id").select("text", "toxic", "fold"))
    counts = count_words(rows.filter("fold < 2")).toPandas()  # at most 3 * BUCKETS rows
    found = np.zeros((2, 3 * BUCKETS))
    found[:, counts.bucket] = counts.toxic, counts.clean
    weights = log_odds(*found)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        scores = Scores(shared.value)
        for batch in batches:
            out = []
            for text in batch.column(0):
                words = WORD(text.as_py() or "")
                x = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
                rounded, n = np.unique(np.round(x * 4), return_counts=True)
                best = sorted((s for *_, s in maximal_segments(x)), reverse=True)
                out.append((len(words), best, (rounded / 4).tolist(), n.tolist()))
            if out:
                types = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["toxic", "words", "best", "value", "n"])

    scored = settle(rows.filter("fold = 3").select("text", F.col("toxic").cast("long")).mapInArrow(run, "toxic long, words long, best array<double>, value array<double>, n array<long>"))
    clean = scored.filter("toxic = 0 and words > 0")
    steps = clean.select(F.explode(F.arrays_zip("value", "n")).alias("x")).groupBy("x.value").agg(F.sum("x.n").alias("n")).toPandas()  # scores in quarters: a few hundred
    decay = solve_decay(steps.value.to_numpy(float), steps.n.to_numpy(float))
    peak = F.coalesce(F.get("best", F.lit(0)), F.lit(0.0)) * decay - F.log("words")
    mean = clean.agg(F.avg(peak)).first()[0]
    log_k = max(-30.0, min(5.0, (mean if mean is not None else 0.0) - EULER))
    plain = Model(weights, decay, log_k, 1.0, 0.0)
    noise = F.log(F.greatest("words", F.lit(1))) + log_k
    least = -math.log(-math.log1p(-MOST_P))  # beyond this a segment's p is at most MOST_P
    beyond = F.filter(F.transform("best", lambda s: s * plain.decay - noise), lambda y: y >= least)
    total = F.least(F.aggregate(beyond, F.lit(0.0), lambda acc, y: acc + y), F.lit(200.0))
    bins = scored.select("toxic", F.round(total, 0).alias("x")).groupBy("x").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).toPandas()  # at most 201 rows
    slope, offset = fit_logistic(bins.x.to_numpy(float), bins.toxic.to_numpy(float), bins.clean.to_numpy(float)) if len(bins) else (0.0, -500.0)
    return Model(weights, decay, log_k, slope, offset)


def _scorer(model):
    scores = Scores(model.weights)

    def score(text: str | None, spans: bool):
        words = WORD(text or "")
        x = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
        evidence, segments = model.evidence(maximal_segments(x), len(words))
        if spans and segments:
            at = [m.span() for m in WORDS(text)]
            segments = [{"start": at[s][0], "end": at[e - 1][1], "score": v, "p": p} for s, e, v, p in segments]
        return model.probability(evidence), segments

    return score


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, segments (character spans of all significant passages) for each row of docs(doc_id, text).

    Null and empty texts score as a text without toxic words; texts of any length are read whole; repeated rows are scored
    each; null doc_ids stay (held_out false); other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches):
        score = _scorer(shared.value)
        for batch in batches:
            got = [score(t.as_py(), True) for t in batch.column(2)]
            if got:
                p = np.array([g[0] for g in got])
                predicted = pa.array((p >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), predicted, pa.array([g[1] for g in got], kind)], ["doc_id", "held_out", "score", "predicted", "segments"])

    held_out = (fold(F.col("doc_id")) == 2).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, "text").mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, segments {SEGMENTS}")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        score = _scorer(shared.value)
        for batch in batches:
            keep = pa.array([score(t.as_py(), False)[0] < threshold for t in batch.column(at)], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"))
