"""Operator 7 - quality classifier: regularised quadratic discriminant analysis.

Each whole text becomes a dozen and a half statistics, transformed to be near normal.
Each class has a mean and a covariance, shrunk toward the pooled covariance and then
toward its diagonal; the score is the logistic of the difference of log densities plus
the log prior ratio, from Mahalanobis distances by Cholesky factors that are computed
once at fitting and broadcast (some kilobytes).

Learning takes at most SAMPLE labelled rows, the ones of least hash of their id; only
their statistics reach the driver.

Defined results: null and empty texts have the statistics of the empty text and are
scored like any other; without labels of both classes every score is the prior of what
was seen (0.5 if nothing); repeated rows score alike; labels, lang, source and doc_id are
no inputs of a score; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.llm.common import column, map_arrow, table, texts_of
from latticelake.llm.langid import fold

#: Labelled rows that the model may learn from at most.
SAMPLE = 12_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Shares of the pooled covariance, and of the diagonal, in a class's covariance.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.10, 0.05, 1e-3

NAMES = (
    "log_chars", "word_length", "distinct", "top_word", "runs", "letters", "upper", "digits", "marks", "spaces", "bare_marks", "marked_ends", "line_repeats", "line_length", "packed", "shout",
)

_KIND = np.full(256, 5)  # 0 lower and non-ASCII, 1 upper, 2 digit, 3 mark, 4 white
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    raw = text.encode()
    n = len(raw) + 1
    kinds = np.bincount(_KIND, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 6) / n
    words = text.split()
    m = len(words)
    counts = Counter(words)
    runs = sum(map(eq, words, words[1:]))
    bare = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    marked = sum(c for w, c in counts.items() if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    shout = sum(c for w, c in counts.items() if len(w) > 2 and w.isupper())
    lines = text.split("\n")
    packed = len(zlib.compress(raw, 1)) / n if raw else 1.0
    logit = lambda k, of: math.log((k + 0.5) / (max(of - k, 0) + 0.5))
    return [
        math.log(n), math.log1p(len(text) / (m + 1)), math.log((len(counts) + 1) / (m + 1)) / math.log(m + 3), math.log((max(counts.values(), default=0) + 1) / (m + 1)),
        math.sqrt(runs / (m + 1)), kinds[0], math.sqrt(kinds[1]), math.sqrt(kinds[2]), math.sqrt(kinds[3]), math.sqrt(kinds[4]), math.sqrt(bare / (m + 1)),
        math.sqrt(marked / (m + 1)), logit(len(lines) - len(set(lines)), len(lines)), math.log(n / len(lines)), math.log(packed), math.sqrt(shout / (m + 1)),
    ]


class Discriminant:
    """Two Gaussians with cached Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = np.bincount(y, minlength=2) if len(y) else np.zeros(2)
        self.prior = float((n[1] + 1) / (n.sum() + 2))
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] | None = None
        if min(n) < 2:
            return
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.centre) / self.scale
        parts = [z[y == c] for c in (0, 1)]
        own = [np.cov(p.T, bias=True) for p in parts]
        pooled = sum(len(p) * s for p, s in zip(parts, own, strict=True)) / len(z)
        self.classes = []
        for p, s in zip(parts, own, strict=True):
            s = (1 - TO_POOLED) * s + TO_POOLED * pooled
            s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.classes.append((p.mean(0), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        prior = math.log(self.prior / (1 - self.prior))
        if self.classes is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - half for mean, inverse, half in self.classes]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + prior, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    key = F.col("doc_id").cast("string")
    picked = (
        labels.where("quality in (0, 1) and doc_id is not null").where(fold(labels, FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64(key), "doc_id").limit(SAMPLE)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in texts_of(batch)]
            yield pa.record_batch([column(batch, "quality"), pa.array(x, pa.list_(pa.float64()))], ["quality", "x"])

    got = map_arrow(rows.select("quality", "text"), run, "quality int, x array<double>").limit(2 * SAMPLE).collect()
    return Discriminant(np.array([r["x"] for r in got]).reshape(-1, len(NAMES)), np.array([r["quality"] for r in got], int))


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch)]).reshape(-1, len(NAMES))
            yield pa.record_batch([column(batch, "doc_id"), pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(out, FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
