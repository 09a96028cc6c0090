"""Quality classifier: Naive Bayes support vectors.

A document's features are indicators of hashed byte n-grams (1 to 4) and of runs of equal words.  Each
indicator is scaled by its log-count ratio between the classes, rows are brought to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent.  A logistic curve on out-of-fold margins
turns a margin into a probability.

The classifier is fitted on a bounded sample: at most ``SAMPLE`` labelled documents of each class outside
the held-out fold.  Every text is scored whole.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, linear

BITS = 18
ORDERS = (1, 2, 3, 4)
RUNS = (2, 3, 4, 6)
SAMPLE = 3000
THRESHOLD = 0.7
WIDTH = (1 << BITS) + len(RUNS)
_LAST = {}


def features(text: bytes) -> np.ndarray:
    """Places of the text's indicators, each once."""
    last = _LAST.setdefault("last", np.zeros(1 << BITS, np.int32))
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    hashes, value = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(data) < n:
            break
        value = value[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            hashes.append(((value * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int32))
    places = np.concatenate(hashes) if hashes else np.empty(0, np.int32)
    order = np.arange(len(places), dtype=np.int32)
    last[places] = order
    places = places[last[places] == order]  # the last of equal places stands for all
    words = text.split()
    same = np.fromiter((a == b for a, b in pairwise(words)), bool, max(0, len(words) - 1))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    longest = int((edges[1::2] - edges[::2]).max()) + 1 if len(edges) else 1
    return np.concatenate((places, [(1 << BITS) + i for i, r in enumerate(RUNS) if longest >= r])).astype(np.int64)


def _unit(places: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = ratio[places]
    return places, values / max(float(np.sqrt(values @ values)), 1e-12)


def _ratio(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the documents that have each feature, by class."""
    counts = [np.bincount(np.concatenate([r for r, g in zip(rows, good) if g == c] or [np.empty(0, np.int64)]), minlength=WIDTH) + smooth for c in (True, False)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def _solve(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    y = np.where(good, 1.0, -1.0)
    cost = np.where(good, len(y) / (2 * good.sum()), len(y) / (2 * (~good).sum()))
    return linear.dual_descent([_unit(r, ratio) for r in rows], y, WIDTH, cost)


def train(texts: list[bytes], labels: np.ndarray) -> bytes:
    good = labels == 1
    out = io.BytesIO()
    if not len(texts) or good.all() or not good.any():
        prior = 0.5 if not len(texts) else (good.sum() + 1) / (len(good) + 2)
        np.savez(out, w=np.zeros(WIDTH + 1, np.float32), r=np.zeros(WIDTH, np.float32), curve=np.array([0.0, np.log(prior / (1 - prior))]), floor=min(prior, 0.5))
        return out.getvalue()
    rows = [features(t) for t in texts]
    fold = np.arange(len(rows)) % 2
    margins = np.zeros(len(rows))
    for k in (0, 1):
        own = [r for r, f in zip(rows, fold) if f != k]
        if good[fold != k].all() or not good[fold != k].any():
            continue
        ratio = _ratio(own, good[fold != k])
        w = _solve(own, good[fold != k], ratio)
        for i in np.flatnonzero(fold == k):
            at, values = _unit(rows[i], ratio)
            margins[i] = values @ w[at] + w[-1]
    ratio = _ratio(rows, good)
    w = _solve(rows, good, ratio)
    curve = linear.calibrate(margins, np.where(good, 1, -1))
    np.savez(out, w=w.astype(np.float32), r=ratio.astype(np.float32), curve=np.array(curve), floor=min(0.5, float(linear.sigmoid(curve[0] * margins.min() + curve[1]))))
    return out.getvalue()


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> bytes:
    return linear.fit(linear.labelled_sample(docs, labels, "quality", {1: SAMPLE, 0: SAMPLE}, seed), train)


def score(df: DataFrame, model: bytes, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """Adds ``out_col``: the probability that a text is of good quality.

    Null counts as an empty text; a text without words says nothing for good quality, so it has the score of the worst
    text of the sample, 0.5 at most.  Repeated rows have equal scores; an input column named like the output is replaced.
    """
    return df.withColumn(out_col, score_of(df, model, text_col))


def score_of(df: DataFrame, model: bytes, text_col: str = "text") -> Column:
    """The score as a column of df."""
    common.bound_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        got = np.load(io.BytesIO(sent.value))
        w, ratio, (slope, offset), floor = got["w"].astype(np.float64), got["r"].astype(np.float64), got["curve"], float(got["floor"])
        product = w[:-1] * ratio
        for texts in batches:
            margins = []
            for v in texts:
                text = v.as_buffer().to_pybytes() if v.is_valid else b""
                if not text.strip():
                    margins.append(np.nan)
                    continue
                at = features(text)
                values = ratio[at]
                margins.append(product[at].sum() / max(float(np.sqrt(values @ values)), 1e-12) + w[-1])
            margins = np.array(margins)
            yield pa.array(np.where(np.isnan(margins), floor, linear.sigmoid(slope * margins + offset)), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(F.col(text_col).cast("binary"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    return docs.where(score_of(docs, fit(docs, labels)) >= threshold)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), out_col="score")
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
