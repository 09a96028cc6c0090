"""Linear hinge-loss models by dual coordinate descent, their calibration, and the labelled sample they learn from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def dual_descent(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum(cost * hinge) by steps on one dual variable at a time.

    rows: for each example its places and values; labels: 1 or -1.  The last weight is the bias.
    """
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            y = labels[i]
            slope = y * (float(values @ w[at]) + w[-1]) - 1.0
            now = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (now - alpha[i]) * y
            if step:
                w[at] += step * values
                w[-1] += step
                alpha[i] = now
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, offset) that make sigmoid(slope * margin + offset) a probability: logistic regression with
    smoothed targets, by Newton steps."""
    pos, neg = float((labels > 0).sum()), float((labels <= 0).sum())
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = sigmoid(x @ theta)
        gradient = x.T @ (p - target) + 1e-3 * np.array([theta[0], 0.0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def logistic(x: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression whose last column is constant, by damped Newton steps."""
    y, theta = (labels > 0).astype(np.float64), np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = sigmoid(x @ theta)
        gradient = x.T @ (p - y) + penalty * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        theta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sizes: dict[int, int], seed: int) -> DataFrame:
    """(text, label) of at most sizes[v] documents of each label v, never of the held-out fold.

    The sample is the rows whose seeded hash of doc_id is smallest.  Of a repeated doc_id the largest label
    counts, and the text least in order.  Only the chosen ids, at most sum(sizes) rows, are broadcast.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*sizes) & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = None
    for value, n in sizes.items():
        part = marked.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull()).groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(sample: DataFrame, train: Callable[[list[bytes], np.ndarray], bytes]) -> bytes:
    """Runs ``train`` on the bounded sample in one task; only the model comes to the driver."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        texts = [v.as_py().encode() for v in table.column("text")]
        return pa.table({"model": pa.array([train(texts, np.array(table.column("label").to_pylist(), np.int64))], pa.binary())})

    got = sample.groupBy(F.lit(0).alias("one")).applyInArrow(run, "model binary").first()
    return bytes(got["model"]) if got else train([], np.empty(0, np.int64))
