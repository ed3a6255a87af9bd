"""Labelled rows for the classifiers: the part that may be learnt from, bounded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def held_out(id_col: str) -> Column:
    """True where labels must not be learnt from."""
    return F.coalesce(remainder(id_col) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents (_id, _text, _label) with a label of 0 or 1 that may be learnt from, at most rows ids.

    Ids are taken in the order of a hash of the id. An id with several labels counts as 1 if any is 1. The ids, at most
    rows of them, are broadcast.
    """
    kept = labels.filter(F.col(label).isin(0, 1) & (remainder(id_col) != 2)).groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
    kept = kept.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(rows).select(F.col(id_col).alias("_id"), "_label")
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return plain.join(F.broadcast(kept), "_id")


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method; mean and scale of the columns, and the weights with the constant last."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + l2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def probability(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))
