"""Score thresholds: a two-component Gaussian mixture on a histogram, or a percentile where it doesn't hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer scores, or components nearer or lighter than these, take the percentile; results are clamped.
LEAST, SEPARATION, WEIGHT, PERCENTILE, LOW, HIGH = 50, 1.0, 0.05, 0.30, 0.15, 0.80
BINS = 4096


def mixture(centres: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of two components, by expectation maximisation over a histogram."""
    total = counts.sum()
    order = np.cumsum(counts)
    mean = np.array([centres[np.searchsorted(order, total * q)] for q in (0.25, 0.75)], float)
    sd = np.full(2, max(np.sqrt((counts * (centres - (counts * centres).sum() / total) ** 2).sum() / total), 1e-3))
    weight = np.array([0.5, 0.5])
    for _ in range(rounds):
        p = weight * np.exp(-0.5 * ((centres[:, None] - mean) / sd) ** 2) / sd
        r = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300) * counts[:, None]
        n = np.maximum(r.sum(axis=0), 1e-12)
        new = (r * centres[:, None]).sum(axis=0) / n
        sd = np.sqrt(np.maximum((r * (centres[:, None] - new) ** 2).sum(axis=0) / n, 1e-8))
        weight, done = n / total, np.abs(new - mean).max() < 1e-9
        mean = new
        if done:
            break
    i = np.argsort(mean)
    return weight[i], mean[i], sd[i]


def fit(scores: DataFrame, column: str = "score") -> dict:
    """value, method, reason, n and the mixture. The driver gets a histogram of BINS counts, never the scores."""
    value = F.col(column)
    finite = scores.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(value.alias("s"))
    n, p30 = finite.agg(F.count("*"), F.percentile("s", F.lit(PERCENTILE))).first()
    out = {"n": n, "method": "p30_fallback", "reason": "no scores", "value": LOW}
    if not n:
        return out
    clamp = lambda x: float(min(max(x, LOW), HIGH))
    out |= {"value": clamp(p30), "reason": f"fewer than {LEAST} scores"}
    if n < LEAST:
        return out
    bins = finite.groupBy(F.floor((F.least(F.greatest("s", F.lit(-1.0)), F.lit(1.0)) + 1) / 2 * (BINS - 1)).alias("bin")).agg(F.count("*").alias("n")).collect()
    centres = np.array([r["bin"] for r in bins]) / (BINS - 1) * 2 - 1
    i = np.argsort(centres)
    weight, mean, sd = mixture(centres[i], np.array([r["n"] for r in bins], float)[i])
    apart = abs(mean[1] - mean[0]) / np.sqrt((sd**2).mean())
    out |= {"weights": weight.tolist(), "means": mean.tolist(), "stds": sd.tolist(), "separation": float(apart)}
    if apart < SEPARATION:
        return out | {"reason": "components aren't apart"}
    if weight.min() < WEIGHT:
        return out | {"reason": "a component is too light"}
    return out | {"method": "gmm", "reason": "midpoint", "value": clamp(mean.mean())}
