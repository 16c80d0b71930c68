"""Fitting the models that turn context/object features into distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kmerloom.functions.scalars import EPSILON

FEATURES = ("xny_ctx", "n_diff_obj_section", "n_mut2_ctx", "n_diff_obj")
#: The denominators are searched on at most this many rows (those of smallest hash); the coefficients are fitted to all.
SAMPLE_ROWS = 50_000


def design(x: np.ndarray, denominators: np.ndarray) -> np.ndarray:
    """[row, 17]: 1, the four features, the three shares (one over a weighted sum of the features), and three features times each share."""
    shares = 1 / (x @ denominators.reshape(3, 4).T + EPSILON)
    return np.concatenate([np.ones((len(x), 1)), x, shares, *(x[:, :3] * shares[:, k : k + 1] for k in range(3))], axis=1)


def _residual(denominators: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    a = design(x, denominators)
    if not np.isfinite(a).all():
        return np.inf
    scale = np.abs(a).max(0) + 1e-300
    error = a @ (np.linalg.lstsq(a / scale, y, rcond=None)[0] / scale) - y
    return float(np.sqrt(error @ error / max(1, len(y) - a.shape[1])))


def simplex_search(objective, start: np.ndarray, rounds: int, tolerance: float = 1e-6) -> np.ndarray:
    """The downhill simplex method of Nelder and Mead: reflect, expand, contract or shrink, until the values agree."""
    points = [start, *(start + 0.1 * np.maximum(np.abs(start), 1) * e for e in np.eye(len(start)))]
    ranked = sorted(((objective(p), k, p) for k, p in enumerate(points)), key=lambda v: v[:2])
    for n in range(rounds):
        worst, best = ranked[-1], ranked[0]
        if abs(worst[0] - best[0]) <= tolerance * (abs(best[0]) + tolerance):
            break
        centre = np.mean([p for _, _, p in ranked[:-1]], axis=0)
        at = lambda t: (objective(q := centre + t * (centre - worst[2])), len(ranked) + n, q)  # noqa: B023, E731
        tried = at(1.0)
        if tried[0] < best[0]:
            tried = min(tried, at(2.0), key=lambda v: v[0])
        elif tried[0] >= ranked[-2][0]:
            tried = at(0.5 if tried[0] < worst[0] else -0.5)
        if tried[0] < worst[0]:
            ranked[-1] = tried
        else:
            ranked = [best, *((objective(q := (best[2] + p) / 2), k, q) for _, k, p in ranked[1:])]
        ranked.sort(key=lambda v: v[:2])
    return ranked[0][2]


def train_regression(rows: DataFrame, label: Column, sample_rows: int = SAMPLE_ROWS, rounds: int = 1000) -> dict:
    """Denominators, coefficients, rows and residual standard error of the three-denominator model of distance.

    ``rows`` has the four feature columns; rows with a null in them or in the label don't count. Denominators come from a
    simplex search on a sample, coefficients from the normal equations of all rows, summed up by tasks (18 x 18 numbers each).
    Raises where there are no more rows than coefficients.
    """
    clean = rows.select(*[F.col(c).cast("double").alias(c) for c in FEATURES], label.cast("double").alias("y")).dropna()
    sample = clean.orderBy(F.xxhash64(*FEATURES, "y")).limit(sample_rows).toPandas()
    x, y = sample[list(FEATURES)].to_numpy(), sample["y"].to_numpy()
    if len(y) <= 17:
        raise ValueError("too few rows")
    denominators = simplex_search(lambda p: _residual(p, x, y), np.ones(12), rounds)
    scale = np.append(np.abs(design(x, denominators)).max(0) + 1e-300, 1.0)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((18, 18)), 0
        for batch in batches:
            a = np.concatenate([design(batch[list(FEATURES)].to_numpy(), denominators), batch[["y"]].to_numpy()], axis=1) / scale
            total += a.T @ a
            n += len(batch)
        yield pd.DataFrame({"cell": np.arange(325), "value": np.append(total.ravel(), n)})

    cells = dict(clean.mapInPandas(gram, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect())
    whole, n = np.array([cells[i] for i in range(324)]).reshape(18, 18), int(cells[324])
    fitted = np.linalg.lstsq(whole[:17, :17], whole[:17, 17], rcond=1e-13)[0]
    square = max(0.0, whole[17, 17] - 2 * fitted @ whole[:17, 17] + fitted @ whole[:17, :17] @ fitted)
    return {"denominators": denominators.reshape(3, 4), "coefficients": fitted / scale[:17], "rows": n, "sigma": float(np.sqrt(square / max(1, n - 17)))}


def predicted(rows: DataFrame, model: dict) -> Column:
    """The model's distance as a column over the feature columns."""
    f = [F.col(c).cast("double") for c in FEATURES]
    shares = [1 / (sum(float(w) * c for w, c in zip(d, f, strict=True)) + EPSILON) for d in model["denominators"]]
    terms = [*f, *shares, *(c * s for s in shares for c in f[:3])]
    out = F.lit(float(model["coefficients"][0]))
    for weight, term in zip(model["coefficients"][1:], terms, strict=True):
        out = out + float(weight) * term
    return out


def train_boosted(rows: DataFrame, label: Column, features: tuple[str, ...] = (*FEATURES, "qry_align_fraction", "ref_align_fraction"), trees: int = 20, depth: int = 5, seed: int = 1):
    """A fitted pipeline of boosted regression trees; ``transform`` adds ``prediction``. Rows with a null don't count."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    clean = rows.select(*[F.col(c).cast("double").alias(c) for c in features], label.cast("double").alias("label")).dropna()
    stages = [VectorAssembler(inputCols=list(features), outputCol="__features"), GBTRegressor(featuresCol="__features", maxIter=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(clean)
