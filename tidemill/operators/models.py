"""Fitted forecasts: boosted trees on histograms, their search, selection, refit, importance and frozen use.

A model is fitted on a seeded sample of at most SAMPLE labelled rows, in NumPy, one task a model; thresholds, errors,
selection and predictions cover all rows, in Arrow batches.
"""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.eda import seeded_sample
from tidemill.operators.metrics import ranked
from tidemill.session import shared_dir

#: Labelled rows a model is fitted on at most; the bound of what a task or the driver holds.
SAMPLE = 10_000
BINS = 32
GRID = {"max_depth": [3, 4, 5], "trees": [40, 80, 120], "rate": [0.05, 0.1, 0.2], "min_rows": [1, 5, 20]}
PARAMS = "max_depth int, trees int, rate double, min_rows int"


def candidates(n: int, seed: int = 42) -> list[dict]:
    """n different parameter sets drawn from GRID, the same for a seed."""
    keys = sorted(GRID)
    every = [()]
    for k in keys:
        every = [(*e, v) for e in every for v in GRID[k]]
    chosen = random.Random(seed).sample(every, min(n, len(every)))
    return [dict(zip(keys, c, strict=True)) for c in chosen]


class Trees:
    """Squared-error boosting with trees of equal depth: node i leads to 2 i + 1 (at most the threshold) and 2 i + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, gain: np.ndarray):
        self.base, self.feature, self.threshold, self.value, self.gain = base, feature, threshold, value, gain

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, max_depth: int, trees: int, rate: float, min_rows: int) -> Trees:
        """Splits lie at quantiles of the features; a node is split where the squared error falls most, each side keeping min_rows."""
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), int)
        flat = binned + np.arange(width) * BINS
        size = 2 ** (max_depth + 1) - 1
        feature, threshold, value = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size))
        base, gains = float(y.mean()) if n else 0.0, np.zeros(width)
        guess = np.full(n, base)
        for t in range(trees if n else 0):
            rest = y - guess
            node = np.zeros(n, np.int64)
            for level in range(max_depth):
                first, count = 2**level - 1, 2**level
                rows = np.flatnonzero(node >= first)
                at = ((node[rows] - first)[:, None] * (width * BINS) + flat[rows]).ravel()
                total = np.bincount(at, np.repeat(rest[rows], width), count * width * BINS).reshape(count, width, BINS)
                held = np.bincount(at, minlength=count * width * BINS).reshape(count, width, BINS)
                left, some = total.cumsum(2), held.cumsum(2)
                whole, all_ = left[:, :, -1:], some[:, :, -1:]
                other = all_ - some
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = left**2 / some + (whole - left) ** 2 / other - whole**2 / all_
                gain = np.where((some >= min_rows) & (other >= min_rows), gain, -np.inf)[:, :, :-1].reshape(count, -1)
                best = gain.argmax(1)
                split = gain[np.arange(count), best] > 1e-9
                f, b = best // (BINS - 1), best % (BINS - 1)
                for k in np.flatnonzero(split):
                    feature[t, first + k], threshold[t, first + k] = f[k], edges[f[k]][b[k]]
                    gains[f[k]] += gain[k, best[k]]
                k = node[rows] - first
                going = rows[split[k]]
                k = k[split[k]]
                node[going] = 2 * node[going] + 1 + (binned[going, f[k]] > b[k])
            held = np.bincount(node, minlength=size)
            value[t] = rate * np.bincount(node, rest, size) / np.maximum(held, 1)
            guess = guess + value[t][node]
        return Trees(base, feature, threshold, value, gains)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), (self.feature.shape[1] + 1).bit_length() - 2
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, f] > threshold[node]), node)
            out += value[node]
        return out

    def dump(self) -> str:
        return json.dumps({"base": self.base, **{k: getattr(self, k).tolist() for k in ("feature", "threshold", "value", "gain")}})

    @staticmethod
    def parse(text: str) -> Trees:
        d = json.loads(text)
        return Trees(d["base"], np.array(d["feature"], np.int32), *(np.array(d[k]) for k in ("threshold", "value", "gain")))


def sampled(df: DataFrame, key: Sequence[str], columns: Sequence[str], rows: int = SAMPLE) -> pd.DataFrame:
    """The seeded sample of labelled rows that models are fitted on, on the driver: at most `rows` rows of `columns`."""
    return seeded_sample(df.select(*key, *[c for c in columns if c not in key]), key, rows).toPandas()[list(columns)]


def fit(samples: dict[int, pd.DataFrame], features: Sequence[str], tasks: Sequence[tuple[int, dict]], spark: SparkSession, log_target: bool = False) -> list[Trees]:
    """One model for every (horizon, parameters), each fitted by a task of its own on the horizon's sample (features and target).

    log_target: on log(1 + target), where a target below 0 counts as 0.
    """
    names = list(features)
    held = {h: (s[names].to_numpy(float), s["target"].to_numpy(float)) for h, s in samples.items()}
    sent = spark.sparkContext.broadcast(held)  # at most SAMPLE rows a horizon

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for no, horizon, params in pdf.itertuples(index=False):
                x, y = sent.value[horizon]
                out.append((no, Trees.fit(x, np.log1p(np.maximum(y, 0)) if log_target else y, **json.loads(params)).dump()))
            yield pd.DataFrame(out, columns=["no", "model"])

    rows = spark.createDataFrame([(i, h, json.dumps(p)) for i, (h, p) in enumerate(tasks)], "no int, horizon int, params string")
    found = rows.repartition(len(tasks), "no").mapInPandas(run, "no int, model string").collect()  # as many as tasks
    return [Trees.parse(r["model"]) for r in sorted(found, key=lambda r: r["no"])]


def predict(df: DataFrame, features: Sequence[str], models: dict[str, Trees], log_target: bool = False, clip: bool = False) -> DataFrame:
    """df without the features, once per model: with model (its name) and y_pred; log ones come back by exp(x) - 1."""
    keep = [c for c in df.columns if c not in features]
    names = list(features)
    sent = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            for name, model in sent.value.items():
                y = model.predict(x)
                yield pdf[keep].assign(model=name, y_pred=np.expm1(y) if log_target else np.maximum(y, 0) if clip else y)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in keep)
    return df.mapInPandas(run, f"{schema}, model string, y_pred double")


def search(data: Callable[[int], DataFrame], key: Sequence[str], features: Sequence[str], horizons: Sequence[int], n: int, seed: int = 42) -> DataFrame:
    """(horizon, candidate, max_depth, trees, rate, min_rows, valid_mae, rank, selected) of n candidates for each horizon.

    Fitted on the sample of train rows, judged on all valid rows, ranked by validation error, then depth, trees and least
    rows of a node, then the candidate's number.
    """
    chosen = candidates(n, seed)
    sets = {h: data(h) for h in horizons}
    spark = next(iter(sets.values())).sparkSession
    samples = {h: sampled(d.where(F.col("split") == "train"), key, [*features, "target"]) for h, d in sets.items()}
    tasks = [(h, p) for h in horizons for p in chosen]
    fitted = fit(samples, features, tasks, spark)
    errors = None
    for i, h in enumerate(horizons):
        models = {str(k): m for k, m in enumerate(fitted[i * len(chosen) : (i + 1) * len(chosen)])}
        judged = predict(sets[h].where(F.col("split") == "valid").select("horizon", "target", *features), features, models)
        part = judged.groupBy("horizon", F.col("model").cast("int").alias("candidate")).agg(F.avg(F.abs(F.col("y_pred") - F.col("target"))).alias("valid_mae"))
        errors = part if errors is None else errors.unionByName(part)
    table = spark.createDataFrame([(k, p["max_depth"], p["trees"], p["rate"], p["min_rows"]) for k, p in enumerate(chosen)], f"candidate int, {PARAMS}")
    joined = errors.join(F.broadcast(table), "candidate")  # n rows
    return ranked(joined, ["horizon"], [F.col("valid_mae").asc_nulls_last(), F.col("max_depth"), F.col("trees"), F.col("min_rows"), F.col("candidate")])


def selected(found: DataFrame) -> dict[int, dict]:
    """The parameters a search selected, by horizon."""
    return {r["horizon"]: {k: r[k] for k in GRID} for r in found.where("selected").collect()}  # one row a horizon


def importance(model: Trees, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance, rank, selected): each feature's share of the squared error that the splits took away, ties by name."""
    share = model.gain / (model.gain.sum() or 1.0)
    table = spark.createDataFrame([(f, float(v)) for f, v in zip(features, share, strict=True)], "feature string, importance double")
    return ranked(table, [], [F.desc("importance"), F.col("feature")])


def permutation_importance(model: Trees, sample: pd.DataFrame, features: Sequence[str], spark: SparkSession, seed: int = 42) -> DataFrame:
    """(feature, importance, rank, selected): growth of the absolute error on the sample when a feature's values are dealt to other rows.

    Stands in for Shapley values, for which there is no library here; the numbers are not comparable.
    """
    x, y = sample[list(features)].to_numpy(float), sample["target"].to_numpy(float)
    error = lambda x: float(np.abs(model.predict(x) - y).mean()) if len(y) else 0.0
    base, out = error(x), []
    for k, f in enumerate(features):
        dealt = x.copy()
        dealt[:, k] = np.random.default_rng(seed + k).permutation(x[:, k])
        out.append((f, error(dealt) - base))
    return ranked(spark.createDataFrame(out, "feature string, importance double"), [], [F.desc("importance"), F.col("feature")])


def save(model: Trees, spark: SparkSession, name: str) -> str:
    """Writes the fitted model under the shared folder, in a place of its own; returns its path."""
    path = f"{shared_dir(spark)}/tidemill-models/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([(model.dump(),)], "value string").coalesce(1).write.text(path)
    return path


def load(spark: SparkSession, path: str) -> Trees:
    return Trees.parse(spark.read.text(path).first()[0])
