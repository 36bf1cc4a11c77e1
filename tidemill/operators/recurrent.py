"""A recurrent forecast: one long short-term memory layer in NumPy, with early stopping, selection and refit."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sets of parameters that are tried; sequences are as long as `lookback`.
CANDIDATES = [{"units": 8, "lookback": 12, "dropout": 0.0}, {"units": 16, "lookback": 12, "dropout": 0.2}, {"units": 16, "lookback": 24, "dropout": 0.2}]
EPOCHS, PATIENCE, BATCH, RATE = 12, 3, 256, 0.01


class Lstm:
    """Gates in the order input, forget, candidate, output; the last state leads to one number."""

    def __init__(self, weights: list[np.ndarray]):
        self.w = weights

    @staticmethod
    def start(inputs: int, units: int, seed: int) -> Lstm:
        rng = np.random.default_rng(seed)
        put = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        bias = np.zeros(4 * units)
        bias[units : 2 * units] = 1.0
        return Lstm([put(inputs, 4 * units), put(units, 4 * units), bias, put(units, 1), np.zeros(1)])

    def forward(self, x: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        wx, wh, b, wo, bo = self.w
        u = wh.shape[0]
        h = c = np.zeros((len(x), u))
        steps = []
        for t in range(x.shape[1]):
            z = x[:, t] @ wx + h @ wh + b
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * u : (k + 1) * u], -30, 30))) for k in (0, 1, 3))
            g = np.tanh(z[:, 2 * u : 3 * u])
            before, c0 = h, c
            c = f * c0 + i * g
            h = o * np.tanh(c)
            steps.append((before, c0, i, f, g, o, c))
        last = h if keep is None else h * keep
        return (last @ wo + bo)[:, 0], [steps, last, keep]

    def gradients(self, x: np.ndarray, held: list, error: np.ndarray) -> list[np.ndarray]:
        """Of half the mean squared error; error is the prediction less the target."""
        wx, wh, _, wo, _ = self.w
        steps, last, keep = held
        d = (error / len(error))[:, None]
        out = [np.zeros_like(w) for w in self.w]
        out[3], out[4] = last.T @ d, d.sum(0)
        dh = d @ wo.T * (1 if keep is None else keep)
        dc = np.zeros_like(dh)
        for t in reversed(range(x.shape[1])):
            before, c0, i, f, g, o, c = steps[t]
            th = np.tanh(c)
            dc = dc + dh * o * (1 - th**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g**2), dh * th * o * (1 - o)], axis=1)
            out[0] += x[:, t].T @ dz
            out[1] += before.T @ dz
            out[2] += dz.sum(0)
            dh, dc = dz @ wh.T, dc * f
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]

    def dump(self) -> str:
        return json.dumps([w.tolist() for w in self.w])

    @staticmethod
    def parse(text: str) -> Lstm:
        return Lstm([np.array(w) for w in json.loads(text)])


def train(x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, units: int, dropout: float, epochs: int = EPOCHS, patience: int = PATIENCE, seed: int = 42) -> tuple[Lstm, list[tuple[int, float, float]]]:
    """(model, history of (epoch, train_loss, valid_loss)); stops after `patience` epochs without a lower validation loss and keeps the best.

    Without validation rows all epochs are run and the last state is kept. Steps by Adam, the gradient's norm at most 1.
    """
    model = Lstm.start(x.shape[2], units, seed)
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(w) for w in model.w] for _ in range(2))
    loss = lambda x, y: float(np.mean((model.predict(x) - y) ** 2)) if len(y) else float("nan")
    best, at, kept, step, history = float("inf"), 0, model.w, 0, []
    for epoch in range(1, epochs + 1):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            rows = order[a : a + BATCH]
            keep = (rng.random((len(rows), units)) >= dropout) / (1 - dropout)
            guess, held = model.forward(x[rows], keep)
            grads = model.gradients(x[rows], held, guess - y[rows])
            norm = np.sqrt(sum((g**2).sum() for g in grads))
            step += 1
            for k, g in enumerate(grads):
                g = g / max(norm, 1.0)
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g**2
                model.w[k] = model.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        history.append((epoch, loss(x, y), loss(xv, yv)))
        if history[-1][2] < best:
            best, at, kept = history[-1][2], epoch, list(model.w)
        if len(yv) and epoch - at >= patience:
            break
    return Lstm(kept) if at else model, history


def arrays(rows: pd.DataFrame, lookback: int) -> np.ndarray:
    """The last `lookback` steps of the sequences of rows, as (rows, steps, inputs)."""
    if not len(rows):
        return np.zeros((0, lookback, 1))
    return np.stack([np.stack([np.asarray(s, float) for s in q[-lookback:]]) for q in rows["sequence"]])


def fit(samples: dict[int, tuple[pd.DataFrame, pd.DataFrame]], tasks: Sequence[tuple[int, dict, int]], spark: SparkSession) -> list[tuple[Lstm, list]]:
    """(model, history) for every (horizon, parameters, epochs), each fitted by a task of its own.

    samples: by horizon the train and the validation rows (sequence, scaled_target), bounded samples both.
    """
    longest = max(p["lookback"] for _, p, _ in tasks)
    held = {h: tuple(v for s in pair for v in (arrays(s, longest), s["scaled_target"].to_numpy(float))) for h, pair in samples.items()}
    sent = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for no, horizon, params, epochs in pdf.itertuples(index=False):
                p, (x, y, xv, yv) = json.loads(params), sent.value[horizon]
                model, history = train(x[:, -p["lookback"] :], y, xv[:, -p["lookback"] :], yv, p["units"], p["dropout"], epochs)
                out.append((no, model.dump(), json.dumps(history)))
            yield pd.DataFrame(out, columns=["no", "model", "history"])

    rows = spark.createDataFrame([(i, h, json.dumps(p), e) for i, (h, p, e) in enumerate(tasks)], "no int, horizon int, params string, epochs int")
    found = rows.repartition(len(tasks), "no").mapInPandas(run, "no int, model string, history string").collect()  # as many as tasks
    return [(Lstm.parse(r["model"]), json.loads(r["history"])) for r in sorted(found, key=lambda r: r["no"])]


def predict(df: DataFrame, models: dict[str, tuple[Lstm, int]]) -> DataFrame:
    """df (with sequence, mean and scale of the target) without these, once per named (model, lookback): y_pred in tokens, never below 0."""
    keep = [c for c in df.columns if c not in ("sequence", "mean", "scale")]
    sent = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, (model, lookback) in sent.value.items():
                y = model.predict(arrays(pdf, lookback)) if len(pdf) else np.zeros(0)
                yield pdf[keep].assign(model=name, y_pred=np.maximum(y * pdf["scale"].to_numpy(float) + pdf["mean"].to_numpy(float), 0))

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in keep)
    return df.mapInPandas(run, f"{schema}, model string, y_pred double")


def history_table(histories: dict[tuple[int, int], list], spark: SparkSession) -> DataFrame:
    """(horizon, candidate, epoch, train_loss, valid_loss): one row per epoch of every fit."""
    rows = [(h, k, int(e), float(a), float(b)) for (h, k), history in histories.items() for e, a, b in history]
    return spark.createDataFrame(rows, "horizon int, candidate int, epoch int, train_loss double, valid_loss double").withColumn("valid_loss", F.when(~F.isnan("valid_loss"), F.col("valid_loss")))
