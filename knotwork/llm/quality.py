"""Quality scores: naive Bayes support vectors over character n-gram indicators.

A text's features are which hashed character 1- and 2-grams it holds, and one for about how many those are. Each indicator is scaled by the log ratio of its
smoothed frequency among good and bad documents, each text's vector by its length, and a linear model with
hinge loss is fitted by dual coordinate descent (Wang and Manning 2012; Hsieh et al. 2008). A
logistic curve fitted to the margins of a fifth of the sample, which the model doesn't see, turns
margins into scores between 0 and 1.

The fit runs on the driver over a bounded sample (``train_rows`` labelled documents, chosen by hashed id; the
sparse indicators, not the texts, come to the driver). Scoring runs on all rows with the weights broadcast;
their number is fixed (``DIMS``).

Cases. Null and empty texts: scored as texts without words, so all alike. Labels that are null are left
out; a document with several labels takes the smallest. Labels of one kind only, or none: every score is
that label's, or 0.5. Repeated rows get equal scores. Extra columns are ignored by ``score`` and pass through ``keep_good``. Very long texts are
cut into overlapping windows, which have the uncut text's indicators. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, map_frames, own_name, text_function
from .langid import WINDOW, grams, sampled

DIMS, ORDERS, TRAIN_ROWS, COST = 1 << 18, (1, 2), 8_000, 0.1
#: Features for the number of others.
COUNTS = 64
THRESHOLD = 0.7


def indicators(texts: list[str | None], dims: int = DIMS, orders: tuple[int, ...] = ORDERS, most: int = WINDOW) -> list[np.ndarray]:
    """The sorted distinct features of each text; the last one stands for their number, on a scale of half powers of two."""
    hashed, rows = dims - COUNTS, [t or "" for t in texts]
    found = [np.empty(0, np.int32) for _ in rows]
    for whose, which in grams(rows, hashed, orders, lower=False, most=most):
        if not len(whose):
            continue
        both = np.unique(whose * np.int64(hashed) + which)
        lo, hi = int(both[0] // hashed), int(both[-1] // hashed) + 1
        bounds = np.searchsorted(both, np.arange(lo, hi + 1) * np.int64(hashed))
        for row in range(lo, hi):
            own = (both[bounds[row - lo] : bounds[row - lo + 1]] % hashed).astype(np.int32)
            found[row] = own if not len(found[row]) else np.union1d(found[row], own)
    return [np.append(x, np.int32(hashed + int(2 * np.log2(len(x) + 1)))) for x in found]


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, dims: int, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, dims), alpha)
    for r, g in zip(rows, good, strict=True):
        counts[int(g), r] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, dims: int, cost: float, rounds: int = 60, tolerance: float = 0.05) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the hinge loss, ``cost`` a row, with an L2 penalty; ends when all projected gradients are small."""
    w, bias, alpha, sign = np.zeros(dims), 0.0, np.zeros(len(rows)), np.where(good, 1.0, -1.0)
    norm = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i], values[i]
            slope = sign[i] * (w[at] @ v + bias) - 1
            if (alpha[i] == 0 and slope >= 0) or (alpha[i] == cost and slope <= 0):
                continue
            worst = max(worst, abs(slope))
            moved = min(cost, max(0.0, alpha[i] - slope / norm[i])) - alpha[i]
            alpha[i] += moved
            w[at] += moved * sign[i] * v
            bias += moved * sign[i]
        if worst < tolerance:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = np.array([[(s * margins * margins).sum() + 1e-6, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """Weights of indicators (log ratio times hinge weight), the ratios for scaling, and the score curve."""

    def __init__(self, weights: np.ndarray, ratio: np.ndarray, bias: float, curve: tuple[float, float]):
        self.weights, self.squares, self.bias, self.curve = weights.astype(np.float32), (ratio * ratio).astype(np.float32), bias, curve

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum(dtype=float) / np.sqrt(self.squares[row].sum(dtype=float) + 1e-12) + self.bias)

    def score(self, texts: list[str | None]) -> np.ndarray:
        margins = np.array([self.margin(r) for r in indicators(texts, len(self.weights))])
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margins + self.curve[1], -35, 35)))


def fit(rows: list[np.ndarray], good: np.ndarray, dims: int = DIMS, cost: float = COST) -> Model:
    """A model from indicator rows and their labels; every fifth row only serves the score curve."""
    good = np.asarray(good, bool)
    if len(set(good.tolist())) < 2:
        level = 0.0 if not len(good) else 5.0 if good[0] else -5.0
        return Model(np.zeros(dims), np.zeros(dims), 0.0, (0.0, level))
    aside = np.arange(len(rows)) % 5 == 4
    if len(set(good[~aside].tolist())) < 2 or len(set(good[aside].tolist())) < 2:
        aside[:] = False
    use = np.flatnonzero(~aside)
    own = [rows[i] for i in use]
    ratio = log_count_ratio(own, good[use], dims)
    values = [(ratio[r] / np.sqrt((ratio[r] ** 2).sum() + 1e-12)).astype(np.float32) for r in own]
    w, bias = dual_coordinate_descent(own, values, good[use], dims, cost)
    model = Model(w * ratio, ratio, bias, (1.0, 0.0))
    test = np.flatnonzero(aside) if aside.any() else use
    model.curve = logistic_curve(np.array([model.margin(rows[i]) for i in test]), good[test])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the documents that ``labels`` marks 1 or 0; see the module for the sample."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "good": pdf["good"], "row": [r.tobytes() for r in indicators(pdf["text"].tolist())]})

    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("q")).where("id is not null and q is not null").groupBy("id").agg((F.min("q") > 0).alias("good"))
    few = sampled(marks, "id", train_rows, marks.count())
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = texts.join(F.broadcast(few), "id").select(F.col("id").cast("string").alias("id"), "good", "text")
    got = map_frames(known, run, "id string, good boolean, row binary", "text").toPandas().sort_values(["id", "row"], kind="stable")
    return fit([np.frombuffer(r, np.int32) for r in got["row"]], got["good"].to_numpy(bool))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function from texts to scores, with the model broadcast."""
    shared = spark.sparkContext.broadcast((model.weights, model.squares, model.bias, model.curve))

    def step() -> Callable[[list[str | None]], list]:
        own = Model.__new__(Model)
        own.weights, own.squares, own.bias, own.curve = shared.value
        return lambda texts: own.score(texts).tolist()

    return text_function(spark, step, "double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of each row."""
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), scorer(docs.sparkSession, model)(F.col(f"`{text_col}`")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    name = own_name(docs, "score")
    scored = docs.withColumn(name, scorer(docs.sparkSession, model)(F.col(f"`{text_col}`")))
    return scored.where(F.col(name) >= threshold).drop(name)


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves aside: a quarter, by the checksum of the id as text."""
    return crc_of_id(doc_id) % 4 == 2
