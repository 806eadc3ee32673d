"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are put in lower case and their character 1- to 4-grams hashed into ``buckets`` counts. Training sums counts
per language and bucket on the executors; the matrix of log probabilities, whose size is languages x
buckets and checked, is broadcast. Scoring adds up, per text, the columns of its n-grams: a gather and a
segmented sum per batch in numpy.

Training takes a bounded sample: rows whose hashed id falls below a threshold that lets through about
``train_rows`` of the labelled rows; tables with fewer rows are used whole. A tenth of the sample, ``SCALE_ROWS`` at most, isn't counted but
sets the scale of the scores, which is the likeliest one for its labels.

Cases. Null text, or one without a letter: ``und``, score 0. No labelled row at all: ``und`` for every text.
Null labels don't train. Repeated rows count again in training and get equal predictions. Extra columns are
ignored by ``identify`` and pass through ``keep_identified``. Very long texts are batches of their own, cut into overlapping windows whose sums are
those of the uncut text. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, map_frames, mix64, own_name, slices, text_function

UNKNOWN = "und"
BUCKETS, ORDERS, TRAIN_ROWS, MODEL_MB = 1 << 15, (1, 2, 3, 4), 20_000, 256
#: Characters whose n-grams are counted at once; labelled rows that set the scores' scale.
WINDOW, SCALE_ROWS = 1 << 18, 2_000
#: Of fewer labelled rows none is set aside, and the scale is ``DEFAULT_SCALE``.
LEAST_ASIDE, DEFAULT_SCALE = 200, 20.0
_LETTER = regex.compile(r"\p{L}")
_U = np.uint64


def gram_codes(texts: list[str], buckets: int, orders: tuple[int, ...], lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each n-gram of the texts, taken as they are, that ends after the first ``lead`` characters of its text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    fresh = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= lead
    whose, which = [], []
    code = np.zeros(len(points), np.uint64)
    for n in range(1, max(orders, default=0) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        code = code[:size] * _U(0x9E3779B97F4A7C15) + points[n - 1 :] + _U(1)
        if n in orders:
            inside = (owner[:size] == owner[n - 1 :]) & fresh[n - 1 :]
            whose.append(owner[:size][inside])
            which.append((mix64(code[inside] + _U(n)) % _U(buckets)).astype(np.int32))
    if not whose:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(whose), np.concatenate(which)


def grams(texts: list[str], buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, lower: bool = True, most: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each n-gram of the texts, each set between two spaces and put in lower case if asked, in parts of bounded size.

    A long text comes in windows that overlap by the longest n-gram less one character, so that each of its n-grams is in one of them.
    """
    overlap = max(orders, default=1) - 1
    for lo, hi in slices(np.array([len(t) for t in texts]), most):
        own = [f" {t.lower() if lower else t} " for t in texts[lo:hi]]
        if len(own) > 1 or len(own[0]) <= most:
            whose, which = gram_codes(own, buckets, orders)
            yield whose + lo, which
            continue
        for at in range(0, len(own[0]), most):
            lead = min(at, overlap)
            whose, which = gram_codes([own[0][at - lead : at + most]], buckets, orders, lead)
            yield whose + lo, which


def sampled(df: DataFrame, id_col: str, rows: int, n: int) -> DataFrame:
    """About ``rows`` of the n rows of ``df``, chosen by the hash of an id; all of them if there are no more."""
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * rows / n))


class Model:
    """Log probabilities by language and bucket, and the scale of scores.

    A text's language is the one of the largest posterior. As neighbouring n-grams say much the same, the posterior itself is next to 1 for nearly any
    text; the score takes the mean over the text's n-grams instead of the sum, times ``scale``.
    """

    def __init__(self, languages: list[str], log_p: np.ndarray, prior: np.ndarray, orders: tuple[int, ...], scale: float = DEFAULT_SCALE):
        self.languages, self.log_p, self.prior, self.orders, self.scale = languages, log_p, prior, orders, scale

    def means(self, texts: list[str]) -> np.ndarray:
        """(texts x languages): the log posterior, up to a constant, a n-gram."""
        total, n = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts))
        for whose, which in grams(texts, self.log_p.shape[1], self.orders):
            n += np.bincount(whose, minlength=len(texts))
            for k, row in enumerate(self.log_p):
                total[:, k] += np.bincount(whose, row[which], len(texts))
        return total / np.maximum(1, n)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not lettered or not self.languages:
            return names, scores
        mean = self.means([texts[i] for i in lettered])
        best = mean.argmax(axis=1)
        share = 1.0 / np.exp(self.scale * (mean - mean.max(axis=1, keepdims=True))).sum(axis=1)
        for i, b, s in zip(lettered, best, share, strict=True):
            names[i], scores[i] = self.languages[b], float(s)
        return names, scores


def fitted_scale(means: np.ndarray, label: np.ndarray) -> float:
    """The scale under which the labels are likeliest, from 1 to 1000; targets are smoothed, so that labels without an error don't ask for the largest."""
    if not len(means) or means.shape[1] < 2:
        return DEFAULT_SCALE
    rest = 1 / (len(means) + 2)
    target = np.full(means.shape, rest / (means.shape[1] - 1))
    target[np.arange(len(means)), label] = 1 - rest
    apart = means - means.max(axis=1, keepdims=True)

    def gain(scale: float) -> float:
        return float((target * (scale * apart - np.log(np.exp(scale * apart).sum(axis=1, keepdims=True)))).sum())

    return max(np.geomspace(1, 1000, 91).tolist(), key=gain)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, train_rows: int = TRAIN_ROWS, alpha: float = 0.1) -> Model:
    """A model from the rows of ``labelled`` that have a text and a label; see the module for the sample."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for pdf in frames:
            for name, own in pdf.groupby("lang")["text"]:
                docs[name] = docs.get(name, 0) + len(own)
                for _, which in grams(own.tolist(), buckets, orders):
                    counts[name] = counts.get(name, 0) + np.bincount(which, minlength=buckets)
        for name, row in counts.items():
            used = np.flatnonzero(row)
            yield pd.DataFrame({"lang": name, "bucket": np.append(used, -1), "n": np.append(row[used], docs[name])})

    usable = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    stated = labelled.select(F.col(f"`{label_col}`").cast("string").alias("lang")).where("lang is not null").groupBy("lang").count()
    kinds, n = stated.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if kinds * buckets * 8 > MODEL_MB << 20:
        raise ValueError(f"{kinds} labels x {buckets} buckets exceed {MODEL_MB} MB; use fewer buckets")
    few = sampled(usable, "id", train_rows, n)
    aside = F.lit(False) if n < LEAST_ASIDE else F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(10)) == 0
    counted = map_frames(few.where(~aside).select("text", "lang"), count, "lang string, bucket int, n long", "text")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    table, docs = np.zeros((len(languages), buckets)), np.ones(len(languages))
    at, bucket = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), got["bucket"].to_numpy(int)
    docs[at[bucket < 0]] = got["n"].to_numpy()[bucket < 0]
    table[at[bucket >= 0], bucket[bucket >= 0]] = got["n"].to_numpy()[bucket >= 0]
    log_p = np.log((table + alpha) / (table.sum(axis=1, keepdims=True) + alpha * buckets))
    model = Model(languages, log_p, np.log(docs / docs.sum()), orders)
    if len(languages) > 1 and n >= LEAST_ASIDE:
        model.scale = _scale_of(model, sampled(few.where(aside), "id", SCALE_ROWS, min(n, train_rows) // 10))
    return model


def _scale_of(model: Model, rows: DataFrame) -> float:
    """The scale fitted to labelled rows that the counts haven't seen; only their means come to the driver."""
    spark, languages = rows.sparkSession, model.languages
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Model = pickle.loads(shared.value)
        for pdf in frames:
            lettered = pdf[pdf["text"].map(lambda t: bool(_LETTER.search(t))) & pdf["lang"].isin(languages)]
            if len(lettered):
                yield pd.DataFrame({"id": lettered["id"], "lang": lettered["lang"], "mean": list(own.means(lettered["text"].tolist()))})

    got = map_frames(rows.select(F.col("id").cast("string").alias("id"), "text", "lang"), run, "id string, lang string, mean array<double>", "text").toPandas()
    if not len(got):
        return fitted_scale(np.empty((0, len(languages))), np.empty(0, int))
    got = got.sort_values(["id", "lang"], kind="stable")
    return fitted_scale(np.stack(got["mean"].to_numpy()), got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int))


def identifier(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function from texts to (lang_pred, score), with the model broadcast."""
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    def step() -> Callable[[list[str | None]], list]:
        own: Model = pickle.loads(shared.value)
        return lambda texts: [{"lang_pred": n, "score": s} for n, s in zip(*own.predict(texts), strict=True)]

    return text_function(spark, step, "lang_pred string, score double")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), identifier(docs.sparkSession, model)(F.col(f"`{text_col}`")).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a known language, with all their columns.

    Texts without a letter, texts of no clear language (score below ``least``) and texts whose stated language is another go.
    """
    name = own_name(docs, "found")
    found = docs.withColumn(name, identifier(docs.sparkSession, model)(F.col(f"`{text_col}`")))
    pred, stated = F.col(f"{name}.lang_pred"), F.col(f"`{lang_col}`").cast("string")
    return found.where((pred != UNKNOWN) & (F.col(f"{name}.score") >= least) & (stated.isNull() | (stated == pred))).drop(name)


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves aside: a fifth, by the checksum of the id as text."""
    return crc_of_id(doc_id) % 5 == 0
