"""Quality classifier by positive-unlabelled learning.

A linear model over byte-class bigrams and a few repetition figures minimises the non-negative unbiased risk
    prior * E+[loss(f)] + max(0, E_unlabelled[loss(-f)] - prior * E+[loss(-f)])
with trusted positives (rows labelled of good quality) and unlabelled web text. Negative labels are used for one
number only: the class prior, estimated as the share of positives among labelled training rows.

The model is fitted on a bounded sample (POSITIVES and UNLABELLED rows with the smallest hash of their id), whose
features are made on the executors. Scores are made in one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, give_back, map_arrow, slices, spread, table, texts

#: At most so many trusted positives and unlabelled rows are fitted on.
POSITIVES, UNLABELLED = 6000, 12_000
HELD_OUT_OF, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Words in a row over which the local repetition figures are taken.
SPAN = 50


def _classes() -> np.ndarray:
    """The class of each byte: lower, upper, digit, blank, line end, sentence and inner marks, other marks, high bytes."""
    out = np.full(256, 10, np.uint8)
    for k, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".?", ",;:", "!", "|", "'\"-()")):
        out[list(members.encode())] = k
    out[0x80:0xC0] = 11  # bytes inside a character
    out[0xC0:] = 12
    return out


CLASSES = _classes()
N_CLASSES = 13
N_FEATURES = N_CLASSES * N_CLASSES + 10


def features(text: str) -> np.ndarray:
    """All zero for an empty text. Every feature is bounded, whatever the length of the text."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    c = CLASSES[np.frombuffer(text.encode(), np.uint8)].astype(np.int32)
    if len(c) > 1:
        out[: N_CLASSES * N_CLASSES] = np.sqrt(np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES * N_CLASSES) / (len(c) - 1))
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if n:
        same = list(map(eq, words, words[1:]))
        parts = [words[i : i + SPAN] for i in range(0, n, SPAN)]
        fresh = [len(set(p)) / len(p) for p in parts if len(p) == SPAN] or [len(set(words)) / n]
        upper = sum(map(str.isupper, words)) / n
        out[-10:] = (
            np.log1p(n) / 12, len(set(words)) / n, sum(same) / n, np.sqrt(sum(same) / n), min(fresh), sum(fresh) / len(fresh), upper,
            np.sqrt(upper), min(len(text) / n, 40) / 40, len({x for x in lines if x}) / max(1, sum(map(bool, lines))),
        )
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for features as they are. Without positives everything scores the prior."""
    width = positive.shape[1] if positive.ndim == 2 else N_FEATURES
    if not len(positive) or not len(unlabelled):
        return np.zeros(width), float(np.log(prior / (1 - prior)))
    every = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, std = every.mean(0), every.std(0) + 1e-3
    p, u = (positive - mean) / std, (unlabelled - mean) / std
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1):
        fp, fu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        down = -sigmoid(-fp) / len(p) * prior  # of the positive part
        up_u, up_p = sigmoid(fu) / len(u), -prior * sigmoid(fp) / len(p)  # of the negative part
        if negative >= 0:
            gp, gu = down + up_p, up_u
        else:  # the estimate went below what a risk can be: step back out of it
            gp, gu = -up_p, -up_u
        g = np.append(p.T @ gp + u.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w / std, float(b - (w / std) @ mean)


def held_out(column="doc_id", of: int = HELD_OUT_OF, part: int = HELD_OUT):
    """Whether crc32 of the id as text leaves this remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of == part, F.lit(False))


def feature_rows(docs: DataFrame, *more: str) -> DataFrame:
    """x: the features' bytes, as the driver holds lists of numbers at several times their size; and other columns."""

    def run(batches):
        for b in slices(batches, "text"):
            yield {"x": [features(t or "").tobytes() for t in b.column("text").to_pylist()], **{c: b.column(c) for c in more}}

    return map_arrow(docs.select("text", *more), run, "x binary" + "".join(f", {c} int" for c in more))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """Labels of held-out rows are never read; an id with several labels counts with its smallest, null labels don't count."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    prior = min(0.98, max(0.02, 0.5 if share is None else share))
    mixed = F.xxhash64("doc_id", F.lit("quality"))
    trusted = known.filter("quality = 1").orderBy(mixed, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("side"))
    web = texts(docs).filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    others = web.orderBy(mixed, "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("side"))
    # at most positives + unlabelled ids
    rows = texts(docs).join(F.broadcast(trusted.unionByName(others)), "doc_id")
    got = feature_rows(rows.dropDuplicates(["doc_id", "side"]), "side").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).astype(np.float64).reshape(len(got), N_FEATURES)
    side = got["side"].to_numpy() if len(got) else np.zeros(0, int)
    positive, mixture = x[side == 1], x[side == 0]
    del got, x, rows
    model = fit(positive, mixture, prior)
    del positive, mixture
    give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, *more: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    A null text scores as an empty one. Repeated rows and ids each give their own row; a null id stays null and isn't
    held out. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    w, bias = model
    w = np.asarray(w, np.float64)

    def run(batches):
        for b in slices(batches, "text"):
            x = np.stack([features(t or "") for t in b.column("text").to_pylist()])
            s = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
            yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_arrow(texts(docs, held_out().alias("held_out")), run, "doc_id bigint, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    w, bias = model
    w = np.asarray(w, np.float64)

    def keep(batches):
        try:
            for part in slices(batches, "text"):
                x = np.stack([features(t or "") for t in part.column("text").to_pylist()])
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) >= threshold))
        finally:
            give_back()

    bounded(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


ORACLE_SQL = None  # a fitted model can't be said in SQL
