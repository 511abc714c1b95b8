"""Quality classifier from positive and unlabelled texts.

Trusted positives are the texts labelled 1 of the fitting folds; every text of those folds, whatever its
label, is unlabelled web text.  Steps, each over all rows:

1. One pass turns each whole text into a dense vector of shape statistics (character classes and their
   neighbours, word lengths, distinct words and word pairs, repeated lines); the vectors are stored once.
2. A positive-against-unlabelled logistic model is fitted on one fold; the class prior is estimated on the
   other fold from the share of unlabelled against positive scores above the best threshold (best-bin
   estimation), with its confidence term.
3. The non-negative unbiased risk  prior*E_p[l(f)] + max(0, E_u[l(-f)] - prior*E_p[l(-f)])  with logistic
   loss l and a ridge term is minimised by damped Newton steps.  Each step is one aggregate over the stored
   vectors; only sums of the size of the model reach the driver.  Where the second term is negative, the step
   goes against its gradient, as the non-negative estimator asks.

Labels, language, source and id are no inputs of a score.  Only rows whose fold (crc32 of the id's text,
modulo 3) is not 1 are learnt from; a row without id counts as held out.

Cases: null and empty text have the vector of the empty text and get a score.  An id with conflicting
labels is no trusted positive.  Without any positive or any fitting row every score is 0.5.  Repeated rows
each count.  Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HELD_OUT, PRIOR_FOLD = 1, 2   # folds: 0 fits the prior's model, 2 estimates the prior, both fit the classifier
RIDGE = 1e-3
STEPS, PRIOR_STEPS = 12, 5    # Newton steps at most
TOLERANCE = 1e-5
BINS = 1000                   # score bins of the prior estimate
DELTA = 0.1                   # its confidence

# character classes of bytes: lower, upper, digit, blank, newline, sentence marks, other marks, non-ASCII
CLASSES = np.full(256, 7, np.int64)
CLASSES[:128] = 6
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 0, 1, 2
CLASSES[[9, 11, 12, 13, 32]], CLASSES[10] = 3, 4
CLASSES[[ord(c) for c in ".,;:'\"-()?"]] = 5
N_SHAPE, N_PAIRS = 16, 64
N_FEATURES = N_SHAPE + N_PAIRS


def features(text: str) -> np.ndarray:
    data = text.encode("utf-8", "replace")
    out = np.zeros(N_FEATURES, np.float32)
    codes = CLASSES[np.frombuffer(data, np.uint8)]
    if len(codes) > 1:
        out[N_SHAPE:] = np.sqrt(np.bincount(codes[:-1] * 8 + codes[1:], minlength=64) / (len(codes) - 1))
    words = data.split()
    n = len(words)
    if not n:
        out[0] = 1.0
        return out
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    counts = np.bincount(seq)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    sizes = lengths[seq]
    pairs = len(np.unique(seq[:-1] * len(ids) + seq[1:])) if n > 1 else 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = counts / n
    shares = np.bincount(codes, minlength=8) / len(codes)
    out[1] = math.log1p(n) / 10
    out[2] = sizes.mean() / 10
    out[3] = sizes.std() / 10
    out[4] = math.log1p(len(ids)) / math.log1p(n)
    out[5] = math.log1p(pairs) / math.log1p(max(n - 1, 1))
    out[6] = counts.max() / n
    out[7] = -(p * np.log(p)).sum() / math.log(n + 1)
    out[8] = 1 - len(set(lines)) / len(lines)
    out[9] = math.log1p(n / len(lines)) / 5
    out[10:15] = shares[[0, 1, 2, 6, 7]]
    out[15] = pairs / max(n - 1, 1)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Model:
    """Linear score on standardised features; the last weight is the bias."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]


def matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def sums(rows: DataFrame, width: int, part) -> np.ndarray:
    """Sum over all rows of ``part(x, positive)``; tasks send one vector each, which Spark adds up."""
    schema = pa.schema([("v", pa.list_(pa.float64()))])

    def run(batches):
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += part(matrix(b.column("x")), np.asarray(b.column("positive"), bool))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], schema=schema)

    parts = rows.select("x", "positive").mapInArrow(run, "v array<double>")
    got = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # width rows
    total = np.zeros(width)
    for r in got:
        total[r["i"]] = r["v"]
    return total


def standardise(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Mean and scale of the features over all rows, and how many rows and positives there are."""
    d = N_FEATURES
    s = sums(rows, 2 * d + 2, lambda x, p: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), p.sum()]]))
    n, n_pos = s[-2:]
    mean = s[:d] / max(n, 1)
    spread = np.sqrt(np.maximum(s[d:2 * d] / max(n, 1) - mean ** 2, 0))
    return mean, np.where(spread > 1e-6, spread, 1.0), n, n_pos


def fit_against_unlabelled(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, steps: int = PRIOR_STEPS) -> np.ndarray:
    """Logistic model of positives against all rows, both classes with the same weight."""
    d = N_FEATURES + 1
    w = np.zeros(d)
    for _ in range(steps):
        def part(x, p, w=w):
            z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            s = sigmoid(z @ w)
            curve = s * (1 - s)
            out = []
            for keep, slope in ((p, s - 1), (np.ones(len(p), bool), s)):
                out += [z[keep].T @ slope[keep], ((z[keep] * curve[keep, None]).T @ z[keep]).ravel(), [keep.sum()]]
            return np.concatenate(out)

        s = sums(rows, 2 * (d + d * d + 1), part)
        half = d + d * d + 1
        grad, curve = RIDGE * w, RIDGE * np.eye(d)
        for v in (s[:half], s[half:]):
            grad = grad + v[:d] / max(v[-1], 1)
            curve = curve + v[d:-1].reshape(d, d) / max(v[-1], 1)
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w


def estimate_prior(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> float:
    """Best-bin estimate of the share of positives among all rows."""
    def part(x, p):
        at = np.minimum((sigmoid((x - mean) / scale @ w[:-1] + w[-1]) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[p], minlength=BINS)]).astype(float)

    s = sums(rows, 2 * BINS, part)
    u, p = s[:BINS], s[BINS:]
    if not u.sum() or not p.sum():
        return 0.5
    above_u, above_p = np.cumsum(u[::-1]) / u.sum(), np.cumsum(p[::-1]) / p.sum()
    slack = math.sqrt(math.log(4 / DELTA) / (2 * u.sum())) + math.sqrt(math.log(4 / DELTA) / (2 * p.sum()))
    seen = above_p > 0
    best = np.argmin((above_u[seen] + slack) / above_p[seen])
    return float(np.clip(above_u[seen][best] / above_p[seen][best], 0.01, 0.99))


def fit_non_negative(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk."""
    d = N_FEATURES + 1
    w, best, best_risk, step, damping = np.zeros(d), np.zeros(d), math.inf, None, 1.0
    for _ in range(steps):
        def part(x, p, w=w):
            z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            f = z @ w
            s = sigmoid(f)
            curve = s * (1 - s)
            zp, fp, sp, cp = z[p], f[p], s[p], curve[p]
            return np.concatenate([
                zp.T @ (sp - 1), zp.T @ sp, z.T @ s,                                   # slopes of l(f) on P, l(-f) on P and U
                ((zp * cp[:, None]).T @ zp).ravel(), ((z * curve[:, None]).T @ z).ravel(),  # curvature on P, U
                [softplus(-fp).sum(), softplus(fp).sum(), softplus(f).sum(), p.sum(), len(p)]])

        s = sums(rows, 3 * d + 2 * d * d + 5, part)
        n_p, n_u = max(s[-2], 1), max(s[-1], 1)
        up, down_p, down_u = s[:d] / n_p, s[d:2 * d] / n_p, s[2 * d:3 * d] / n_u
        curve_p = s[3 * d:3 * d + d * d].reshape(d, d) / n_p
        curve_u = s[3 * d + d * d:3 * d + 2 * d * d].reshape(d, d) / n_u
        loss_up, loss_p, loss_u = s[-5] / n_p, s[-4] / n_p, s[-3] / n_u
        negative_part = loss_u - prior * loss_p
        ridge = RIDGE * np.append(w[:-1], 0)
        risk = prior * loss_up + max(0.0, negative_part) + ridge @ w / 2
        if risk > best_risk + 1e-9 and step is not None:  # went too far: half the step from the best point
            damping /= 2
            w = best - damping * step
            continue
        done = best_risk - risk < TOLERANCE
        best, best_risk = w, risk
        if done:
            break
        if negative_part >= 0:
            grad, curve = prior * up + down_u - prior * down_p + ridge, curve_u
        else:  # the estimate of the negative class's risk overfits: go back against its gradient
            grad, curve = -(down_u - prior * down_p), curve_u + prior * curve_p
        step = np.linalg.solve(curve + RIDGE * np.eye(d), grad)
        damping = 1.0
        w = best - step
    return best


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fold, x) of every row, stored once."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("x", pa.list_(pa.float32()))])
    ident = F.col(id_col).cast("long")
    rows = docs.select(ident.alias("doc_id"), F.coalesce(F.crc32(ident.cast("string")) % 3, F.lit(HELD_OUT)).cast("int").alias("fold"),
                       common.text_or_empty(text_col).alias("text"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack([features(t) for t in b.column("text").to_pylist()])
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fold"), x], schema=schema)

    return common.staged(rows.mapInArrow(run, "doc_id long, fold int, x array<float>"), "quality-features")


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """Fit on the stored vectors; None if there is nothing to learn from."""
    trusted = (labels.groupBy(F.col(id_col).cast("long").alias("doc_id"))
               .agg(F.min(label_col).alias("low"), F.max(label_col).alias("high")).filter("low = 1 and high = 1")
               .select("doc_id", F.lit(True).alias("positive")))
    rows = (table.filter(F.col("fold") != HELD_OUT).join(trusted, "doc_id", "left")
            .select("fold", "x", F.coalesce("positive", F.lit(False)).alias("positive")))
    rows = common.staged(rows, "quality-fit")
    mean, scale, n, n_pos = standardise(rows)
    if not n or not n_pos:
        return None
    first = fit_against_unlabelled(rows.filter(F.col("fold") != PRIOR_FOLD), mean, scale)
    prior = estimate_prior(rows.filter(F.col("fold") == PRIOR_FOLD), mean, scale, first)
    return Model(mean, scale, fit_non_negative(rows, mean, scale, prior), prior)


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every stored vector."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = np.full(b.num_rows, 0.5) if model is None else sigmoid(model.margin(matrix(b.column("x"))))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.asarray(b.column("fold")) == HELD_OUT),
                                                  pa.array(np.round(s, 9))], schema=schema)

    return table.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    table = feature_table(docs, id_col, text_col)
    return score(table, fit(table, labels, id_col))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score is at least 0.5, all columns unchanged."""
    common.small_batches(docs.sparkSession)
    model = fit(feature_table(docs, id_col, text_col), labels, id_col)
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack([features(t or "") for t in b.column(at).to_pylist()]).astype(np.float64)
                yield b.filter(pa.array(np.round(sigmoid(model.margin(x)), 9) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, as ``labels.quality`` marks it."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
