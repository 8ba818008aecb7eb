"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Staged, cut, remainder

#: Statistics of a text, each taken from all of it.
FEATURES = ("log_words", "word_length", "upper", "digits", "stops", "symbols", "bangs", "bars", "high", "distinct", "repeated_lines", "line_words", "top_word", "doubled")
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{}~[]", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text: logs of lengths, and logarithms of one plus rates per hundred words or letters.

    Rates are over a few more words and letters than there are, so that one telephone number in a line of five words weighs
    little.  Null and empty texts have all rates 0.
    """
    b = (text or "").encode()
    h = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    words = b.split()
    n, letters = len(words) + 8, int(h[65:91].sum() + h[97:123].sum() + h[128:].sum()) + 40
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    rate = lambda k, per: float(np.log1p(100.0 * k / per))
    return [
        float(np.log1p(len(words))),
        float(np.log1p(sum(map(len, words)) / max(1, len(words)))),
        rate(h[65:91].sum(), letters),
        rate(h[48:58].sum(), letters),
        rate(h[46] + h[44] + h[63] + h[58] + h[59], n),
        rate(h[_SYMBOLS].sum(), n),
        rate(h[33], n),
        rate(h[124], n),
        rate(h[128:].sum(), letters),
        rate(len(seen), n),
        rate(len(lines) - len(set(lines)), max(1, len(lines))),
        float(np.log1p(len(words) / max(1, len(lines)))),
        rate(max(seen.values(), default=0), n),
        rate(sum(map(bytes.__eq__, words, words[1:])), n),
    ]


def _features(batches):
    for b in cut(batches):
        x = np.array([statistics(t) for t in b.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of each whole text, a row for each row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_features, "doc_id long, x array<double>")


def _moments(d: int):
    def run(batches):
        s = {}
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, d)
            y = np.array(b.column("y").to_pylist(), np.int64)
            for k in (0, 1):
                z = np.hstack([np.ones(((y == k).sum(), 1)), x[y == k]])
                s[k] = s.get(k, 0) + z.T @ z
        rows = [(k, i, float(v)) for k, m in s.items() for i, v in enumerate(m.ravel())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["y", "i", "v"])

    return run


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes with their shrunk covariances' Cholesky factors: small arrays, closed over by the scoring tasks."""

    prior: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray  # of each Cholesky factor
    log_det: np.ndarray
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row, from the difference of the Mahalanobis log-densities."""
        ll = [np.log(self.prior[k]) - 0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(1) - self.log_det[k] for k in (0, 1)]
        z = np.clip((ll[1] - ll[0]) / self.temper, -700, 700)
        return 1 / (1 + np.exp(-z))


def fit(examples: DataFrame, d: int = len(FEATURES), shrink: float = 0.1, floor: float = 0.1, temper: float = 2.0) -> Discriminant:
    """Fit on all rows (x array<double>, y 0 or 1): exact moments summed over the cluster; only 2 (d + 1)^2 sums reach the driver.

    Each class covariance is drawn towards the diagonal of the pooled one by ``shrink``, and variances are at least ``floor``;
    ``temper`` divides the log-density difference, since statistics of one text are not independent.
    A class without rows takes the other's place with prior 0.5, so that scores stay defined; without any row all score 0.5.
    """
    sums = examples.select("x", F.col("y").cast("int").alias("y")).mapInArrow(_moments(d), "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    m = np.zeros((2, (d + 1) ** 2))
    for r in sums.collect():
        m[r["y"], r["i"]] = r["v"]
    m = m.reshape(2, d + 1, d + 1)
    n = m[:, 0, 0]
    if not n.all():
        m[n == 0] = m[n > 0][0] if n.any() else np.eye(d + 1)
    prior = n / n.sum() if n.all() else np.array([0.5, 0.5])
    n = m[:, 0, 0]
    mean = m[:, 0, 1:] / n[:, None]
    cov = m[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = np.maximum(np.einsum("k,kii->i", n / n.sum(), cov), floor)
    inverse, log_det = [], []
    for k in (0, 1):
        c = (1 - shrink) * cov[k] + shrink * np.diag(pooled) + floor * np.eye(d)
        low = np.linalg.cholesky((c + c.T) / 2)
        inverse.append(np.linalg.inv(low))
        log_det.append(np.log(np.diag(low)).sum())
    return Discriminant(prior, mean, np.array(inverse), np.array(log_det), temper)


def _scored(model: Discriminant, threshold: float):
    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score(feats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for rows (doc_id, x)."""
    return feats.mapInArrow(_scored(model, threshold), "doc_id long, score double, predicted int")


def training_rows(feats: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(x, y) of the labelled documents outside the held-out fold.  Null and other labels than 0 and 1 are left out."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    return feats.where(remainder("doc_id", folds) != 0).join(y, "doc_id").select("x", "y")


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> tuple[DataFrame, Discriminant]:
    """Score all documents with a model fitted on the labelled ones outside the held-out fold; texts are read once.

    Null and empty texts have statistics and a score like others; null doc_ids are in no fold and match no label.  Several
    labels of one doc_id are examples each; repeated rows are scored row by row.  An empty table gives no rows; without
    labels all scores are 0.5.
    """
    feats = Staged(features(documents), "features").df
    model = fit(training_rows(feats, labels, folds))
    return score(feats, model, threshold), model


def _kept(model: Discriminant, threshold: float):
    def run(batches):
        for b in cut(batches):
            x = np.array([statistics(t) for t in b.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return run


def keep(documents: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """The documents with a score of ``threshold`` or more, all columns as they are, in one pass without a shuffle."""
    return documents.withColumn("text", F.col("text").cast("string")).mapInArrow(_kept(model, threshold), documents.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls, empties, repeated rows and missing labels as in classify()."""
    scored, _ = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
