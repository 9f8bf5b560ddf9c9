"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics. Class means and covariances come from
sums over all labelled training rows (one partial row per task, so nothing is sampled), are shrunk
towards the pooled diagonal, and are factorised once (Cholesky). The score is the logistic of the
difference of the Mahalanobis log-densities.

Defined results: null and empty texts have the statistics of an empty text and are scored like any
other; texts of any length are described whole; rows of equal text get equal scores; rows whose label is
null teach nothing, rows that share an id share its label, repeated rows and labels count as often as they
occur; without both labels every score is 0.5; an empty table gives none; extra columns pass.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import append_columns

SHRINK = 0.15
RIDGE = 1e-3
#: Byte classes, fixed: common prose punctuation; every other printable ASCII sign counts as a symbol.
PROSE_SIGNS = b".,;:'\"-?()"
NAMES = ("words", "word_length", "symbols", "shouts", "upper", "digits", "distinct_words", "repeats", "distinct_lines", "prose_signs", "line_length")


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode()
    n = len(raw) + 1
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    prose = int(at[list(PROSE_SIGNS)].sum())
    digits, upper = int(at[48:58].sum()), int(at[65:91].sum())
    shouts = int(at[33])
    symbols = int(at[33:48].sum() + at[58:65].sum() + at[91:97].sum() + at[123:127].sum()) - prose - shouts
    words = text.split()
    m = len(words)
    lines = text.split("\n")
    return [
        np.log1p(m),
        np.log1p(sum(map(len, words)) / max(1, m)),
        np.log(symbols / n + 1e-3),
        np.log(shouts / n + 1e-3),
        np.log(upper / n + 1e-2),
        np.log(digits / n + 1e-2),
        len(set(words)) / max(1, m),
        np.log(sum(map(eq, words, words[1:])) / max(1, m) + 1e-2),
        len(set(lines)) / len(lines),
        np.log(prose / n + 1e-2),
        np.log1p(len(text) / len(lines)),
    ]


@dataclass
class QdaModel:
    """Log priors, means and Cholesky factors of the two classes, in standardised coordinates."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 0.5)
        z = (x - self.centre) / self.scale
        density = []
        for mean, inverse, offset in zip(self.means, self.factors, self.offsets, strict=True):
            density.append(offset - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def describe(docs: DataFrame, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    """Append the statistics of every whole text."""

    def make():
        return lambda texts: {out_col: [[float(x) for x in statistics(t)] for t in texts]}

    return append_columns(docs, make, [T.StructField(out_col, T.ArrayType(T.DoubleType()))], text_col)


def fit(described: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", shrink: float = SHRINK) -> QdaModel:
    """Class sums over every labelled row; only the short statistics are joined to the labels, never the texts."""
    rows = described.select(id_col, "stats").join(labels.select(id_col, label).filter(F.col(label).isin(0, 1)), id_col).select(F.col(label).cast("int").alias("y"), "stats")
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                part = x[y == c]
                if len(part):
                    n, s, q = total.get(c, (0, np.zeros(d), np.zeros((d, d))))
                    total[c] = (n + len(part), s + part.sum(0), q + part.T @ part)
        if total:
            rows = list(total.items())
            yield pa.RecordBatch.from_pydict({"y": [c for c, _ in rows], "n": [float(v[0]) for _, v in rows], "s": [[*v[1].tolist(), *v[2].ravel().tolist()] for _, v in rows]}, schema=pa.schema([("y", pa.int32()), ("n", pa.float64()), ("s", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(sums, "y int, n double, s array<double>")
    long = parts.select("y", "n", F.posexplode("s").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    got = {0: (0.0, np.zeros(d + d * d)), 1: (0.0, np.zeros(d + d * d))}
    for r in long.collect():  # 2 x (d + d^2) numbers
        got[r["y"]] = (r["n"], got[r["y"]][1])
        got[r["y"]][1][r["k"]] = r["v"]
    if min(got[0][0], got[1][0]) < 2:
        return QdaModel(np.zeros(d), np.ones(d), [], [], [])
    n_all = got[0][0] + got[1][0]
    moments = {c: (n, v[:d] / n, v[d:].reshape(d, d) / n) for c, (n, v) in got.items()}
    centre = sum(n * m for n, m, _ in moments.values()) / n_all
    within = sum(n * (np.diag(q) - m**2) for n, m, q in moments.values()) / n_all
    scale = np.sqrt(np.maximum(within, 1e-9))
    means, factors, offsets = [], [], []
    for c in (0, 1):
        n, m, q = moments[c]
        cov = (q - np.outer(m, m)) / np.outer(scale, scale)
        cov = (1 - shrink) * cov + (shrink + RIDGE) * np.eye(d)
        chol = np.linalg.cholesky(cov)
        means.append((m - centre) / scale)
        factors.append(np.linalg.inv(chol))
        offsets.append(float(np.log(n / n_all) - np.log(np.diag(chol)).sum()))
    return QdaModel(centre, scale, means, factors, offsets)


def score(described: DataFrame, model: QdaModel, out_col: str = "score") -> DataFrame:
    """Append the probability of label 1 to rows that ``describe`` has described."""
    shared = described.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def make():
        return lambda rows: {out_col: shared.value.scores(np.array(rows, float).reshape(-1, len(NAMES))).tolist()}

    return append_columns(described, make, [T.StructField(out_col, T.DoubleType())], "stats")
