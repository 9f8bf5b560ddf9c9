"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are folded to lower case, anything else to one gap; 1- to 3-grams are hashed into
``BUCKETS``. Document frequencies cover all training rows; the weights are fitted by
follow-the-regularised-leader (FTRL-proximal, elastic net) on a bounded sample (``PER_LANG`` rows of
each language, fewer where that would be more than ``SAMPLE_ROWS`` in all, two at least) and calibrated
by one temperature on the part of the sample held out for it. Every language that occurs is learned.

Defined results: null texts and texts without a letter are ``und`` with score 0; if nothing can be
learned every text is ``und``; rows with a null language teach nothing; rows of equal id and text teach
once, rows that share an id but not a text are rows of their own; ties go to the language that sorts first;
texts of any length are read whole; an empty table gives none; extra columns pass.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import append_columns
from papyrine.llm.sampling import text_sample

BUCKETS = 1 << 15
PER_LANG = 400
SAMPLE_ROWS = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
_FOLD: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Code point -> lower-case letter's code point, 0 for anything that is no letter."""
    if not _FOLD:
        _FOLD.append(np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32))
    return _FOLD[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text's n-grams; empty without a letter."""
    a = _folded()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not a.any():
        return np.zeros(0, np.int64), np.zeros(0)
    # Runs of gaps count as one; a gap on either side marks where words begin and end.
    a = np.concatenate((np.zeros(1, np.uint32), a, np.zeros(1, np.uint32)))
    a = a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]
    shift = np.uint32(17)
    one = a[a != 0] * np.uint32(2654435761)
    two = (a[:-1] * np.uint32(40503) + a[1:]) * np.uint32(2246822519)
    three = ((a[:-2] * np.uint32(40503) + a[1:-1]) * np.uint32(40503) + a[2:]) * np.uint32(3266489917)
    counts = np.bincount(np.concatenate((one >> shift, two >> shift, three >> shift)), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


@dataclass
class LangModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[at]
        return x / max(1e-12, float(np.sqrt((x * x).sum())))

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = gram_counts(text)
        if not len(at) or not self.langs:
            return "und", 0.0
        p = _softmax(self.vector(at, counts) @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Per-coordinate FTRL-proximal with L1 and L2; returns BUCKETS x classes weights, mostly zero."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS))


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_lang: int = PER_LANG) -> LangModel:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = gram_counts(text)
                total[at] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array([-1, *at.tolist()], pa.int32()), "v": pa.array([n, *total[at].tolist()], pa.int64())})

    counted = dict(rows.select("text").mapInArrow(frequencies, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect())
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    n = counted.get(-1) or 0
    idf = np.full(BUCKETS, np.log(n + 1.0) + 1)
    for k, v in counted.items():
        if k >= 0:
            idf[k] = np.log((n + 1) / (v + 1)) + 1
    model = LangModel(langs, idf, np.zeros((BUCKETS, len(langs))), 1.0)
    if not langs:
        return model

    def make():
        def run(texts):
            got = [gram_counts(t) for t in texts]
            return {"at": [a.tolist() for a, _ in got], "counts": [c.tolist() for _, c in got]}

        return run

    order = F.xxhash64(F.lit("langid"), "id", "text")
    picked = text_sample(rows, "lang", order, max(2, min(per_lang, SAMPLE_ROWS // len(langs)))).dropDuplicates(["id", "text"])
    fields = [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))]
    sample = append_columns(picked.withColumn("h", order), make, fields).select("id", "h", "lang", "at", "counts").orderBy("id", "h").collect()
    sample = [r for r in sample if r["at"]]
    if not sample:
        return LangModel([], idf, model.weights, 1.0)
    xs = [(np.array(r["at"]), model.vector(np.array(r["at"]), np.array(r["counts"], float))) for r in sample]
    y = np.array([langs.index(r["lang"]) for r in sample])
    hold = np.zeros(len(y), bool)  # every fifth row of a language; a language of fewer is fitted on all it has
    for lang in range(len(langs)):
        hold[np.flatnonzero(y == lang)[4::5]] = True
    model.weights = ftrl([x for x, h in zip(xs, hold, strict=True) if not h], y[~hold], len(langs))
    logits = np.array([x @ model.weights[at] for at, x in xs])
    kept = hold if hold.any() else ~hold
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 80))
    loss = [-np.log(np.maximum(_softmax(logits[kept] / t)[np.arange(kept.sum()), y[kept]], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """Append lang_pred and score for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def make():
        def run(texts):
            got = [shared.value.predict(t) for t in texts]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return run

    return append_columns(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], text_col)
