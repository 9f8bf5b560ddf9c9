"""Toxicity severity by cumulative-link (proportional-odds) regression over sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector shared by all ordered thresholds. Features
are words and word prefixes, valued by how many distinct words of a text have them. The model is fitted on a bounded sample of
labelled rows (``PER_CLASS`` of each label); scoring is row-local over every whole text.

Labels hold 0 or 1. Three ordered grades come from them: 0 (label 0), and for label 1 grade 2 with at
least ``SEVERE_WORDS`` distinct words that speak for the label, else 1. Which words speak for it is
learned from the other half of the sample, so no text is graded by statistics it is part of. Output:
expected severity, 0 to 2.

Defined results: null and empty texts have no feature and get the severity of a featureless text; a
sample without both labels gives severity 0 everywhere; rows that share an id but not a text, null labels
and ids labelled in two ways teach nothing, repeated rows teach once; repeated rows and ties get equal
scores; texts of any length are scored whole; an empty table gives none; extra columns pass through.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import append_columns, materialise, release
from papyrine.llm.sampling import labelled_sample

PER_CLASS = 2500
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature enters the model if that share of the sampled texts has it (3 texts at least) and its
#: log-odds are that far from 0.
LEAST_SHARE, LEAST_ODDS = 0.003, 2.0
SEVERE_WORDS = 3
REJECT_AT = 0.5
CACHE_WORDS = 250_000
words_of = re.compile(r"\w+").findall


def word_features(word: str) -> list[str]:
    """The word itself and its proper prefixes."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def text_features(text: str | None) -> Counter[str]:
    """How many distinct words of a text have each feature."""
    return Counter(f for w in set(words_of((text or "").lower())) for f in word_features(w))


def weigh(count: int) -> float:
    """Value of a feature that ``count`` distinct words have."""
    return math.log2(1 + count)


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thetas: list[float]

    def severity(self, eta: float) -> float:
        """Expected grade: the sum over thresholds of P(grade > k)."""
        return sum(1 / (1 + math.exp(min(50.0, max(-50.0, t - eta)))) for t in self.thetas)


def fit_cumulative_link(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_features: int, steps: int = 600, l1: float = 2e-5, l2: float = 1e-4):
    """Accelerated proximal gradient on the mean negative log-likelihood; returns weights and ordered thresholds.

    The step follows from the largest curvature (power iteration), so frequent features settle first
    and rare ones stay small: an early stop that works as further shrinkage.
    """
    k, n = int(grades.max()), len(grades)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    value = np.concatenate(values) if values else np.zeros(0)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    # Columns are brought to like size, rare ones less so: that evens the curvature and still holds rare words back.
    scale = 1 / np.sqrt(np.bincount(flat, value**2, n_features) / n + 0.005)
    value = value * scale[flat]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    times = lambda w: np.bincount(owner, w[flat] * value, n)
    back = lambda e: np.bincount(flat, e[owner] * value, n_features)
    v, top = np.ones(n_features), 1.0
    for _ in range(20):
        v = back(times(v)) / n
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    # theta_k = first + the sum of the gaps before it; gaps stay positive by projection.
    share = [np.log(max(1e-3, (grades <= i).mean()) / max(1e-3, (grades > i).mean())) for i in range(k)]
    point = (np.zeros(n_features), np.concatenate((share[:1], np.maximum(np.diff(share), 0.1))))
    ahead, momentum, rate = point, 1.0, 1 / (0.25 * (top + k) + l2)
    for _ in range(steps):
        w, g = ahead
        theta, eta = np.cumsum(g), times(w)
        upper = np.where(grades < k, sig(theta[np.minimum(grades, k - 1)] - eta), 1.0)
        lower = np.where(grades > 0, sig(theta[np.maximum(grades - 1, 0)] - eta), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
        slope = np.bincount(np.minimum(grades, k - 1), -du, k) + np.bincount(np.maximum(grades - 1, 0), dl, k)
        w = w - rate * (back(du - dl) + l2 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        g = g - rate * np.cumsum(slope[::-1])[::-1]
        g[1:] = np.maximum(g[1:], 0.05)
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        pull = (momentum - 1) / after
        ahead = (w + pull * (w - point[0]), g + pull * (g - point[1]))
        point, momentum = (w, g), after
    return point[0] * scale, np.cumsum(point[1]).tolist()


def _odds(bad, good, n_bad: int, n_good: int):
    return F.log((bad + 0.5) / (n_bad + 1.0)) - F.log((good + 0.5) / (n_good + 1.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """One scan of the texts picks the sample; all else reads the sample."""
    sample = labelled_sample(docs, labels, label, [0, 1], per_class, "toxicity", id_col, text_col)
    sample = sample.select(F.col(id_col).alias("id"), F.col(label).alias("y"), F.pmod(F.xxhash64(F.lit("half"), id_col), F.lit(2)).cast("int").alias("half"), "text")

    def make():
        return lambda texts: {"features": [list(text_features(t)) for t in texts]}

    got = materialise(append_columns(sample, make, [T.StructField("features", T.ArrayType(T.StringType()))]), "toxicity_sample")
    sizes = {(r["y"], r["half"]): r["c"] for r in got.groupBy("y", "half").agg(F.count(F.lit(1)).alias("c")).collect()}
    n = lambda y, half=None: sum(c for (a, b), c in sizes.items() if a == y and half in (None, b))
    if not n(0) or not n(1):
        return OrdinalModel({}, [50.0, 51.0])
    seen = [F.count_if((F.col("y") == y) & (F.col("half") == h)).alias(f"c{y}{h}") for y in (0, 1) for h in (0, 1)]
    per = got.select("y", "half", F.explode("features").alias("f")).groupBy("f").agg(*seen)
    bad, good = F.col("c10") + F.col("c11"), F.col("c00") + F.col("c01")
    least = max(3, round(LEAST_SHARE * (n(0) + n(1))))
    per = per.withColumn("kept", (bad + good >= least) & (F.abs(_odds(bad, good, n(1), n(0))) >= LEAST_ODDS))
    for h in (0, 1):  # what half h says of the other one
        b, g = F.col(f"c1{h}"), F.col(f"c0{h}")
        per = per.withColumn(f"strong{h}", (b + g >= least / 2) & (_odds(b, g, n(1, h), n(0, h)) >= LEAST_ODDS))
    # Few features are that frequent and that telling: at most a text's features over LEAST_SHARE.
    told = per.filter("kept or strong0 or strong1").select("f", "kept", "strong0", "strong1").orderBy("f").collect()
    index = {f: i for i, f in enumerate(r["f"] for r in told if r["kept"])}
    strong = [frozenset(r["f"] for r in told if r[f"strong{h}"]) for h in (0, 1)]
    chosen = frozenset(index)

    def mark():
        def run(texts):
            words = [set(words_of((t or "").lower())) for t in texts]
            hits = {f"hits{h}": [sum(not strong[h].isdisjoint(word_features(w)) for w in ws) for ws in words] for h in (0, 1)}
            return hits | {"mine": [[{"f": f, "c": c} for f, c in text_features(t).items() if f in chosen] for t in texts]}

        return run

    mine = T.ArrayType(T.StructType([T.StructField("f", T.StringType()), T.StructField("c", T.IntegerType())]))
    fields = [*(T.StructField(f"hits{h}", T.LongType()) for h in (0, 1)), T.StructField("mine", mine)]
    small = append_columns(got.select("id", "y", "half", "text"), mark, fields).drop("text").orderBy("id").collect()
    release(got)
    found = [sorted((index[x["f"]], x["c"]) for x in r["mine"]) for r in small]
    grades = np.array([0 if r["y"] == 0 else 2 if r[f"hits{1 - r['half']}"] >= SEVERE_WORDS else 1 for r in small])
    if grades.max() < 2:
        grades[np.flatnonzero(grades == 1)[:1]] = 2
    rows = [np.array([i for i, _ in fs], np.int64) for fs in found]
    values = [np.array([weigh(c) for _, c in fs]) for fs in found]
    w, thetas = fit_cumulative_link(rows, values, grades, max(1, len(index)))
    return OrdinalModel({f: float(w[i]) for f, i in index.items() if w[i]}, thetas)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", out_col: str = "severity") -> DataFrame:
    """Append the expected severity of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the features that the sample keeps

    def make():
        model = shared.value
        weight = model.weights.get
        seen: dict[str, tuple[str, ...]] = {}

        def known(word: str) -> tuple[str, ...]:
            got = seen.get(word)
            if got is None:
                got = tuple(f for f in word_features(word) if f in model.weights)
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                if len(word) <= 64:
                    seen[word] = got
            return got

        def eta(text: str | None) -> float:
            present = Counter(f for fs in map(known, set(words_of((text or "").lower()))) for f in fs)
            return sum(sorted(weight(f) * weigh(c) for f, c in present.items()))

        return lambda texts: {out_col: [model.severity(eta(t)) for t in texts]}

    return append_columns(docs, make, [T.StructField(out_col, T.DoubleType())], text_col)


def is_rejected(severity):
    return severity >= F.lit(REJECT_AT)
