"""Toxicity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batched
from .sampling import sample

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows for fitting, at most, and characters of the longest of them.
ROWS, LONGEST = 4000, 20_000
#: Grades: 0 clean, 1 to 3 by how many different telling words a toxic text has.
GRADES = 4
#: Sampled texts that a feature must occur in.
LEAST = 4
#: Texts of this expected severity or more are rejected.
REJECT = 0.5


def features(text: str | None, known: dict[str, float] | None = None) -> Counter:
    """Counts of the text's words and of their first four and five letters (marked ^), where `known` has them."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        for x in (w, "^" + w[:4], "^" + w[:5]) if len(w) > 5 else (w, "^" + w[:4]) if len(w) == 5 else (w,):
            if known is None or x in known:
                out[x] += n
    return out


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w . x - t[k]), t ascending: one weight vector for all thresholds. x holds log(1 + count) of the features with a weight."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 20.0))

    def severity(self, text: str | None) -> float:
        """Expected grade, 0 to GRADES - 1: the sum of P(grade > k)."""
        w = self.weights
        z = sum(w[x] * math.log1p(n) for x, n in features(text, w).items())
        return float((1 / (1 + np.exp(-np.clip(z - self.thresholds, -30, 30)))).sum())

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], rounds: int = 400, ridge: float = 0.02) -> OrdinalModel:
        """Labels say toxic or not; grades follow from how many telling words (by smoothed log odds) a toxic text holds."""
        bags = [features(t) for t, _ in rows]
        y = np.array([v for _, v in rows])
        if len(set(y.tolist())) < 2:
            return cls()
        # toxic texts carry their words in few places: features are chosen by their odds between the classes
        n1, n0 = int((y == 1).sum()), int((y == 0).sum())
        df1, df0 = Counter(), Counter()
        for b, v in zip(bags, y):
            (df1 if v else df0).update(b.keys())
        vocab = {}
        for x in df1.keys() | df0.keys():
            a, b = df1[x], df0[x]
            if a + b >= LEAST:
                pa_, pb = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
                z = np.log(pa_ / (1 - pa_)) - np.log(pb / (1 - pb))
                if abs(z) > 2.58 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) and abs(z) > 1:
                    vocab[x] = z
        names = sorted(vocab)
        at = {x: k for k, x in enumerate(names)}
        told = {x for x in names if vocab[x] > 1}
        grade = np.array([0 if not v else min(GRADES - 1, max(1, sum(x in told for x in b if x[0] != "^"))) for b, v in zip(bags, y)])
        cells = [(i, at[x], np.log1p(n)) for i, b in enumerate(bags) for x, n in b.items() if x in at]
        if not cells:
            return cls()
        r, c, v = (np.array(z) for z in zip(*cells))
        c = c.astype(int)
        above = (grade[:, None] > np.arange(GRADES - 1)).astype(float)
        w, base, gaps = np.zeros(len(names)), 0.0, np.zeros(GRADES - 2)
        par = np.concatenate([w, [base], gaps])
        m, s = np.zeros_like(par), np.zeros_like(par)
        for k in range(1, rounds + 1):
            w, t = par[: len(names)], par[len(names)] + np.concatenate([[0], np.cumsum(np.exp(par[len(names) + 1 :]))])
            z = np.bincount(r, weights=w[c] * v, minlength=len(y))
            d = (1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30))) - above) / len(y)
            gt = -d.sum(axis=0)
            tail = np.cumsum(gt[::-1])[::-1]
            g = np.concatenate([np.bincount(c, weights=d.sum(axis=1)[r] * v, minlength=len(names)) + ridge * w / len(y), [tail[0]], tail[1:] * np.exp(par[len(names) + 1 :])])
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            par = par - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-9)
        t = par[len(names)] + np.concatenate([[0], np.cumsum(np.exp(par[len(names) + 1 :]))])
        return cls({x: float(u) for x, u in zip(names, par) if abs(u) > 1e-3}, t)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> OrdinalModel:
    return OrdinalModel.fit(sample(docs, labels, "toxic", rows, longest))


def with_severity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", name: str = "severity") -> DataFrame:
    """docs with the expected severity of the whole text; null and empty texts have what the thresholds alone say."""

    def run(batches):
        for b in batches:
            got = pa.array([model.severity(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))], type=pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, name])

    return batched(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, grade, toxic) per document: severity is the expected grade. Null and empty texts get what the thresholds alone say; rows of null or repeated ids are returned each; extra columns are ignored.

    Labels say toxic or not. So only the bound between grades 0 and 1 is measured against them; grades 1 to 3 count a toxic text's different telling words, an order that no label checks.

    Without labels of both kinds nothing is toxic.
    """
    out = with_severity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels)).drop("text")
    return out.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= REJECT).alias("toxic"))
