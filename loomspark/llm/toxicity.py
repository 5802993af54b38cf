"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades 0 to 3: P(grade <= k) = logistic(theta_k - w.x), with one weight vector w for all of the ordered thresholds.
The score is the expected severity, the sum of P(grade > k); a document is rejected when P(grade > 0) reaches
`reject_at`.

Features are binary: a word occurs; the words that begin with a prefix of 3 to 7 letters occur at least 1, 2, 3 or 5
times, or at least twice and at least once in every 50, 100, 200 or 400 words. The training rows are at most
`max_rows` labelled documents, those with the smallest hash of their id, which is the documented bound on the sample;
of their features the `max_features` that tell the labels apart best (by the z-score of the log odds) are used. The
labels say only toxic or not, so the grades of the toxic rows follow how many strongly toxic features they hold, by
thirds. Selection and counts are Spark aggregations; the driver gets the chosen features of the sample's rows, whose
size the two bounds limit, and fits the model. All documents are scored in whole, in Python tasks without a shuffle.

Defined results: null and empty texts have no features and the grade of the thresholds alone, which is 0 for labels
with fewer toxic rows than others. Without labelled rows of both kinds nothing is rejected (severity 0). Labels that
are null are not used; documents labelled more than once count once, as toxic if any label says so. Repeated rows are
scored alike; other columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import small_batches, whole_row, written

MAX_ROWS, MAX_FEATURES, MIN_ROWS = 8000, 3000, 4
GRADES, STRONG_Z, PENALTY, STEPS, REJECT_AT = 4, 6.0, 0.1, 400, 0.5
#: A text can have thousands of features, so those of so many texts are held and handed on at a time.
FEATURE_ROWS = 64
#: A worker remembers so many words' bases, some 10 MB.
CACHE_WORDS = 60_000
PREFIXES, COUNTS, RATES = range(3, 8), (1, 2, 3, 5), (50, 100, 200, 400)
_letters = re.compile(r"[^\W\d_]+").findall


def _prefix_features(prefix: str, n: int, words: int) -> list[str]:
    return [f"{prefix}*{k}" for k in COUNTS if n >= k] + [f"{prefix}*/{d}" for d in RATES if n >= 2 and n * d >= words]


def features(text: str | None) -> set[str]:
    """All features of a text."""
    words = Counter(_letters(text.lower())) if text else Counter()
    out, prefixes, total = set(words), Counter(), sum(words.values())
    for word, n in words.items():
        for k in PREFIXES:
            if len(word) > k:
                prefixes[word[:k]] += n
    for prefix, n in prefixes.items():
        out.update(_prefix_features(prefix, n, total))
    return out


def feature_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches (h, toxic, text) -> (h, toxic, f), f being the features of each text."""
    for batch in batches:
        for at in range(0, len(batch), FEATURE_ROWS):
            b = batch.iloc[at : at + FEATURE_ROWS]
            yield pd.DataFrame({"h": b["h"], "toxic": b["toxic"], "f": [sorted(features(t)) for t in b["text"]]})


class _Bases(dict):
    """For a word, which of the model's words and prefixes it holds; a bounded cache."""

    def __init__(self, known: set[str]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(b for b in (word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)) if b in self.known)
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = found
        return found


class OrdinalModel:
    """Weights of the features and the ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.array(thresholds)
        self._bases = None

    def raw(self, text: str | None) -> float:
        """w.x; only words and prefixes that the model knows are counted."""
        if not text or not self.weights:
            return 0.0
        if self._bases is None:
            self._bases = _Bases({re.sub(r"\*.*", "*", f) for f in self.weights})
        words, bases, prefixes, total = Counter(_letters(text.lower())), self._bases, Counter(), 0.0
        for word, n in words.items():
            for base in bases[word]:
                if base[-1] == "*":
                    prefixes[base] += n
                else:
                    total += self.weights[base]
        if prefixes:
            length = words.total()
            for base, n in prefixes.items():
                for f in _prefix_features(base[:-1], n, length):
                    total += self.weights.get(f, 0.0)
        return total

    def exceeding(self, raw: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - raw[:, None], -35, 35)))


def fit_ordinal(columns: np.ndarray, rows: np.ndarray, grades: np.ndarray, n_features: int, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalized likelihood; the thresholds' gaps stay positive."""
    n, w, a = len(grades), np.zeros(n_features), np.array([2.0] + [0.7] * (GRADES - 2))
    moments = [np.zeros_like(v) for v in (w, w, a, a)]
    for it in range(1, steps + 1):
        raw = np.bincount(rows, w[columns], minlength=n)
        theta = np.cumsum(np.r_[a[0], np.exp(a[1:])])
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - raw[:, None], -35, 35)))
        below = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        up, low = below[np.arange(n), grades + 1], below[np.arange(n), grades]
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g_raw = (d_up - d_low) / n
        g_w = np.bincount(columns, g_raw[rows], minlength=n_features) + penalty * w / n
        g_theta = np.array([d_low[grades == k + 1].sum() - d_up[grades == k].sum() for k in range(GRADES - 1)]) / n
        g_a = np.r_[g_theta.sum(), [g_theta[k:].sum() * math.exp(a[k]) for k in range(1, GRADES - 1)]]
        for v, g, m, s in ((w, g_w, moments[0], moments[1]), (a, g_a, moments[2], moments[3])):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= 0.05 * (m / (1 - 0.9**it)) / (np.sqrt(s / (1 - 0.999**it)) + 1e-9)
    return w, np.cumsum(np.r_[a[0], np.exp(a[1:])])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """docs (doc_id, text) and labels (doc_id, toxic) -> the model."""
    never = OrdinalModel({}, [35.0] * (GRADES - 1))
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = written(marked.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows).select(F.col("doc_id").alias("id"), "h", "toxic"), "toxicity-sample")

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("at"), "text").join(sample, F.col("at") == F.col("id"))
    texts = texts.groupBy("id", "h", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of an id's texts one
    rows = written(texts.select("h", "toxic", "text").mapInPandas(feature_lists, "h long, toxic int, f array<string>"), "toxicity-features")
    n1, n0 = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n1 or not n0:
        return never
    counts = rows.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") + F.col("b") >= MIN_ROWS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
    z = odds / F.sqrt(1 / a + 1 / b + 1 / (n1 + 1 - a) + 1 / (n0 + 1 - b))
    best = counts.select("f", z.alias("z")).orderBy(F.abs("z").desc(), "f").limit(max_features).collect()  # bounded
    if not best:
        return never
    index = {r["f"]: i for i, r in enumerate(best)}
    strong = {i for i, r in enumerate(best) if r["z"] > STRONG_Z}

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "toxic": b["toxic"], "x": [[index[f] for f in fs if f in index] for fs in b["f"]]})

    got = rows.mapInPandas(chosen, "h long, toxic int, x array<int>").orderBy("h").toPandas()  # at most max_rows
    toxic = got["toxic"].to_numpy()
    severity = np.array([sum(i in strong for i in x) for x in got["x"]])
    cuts = np.quantile(severity[toxic == 1], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grades = np.where(toxic == 1, 1 + sum((severity > c).astype(int) for c in cuts), 0)
    sizes = np.array([len(x) for x in got["x"]])
    columns = np.concatenate([np.asarray(x, dtype=np.int64) for x in got["x"]])
    w, theta = fit_ordinal(columns, np.repeat(np.arange(len(got)), sizes), grades, len(best))
    return OrdinalModel({r["f"]: float(w[i]) for i, r in enumerate(best)}, theta.tolist())


def scored(text: Column, model: OrdinalModel) -> Column:
    """For each text a struct of severity (expected grade), p_toxic and grade (the most likely one)."""

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            over = model.exceeding(np.array([model.raw(t) for t in texts], dtype=float))
            each = -np.diff(np.hstack([np.ones((len(over), 1)), over, np.zeros((len(over), 1))]), axis=1)
            yield pd.DataFrame({"severity": over.sum(axis=1), "p_toxic": over[:, 0], "grade": each.argmax(axis=1).astype(np.int32)})

    return score(text)


def grade_documents(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT, text_col: str = "text", model: OrdinalModel | None = None) -> DataFrame:
    """Every row of docs, as `row`, with severity, p_toxic, grade and rejected."""
    small_batches(docs.sparkSession)
    model = model or fit(docs.select("doc_id", F.col(f"`{text_col}`").alias("text")), labels)
    rows = docs.select(whole_row(docs)).withColumn("s", scored(F.col(f"row.`{text_col}`"), model))
    return rows.select("row", "s.severity", "s.p_toxic", "s.grade", (F.col("s.p_toxic") >= reject_at).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of docs that aren't rejected."""
    return grade_documents(docs, labels, reject_at).where(~F.col("rejected")).select("row.*")
