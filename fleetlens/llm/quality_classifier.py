"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x). The weights w over hashed text features are shared by all grades and the
thresholds are ordered, so a text gets an expected grade and the probability of reaching a grade. Features are the
presence of words and of their beginnings (4 and 5 bytes), and ranges of a few shares (symbols, capitals, distinct
words, repeated lines, length); L1 shrinkage leaves weights only where the ratings bear them out.

The model is fitted on a sample of at most ``max_rows`` rated documents, those with the smallest hash of their id;
the weights, 2^18 numbers, are what scoring broadcasts. Everything is scored over whole texts.

Defined results: a NULL text is scored like an empty one; ratings that are NULL, or whose id is NULL or has no
document, are left out; of several ratings of an id each counts, on the id's smallest text if it has several. Without any rating every grade is equally likely.
Repeated and NULL ids are scored like any other row. Empty tables give empty results.
"""

from __future__ import annotations


from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import FOLD, as_bytes

BUCKETS = 1 << 18
STYLE = 16  # ranges of each share
SHARES = 7
MAX_ROWS = 8000
SIGNS = b"#*$%&|<>!=_~^@{}[]\\"
CAPITALS = bytes(range(65, 91))
SCORE = "struct<expected_grade:double,tail_probability:double>"


def features(text: bytes) -> np.ndarray:
    """Distinct feature numbers of a text."""
    words = text.translate(FOLD).split()
    kinds = set(words)
    parts = kinds | {b"\x01" + w[:4] for w in kinds} | {b"\x02" + w[:5] for w in kinds}
    digest = xxhash.xxh3_64_intdigest
    hashed = np.unique(np.fromiter((digest(p) & (BUCKETS - 1) for p in parts), np.int32, len(parts)))
    size, n = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    lettered = len(text.translate(None, CAPITALS))
    shares = (
        8 * (len(text) - len(text.translate(None, SIGNS))) / size, 4 * (len(text) - lettered) / size, len(kinds) / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log2(n) / STYLE, len(text) / n / 24, text.count(b"|") * 4 / n,
    )
    style = [BUCKETS + i * STYLE + min(STYLE - 1, int(STYLE * min(1.0, s))) for i, s in enumerate(shares)]
    return np.concatenate((hashed, np.array(style, np.int32)))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def feature_column(text: pa.Array) -> pa.Array:
    return pa.array([features(t or b"") for t in as_bytes(text)], pa.list_(pa.int32()))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ordered; one fewer than the grades

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) per text and threshold."""
        scores = np.array([self.weights[features(t)].sum() for t in texts])
        return 1 - _logistic(self.thresholds[None, :] - scores[:, None]) if len(texts) else np.zeros((0, len(self.thresholds)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 40, rate: float = 0.15, shrink: float = 2e-4, least_docs: int = 4, batch: int = 256) -> OrdinalModel:
    """Weights and thresholds by AdaGrad with proximal L1 steps; the same rows give the same model."""
    top = BUCKETS + SHARES * STYLE
    share = (np.bincount(grades, minlength=n_grades) + 1) / (len(grades) + n_grades)
    below = np.cumsum(share)[:-1]
    first = np.log(below / (1 - below))
    if not rows or len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(top), first)
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    wide = np.bincount(flat, minlength=top) >= least_docs
    number = np.cumsum(wide) - 1
    owner = np.repeat(np.arange(len(rows)), sizes)[wide[flat]]
    columns = number[flat[wide[flat]]]
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
    w, seen = np.zeros(int(wide.sum())), np.full(int(wide.sum()), 1e-6)
    low, gaps = first[0], np.log(np.maximum(np.diff(first), 1e-3))
    seen_t = np.full(len(first), 1e-6)
    order = np.random.default_rng(0)
    for epoch in range(epochs):
        for chosen in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            at = [columns[bounds[i] : bounds[i + 1]] for i in chosen]
            cols, n = np.concatenate(at), np.array([len(a) for a in at])
            mine = np.repeat(np.arange(len(chosen)), n)
            scores = np.bincount(mine, w[cols], len(chosen))
            cuts = np.concatenate(([-np.inf], low + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))), [np.inf]))
            y = grades[chosen]
            upper, lower = _logistic(cuts[y + 1] - scores), _logistic(cuts[y] - scores)
            upper[y == n_grades - 1], lower[y == 0] = 1.0, 0.0
            slope = (1 - upper - lower) / len(chosen)
            g = np.bincount(cols, slope[mine], len(w))
            seen += g * g
            step = rate / np.sqrt(seen)
            moved = w - step * g
            w = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
            inside = np.maximum(upper - lower, 1e-9) * len(chosen)
            gt = np.zeros(n_grades - 1)
            np.add.at(gt, y[y < n_grades - 1], -(upper * (1 - upper) / inside)[y < n_grades - 1])
            np.add.at(gt, y[y > 0] - 1, (lower * (1 - lower) / inside)[y > 0])
            seen_t += gt * gt
            pull = rate / np.sqrt(seen_t)
            low -= pull[0] * gt.sum()
            gaps = gaps - pull[1:] * np.array([gt[k + 1 :].sum() for k in range(len(gaps))]) * np.exp(gaps)
    weights = np.zeros(top)
    weights[wide] = w
    return OrdinalModel(weights, low + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", n_grades: int = 3, max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Fit on at most ``max_rows`` of ``ratings`` (id, grade 0 to n_grades - 1)."""
    rated = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter("id IS NOT NULL AND grade IS NOT NULL")
    sample = rated.orderBy(F.xxhash64("id"), "grade").limit(max_rows)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.select("id")), "id", "left_semi")
    known = known.groupBy("id").agg(F.min("text").alias("text"))  # a repeated id is one text
    met = known.join(F.broadcast(sample), "id").select("id", "grade", feature_column("text").alias("f"))  # max_rows rows at most
    table = met.toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    rows = [np.asarray(x.values, np.int32) for x in table["f"].combine_chunks()] if len(table) else []
    return fit_ordinal(rows, table["grade"].to_numpy().astype(np.int64), n_grades)



def score(spark: SparkSession, model: OrdinalModel, text: Column, tail: int | None = None) -> Column:
    """Expected grade, and the probability of grade ``tail`` or better (the best grade by default)."""
    held = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    at = (len(model.thresholds) if tail is None else tail) - 1

    @F.arrow_udf(SCORE)
    def run(texts: pa.Array) -> pa.Array:
        above = OrdinalModel(*held.value).above([t or b"" for t in as_bytes(texts)])
        return pa.StructArray.from_arrays([pa.array(above.sum(1), pa.float64()), pa.array(above[:, at], pa.float64())], ["expected_grade", "tail_probability"])

    return run(text)


def classify(docs: DataFrame, model: OrdinalModel, text_col: str = "text", tail: int | None = None, score_col: str = "quality") -> DataFrame:
    """``docs`` with ``quality``: expected grade and tail probability."""
    return docs.withColumn(score_col, score(docs.sparkSession, model, F.col(text_col), tail))
