"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= j | x) = sigmoid(t_j - w x): all ordered thresholds t_1 < t_2 < ...
share the weights w of the hashed words that a text has. The model is fitted by
proximal gradient steps with momentum on a bounded sample of labelled documents
(``SAMPLE``, those with the least hash of doc_id). Scores of a text are the
probability of each grade, the expected grade, and P(grade >= 1).

Labels that only say toxic or not are graded first: a toxic document's grade is 2
if it has more words that mark toxic documents than the median toxic document,
else 1. Marks are words seen in ``LEAST_DOCS`` sampled documents or more, nine in
ten of them toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelvinlake.llm._arrays import handing_back, row_of, slices, word_hashes

BITS = 20
SAMPLE = 12_000
LEAST_DOCS = 4
GRADES = 3
#: P(grade >= 1) from which a document is rejected; set on held-out labels, where 0.3
#: caught a few hundredths more toxic documents than 0.5 at as many false ones.
REJECT = 0.3


@dataclass(frozen=True)
class SeverityModel:
    weights: np.ndarray  # 2 ** BITS
    thresholds: np.ndarray  # ascending, grades - 1

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -60, 60)))


def distinct_features(texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row offsets) of each text's distinct hashed words."""
    words, off = word_hashes(texts)
    feature = (words >> np.uint64(64 - BITS)).astype(np.int64)
    row = row_of(off)
    if keep is not None:
        chosen = keep[feature]
        feature, row = feature[chosen], row[chosen]
    both = np.unique(row << BITS | feature)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(off)))


def grade(toxic: np.ndarray, feature: np.ndarray, off: np.ndarray, least: int = LEAST_DOCS) -> np.ndarray:
    """Grades 0..2 of documents labelled 0 or 1."""
    row = row_of(off)
    seen = np.bincount(feature, minlength=1 << BITS)
    bad = np.bincount(feature[toxic[row] > 0], minlength=1 << BITS)
    mark = (seen >= least) & (bad >= 0.9 * seen)
    marks = np.bincount(row[mark[feature]], minlength=len(toxic))
    middle = np.median(marks[toxic > 0]) if (toxic > 0).any() else 0
    return np.where(toxic > 0, 1 + (marks > middle), 0)


def fit(
    grades: np.ndarray, feature: np.ndarray, off: np.ndarray, *, count: int = GRADES, least: int = LEAST_DOCS,
    least_z: float = 2.5, l1: float = 1e-4, steps: int = 300,
) -> SeverityModel:
    """Maximum likelihood with an absolute penalty on the weights."""
    n, row = len(grades), row_of(off)
    seen = np.bincount(feature, minlength=1 << BITS)
    names, column = np.unique(feature[seen[feature] >= least], return_inverse=True)
    row = row[seen[feature] >= least]
    w, t = np.zeros(len(names)), np.linspace(0.5, 0.5 + count - 2, count - 1)
    bad = int((grades > 0).sum())
    share = np.full(n, 1 / n)
    # a column's value is its log ratio between toxic and clean documents, 0 where
    # chance explains the difference: few columns are left to learn from few labels
    in_bad = np.bincount(column, (grades > 0)[row], len(names))
    in_all = np.bincount(column, minlength=len(names))
    ratio = np.log((in_bad + 0.5) / (bad + 1)) - np.log((in_all - in_bad + 0.5) / (n - bad + 1))
    spread = np.sqrt(np.maximum(in_all / n * (1 - in_all / n), 1e-12) * (1 / max(bad, 1) + 1 / max(n - bad, 1)))
    z = (in_bad / max(bad, 1) - (in_all - in_bad) / max(n - bad, 1)) / spread
    value = np.where(np.abs(z) >= least_z, ratio, 0)
    rate = np.zeros(len(names)) + 1e-8
    rate_t = 1e-8
    for _ in range(steps):
        score = np.bincount(row, (w * value)[column], n)
        # with shared weights the likelihood is that of P(grade = g) = P(> g - 1) - P(> g)
        s = 1 / (1 + np.exp(np.clip(t[None] - score[:, None], -60, 60)))
        s = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], 1)
        p = np.maximum(s[np.arange(n), grades] - s[np.arange(n), grades + 1], 1e-12)
        d = s * (1 - s)
        by_score = share * (d[np.arange(n), grades] - d[np.arange(n), grades + 1]) / p
        g_t = np.zeros(count - 1)
        for j in range(count - 1):
            g_t[j] = np.sum(share * d[:, j + 1] / p * ((grades == j).astype(float) - (grades == j + 1)))
        g_w = np.bincount(column, by_score[row], len(names)) * value
        rate += g_w**2
        rate_t = rate_t + g_t**2
        step = 0.3 / np.sqrt(rate)
        w = w + step * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        t = np.sort(t + 0.3 / np.sqrt(rate_t) * g_t)
    out = np.zeros(1 << BITS, np.float32)
    out[names] = w * value
    return SeverityModel(out, t)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> SeverityModel:
    """Fits on ``sample`` labelled documents at most (doc_id, toxic). A null label,
    doc_id or text counts as unlabelled; of repeated labels the least counts."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    spark = docs.sparkSession
    rows = chosen.collect()  # ``sample`` rows at most
    if not rows:
        return SeverityModel(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, 60.0))
    chosen = F.broadcast(spark.createDataFrame(rows, chosen.schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                feature, off = distinct_features(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), lists], ["doc_id", "toxic", "features"]
                )

    got = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(chosen, "doc_id")
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
        .mapInArrow(handing_back(run), "doc_id long, toxic int, features array<int>")
        .dropDuplicates(["doc_id"])
        .toArrow()
        .sort_by("doc_id")
    )
    lists = got.column("features").combine_chunks()
    # copies of one document must not make its rare words look like marks
    alike: dict[bytes, int] = {}
    sets = [np.asarray(x, np.int64) for x in lists.to_numpy(zero_copy_only=False)]
    for i, x in enumerate(sets):
        alike.setdefault(x.tobytes(), i)
    keep = sorted(alike.values())
    toxic = (got.column("toxic").to_numpy()[keep] > 0).astype(np.int64)
    sets = [sets[i] for i in keep]
    if not sets:
        return SeverityModel(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, 60.0))
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    feature = np.concatenate(sets)
    return fit(grade(toxic, feature, off), feature, off)


def score_severity(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """``docs`` with the added columns expected_severity, p_toxic, grade.

    ``grade`` is the most likely one; the least wins ties. A null or empty text has
    no features and is scored by the thresholds alone. Columns of ``docs`` pass
    through (ones with the added names are replaced); repeated rows score alike.
    """
    base = docs.drop("expected_severity", "p_toxic", "grade")
    names = base.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    schema = T.StructType(
        [
            *base.schema.fields,
            T.StructField("expected_severity", T.DoubleType()),
            T.StructField("p_toxic", T.DoubleType()),
            T.StructField("grade", T.IntegerType()),
        ]
    )

    def run(batches):
        weights, thresholds = shared.value
        model, used = SeverityModel(weights, thresholds), weights != 0
        for batch in batches:
            for part in slices(batch, "text"):
                feature, off = distinct_features(part.column("text"), used)
                score = np.bincount(row_of(off), weights[feature], part.num_rows)
                over = model.at_least(score)
                each = np.diff(np.concatenate([np.zeros((len(score), 1)), 1 - over, np.ones((len(score), 1))], 1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(n) for n in names],
                        pa.array(over.sum(1)),
                        pa.array(over[:, 0]),
                        pa.array(each.argmax(1).astype(np.int32)),
                    ],
                    [*names, "expected_severity", "p_toxic", "grade"],
                )

    return base.mapInArrow(handing_back(run), schema)
