"""Toxicity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import only

#: Labelled documents of each grade to learn from, about.
PER_GRADE = 2000
#: Features that are kept, by chi-square.
FEATURES = 4000
#: Least chi-square of a feature.
CHI = 15.0

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str | None) -> set[bytes]:
    """The distinct lower-cased words of a text, and the first four bytes of the longer ones with a star."""
    words = set(text.encode("utf-8", "replace").translate(_LETTERS).split()) if text else set()
    return words | {w[:4] + b"*" for w in words if len(w) > 4}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """P(grade > k) = sigmoid(sum of weights - cuts[k]): one set of weights for all the increasing cuts."""

    weights: dict[bytes, float]
    cuts: np.ndarray

    def exceed(self, text: str | None) -> np.ndarray:
        get = self.weights.get
        return _sigmoid(sum(get(w, 0.0) for w in features(text)) - self.cuts)


def train(rows: list[tuple[str | None, int]], grades: int, epochs: int = 30, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> Model:
    """Fits (text, grade) rows by stochastic gradient descent with adaptive steps.

    The features are those of which presence speaks most for a grade above 0, by chi-square over all rows: in long texts, many weak
    signs of the contrary would outweigh a strong one. The cuts are kept
    in order as a first one and the logarithms of the steps between them.
    """
    sets = [features(t) for t, _ in rows]
    y = np.array([g for _, g in rows], np.int64)
    n1, n = int((y > 0).sum()), len(rows)
    start = np.array([np.log((sum(y <= k) + 1) / (sum(y > k) + 1)) for k in range(grades - 1)])
    start = np.maximum.accumulate(start + np.arange(grades - 1) * 1e-3)
    if not n1 or n1 == n:
        return Model({}, start)
    all_, high = Counter(), Counter()
    for s, g in zip(sets, y.tolist(), strict=True):
        all_.update(s)
        if g:
            high.update(s)

    def chi(w: bytes) -> float:
        a, c = high[w], all_[w]
        return n * (a * (n - c - n1 + a) - (c - a) * (n1 - a)) ** 2 / (c * (n - c) * n1 * (n - n1))

    kept = sorted(((x, w) for w, c in high.items() if c * n > all_[w] * n1 and 3 <= all_[w] < n and (x := chi(w)) >= CHI), reverse=True)[:FEATURES]
    number = {w: i for i, (_, w) in enumerate(kept)}
    rng = np.random.default_rng(seed)
    idx = [np.fromiter(sorted(number[w] for w in s if w in number), np.int64) for s in sets]
    weights, seen = np.zeros(len(number)), np.full(len(number), 1e-6)
    first, steps = float(start[0]), np.log(np.maximum(np.diff(start), 0.5))
    cut_seen = np.full(grades - 1, 1e-6)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), max(1, n // 64)):
            cuts = first + np.concatenate(([0], np.cumsum(np.exp(steps))))
            flat = np.concatenate([idx[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(idx[i]) for i in batch])
            eta = np.bincount(row, weights[flat], len(batch))
            edge = np.concatenate(([-np.inf], cuts, [np.inf]))
            g = y[batch]
            low, up = _sigmoid(edge[g] - eta), _sigmoid(edge[g + 1] - eta)
            p = np.maximum(up - low, 1e-9)
            dlow, dup = low * (1 - low), up * (1 - up)
            deta = (dup - dlow) / p  # of the loss
            grad = np.bincount(flat, deta[row], len(weights)) / len(batch) + decay * weights / 10
            seen += grad * grad
            weights -= rate * grad / np.sqrt(seen)
            dcut = np.zeros(grades + 1)
            np.add.at(dcut, g, dlow / p)
            np.add.at(dcut, g + 1, -dup / p)
            dcut = dcut[1:-1] / len(batch)
            through = np.cumsum(dcut[::-1])[::-1]  # a step moves all later cuts
            own = np.concatenate(([through[0]], through[1:] * np.exp(steps)))
            cut_seen += own * own
            own = 0.1 * own / np.sqrt(cut_seen)
            first, steps = first - own[0], steps - own[1:]
    cuts = first + np.concatenate(([0], np.cumsum(np.exp(steps))))
    return Model({w: float(weights[i]) for w, i in number.items() if abs(weights[i]) > 1e-4}, cuts)


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, grade``: 0 not toxic, 1 toxic, 2 toxic and of low quality. Of several rows of an id the highest counts; null ids
    and null labels of toxicity are left out; unknown quality is not low."""
    one = only(labels, id_col, "toxic", "quality").where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 2).otherwise(1)
    return one.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(grade).alias("grade"))


def training_rows(docs: DataFrame, grades: DataFrame, per_grade: int = PER_GRADE, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str | None, int]]:
    """About ``per_grade`` labelled texts of each grade, taken by the hash of the id."""
    counts = {r[0]: r[1] for r in grades.groupBy("grade").count().collect()}
    share = F.lit(0.0)
    for g, n in counts.items():
        share = F.when(F.col("grade") == g, min(1.0, per_grade / n)).otherwise(share)
    unit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    some = grades.where(unit < share).withColumnRenamed("doc_id", "_id")  # at most about per_grade for each grade
    rows = only(docs, id_col, text_col).join(F.broadcast(some), F.col(id_col) == F.col("_id")).select(id_col, text_col, "grade").collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1] or ""))]


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, severity, expected_severity, toxic`` for each row, from its whole text.

    expected_severity is the sum of the chances to exceed each grade, severity the most likely grade, and toxic says whether a
    grade above 0 is more likely than not. A null or empty text has no features, and so the grade of the cuts alone. Repeated rows,
    null ids and further columns do no harm. The model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                e = np.array([m.exceed(t) for t in part.column(1).to_pylist()]).reshape(part.num_rows, -1)
                each = -np.diff(np.concatenate([np.ones((len(e), 1)), e, np.zeros((len(e), 1))], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(each.argmax(1).astype(np.int32)), pa.array(e.sum(1)), pa.array(e[:, 0] > 0.5)], ["doc_id", "severity", "expected_severity", "toxic"])

    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, severity int, expected_severity double, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model of those with labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = training_rows(docs, grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return severity(docs, train(rows, 3)).withColumn("doc_id", F.col("doc_id").cast("long"))
