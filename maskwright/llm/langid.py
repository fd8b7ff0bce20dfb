"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import lean_map, only

BUCKETS = 1 << 14
WIDTH = 16
#: Documents of each language to learn from, about.
PER_LANGUAGE = 600
#: Share of correctly named calibration texts that the threshold may reject.
REJECT = 0.0005
UND = "und"

_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def subwords(text: str) -> np.ndarray:
    """Buckets of the 3- and 4-byte subwords of the lower-cased words, spaces around a word included."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    three = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    four = three[:-1] << np.uint32(8) | b[3:]
    return np.concatenate(((three * np.uint32(2654435761)) >> np.uint32(18), (four * np.uint32(2246822519)) >> np.uint32(18)))


@dataclass
class Model:
    """``table`` holds the logits that a bucket adds: the average of embeddings, then a linear layer, is linear as a whole."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray | None:
        idx = subwords(text)
        if not len(idx):
            return None
        return np.bincount(idx, minlength=BUCKETS) @ self.table / len(idx) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 for a text that is null or has no letter."""
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return UND, 0.0
        z = self.logits(text)
        z = (self.bias if z is None else z) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 2.0, steps: int = 300, seed: int = 7) -> Model:
    """Fits (text, language) rows by stochastic gradient descent; a fifth of them only calibrates. Few rows get more epochs, for
    ``steps`` steps in all at least.

    Each epoch sees every text whole and as a random run of 2 to 12 words, since texts to name may be very short. The
    temperature minimizes the loss on the calibration texts and such runs of theirs; the threshold is the score under which
    REJECT of the correctly named ones lie, and one half at most.
    """
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    number = {x: n for n, x in enumerate(languages)}
    rows = [rows[i] for i in rng.permutation(len(rows))]
    fit, held = rows[len(rows) // 5 :], rows[: len(rows) // 5] or rows

    def piece(text: str) -> np.ndarray:
        words = text.split()
        n = int(rng.integers(2, 13))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        return subwords(" ".join(words[at : at + n]))

    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    lin, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    whole = [np.unique(subwords(t), return_counts=True) for t, _ in fit]
    target = np.array([number[lang] for _, lang in fit])
    epochs = max(epochs, -(-steps * 32 // len(fit)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // 32)):
            some = [whole[i] for i in batch] + [np.unique(piece(fit[i][0]), return_counts=True) for i in batch]
            y = np.concatenate([target[batch], target[batch]])
            use = [n for n, (i, _) in enumerate(some) if len(i)]
            if not use:
                continue
            some, y = [some[n] for n in use], y[use]
            idx = np.concatenate([i for i, _ in some])
            w = np.concatenate([c / c.sum() for _, c in some])[:, None]
            starts = np.cumsum([0, *(len(i) for i, _ in some[:-1])])
            h = np.add.reduceat(emb[idx] * w, starts)
            g = _softmax(h @ lin + bias)
            g[np.arange(len(y)), y] -= 1
            g /= len(y)
            back = np.repeat(g @ lin.T, np.diff(np.append(starts, len(idx))), axis=0) * w
            lin -= step * (h.T @ g)
            bias -= step * g.sum(0)
            order = np.argsort(idx, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], np.diff(idx[order]) > 0)))
            emb[idx[order][cut]] -= step * len(y) * np.add.reduceat(back[order], cut)
    model = Model(languages, emb @ lin, bias, 1.0, 0.0)
    texts = [subwords(t) for t, _ in held] + [piece(t) for t, _ in held]
    y = np.array([number[lang] for _, lang in held] * 2)
    use = [n for n, i in enumerate(texts) if len(i)]
    if use:
        z = np.array([model.table[texts[n]].mean(0) + bias for n in use])
        y = y[use]
        model.temperature = float(min(np.geomspace(0.05, 20, 120), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).sum()))
        p = _softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y]
        model.threshold = min(0.5, float(np.quantile(right, REJECT))) if len(right) else 0.0
    return model


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """About ``per_language`` labelled texts of each language, never from the held-out fifth.

    The sample is of the ids whose hash is below the share of its language to be taken, so it does not depend on partitioning;
    counts need no text. Null texts and languages are left out.
    """
    mod = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5
    known = only(docs, id_col, text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (mod != 0))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, per_language / n)).otherwise(share)
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rows = known.where(unit < share).select(text_col, lang_col, id_col).collect()
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[2], r[0]))]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row, from its whole text alone.

    ``und`` with score 0 for null texts and texts without a letter, which are rejected, as are scores below the model's threshold.
    A model of no languages (an empty table to learn from) says ``und``. The model has a fixed size and goes to each worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found = [m.predict(t) for t in part.column(1).to_pylist()]
                out = [x == UND or s < m.threshold for x, s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return lean_map(plain, run, f"doc_id {dict(plain.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which the language is not rejected, with all their columns and no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found = [m.predict(t) for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array([x != UND and s >= m.threshold for x, s in found], pa.bool_()))

    return lean_map(docs, run, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model of those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(training_rows(docs)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "rejected")
