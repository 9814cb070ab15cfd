"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Per label, mean and
covariance come from sums over all labelled rows (one small row per task). The
covariance is shrunk towards the pooled one, and that towards a multiple of the
identity; its Cholesky factor is kept with the model. The score is the logistic
of the difference of the two log densities (log determinant and Mahalanobis
distance) plus the log odds of the labels, tempered so that it is not
overconfident.

Defined results: null text is the empty text, and empty texts get a score like all
others; a label given more than once counts by its mean, at least one half being
1; null labels are left out; whole texts count, however long; a score of exactly the
threshold counts as label 1; with only one label in the training rows its share
(1 or 0) is the score of all, with none 0.5; rows are scored one by one, so repeated
rows agree; only id and text are read, so other columns cannot clash; an empty
table gives no rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.llm.common import arrow_rows, give_back
from biomeframe.session import materialise

THRESHOLD = 0.3
# Texts that go to a Python worker at a time.
BATCH_ROWS = 1000
SHRINK, RIDGE, TEMPER = 0.1, 0.05, 0.5
# Words of ordinary text that every document is taken to hold besides its own.
PRIOR_WORDS = 20

# Classes of bytes that the statistics count.
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>@^~=_{}[]\\/+"]] = True
SHOUT = np.zeros(256, bool)
SHOUT[[ord(c) for c in "!?"]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:"]] = True
STATISTICS = (
    "symbols", "upper", "digits", "shout", "stops", "word_length", "short_words", "distinct", "repeats", "lines"
)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text, each roughly within -3 and 3.

    Shares are taken as square roots, which spreads small ones; smoothing by some
    words keeps very short texts near typical values.
    """
    text = text or ""
    words = text.split()
    n = len(words)
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    per_word = lambda kind: float(np.sqrt(byte[kind].sum() / (n + PRIOR_WORDS)))
    lengths = np.fromiter(map(len, words), float, n)
    distinct = len(set(words))
    # Distinct words grow slower than the text: measured against a power of its length.
    rich = np.log((distinct + PRIOR_WORDS) / (n + PRIOR_WORDS) ** 0.85)
    repeats = sum(map(operator.eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        per_word(SYMBOL),
        per_word(UPPER),
        per_word(DIGIT),
        per_word(SHOUT),
        per_word(STOP),
        float(np.log((lengths.sum() + 5 * PRIOR_WORDS) / (n + PRIOR_WORDS))),
        float(np.sqrt(((lengths <= 3).sum() + 0.35 * PRIOR_WORDS) / (n + PRIOR_WORDS))),
        float(rich),
        float(np.sqrt(repeats / (n + PRIOR_WORDS))),
        float(np.sqrt(1 - (len(set(lines)) + 5) / (len(lines) + 5))),
    ]


@dataclass
class Model:
    """Per label 0 and 1: mean, Cholesky factor, half its log determinant; log odds of the labels."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    half_logs: list[float]
    log_odds: float
    constant: float | None = None


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **keep) -> DataFrame:
    """doc_id, the columns of ``keep`` (name=Column) and the statistics ``x`` of every text."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in keep.items()], F.col(text_col).cast("string").alias("_text")
    )
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column(len(kept))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], x], names=[*kept, "x"])
            del batch, x
            give_back()

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{head}, x array<double>")


def stored(docs: DataFrame, *columns: str, **keep) -> DataFrame:
    """``measure``, written once: training and scoring both read it, and no text is read twice."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return materialise(measure(docs, *columns, **keep))


def fit(
    measured: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    shrink: float = SHRINK,
    ridge: float = RIDGE,
    temper: float = TEMPER,
) -> Model:
    """A model of ``labels`` (doc_id, label) on ``measured`` (doc_id, x), from all rows that have both."""
    marks = (
        labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("_y"))
    )
    p = len(STATISTICS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist()).reshape(-1, p)
            for k in (0, 1):
                part = x[y == k]
                n[k] += len(part)
                s[k] += part.sum(0)
                ss[k] += part.T @ part
        if n.sum():
            yield pa.RecordBatch.from_pydict({"sums": [np.concatenate([n, s.ravel(), ss.ravel()]).tolist()]})

    parts = measured.join(marks, "doc_id").select("_y", "x").mapInArrow(add, "sums array<double>")
    summed = parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + 2 * p + 2 * p * p)
    for r in summed:
        flat[r["i"]] = r["v"]
    n, s, ss = flat[:2], flat[2 : 2 + 2 * p].reshape(2, p), flat[2 + 2 * p :].reshape(2, p, p)
    if not n.all():
        return Model([], [], [], 0.0, 0.5 if not n.any() else float(n[1] > 0))
    means = [s[k] / n[k] for k in (0, 1)]
    scatter = [ss[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(scatter) / n.sum()
    target = (1 - ridge) * pooled + ridge * np.eye(p) * max(np.trace(pooled) / p, 1e-6)
    # A label with few rows for its statistics leans on the pooled covariance more.
    lean = [max(shrink, p / (n[k] + p)) for k in (0, 1)]
    factors = [np.linalg.cholesky((1 - a) * scatter[k] / n[k] + a * target) for k, a in enumerate(lean)]
    halves = [float(np.log(np.diag(c)).sum()) for c in factors]
    model = Model(means, factors, halves, float(np.log(n[1] / n[0])))
    return tempered(model, temper)


def tempered(model: Model, temper: float) -> Model:
    """Densities taken to the power ``temper``; the label odds stay."""
    root = np.sqrt(temper)
    return Model(model.means, [c / root for c in model.factors], [temper * h for h in model.half_logs], model.log_odds)


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    """Share of label 1 for each row of statistics."""
    if model.constant is not None:
        return np.full(len(x), model.constant)
    density = []
    for mean, factor, half in zip(model.means, model.factors, model.half_logs, strict=True):
        z = np.linalg.solve(factor, (x - mean).T)
        density.append(-0.5 * (z * z).sum(0) - half)
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + model.log_odds, -500, 500)))


def score(measured: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``measured`` with ``score`` and ``predicted`` instead of the statistics."""
    kept = [c for c in measured.columns if c != "x"]
    rows = measured.select(*kept, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(len(kept)).to_pylist()).reshape(-1, len(STATISTICS))
            s = scores(model, x)
            columns = [*batch.columns[: len(kept)], pa.array(s), pa.array((s >= threshold).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{head}, score double, predicted int")


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(scores(model, x) >= threshold))
            del batch, x
            give_back()

    return docs.mapInArrow(run, docs.schema)
