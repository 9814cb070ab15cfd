"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over
hashed byte n-grams (letters only, ASCII lower-cased) tells the languages whose bit
is one from the others: its weights are log ratios of the two sides' mean
n-gram frequencies. A text gets one margin per bit; the language whose codeword
has the smallest logistic loss, summed with a weight per bit from the
classifiers' training errors, is the prediction. A text whose two best codewords
are close is flagged as ambiguous.

Training reads a bounded sample: at most about ``per_language`` rows of each
language, chosen by a hash of id and text. Prediction reads every whole text.

Defined results: null text, or text without a letter, gives ``und`` and score 0, and so
does everything if no row has a language; with one language all others give it with
score 1; rows are predicted one by one, so repeated rows agree; whole texts count, however
long; of languages at equal distance the first by name is given; only id and text
are read (training: the language too), so other columns cannot clash; an empty
table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.session import materialise

FEATURES = 1 << 13
PER_LANGUAGE, FIT_TASKS = 4_000, 32
SCALE, AMBIGUOUS = 4.0, 0.9
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
# Bytes to letters: upper case to lower, other ASCII to one separator, the rest as it is.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # per bit


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed 2-, 3- and 4-grams of folded bytes."""
    b = FOLD[data].astype(np.uint32)
    out = []
    for n in (2, 3, 4):
        if len(b) >= n:
            h = sum((b[i : len(b) - n + 1 + i] + np.uint32(n)) * MULTIPLIERS[i] for i in range(n))
            out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def frequencies(text: str) -> np.ndarray:
    """Share of each hashed n-gram in one text."""
    counts = np.bincount(grams(np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)), minlength=FEATURES)
    return counts / max(1, counts.sum())


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """Codewords of n languages: all splits into two sides up to six languages, then the most
    spread of some random codes."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 6:
        rows = [[1] + list(rest) for rest in itertools.product((1, -1), repeat=max(0, n - 1))][1:]
        return np.array(rows, float).reshape(-1, n).T
    rng = np.random.default_rng(seed)
    bits = max(32, 12 * int(np.ceil(np.log2(n))))
    best, spread = None, -1.0
    for _ in range(20):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        if -agree.max() + code.shape[1] > spread:
            best, spread = code, -agree.max() + code.shape[1]
    return best


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its score, and whether the runner-up is close. ``x``: texts x features."""
    margins = SCALE * (x @ model.weights)
    losses = np.stack([(np.logaddexp(0, -margins * c) * model.trust).sum(1) for c in model.codes], 1)
    shares = np.exp(losses.min(1, keepdims=True) - losses)
    shares /= shares.sum(1, keepdims=True)
    ranked = np.sort(shares, 1)
    close = ranked[:, -2] > AMBIGUOUS * ranked[:, -1] if len(model.languages) > 1 else np.zeros(len(x), bool)
    return shares.argmax(1), shares.max(1), close


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of every language at most; which ones depends on id and text only."""
    # One row per language, the vocabulary that the model itself holds.
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) * F.col("_n")
    return labelled.join(F.broadcast(sizes), "lang").filter(drawn <= F.lit(per_language << 30)).drop("_n")


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model:
    """A model of the non-null languages in ``docs``; the number of languages is a vocabulary, not data."""
    names = {id_col: "doc_id", text_col: "text", lang_col: "lang"}
    labelled = docs.select(*[F.col(c).alias(n) for c, n in names.items()]).filter("lang IS NOT NULL AND text IS NOT NULL")
    few = sample(labelled, per_language).select(F.col("lang").cast("string"), "text")
    rows = materialise(few.repartition(FIT_TASKS))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if LETTER.search(text):
                    sums[lang] = sums.get(lang, 0) + frequencies(text)
                    n[lang] = n.get(lang, 0) + 1
        for lang in sums:
            yield pa.RecordBatch.from_pydict({"lang": [lang], "n": [n[lang]], "sums": [sums[lang].tolist()]})

    # One row per task and language.
    parts = rows.mapInArrow(add, "lang string, n long, sums array<double>").collect()
    languages = sorted({r["lang"] for r in parts})
    total = {c: [0, np.zeros(FEATURES)] for c in languages}
    for r in parts:
        total[r["lang"]][0] += r["n"]
        total[r["lang"]][1] += np.array(r["sums"])
    means = np.array([s / n for n, s in total.values()]).reshape(-1, FEATURES)
    codes = codewords(len(languages))
    smooth = 0.1 / FEATURES
    weights = np.array([
        np.log(means[bit > 0].mean(0) + smooth) - np.log(means[bit < 0].mean(0) + smooth) for bit in codes.T
    ]).reshape(-1, FEATURES).T
    model = Model(languages, codes, weights, np.ones(codes.shape[1]))
    if not codes.shape[1]:
        return model

    def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = 0, np.zeros(codes.shape[1])
        at = {c: i for i, c in enumerate(languages)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang in at:
                    seen += 1
                    bad += np.sign(frequencies(text) @ weights) != codes[at[lang]]
        yield pa.RecordBatch.from_pydict({"n": [seen], "bad": [bad.tolist()]})

    errors = rows.mapInArrow(wrong, "n long, bad array<double>").collect()
    rate = sum(np.array(r["bad"]) for r in errors) / max(1, sum(r["n"] for r in errors))
    # A bit that errs at chance counts nothing.
    model.trust = np.clip(1 - 2 * rate, 0.02, 1)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", **keep) -> DataFrame:
    """doc_id, the columns of ``keep`` (name=Column), lang_pred, score, ambiguous."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in keep.items()], F.col(text_col).cast("string").alias("_text")
    )
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(len(kept)).to_pylist()
                good = [i for i, t in enumerate(texts) if t and model.languages and LETTER.search(t)]
                names, scores, close = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                if good:
                    best, share, near = decode(model, np.array([frequencies(texts[i]) for i in good]))
                    for i, b, s, c in zip(good, best.tolist(), share.tolist(), near.tolist(), strict=True):
                        names[i], scores[i], close[i] = model.languages[b], s, c
                columns = [batch.column(i) for i in range(len(kept))]
                columns += [pa.array(names), pa.array(scores), pa.array(close)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", "ambiguous"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{head}, lang_pred string, score double, ambiguous boolean")
