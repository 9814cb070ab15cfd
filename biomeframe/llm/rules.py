"""Quality rules: a threshold table compiled into one projection; DataFrame functions only.

All figures of a document come from arrays inside its row, so nothing is
shuffled or collected. Repeated 8-word windows are found by hashing the windows
(64 bits) and, only in texts where hashes repeat, by sorting them.

Defined results: null and empty texts have no words, fail the base rules and are
not kept; very long texts cost n log n; rows are judged one by one, so ties and
repeated rows get equal answers; result columns replace columns of the same
name, all others stay; an empty table stays empty.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biomeframe.llm.common import SPACE, SPACE_CHARS, WORD, unused

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in is that for it as was with be by on not he his but at are this have from or had an they which
le la les de des du et en un une que qui dans est pour par sur au avec il ne se pas plus elle
der die das und ist von zu den mit sich ein eine nicht auf dem im für als auch es an er
el los las y del que en se por con para una su lo como más al no
""".split()

# Rule name, figure, comparison a kept document satisfies, threshold.
THRESHOLDS: list[tuple[str, str, str, float]] = [
    ("long_enough", "n_words", ">=", 20),
    ("words_not_short", "mean_word_chars", ">=", 2.0),
    ("words_not_long", "mean_word_chars", "<=", 14.0),
    ("few_symbols", "symbols_per_word", "<=", 0.2),
    ("some_stop_words", "stop_word_ratio", ">=", 0.02),
    ("few_repeated_lines", "dup_line_ratio", "<=", 0.3),
    ("few_repeated_words", "repeat_word_ratio", "<=", 0.3),
]
COMPARE = {"<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(words: Column) -> Column:
    """Hashes of the 8-word windows, in order."""

    def windows(w: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        )
        return F.when(F.size(w) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash is found twice or more."""

    def in_order(ranked: Column) -> Column:
        def place(row: Column, k: Column) -> Column:
            twin = (F.get(ranked, k - 1)["h"] == row["h"]) | (F.get(ranked, k + 1)["h"] == row["h"])
            return F.when(twin, row["at"])

        return F.sort_array(F.array_compact(F.transform(ranked, place)))

    def spans(places: Column) -> Column:
        step = F.transform(
            places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(step, F.lit(0), operator.add)

    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return bound(bound(ranked, in_order), spans)


def figures(text: Column) -> Column:
    """All figures of one text as a struct."""
    text = F.coalesce(text, F.lit(""))

    def counted(words: Column) -> Column:
        stop = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
        repeated = bound(
            _hashes(words),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)),
        )
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated.cast("long").alias("n_repeat_words"),
            stop.cast("long").alias("n_stop_words"),
        )

    def lined(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    words = bound(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""), counted)
    lines = bound(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)), lined)
    return bound(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda s: F.struct(
            s["w"]["n_words"].alias("n_words"),
            F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            s["l"]["n_dup_lines"].alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            s["w"]["n_stop_words"].alias("n_stop_words"),
            s["l"]["n_lines"].alias("n_lines"),
        ),
    )


def ratios() -> dict[str, Column]:
    """Figures that thresholds may name, from the columns that ``judge`` adds."""

    def per(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }


def compiled(thresholds: Iterable[tuple[str, str, str, float]]) -> Column:
    """Names of the rules that a document fails, as one array expression."""
    known = ratios()
    broken = [F.when(~COMPARE[op](known[figure], F.lit(limit)), F.lit(name)) for name, figure, op, limit in thresholds]
    return F.array_compact(F.array(*broken))


def judge(
    docs: DataFrame,
    text_col: str = "text",
    thresholds: Iterable[tuple[str, str, str, float]] = tuple(THRESHOLDS),
) -> DataFrame:
    """``docs`` with the figures, ``base_failed``, the names of ``failed`` rules and ``kept``."""
    held = unused("_figures", docs.columns)
    measured = docs.withColumn(held, figures(F.col(text_col)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")
    flat = measured.withColumns({n: F.col(f"{held}.{n}") for n in names}).drop(held)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return (
        flat.withColumn("base_failed", base)
        .withColumn("failed", compiled(thresholds))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )
