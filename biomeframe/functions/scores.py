"""Row-wise expressions over score and probability arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(scores: Column | str) -> Column:
    """Class probabilities of raw scores, shifted by the maximum for stability."""
    scores = _col(scores)
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda acc, e: acc + e)
    return F.transform(raised, lambda e: e / total)


def argmax_index(scores: Column | str) -> Column:
    """0-based index of the largest score; the first index wins ties."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_label(scores: Column | str, labels: Column | str) -> Column:
    """The label at :func:`argmax_index`."""
    return F.element_at(_col(labels), argmax_index(scores) + 1)


def choices(scores: Column | str, rank_mode: str = "first_index") -> Column:
    """Class indices from best to worst guess.

    ``first_index`` gives every tied rank the first tied class; ``unique``
    gives tied classes consecutive ranks in index order.
    """
    scores = _col(scores)
    if rank_mode == "first_index":
        ordered = F.sort_array(scores, asc=False)
        return F.transform(ordered, lambda s: (F.array_position(scores, s) - 1).cast("int"))
    if rank_mode == "unique":
        keyed = F.transform(scores, lambda s, i: F.struct((-s).alias("k"), i.alias("i")))
        return F.transform(F.sort_array(keyed), lambda p: p["i"])
    raise ValueError(f"unknown rank_mode {rank_mode!r}")


def entropy_signed(probs: Column | str, on_zero: str = "nan") -> Column:
    """Sum of p ln p (the negative of Shannon's H).

    ``on_zero='nan'`` keeps 0 ln 0 undefined; ``'zero'`` uses its limit 0.
    """
    if on_zero not in ("nan", "zero"):
        raise ValueError(f"unknown on_zero {on_zero!r}")
    at_zero = F.lit(NAN if on_zero == "nan" else 0.0)
    term = lambda p: F.when(p == 0, at_zero).otherwise(p * F.ln(p))
    return F.aggregate(_col(probs), F.lit(0.0), lambda acc, p: acc + term(p))


def clamp(value: Column | str, lo: float, hi: float) -> Column:
    """``value`` limited to ``[lo, hi]``; null stays null."""
    value = _col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), value)))


def ratio(num: Column, den: Column) -> Column:
    """Double division with floating-point results at a zero denominator."""
    num, den = num.cast("double"), den.cast("double")
    inf = F.lit(float("inf"))
    at_zero = F.when(num > 0, inf).when(num < 0, -inf).otherwise(F.lit(NAN))
    return F.when(den == 0, F.when(num.isNotNull(), at_zero)).otherwise(num / den)
