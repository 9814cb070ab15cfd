"""Assignment entropy and correlations."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biomeframe.functions.scores import entropy_signed

# Terms of the continued fraction behind a p-value.
TERMS = 1000


def assignment_entropy(df: DataFrame, pct_cols: list[str], on_zero: str = "nan") -> DataFrame:
    """``h_signed`` = sum p ln p, ``h_norm`` = that / ln(classes), ``shannon`` = -h_signed."""
    h = entropy_signed(F.array(*[F.col(f"`{c}`").cast("double") for c in pct_cols]), on_zero)
    return df.withColumn("h_signed", h).withColumns(
        {"h_norm": F.col("h_signed") / math.log(len(pct_cols)), "shannon": -F.col("h_signed")}
    )


def pct_columns(df: DataFrame) -> list[str]:
    """Probability columns by their fixed name prefix."""
    return [c for c in df.columns if c.startswith("Pct")]


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series, twenty places further up."""
    up = 20
    far = z + F.lit(float(up))
    inverse = F.lit(1.0) / far
    square = inverse * inverse
    series = inverse * (F.lit(1 / 12) - square * (F.lit(1 / 360) - square * (F.lit(1 / 1260) - square * F.lit(1 / 1680))))
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(up - 1)), F.lit(0.0), lambda acc, k: acc + F.ln(z + k))
    return (far - 0.5) * F.ln(far) - far + F.lit(0.5 * math.log(2 * math.pi)) + series - steps


def _fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """Continued fraction of the incomplete beta integral by Lentz's method, two steps per term."""
    # No denominator of the fraction may become zero.
    safe = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(F.lit(1e-300))
    first = F.lit(1.0) / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("total"))

    def step(acc: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        by = F.when(j % 2 == 0, even).otherwise(odd)
        d = F.lit(1.0) / safe(1 + by * acc["d"])
        c = safe(1 + by / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["total"] * c * d).alias("total"))

    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * terms + 1)), start, step, lambda acc: acc["total"])


def beta_tail(a: Column, b: Column, x: Column, terms: int = TERMS) -> Column:
    """Regularised incomplete beta function I_x(a, b), as one expression.

    The fraction converges fast below the mean of the distribution; above, the mirrored one is taken.
    """
    mirrored = x > (a + 1) / (a + b + 2)
    p, q = F.when(mirrored, b).otherwise(a), F.when(mirrored, a).otherwise(b)
    y = F.when(mirrored, 1 - x).otherwise(x)
    front = F.exp(ln_gamma(p + q) - ln_gamma(p) - ln_gamma(q) + p * F.ln(y) + q * F.log1p(-y)) / p
    part = front * _fraction(p, q, y, terms)
    inner = F.when(mirrored, 1 - part).otherwise(part)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of Pearson's r over n pairs; NaN below three pairs or without r."""
    freedom = (n - 2).cast("double")
    tail = beta_tail(freedom / 2, F.lit(0.5), 1 - r * r)
    return F.when(r.isNull() | F.isnan(r) | (n < 3), F.lit(float("nan"))).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(tail)


def correlations(df: DataFrame, cols: list[str], digits: tuple[int, int] = (2, 4)) -> DataFrame:
    """Pearson r of every column pair (upper triangle) with its two-sided p-value.

    All pairs come from one aggregation over rows where both values exist.
    """
    aggs = []
    for a, b in combinations(cols, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
        aggs.append(
            F.struct(
                F.lit(a).alias("row"),
                F.lit(b).alias("column"),
                F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias("r"),
                F.count(F.when(both, 1)).alias("n"),
            ).alias(f"{a}~{b}")
        )
    table = df.agg(*aggs)
    long = table.select(F.explode(F.array(*[f"`{c}`" for c in table.columns])).alias("e")).select("e.*")
    return long.select(
        "row",
        "column",
        F.round("r", digits[0]).alias("corr"),
        "n",
        F.round(correlation_p(F.col("r"), F.col("n")), digits[1]).alias("p"),
    )
