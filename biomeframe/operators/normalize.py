"""Per-sample shares and per-taxon scaling on the long form.

A long table holds one row per (sample, taxon), so the rows of a sample are
bounded by the number of taxa; per-sample windows rely on that. Per-taxon
statistics are aggregates with map-side combine, since a taxon can occur in
every sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biomeframe.functions.scores import clamp, ratio
from biomeframe.operators.keyed import attach
from biomeframe.session import materialise

PSEUDO = 1.0e-5


def to_long(df: DataFrame, sample: str = "sampleID", taxon: str = "taxon", count: str = "count") -> DataFrame:
    """Canonical long table: one row per (sample, taxon), counts added up."""
    return df.groupBy(F.col(sample).alias("sampleID"), F.col(taxon).alias("taxon")).agg(
        F.sum(F.col(count).cast("double")).alias("count")
    )


def relative_abundance(df: DataFrame, zero_policy: str = "zero") -> DataFrame:
    """``value`` = count / sample total.

    For a null count or an empty sample: ``'zero'`` gives 0, ``'null'`` gives
    null, ``'pseudocount'`` gives 1e-5, which also replaces exact zeros after
    the division (shares then no longer add up to 1).
    """
    share = F.when(F.col("_total") != 0, F.col("count") / F.col("_total"))
    if zero_policy == "zero":
        value = F.coalesce(share, F.lit(0.0))
    elif zero_policy == "pseudocount":
        value = F.when(share.isNull() | (share == 0), F.lit(PSEUDO)).otherwise(share)
    elif zero_policy == "null":
        value = share
    else:
        raise ValueError(f"unknown zero_policy {zero_policy!r}")
    total = F.sum("count").over(Window.partitionBy("sampleID"))
    return df.withColumn("_total", total).withColumn("value", value).drop("count", "_total")


def _complete(have: DataFrame, taxa: DataFrame, fill: float) -> DataFrame:
    """Long rows of ``have`` (one array per sample) plus ``fill`` for absent taxa."""
    missing = F.array_except(taxa.agg(F.collect_list("taxon")).scalar(), F.col("have.taxon"))
    filler = F.array_repeat(F.lit(float(fill)), F.size("missing"))
    absent = F.arrays_zip(F.col("missing").alias("taxon"), filler.alias("value"))
    return have.withColumn("missing", missing).select(
        "sampleID", F.inline(F.concat("have", absent))
    )


def densify(df: DataFrame, taxa: DataFrame, fill: float = 0.0) -> DataFrame:
    """Add a ``fill`` row for every dictionary taxon a sample lacks.

    The dictionary travels as one array; a sample's rows are at most its size.
    """
    have = df.groupBy("sampleID").agg(F.collect_list(F.struct("taxon", "value")).alias("have"))
    return _complete(have, taxa, fill)


def fill_samples(df: DataFrame, samples: DataFrame, taxa: DataFrame, fill: float = 0.0) -> DataFrame:
    """Dense table over ``samples``, including samples without any present taxon."""
    have = df.groupBy("sampleID").agg(F.collect_list(F.struct("taxon", "value")).alias("have"))
    none = F.array().cast("array<struct<taxon:string,value:double>>")
    joined = samples.select("sampleID").join(have, "sampleID", "left")
    return _complete(joined.withColumn("have", F.coalesce("have", none)), taxa, fill)


def pseudocount_abundance(df: DataFrame) -> DataFrame:
    """Dense shares with 1e-5 in place of zeros and nulls."""
    shares = relative_abundance(df, "pseudocount")
    return densify(shares, df.select("taxon").distinct(), PSEUDO)


def only_samples(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Long rows of the listed samples."""
    return df.join(samples.select("sampleID"), "sampleID", "left_semi")


def taxon_moments(df: DataFrame, samples: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Per taxon over ``samples`` (or all), absent ones counting as 0, in one aggregation.

    Rows of samples that are not listed take no part.

    Returns ``n, nnz, total, mean, sd_pop, sd_samp, min, max, prevalence``. The
    zero group joins the present rows by the pairwise variance formula.
    """
    if samples is not None:
        df = only_samples(df, samples)
    universe = df.select("sampleID").distinct() if samples is None else samples
    n = universe.agg(F.count(F.lit(1)).cast("double")).scalar()
    x = F.col(value)
    part = df.filter(x.isNotNull()).groupBy("taxon").agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum(F.when(x > 0, 1.0).otherwise(0.0)).alias("nnz"),
        F.sum(x).alias("total"),
        F.avg(x).alias("m"),
        (F.var_pop(x) * F.count(F.lit(1))).alias("m2"),
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
    ).withColumn("n", n)
    spread = F.col("m2") + F.col("m") * F.col("m") * F.col("k") * (F.col("n") - F.col("k")) / F.col("n")
    gap = F.col("k") < F.col("n")
    return part.select(
        "taxon",
        F.col("n").cast("long").alias("n"),
        F.col("nnz").cast("long").alias("nnz"),
        "total",
        (F.col("total") / F.col("n")).alias("mean"),
        F.sqrt(spread / F.col("n")).alias("sd_pop"),
        F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("sd_samp"),
        F.when(gap, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min"),
        F.when(gap, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max"),
        (F.col("nnz") / F.col("n")).alias("prevalence"),
    )


def scale(
    df: DataFrame,
    method: str,
    ddof: int = 0,
    samples: DataFrame | None = None,
    on_zero: str = "error",
) -> DataFrame:
    """Scale a table of shares.

    ``zscore``, ``minmax``, ``stddev`` use per-taxon statistics over all samples
    and return the dense table; a constant taxon gives NaN. ``log_ratio`` is
    x / log10(x). ``tmm`` divides by a trimmed-mean factor per sample.
    """
    if method == "none":
        return df
    if method == "log_ratio":
        return log_ratio(df, on_zero)
    if method == "tmm":
        return tmm(df)
    if method not in ("zscore", "minmax", "stddev"):
        raise ValueError(f"unknown scaling method {method!r}")
    stats = taxon_moments(df, samples)
    sd = F.col("sd_pop") if ddof == 0 else F.col("sd_samp")
    value = {
        "zscore": ratio(F.col("value") - F.col("mean"), sd),
        "minmax": ratio(F.col("value") - F.col("min"), F.col("max") - F.col("min")),
        "stddev": ratio(F.col("value"), sd),
    }[method]
    taxa = stats.select("taxon")
    full = densify(df, taxa) if samples is None else fill_samples(df, samples, taxa)
    return attach(full, stats, "taxon").select("sampleID", "taxon", value.alias("value"))


def fit_scaling(df: DataFrame, method: str, taxa: list[str], samples: DataFrame, ddof: int = 0) -> dict:
    """What ``method`` learns from ``samples``: plain numbers, in the order of ``taxa``.

    ``shift`` and ``by`` for the per-taxon methods, where a value becomes (x - shift) / by;
    the reference sample and the centre for ``tmm``; nothing for the others.
    """
    if method == "tmm":
        df = materialise(only_samples(df, samples))
        reference = materialise(tmm_reference(df))
        centre = tmm_log_factors(df, reference).agg(F.avg("lf")).first()[0]
        rows = {r["taxon"]: (r["yr"], r["nr"]) for r in reference.collect()}
        return {"reference": [[t, *v] for t, v in sorted(rows.items())], "centre": centre or 0.0}
    if method not in ("zscore", "minmax", "stddev"):
        return {}
    sd = "sd_pop" if ddof == 0 else "sd_samp"
    shift, by = {
        "zscore": (F.col("mean"), F.col(sd)),
        "minmax": (F.col("min"), F.col("max") - F.col("min")),
        "stddev": (F.lit(0.0), F.col(sd)),
    }[method]
    found = taxon_moments(df, samples).select("taxon", shift.alias("shift"), by.alias("by")).collect()
    numbers = {r["taxon"]: (r["shift"], r["by"]) for r in found}
    pairs = [numbers.get(t, (0.0, 0.0)) for t in taxa]
    return {"shift": [float(s) for s, _ in pairs], "by": [float(b or 0.0) for _, b in pairs]}


def log_ratio(df: DataFrame, on_zero: str = "error") -> DataFrame:
    """x / log10(x); infinite at x = 1."""
    x = F.col("value")
    if on_zero == "error":
        below = F.raise_error(F.lit("log_ratio needs positive values"))
    elif on_zero == "null":
        below = F.lit(None)
    else:
        raise ValueError(f"unknown on_zero {on_zero!r}")
    scaled = F.when(x > 0, ratio(x, F.log10(x))).when(x <= 0, below.cast("double"))
    return df.withColumn("value", scaled)


def effort_z(samples: DataFrame, depth: str = "read_count", name: str = "effort_z") -> DataFrame:
    """Sequencing effort: read count standardised with the sample sd; nulls skipped."""
    both = samples.agg(F.struct(F.avg(depth).alias("m"), F.stddev_samp(depth).alias("s"))).scalar()
    return samples.withColumn(name, ratio(F.col(depth) - both["m"], both["s"]))


def clamp_values(df: DataFrame, lo: float, hi: float, value: str = "value") -> DataFrame:
    return df.withColumn(value, clamp(value, lo, hi))


def zscore_taxa(
    df: DataFrame, top_n: int | None = None, rank_by: str = "mean", samples: DataFrame | None = None
) -> DataFrame:
    """z-scores with the sample sd; optional top-N taxa first; constant taxa dropped.

    ``dropped`` carries how many taxa had no variance.
    """
    from biomeframe.operators.ranking import top_of

    stats = materialise(taxon_moments(df, samples))  # one row per taxon, read several times
    kept = stats.filter(F.col("total") > 0) if top_n is None else top_of(stats, top_n, rank_by)
    flat = F.coalesce(F.col("sd_samp"), F.lit(0.0)) == 0
    dropped = kept.agg(F.count(F.when(flat, 1))).scalar()
    kept = kept.filter(~flat).withColumn("dropped", dropped)
    present = attach(df, kept.select("taxon"), "taxon", "left_semi")
    universe = df.select("sampleID").distinct() if samples is None else samples.select("sampleID")
    full = fill_samples(present, universe, kept.select("taxon"))
    return attach(full, kept, "taxon").select(
        "sampleID", "taxon", ((F.col("value") - F.col("mean")) / F.col("sd_samp")).alias("z"), "dropped"
    )


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``value``, which is computed once however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _average_ranks(values: Column) -> Column:
    """Rank of each value of an array, from 1, ties averaged."""

    def ranked(x: Column) -> Column:
        first = lambda v: F.array_position(x["up"], v)
        last = lambda v: F.size(x["up"]) + 1 - F.array_position(x["down"], v)
        return F.transform(x["own"], lambda v: (first(v) + last(v)) / 2.0)

    both = F.struct(values.alias("own"), F.sort_array(values).alias("up"), F.sort_array(values, asc=False).alias("down"))
    return _let(both, ranked)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def tmm_reference(df: DataFrame) -> DataFrame:
    """Reference sample ``taxon, yr, nr``: its upper quartile, relative to its total, is nearest
    to the mean one; ties go to the smallest id.
    """
    present = df.filter(F.col("value") > 0)
    width = present.select("taxon").distinct().agg(F.count(F.lit(1))).scalar()
    # A sample's values are at most as many as the taxa.
    own = present.groupBy("sampleID").agg(F.sort_array(F.collect_list("value")).alias("v"))
    # 75 % point among all taxa, the absent ones being leading zeros.
    at = (F.col("t") - 1) * 0.75
    low = F.floor(at)

    def pick(pos: Column) -> Column:
        idx = (pos - (F.col("t") - F.size("v")) + 1).cast("int")
        return F.when(idx >= 1, F.try_element_at("v", idx)).otherwise(F.lit(0.0))

    quart = (
        own.withColumns({"t": width, "lib": _total(F.col("v"))})
        .withColumns({"a": pick(low), "b": F.coalesce(pick(F.least(low + 1, F.col("t") - 1)), F.lit(0.0))})
        .select("sampleID", "lib", ((F.col("a") + (F.col("b") - F.col("a")) * (at - low)) / F.col("lib")).alias("f75"))
    )
    quart = materialise(quart)
    centre = quart.agg(F.avg("f75")).scalar()
    nearest = F.struct(F.round(F.abs(F.col("f75") - centre), 12).alias("gap"), "sampleID", "lib")
    # One row.
    chosen = materialise(quart.agg(F.min(nearest).alias("r")).select("r.sampleID", F.col("r.lib").alias("nr")))
    return present.join(chosen, "sampleID").select("taxon", F.col("value").alias("yr"), "nr")


def _log_factor(have: Column, lib: Column, trim_m: float, trim_a: float) -> Column:
    """log2 factor of one sample from its values with the reference's: ranks, trimming and weighted mean."""

    def measure(e: Column) -> Column:
        y, n, yr, nr = e["value"], lib, e["yr"], e["nr"]
        return F.struct(
            F.round(F.log2((y / n) / (yr / nr)), 12).alias("m"),
            F.round(0.5 * F.log2(y * yr / (n * nr)), 12).alias("a"),
            ((n - y) / (n * y) + (nr - yr) / (nr * yr)).alias("v"),
        )

    shared = F.filter(have, lambda e: (e["value"] > 0) & e["yr"].isNotNull())
    ranks = lambda p: F.struct(
        p.alias("p"), _average_ranks(p["m"]).alias("rm"), _average_ranks(p["a"]).alias("ra"), F.size(p).alias("k")
    )

    def trimmed(r: Column) -> Column:
        lo_m, lo_a = F.floor(r["k"] * trim_m), F.floor(r["k"] * trim_a)
        both = F.arrays_zip(r["p"].alias("p"), r["rm"].alias("rm"), r["ra"].alias("ra"))
        inside = lambda e: (
            e["rm"].between(lo_m + 1, r["k"] - lo_m) & e["ra"].between(lo_a + 1, r["k"] - lo_a) & (e["p"]["v"] > 0)
        )
        return F.filter(both, inside)

    mean = lambda kept: _total(F.transform(kept, lambda e: e["p"]["m"] / e["p"]["v"])) / _total(
        F.transform(kept, lambda e: 1 / e["p"]["v"])
    )
    return _let(F.transform(shared, measure), lambda p: _let(ranks(p), lambda r: _let(trimmed(r), lambda k: F.when(F.size(k) > 0, mean(k)))))


def _with_log_factor(df: DataFrame, reference: DataFrame, trim_m: float, trim_a: float) -> DataFrame:
    """One row per sample: its values as an array ``have``, their sum ``total``, ``n`` positive ones and ``lf``."""
    paired = attach(df, reference, "taxon", "left")
    entry = F.struct("taxon", "value", "yr", "nr")
    own = paired.groupBy("sampleID").agg(F.sort_array(F.collect_list(entry)).alias("have"))
    positive = F.filter(F.col("have"), lambda e: e["value"] > 0)
    lib = _total(F.transform(positive, lambda e: e["value"]))
    factor = F.coalesce(_let(lib, lambda n: _log_factor(F.col("have"), n, trim_m, trim_a)), F.lit(0.0))
    return own.select("sampleID", "have", F.size(positive).alias("n"), factor.alias("lf"))


def tmm_log_factors(df: DataFrame, reference: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """``lf`` per sample with a positive value, log2 of its factor against ``reference`` before centring."""
    return _with_log_factor(df, reference, trim_m, trim_a).filter("n > 0").select("sampleID", "lf")


def _centred(
    df: DataFrame, trim_m: float, trim_a: float, reference: DataFrame | None, centre: float | None
) -> DataFrame:
    """:func:`_with_log_factor` with ``factor``; a sample without positive values has none."""
    reference = materialise(tmm_reference(df)) if reference is None else reference
    every = _with_log_factor(df, reference, trim_m, trim_a)
    if centre is None:
        every = materialise(every)
        middle = every.filter("n > 0").agg(F.avg("lf")).scalar()
    else:
        middle = F.lit(float(centre))
    return every.withColumn("factor", F.when(F.col("n") > 0, F.pow(F.lit(2.0), F.col("lf") - middle)))


def tmm_factors(
    df: DataFrame,
    trim_m: float = 0.3,
    trim_a: float = 0.05,
    reference: DataFrame | None = None,
    centre: float | None = None,
) -> DataFrame:
    """Trimmed mean of M-values (Robinson & Oshlack 2010): one ``factor`` per sample.

    Without a stored ``reference`` and ``centre`` both come from ``df``: the factors then
    have geometric mean 1. A sample's values are gathered once into an array, in which ranks, trimming and the
    weighted mean are expressions. The values are read several times: pass a stored table.
    """
    every = _centred(df, trim_m, trim_a, reference, centre)
    return every.filter("n > 0").select("sampleID", "factor")


def tmm(
    df: DataFrame,
    trim_m: float = 0.3,
    trim_a: float = 0.05,
    reference: DataFrame | None = None,
    centre: float | None = None,
) -> DataFrame:
    """Values divided by their sample's total times its TMM factor."""
    every = _centred(df, trim_m, trim_a, reference, centre).filter("n > 0")
    known = F.filter(F.transform("have", lambda e: e["value"]), lambda v: v.isNotNull())
    placed = every.select("sampleID", _total(known).alias("_lib"), "factor", F.inline("have"))
    return placed.select("sampleID", "taxon", (F.col("value") / (F.col("_lib") * F.col("factor"))).alias("value"))
