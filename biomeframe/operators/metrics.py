"""Scoring of (truth, prediction) pairs.

Every metric starts from the class counts, so the samples are aggregated
map-side once and later steps see at most classes x classes rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biomeframe.functions.scores import choices, ratio
from biomeframe.operators.keyed import attach
from biomeframe.session import materialise

TRUTH, PRED = "HC_subCST", "subCST"


def align_report(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """How the two id sets match: one row of counts."""
    left = truth.groupBy("sampleID").agg(F.count(F.lit(1)).alias("t"))
    right = pred.groupBy("sampleID").agg(F.count(F.lit(1)).alias("p"))
    both = left.join(right, "sampleID", "full_outer")
    count = lambda cond: F.count(F.when(cond, 1))
    return both.agg(
        count(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("n_matched"),
        count(F.col("p").isNull()).alias("n_truth_only"),
        count(F.col("t").isNull()).alias("n_pred_only"),
        count((F.col("t") > 1) | (F.col("p") > 1)).alias("n_duplicated"),
    )


def align(truth: DataFrame, pred: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs on ``sampleID``; ``strict`` raises when the id sets differ or repeat."""
    if strict:
        report = align_report(truth, pred).first()
        if report["n_truth_only"] or report["n_pred_only"] or report["n_duplicated"]:
            raise ValueError(f"truth and prediction do not hold the same samples: {report}")
    return truth.select("sampleID", TRUTH).join(pred.select("sampleID", PRED), "sampleID")


def accuracy(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Percent of matching pairs."""
    hit = F.coalesce((F.col(TRUTH) == F.col(PRED)).cast("double"), F.lit(0.0))
    return pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(hit) * 100).alias("accuracy")
    )


def cells(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pair counts; pairs that already carry a count ``n`` are added up."""
    n = F.sum("n") if "n" in pairs.columns else F.count(F.lit(1))
    return pairs.groupBy(*(by or []), TRUTH, PRED).agg(n.alias("n"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts on the sorted label universe of truth and prediction, zero-filled."""
    counted = materialise(cells(pairs))  # at most classes x classes rows, read twice
    universe = counted.select(F.explode(F.array(TRUTH, PRED)).alias("c")).agg(
        F.sort_array(F.collect_set("c")).alias("u")
    )
    grid = universe.select(F.explode("u").alias(TRUTH), "u").select(TRUTH, F.explode("u").alias(PRED))
    return grid.join(counted, [TRUTH, PRED], "left").select(
        TRUTH, PRED, F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """The confusion counts with one column per label."""
    wide = cells(pairs).groupBy(TRUTH).pivot(PRED, labels).agg(F.first("n"))
    return wide.na.fill(0)


def confusion_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell-wise confusion of ``a`` minus that of ``b``."""
    left = cells(a).withColumnRenamed("n", "na")
    right = cells(b).withColumnRenamed("n", "nb")
    zero = F.lit(0)
    return left.join(right, [TRUTH, PRED], "full_outer").select(
        TRUTH, PRED, (F.coalesce("na", zero) - F.coalesce("nb", zero)).alias("diff")
    )


def class_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Support, precision, recall and F1 per class; undefined values are 0."""
    by = by or []
    sides = F.array(
        F.struct(
            F.col(TRUTH).alias("c"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("guessed"),
            F.when(F.col(TRUTH) == F.col(PRED), F.col("n")).otherwise(F.lit(0)).alias("tp"),
        ),
        F.struct(
            F.col(PRED).alias("c"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("guessed"),
            F.lit(0).cast("long").alias("tp"),
        ),
    )
    per_class = (
        cells(pairs, by)
        .select(*by, F.inline(sides))
        .groupBy(*by, F.col("c").alias(TRUTH))
        .agg(*[F.sum(m).alias(m) for m in ("support", "guessed", "tp")])
    )
    tp = F.col("tp")
    p = F.when(F.col("guessed") > 0, tp / F.col("guessed")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, tp / F.col("support")).otherwise(F.lit(0.0))
    scored = per_class.select(*by, TRUTH, "support", p.alias("precision"), r.alias("recall"))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    return scored.withColumn("f1", f1)


def weighted_metrics(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Support-weighted precision, recall, F1 and accuracy as shares."""
    by = by or []
    weight = lambda m: ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
    return (
        class_scores(pairs, by)
        .groupBy(*by)
        .agg(
            F.sum("support").alias("n"),
            weight("precision"),
            weight("recall"),
            weight("f1"),
        )
        .withColumn("accuracy", F.col("recall"))
    )


def per_class_metrics(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics on the samples of one true class only, where no other class has support."""
    by = by or []
    hits = F.sum(F.when(F.col(TRUTH) == F.col(PRED), F.col("n")).otherwise(F.lit(0)))
    return (
        cells(pairs, by)
        .groupBy(*by, TRUTH)
        .agg((hits / F.sum("n")).alias("recall"))
        .select(
            *by,
            TRUTH,
            "recall",
            F.col("recall").alias("accuracy"),
            F.when(F.col("recall") > 0, 1.0).otherwise(0.0).alias("precision"),
            (2 * F.col("recall") / (1 + F.col("recall"))).alias("f1"),
        )
    )


def roc_points(pairs: DataFrame) -> DataFrame:
    """One-versus-rest ROC corners per true class from hard labels."""
    counted = cells(pairs)
    total = counted.agg(F.sum("n")).scalar()
    hit = F.when(F.col(TRUTH) == F.col(PRED), F.col("n")).otherwise(0)
    truth = counted.filter(F.col(TRUTH).isNotNull()).groupBy(TRUTH).agg(F.sum("n").alias("pos"), F.sum(hit).alias("tp"))
    guess = counted.filter(F.col(PRED).isNotNull()).groupBy(F.col(PRED).alias(TRUTH)).agg(F.sum("n").alias("guessed"))
    counted = truth.join(guess, TRUTH, "left").select(
        TRUTH, total.alias("total"), "pos", "tp", (F.coalesce("guessed", F.lit(0)) - F.col("tp")).alias("fp")
    )
    corner = lambda x, y: F.struct(x.alias("fpr"), y.alias("tpr"))
    middle = corner(
        ratio(F.col("fp"), F.col("total") - F.col("pos")), ratio(F.col("tp"), F.col("pos"))
    )
    ends = [corner(F.lit(v), F.lit(v)) for v in (0.0, 1.0)]
    corners = F.array_distinct(F.array(ends[0], middle, ends[1]))
    return counted.select(TRUTH, F.posexplode(corners).alias("point", "c")).select(
        TRUTH, "point", "c.fpr", "c.tpr"
    )


def score_steps(scored: DataFrame, labels: list[str], scores: str = "scores") -> DataFrame:
    """One row per class and distinct score: samples at it (``pos`` of the class, ``neg`` of others), and with
    it and all higher scores (``tp``, ``fp``, ``point``).

    Equal scores are merged first. Running sums go over range partitions of (class, score) and the sums of the
    partitions before, so no window holds a class. Rows without a label and missing scores have no part; NaN
    is the highest score.
    """
    names = F.array(*[F.lit(x) for x in labels])
    each = scored.filter(F.col(TRUTH).isNotNull()).select(F.col(TRUTH).alias("_t"), F.posexplode(scores).alias("_c", "score"))
    own = F.get(names, F.col("_c")).alias(TRUTH)
    told = each.filter(F.col("score").isNotNull()).select("_t", own, "score").filter(F.col(TRUTH).isNotNull())
    hit = F.col("_t") == F.col(TRUTH)
    merged = told.groupBy(TRUTH, "score").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    ranged = merged.repartitionByRange(F.col(TRUTH), F.desc("score")).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged)
    sums = {"tp": F.sum("pos"), "fp": F.sum("neg"), "point": F.count(F.lit(1))}
    parts = ranged.groupBy(TRUTH, "_part").agg(*[v.alias(f"_{k}") for k, v in sums.items()])
    # One row per partition and class in it.
    before = Window.partitionBy(TRUTH).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(TRUTH, "_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    upto = Window.partitionBy(TRUTH, "_part").orderBy(F.desc("score"))
    running = ranged.withColumns({k: v.over(upto) for k, v in sums.items()})
    joined = attach(running, offsets, [TRUTH, "_part"])
    return joined.select(TRUTH, "score", "pos", "neg", *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])


def _class_sizes(steps: DataFrame) -> DataFrame:
    return steps.groupBy(TRUTH).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def roc_curves(scored: DataFrame, labels: list[str], scores: str = "scores") -> DataFrame:
    """One-versus-rest ROC points per class from class scores, from (0, 0) down the thresholds to (1, 1).

    ``scores`` is an array in the order of ``labels``. Point 0 has no threshold; equal scores make one point. A rate
    is null where the table has no sample of its kind.
    """
    steps = materialise(score_steps(scored, labels, scores))
    sized = attach(steps, _class_sizes(steps), TRUTH)
    origin = _class_sizes(steps).select(
        TRUTH, "n_pos", "n_neg", F.lit(None).cast("double").alias("score"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "point")]
    )
    every = sized.select(*origin.columns).unionByName(origin)
    rate = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n))
    return every.select(
        TRUTH, "point", F.col("score").alias("threshold"), rate("fp", "n_neg").alias("fpr"), rate("tp", "n_pos").alias("tpr")
    )


def roc_auc(scored: DataFrame, labels: list[str], scores: str = "scores") -> DataFrame:
    """Area under each class's ROC curve, with the numbers of samples inside and outside the class.

    The area is the share of (inside, outside) pairs in the right order, ties counting half, added up in exact
    integers; null where one of the two kinds is missing.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    pairs = F.sum(wide("neg") * (2 * F.col("tp") - F.col("pos")).cast("decimal(20,0)")).cast("double")
    steps = score_steps(scored, labels, scores)
    sums = steps.groupBy(TRUTH).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), pairs.alias("_pairs"))
    both = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return sums.select(TRUTH, "n_pos", "n_neg", F.when(both > 0, F.col("_pairs") / (2 * both)).alias("auc"))


def misclassified(pairs: DataFrame) -> DataFrame:
    """``truth:pred`` of every wrong pair."""
    return pairs.filter(F.col(TRUTH) != F.col(PRED)).select(
        "sampleID", F.concat_ws(":", TRUTH, PRED).alias("miss")
    )


def tagged_pairs(methods: dict[str | tuple[str, ...], DataFrame], names: list[str]) -> DataFrame:
    """Stack pairs of several methods with their tags."""
    frames = []
    for key, pairs in methods.items():
        parts = (key,) if isinstance(key, str) else key
        tags = [F.lit(v).alias(n) for n, v in zip(names, parts, strict=True)]
        frames.append(pairs.select(*tags, "sampleID", TRUTH, PRED))
    return reduce(DataFrame.unionByName, frames)


def compare_methods(
    methods: dict[str | tuple[str, ...], DataFrame], names: tuple[str, ...] = ("method",)
) -> DataFrame:
    """Weighted metrics per method (and training share), rounded to 3 digits."""
    scored = weighted_metrics(tagged_pairs(methods, list(names)), list(names))
    panel = [F.round(m, 3).alias(m) for m in ("accuracy", "f1", "precision", "recall")]
    return scored.select(*names, *panel)


def rank_hits(
    scored: DataFrame, labels: list[str], scores: str = "scores", rank_mode: str = "first_index"
) -> DataFrame:
    """How often the i-th guess was right, per rank and cumulated."""
    universe = F.array(*[F.lit(x) for x in labels])
    guesses = scored.select(TRUTH, F.posexplode(choices(scores, rank_mode)).alias("r", "i"))
    hit = (F.element_at(universe, F.col("i") + 1) == F.col(TRUTH)).cast("long")
    per_rank = guesses.groupBy((F.col("r") + 1).alias("rank")).agg(
        F.sum(F.coalesce(hit, F.lit(0))).alias("hits")
    )
    # One row per class.
    running = F.sum("hits").over(Window.partitionBy(F.lit(0)).orderBy("rank"))
    return per_rank.withColumn("cumulative", running)


def lookup(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Add the columns of a keyed dimension."""
    return attach(df, table, on, "left")
