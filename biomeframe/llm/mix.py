"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source whose target is t and whose size is s gives every document an
expectation of t / s copies. The whole copies are certain. The rest is an
inclusion probability p: documents are ranked by random odds u / (1 - u) over
inclusion odds p / (1 - p), and the smallest ranks are taken until the source's
remaining words are reached, so that the sample's size is fixed. Documents are taken
whole: the one at the cut is in or out, whichever ends nearer to the target.

The cut is found without ranking a source: sizes are summed per source and rank
bucket (``BUCKETS`` per source), and only the bucket with the cut is ranked.
What is broadcast or joined is one row per source.

Defined results: null text has no words and gives none; a null source is a source
of its own, last in the order of sources; documents with equal ids of one source
draw the same number; rows that tie at the cut (equal ids and sizes) are all in or all out, half a
document too many counts as near enough; an empty table gives no rows. Only the id, text and source columns are read, so
other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biomeframe.llm.common import word_count
from biomeframe.operators.keyed import with_position
from biomeframe.session import materialise

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
BUCKETS = 4096


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: str) -> DataFrame:
    """id, source, its non-null key, and size in words, one row per document."""
    source = F.col(source_col)
    return docs.select(
        *more,
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string"))).alias("_key"),
        word_count(F.col(text_col)).alias("size"),
    )


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: ``share`` of all sizes by weight, at most
    ``cap`` times the source's size, the excess going to the others by weight.

    Sources take ``weights`` in turn in code point order, null last. The level,
    target per weight, rises until no further source reaches its cap; each step
    brings two sums to the driver.
    """
    ordered = with_position(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_at")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = materialise(
        ordered.withColumn("_w", F.element_at(listed, (F.col("_at") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .drop("_at", "_last")
    )
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        capped = F.col("_w") * F.lit(level) >= F.col("_cap")
        got = rows.agg(
            F.count_if(capped).alias("full"),
            F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)).alias("given"),
            F.sum(F.when(~capped, F.col("_w"))).alias("open"),
        ).first()
        if got["full"] == full or not got["open"]:
            break
        full = got["full"]
        level = (float(share) * total - got["given"]) / got["open"]
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level))
    return rows.withColumn("target", target).drop("_w", "_cap")


def _drawn(seed: int) -> Column:
    """A number in (0, 1) from the id's text, the same in any SQL engine."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def _rank() -> Column:
    """Rank in [0, 1], increasing with random odds over inclusion odds; the cut lies near one half."""
    random, inclusion = F.col("_u") / (1 - F.col("_u")), F.col("_p") / (1 - F.col("_p"))
    return random / (random + inclusion)


def plan(rows: DataFrame, seed: int = 0, **rates) -> DataFrame:
    """One row per source: size, target, certain copies, inclusion probability and the cut."""
    sizes = rows.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sizes, **rates)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.withColumn("_whole", F.floor(copies)).withColumns(
        {
            "_rest": F.round(F.col("target")).cast("long") - F.col("_whole") * F.col("source_size"),
            "_p": copies - F.col("_whole"),
        }
    )
    wanted = materialise(wanted)
    open_rows = (
        rows.filter(F.col("size") > 0)
        .join(wanted.filter((F.col("_p") > 0) & (F.col("_rest") > 0)).select("_key", "_rest", "_p"), "_key")
        .withColumn("_u", _drawn(seed))
        .withColumn("_t", _rank())
        .withColumn("_b", F.floor(F.col("_t") * BUCKETS))
    )
    sums = open_rows.groupBy("_key", "_b").agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_b"))
    cut = (
        sums.withColumn("_before", upto - F.col("_sum"))
        .filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") >= F.col("_rest")))
        .select("_key", "_b", (F.col("_rest") - F.col("_before")).alias("_left"))
    )
    # Ranked: the rows of one bucket per source, equal draws summed first.
    equal = (
        open_rows.join(cut, ["_key", "_b"])
        .groupBy("_key", "_t", "doc_id", "size")
        .agg(F.sum("size").alias("_sum"), F.first("_left").alias("_left"))
    )
    order = Window.partitionBy("_key").orderBy("_t", "doc_id", "size")
    found = (
        equal.withColumn("_before", F.sum("_sum").over(order) - F.col("_sum"))
        .filter((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_sum") >= F.col("_left")))
        .select(
            "_key",
            F.col("_t").alias("_cut_t"),
            F.struct("doc_id", "size").alias("_cut"),
            F.when((F.col("_left") - F.col("_before")) * 2 >= F.col("_sum"), F.col("size")).otherwise(0).alias("_cut_take"),
        )
    )
    return materialise(wanted.join(found, "_key", "left").drop("source"))


def take(rows: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``taken``; no row depends on another one."""
    me, cut = F.struct("doc_id", "size"), F.col("_cut")
    sampled = (
        F.when(F.col("_cut_t").isNull(), 0)
        .when(F.col("_t") < F.col("_cut_t"), F.col("size"))
        .when(F.col("_t") > F.col("_cut_t"), 0)
        .when(me < cut, F.col("size"))
        .when(me.eqNullSafe(cut), F.col("_cut_take"))
        .otherwise(0)
    )
    placed = rows.join(plan, "_key").withColumn("_u", _drawn(seed)).withColumn("_t", _rank())
    taken = (F.col("_whole") * F.col("size") + sampled).cast("long")
    return placed.withColumn("taken", taken).drop("_key", "_whole", "_rest", "_p", "_u", "_t", "_cut_t", "_cut", "_cut_take")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
    **rates,
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken words of every document.

    ``rates`` are those of ``targets``. The sizes are written once, so texts are read once.
    """
    rows = materialise(measured(docs, id_col, text_col, source_col))
    return take(rows, plan(rows, seed, **rates), seed)


def mixed(docs: DataFrame, seed: int = 0, **rates) -> DataFrame:
    """The mix itself, in the columns of ``docs`` (doc_id, text, source and others).

    A document is repeated for each copy, with its whole text. Documents of which nothing is taken go,
    those without words too.
    """
    names = docs.columns
    columns = ("_doc.doc_id", "_doc.text", "_doc.source")
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    cuts = plan(materialise(measured(nested, *columns)), seed, **rates)
    out = take(measured(nested, *columns, "_doc"), cuts, seed).filter("taken > 0")
    copies = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return out.select("_doc", F.explode(copies)).select("_doc.*")
