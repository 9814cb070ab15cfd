"""Dropping lines that many documents share; DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased. Each
document's keys are hashed once and written, 12 bytes a line. Distinct keys per
document are counted with map-side sums, and the positions of frequent keys come
back per text. Documents are told apart by row, the texts to which positions
belong by a 128-bit fingerprint, so repeated ids and copies do no harm. Neither
a key nor a text that holds much of the data meets in one task: counts are
pre-aggregated, and both joins are equi-joins that adaptive execution splits.

Defined results: null text is the empty text, one empty line; each row counts as a
document, also where ids repeat or are null; a very long text is one row of keys; an empty table stays empty; result columns replace columns of the same
name, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biomeframe.llm.common import SPACE_CHARS, ascii_lower, unused
from biomeframe.session import materialise

MIN_DOCUMENTS, MIN_LENGTH = 10, 1


def keys_of(text: Column) -> Column:
    """Line keys of a text, in order."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)))


def _hashed(key: Column, min_length: int) -> Column:
    """96 bits of a key; null if the key is too short to be dropped."""
    return F.when(
        F.length(key) >= min_length, F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"))
    )


def _fingerprint(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def drop_frequent_lines(
    docs: DataFrame, text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH
) -> DataFrame:
    """``docs`` without the lines whose key is in at least ``min_documents`` documents.

    Keys shorter than ``min_length`` code points stay. Adds ``n_lines`` (before)
    and ``n_dropped``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.transform(keys_of(text), lambda key: _hashed(key, min_length))
    lines = materialise(docs.select(_fingerprint(text).alias("fp"), hashed.alias("keys")))
    present = lines.select(F.explode(F.array_distinct("keys")).alias("key")).filter("key IS NOT NULL")
    frequent = present.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents)
    # Stored, so that the join below reads both sides as they are and a frequent key can be split.
    frequent = materialise(frequent.select("key"))
    places = lines.select("fp", F.posexplode("keys").alias("at", "key")).filter("key IS NOT NULL")
    drops = materialise(
        places.join(frequent, "key").groupBy("fp").agg(F.collect_set("at").alias("_drops"))
    )
    fp, gone, split = (unused(name, docs.columns) for name in ("_fp", "_drops", "_lines"))
    marked = docs.withColumn(text_col, text).withColumn(fp, _fingerprint(F.col(text_col)))
    joined = marked.join(drops.select(F.col("fp").alias(fp), F.col("_drops").alias(gone)), fp, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    return (
        joined.withColumn(split, F.split(F.col(text_col), "\n", -1))
        .withColumn("n_lines", F.size(split).cast("long"))
        .withColumn("n_dropped", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept))
        .drop(fp, gone, split)
    )
