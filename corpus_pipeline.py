"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

Each stage returns the columns of ``documents`` (the last one pieces of sequences), further columns stay as they are,
whatever their names. An empty table gives an empty one. Rows with a null id are judged as every
other row; repeated rows too, and the near-copy stage leaves one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biomeframe.llm import jaccard, lines, mix, pack, quality
from biomeframe.llm.common import held_out, table
from biomeframe.session import materialise


def _in_columns_of(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` in the columns of ``docs``, with ``n_chars`` of the new text."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.length("text").cast(kind))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, does not reject. Null and empty texts are scored
    by their statistics like any other; without labels nothing is rejected, labels of one kind say so of all."""
    measured = quality.stored(docs.filter(~held_out("doc_id")))
    return quality.keep(docs, quality.fit(measured, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share. Null texts become empty ones; no row goes."""
    return _in_columns_of(docs, lines.drop_frequent_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id. Texts without words, null ones
    among them, are no copies of one another."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that sources reach their targets, always with their whole text.
    Documents without words go; a null source is a source of its own."""
    return _in_columns_of(docs, mix.mixed(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; copies of a document are pieces of their own."""
    return pack.stored(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

# The first stage trains a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
