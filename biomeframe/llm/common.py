"""Word and line rules that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biomeframe.session import arrow_rows  # noqa: F401

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def give_back() -> None:
    """Memory this Python worker has freed, back to the system: workers outlive tasks and stages, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    # Only glibc keeps freed memory and has this call.
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def held_out(doc_id: Column | str, remainder: int = 0) -> Column:
    """True where crc32 of the id's text leaves ``remainder`` modulo 5. A null id counts as the empty text."""
    key = F.coalesce(col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 == remainder


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it, also not in other letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
