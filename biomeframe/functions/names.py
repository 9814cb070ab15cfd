"""Taxon and column name clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: any first character, one underscore, an optional second one.
RANK_PREFIX = r"(?s)^.__?"


def norm_taxon(name: Column | str, strict: bool = False) -> Column:
    """Lower-case, blanks to underscores, rank prefix (``g_``, ``g__``) removed.

    ``strict`` raises on one-character names, which carry no taxon.
    """
    column = F.col(name) if isinstance(name, str) else name
    flat = F.replace(F.lower(column), F.lit(" "), F.lit("_"))
    cleaned = F.regexp_replace(flat, RANK_PREFIX, "")
    if strict:
        too_short = F.length(flat) < 2
        cleaned = F.when(
            too_short, F.raise_error(F.concat(F.lit("taxon name too short: "), flat))
        ).otherwise(cleaned)
    return cleaned


def drop_trailing_blank(name: Column | str) -> Column:
    """Remove one trailing blank."""
    return F.regexp_replace(name, " $", "")


def drop_leading_blanks(name: Column | str) -> Column:
    """Remove all leading blanks."""
    return F.ltrim(name)


def tag(label: Column | str, suffix: str) -> Column:
    """``label`` and a split or study tag, separated by one blank."""
    return F.concat_ws(" ", label, F.lit(suffix))


def untag(tagged: Column | str) -> Column:
    """The label part of a tagged label."""
    return F.split_part(F.col(tagged) if isinstance(tagged, str) else tagged, F.lit(" "), F.lit(1))
