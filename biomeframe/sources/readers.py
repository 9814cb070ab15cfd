"""Study-specific layouts into wide or long abundance tables.

Layouts with samples in columns are read as text: each line becomes an array of fields, and its
cells meet the sample ids of the header line by position, so any number of samples makes the same plan.
Layouts with samples in rows take their schema from the header line, which reaches the driver.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biomeframe.functions.names import drop_leading_blanks
from biomeframe.session import materialise


def _line(spark: SparkSession, path: str, sep: str, number: int = 0) -> list[str]:
    """Fields of one of the first lines of a file."""
    head = spark.read.text(path).limit(number + 1).collect()
    return next(csv.reader([head[number]["value"]], delimiter=sep))


def _csv(
    spark: SparkSession, path: str, sep: str, schema: T.StructType, header: bool, strict: bool = False
) -> DataFrame:
    """A delimited file with as many columns as ``schema``; ``strict`` raises on cells of another type."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    reader = spark.read.options(maxColumns=max(20_480, len(schema) + 8), mode=mode)
    return reader.csv(path, header=header, sep=sep, schema=schema, enforceSchema=True)


def _number(raw: Column, strict: bool) -> Column:
    """A count; blank is null. Any other text is null too, or an error if ``strict``."""
    value = raw.try_cast("double")
    if not strict:
        return value
    bad = value.isNull() & (F.trim(raw) != "")
    return F.when(bad, F.raise_error(F.concat(F.lit("not a count: "), raw)).cast("double")).otherwise(value)


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_wide(
    spark: SparkSession,
    path: str,
    text_columns: list[str] = ("sampleID", "HC_subCST"),
    sep: str = ",",
    strict: bool = True,
) -> DataFrame:
    """Samples in rows, header line; every column but ``text_columns`` is numeric.

    A cell that is no number raises when it is read; with ``strict=False`` it becomes null.

    The schema comes from the header line, so the data is not scanned to infer it.
    Repeated names get a numeric suffix after the first.
    """
    header = _unique(_line(spark, path, sep))
    text = set(text_columns)
    fields = [T.StructField(n, T.StringType() if n in text else T.DoubleType()) for n in header]
    return _csv(spark, path, sep, T.StructType(fields), True, strict)


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if k == 0 else f"{n}.{k}")
    return out


def _explode_columns(
    df: DataFrame, keep: list[Column], columns: list[str], names: list[str], key: str, strict: bool = True
) -> DataFrame:
    values = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    at = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_pos") + 1)
    return df.select(*keep, F.posexplode(values).alias("_pos", "_raw")).select(
        "*", at.alias(key), _number(F.col("_raw"), strict).alias("count")
    )


def wide_to_long(wide: DataFrame, not_taxa: list[str] = ("read_count", "HC_subCST"), sample: str = "sampleID") -> DataFrame:
    """Wide table to ``sampleID, taxon, pos, count``; ``pos`` is the column order."""
    taxa = [c for c in wide.columns if c != sample and c not in set(not_taxa)]
    long = _explode_columns(wide, [F.col(sample).alias("sampleID")], taxa, taxa, "taxon")
    return long.select("sampleID", "taxon", F.col("_pos").alias("pos"), "count")


def _fields(line: Column, sep: str) -> Column:
    """Fields of a delimited line; quoted ones may hold the separator, and quotes doubled. Empty fields are null."""
    plain = F.split(line, re.escape(sep), -1)
    one = re.escape(sep)
    # Possessive, so that a long quoted field needs no backtracking; the separator in front makes every field a match.
    pattern = f'{one}(?:"([^"]*+(?:""[^"]*+)*+)"[^{one}]*+|([^{one}]*+))'
    led = F.concat(F.lit(sep), line)
    quoted = F.regexp_extract_all(led, F.lit(pattern), F.lit(1))
    bare = F.regexp_extract_all(led, F.lit(pattern), F.lit(2))
    either = F.zip_with(quoted, bare, lambda q, b: F.when(b == "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(b))
    found = F.when(F.contains(line, F.lit('"')), either).otherwise(plain)
    return F.transform(found, lambda f: F.nullif(f, F.lit("")))


def _positioned(
    spark: SparkSession, path: str, sep: str, skip_lines: int = 0, header_from: int = 1, body_from: int = 1
) -> tuple[DataFrame, DataFrame]:
    """A file with samples in columns as two tables: header (``_pos``, ``sampleID``) and body (``_name``, ``_values``).

    Ids stand in the header line from field ``header_from``, counts in the others from field ``body_from``; equal
    ``_pos`` belong together. Nothing of the header enters the plan, so it does not grow with the samples.
    Part files of one table repeat the title and header lines; lines equal to these are passed over, as are
    blank ones. A field may not hold a line break. Values of missing fields are null.
    """
    lines = spark.read.text(path)
    # Partition 0 begins with the first block of a file, so its first lines are the header lines. Written,
    # so that measured sizes decide how they are joined.
    numbered = lines.select("value", F.monotonically_increasing_id().alias("_line"))
    heads = materialise(numbered.filter(F.col("_line") <= skip_lines))
    ids = heads.filter(F.col("_line") == skip_lines)
    header = materialise(
        ids.select(F.posexplode(F.slice(_fields(F.col("value"), sep), header_from + 1, 1 << 30)).alias("_pos", "sampleID"))
    )
    last = header.agg(F.coalesce(F.max("_pos") + 1, F.lit(0)).alias("n"))
    rest = lines.filter(F.length(F.trim("value")) > 0).join(heads.select("value"), "value", "left_anti")
    fields = rest.select(_fields(F.col("value"), sep).alias("f"))
    values = F.slice("f", body_from + 1, 1 << 30)
    missing = F.array_repeat(F.lit(None).cast("string"), F.greatest(F.col("_n") - F.size(values), F.lit(0)))
    body = fields.withColumn("_n", last.scalar()).select(F.get("f", F.lit(0)).alias("_name"), F.concat(values, missing).alias("_values"))
    return header, body


def _cells(header: DataFrame, body: DataFrame, strict: bool) -> DataFrame:
    """``sampleID``, ``_name``, ``_raw`` and ``count`` of every field below an id."""
    each = body.select("_name", F.posexplode("_values").alias("_pos", "_raw"))
    joined = each.join(header, "_pos")
    return joined.select("sampleID", "_name", "_raw", _number(F.col("_raw"), strict).alias("count"))


def read_transposed(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    skip_lines: int = 0,
    meta_rows: list[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Samples in columns to long form; the first column holds the taxon.

    ``skip_lines`` title lines stand above the line with the ids. Lines named in
    ``meta_rows`` are left out; :func:`read_meta_rows` returns them. A cell that is
    no count raises, or is null with ``strict=False``.
    """
    header, body = _positioned(spark, path, sep, skip_lines)
    taxa = body.filter(~F.coalesce(F.col("_name").isin(*meta_rows), F.lit(False))) if meta_rows else body
    return _cells(header, taxa, strict).select("sampleID", F.col("_name").alias("taxon"), "count")


def read_meta_rows(spark: SparkSession, path: str, meta_rows: list[str], sep: str = ",", skip_lines: int = 0) -> DataFrame:
    """Sample annotations laid out as lines of a transposed file: one column per line name."""
    header, body = _positioned(spark, path, sep, skip_lines)
    rows = _cells(header, body.filter(F.col("_name").isin(*meta_rows)), strict=False)
    return rows.groupBy("sampleID").pivot("_name", list(meta_rows)).agg(F.first("_raw"))


def read_otu_supplement(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Supplement with a title line above the line ``species, id, id, ...``."""
    return read_transposed(spark, path, skip_lines=1, strict=strict)


def read_ragged_tsv(
    spark: SparkSession, path: str, drop: str = "taxID", strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Header one field shorter than the lines, whose first field is the taxon.

    Returns long counts without the ``drop`` column and each sample's read count.
    """
    header, body = _positioned(spark, path, "\t", header_from=0)
    kept = header.filter(~F.col("sampleID").eqNullSafe(F.lit(drop)))
    cells = _cells(kept, body, strict)
    long = cells.select("sampleID", drop_leading_blanks("_name").alias("taxon"), "count")
    depth = F.coalesce(F.sum("count"), F.lit(0.0)).alias("read_count")
    return long, long.groupBy("sampleID").agg(depth)


def read_taxon_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One taxon per line; field 0 is its name, field 1 is ignored, line 0 holds the ids."""
    header, body = _positioned(spark, path, "\t", header_from=2, body_from=2)
    return _cells(header, body, strict).select("sampleID", F.col("_name").alias("taxon"), "count")


def read_tsv_labelled(
    spark: SparkSession,
    path: str,
    label: str = "diagnosis_binary",
    drop: list[str] = ("family_id", "role"),
    strict: bool = True,
) -> DataFrame:
    """Samples in rows, blank first header, a diagnosis column as label."""
    header = ["sampleID" if i == 0 else h for i, h in enumerate(_line(spark, path, "\t"))]
    text = {"sampleID", label, *drop}
    fields = [T.StructField(n, T.StringType() if n in text else T.DoubleType()) for n in header]
    wide = _csv(spark, path, "\t", T.StructType(fields), True, strict)
    return wide.drop(*drop).withColumnRenamed(label, "HC_subCST")
