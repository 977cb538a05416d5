"""Tab-separated files to typed frames and Parquet tables.

Fields are split at tabs, records at line feeds; one carriage return before the line feed is not data.
There is no quoting. A field that is \\N is null; an empty field is an empty text, or null in a column of
numbers. Types come from the whole file: int, then bigint, then double, then string, each the first that
fits every field; an integer beyond 64 bits makes its column a string. One scan finds the width, one the
types of all columns, one writes the table; where files have headers, each of these also finds the files' first lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGER = r"^[+-]?[0-9]+\z"
DOUBLE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
TYPES = ("int", "bigint", "double", "string")


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """(fields array<string>): one row per record; an empty line is a record with one empty field."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.split(F.regexp_replace("value", r"\r\z", ""), "\t", -1).alias("fields"))


def _field(k: int) -> Column:
    c = F.try_element_at("fields", F.lit(k + 1))
    return F.when(c != "\\N", c)


def infer(fields: DataFrame) -> list[str]:
    """A type of TYPES for each column; as many columns as the widest record has."""
    width = fields.agg(F.max(F.size("fields"))).first()[0] or 0
    if not width:
        return []
    checks = []
    for k in range(width):
        c = F.nullif(_field(k), F.lit(""))
        whole = c.rlike(INTEGER)
        checks += [
            F.count(c),
            F.coalesce(F.bool_and(F.coalesce(whole & c.try_cast("int").isNotNull(), F.lit(False)) | c.isNull()), F.lit(True)),
            F.coalesce(F.bool_and(F.coalesce(whole & c.try_cast("bigint").isNotNull(), F.lit(False)) | c.isNull()), F.lit(True)),
            F.coalesce(F.bool_and(F.coalesce(F.when(whole, c.try_cast("bigint").isNotNull()).otherwise(c.rlike(DOUBLE)), F.lit(False)) | c.isNull()), F.lit(True)),
        ]
    r = fields.agg(*(x.alias(f"c{j}") for j, x in enumerate(checks))).first()
    return ["string" if not r[4 * k] else next((t for t, fits in zip(TYPES, r[4 * k + 1 : 4 * k + 4], strict=False) if fits), "string") for k in range(width)]


def _without_headers(lines: DataFrame, header: str) -> DataFrame:
    """(value): the lines but for the first of each file, where that is the header.

    A file's first line has the smallest number among the lines of the file's first block, however many files
    share a partition. The table of first lines has a row for each file; Spark broadcasts it if it is small.
    """
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    starts = placed.where(F.col("block") == 0).groupBy("path").agg(F.min("id").alias("first")).select("first")
    body = placed.join(starts, F.col("id") == F.col("first"), "left")
    return body.where(F.col("first").isNull() | (F.regexp_replace("value", r"\r\z", "") != F.lit(header))).select("value")


def read_tsv(spark: SparkSession, path: str, header: bool = False, names: list[str] | None = None) -> DataFrame:
    """A typed frame. Names are the header's, else those given, else col0, col1, ...; short records end in nulls.

    With `header`, the first record names the columns, and every file may start with the same record.
    """
    fields = read_fields(spark, path)
    if header:
        first = fields.first()
        names = list(first[0]) if first else names
        body = _without_headers(spark.read.option("lineSep", "\n").text(path), "\t".join(first[0]) if first else "")
        fields = body.select(F.split(F.regexp_replace("value", r"\r\z", ""), "\t", -1).alias("fields"))
    kinds = infer(fields)
    names = [n if n else f"col{k}" for k, n in enumerate([*(names or []), *[""] * len(kinds)][: max(len(kinds), len(names or [])) if header else len(kinds)])]
    kinds += ["string"] * (len(names) - len(kinds))
    return fields.select(*((_field(k) if t == "string" else F.nullif(_field(k), F.lit("")).try_cast(t)).alias(n) for k, (n, t) in enumerate(zip(names, kinds, strict=True))))


def convert(spark: SparkSession, path: str, out: str, header: bool = False, names: list[str] | None = None, dict_threshold: int | None = None) -> DataFrame:
    """Write a TSV file as a Parquet table, in place of one that is there; returns the table.

    dict_threshold bounds the distinct values of a column that keeps a dictionary; it becomes the size of a
    dictionary page at 16 bytes a value. Parquet falls back to plain pages beyond it.
    """
    writer = read_tsv(spark, path, header, names).write.mode("overwrite")
    if dict_threshold is not None:
        writer = writer.option("parquet.dictionary.page.size", max(1024, 16 * dict_threshold)).option("parquet.enable.dictionary", str(dict_threshold > 0).lower())
    writer.parquet(out)
    return spark.read.parquet(out)
