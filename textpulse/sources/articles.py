"""Articles and their metadata: CSV in and out, failed-page filter, back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = "Url STRING, Source STRING, Bias STRING, Quality STRING"

# What a failed fetch leaves behind in the text.
FAILED_MARKER = "FAILED_TO_LOAD_PAGE"
FAILED_PATTERN = "403|Forbidden|FAILED_TO_LOAD_PAGE"

_CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "lineSep": "\n",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: str = METADATA_SCHEMA, multiline: bool = False) -> DataFrame:
    """Delimited text with a header and an explicit schema, as ``write_csv`` leaves it: one line per row, so files split.

    ``multiline`` is for files of others whose quoted fields span lines; each is one task then, and nothing is unescaped.
    """
    rows = spark.read.schema(schema).options(**_CSV, multiLine=multiline).csv(path)
    return rows if multiline else rows.select(*[_unescaped(f.name).alias(f.name) if f.dataType.typeName() == "string" else f.name
                                                for f in rows.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """Line breaks and backslashes inside strings are escaped, so that a row is a line."""
    lines = df.select(*[_escaped(f.name).alias(f.name) if f.dataType.typeName() == "string" else f.name for f in df.schema.fields])
    lines.write.mode("overwrite").options(**_CSV, quoteAll=True).csv(path)


def _escaped(name: str) -> Column:
    out = F.col(name)
    for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def _unescaped(name: str) -> Column:
    """Double backslashes part the pieces in which the other codes are read."""
    pieces = F.transform(F.split(name, r"\\\\", -1), lambda p: F.replace(
        F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(pieces, "\\")


def without_failed_pages(articles: DataFrame, text: str = "text", pattern: str = FAILED_PATTERN) -> DataFrame:
    """Drop rows whose text shows a failed fetch anywhere; rows without text are kept."""
    return articles.where(~F.coalesce(F.col(text).rlike(pattern), F.lit(False)))


def backfill(articles: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set ``columns`` from the metadata table where it has a value, else keep the stored one."""
    fresh = metadata.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = articles.join(fresh, key, "left")
    return joined.select(
        *[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in articles.columns]
    )
