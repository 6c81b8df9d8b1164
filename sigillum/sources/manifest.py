"""Checksum manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import (
    DIGEST_HEX_LENGTH,
    ENTRY_PATTERN,
    NOT_BLANK_PATTERN,
    SEPARATOR,
)
from ..functions.stores import split_path

# A name may not be longer than a line, whatever that is.
_TO_END = 2**31 - 1


def parse_manifest(
    lines: DataFrame, line_col: str = "value", prefix_col: str | None = None
) -> DataFrame:
    """`(digest, file_name, line, is_malformed)` of every line that is not blank.

    A line of any other form than an entry keeps its text, with NULL digest and
    name. The scan shuffles nothing; equal entries are left to `entries` and to
    the aggregations of the audit and the cross-check. `prefix_col` goes in front
    of a line's name.
    """
    line = F.col(line_col)
    prefix = F.col(prefix_col) if prefix_col else F.lit("")
    name_start = DIGEST_HEX_LENGTH + len(SEPARATOR) + 1
    return (
        lines.where(line.rlike(NOT_BLANK_PATTERN))
        .select(line.alias("line"), line.rlike(ENTRY_PATTERN).alias("is_entry"), prefix.alias("prefix"))
        .select(
            F.when(F.col("is_entry"), F.substring("line", 1, DIGEST_HEX_LENGTH)).alias("digest"),
            F.when(
                F.col("is_entry"), F.concat("prefix", F.substring("line", name_start, _TO_END))
            ).alias("file_name"),
            "line",
            (~F.col("is_entry")).alias("is_malformed"),
        )
    )


def _name_of(path: str) -> str:
    """SQL: the unescaped path, without scheme and authority, of an escaped URI."""
    unescaped = f"url_decode(replace({path}, '+', '%2B'))"
    return f"regexp_replace({unescaped}, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?', '')"


def read_manifest(
    spark: SparkSession, path: str | list[str], *, root: str | None = None
) -> DataFrame:
    """Scan manifest files, folders or globs; large plain files are split between tasks.

    With a `root`, names are relative to it: an entry of a manifest in a folder
    below `root` gets that folder in front. A manifest that lies elsewhere names
    files of `root` itself.
    """
    if root is None:
        return parse_manifest(spark.read.text(path))
    below = split_path(root)[2].rstrip("/") + "/"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"))
    folder = F.expr(f"regexp_extract({_name_of('source')}, '(?s)^(.*/)[^/]*$', 1)")
    inside = F.substring("folder", len(below) + 1, _TO_END)
    prefix = F.when(F.col("folder").startswith(below), inside).otherwise("")
    return parse_manifest(
        lines.select(F.col("value"), folder.alias("folder")).select("value", prefix.alias("prefix")), "value", "prefix"
    )


def entries(manifest: DataFrame) -> DataFrame:
    """`(digest, file_name)` of the entries, equal ones once."""
    return manifest.where("NOT is_malformed").select("digest", "file_name").distinct()
