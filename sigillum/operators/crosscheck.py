"""Digests published in pages, checked against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import PUBLISHED_PATTERN
from .keys import quoted, require_free_name
from .lookup import lookup


def published_digests(pages: DataFrame, page_key: str, html_col: str = "html") -> DataFrame:
    """`(page_key, published)`: one row per digest occurrence in the whole page."""
    require_free_name(page_key, ("published",))
    found = F.regexp_extract_all(quoted(html_col), F.lit(PUBLISHED_PATTERN), F.lit(1))
    return pages.select(quoted(page_key), F.explode(found).alias("published"))


def crosscheck(
    pages: DataFrame, manifest: DataFrame, page_key: str, html_col: str = "html"
) -> DataFrame:
    """`(page_key, published, file_name, in_manifest)` per digest occurrence.

    A page does not say which file a digest belongs to, so only membership is
    tested. If several names share the digest, `file_name` is the least.
    """
    require_free_name(page_key, ("published", "file_name", "in_manifest"))
    names = manifest.groupBy(F.col("digest").alias("published")).agg(
        F.min("file_name").alias("file_name"), F.lit(True).alias("in_manifest")
    )
    return lookup(published_digests(pages, page_key, html_col), names, "published").select(
        quoted(page_key),
        "published",
        "file_name",
        F.coalesce("in_manifest", F.lit(False)).alias("in_manifest"),
    )
