"""SHA-256 of columns, and of files too large to be one row."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formats import DIGEST_BITS
from .stores import StoreOptions, Stores

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 8 * 1024 * 1024


def sha256(content: Column | str) -> Column:
    """Lowercase hex SHA-256; text counts as its UTF-8 bytes, NULL stays NULL."""
    return F.sha2(content, DIGEST_BITS)


def digest(df: DataFrame, content_col: str) -> DataFrame:
    """`df` with a `digest` column. A narrow projection: no row moves."""
    return df.withColumn("digest", sha256(content_col))


def _digest_file(path: str, stores: Stores) -> str:
    running = hashlib.sha256()
    with stores.open(path) as stream:
        while chunk := stream.read(CHUNK_BYTES):
            running.update(chunk)
    return running.hexdigest()


def digest_of_path(path: Column | str, options: StoreOptions | None = None) -> Column:
    """SHA-256 of the file at each path, read in chunks by the task that has the row.

    SHA-256 runs through a file from front to back, so one file is one task's
    work, but never more than a chunk of its memory. A scalar function rather
    than `mapInPandas`, so that Catalyst drops it where the digest is not used.
    `options` are those of `Stores`.
    """

    @F.pandas_udf(T.StringType())
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stores = Stores(options)
        for paths in batches:
            yield paths.map(lambda path: _digest_file(path, stores), na_action="ignore")

    return digests(path)
