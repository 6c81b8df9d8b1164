"""Files below a folder, and their digests."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import digest_of_path
from ..functions.shared import stash
from ..functions.stores import StoreOptions, Stores, split_path

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FOUND = "path string, root string, is_folder boolean, length long"


def _absolute(spark: SparkSession, path: str) -> str:
    """`path` as tasks take it: one without a scheme belongs to the session's default
    file system where Spark's own settings name one, else to the local one."""
    if re.fullmatch(r"[^/]+://[^/]+", path):
        path += "/"
    scheme, _, name = split_path(path)
    default = spark.conf.get("spark.hadoop.fs.defaultFS", None)
    named = path if scheme or not default else default.rstrip("/") + path
    return named if name == "/" else named.rstrip("/")


def list_files(
    spark: SparkSession, path: str | list[str], options: StoreOptions | None = None
) -> DataFrame:
    """`(path, root, length)` of every file in and below `path`, hidden and empty ones too.

    The tree is listed when this is called, a level at a time; the folders of
    each level are spread over all tasks, and each is listed once. The levels
    are kept in the shared folder. Nothing passes through the driver, and no
    name is a pattern.
    """
    roots = [_absolute(spark, root) for root in ([path] if isinstance(path, str) else path)]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores = Stores(options)
        for batch in batches:
            for folder, root in zip(batch["path"], batch["root"], strict=True):
                rows = [(found, root, *rest) for found, *rest in stores.children(folder)]
                yield pd.DataFrame(rows, columns=["path", "root", "is_folder", "length"])

    folders = spark.createDataFrame([(root, root) for root in roots], "path string, root string")
    files = None
    while True:
        level = stash(folders.repartition(tasks).mapInPandas(children, _FOUND))
        found = level.where("NOT is_folder").select("path", "root", "length")
        files = found if files is None else files.unionByName(found)
        folders = level.where("is_folder").select("path", "root")
        if folders.isEmpty():
            return files


def relative_name(path: str = "path", root: str = "root"):
    """A file's name from its root on; the last part of the path if it is the root itself."""
    return F.expr(
        f"CASE WHEN {path} = {root} THEN substring_index({path}, '/', -1)"
        f" ELSE substring({path}, length(trim(TRAILING '/' FROM {root})) + 2) END"
    )


def digest_files(
    spark: SparkSession, path: str | list[str], options: StoreOptions | None = None
) -> DataFrame:
    """`(file_name, length, digest)` of every file in and below `path`, of any size.

    `file_name` is relative to the path given, so it is the bare name in a flat
    folder. Files are dealt evenly over tasks and streamed through them. Bounded
    by what one folder lists; where a folder is too large for that, bring an
    inventory table and use `digest_of_path`.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        list_files(spark, path, options)
        .repartition(tasks)
        .select(relative_name().alias("file_name"), "length", digest_of_path("path", options).alias("digest"))
    )
