"""The whole check of a publication: its manifests against its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import digest_of_path
from ..functions.stores import StoreOptions
from ..operators.audit import audit
from ..sources.files import digest_files
from ..sources.manifest import read_manifest

RESULT = ("file_name", "expected", "actual", "status", "line")


def _with_malformed(audited: DataFrame, manifest: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    malformed = manifest.where("is_malformed").select(
        none.alias("file_name"), none.alias("expected"), none.alias("actual"),
        F.lit("MALFORMED").alias("status"), "line",
    )
    return audited.withColumn("line", none).select(*RESULT).unionByName(malformed)


def audit_files(
    spark: SparkSession,
    manifest_path: str | list[str],
    artifacts_path: str,
    options: StoreOptions | None = None,
) -> DataFrame:
    """`(file_name, expected, actual, status, line)` of files against manifest files.

    Names are relative to `artifacts_path`; a manifest in a folder below it is
    about that folder. A line that is no entry is a row of its own, `MALFORMED`,
    with its text in `line`. Manifests below `artifacts_path` are artifacts like
    any other file there.
    """
    manifest = read_manifest(spark, manifest_path, root=artifacts_path)
    audited = audit(manifest, digest_files(spark, artifacts_path, options), "file_name")
    return _with_malformed(audited, manifest)


def audit_inventory(
    manifest: DataFrame,
    inventory: DataFrame,
    *,
    path_col: str = "path",
    name_col: str = "file_name",
    tasks: int | None = None,
    options: StoreOptions | None = None,
) -> DataFrame:
    """As `audit_files`, for files named in a table, so that no folder is listed.

    `inventory` has the path to read and the name a manifest knows it by. Its
    rows are dealt evenly over `tasks` before files are opened.
    """
    spark = inventory.sparkSession
    named = inventory.select(F.col(name_col).alias("file_name"), F.col(path_col).alias("path"))
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = named.repartition(tasks).select("file_name", digest_of_path("path", options).alias("digest"))
    return _with_malformed(audit(manifest, digests, "file_name"), manifest)
