"""Audit of artifact digests against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import quoted, require_free_name, require_same_type

# Hash buckets counted for each shuffle partition, to find hot keys.
BUCKETS_PER_PARTITION = 8

_STATUS = """
CASE WHEN is_conflict IS NULL THEN 'UNLISTED'
     WHEN expected IS NULL THEN 'NO_DIGEST'
     WHEN is_conflict THEN 'CONFLICT'
     WHEN actual IS NULL THEN 'MISSING'
     WHEN actual = expected THEN 'OK'
     ELSE 'MISMATCH' END
"""


def _listed(manifest: DataFrame) -> DataFrame:
    """One row per listed key: its least digest, and whether there are others.

    Least and greatest digest are enough to see a conflict, so however often a
    name is listed, each map task sends one row for it.
    """
    return (
        manifest.groupBy(F.xxhash64("entry_key").alias("slot"), "entry_key")
        .agg(F.min("digest").alias("expected"), F.max("digest").alias("greatest"))
        .selectExpr(
            "slot", "entry_key", "expected", "coalesce(expected <> greatest, false) AS is_conflict"
        )
    )


def _hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """`hot_key`: the keys of `rows` with more than an average partition of them, exactly.

    There are fewer of those than shuffle partitions. Reads the key column only.
    Counting hash buckets first costs a few rows per task and bucket instead of a
    shuffle of all keys; without a hot bucket, adaptive execution drops the rest.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(
        quoted(key).alias("hot_key"),
        F.pmod(F.xxhash64(quoted(key)), F.lit(partitions * BUCKETS_PER_PARTITION)).alias("bucket"),
    ).where("hot_key IS NOT NULL")
    hot_buckets = (
        keyed.groupBy("bucket")
        .agg(F.expr("count(*)").alias("n"))
        .selectExpr("bucket", "n", f"sum(n) OVER (PARTITION BY 0) / {partitions} AS limit")
        .where("n > limit")
        .select("bucket", "limit")
    )
    return (
        keyed.join(F.broadcast(hot_buckets), "bucket")
        .groupBy("hot_key")
        .agg(F.expr("count(*) > max(limit)").alias("is_hot"))
        .where("is_hot")
        .select("hot_key")
    )


def audit(manifest: DataFrame, digests: DataFrame, key: str) -> DataFrame:
    """`(key, expected, actual, status)`: every artifact, and every entry without one.

    Both inputs have `key` and `digest` columns. Manifest rows without a key,
    malformed lines among them, are left to `is_malformed`. Several artifacts
    under one key are one row each. For a `CONFLICT`, `expected` is the least
    digest listed; a key listed without any digest is `NO_DIGEST`.

    A full outer join with one shuffle per side, of digests and never of content.
    Spark cannot split one key of a full outer join between tasks, so artifacts
    under a hot key bring what the manifest lists for it along, from a broadcast
    of those few keys, and go through the join unmatched, spread over its tasks.
    So do artifacts without a key. Their entries are kept out of the join: a hot
    key has artifacts, so it cannot be missing.
    """
    require_free_name(key, ("expected", "actual", "status"))
    require_same_type(manifest, digests, key)
    entries = manifest.select(quoted(key).alias("entry_key"), "digest").where("entry_key IS NOT NULL")
    hot_keys = _hot_keys(digests, key)
    # Marked by an outer join, which stays above the aggregation: so both halves
    # read the same shuffle, and the manifest is scanned and digested once.
    marked = _listed(entries).join(F.broadcast(hot_keys), F.expr("entry_key = hot_key"), "left")
    listed = marked.where("hot_key IS NULL").drop("hot_key")
    hot_listed = hot_keys.join(
        marked.where("hot_key IS NOT NULL").drop("hot_key"), F.expr("entry_key = hot_key"), "left"
    ).selectExpr("hot_key", "struct(hot_key AS key, expected, is_conflict) AS hot")

    # Rows go to slots by key or, unmatched, by their own digest and the id of
    # their partition, which stays the same when a task is run again.
    by_key = F.expr("hot_key IS NULL AND artifact_key IS NOT NULL")
    spread = F.xxhash64(F.spark_partition_id(), "actual")
    artifacts = (
        digests.select(quoted(key).alias("artifact_key"), F.col("digest").alias("actual"))
        .join(F.broadcast(hot_listed), F.expr("artifact_key = hot_key"), "left")
        .select(
            F.when(by_key, F.xxhash64("artifact_key")).otherwise(spread).alias("slot"),
            F.expr("CASE WHEN hot_key IS NULL THEN artifact_key END AS entry_key"),
            "actual",
            "hot",
        )
    )
    return (
        artifacts.join(listed, ["slot", "entry_key"], "full_outer")
        .selectExpr(
            "coalesce(hot.key, entry_key) AS key",
            "coalesce(hot.expected, expected) AS expected",
            "actual",
            "coalesce(hot.is_conflict, is_conflict) AS is_conflict",
        )
        .select(F.col("key").alias(key), "expected", "actual", F.expr(_STATUS).alias("status"))
    )


def audit_summary(audited: DataFrame) -> DataFrame:
    """`(status, n)` of an audit's rows, counted before the shuffle."""
    return audited.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
