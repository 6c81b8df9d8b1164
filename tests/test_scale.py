"""The plans that hold at scale: what is read, what is shuffled, what is split."""

import re
from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sigillum import audit, audit_files, crosscheck, digest, digest_files
from sigillum.operators.audit import _hot_keys

PAGES = "/root/testdata/sf0.01/pages.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    return plan(df).split("Initial Plan")[0]


@contextmanager
def settings(spark, **values):
    names = {name: f"spark.sql.{name.replace('__', '.')}" for name in values}
    before = {name: spark.conf.get(key, None) for name, key in names.items()}
    for name, key in names.items():
        spark.conf.set(key, values[name])
    try:
        yield
    finally:
        for name, key in names.items():
            if before[name] is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before[name])


@pytest.fixture
def large_tables(spark):
    """As on a cluster: nothing is small enough to broadcast, and 16 KiB is a large partition."""
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        shuffle__partitions="128",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="16k",
        adaptive__advisoryPartitionSizeInBytes="16k",
        adaptive__coalescePartitions__enabled="false",
    ):
        yield


def stored(spark, tmp_path, name, df):
    """Read back from parquet, so that no input has a partitioning to build on."""
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_digest(column):
    return F.sha2(F.col(column).cast("string"), 256)


@pytest.mark.parametrize("hot_key", ["listed", "unlisted", "null"])
def test_hot_artifact_key_is_spread_and_counted_whole(spark, tmp_path, large_tables, hot_key):
    n, tasks = 30000, 12
    value = {"listed": F.lit(0), "unlisted": F.lit(-1), "null": F.lit(None)}[hot_key]
    artifacts = stored(
        spark, tmp_path, "artifacts",
        spark.range(0, n, 1, tasks).select(
            F.when(F.col("id") % 3 == 0, value).otherwise(F.col("id")).cast("long").alias("key"),
            text_digest("id").alias("digest"),
        ),
    )
    manifest = stored(
        spark, tmp_path, "manifest",
        spark.range(0, n + 5, 1, 8).select(F.col("id").alias("key"), text_digest("id").alias("digest")),
    )
    audited = audit(manifest, artifacts, "key")
    by_task = audited.groupBy(F.spark_partition_id().alias("task"), "status").count().collect()
    found = Counter()
    for row in by_task:
        found[row.status] += row["count"]
    hot = n // 3
    assert found == {
        "listed": {"OK": n - hot + 1, "MISMATCH": hot - 1, "MISSING": hot - 1 + 5},
        "unlisted": {"OK": n - hot, "UNLISTED": hot, "MISSING": hot + 5},
        "null": {"OK": n - hot, "UNLISTED": hot, "MISSING": hot + 5},
    }[hot_key]
    rows_of_task = Counter()
    for row in by_task:
        rows_of_task[row.task] += row["count"]
    assert max(rows_of_task.values()) < 3 * sum(rows_of_task.values()) / 128


def test_hot_copies_are_spread_by_the_task_that_read_them(spark, tmp_path, large_tables):
    """Equal rows, so that nothing in them tells one from another."""
    n, tasks = 40000, 40
    copies = spark.range(0, n, 1, tasks).select(
        F.lit("copy").alias("key"), F.sha2(F.lit("copy"), 256).alias("digest")
    )
    manifest = copies.limit(1)
    audited = audit(manifest, copies, "key")
    by_task = audited.groupBy(F.spark_partition_id().alias("task"), "status").count().collect()
    assert {row.status for row in by_task} == {"OK"}
    assert sum(row["count"] for row in by_task) == n
    assert max(row["count"] for row in by_task) <= n // 8


@pytest.mark.parametrize("partitions", [4, 50])
def test_keys_of_more_than_an_average_partition_are_hot(spark, partitions):
    counts = {"a": 500, "b": 251, "c": 250, "d": 40, "e": 39, "f": 20, "g": 1, None: 1000}
    counts |= {f"rest {k}": 1 for k in range(1000 - sum(n for key, n in counts.items() if key))}
    rows = spark.createDataFrame([(key,) for key, n in counts.items() for _ in range(n)], "key string")
    average = sum(n for key, n in counts.items() if key) / partitions
    with settings(spark, shuffle__partitions=str(partitions)):
        found = {row.hot_key for row in _hot_keys(rows, "key").collect()}
    assert found == {key for key, n in counts.items() if key and n > average}
    assert len(found) < partitions


@pytest.mark.parametrize("partitions", ["16", "64"])
def test_no_key_stays_unsplit_above_twice_an_average_partition(spark, tmp_path, partitions):
    """The joined rows of each task, with keys of all sizes, at several numbers of partitions."""
    n = 60000
    with settings(
        spark, shuffle__partitions=partitions, autoBroadcastJoinThreshold="-1",
        adaptive__coalescePartitions__enabled="false",
    ):
        artifacts = stored(
            spark, tmp_path, f"artifacts {partitions}",
            spark.range(0, n, 1, 16).select(
                F.floor(F.lit(300) * F.pow(F.rand(5), 3)).cast("long").alias("key"), text_digest("id").alias("digest")
            ),
        )
        manifest = stored(
            spark, tmp_path, f"manifest {partitions}",
            spark.range(0, 300).select(F.col("id").alias("key"), text_digest("id").alias("digest")),
        )
        hot = {row.hot_key for row in _hot_keys(artifacts, "key").collect()}
        counts = {row.key: row["count"] for row in artifacts.groupBy("key").count().collect()}
        assert hot and max(c for key, c in counts.items() if key not in hot) <= 2 * n / int(partitions)
        audited = audit(manifest, artifacts, "key")
        tasks = audited.groupBy(F.spark_partition_id().alias("task")).count().collect()
        missing = len(set(range(300)) - set(counts))
        assert sum(row["count"] for row in tasks) == n + missing


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_content_is_scanned_once_a_side_with_a_hot_key(spark, tmp_path, large_tables, adaptive):
    """Also the manifest's, though hot and other keys go different ways."""
    pages = spark.range(0, 20000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"), F.col("id").cast("string").alias("html")
    )
    artifacts, listed = (stored(spark, tmp_path, name, pages) for name in ("artifacts", "manifest"))
    with settings(spark, adaptive__enabled=adaptive):
        audited = audit(digest(listed, "html"), digest(artifacts, "html"), "key")
        assert audited.count() == 20000
        audited.collect()
        finished = final_plan(audited)
    assert len(re.findall(r"sha2\(", finished)) == 2
    with_content = re.findall(r"ReadSchema: struct<key:bigint,html:string>", finished)
    assert len(with_content) == 2


def test_ordinary_keys_cost_one_shuffle_of_each_side(spark, tmp_path, large_tables):
    """Without a hot key the finished plan is a plain full outer join."""
    n = 20000
    rows = spark.range(0, n, 1, 8).select(F.col("id").alias("key"), text_digest("id").alias("digest"))
    artifacts, manifest = (stored(spark, tmp_path, name, rows) for name in ("artifacts", "manifest"))
    audited = audit(manifest, artifacts, "key")
    assert len(audited.collect()) == n
    finished = final_plan(audited)
    assert finished.count("Exchange hashpartitioning") == 2
    assert finished.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in finished
    # The manifest's shuffle is made once, for hot and other keys, and shown as reused.
    assert finished.count("Scan parquet") + finished.count("ReusedExchange") == 2


def test_hot_published_digest_is_split_and_counted_whole(spark, tmp_path, large_tables):
    n = 30000
    pages = stored(
        spark, tmp_path, "pages",
        spark.range(0, n, 1, 8).select(
            F.col("id").alias("page_id"),
            F.concat(
                F.lit("<code>"),
                F.when(F.col("id") % 3 == 0, F.sha2(F.lit("hot"), 256)).otherwise(text_digest("id")),
                F.lit("</code>"),
            ).alias("html"),
        ),
    )
    manifest = stored(
        spark, tmp_path, "manifest",
        spark.range(0, n, 1, 8).select(
            F.when(F.col("id") == 0, F.sha2(F.lit("hot"), 256)).otherwise(text_digest("id")).alias("digest"),
            F.col("id").cast("string").alias("file_name"),
        ),
    )
    found = (
        crosscheck(pages, manifest, "page_id")
        .groupBy("in_manifest", (F.col("file_name") == "0").alias("is_hot"))
        .agg(F.count("*"), F.sum("page_id"))
    )
    hot_sum = sum(range(0, n, 3))
    assert sorted(map(tuple, found.collect())) == [
        (True, False, n - n // 3, sum(range(n)) - hot_sum),
        (True, True, n // 3, hot_sum),
    ]
    assert "SortMergeJoin(skew=true)" in final_plan(found)


def test_hot_manifest_key_is_combined_before_the_shuffle(spark, tmp_path, large_tables):
    """A name listed any number of times leaves each map task as one row."""
    tasks = 8
    manifest = stored(
        spark, tmp_path, "manifest",
        spark.range(0, 40000, 1, tasks).select(
            F.lit("hot").alias("key"), F.sha2((F.col("id") % 1000).cast("string"), 256).alias("digest")
        ),
    )
    artifacts = spark.createDataFrame([("hot", None)], "key string, digest string")
    audited = audit(manifest, artifacts, "key")
    assert [row.status for row in audited.collect()] == ["CONFLICT"]
    shuffled = [int(float(rows)) for rows in re.findall(r"rowCount=([0-9.E+]+)", final_plan_stats(audited))]
    assert shuffled and max(shuffled) <= tasks


def final_plan_stats(df):
    """Row counts of the finished shuffle stages, from the formatted plan."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_audit_reads_content_once_and_never_shuffles_it(spark, large_tables):
    pages = spark.read.parquet(PAGES)
    artifacts = digest(pages, "html").select("page_id", "digest")
    manifest = artifacts.where(F.col("page_id") > 3)
    text = plan(audit(manifest, artifacts, "page_id"))
    initial = text.split("Initial Plan")[-1]
    # The artifacts' halves: one scan with content, one with keys only.
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", initial)
    assert "struct<page_id:bigint>" in schemas
    for line in initial.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "html" not in line
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "IsNotNull(page_id)]" in text


def test_two_tables_are_digested_once_each(spark, large_tables):
    old, new = (
        digest(spark.read.parquet(f"/root/testdata/{scale}/pages.parquet"), "html")
        for scale in ("sf0.001", "sf0.01")
    )
    audited = audit(old, new, "page_id")
    assert len(audited.collect()) == 250
    finished = final_plan(audited)
    assert len(re.findall(r"sha2\(", finished)) + finished.count("ReusedExchange") == 2


@pytest.mark.parametrize("name", ["integrity_audit", "published_digest_crosscheck"])
def test_registered_queries_digest_content_once_a_side(spark, name):
    result = contract.queries()[name](spark, "/root/testdata/sf0.01")
    result.collect()
    finished = final_plan(result)
    assert len(re.findall(r"sha2\([^,]*html", finished)) + finished.count("ReusedExchange") == 2


def test_small_manifest_is_broadcast_by_size_in_the_cross_check(spark, tmp_path):
    pages = spark.read.parquet(PAGES)
    hashed = digest(pages, "html").select("digest", F.col("url").alias("file_name"))
    listed = stored(spark, tmp_path, "manifest", hashed)
    checked = crosscheck(pages, listed, "page_id")
    checked.collect()
    assert "BroadcastHashJoin" in final_plan(checked)


def test_digest_is_a_projection_over_the_columns_asked_for(spark):
    text = plan(digest(spark.read.parquet(PAGES), "html").select("page_id", "digest"))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_unused_file_digest_reads_no_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"a")
    text = plan(digest_files(spark, str(tmp_path)).select("file_name", "length"))
    assert "ArrowEvalPython" not in text


def test_file_audit_digests_in_one_of_its_scans_only(spark, tmp_path, large_tables):
    (tmp_path / "a.bin").write_bytes(b"a")
    (tmp_path / "manifest").write_text("")
    text = plan(audit_files(spark, str(tmp_path / "manifest"), str(tmp_path)))
    initial = text.split("Initial Plan")[-1]
    assert len(re.findall(r"ArrowEvalPython", initial)) == 1
