import hashlib
from collections import Counter
from contextlib import contextmanager
from random import Random

import pytest

from sigillum import (
    audit,
    audit_files,
    audit_inventory,
    audit_summary,
    parse_manifest,
    read_manifest,
)

A, B, C = (hashlib.sha256(text).hexdigest() for text in (b"a", b"b", b"c"))
LEAST = min(A, B)
SCHEMA = "key string, digest string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@contextmanager
def partitions(spark, number):
    """A key is hot with more rows than an average partition, so this sets what is hot."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(number))
    try:
        yield
    finally:
        spark.conf.set(name, before)


NONE_HOT, SOME_HOT, ALL_HOT = 1, 40, 2000


def run(spark, manifest, artifacts, shuffle_partitions=4):
    with partitions(spark, shuffle_partitions):
        audited = audit(frame(spark, manifest), frame(spark, artifacts), "key")
        assert audited.columns == ["key", "expected", "actual", "status"]
        return Counter(tuple(row) for row in audited.collect())


CASES = {
    "ok": ([("x", A)], [("x", A)], [("x", A, A, "OK")]),
    "mismatch": ([("x", A)], [("x", B)], [("x", A, B, "MISMATCH")]),
    "missing": ([("x", A)], [], [("x", A, None, "MISSING")]),
    "unlisted": ([], [("x", A)], [("x", None, A, "UNLISTED")]),
    "conflict": ([("x", B), ("x", A)], [("x", A)], [("x", LEAST, A, "CONFLICT")]),
    "conflict without artifact": ([("x", B), ("x", A)], [], [("x", LEAST, None, "CONFLICT")]),
    "conflict before null content": ([("x", B), ("x", A)], [("x", None)], [("x", LEAST, None, "CONFLICT")]),
    "listed with null content": ([("x", A)], [("x", None)], [("x", A, None, "MISSING")]),
    "unlisted with null content": ([], [("x", None)], [("x", None, None, "UNLISTED")]),
    "repeated entry": ([("x", A)] * 3, [("x", A)], [("x", A, A, "OK")]),
    "several artifacts": (
        [("x", A)],
        [("x", A), ("x", A), ("x", B), ("x", None)],
        [("x", A, A, "OK")] * 2 + [("x", A, B, "MISMATCH"), ("x", A, None, "MISSING")],
    ),
    "artifact without key": ([("x", A)], [(None, A)], [(None, None, A, "UNLISTED"), ("x", A, None, "MISSING")]),
    "entry without digest": ([("x", None)], [("x", A)], [("x", None, A, "NO_DIGEST")]),
    "entry without digest or artifact": ([("x", None)], [], [("x", None, None, "NO_DIGEST")]),
    "entry with and without digest": ([("x", None), ("x", A)], [("x", A)], [("x", A, A, "OK")]),
}


@pytest.mark.parametrize("shuffle_partitions", [NONE_HOT, ALL_HOT])
def test_statuses(spark, shuffle_partitions):
    """All cases in one audit, each under names of its own."""

    def named(case, rows):
        return [(key and f"{case}/{key}", *rest) for key, *rest in rows]

    manifest, artifacts, expected = (
        [row for case, parts in CASES.items() for row in named(case, parts[i])] for i in range(3)
    )
    assert run(spark, manifest, artifacts, shuffle_partitions) == Counter(expected)


@pytest.mark.parametrize("manifest, artifacts", [([], []), ([("x", A)], []), ([], [("x", A)])])
def test_empty_sides(spark, manifest, artifacts):
    assert run(spark, manifest, artifacts) == brute_force(manifest, artifacts)


def brute_force(manifest, artifacts):
    listed = {}
    for key, digest in manifest:
        if key is not None:
            listed.setdefault(key, set()).update({digest} - {None})
    out = Counter()
    for key, actual in artifacts:
        digests = listed.get(key)
        if digests is None:
            out[(key, None, actual, "UNLISTED")] += 1
            continue
        expected = min(digests, default=None)
        if expected is None:
            status = "NO_DIGEST"
        elif len(digests) > 1:
            status = "CONFLICT"
        elif actual is None:
            status = "MISSING"
        else:
            status = "OK" if actual == expected else "MISMATCH"
        out[(key, expected, actual, status)] += 1
    for key in set(listed) - {key for key, _ in artifacts}:
        n = len(listed[key])
        status = "CONFLICT" if n > 1 else "MISSING" if n else "NO_DIGEST"
        out[(key, min(listed[key], default=None), None, status)] += 1
    return out


def generated(seed, n_keys=400, n_rows=1500):
    """Rows whose keys are repeated very unevenly, some without key or digest."""
    random = Random(seed)

    def rows():
        return [
            (
                None if random.random() < 0.02 else f"key {int(n_keys * random.random() ** 3)}",
                random.choice([A, A, A, A, B, C, None]),
            )
            for _ in range(n_rows)
        ]

    # Every fifth key of the manifest gets no artifact at all, and the reverse.
    manifest = [row for row in rows() if not (row[0] or "").endswith("5")]
    artifacts = [row for row in rows() if not (row[0] or "").endswith("7")]
    return manifest, artifacts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("shuffle_partitions", [NONE_HOT, SOME_HOT, ALL_HOT])
def test_agrees_with_brute_force(spark, shuffle_partitions, seed):
    manifest, artifacts = generated(seed)
    expected = brute_force(manifest, artifacts)
    assert {status for _, _, _, status in expected} == {
        "OK", "MISMATCH", "MISSING", "UNLISTED", "CONFLICT", "NO_DIGEST",
    }
    assert run(spark, manifest, artifacts, shuffle_partitions) == expected


@pytest.mark.parametrize("shuffle_partitions", [NONE_HOT, SOME_HOT])
@pytest.mark.parametrize(
    "setting", [("adaptive.enabled", "false"), ("autoBroadcastJoinThreshold", "-1")]
)
def test_agrees_with_brute_force_under_other_settings(spark, shuffle_partitions, setting):
    name = f"spark.sql.{setting[0]}"
    spark.conf.set(name, setting[1])
    try:
        manifest, artifacts = generated(3)
        assert run(spark, manifest, artifacts, shuffle_partitions) == brute_force(manifest, artifacts)
    finally:
        spark.conf.unset(name)


def test_summary(spark):
    audited = audit(
        frame(spark, [("x", A), ("y", A), ("z", A)]), frame(spark, [("x", A), ("y", B)]), "key"
    )
    summary = audit_summary(audited)
    assert summary.columns == ["status", "n"]
    assert {tuple(row) for row in summary.collect()} == {("OK", 1), ("MISMATCH", 1), ("MISSING", 1)}


def test_malformed_lines_list_nothing(spark):
    lines = spark.createDataFrame([(f"{A}  x",), (f"{B} x",), ("junk",)], "value string")
    artifacts = spark.createDataFrame([("x", A)], "file_name string, digest string")
    rows = audit(parse_manifest(lines), artifacts, "file_name").collect()
    assert [tuple(row) for row in rows] == [("x", A, A, "OK")]


def test_keys_of_different_types_are_refused(spark):
    numbers = spark.createDataFrame([(1, A)], "key int, digest string")
    longs = spark.createDataFrame([(1, A)], "key long, digest string")
    with pytest.raises(TypeError, match="key 'key' is int on one side and bigint"):
        audit(numbers, longs, "key")


@pytest.mark.parametrize("name", ["expected", "actual", "status", "Status"])
def test_key_named_as_a_result_column_is_refused(spark, name):
    rows = spark.createDataFrame([("x", A)], f"{name} string, digest string")
    with pytest.raises(ValueError, match=name):
        audit(rows, rows, name)


@pytest.mark.parametrize("name", ["a.b", "a`b", "slot", "hot_key", "entry_key", "key", "bucket"])
def test_key_of_any_other_name(spark, name):
    rows = spark.createDataFrame([("x", A)], SCHEMA).toDF(name, "digest")
    audited = audit(rows, rows, name)
    assert audited.columns == [name, "expected", "actual", "status"]
    assert [tuple(row) for row in audited.collect()] == [("x", A, A, "OK")]


def test_collated_keys_are_refused(spark):
    rows = frame(spark, [("A.zip", A)]).selectExpr("key collate utf8_lcase AS key", "digest")
    with pytest.raises(TypeError, match="collat"):
        audit(rows, rows, "key")


def test_files_against_manifest(spark, tmp_path):
    artifacts = tmp_path / "artifacts"
    artifacts.mkdir()
    for name in ("good.zip", "Bô chèng.zip", "changed.zip", "extra.zip", "twice.zip"):
        (artifacts / name).write_bytes(name.encode())
    named = {p.name: hashlib.sha256(p.name.encode()).hexdigest() for p in artifacts.iterdir()}
    (tmp_path / "manifest").write_text(
        f"{named['good.zip']}  good.zip\n"
        f"{named['good.zip']}  good.zip\n"
        f"{named['Bô chèng.zip']}  Bô chèng.zip\n"
        f"{A}  changed.zip\n"
        f"{A}  gone.zip\n"
        f"{A}  twice.zip\n{B}  twice.zip\n"
        f"{named['extra.zip'].upper()}  extra.zip\n"
    )
    rows = audit_files(spark, str(tmp_path / "manifest"), str(artifacts)).collect()
    found = {row.file_name: row.status for row in rows if row.status != "MALFORMED"}
    assert found == {
        "good.zip": "OK",
        "Bô chèng.zip": "OK",
        "changed.zip": "MISMATCH",
        "gone.zip": "MISSING",
        "twice.zip": "CONFLICT",
        "extra.zip": "UNLISTED",
    }
    assert [row.line for row in rows if row.status == "MALFORMED"] == [f"{named['extra.zip'].upper()}  extra.zip"]
    assert len(rows) == 7


def write(folder, files):
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)


def test_every_line_and_every_file_is_accounted_for(spark, tmp_path):
    """Names in folders are keys of their own; hidden and empty files are files."""
    files = {"v1/x.zip": b"1", "v2/x.zip": b"2", "_config.yml": b"3", ".htaccess": b"", "a[1]/b c+d%20.zip": b"4"}
    write(tmp_path / "lake", files)
    lines = [f"{hashlib.sha256(content).hexdigest()}  {name}" for name, content in files.items()]
    (tmp_path / "sums").write_text("\n".join([*lines, "junk", f"{A} one space", "", "junk"]))
    rows = audit_files(spark, str(tmp_path / "sums"), str(tmp_path / "lake")).collect()
    assert {row.file_name: row.status for row in rows if row.file_name} == dict.fromkeys(files, "OK")
    assert sorted(row.line for row in rows if row.line) == sorted(["junk", "junk", f"{A} one space"])
    assert len(rows) == len(files) + 3


def test_a_manifest_is_about_its_own_folder(spark, tmp_path):
    write(tmp_path / "lake", {"v1 é+%41/x.zip": b"1", "v2/deep/x.zip": b"2"})
    for folder, content in (("v1 é+%41", b"1"), ("v2/deep", b"3")):
        digest = hashlib.sha256(content).hexdigest()
        (tmp_path / "lake" / folder / "SHA256SUMS").write_text(f"{digest}  x.zip\n")
    root = str(tmp_path / "lake")
    manifests = [f"{root}/v1 é+%41/SHA256SUMS", f"{root}/v2/deep/SHA256SUMS"]
    found = {row.file_name: row.status for row in audit_files(spark, manifests, root).collect()}
    assert found == {
        "v1 é+%41/x.zip": "OK", "v2/deep/x.zip": "MISMATCH",
        "v1 é+%41/SHA256SUMS": "UNLISTED", "v2/deep/SHA256SUMS": "UNLISTED",
    }


def test_audit_of_an_inventory_lists_no_folder(spark, tmp_path):
    write(tmp_path / "lake", {"x": b"1", "not in the inventory": b"2"})
    (tmp_path / "sums").write_text(f"{hashlib.sha256(b'1').hexdigest()}  x\n{A}  y\njunk\n")
    inventory = spark.createDataFrame([(f"{tmp_path}/lake/x", "x"), (None, "y")], "path string, file_name string")
    rows = audit_inventory(read_manifest(spark, str(tmp_path / "sums")), inventory).collect()
    assert sorted((row.file_name or row.line, row.status) for row in rows) == [
        ("junk", "MALFORMED"), ("x", "OK"), ("y", "MISSING"),
    ]
