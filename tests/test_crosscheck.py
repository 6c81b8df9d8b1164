import hashlib
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sigillum import crosscheck

A, B, C = (hashlib.sha256(text).hexdigest() for text in (b"a", b"b", b"c"))


def run(spark, pages, manifest):
    df = crosscheck(
        spark.createDataFrame(pages, "page_id long, html string"),
        spark.createDataFrame(manifest, "digest string, file_name string"),
        "page_id",
    )
    assert df.columns == ["page_id", "published", "file_name", "in_manifest"]
    return Counter(tuple(row) for row in df.collect())


def test_page_and_manifest_agree(spark):
    html = f'<!doctype html><meta charset="utf-8"><small>ZIP SHA-256</small><code>{A}</code>'
    assert run(spark, [(1, html)], [(A, "a.zip")]) == Counter([(1, A, "a.zip", True)])


def test_unknown_digest(spark):
    assert run(spark, [(1, B)], [(A, "a.zip")]) == Counter([(1, B, None, False)])


def test_one_row_per_occurrence(spark):
    assert run(spark, [(1, f"{A} {B} {A}"), (2, A), (3, "none"), (4, None)], [(A, "a")]) == Counter(
        [(1, A, "a", True), (1, A, "a", True), (1, B, None, False), (2, A, "a", True)]
    )


def test_least_of_several_names_and_no_fan_out(spark):
    manifest = [(A, "b"), (A, "a"), (A, "c"), (A, "a")]
    assert run(spark, [(1, A)], manifest) == Counter([(1, A, "a", True)])


def test_digest_must_stand_alone(spark):
    for html in (A[:-1], A + "0", "0" + A, A + B, A.upper(), f"_{A}", f"{A}_", f"z{A}", f"{A}Z"):
        assert not run(spark, [(1, html)], [(A, "a")])


def test_digest_directly_after_other_scripts(spark):
    for html in (f"雜湊{A}", f"{A}完", f"é{A}é", f"é{A}́", f"-{A}.", f"\n{A} "):
        assert run(spark, [(1, html)], [(A, "a")]) == Counter([(1, A, "a", True)])


def test_malformed_manifest_rows_match_nothing(spark):
    assert run(spark, [(1, A)], [(None, None)]) == Counter([(1, A, None, False)])


def test_digest_at_the_end_of_a_long_page(spark):
    html = "x " * 500_000 + A
    assert run(spark, [(1, html)], [(A, "a")]) == Counter([(1, A, "a", True)])


def test_many_digests_in_one_page(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000)]
    found = run(spark, [(1, "\n".join(digests))], [(d, "f") for d in digests[::2]])
    assert sum(found.values()) == 20_000
    assert sum(n for row, n in found.items() if row[3]) == 10_000


PIECES = st.sampled_from([A, B, C, A.upper(), A[:-1], " ", "<code>", "0", "z", "_", "é", "湊", "\n"])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.lists(PIECES, max_size=8).map("".join), max_size=8),
    st.lists(st.tuples(st.sampled_from([A, B]), st.sampled_from("pqr")), max_size=5),
)
def test_agrees_with_brute_force(spark, htmls, manifest):
    expected = Counter()
    for page_id, html in enumerate(htmls):
        for digest in re.findall(r"\b[0-9a-f]{64}\b", html, re.ASCII):
            names = [name for listed, name in manifest if listed == digest]
            expected[(page_id, digest, min(names, default=None), bool(names))] += 1
    assert run(spark, list(enumerate(htmls)), manifest) == expected


@pytest.mark.parametrize("name", ["published", "file_name", "in_manifest"])
def test_page_key_named_as_a_result_column_is_refused(spark, name):
    pages = spark.createDataFrame([("p", A)], "key string, html string").withColumnRenamed("key", name)
    manifest = spark.createDataFrame([(A, "a")], "digest string, file_name string")
    with pytest.raises(ValueError, match=name):
        crosscheck(pages, manifest, name)


@pytest.mark.parametrize("name", ["digest", "a.b", "line"])
def test_page_key_of_any_other_name(spark, name):
    pages = spark.createDataFrame([("p", A)], "key string, html string").withColumnRenamed("key", name)
    manifest = spark.createDataFrame([(A, "a")], "digest string, file_name string")
    assert [tuple(row) for row in crosscheck(pages, manifest, name).collect()] == [("p", A, "a", True)]
