"""The pipeline: each stage against what the one before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigillum.llm.common import stash, table
from sigillum.llm.decontam import TELLING_CHARS, contaminated
from sigillum.llm.neardup import near_duplicates
from sigillum.llm.secrets import BASE_KINDS, MARK, Scanner
from sigillum.llm.toxicity import toxicity

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF_DIR, "documents")
    kept = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        kept.append((name, stash(stage(spark, kept[-1][1], SF_DIR))))
    return dict(kept)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_and_columns(stages):
    assert list(stages) == ["documents", "toxicity", "near_dedup", "decontamination", "secret_scan", "mixing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_toxic_documents_go(spark, stages):
    found = toxicity(stages["documents"], table(spark, SF_DIR, "labels")).where("predicted = 0")
    assert ids(stages["toxicity"]) == ids(found) != ids(stages["documents"])


def test_one_of_each_group_stays(stages):
    groups = near_duplicates(stages["toxicity"]).collect()
    assert ids(stages["near_dedup"]) == {r.component_id for r in groups}
    assert len(groups) > len({r.component_id for r in groups})


def test_contaminated_documents_go(spark, stages):
    found = contaminated(stages["near_dedup"], table(spark, SF_DIR, "benchmark"))
    leaks = ids(found.where(F.col("end") - F.col("start") >= TELLING_CHARS))
    assert leaks and ids(stages["decontamination"]) == ids(stages["near_dedup"]) - leaks


def test_secrets_are_marked_and_documents_stay(stages):
    before = {r.doc_id: r for r in stages["decontamination"].collect()}
    after = {r.doc_id: r for r in stages["secret_scan"].collect()}
    assert set(before) == set(after)
    scanner = Scanner()
    for doc_id, row in after.items():
        found = scanner.spans(before[doc_id].text)
        assert (row.text == before[doc_id].text) == (not found) and (MARK in row.text) >= bool(found)
        assert not [s for s in scanner.spans(row.text) if s[1] < len(BASE_KINDS)]
        assert row.n_chars == len(row.text)
    assert any(MARK in r.text for r in after.values())


def test_every_document_is_scheduled(stages):
    rows = stages["mixing"]
    assert ids(rows) == ids(stages["secret_scan"])
    once = rows.where("copy = 1").select(stages["secret_scan"].columns)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, stages["secret_scan"].collect()))


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(stages["mixing"].collect())


def test_stages_decide_by_row_and_take_any_column_name(spark):
    """NULL and repeated ids go by their own text; one of repeated rows stays; names with signs stay."""
    item = table(spark, SF_DIR, "benchmark").where("length(text) > 80").first().text
    text = "a quiet harbour town where the boats come home before the evening bells begin to ring again"
    other = "the second document of this id has nothing in common with any other one that is given here"
    rows = [
        (None, text, "en", "s", 1), (None, text, "en", "s", 1), (1, text, "en", "s", 1), (2, other, "en", "s", 1),
        (2, f"{other} {item}", "en", "t", 1), (None, f"before it {item} behind it", "en", "t", 1), (3, "password: hunter2hunter2", None, None, 1),
        (4, None, None, None, None), (4, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, table(spark, SF_DIR, "documents").schema)
    names = ["a.b", "c`d", "Copy", "Row_Number", "toxicity_SCORE"]
    docs = stash(docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(names))))
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = stash(stage(spark, given, SF_DIR))
        assert given.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in given.collect()), key=repr) == sorted(
        [(1, text), (2, other), (3, MARK), (4, None), (4, None)], key=repr)
    last = corpus_pipeline.STAGES[-1][1](spark, given, SF_DIR)
    assert last.columns[: len(docs.columns)] == docs.columns and last.where("copy_ = 1").count() == 5


def test_rows_with_nulls_and_an_empty_table(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", None, None), (None, "words of a text", None, "s", 3), (2, "", None, "s", 0)],
        table(spark, SF_DIR, "documents").schema,
    )
    for given, n in ((docs, 4), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            given = stash(stage(spark, given, SF_DIR))
        assert given.where(F.col("copy") == 1).count() == n
