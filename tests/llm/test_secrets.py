"""Secret spans against plain regular expressions over whole texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sigillum.llm.secrets import ACCESS, ASSIGN, KINDS, MARK, Scanner, crc_base62, find_secrets, redact_secrets

BODY = "abcdefghijABCDEFGHIJ0123456789"
GOOD = f"ghp_{BODY}{crc_base62(BODY)}"
BAD = f"ghp_{BODY}000000"


def brute_force(text):
    found = [
        (m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.ASCII | re.IGNORECASE) if len(m[2]) >= 6
    ]
    found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


PIECES = [
    "password", "PassWord", "passwd", "secret", "token", "api_key", "APIKEY", "apikey", "AKIA", "akia", "ABCDEFGHIJKLMNOP",
    "0123456789abcdef", "deadbeef" * 3, "f" * 23, "=", ": ", " ", '"', "'", ":=", "é", "İ", "ſ", "K", "\n", "/+_.-",
    "a", "g", "abcde", "abcdef", "\U0001f600",
]


def test_base_spans_agree_with_plain_patterns():
    rng, scanner = random.Random(4), Scanner()
    seen = set()
    for _ in range(4000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 25)))
        spans = [s for s in scanner.spans(text) if s[1] < 3]
        assert spans == brute_force(text), text
        seen |= {s[1] for s in spans}
    assert seen == {0, 1, 2}


@pytest.mark.parametrize("text, kinds", [
    (GOOD, ["github"]), (BAD, []), (GOOD + "x", []), (f"npm_{BODY}{crc_base62(BODY)}", ["npm"]), (f"x{GOOD}.", ["github"]),
    (f"token={GOOD}", ["assign", "github"]),
])
def test_tokens_with_a_checksum(text, kinds):
    assert [KINDS[k] for _, k, _ in Scanner().spans(text)] == kinds


def test_very_long_text():
    text = "e " * 1_000_000 + "token=abcdefgh" + "0" * 500_000
    assert Scanner().spans(text) == brute_force(text)


def test_tables(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a token: secret=abcdefghi end", 3), (3, "clean", 4), (None, "0" * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("secrets", F.lit(7))
    found = sorted(((r.doc_id, [tuple(s) for s in r.secrets]) for r in find_secrets(df).collect()), key=repr)
    assert found == sorted([
        (1, []), (2, []), (3, [("assign", 2, 25)]), (3, []), (None, [("hex", 0, 30)]),
    ], key=repr)
    clean = redact_secrets(df)
    assert clean.columns == df.columns
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in clean.collect()), key=repr)
    redacted = f"a {MARK} end"
    assert texts == sorted([
        (1, None, 1), (2, "", 0), (3, redacted, len(redacted)), (3, "clean", 5), (None, MARK, len(MARK)),
    ], key=repr)
    assert find_secrets(df.limit(0)).collect() == []


def spans(text):
    return [(KINDS[k], a, b) for a, k, b in brute_force(text)]


def test_query_over_the_whole_table(spark):
    import __spark_entry__ as contract

    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = contract.queries()["op5_secrets"](spark, sf_dir).collect()
    assert {r.doc_id for r in found} == set(texts) and len(found) == len(texts)
    some = 0
    for row in found:
        base = spans(texts[row.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        assert [row.n_assign, row.n_access, row.n_hex] == counts
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(row.spans.split(","))
        some += bool(base)
    assert some > 10
