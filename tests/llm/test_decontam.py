"""Benchmark passages against edit distances over whole texts."""

import random

import numpy as np

import pytest

from sigillum.llm import decontam
from sigillum.llm.decontam import MIN_CHARS, STEP, WINDOW, contaminated, decontaminate, edit_budget, normalised, parts_of

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def plain(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return bytes(normalised(raw, np.array([0, len(raw)]))[0]) if len(raw) else b""


def least_edits(text, pattern):
    """Edits of the best match of the whole pattern anywhere in the text."""
    row = np.zeros(len(text) + 1, np.int64)
    chars, lane = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for i, c in enumerate(pattern, start=1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (chars != c), row[1:] + 1)
        row = np.minimum.accumulate(best - lane) + lane
    return int(row.min())


def brute_force(docs, items):
    """`(doc, item, edits)` of whole items, and `(doc, item, offset)` of windows where there is none."""
    whole, windows = set(), set()
    for item_id, item in items:
        pattern = plain(item).strip()
        for doc_id, text in docs:
            text = plain(text)
            if len(pattern) < MIN_CHARS:
                if pattern and b" " + pattern + b" " in b" " + text + b" ":
                    whole.add((doc_id, item_id, 0))
                continue
            edits = least_edits(text, pattern)
            if edits <= edit_budget(len(pattern)):
                whole.add((doc_id, item_id, edits))
                continue
            for at, n in parts_of(len(pattern))[1:]:
                if least_edits(text, pattern[at : at + n]) <= edit_budget(n):
                    windows.add((doc_id, item_id, at))
    return whole, windows


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdeist", k=rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        text[at] = rng.choice(["", "x", text[at] + "y"])
    return "".join(text)


def run(spark, docs, items, **options):
    df = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    assert df.columns == ["doc_id", "item_id", "edits", "start", "end", "share"]
    return df.collect()


def test_agrees_with_edit_distances_around_the_budget(spark):
    rng = random.Random(5)
    items = [(k, sentence(rng, rng.randint(6, 40))) for k in range(12)] + [(99, "too short")]
    docs = []
    for k in range(160):
        item = rng.choice(items)[1]
        middle = edited(rng, item, rng.randint(0, int(0.14 * len(item))))
        if k % 3 == 0:
            middle = middle.upper().replace(" ", rng.choice([", ", "\n\n", " - ", "... "]))
        docs.append((k, f"{sentence(rng, rng.randint(0, 30))} {middle} {sentence(rng, rng.randint(0, 30))}"))
    expected, windows = brute_force(docs, items)
    assert 40 < len({d for d, _, _ in expected}) < 150
    assert len({e for _, _, e in expected}) > 3 and windows
    found = run(spark, docs, items)
    assert {(r.doc_id, r.item_id, r.edits) for r in found if r.share == 1} == expected
    assert {(r.doc_id, r.item_id) for r in found if r.share < 1} == {(d, i) for d, i, _ in windows}


def test_parts_of_items_are_regions(spark):
    """Copies of 30 to 100% of an item, with and without edits."""
    rng = random.Random(8)
    items = [(k, sentence(rng, rng.randint(25, 60))) for k in range(8)]
    docs, cuts = [], {}
    for k in range(90):
        item = rng.choice(items)[1]
        n = int(len(item) * rng.uniform(0.3, 1))
        at = rng.randint(0, len(item) - n)
        part = item[at : at + n]
        cuts[k] = (len(part), k % 2)
        part = edited(rng, part, int(len(part) * rng.uniform(0, 0.1))) if k % 2 else part
        docs.append((k, f"{sentence(rng, rng.randint(0, 20))} {part} {sentence(rng, rng.randint(0, 20))}"))
    whole, windows = brute_force(docs, items)
    found = run(spark, docs, items)
    assert {(r.doc_id, r.item_id, r.edits) for r in found if r.share == 1} == whole
    partial = [r for r in found if r.share < 1]
    assert {(r.doc_id, r.item_id) for r in partial} == {(d, i) for d, i, _ in windows}
    texts, sizes = dict(docs), {i: len(plain(text).strip()) for i, text in items}
    for r in partial:
        assert WINDOW <= r.share * sizes[r.item_id] + 1e-6
        assert abs((r.end - r.start) - r.share * sizes[r.item_id]) <= 2 * edit_budget(WINDOW)
        assert len(texts[r.doc_id]) >= r.end
    hit = {r.doc_id for r in found}
    assert all(k in hit for k, (n, is_edited) in cuts.items() if n >= WINDOW + STEP + 2 and not is_edited)


@pytest.mark.parametrize("seed", range(2))
def test_short_items_are_whole_words(spark, seed):
    rng = random.Random(seed)
    items = [(k, "".join(rng.choice("ab é7") for _ in range(k))) for k in range(1, 31) for _ in range(3)]
    docs = [(k, "".join(rng.choice("ab é7,") for _ in range(rng.randint(0, 60)))) for k in range(60)]
    docs += [(100 + k, f"{rng.choice('a, ')}{rng.choice(items)[1].upper()}{rng.choice('b. ')}") for k in range(60)]
    docs.append((999, "What is 7 times 8? Nobody knows."))
    items.append((77, "What is 7 times 8?"))
    whole, _ = brute_force(docs, items)
    assert {(r.doc_id, r.item_id, r.edits) for r in run(spark, docs, items)} == whole and (999, 77, 0) in whole


def test_a_phrase_in_all_items_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    phrase = "answer the following question and explain your answer in a few words please"
    items = [(k, f"{phrase} {sentence(rng, 12)}") for k in range(60)]
    docs = [(k, f"{sentence(rng, 5)} {rng.choice(items)[1]} {sentence(rng, 5)}") for k in range(30)]
    docs += [(50 + k, f"{sentence(rng, 9)} {phrase} {sentence(rng, 9)}") for k in range(3)]
    first = sorted(map(tuple, run(spark, docs, items)))
    assert sorted(map(tuple, run(spark, docs, items, block_bytes=900))) == first
    monkeypatch.setattr(decontam, "MOST_PLACES", 1000)
    assert sorted(map(tuple, run(spark, docs, items))) == first
    whole, windows = brute_force(docs, items)
    assert {(d, i, e) for d, i, e, _, _, share in first if share == 1} == whole
    assert {(d, i) for d, i, _, _, _, share in first if share < 1} == {(d, i) for d, i, _ in windows}


def test_places_are_code_points_of_the_whole_text(spark):
    item = "Zwölf Boxkämpfer jagen Viktor quer über den grünen Sylter Deich"
    text = "é" * 50_000 + f"\n{item.upper()}! " + "😀 und so weiter " * 3
    (row,) = run(spark, [(1, text)], [(7, item)])
    assert text[row.start : row.end] == item.upper() and row.edits == 0


def test_text_is_normalised_by_code_point():
    texts = ["\u201cDon\u2019t\u201d \u2014 STOP\u2026", "\u0386\u039b\u03a6\u0391\u03a3 \u0416\u0423\u041a \u0141\u00d3D\u0179", "", "Stra\u00dfe \u00d7 \u5b57\U00020000 \U0001f600\ufe0f 9", "\u0915\u093f \u2013"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    text, bounds, places = normalised(np.frombuffer(b"".join(raw), np.uint8), offsets)
    found = [bytes(text[a:b]).decode() for a, b in zip(bounds[:-1], bounds[1:])]
    assert found == [" don t stop ", "\u03ac\u03bb\u03c6\u03b1\u03c3 \u0436\u0443\u043a \u0142\u00f3d\u017a", "", "strasse \u5b57\U00020000 9", "\u0915\u093f "]
    assert len(places) == len(text) and (np.diff(places) >= 0).all()
    broken = np.frombuffer(b"a\x80b\xc3 \xf0\x9f \xff\xe2\x82", np.uint8)
    assert len(normalised(broken, np.array([0, 3, len(broken)]))[0])


def test_typographic_signs_and_other_scripts_cost_no_edits(spark):
    items = [
        (1, "\"It's the fox - isn't it?\" she said - \"and it won't go\" - and he didn't say \"no\" to it."),
        (2, "\u0432\u0441\u0435 \u0441\u0447\u0430\u0441\u0442\u043b\u0438\u0432\u044b\u0435 \u0441\u0435\u043c\u044c\u0438 \u043f\u043e\u0445\u043e\u0436\u0438 \u0434\u0440\u0443\u0433 \u043d\u0430 \u0434\u0440\u0443\u0433\u0430"),
        (3, "\u03bc\u1fc6\u03bd\u03b9\u03bd \u1f04\u03b5\u03b9\u03b4\u03b5 \u03b8\u03b5\u1f70 \u03c0\u03b7\u03bb\u03b7\u03ca\u03ac\u03b4\u03b5\u03c9 \u1f00\u03c7\u03b9\u03bb\u1fc6\u03bf\u03c2"),
        (4, "za\u017c\u00f3\u0142\u0107 g\u0119\u015bl\u0105 ja\u017a\u0144 w pi\u0119knej \u0142odzi"),
    ]
    typographic = items[0][1].replace("'", "\u2019").replace(" - ", " \u2014 ").replace('"', "\u201d")
    docs = [(1, f"\u00ab\u2026 {typographic} \u00bb")] + [(k, f"\u2014 {text.upper()}!") for k, text in items[1:]]
    found = run(spark, docs, items)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found) == [(k, k, 0) for k in (1, 2, 3, 4)]
    texts = dict(docs)
    assert all(texts[r.doc_id][r.start : r.end].strip("\u201d.") == texts[r.doc_id][2:-1].strip("\u2026 \u201d.") for r in found)


def test_edge_cases(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = [(1, None), (2, ""), (3, "..."), (4, item), (4, item), (None, item), (5, f"{item} {item}"), (6, "clean text")]
    items = [(1, item), (2, item), (3, None), (4, ""), (None, item)]
    found = run(spark, docs, items)
    pairs = sorted(((r.doc_id, r.item_id, r.start) for r in found), key=repr)
    assert pairs == sorted([(d, i, 0) for d in (4, 4, None, 5) for i in (1, 2, None)], key=repr)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_rows_go_by_their_own_text(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = [(1, None), (2, ""), (4, item), (4, "a clean text"), (None, item), (None, "clean too"), (5, f"{item} {item}"), (6, "yes")]
    wide = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS + ", `item_id.part` string, `ed``its` int")
    kept = decontaminate(wide, spark.createDataFrame([(1, item), (2, "yes")], ITEMS))
    assert kept.columns == wide.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted(
        [(1, None), (2, ""), (4, "a clean text"), (None, "clean too"), (6, "yes")], key=repr)


def test_query_finds_every_exact_passage(spark):
    import __spark_entry__ as contract

    sf_dir = "/root/testdata/sf0.01"
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()]
        for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    exact = {d for d, text in docs if any(plain(i).strip() in plain(text) for _, i in items)}
    found = {r.doc_id for r in contract.queries()["op1_decontamination"](spark, sf_dir).collect()}
    assert exact and exact <= found
