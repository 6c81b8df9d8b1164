"""Fingerprints of documents: invertible Bloom lookup sketches of their paragraphs.

A text is a set of paragraph digests: its lines, cut after every `PIECE_WORDS`
words. A sketch has three tables of cells; a digest goes into one cell of each,
where it is counted and XORed. Two sketches subtract cell by cell: what both
texts hold cancels. A cell left with one digest gives it away (a check tells),
and taking it out of its other cells may leave more such cells: peeling. If
cells remain, the pair is tried again with sketches four times as large.

All of it is built-in functions: sketches are grouped sums and XORs, a round of
peeling is one more grouping of the cells by document. Tables of a sketch take
turns, so a digest alone in cells of two tables is not taken out twice. All
rounds of a try group by document, so they need one shuffle between them.

Subtracted fingerprints tell about how many digests differ, by the squares of
their counts. Where a fingerprint has room for that many, it is peeled itself; else
the pair gets sketches of that size at once. Cells without a difference
have no row, so room to spare costs nothing, and most cells of such a sketch
give a digest away in the first turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

PIECE_WORDS = 16
TABLES = 3
CELLS = 36  # of a fingerprint, all tables
GROWTH = 4
ROUNDS = 4  # each takes every table once
ROOM = 2  # cells of a table for each digest that is thought to differ
ROOM_ROUNDS = 2  # with so much room
TASK_DIGESTS = 1 << 19
BROADCAST_ROWS = 1 << 17  # pairs to try again: some 12 MB

PIECE = rf"[^\x20\x09-\x0D]++(?:[\x20\x09\x0B-\x0D]++[^\x20\x09-\x0D]++){{0,{PIECE_WORDS - 1}}}"


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; white space around one does not count."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def _check(digest: str) -> str:
    return f"(xxhash64({digest}, 97) & 4294967295)"


def _cell(digest: str, place: int, each: int | str) -> str:
    """The cell in table `place`, where each table has `each` cells: a number or a column."""
    return f"CAST(pmod(xxhash64({digest}, {place}), {each}) + {place} * {each} AS INT)"


def _sketched(rows: DataFrame, sides: dict[str, str], cells: int) -> DataFrame:
    """Cells of the sketches of several digest columns: counts, XORs and checks of each."""
    all_sides = ", ".join(f"named_struct('side', {k}, 'd', {column})" for k, column in enumerate(sides.values()))
    each_side = rows.select("id", F.expr(f"explode(array({all_sides}))").alias("s"))
    digests = each_side.select("id", "s.side", F.expr("explode(s.d)").alias("digest"))
    spread = ", ".join(_cell("digest", t, cells // TABLES) for t in range(TABLES))
    celled = digests.select("id", "side", "digest", F.expr(f"explode(array({spread}))").alias("cell"))
    sums = []
    for k, name in enumerate(sides):
        own = f"CASE WHEN side = {k} THEN"
        sums += [
            F.expr(f"count({own} 1 END)").alias(f"n_{name}"),
            F.expr(f"coalesce(bit_xor({own} digest END), 0L)").alias(f"x_{name}"),
            F.expr(f"coalesce(bit_xor({own} {_check('digest')} END), 0L)").alias(f"c_{name}"),
        ]
    return celled.groupBy("id", "cell").agg(*sums)


def _subtracted(sketches: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """`(id, pair, cell, n, x, c)` of the cells where the sketches of a pair differ."""
    each = ", ".join(
        f"struct({k} AS pair, n_{a} - n_{b} AS n, x_{a} ^ x_{b} AS x, c_{a} ^ c_{b} AS c)"
        for k, (a, b) in enumerate(pairs)
    )
    return (
        sketches.select("id", "cell", F.expr(f"explode(array({each}))").alias("d"))
        .select("id", "d.pair", "cell", "d.n", "d.x", "d.c")
        .where("n <> 0 OR x <> 0 OR c <> 0")
    )


def _peeled(cells_left: DataFrame, each: int | str, rounds: int, found: str | None = None) -> DataFrame:
    """The cells after peeling, and rows with cell -1 for the digests recovered.

    Those are one row of a pair, which counts them in `n`; with a column `found`,
    which then has the digest, a row for each, and `n` tells the side. `each` may be
    made of the columns `id` and `pair`.
    """
    keys = ["id", "pair", "cell", *([found] if found else [])]
    rows = cells_left.withColumn(found, F.lit(None).cast("long")) if found else cells_left
    none, its, kept = (f"CAST(NULL AS BIGINT) AS {found}, ", f"x AS {found}, n", f"{found}, ") if found else ("", "1L", "")
    for turn in range(rounds * TABLES):
        place = turn % TABLES
        others = [t for t in range(TABLES) if t != place]
        is_pure = (
            f"abs(n) = 1 AND cell >= {place} * {each} AND cell < {place + 1} * {each}"
            f" AND c = {_check('x')} AND cell = {_cell('x', place, each)}"
        )
        taken = ", ".join(
            f"struct({_cell('x', t, each)} AS cell, {none}-n AS n, x AS x, c AS c)" for t in others
        )
        step = f"""explode(CASE WHEN {is_pure}
            THEN array(struct(-1 AS cell, {its} AS n, 0L AS x, 0L AS c), {taken})
            ELSE array(struct(cell, {kept}n, x, c)) END)"""
        rows = (
            rows.select("id", "pair", F.expr(step).alias("s"))
            .select("id", "pair", "s.*")
            .groupBy(*keys)
            .agg(F.sum("n").alias("n"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(c)").alias("c"))
            .where("cell < 0 OR n <> 0 OR x <> 0 OR c <> 0")
        )
    return rows


def _estimated(apart: DataFrame, cells: int) -> DataFrame:
    """`(id, pair, about)` of subtracted sketches: about how many digests differ.

    Each digest is one more or one less in a cell of each table, by chance, so the squares of a
    table's counts add up to their number, once what the difference of both sizes adds is
    taken off. There are that many at least.
    """
    each = cells // TABLES
    sums = apart.groupBy("id", "pair").agg(
        F.sum(F.expr("n * n")).alias("squares"), F.sum("n").alias("more"), F.count(F.lit(1)).alias("used")
    )
    gap = f"(more / {TABLES})"
    by_squares = f"(squares / {TABLES} - {gap} * {gap} / {each}) / (1 - 1 / {max(2, each)})"
    about = f"CAST(ceil(greatest({by_squares}, abs({gap}), used / {TABLES})) AS BIGINT)"
    return sums.selectExpr("id", "pair", f"{about} AS about")


def _differing(rows: DataFrame, sides: dict[str, str], pairs: list[tuple[str, str]], rounds: int) -> DataFrame:
    """`(id, pair, each, recovered, left)`: how many digests differ, and how many cells stay unpeeled.

    `rows` has array columns of digests, and a row for each `pair` to compare with `each` cells in
    a table. Sums over what the sketch of one side adds and that of the other takes away are
    their difference.
    """
    signed = ", ".join(
        f"named_struct('k', {k}, 'sign', {sign}L, 'd', {sides[side]})"
        for k, pair in enumerate(pairs)
        for side, sign in zip(pair, (1, -1), strict=True)
    )
    # In one number, which all rounds group by.
    bits = (len(pairs) - 1).bit_length()
    pair = f"shiftleft(each, {bits}) + pair"
    each = f"shiftright(pair, {bits})"
    spread = ", ".join(_cell("digest", t, each) for t in range(TABLES))
    apart = (
        rows.select("id", F.expr(pair).alias("pair"), F.expr(f"explode(filter(array({signed}), s -> s.k = pair))").alias("s"))
        .select("id", "pair", "s.sign", F.expr("explode(s.d)").alias("digest"))
        .select("id", "pair", "sign", "digest", F.expr(_check("digest")).alias("c"), F.expr(f"explode(array({spread}))").alias("cell"))
        .groupBy("id", "pair", "cell")
        .agg(F.sum("sign").alias("n"), F.expr("bit_xor(digest)").alias("x"), F.expr("bit_xor(c)").alias("c"))
        .where("n <> 0 OR x <> 0 OR c <> 0")
    )
    totals = _peeled(apart, each, rounds).groupBy("id", "pair").agg(
        F.sum(F.expr("CASE WHEN cell < 0 THEN n ELSE 0 END")).alias("recovered"),
        F.sum(F.expr("CASE WHEN cell >= 0 THEN 1 ELSE 0 END")).alias("left"),
    )
    return totals.selectExpr("id", f"CAST(pair % {1 << bits} AS INT) AS pair", f"{each} AS each", "recovered", "left")


def differences(
    rows: DataFrame,
    sides: dict[str, str],
    pairs: list[tuple[str, str]],
    *,
    cells: int,
    tasks: int,
    rounds: int = ROOM_ROUNDS,
) -> DataFrame:
    """`(id, pair, recovered)`, a stored table: how many digests of a pair differ.

    `rows`, a stored table, has an `id` and array columns of digests. Pairs without a
    difference have no row. Those that do not peel are tried again with sketches
    `GROWTH` times as large.
    """
    by_id = rows.select("id", *sides.values()).repartition(tasks, "id")
    apart = _subtracted(_sketched(by_id, sides, cells), pairs)
    each = f"greatest({cells // TABLES}L, {ROOM} * about) AS each"
    # One query, so both uses of `by_id` are one shuffle.
    sized, solved = by_id.join(_estimated(apart, cells).selectExpr("id", "pair", each), "id"), None
    while True:
        tries = stash(_differing(sized, sides, pairs, rounds))
        done = tries.where("left = 0").select("id", "pair", "recovered")
        solved = done if solved is None else solved.union(done)
        todo = tries.where("left > 0").selectExpr("id", "pair", f"{GROWTH} * each AS each")
        failed = todo.count()
        if not failed:
            return solved
        some = F.broadcast(todo) if failed <= BROADCAST_ROWS else todo
        sized = rows.select("id", *sides.values()).join(some, "id").repartition("id")


def recovered_digests(
    rows: DataFrame, left: str, right: str, *, cells: int = CELLS, rounds: int = ROUNDS
) -> DataFrame:
    """`(id, digest, is_left)`: the digests that only one of two array columns holds.

    The general form of the comparison: pairs that do not peel are tried again
    with larger sketches until all are recovered.
    """
    todo, found = rows, None
    while True:
        apart = _subtracted(_sketched(todo, {"a": left, "b": right}, cells), [("a", "b")])
        peeled = stash(_peeled(apart, cells // TABLES, rounds, "digest"))
        failed = stash(peeled.where("cell >= 0").select("id").distinct())
        done = peeled.where("cell < 0").join(failed, "id", "left_anti").selectExpr("id", "digest", "n > 0 AS is_left")
        found = done if found is None else found.union(done)
        if failed.isEmpty():
            return found
        todo = stash(todo.join(failed, "id", "left_semi"))
        cells *= GROWTH


def _buckets(docs: DataFrame, tasks: int) -> tuple[Column, list[tuple[int, int, int]]]:
    """Runs of ids as even as the quantiles are: the column, and `(greatest id, run, run above)`.

    A run is found in two steps among about the root of `tasks` bounds each.
    The driver has one bound and one id for each task.
    """
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    share = [k / tasks for k in range(1, tasks)]
    row = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), 20 * tasks).alias("b")).first() if share else None
    bounds = sorted(set((row.b if row else None) or []))
    wide = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[wide - 1 :: wide]
    as_array = lambda values: "array(" + ", ".join(f"{v}L" for v in values) + ")"
    if bounds:
        step = f"size(filter({as_array(coarse)}, b -> b < doc_id))"
        run = f"{step} * {wide} + size(filter(slice({as_array(bounds)}, {step} * {wide} + 1, {wide}), b -> b < doc_id))"
    else:
        run = "0"
    found = ids.groupBy(F.expr(run).cast("int").alias("run")).agg(F.max("doc_id").alias("top")).collect()
    tops = sorted((r.run, r.top) for r in found)
    # The first id of a run, in descending order, follows the last one of the run above.
    ghosts = [(top, run, tops[(k + 1) % len(tops)][0]) for k, (run, top) in enumerate(tops)]
    return F.expr(run).cast("int"), ghosts


def with_next(docs: DataFrame) -> DataFrame:
    """`(doc_id, text, digests, next_text, next_digests)`: the next document by descending id.

    After the last one comes the first. Texts are shuffled once, to the run of
    their ids; the first document of a run goes to the end of the run before as
    well. Of equal ids the one with the lesser hash of its text comes first. A
    row without an id is its own next document.
    """
    spark = docs.sparkSession
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    run, ghosts = _buckets(docs, tasks)
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "digests", paragraph_digests(F.col("text"))
    )
    numbered = read.where("doc_id IS NOT NULL").withColumn("run", run)
    firsts = spark.createDataFrame(ghosts, "doc_id long, run int, above int").select("doc_id", "above")
    placed = (
        numbered.join(F.broadcast(firsts), "doc_id", "left")
        .withColumn("seats", F.expr("""CASE WHEN above IS NULL THEN array(struct(run, false AS is_ghost))
            ELSE array(struct(run, false AS is_ghost), struct(above AS run, true AS is_ghost)) END"""))
        .select("doc_id", "text", "digests", F.explode("seats").alias("seat"))
        .select("doc_id", "text", "digests", "seat.*")
    )
    order = Window.partitionBy("run").orderBy("is_ghost", F.desc("doc_id"), F.xxhash64("text"))
    followed = placed.select(
        "doc_id", "text", "digests", "is_ghost",
        F.lead("text").over(order).alias("next_text"),
        F.lead("digests").over(order).alias("next_digests"),
    )
    alone = read.where("doc_id IS NULL").select(
        "doc_id", "text", "digests", F.col("text").alias("next_text"), F.col("digests").alias("next_digests")
    )
    return followed.where("NOT is_ghost").drop("is_ghost").unionByName(alone)


def _tasks(rows: DataFrame, sides: dict[str, str]) -> int:
    """Tasks of about `TASK_DIGESTS` digests, so what one holds does not grow with the table."""
    held = " + ".join(f"size({column})" for column in sides.values())
    total = rows.agg(F.sum(F.expr(held))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_DIGESTS))


def _serialised(name: str) -> Column:
    """A sketch as text: cell, count, XOR and check of each cell that is not empty."""
    used = F.filter("cells", lambda c: c[f"n_{name}"] != 0)
    fields = lambda c: F.concat(
        F.lpad(F.hex(c["cell"]), 4, "0"), F.lpad(F.hex(c[f"n_{name}"]), 8, "0"),
        F.lpad(F.hex(c[f"x_{name}"]), 16, "0"), F.lpad(F.hex(c[f"c_{name}"]), 8, "0"),
    )
    return F.base64(F.unhex(F.array_join(F.transform(used, fields), "")))


def fingerprints(docs: DataFrame, *, cells: int = CELLS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    `(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)`. The edited text has its last third replaced by as
    much of the next document's beginning. Likeness is 1 less the number of
    recovered digests over the number of all, 1 for two texts without any.

    Cases. NULL is the empty text. Equal ids, NULL ids, ties: see `with_next`.
    Repeated rows are each reported. Further columns are not read; a single
    document is its own next one. An empty table gives none.
    """
    third = F.expr("CAST(floor(n_chars / 3) AS INT)")
    texts = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(
        F.expr("substring(text, 1, CAST(n_chars AS INT) - third)"), F.expr("substring(next_text, 1, third)")
    )
    base = stash(
        texts.withColumn("third", third)
        .withColumn("edited", edited)
        .select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            F.monotonically_increasing_id().alias("id"),
            "digests", paragraph_digests(F.col("edited")).alias("edited_digests"), "next_digests",
        )
    )
    sides = {"own": "digests", "edited": "edited_digests", "next": "next_digests"}
    pairs = [("own", "edited"), ("own", "next")]
    tasks = _tasks(base, sides)
    own = {name: sides[name] for name in ("own", "edited")}
    sketches = _sketched(base.select("id", *own.values()).repartition(tasks, "id"), own, cells)
    sums = [f"{kind}_{name}" for name in own for kind in ("n", "x", "c")]
    prints = (
        sketches.groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("cell", *sums))).alias("cells"))
        .select("id", _serialised("own").alias("fingerprint"), _serialised("edited").alias("edited_fingerprint"))
    )
    solved = differences(base, sides, pairs, cells=cells, tasks=tasks)
    apart = solved.groupBy("id").agg(
        *[F.sum(F.expr(f"CASE WHEN pair = {k} THEN recovered ELSE 0 END")).alias(f"apart_{k}") for k in (0, 1)]
    )
    likeness = lambda k: F.expr(
        f"CASE WHEN all_{k} = 0 THEN 1D ELSE 1D - coalesce(apart_{k}, 0) / all_{k} END"
    )
    return (
        base.select(
            "id", "doc_id", "n_chars", "edited_sha256",
            F.expr("size(digests) + size(edited_digests)").alias("all_0"),
            F.expr("size(digests) + size(next_digests)").alias("all_1"),
        )
        .join(prints, "id", "left")
        .join(apart, "id", "left")
        .select(
            "doc_id", "n_chars", "edited_sha256",
            F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
            F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
            likeness(0).alias("near_edited"), likeness(1).alias("near_next"),
        )
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
