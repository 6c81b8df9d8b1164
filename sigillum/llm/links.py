"""Exact links between sets that share keys, as forests instead of all pairs.

Sets with a common key are a bucket, named by its centre, the least of them;
buckets of one centre are one. All links within a bucket are found, but only as
many are returned as connect what is connected:

1. The centre is compared with all others (a star).
2. Where the others are in several components, the bucket is open. It is compared
   block by block; a group is two blocks, and returns a spanning forest. Members of
   the largest component need no comparison with each other. Where the others are
   `LEFTS` blocks at most, groups grow with the bucket only, and `2 * LEFTS` times its
   sets are moved at most.
3. Where the others are more, the bucket elects a new centre before, the member with
   most links so far, which is compared with those that are still apart from it; and
   so on for some rounds.

Every comparison is on full sets.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from .common import mix64, slices, stash
from .components import BROADCAST_ROWS, components, least_labels
from .shingles import Powers, shingle_sets

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 2
BLOCK = 512  # sets
LEFTS = 4  # blocks outside the largest component that are compared without a new centre
WEIGHT = 1 << 20  # shingles of a group
COLUMNS = 2048
RANGE = 1 << 18
CELLS = 1 << 12

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_LINK = "a long, b long"
_RIGHT, _LEFT, _BOTH = range(3)


def _measured(stored: DataFrame) -> DataFrame:
    """A stored table of ids, broadcast in a join if it has few rows; beyond, Spark shuffles both sides."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, size and values of the sets of a group."""
    sets = rows.column("shingles").combine_chunks()
    return rows.column("node").to_numpy(), sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()


def _star(pct: int) -> Callable[[pa.Table], pa.Table]:
    def compare(rows: pa.Table) -> pa.Table:
        node, size, values = _flat(rows)
        is_centre = rows.column("is_centre").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(node)), size)
        of_centre = is_centre[owner]
        centre = np.sort(values[of_centre])
        if not len(centre):
            return _pairs(node[:0], node[:0])
        others, owner = values[~of_centre], owner[~of_centre]
        place = np.minimum(np.searchsorted(centre, others), len(centre) - 1)
        common = np.bincount(owner[centre[place] == others], minlength=len(node))
        linked = (100 * common >= pct * (size + len(centre) - common)) & ~is_centre
        return _pairs(node[linked], np.full(int(linked.sum()), node[is_centre][0]))

    return compare


def confirmed_stars(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The links among distinct `(centre, member)` pairs.

    `sets` has `(node, size, shingles)`. A member's set travels once for each of
    its centres, a centre's once for each `WEIGHT` shingles of its members, which
    are dealt into groups of that size.
    """
    size = sets.select("node", "size")
    sized = lookup(pairs, size.withColumnsRenamed({"node": "member", "size": "m"}), "member")
    sized = lookup(sized, size.withColumnsRenamed({"node": "centre", "size": "c"}), "centre").where(
        f"100L * least(m, c) >= {pct}L * greatest(m, c)"
    )
    sized = stash(sized.select("centre", "member", "m"))
    chunks = stash(sized.groupBy("centre").agg(F.ceil(F.sum("m") / WEIGHT).cast("int").alias("chunks")))
    dealt = stash(lookup(sized, chunks, "centre").select(
        "centre", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int").alias("chunk"), F.col("member").alias("node")
    ))
    members = sets.join(_measured(dealt), "node").select("centre", "chunk", "node", F.lit(False).alias("is_centre"), "shingles")
    as_nodes = _measured(chunks.withColumn("node", F.col("centre")))
    centres = (
        sets.join(as_nodes, "node")
        .select("centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node",
                F.lit(True).alias("is_centre"), "shingles")
    )
    return members.union(centres).groupBy("centre", "chunk").applyInArrow(_star(pct), _LINK)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges, in their order, connect something that was apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


def _blocks(pct: int) -> Callable[[pa.Table], pa.Table]:
    def compare(rows: pa.Table) -> pa.Table:
        node, size, values = _flat(rows)
        label = rows.column("label").to_numpy()
        side = rows.column("side").to_numpy()
        owner = np.repeat(np.arange(len(node)), size)
        left, right = np.flatnonzero(side != _RIGHT), np.flatnonzero(side != _LEFT)
        common = np.zeros((len(left), len(right)), np.float32)
        # Hashes are even, so ranges of them bound the memory, however long the texts are.
        bounds = np.linspace(-(2.0**63), 2.0**63, 2 + len(values) // RANGE)[1:-1].astype(np.int64)
        part = np.searchsorted(bounds, values, "right") if len(bounds) else np.zeros(len(values), np.int8)
        for k in range(len(bounds) + 1):
            inside = np.flatnonzero(part == k)
            _, column, times = np.unique(values[inside], return_inverse=True, return_counts=True)
            is_shared = times > 1
            keep = is_shared[column]
            who, column = owner[inside][keep], (np.cumsum(is_shared) - 1)[column[keep]]
            order = np.argsort(column, kind="stable")
            who, column = who[order], column[order]
            for start in range(0, int(is_shared.sum()), COLUMNS):
                a, b = np.searchsorted(column, (start, start + COLUMNS))
                grid = np.zeros((len(node), COLUMNS), np.float32)
                grid[who[a:b], column[a:b] - start] = 1
                common += grid[left] @ grid[right].T
        common = common.astype(np.int64)
        union = size[left][:, None] + size[right][None, :] - common
        i, j = np.nonzero((100 * common >= pct * union) & (label[left][:, None] != label[right][None, :]))
        some = _forest(label[left][i], label[right][j])
        return _pairs(node[left][i[some]], node[right][j[some]])

    return compare


def _seated(rows: DataFrame, sets: DataFrame, *, is_apart: bool = False) -> DataFrame:
    """`(bucket, node, label, main, lefts, rights)` of rows `(bucket, node, label)`.

    `main` is the label that most of a bucket have, `lefts` counts the blocks of
    nodes outside it, `rights` those of all. With `is_apart`, a label is one node's.
    """
    sized = lookup(rows.select("bucket", "node", "label"), sets.select("node", "size"), "node")
    if is_apart:
        by_label = sized.selectExpr("bucket", "label", "1L AS n", "size AS w")
    else:
        by_label = sized.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    seats = by_label.groupBy("bucket").agg(
        F.max(F.struct("n", "w", "label")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w")
    ).selectExpr(
        "bucket",
        "main.label AS main",
        f"CAST(ceil(greatest((n - main.n) / {BLOCK}, (w - main.w) / {WEIGHT})) AS INT) AS lefts",
        f"CAST(ceil(greatest(n / {BLOCK}, w / {WEIGHT})) AS INT) AS rights",
    )
    return lookup(sized.drop("size"), seats, "bucket")


def _compared_blocks(rows: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """A forest of the links between nodes of a bucket with different labels.

    `rows` has `(bucket, node, label)`, and what `_seated` adds if it is known.
    Nodes outside the label that most have are on the left and meet all, on the
    right; both sides are dealt into blocks, and a group is two blocks. A bucket of
    one block is one group.
    """
    seated = rows if "main" in rows.columns else _seated(rows, sets)
    seat = "struct({} AS left_block, {} AS right_block, {} AS side)"
    dealt = "CAST(pmod(xxhash64(node), {}) AS INT)"
    on_right = f"transform(sequence(0, lefts - 1), b -> {seat.format('b', dealt.format('rights'), _RIGHT)})"
    on_left = f"transform(sequence(0, rights - 1), b -> {seat.format(dealt.format('lefts'), 'b', _LEFT)})"
    one = f"array({seat.format('0', '0', f'IF(label = main, {_RIGHT}, {_BOTH})')})"
    places = f"explode(CASE WHEN rights = 1 THEN {one} WHEN label = main THEN {on_right} ELSE concat({on_right}, {on_left}) END)"
    placed = stash(seated.select("bucket", "node", "label", F.expr(places).alias("seat")).select("bucket", "node", "label", "seat.*"))
    return (
        sets.select("node", "shingles")
        .join(_measured(placed), "node")
        .groupBy("bucket", "left_block", "right_block")
        .applyInArrow(_blocks(pct), _LINK)
    )


def bucket_forest(
    buckets: DataFrame,
    sets: DataFrame,
    pct: int,
    *,
    given: DataFrame | None = None,
    has_stars: bool = True,
    rounds: int = ROUNDS,
) -> DataFrame:
    """`(node, component)` of the nodes that links within buckets, and those `given`, connect.

    `buckets` has distinct `(centre, node)`; `sets` has `(node, size, shingles)`
    of all. Both are stored tables. Links are pairs with 100 * intersection >=
    `pct` * union. Without stars, a bucket that fits into a group is compared at once.
    """
    centres = buckets.select("centre").distinct()
    rows = buckets.select(F.col("centre").alias("bucket"), "node")
    whole = rows.union(centres.select(F.col("centre").alias("bucket"), F.col("centre").alias("node")))
    parts = []
    if has_stars:
        stars = buckets.select("centre", F.col("node").alias("member"))
    else:
        seated = stash(_seated(whole.withColumn("label", F.col("node")), sets, is_apart=True))
        parts.append(_compared_blocks(seated.where("rights = 1"), sets, pct))
        rows = seated.where("rights > 1 AND node <> bucket").select("bucket", "node")
        stars = rows.select(F.col("bucket").alias("centre"), F.col("node").alias("member"))
    parts.append(confirmed_stars(stars, sets, pct))
    links = stash(reduce(DataFrame.union, parts))
    links = links if given is None else links.union(given)
    labels = components(links)
    for step in range(rounds + 1):
        named = lookup(rows, labels, "node").select("bucket", "node", F.coalesce("component", "node").alias("label"))
        spread = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        rows = stash(lookup(named, spread.where("low < high"), "bucket").where("low IS NOT NULL")
                     .select("bucket", "node", "label"))
        if rows.isEmpty():
            return labels
        seated = stash(_seated(rows, sets))
        large = seated.where(f"lefts > {LEFTS}")
        is_last = step == rounds or large.isEmpty()
        found = _compared_blocks(seated if is_last else seated.where(f"lefts <= {LEFTS}"), sets, pct)
        if not is_last:
            rows, more = _elected(large, links, sets, pct)
            found = found.union(more)
        found = stash(found)
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
        if is_last:
            break
        rows = rows.select("bucket", "node")
    return labels


def _elected(rows: DataFrame, links: DataFrame, sets: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """What is left to compare after a new centre of each bucket, and the links it has."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    chosen = (
        lookup(rows.select("bucket", "node", "label"), degree, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("node")).alias("minus"), "label")).alias("c"))
        .select("bucket", (-F.col("c.minus")).alias("centre"), F.col("c.label").alias("own"))
    )
    rows = stash(lookup(rows.select("bucket", "node", "label"), chosen, "bucket").where("node <> centre"))
    pairs = rows.where("label <> own").select("centre", F.col("node").alias("member")).distinct()
    return rows, confirmed_stars(pairs, sets, pct)


def bin_counts(found: np.ndarray) -> bytes:
    """How many of a set of sorted hashes are in each range of them, 255 at most: a byte each.

    A power of two of ranges, about a quarter of the elements. Neighbours add up
    to the counts of half as many.
    """
    bits = min(16, max(6, (len(found) // 4).bit_length()))
    bins = (found >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(bins, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _near(pct: int) -> Callable[[pa.Table], pa.Table]:
    def compare(rows: pa.Table) -> pa.Table:
        node, size = rows.column("node").to_numpy(), rows.column("size").to_numpy()
        counts = [np.frombuffer(c, np.uint8) for c in rows.column("counts").to_pylist()]
        width = min(map(len, counts))
        table = np.stack([
            np.minimum(c.reshape(width, -1).sum(axis=1, dtype=np.int32), 255) for c in counts
        ]).astype(np.int16)
        left, right = [], []
        order = np.argsort(node)
        node, size, table = node[order], size[order], table[order]
        for k in range(len(node) - 1):
            apart = np.abs(table[k + 1 :] - table[k]).sum(axis=1, dtype=np.int64)
            other = size[k + 1 :]
            may = ((100 + pct) * apart <= (100 - pct) * (size[k] + other)) & (
                100 * np.minimum(size[k], other) >= pct * np.maximum(size[k], other)
            )
            right.append(k + 1 + np.flatnonzero(may))
            left.append(np.full(len(right[-1]), k))
        i = np.concatenate([np.zeros(0, np.int64), *left])
        j = np.concatenate([np.zeros(0, np.int64), *right])
        label = least_labels(i, j, len(node))  # every set has an edge to the first of its own
        moved = np.flatnonzero(label != np.arange(len(node)))
        return _pairs(node[label[moved]], node[moved])

    return compare


def narrowed(buckets: DataFrame, bounds: DataFrame, pct: int) -> DataFrame:
    """Buckets `(centre, node)` of sets that may be similar by their counts, most of them smaller.

    `bounds` has `(node, size, counts)` with `bin_counts` of each set. Two sets
    differ in as many elements at least as their counts do, so a pair whose counts
    are too far apart is no link. What is left of the pairs of all buckets that fit
    into a group connects sets into new buckets, where each set is once. Larger
    buckets stay as they are.
    """
    centres = buckets.select("centre").distinct()
    whole = buckets.select(F.col("centre").alias("bucket"), "node").union(
        centres.select(F.col("centre").alias("bucket"), F.col("centre").alias("node"))
    )
    seated = _seated(whole.withColumn("label", F.col("node")), bounds, is_apart=True)
    sized = stash(seated.select("bucket", "node", (F.col("rights") == 1).alias("fits")))
    small = sized.where("fits").select("bucket", "node")
    near = stash(bounds.join(small, "node").groupBy("bucket").applyInArrow(_near(pct), _LINK))
    groups = components(near).select(F.col("component").alias("centre"), "node")
    large = sized.where("NOT fits").select(F.col("bucket").alias("centre"), "node")
    return stash(groups.union(large).where("node <> centre").distinct())


def set_digest(found: np.ndarray) -> bytes | None:
    """128 bits that tell a set of hashes; none of an empty one."""
    if not len(found):
        return None
    return np.array([found.sum(), mix64(found ^ _GOLDEN).sum()], np.uint64).tobytes()


def _set_reader(words: int) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, end, raw, offsets in slices(batch.column(1)):
                sets = list(shingle_sets(raw, offsets, words, powers))
                wanted = batch.column(2).slice(first, end - first).to_pylist()
                right = [k for k, found in enumerate(sets) if set_digest(found) == wanted[k]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first).take(pa.array(right, pa.int64())),
                        pa.array([len(sets[k]) for k in right], pa.int64()),
                        pa.array([sets[k].view(np.int64) for k in right], pa.list_(pa.int64())),
                    ],
                    names=["node", "size", "shingles"],
                )

    return read


def key_buckets(keyed: DataFrame) -> DataFrame:
    """Distinct `(centre, node)` of the nodes that share a key of `(node, keys)`.

    The centre is the least node of a key; it has no row of its own. Rows are
    sorted into windows, each of one key. Cells of keys are counted before: those
    with more rows than an average partition hold a hot key, and take an
    aggregation, combined before the shuffle, and a join whose hot partitions
    are split.
    """
    spark = keyed.sparkSession
    rows = keyed.select("node", F.explode("keys").alias("key"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = F.pmod(F.col("key"), F.lit(max(CELLS, 16 * partitions)))
    cells = stash(rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    # Fewer than there are partitions.
    hot = F.broadcast(cells.where(F.col("n") > max(1, total // partitions)).select("cell", F.lit(True).alias("is_hot")))
    named = rows.withColumn("cell", cell).join(hot, "cell", "left").drop("cell")

    window = Window.partitionBy("key")
    usual = named.where("is_hot IS NULL").select("node", F.min("node").over(window).alias("centre"))
    busy = named.where("is_hot").select("key", "node")
    busy = lookup(busy, busy.groupBy("key").agg(F.min("node").alias("centre")), "key").select("node", "centre")
    return stash(usual.union(busy).where("node <> centre").select("centre", "node").distinct())


def sign(named: DataFrame, signer: Callable, *, has_counts: bool = False) -> DataFrame:
    """`(doc_id, text_hash, n_shingles, class, keys, row)`, a stored table, of `(doc_id, text)`.

    `signer` gets batches of ids, texts and hashes, and returns the other columns but
    `row`; with `has_counts`, also `counts`, the `bin_counts` of the set.
    """
    hashed = named.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = "doc_id long, text_hash long, n_shingles long, class binary, keys array<long>"
    schema += ", counts binary" if has_counts else ""
    return stash(hashed.mapInArrow(signer, schema).withColumn("row", F.monotonically_increasing_id()))


def component_ids(
    named: DataFrame, signed: DataFrame, words: int, pct: int, *, has_stars: bool = True
) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` for each row of `named`, which has `(doc_id, text)`.

    `signed` is its result of `sign`, where any two similar sets share a key. Where
    it has counts, buckets are narrowed by them before any set is moved.
    Rows of one set are a class, and only its first row goes on; its text is
    read again where it shares a key with another. Rows of one id are one document.
    """
    usable = signed.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = stash(
        usable.groupBy("class")
        .agg(F.min(F.struct("row", "doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least"))
        .select("class", "least", F.col("first.row").alias("node"), "first.doc_id", "first.text_hash")
    )
    members = lookup(usable.select("row", "doc_id", "class"), classes.select("class", "node"), "class")
    members = stash(members.select("row", "doc_id", "node"))
    others = stash(members.where("row <> node").select("row"))
    keyed = usable.select("row", "keys").join(_measured(others), "row", "left_anti").withColumnRenamed("row", "node")
    buckets = key_buckets(keyed)
    if "counts" in signed.columns:
        bounds = usable.select(F.col("row").alias("node"), F.col("n_shingles").alias("size"), "counts")
        buckets = narrowed(buckets, bounds, pct)
    nodes = buckets.select(F.explode(F.array("node", "centre")).alias("node")).distinct()
    nodes = stash(lookup(nodes, classes.select("node", "doc_id", "text_hash", "class"), "node"))
    sets = stash(
        named.withColumn("text_hash", F.xxhash64("text"))
        .join(_measured(nodes), ["doc_id", "text_hash"])
        .select("node", "text", "class")
        .mapInArrow(_set_reader(words), "node long, size long, shingles array<long>")
    )
    if sets.count() > nodes.count():  # repeated rows
        sets = stash(sets.dropDuplicates(["node"]))

    per_doc = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    same_id = stash(lookup(members, per_doc, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct())
    labels = bucket_forest(
        buckets, sets, pct, given=None if same_id.isEmpty() else same_id, has_stars=has_stars
    )

    labelled = stash(
        lookup(classes, labels, "node").select("class", "least", F.coalesce("component", "node").alias("component"))
    )
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = lookup(labelled.select("class", "component"), least, "component").select("class", "component_id")
    component_id = F.coalesce("component_id", "doc_id")  # without words
    return lookup(signed.select("doc_id", "n_shingles", "class"), per_class, "class").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component_id).alias("component_id")
    )
