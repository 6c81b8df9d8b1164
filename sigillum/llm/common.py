"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder, stash

__all__ = ["few", "free_name", "held_out", "in_share", "mix64", "shared_folder", "slices", "stash", "table"]

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: Iterable[str]) -> str:
    """`name`, with as many underscores behind it as make it differ from all others in any letter case."""
    others = {t.lower() for t in taken}
    while name.lower() in others:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True for documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def in_share(hashed: Column, rows: int, of: int) -> Column:
    """True for about three times `rows` of `of` rows, by a hash; for all of a few.

    Before the least `rows` hashes are taken, so that what the tasks send for it
    does not grow with their number.
    """
    share = min(1.0, 3 * rows / max(1, of))
    return F.pmod(hashed, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def give_back() -> None:
    """Memory that this worker holds but does not use goes back to the machine.

    A worker lives on after its task, and what allocators keep for it would be
    missing to the next stage of a job.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU only
    if trim is not None:
        trim(0)


def slices(column: pa.Array, most_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """`(first, end, bytes, offsets)` of runs of texts, about `most_bytes` long.

    Texts are whole; a longer one is a run of its own. NULL counts as empty.
    """
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    give_back()


def few(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """The values of a batch, some rows at a time, so that they are not all there twice."""
    for first in range(0, len(column), rows):
        yield column.slice(first, rows).to_pylist()
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
