"""Left join to a table with one row per key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import require_same_type

_KEY_HASH = "__key_hash"


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` with the columns of `table`, which is unique in `key`.

    A small table is broadcast by Spark itself, on measured size. Otherwise this
    is a sort-merge join in which one key may hold any share of `rows`: adaptive
    execution splits such a partition between tasks. It does so only if both
    inputs are shuffled for the join directly, but `table` comes out of an
    aggregation already partitioned by `key` and would be taken as it is. The
    hash in front of the key asks for its own shuffle; it also gives the sort an
    8-byte prefix that differs, where long names often start alike.
    """
    require_same_type(rows, table, key)
    return (
        rows.withColumn(_KEY_HASH, F.xxhash64(key))
        .join(table.withColumn(_KEY_HASH, F.xxhash64(key)), [_KEY_HASH, key], "left")
        .drop(_KEY_HASH)
    )
