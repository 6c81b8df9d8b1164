"""What the joins ask of their keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of just that name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_same_type(left: DataFrame, right: DataFrame, key: str) -> None:
    """The joins compare hashes of the key, which differ between types, and
    between texts that a collation takes for equal."""
    left_type, right_type = left.schema[key].dataType, right.schema[key].dataType
    for kind in (left_type, right_type):
        if "collate" in kind.simpleString():
            raise TypeError(
                f"key {key!r} is {kind.simpleString()}; only binary collation is compared by hash: "
                "cast it to string, or join on a normalised copy"
            )
    if left_type != right_type:
        raise TypeError(
            f"key {key!r} is {left_type.simpleString()} on one side and "
            f"{right_type.simpleString()} on the other; cast one of them"
        )


def require_free_name(key: str, taken: Iterable[str]) -> None:
    """The result must not hold two columns of one name."""
    if key.lower() in taken:
        raise ValueError(f"the key column is named {key!r}, as a column of the result; rename it")
