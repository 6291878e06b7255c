"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are sent by broadcast; any other key holds less than 1 / HOT of the rows.
HOT = 10_000


def join_by_key(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, how: str = "inner", hot: int = HOT, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``keys``, which has one row per key, is already written, and tells by
    ``weight`` how many rows each key has.

    A key with more than 1 / ``hot`` of the whole weight is hot, so there are fewer than ``hot`` of them,
    whatever the data: they are broadcast and their rows stay where they are. All others are shuffled by
    key, and no task gets more than a small share for one of them. ``how``: inner or left_semi.
    """
    if total is None:
        total = keys.agg(F.sum(weight)).first()[0] or 0
    often = keys.filter(F.col(weight) > total / hot)
    seldom = keys.filter(F.col(weight) <= total / hot)
    here = rows.join(F.broadcast(often), on, how)
    there = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(seldom, on, how)
    return here.unionByName(there)
