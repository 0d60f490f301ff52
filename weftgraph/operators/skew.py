"""Joins whose hot keys don't land in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows, and more than HOT_LEAST rows, is hot: there are at most 1 / HOT_SHARE of them.
HOT_SHARE, HOT_LEAST = 1e-4, 100


def joined_by_share(rows: DataFrame, counted: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """rows joined with counted, which has each key once and in column n how many of the total rows have it (or more than that).

    Hot keys are joined by broadcast, at most 1 / HOT_SHARE rows of counted whatever the input, and their rows stay where they
    are; all others by a sort-merge join at any size, none of whose keys brings a task more than that share. Both inputs are read
    twice, so
    they are better written or cheap.
    """
    key = [key] if isinstance(key, str) else key
    most = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = F.broadcast(counted.where(F.col(n) > most))
    cold = rows.join(F.broadcast(counted.where(F.col(n) > most).select(*key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(counted.where(F.col(n) <= most).hint("merge"), key))
