"""Joins whose keys may be hot: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many rows, so there are never more hot keys than this.
HOT = 1_000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``rows`` joined by ``key`` to ``per_key``, which has one row a key and the key's number of rows as ``n`` (dropped).

    ``rows`` is read twice: hot keys, at most ``HOT`` whatever the input, are broadcast, so their rows stay where they are;
    the rest is shuffled, and none of its keys has more than a thousandth of all rows. Rows without a partner are dropped.
    """
    hot = F.col(n) * HOT > max(total, HOT)
    few, rest = per_key.filter(hot).drop(n), per_key.filter(~hot).drop(n)
    near = rows.join(F.broadcast(few), key)
    return near.unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))
