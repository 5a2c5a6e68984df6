"""Joins that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than this share of all rows, so there are at most
#: 1 / HEAVY_SHARE heavy keys: the proven bound of the broadcast side.
HEAVY_SHARE = 1 / 2048


def join_by_weight(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key and in ``weight``
    the number of rows of that key. Heavy keys are joined by broadcast (at most
    1 / HEAVY_SHARE of them), all others by a shuffle in which no key is large."""
    heavy_from = total * HEAVY_SHARE
    heavy = F.broadcast(keyed.filter(F.col(weight) > heavy_from))
    light = keyed.filter(F.col(weight) <= heavy_from)
    rest = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key))
