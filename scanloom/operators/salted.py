"""Joining rows to what is known of their group, when a group may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts that each group's rows are dealt into; each group row is sent to all of them.
SALTS = 64


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` with the columns of their group, ``groups`` having one row per ``key``.

    The rows of a group are dealt by ``spread``, so no task gets a whole group.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
