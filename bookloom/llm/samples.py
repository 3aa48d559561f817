"""Bounded samples of groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from bookloom.operators.scale import first_rows
from bookloom.session import cut_lineage

#: groups whose sizes are sent to all tasks; more are joined by a shuffle
SENT_GROUPS = 100_000


def smallest_hashes(df: DataFrame, group: str, h: str, k: int, out: str = "r") -> DataFrame:
    """The k rows of each group with the smallest 64-bit hash h, numbered from 1 in `out`; ties by the other columns.

    The group's size tells below which hash about k rows and ten standard deviations more are found; rows above it are dropped
    where they are read, so all tasks together send little more than k rows of a group, not k rows each. A group that still has fewer
    than k rows below its bound though it has more (hashes that are not spread) is taken whole. Null groups are dropped; an
    empty table gives an empty result.
    """
    df = cut_lineage(df.where(F.col(group).isNotNull()))
    room = k + 10 * math.sqrt(k) + 100
    below = F.col(h).cast("double") <= -2.0 ** 63 + F.least(F.lit(1.0), room / F.col("_n")) * 2.0 ** 64

    def beside(sizes: DataFrame) -> DataFrame:
        return df.join(F.broadcast(sizes) if sizes.count() <= SENT_GROUPS else sizes, group)

    sizes = cut_lineage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))
    found = beside(sizes).groupBy(group).agg(F.count_if(below).alias("_m"))
    sizes = cut_lineage(sizes.join(found, group).select(group, F.when(F.col("_m") >= F.least(F.lit(k), "_n"), F.col("_n"))
                                                        .otherwise(F.lit(1)).alias("_n")))
    near = beside(sizes).where(below).drop("_n")
    return first_rows(near, [group], [F.col(h), *[F.col(c) for c in df.columns if c not in (group, h)]], k, out)
