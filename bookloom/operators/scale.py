"""Building blocks that keep hot keys from ending up in one task.

* ``ranked``       row numbers inside groups of any size (a plain window would sort a hot group in one task)
* ``first_rows``   the first k rows of each group; Spark prunes each map task to k rows per group before the shuffle
* ``salted_join``  equi-join whose left side is a table with hot keys; only the hot keys are salted
* ``run_join``     equi-join of lists with those that ask for them, whose result is their product, in even tasks

Other joins are left to adaptive execution, which splits skewed partitions of a sort-merge join at run time. The
explicit form is for joins straight on a table, where finding the hot keys is one pruned scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bookloom.session import cut_lineage

HOT_ROWS = 1_000_000
SALTS = 64
RUN = 256
SIDE = 2048
CUTS = 4096
TASK = 1 << 20
PIECES = 512
TRACKED = 1024


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str,
           size: str | None = None) -> DataFrame:
    """Number the rows of each group 1..n in the given (total) order; optionally add the group size.

    Rows are range-partitioned on (group, order), so a group with a third of all rows spreads over a third of
    the partitions. Each partition is sorted and numbered locally; one small table (a row per group and
    partition) turns local numbers into global ones. The numbered rows are written once (cut_lineage), so both
    readers see the same partitioning whatever happens to the executors.
    """
    group = list(group)
    keys = [F.col(c).asc_nulls_first() for c in group] + list(order)
    local = cut_lineage(
        df.repartitionByRange(*keys)
          .sortWithinPartitions(*keys)
          .withColumn("_row", F.monotonically_increasing_id())
          .withColumn("_part", F.shiftright("_row", 33))
    )
    block = local.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # at most (#partitions + #groups) rows, and no group has more than #partitions of them
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = block.select("_part", *group, (before - F.col("_first") + 1).alias("_shift"),
                         *([F.sum("_n").over(w).alias(size)] if size else []))
    renamed = block.select("_shift", *([size] if size else []), F.col("_part").alias("_bp"),
                           *[F.col(c).alias(f"_b_{c}") for c in group])
    on = F.col("_part") == F.col("_bp")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    side = renamed if group else F.broadcast(renamed)  # without groups: one row per partition
    return (local.join(side, on, "left")
            .withColumn(out, (F.col("_row") + F.col("_shift")).cast("long"))
            .drop("_row", "_part", "_shift", "_bp", *[f"_b_{c}" for c in group]))


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int = 1,
               out: str | None = None) -> DataFrame:
    """The first k rows of each group. The planner puts a group limit before the shuffle, so a hot key sends
    at most k rows per map task."""
    name = out or "_rn"
    w = Window.partitionBy(*group).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return kept if out else kept.drop(name)


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of the keys with more than hot_rows rows, at most TRACKED/2 of them.

    A frequent-items sketch of fixed size per task finds every key that holds more than about 1/TRACKED*1.4 of the rows;
    nothing is shuffled but the sketches, and these are merged in two steps. A missed or extra key only changes how rows
    are spread, never the result.
    """
    sketches = df.select(F.xxhash64(*on).alias("_hk")).groupBy(F.pmod(F.spark_partition_id(), F.lit(256)).alias("_g")) \
                 .agg(F.expr(f"approx_top_k_accumulate(_hk, {TRACKED})").alias("_s"))
    # grouped, because the ungrouped form of this aggregate fails on a partition without rows
    merged = sketches.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_combine(_s, {TRACKED})").alias("_s"))
    top = merged.selectExpr(f"inline(approx_top_k_estimate(_s, {TRACKED // 2}))")
    return top.where(F.col("count") > hot_rows).select(F.col("item").alias("_hk"), F.lit(True).alias("_hot"))


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS,
                salts: int = SALTS, hot_from: DataFrame | None = None) -> DataFrame:
    """Equi-join where the left side may have hot keys and the right side has few rows per key.

    Left rows of hot keys are spread over `salts` sub-keys by the hash of the row, the right rows of these keys
    are copied once per salt, everything else is joined as it is. `hot_from` is where to look for hot keys when the
    left side is itself costly to compute.
    """
    on = list(on)
    hot = F.broadcast(hot_keys(hot_from if hot_from is not None else left, on, hot_rows))  # at most TRACKED/2 rows
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts))
                    .cast("int")).otherwise(F.lit(0))
    big = (left.withColumn("_hk", F.xxhash64(*on)).join(hot, "_hk", "left")
           .withColumn("_salt", spread).drop("_hk", "_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    small = (right.withColumn("_hk", F.xxhash64(*on)).join(hot, "_hk", "left")
             .withColumn("_salt", F.explode(copies)).drop("_hk", "_hot"))
    return big.join(small, on + ["_salt"], how).drop("_salt")


def run_join(lists: DataFrame, asked: DataFrame, on: Sequence[str], run: int = RUN, pieces: int = PIECES,
             hot_rows: int = SIDE, salts: int = CUTS) -> DataFrame:
    """Inner equi-join where both sides may have many rows per key, in even tasks and with the rows of the product in an order that packs well.

    Up to `run` rows of `asked` go through a list together, so a row of the list comes out that often in a row, and the same few rows of
    `asked` come again with the next. Both are a few bytes in a columnar file; a row of `asked` that goes through the list alone makes
    a copy of it, and a list longer than a codec looks back on is written out anew each time.
    The work lies in the rows that come out, of which the bytes that are shuffled say nothing. So there is a task for each TASK of them, and from
    `pieces` tasks on they grow to 32 times as many rows before there are more. Where a side of a key has over `hot_rows` rows it is cut into
    pieces of about so many, at most `salts`; a row of the one side meets each piece of the other, so one copy of a row makes `hot_rows` rows.
    """
    on, rest = list(on), [c for c in asked.columns if c not in on]
    both = lists.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_a")).unionByName(asked.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_a")))
    sizes = cut_lineage(both.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_a").alias("_a")))
    # what comes out, and what goes in: to shuffle and sort a row takes about as long as eight rows that come out
    work = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_a") + 8.0 * (F.col("_l") + F.col("_a")))).first()[0] or 0
    tasks = max(1, min(pieces, math.ceil(work / TASK)), math.ceil(work / (32 * TASK)))
    cuts = [F.least(F.lit(salts), F.ceil(F.col(c) / hot_rows)).cast("int").alias(f"{c}n") for c in ("_l", "_a")]
    dealt = sizes.where(F.greatest("_l", "_a") > hot_rows).select(*on, *cuts)
    keys = [*on, "_l", "_a"]

    def side(d: DataFrame, own: str, other: str) -> DataFrame:
        row = F.xxhash64(*[F.col(c) for c in d.columns])
        return (d.join(dealt, on, "left").withColumn(own, F.coalesce(F.pmod(row, F.col(f"{own}n")).cast("int"), F.lit(0)))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}n", F.lit(1)) - 1)))
                .drop("_ln", "_an").repartition(tasks, *keys))

    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))  # any order: which rows go together does not matter
    together = side(asked, "_a", "_l").withColumn("_run", F.floor((number - 1) / run)) \
        .groupBy(*keys, "_run").agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    # a merge join goes through its left side and holds the rows of a key of its right side. What comes of one row of the left side waits in
    # memory where the product is made in the same step; coalesce, which changes nothing else, makes it a step of its own
    met = together.hint("merge").join(side(lists, "_l", "_a"), keys, "inner").coalesce(tasks)
    others = [c for c in lists.columns if c not in on]
    return met.select(*on, *others, F.inline("_rows")).select(*on, *rest, *others)
