"""Running totals in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bookloom.session import cut_lineage

ADD, XOR = F.sum, F.bit_xor


class Ordered:
    """Rows sorted by (group, order) in range partitions, written once.

    A running total is a local one plus the totals of the group's earlier partitions, of which there is one row per
    partition and group. A group with a third of all rows is spread over a third of the partitions; no task sees more of
    it than a partition. The order should be total; rows that are equal in it are numbered in any order.
    """

    def __init__(self, df: DataFrame, group: Sequence[str], order: Sequence[Column]):
        self.group = list(group)
        keys = [F.col(c).asc_nulls_first() for c in self.group] + list(order)
        self.rows = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                                .withColumn("_row", F.monotonically_increasing_id())
                                .withColumn("_part", F.shiftright("_row", 33)))

    def add(self, name: str, value: Column, total=ADD) -> Ordered:
        """Add the running total of a bigint value, up to and with the row."""
        return self.add_all(total, **{name: value})

    def add_all(self, total=ADD, **values: Column) -> Ordered:
        """Add the running totals of several bigint values in one pass: one sort and one join for all of them."""
        at = {name: i for i, name in enumerate(values)}
        rows = self.rows.withColumns({f"_v{at[n]}": v.cast("long") for n, v in values.items()})
        block = rows.groupBy("_part", *self.group).agg(*[total(f"_v{i}").alias(f"_t{i}") for i in at.values()])
        w = Window.partitionBy(*self.group) if self.group else Window.partitionBy(F.lit(0))  # a row per partition at most
        earlier = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        block = block.select(F.col("_part").alias("_bp"),
                             *[F.coalesce(total(f"_t{i}").over(earlier), F.lit(0)).alias(f"_before{i}") for i in at.values()],
                             *[F.col(c).alias(f"_b{i}") for i, c in enumerate(self.group)])
        inside = Window.partitionBy("_part", *self.group).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
        on = F.col("_part") == F.col("_bp")
        for i, c in enumerate(self.group):
            on = on & F.col(c).eqNullSafe(F.col(f"_b{i}"))

        def whole(i: int) -> Column:
            before, local = F.col(f"_before{i}"), F.col(f"_l{i}")
            return before + local if total is ADD else before.bitwiseXOR(local)

        local = rows.select("*", *[total(f"_v{i}").over(inside).alias(f"_l{i}") for i in at.values()])
        return self._with(local.join(block, on).select(
            *[c for c in self.rows.columns if c not in at], *[whole(i).alias(n) for n, i in at.items()]))

    def only(self, *columns: str) -> Ordered:
        """The same rows in the same order with few columns, for totals that need no more; `rows` keeps `_row`, by which the others join."""
        return self._with(self.rows.select("_row", "_part", *columns))

    def _with(self, rows: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.group, out.rows = self.group, rows
        return out

    def done(self) -> DataFrame:
        return self.rows.drop("_row", "_part")
