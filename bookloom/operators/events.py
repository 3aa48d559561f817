"""Batch forms of the stateful operators: latest values, the block breaker, time-to-live suppression, bookmarks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from bookloom.operators.scale import ranked
from bookloom.session import cut_lineage


def latest_by_key(events: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Last write per key: a partial aggregate, so a busy key costs one row per task."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *fields)).alias("_v")).select(key, *[f"_v.{c}" for c in [*order, *fields]])


def block_breaker(events: DataFrame, source: str, order: Sequence[Column], blocked: Column, limit: int = 3,
                  carry: DataFrame | None = None) -> DataFrame:
    """Per source: tripped (limit blocked answers in a row, sticky), the position that tripped it, the run of blocked
    answers at the end. `carry` (source, run, tripped) continues an earlier result.

    A run of `limit` ends at n exactly when n..n-limit+1 are all blocked, so every blocked row counts for the next
    positions and positions that collect `limit` trip. No task walks a whole source.
    """
    n = ranked(events.select(F.col(source), *[o.alias(f"_o{i}") for i, o in enumerate(order)], blocked.alias("_b")), [source],
               [F.col(f"_o{i}") for i in range(len(order))], "_n")
    marks = n.where("_b").select(source, "_n")
    if carry is not None:
        before = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("run"), F.lit(limit - 1)) - 1), lambda i: -i)
        old = carry.where((F.col("run") > 0) & ~F.col("tripped"))
        marks = marks.unionByName(old.select(source, F.explode(before).alias("_n")))
    hits = (marks.select(source, F.explode(F.sequence(F.col("_n"), F.col("_n") + limit - 1)).alias("_n"))
            .groupBy(source, "_n").count().where(F.col("count") == limit).groupBy(source).agg(F.min("_n").alias("tripped_at")))
    ends = n.groupBy(source).agg(F.max("_n").alias("_all"), F.max(F.when(~F.col("_b"), F.col("_n"))).alias("_ok"))
    if carry is not None:
        ends = ends.join(carry, source, "full").fillna(0, ["run"]).fillna(False, ["tripped"])
    else:
        ends = ends.withColumn("run", F.lit(0).cast("long")).withColumn("tripped", F.lit(False))
    total = F.coalesce("_all", F.lit(0))
    run = F.when(F.col("_ok").isNotNull(), total - F.col("_ok")).otherwise(total + F.col("run"))
    out = ends.join(hits, source, "left")
    return out.select(source, (F.col("tripped") | F.col("tripped_at").isNotNull()).alias("tripped"),
                      F.when(~F.col("tripped"), F.col("tripped_at")).alias("tripped_at"), run.cast("long").alias("run"))


def ttl_dedup(events: DataFrame, key: str, ts: str, ttl: Column, tie: str) -> DataFrame:
    """Keep an event when no kept event of the key is younger than ttl: (key, ts, tie). Rows without key or ts are left out.

    Every event points to the first one of its key that is more than ttl younger; what the pointers lead to from a key's first event
    is kept. The pointers come from two range-sorted numberings: of the events, and of events and their ends of life together. An
    event that follows the one before it by more than ttl is kept whatever was kept before, so pointers end there. Pointers are then doubled: after k rounds
    everything less than 2 ** k steps from a start is marked. So rounds grow with the logarithm of the longest chain, and a busy
    key is spread like any other rows, since all joins are on (key, number). They are sort-merge joins: the tables are so well
    compressed that the planner would send ones of millions of rows to every task.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, tie)
    line = cut_lineage(ranked(rows, [key], [F.col(ts), F.col(tie)], "_n"))
    both = line.select(key, F.col(ts).alias("_at"), F.lit(0).alias("_end"), "_n") \
        .unionByName(line.select(key, (F.col(ts) + ttl).alias("_at"), F.lit(1).alias("_end"), "_n"))
    laid = ranked(both, [key], [F.col("_at"), F.col("_end"), F.col("_n")], "_p", size="_size")
    # the n-th end of life has as many events before it as its place less n
    ahead = cut_lineage(laid.where("_end = 1 and _p - _n < _size / 2").select(key, "_n", (F.col("_p") - F.col("_n") + 1).alias("_to")))
    begin = ahead.where("_to = _n + 1").select(key, F.col("_to").alias("_n"))
    marked = cut_lineage(line.where("_n = 1").select(key, "_n").union(begin))
    jump = cut_lineage(ahead.join(begin.withColumnRenamed("_n", "_to").hint("merge"), [key, "_to"], "left_anti").select(key, "_n", "_to"))
    while True:
        reached = cut_lineage(marked.join(jump.hint("merge"), [key, "_n"]).select(key, F.col("_to").alias("_n")))
        if reached.isEmpty():
            break
        marked = cut_lineage(marked.union(reached).distinct())
        far = jump.select(key, F.col("_n").alias("_to"), F.col("_to").alias("_far"))
        jump = cut_lineage(jump.join(far.hint("merge"), [key, "_to"]).select(key, "_n", F.col("_far").alias("_to")))
    return line.join(marked.hint("merge"), [key, "_n"]).select(key, ts, tie)


class Places:
    """The places 0, 1, 2, ... without those taken away; finds the n-th that is left in a logarithmic number of steps (a sparse
    Fenwick tree over the places taken)."""
    BITS = 40

    def __init__(self):
        self.tree: dict[int, int] = {}
        self.gone: set[int] = set()

    def nth(self, n: int) -> int:
        at = 0
        for bit in reversed(range(self.BITS)):
            left = (1 << bit) - self.tree.get(at + (1 << bit), 0)
            if left <= n:
                n -= left
                at += 1 << bit
        return at

    def take(self, place: int) -> None:
        self.gone.add(place)
        i = place + 1
        while i <= 1 << self.BITS:
            self.tree[i] = self.tree.get(i, 0) + 1
            i += i & -i

    def __contains__(self, place: int) -> bool:
        return place in self.gone


def bookmark_fold(events: DataFrame, key: str, order: str, action: str = "action", item: str = "item", ordinal: str = "ordinal") -> DataFrame:
    """Current bookmark list per book from add (in front) and delete (by place from 0) events: (key, place, item).

    A stretch of events is a small change: items it puts in front, and places of the incoming list it removes. The stretches
    a book has in the partitions are summarised one by one; then every item is carried through the later stretches of its book
    on its own, by the number of items in front of it and the places removed. No list of a book is ever put together.
    """
    kind = dict(events.dtypes)[key]
    keys = [F.col(key), F.col(order)]
    laid = events.select(key, order, action, item, ordinal).repartitionByRange(*keys).sortWithinPartitions(*keys) \
                 .withColumn("_part", F.spark_partition_id())

    class Stretch:
        """What a stretch of one book's events does: items it puts in front, and places of the incoming list it takes away."""

        def __init__(self, name, part):
            self.name, self.part, self.items, self.alive = name, part, [], 0
            self.own, self.incoming = Places(), Places()

        def add(self, it) -> None:
            self.items.append(it)
            self.alive += 1

        def delete(self, at: int) -> None:
            if at < self.alive:
                self.own.take(self.own.nth(self.alive - 1 - at))
                self.alive -= 1
            else:
                self.incoming.take(self.incoming.nth(at - self.alive))

        def rows(self) -> list:
            front = [it for i, it in enumerate(self.items) if i not in self.own][::-1]
            return [(self.name, self.part, None, None, len(front), sorted(self.incoming.gone))] + \
                [(self.name, self.part, i, it, None, None) for i, it in enumerate(front)]

    def summarise(batches: Iterable[pd.DataFrame]):
        now = None  # the stretch of the book being read; the rows come sorted by book
        cols = [key, "_part", "idx", "item", "n", "gone"]
        frame = lambda out: pd.DataFrame(out, columns=cols).astype({"idx": "Int64", "n": "Int64"})
        for b in batches:
            out = []
            for k, part, act, it, at in zip(b[key], b["_part"], b[action], b[item], b[ordinal]):
                if now is None or now.name != k:
                    out += now.rows() if now is not None else []
                    now = Stretch(k, part)
                if act == "add":
                    now.add(it)
                elif not pd.isna(at) and at >= 0:
                    now.delete(int(at))
            yield frame(out)
        if now is not None:
            yield frame(now.rows())

    parts = cut_lineage(laid.mapInPandas(summarise, f"{key} {kind}, _part int, idx long, item string, n long, gone array<long>"))
    later = parts.where(F.col("n").isNotNull()).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_part", "n", "gone"))).alias("_later"))  # one small row per partition
    items = parts.where(F.col("idx").isNotNull()).select(key, "_part", "idx", "item").join(later, key)
    # place of the item, or null once it is removed
    place = F.aggregate(F.filter("_later", lambda s: s["_part"] > F.col("_part")), F.col("idx"), lambda at, s: F.when(
        at.isNotNull() & ~F.array_contains(s["gone"], at),
        s["n"] + at - F.size(F.filter(s["gone"], lambda g: g < at)).cast("long")))
    return items.select(key, place.cast("int").alias("place"), "item").where(F.col("place").isNotNull())
