"""Shards of nearly equal bytes: a minimax contiguous partition of groups of equal texts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.ordered import Ordered
from bookloom.session import cut_lineage

#: summary rows that the driver gets in one step of the search, whatever the size of the table; at least 4 * shards * shards, as what
#: is open about the k-th cut is k times what is open about the capacity
CELLS = 16_384


@dataclass
class Ends:
    """Where groups end, in bytes from the start: all that lie outside the gaps, and both ends of each gap."""
    known: list[int]
    gaps: list[tuple[int, int]]

    def sure(self, x: int) -> int:
        """The last known end up to x."""
        return self.known[bisect_right(self.known, x) - 1]

    def hoped(self, x: int) -> int:
        """No end up to x lies behind this."""
        i = bisect_right(self.gaps, (x, x)) - 1
        return x if i >= 0 and self.gaps[i][0] < x < self.gaps[i][1] else self.sure(x)


def _steps(capacity: int, shards: int, floor) -> list[int]:
    at = [0]
    for _ in range(shards):
        at.append(floor(at[-1] + capacity))
    return at


def _smallest(low: int, high: int, shards: int, total: int, floor) -> int:
    """The smallest capacity in low..high with which greedy filling needs at most this many shards; high is one."""
    while low < high:
        middle = (low + high) // 2
        if _steps(middle, shards, floor)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def _looked_up(groups: DataFrame, ends: Ends, regions: list[tuple[int, int]], cells: int) -> Ends:
    """Replace what is known of some regions, at the borders of which no gap is cut, by a finer look."""
    per = max(4, cells // len(regions))
    cell = F.lit(None).cast("long")
    for i, (low, high) in enumerate(regions):
        width = -(-(high - low) // per)
        cell = F.when((F.col("end") > low) & (F.col("end") <= high),
                      F.lit(i * per) + F.expr(f"(end - {low} - 1) div {width}")).otherwise(cell)
    found = (groups.select("end", cell.alias("cell")).where("cell is not null").groupBy("cell")
             .agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")).collect())  # as many rows as cells at most
    known = {0, *ends.known, *(x for r in found for x in (r.a, r.b))}  # what is known stays, so a capacity that fits goes on to fit
    gaps = [g for g in ends.gaps if not any(a <= g[0] and g[1] <= b for a, b in regions)]
    return Ends(sorted(known), sorted(gaps + [(r.a, r.b) for r in found if r.n > 2]))


def _minimax(groups: DataFrame, total: int, shards: int, largest: int, start: int = 0) -> list[int]:
    """The ends of the shards (as bytes from the start) of a contiguous partition whose largest shard is smallest."""
    shifted = groups.select((F.col("end") - start).alias("end"))
    ends = Ends([0, total], [(0, total)])
    regions = [(0, total)]
    low, high = max(largest, -(-total // shards)), total
    while True:
        ends = _looked_up(shifted, ends, regions, max(CELLS, 4 * shards * shards))
        high = _smallest(low, high, shards, total, ends.sure)
        low = _smallest(low, high, shards, total, ends.hoped)
        if low == high:
            break
        bounds = zip(_steps(low, shards, ends.sure)[1:], _steps(high, shards, ends.hoped)[1:], strict=True)
        regions = []
        for a, b in sorted((min(a, total), min(b, total)) for a, b in bounds):
            touched = [g for g in ends.gaps if g[0] < b and a < g[1]]
            if touched:
                a, b = min(a, touched[0][0]), max(b, touched[-1][1])
                if regions and a <= regions[-1][1]:
                    regions[-1] = (regions[-1][0], max(b, regions[-1][1]))
                else:
                    regions.append((a, b))
    # within this capacity, cut as near to an even split of the rest as the shards that follow allow
    latest = [total]
    for _ in range(shards - 1):
        latest.append(ends.known[bisect_left(ends.known, max(0, latest[-1] - high))])
    cuts = [0]
    for k in range(shards - 1):
        at = cuts[-1]
        first, last = max(at, latest[shards - 1 - k]), ends.sure(at + high)
        aim = at + round((total - at) / (shards - k))
        i = bisect_left(ends.known, aim)
        near = [x for x in ends.known[max(0, i - 1):i + 1] if first <= x <= last]
        cuts.append(min(near, key=lambda x: abs(x - aim)) if near else min(max(aim, first), last) if first == last
                    else first if aim < first else last)
    return cuts[1:]


def with_shard(docs: DataFrame, shards: int = 24, text: str = "text", digest: str = "_digest") -> DataFrame:
    """Add `size` (UTF-8 bytes of the text plus 8), the digest of the text and the shard 0..shards-1 of each row.

    Rows of equal text form an atomic group; groups are ordered by digest and cut into contiguous shards whose largest is
    as small as it can be. A group that is larger than an even share gets a shard of its own first, so that it does
    not leave others empty; the rest is divided among the rest of the shards. The smallest capacity is found by binary search over
    a summary of the running sizes with a fixed number of rows, which is refined where the cuts can be until the answer
    is exact. A shard is a function of the text's digest and of 2 * shards constants: no text is moved.

    Null texts are a group (8 bytes each) apart from the empty text (8 bytes each); repeated rows belong to their text's
    group and count each; an empty table gives an empty result. Other columns are kept; a column with the name of an
    added one is replaced.
    """
    narrow = docs.select((F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                         F.coalesce(F.sha2(text, 256), F.lit("")).alias("d"))
    groups = cut_lineage(narrow.groupBy("d").agg(F.sum("size").alias("size")))
    total, largest = groups.agg(F.sum("size"), F.max("size")).first()
    total = total or 0
    alone: list = []
    left, rest = shards, total
    if total and largest * shards > total:
        # at most shards - 1 groups are larger than an even share of what is left
        for d, size in groups.where(F.col("size") * shards > total).orderBy(F.desc("size"), "d").limit(shards - 1).collect():
            if left > 1 and size * left > rest:
                alone.append(d)
                left, rest = left - 1, rest - size
        while left > 1:
            more = groups.where(~F.col("d").isin(alone)).orderBy(F.desc("size"), "d").limit(left - 1).collect()
            fits = []
            for d, size in more:
                if left > 1 and size * left > rest:
                    fits.append(d)
                    left, rest = left - 1, rest - size
            alone += fits
            if not fits:
                break
    cut_digests: list[str] = []
    others = groups.where(~F.col("d").isin(alone)) if alone else groups
    if rest and left > 1:
        line = cut_lineage(Ordered(others, [], [F.col("d").asc()]).add("end", F.col("size")).done())
        largest = line.agg(F.max("size")).first()[0]
        cuts = _minimax(line, rest, left, largest)
        named = {r["end"]: r["d"] for r in line.where(F.col("end").isin(sorted(set(cuts)))).collect()}  # a row per cut
        cut_digests = [named.get(c, "") for c in cuts]
    behind = reduce(lambda a, c: a + (F.col(digest) > F.lit(c)).cast("int"), cut_digests, F.lit(len(alone)))
    shard = behind
    for i, d in enumerate(alone):
        shard = F.when(F.col(digest) == d, F.lit(i)).otherwise(shard)
    return (docs.withColumn(digest, F.coalesce(F.sha2(text, 256), F.lit("")))
            .withColumn("size", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"))
            .withColumn("shard", shard.cast("int")))


def with_slot(sharded: DataFrame, order: list[Column]) -> DataFrame:
    """Number the rows of each shard from 0 without gaps; a shard of any size is spread over many tasks."""
    return Ordered(sharded, ["shard"], order).add("_n", F.lit(1)).done().withColumn("slot", F.col("_n") - 1).drop("_n")


def op3_sharding(spark, folder: str) -> DataFrame:
    """Shards 0 to 23 of `documents`, law `bytes`."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    placed = (with_shard(docs).withColumn("text_crc32", F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long"))
              .drop("text"))
    slots = with_slot(placed, [F.col("_digest").asc(), F.col("doc_id").asc_nulls_first()])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
                        F.lit(None).cast("int").alias("grown_shard"))
