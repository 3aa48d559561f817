"""SimHash near-duplicates: fingerprints that differ in few bits meet on shared blocks of bits and are verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from bookloom.llm.graph import components
from bookloom.llm.words import BLANK_SEPARATED, Words, hashed, sliced
from bookloom.session import cut_lineage

#: bits of a fingerprint, and seed of the shingle hash
BITS, SEED = 64, 42
#: shingles of one text that are hashed at a time
CHUNK = 1 << 16
#: fingerprints of one block value that are compared in one task; a block value with more is cut into parts of about this size
GROUP = 4096
#: members of such a block value that go to all of its parts
PIVOTS = 256
#: groups up to this size are compared all at once by shifting the sorted rows
SMALL = 8
#: rows that are sent to all tasks; more are joined by a shuffle
SENT = 1_000_000


def fingerprint(w: Words, t: int, shingle: int) -> int:
    """SimHash of text t as a signed 64-bit number: a bit is set if it is set in over half of the shingle hashes (XXH64)."""
    text = w.joined(t).lower()  # bytes.lower() changes A-Z only
    if not text:
        return 0
    size = (w.end - w.start)[w.first[t]:w.first[t + 1]]
    begin = np.cumsum(size + 1) - size - 1
    k = min(shingle, len(size))
    end = (begin + size)[k - 1:]
    begin = begin[:len(end)]
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(end), CHUNK):
        a, b = begin[i:i + CHUNK].tolist(), end[i:i + CHUNK].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(text[p:q], SEED) for p, q in zip(a, b, strict=True)), np.uint64, len(a))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(end), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(id, fp): a row per row of docs; a null or wordless text has the fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            w = hashed(b.column(1), BLANK_SEPARATED)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(w, t, shingle) for t in range(b.num_rows)], pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def masks(rows: int, distance: int) -> list[int]:
    """Bit masks, as signed numbers, of which any two fingerprints with at most `distance` differing bits agree in one at least.

    The bits are dealt into b blocks; `distance` of them at most can differ, so some b - distance agree. One block more than the
    distance would do; more blocks make more masks of more bits, and b is the least one for which a mask has as many values as there
    are rows, so that unrelated fingerprints rarely meet.
    """
    for b in range(distance + 2, distance + 9):
        edge = [BITS * i // b for i in range(b + 1)]
        block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(b)]
        out = [sum(block[i] for i in some) for some in combinations(range(b), b - distance)]
        if min(m.bit_count() for m in out) >= max(1, rows).bit_length():
            break
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def forest(fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that connect what near pairs connect, one for each member but the first of its tree. A member is compared only with those
    that no tree has yet."""
    left = fp
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            hit = near(left, queue.pop(), distance)
            if hit.any():
                queue.extend(left[hit])
                for x in left[hit]:
                    yield root, x
                left = left[~hit]


def _links(distance: int) -> Callable:
    """Over rows (g, fp) sorted by g: the links of each group. The last group of a batch waits for the next batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(g)))
            rows = np.repeat(size, size)
            a, b = [], []
            for s in range(1, SMALL):
                both = (g[s:] == g[:-s]) & (rows[s:] <= SMALL)
                i = np.flatnonzero(both & near(fp[s:], fp[:-s], distance))
                a.append(fp[i])
                b.append(fp[i + s])
            for i in np.flatnonzero(size > SMALL):
                pairs = np.array(list(forest(np.unique(fp[start[i]:start[i] + size[i]]), distance)), np.uint64).reshape(-1, 2)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
            both = [pa.array(np.concatenate(v).astype(np.uint64).view(np.int64)) for v in (a, b)]
            return pa.RecordBatch.from_arrays(both, ["a", "b"])

        g, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            g = np.concatenate((g, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(g):
                last = int(np.searchsorted(g, g[-1]))
                if last:
                    yield solved(g[:last], fp[:last])
                    g, fp = g[last:], fp[last:]
        yield solved(g, fp)

    return run


def _grouped(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) in groups g of fingerprints fp, none much larger than GROUP."""
    return rows.select("g", "fp").repartition("g").sortWithinPartitions("g").mapInArrow(_links(distance), "a long, b long") \
        .where("a <> b")


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df


def _strays(hot: DataFrame, comp: DataFrame, distance: int) -> DataFrame:
    """Links between the components that a large group still holds: all members outside its largest component against all members,
    parts of the one with parts of the other. Any missing link has such a member at one end at least."""
    rows = hot.join(comp.select(F.col("id").alias("fp"), "comp"), "fp", "left").select("g", "parts", "fp", F.coalesce("comp", "fp").alias("c"))
    rows = cut_lineage(rows)
    most = rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(
        F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all")).where("m.n < all") \
        .select("g", F.col("m.c").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / GROUP).cast("int").alias("others"))
    rows = rows.join(_sent(cut_lineage(most)), "g").withColumn("h", F.xxhash64("fp", F.lit(1)))
    part, other = F.expr("pmod(h, parts)"), F.expr("pmod(h, others)")
    member = rows.select("g", "fp", "c", part.alias("p"), F.explode(F.expr("sequence(0, others - 1)")).alias("o"), F.lit(False).alias("stray"))
    stray = rows.where("c <> main").select("g", "fp", "c", F.explode(F.expr("sequence(0, parts - 1)")).alias("p"), other.alias("o"),
                                           F.lit(True).alias("stray"))

    def compare(t: pa.Table) -> pa.Table:
        fp, c = (t.column(x).to_numpy() for x in ("fp", "c"))
        fp, is_stray = fp.view(np.uint64), t.column("stray").to_numpy()
        mine, of = fp[~is_stray], c[~is_stray]
        out: set[tuple[int, int]] = set()
        for x, k in zip(fp[is_stray], c[is_stray].tolist(), strict=True):
            out.update((k, o) for o in np.unique(of[near(mine, x, distance)]).tolist() if o != k)
        return pa.table({"a": pa.array([v[0] for v in out], pa.int64()), "b": pa.array([v[1] for v in out], pa.int64())})

    return member.unionByName(stray).groupBy("g", "p", "o").applyInArrow(compare, "a long, b long")


def linked(prints: DataFrame, distance: int) -> DataFrame:
    """(id, comp): for each fingerprint of `prints` (fp, distinct) that is linked with another, the component it is in.

    A block value with up to GROUP fingerprints is compared in one task. A larger one is cut by hash into parts of about that size that
    share PIVOTS members, so that a dense family comes together at once; what is still apart in it is then compared part by part.
    """
    block = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(prints.count(), distance))])
    keyed = cut_lineage(prints.select("fp", F.explode(block).alias("g")))
    large = cut_lineage(keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
                        .select("g", F.ceil(F.col("n") / GROUP).cast("int").alias("parts")))
    if large.isEmpty():
        return components(cut_lineage(_grouped(keyed, distance)))
    cold = keyed.join(_sent(large), "g", "left_anti")
    hot = cut_lineage(keyed.join(_sent(large), "g"))
    pivot = hot.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("fp")))).where(F.col("_r") <= PIVOTS)
    part = hot.select("g", "fp", F.expr("pmod(xxhash64(fp, 1), parts)").cast("int").alias("p")) \
        .union(pivot.select("g", "fp", F.explode(F.expr("sequence(0, parts - 1)")).alias("p")))
    parts = part.select(F.xxhash64("g", "p").alias("g"), "fp")
    first = components(cut_lineage(_grouped(cold, distance).union(_grouped(parts, distance))))
    more = cut_lineage(_strays(hot, first, distance))
    if more.isEmpty():
        return first
    top = components(more)
    known = first.union(top.select("id", F.col("id").alias("comp"))).distinct()
    return cut_lineage(known.join(top.select(F.col("id").alias("comp"), F.col("comp").alias("_t")), "comp", "left")
                       .select("id", F.coalesce("_t", "comp").alias("comp")))


def simhash_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 4) -> DataFrame:
    """(id, fp, component_id, kept), a row per row of docs.

    fp is the SimHash of the text's word shingles (A-Z as a-z, words between blanks, repeats counted, joined by one blank; a text of fewer
    words is one shingle). Fingerprints with at most `distance` differing bits are linked; component_id is the smallest id that links
    lead to, and kept says that it is the row's own. Equal fingerprints are one node from the start, so copies cost nothing later. Every
    pair of near fingerprints agrees in one set of blocks, so none is missed; fingerprints that share block values are compared exactly, and
    a group is connected by as many links as it has members, not by its pairs.

    A null, empty or wordless text has the fingerprint zero, which is linked like any other. Rows that share an id are separate texts. A
    row without id links as others do, but names no component; component_id is null where a component has no id at all. Bytes
    that are no valid UTF-8 are hashed as they are. A text of any length is hashed in pieces. Empty tables give empty results; other
    columns are not returned.
    """
    sig = cut_lineage(with_fingerprint(docs, key, text, shingle))
    prints = cut_lineage(sig.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    comp = linked(prints.select("fp"), distance)
    whole = prints.join(comp.withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = whole.groupBy("comp").agg(F.min("least").alias("component_id"))
    # only these need to be told: texts with a copy or a link
    told = whole.join(comp.select("comp").distinct().withColumn("_l", F.lit(True)), "comp", "left").where("_l or n > 1") \
        .join(least, "comp").select(F.col("fp").alias("_fp"), "component_id")
    told = _sent(cut_lineage(told))
    return sig.join(told, F.col("fp") == F.col("_fp"), "left") \
        .select("id", "fp", F.coalesce("component_id", "id").alias("component_id")) \
        .withColumn("kept", F.col("id") == F.col("component_id"))


def op11_simhash(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = simhash_duplicates(docs, shingle=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")
