"""MinHash near-duplicates by tensored banding, with every link verified on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bookloom.llm.frames import tidy
from bookloom.llm.graph import components
from bookloom.llm.ordered import Ordered
from bookloom.llm.words import BLANK_SEPARATED, Words, hashed, mix, sliced
from bookloom.session import cut_lineage

#: minhash values in one hash of a collection; a table key joins one hash of either collection
ROWS = 3
#: chance that a pair right at the threshold meets in no table
MISS = 5e-5
#: texts that are compared with as many others in one task
BLOCK = 256
#: bytes of text in such a block; a longer text is a block of its own
BLOCK_BYTES = 16 << 20
#: ids that are sent to all tasks to pick texts; more are joined by a shuffle
SENT_IDS = 1_000_000


def collection_size(similarity: float) -> int:
    """Hashes in each of the two collections: a pair is missed if it differs in all of one of them."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - similarity ** ROWS))


def shingle_sets(w: Words, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text's whole word sequence is its one shingle."""
    full = w.runs(shingle)
    short: dict[int, np.ndarray] = {}
    for t in range(len(w.first) - 1):
        a, b = int(w.first[t]), int(w.first[t + 1])
        if b - a >= shingle:
            yield np.unique(full[a:b - shingle + 1])
        elif b > a:
            if b - a not in short:
                short[b - a] = w.runs(b - a)
            yield short[b - a][a:a + 1] + np.uint64(b - a)
        else:
            yield full[:0]


def signature(s: np.ndarray, seeds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, ((s[i:i + 2048, None] ^ seeds) * factors).min(axis=0), out=low)
    return low


def _signatures(docs: DataFrame, key: str, text: str, shingle: int, m: int) -> DataFrame:
    """(id, x, n, d1, d2, keys): hash of the text, set size, a 128-bit digest of the set and the hashes of both collections."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            seeds = mix(np.arange(1, 2 * m * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            factors = mix(seeds) | np.uint64(1)
            place = mix(np.arange(101, 101 + 2 * m, dtype=np.uint64))
            for b in sliced(batches, 2):
                sizes, d1, d2, keys = [], [], [], []
                for s in shingle_sets(hashed(b.column(2), BLANK_SEPARATED, lower=True), shingle):
                    sizes.append(len(s))
                    d1.append(int(mix(s).sum()) if len(s) else 0)
                    d2.append(int(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum()) if len(s) else 0)
                    low = mix(signature(s, seeds, factors)).reshape(2 * m, ROWS)
                    keys.append(mix(mix(mix(low[:, 0]) + low[:, 1]) + low[:, 2] + place).view(np.int64) if len(s) else None)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(sizes, pa.int64()), signed(d1), signed(d2), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "x", "n", "d1", "d2", "keys"])

    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("x"), F.col(text)) \
        .mapInArrow(run, "id long, x long, n long, d1 long, d2 long, keys array<long>")


def _tables(nodes: DataFrame, m: int) -> DataFrame:
    """(key, id, deg): memberships in tables that hold another text as well.

    A table key is a pair of hashes, one of either collection, and can only be shared where both are; so single hashes are counted
    first, and pairs are formed of the shared ones only. deg, the number of texts met on single hashes, is high
    for a text in the middle of its group.
    """
    each = nodes.select("id", F.posexplode("keys").alias("i", "k"))
    shared = each.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    mine = each.join(shared, "k").groupBy("id").agg(
        F.collect_list(F.when(F.col("i") < m, F.col("k"))).alias("a"),
        F.collect_list(F.when(F.col("i") >= m, F.col("k"))).alias("b"), F.sum("c").alias("deg"))  # 2 * m hashes at most
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    return mine.select("id", "deg", F.explode(pairs).alias("key"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) for which den * |intersection| >= num * |union|, on whole sets."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            keep = np.zeros(batch.num_rows, bool)
            left = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1]))) if len(left) else left
            sets = list(shingle_sets(hashed(batch.column(2).take(pa.array(first)), BLANK_SEPARATED, lower=True), shingle))
            of = np.cumsum(np.concatenate(([True], left[1:] != left[:-1]))) - 1 if len(left) else left
            for i, other in enumerate(shingle_sets(hashed(batch.column(3), BLANK_SEPARATED, lower=True), shingle)):
                mine = sets[of[i]]
                if not len(mine) or not len(other):
                    continue
                if den * min(len(mine), len(other)) < num * max(len(mine), len(other)):
                    continue  # the sizes alone rule it out
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                both = int((mine[at] == other).sum())
                keep[i] = den * both >= num * (len(mine) + len(other) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    ta, tb = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return pairs.select("a", "b").join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _across(tables: DataFrame, comp: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of components that are linked, of tables that still hold several.

    Texts that meet in such tables, directly or over others, are laid side by side and cut into blocks of BLOCK texts or BLOCK_BYTES bytes. Blocks that
    share a table are compared in one task, all texts of a family with all others, as a product of two matrices; so pairs are never
    rows, and two components are named once by a pair of blocks.
    """
    labelled = tables.join(comp.withColumnRenamed("comp", "_c"), "id", "left").select(
        "key", "id", F.coalesce("_c", "id").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c"),
                                        F.min("id").alias("head")).where("x <> y and c > 2").select("key", "head")
    rest = cut_lineage(labelled.join(mixed, "key"))
    # a text is tied to one head, and that one to the heads of all its tables: few links, the same families
    tied = rest.groupBy("id").agg(F.min("head").alias("one"))
    heads = rest.join(tied, "id").select(F.col("head").alias("a"), F.col("one").alias("b")).distinct()
    family = components(heads.union(tied.select("id", "one")))
    members = rest.select("id", "comp").distinct().join(family.select("id", F.col("comp").alias("fam")), "id")
    members = members.join(texts.select("id", F.octet_length("t").alias("size")), "id")
    line = Ordered(members, [], [F.col("fam").asc(), F.col("id").asc()]).add_all(_n=F.lit(1), _b=F.col("size")).done()
    # both quotients only rise, so their sum is a number of its own for each stretch in which neither does
    line = cut_lineage(line.select("id", "comp", "fam", F.expr(f"(_n - 1) div {BLOCK} + _b div {BLOCK_BYTES}").alias("block")))
    held = rest.select("key", "id").join(line.select("id", "block"), "id").select("key", "block").distinct()
    left, right = held.toDF("key", "p"), held.toDF("key", "q")
    pairs = left.join(right, "key").where("p <= q").select("p", "q").distinct()  # blocks of a table are neighbours
    full = cut_lineage(line.join(texts, "id"))
    sides = pairs.select("p", "q", F.col("p").alias("block")).union(pairs.where("p < q").select("p", "q", F.col("q").alias("block")))

    def compare(t: pa.Table) -> pa.Table:
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        block, fam, of = (t.column(c).to_numpy() for c in ("block", "fam", "comp"))
        sets = list(shingle_sets(hashed(t.column("t"), BLANK_SEPARATED, lower=True), shingle))
        out: set[tuple[int, int]] = set()
        for f in np.unique(fam):
            x, y = np.flatnonzero((fam == f) & (block == p)), np.flatnonzero((fam == f) & (block == q))
            if not len(x) or not len(y):
                continue
            nx, ny = np.array([len(sets[i]) for i in x]), np.array([len(sets[i]) for i in y])
            both = _shared([sets[i] for i in x], [sets[i] for i in y])
            near = (den * both >= num * (nx[:, None] + ny[None, :] - both)) & (of[x][:, None] != of[y][None, :])
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = int(of[x[i]]), int(of[y[j]])
                out.add((min(a, b), max(a, b)))
        return pa.table({"a": pa.array([v[0] for v in out], pa.int64()), "b": pa.array([v[1] for v in out], pa.int64())})

    return sides.join(full, "block").groupBy("p", "q").applyInArrow(compare, "a long, b long")


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, a stretch of the shingles at a time."""
    hx, hy = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(hx, hy)
    out = np.zeros((len(x), len(y)), np.int64)
    rx, ry = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    cx, cy = np.searchsorted(common, hx), np.searchsorted(common, hy)
    if len(common):
        okx, oky = common[np.minimum(cx, len(common) - 1)] == hx, common[np.minimum(cy, len(common) - 1)] == hy
        rx, cx, ry, cy = rx[okx], cx[okx], ry[oky], cy[oky]
    for low in range(0, len(common), 4096):
        mx, my = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
        ix, iy = (cx >= low) & (cx < low + 4096), (cy >= low) & (cy < low + 4096)
        mx[rx[ix], cx[ix] - low] = 1
        my[ry[iy], cy[iy] - low] = 1
        out += np.rint(mx @ my.T).astype(np.int64)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
                    similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row per row of docs.

    Texts (A-Z as a-z) are sets of word shingles; two are linked if their sets' Jaccard similarity reaches the given fraction,
    and component_id is the smallest id that links lead to. Equal sets count as one node from the start, so copies cost
    nothing later. Every node gets two collections of m hashes of three minhash values each; the m * m tables are keyed by pairs of
    hashes, which takes 6 * m minhash values instead of 6 * m * m. In each table all are compared with the best connected member; in tables
    that still hold several components after that, all members are compared in blocks. So each pair of texts that meet in a table is either verified on whole sets or connected by verified links.
    A pair right at the threshold meets in no table with a chance under 5e-5.

    A null, empty or wordless text has no shingles and no links. A row without id has no component (null) and links
    nothing. Rows with the same id are one document, which is linked by the smallest of its set digests; repeated rows get equal results. Empty
    tables give empty results; other columns are not returned.
    """
    num, den = similarity
    m = collection_size(num / den)
    sig = cut_lineage(_signatures(docs, key, text, shingle, m))
    one = sig.where("id is not null and n > 0").groupBy("id").agg(F.min(F.struct("d1", "d2", "n", "x", "keys")).alias("s"))
    groups = one.select("id", "s.*").groupBy("d1", "d2").agg(F.min(F.struct("id", "x", "keys")).alias("s"))
    groups = cut_lineage(groups.select("d1", "d2", "s.id", "s.x", "s.keys"))
    tables = cut_lineage(_tables(groups, m))
    top = tables.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("deg", "id")).alias("top")).where("c > 1")
    tables = cut_lineage(tables.join(top.select("key", F.col("top.id").alias("top")), "key").select("key", "id", "deg", "top"))
    tested = cut_lineage(tables.where("id <> top").select(F.col("top").alias("a"), F.col("id").alias("b")).distinct())
    ids = tested.select(F.col("a").alias("id")).union(tested.select(F.col("b").alias("id"))).distinct()
    ids = cut_lineage(ids.join(groups.select("id", "x"), "id"))
    picked = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    # of an id with several texts, the one that its hashes are of
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("x"), F.col(text).alias("t")) \
        .join(picked, ["id", "x"], "left_semi")
    texts = cut_lineage(texts.groupBy("id").agg(F.min("t").alias("t")))
    links = cut_lineage(_verified(tested, texts, shingle, num, den))
    comp = components(links)
    found = cut_lineage(_across(tables, comp, texts, shingle, num, den))
    # only components are linked from here on; a text without links is one of its own
    joined = components(found)
    known = comp.union(joined.select("id", F.col("id").alias("comp"))).distinct()
    comp = cut_lineage(known.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("_top")), "comp", "left")
                       .select("id", F.coalesce("_top", "comp").alias("comp")))
    node = groups.select(F.col("d1").alias("_x"), F.col("d2").alias("_y"), F.col("id").alias("_r")) \
        .join(comp.select(F.col("id").alias("_r"), "comp"), "_r", "left") \
        .select("_x", "_y", F.coalesce("comp", "_r").alias("comp"))
    of = one.select("id", "s.d1", "s.d2").join(node, (F.col("d1") == F.col("_x")) & (F.col("d2") == F.col("_y"))) \
        .select(F.col("id").alias("_i"), "comp")
    return (sig.select("id", "n").join(of, F.col("id") == F.col("_i"), "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))
            .withColumn("kept", F.col("id") == F.col("component_id")))


def op10_minhash(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, similarity=(85, 100)).withColumnRenamed("id", "doc_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
