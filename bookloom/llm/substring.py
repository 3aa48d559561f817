"""Substring deduplication: documents are factored relative to the earlier ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bookloom.llm.words import Words, hashed, sliced
from bookloom.session import cut_lineage

#: words of the shortest factor that counts
WINDOW = 13
#: words of a seed
SEED = 7
#: ids that are sent to all tasks to pick texts; more are joined by a shuffle
SENT_IDS = 1_000_000

NONE = hashlib.sha256(b"").hexdigest()


def _blocks(w: Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """The reference blocks of some texts: seed hash, block hash, text, first window (from the text's start), windows.

    The seed of a window is its smallest run of `seed` words by hash, the leftmost of equal ones. A block has the neighbouring windows that
    have their seed at the same place, so equal windows of two texts lie in blocks of one seed, at the same distance from it.
    """
    n, top = len(w.hash), np.uint64(0xFFFFFFFFFFFFFFFF)
    ok = np.flatnonzero(w.rest() >= window)
    if not len(ok):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    run = np.concatenate((w.runs(seed), np.full(window, top)))
    low, off = np.full(n, top), np.zeros(n, np.int64)
    for j in range(window - seed + 1):
        less = run[j:j + n] < low
        low[less] = run[j:j + n][less]
        off[less] = j
    place = ok + off[ok]
    text = np.searchsorted(w.first, ok, "right") - 1
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    first, count = ok[new], np.diff(np.append(new, len(ok)))
    with np.errstate(over="ignore"):
        block = w.spans(first, count + window - 1) + off[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return low[first], block, text[new], first - w.first[text[new]], count


def _seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            s, c, text, first, count = _blocks(hashed(b.column(1)), window, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(pa.array(text)),
                 pa.array(first << 16 | count)], ["seed", "block", "id", "at"])  # a block has fewer windows than a window has words

    return docs.mapInArrow(run, "seed long, block long, id long, at long")


def _matched(seeds: DataFrame) -> DataFrame:
    """(id, at, whole): blocks that an earlier document has (whole), and first blocks whose seed also stands in other blocks.

    Counts and first ids are combined before the shuffle, and what they say comes back by sort-merge joins, which split a seed with very
    many rows; no task needs all rows of a seed.
    """
    shared = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("seed")
    some = cut_lineage(seeds.join(shared, "seed"))
    firsts = cut_lineage(some.groupBy("seed", "block").agg(F.min("id").alias("first")))
    several = firsts.groupBy("seed").agg((F.count(F.lit(1)) > 1).alias("more"))
    return some.join(firsts.join(several, "seed"), ["seed", "block"]) \
        .select("id", "at", (F.col("id") > F.col("first")).alias("whole"), "more").where("whole or more").select("id", "at", "whole")


def _picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs by id; a bounded number of ids is sent to the tasks."""
    return docs.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", how)


def _edge_windows(edges: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, id, at): every window of the given blocks, with 128 bits of hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            w, v = hashed(b.column(1)), hashed(b.column(1), seed=7)
            blocks = b.column(2)
            t = np.repeat(np.arange(b.num_rows), np.diff(blocks.offsets.to_numpy()))
            at = blocks.flatten().to_numpy()
            first, count = at >> 16, at & 0xFFFF
            doc, inner = np.repeat(t, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            local = np.repeat(first, count) + inner
            pos = w.first[doc] + local
            size = np.full(len(pos), window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.spans(pos, size).view(np.int64)), pa.array(v.spans(pos, size).view(np.int64)),
                 b.column(0).take(pa.array(doc)), pa.array(local << 16 | 1)], ["h1", "h2", "id", "at"])

    lists = edges.groupBy("id").agg(F.collect_list("at").alias("blocks"))  # blocks of one text
    return texts.join(lists, "id").select("id", "t", "blocks").mapInArrow(run, "h1 long, h2 long, id long, at long")


def _described(docs: DataFrame) -> DataFrame:
    """(id, n_words, sha): of the words joined by one blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            w = hashed(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(w.first)), pa.array([hashlib.sha256(w.joined(t)).hexdigest() for t in range(b.num_rows)])],
                ["id", "n_words", "sha"])

    return docs.mapInArrow(run, "id long, n_words long, sha string")


def factors(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The relative parse: (described, matches).

    described has (id, n_words, sha, copy) for each row of docs, copy marking rows whose word sequence a smaller id has whole. matches has
    (id, at), at = first window * 65536 + number of windows: all stretches of windows that also start in an earlier document,
    for all rows that are not copies; neighbouring and overlapping stretches join to the maximal factors.

    Whole copies are one factor each and drop out. The others are cut into blocks, neighbouring windows with a common seed, and the
    index of blocks by (seed, hash) names each one's first document. A block that an earlier document has extends the
    factor greedily. Where a block is the first of its kind, but its seed stands in others too, a factor may end inside: of these
    boundary blocks, and only of these, single windows are looked up, in an index of the windows of all boundary blocks. The
    first occurrences suffice: if an earlier document has a window, the first document with that document's block has it too.
    """
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    known = cut_lineage(_described(own))
    firsts = known.where(F.col("id").isNotNull() & (F.col("n_words") >= window)).groupBy("sha").agg(F.min("id").alias("first"))
    known = cut_lineage(known.join(firsts, "sha", "left").select("id", "n_words", "sha", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy")))
    unclear = known.where("id is not null").groupBy("id").agg(F.countDistinct("sha").alias("n")).where("n > 1").select("id")
    out = cut_lineage(known.where("copy or n_words < %d" % window).select("id").union(unclear).where("id is not null").distinct())
    left = _picked(own.where(F.col("id").isNotNull()), out, "left_anti")
    matched = cut_lineage(_matched(_seeds(left, window, seed)))
    edges = matched.where("not whole").select("id", "at")
    texts = _picked(left, cut_lineage(edges.select("id").distinct()), "left_semi")
    windows = cut_lineage(_edge_windows(edges, texts, window))
    first = windows.groupBy("h1", "h2").agg(F.min("id").alias("i"), F.max("id").alias("j")).where("i < j").drop("j")
    single = windows.join(first, ["h1", "h2"]).where("id > i").select("id", "at")
    return known, cut_lineage(matched.where("whole").select("id", "at").union(single))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, spans, kept, kept_sha256), a row per row of docs: words inside a stretch of `window` words that also
    starts in a document with a smaller id are removed; spans are the removed word ranges (start, end not included) and kept the rest,
    joined by blanks (null where nothing is removed, so that untouched texts are not moved).

    A null, empty or wordless text has no words. Rows without an id, and rows that share an id but not their words, are left
    as they are and are no references. Repeated rows with equal words get equal results. Stretches that are repeated within one document only stay. Empty tables give
    empty results; other columns are not returned.
    """
    known, matches = factors(docs, key, text, window)
    lists = cut_lineage(matches.groupBy("id").agg(F.collect_list("at").alias("at")))  # stretches of one text
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            w = hashed(b.column(1))
            removed, spans, kept, sha = [], [], [], []
            for t, stretches in enumerate(b.column(2)):
                n = int(w.first[t + 1] - w.first[t])
                at = stretches.values.to_numpy()
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at >> 16, 1)
                np.add.at(edge, (at >> 16) + (at & 0xFFFF) + window - 1, -1)
                gone = edge.cumsum()[:-1] > 0
                cut = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                rest = w.joined(t, ~gone)
                removed.append(int(gone.sum()))
                spans.append([{"start": s, "end": e} for s, e in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True)])
                kept.append(rest.decode("utf-8", "replace"))  # the digest is of the bytes as they are
                sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(spans, span),
                                              pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["i", "n", "s", "k", "h"])

    texts = _picked(own, lists.select("id"), "left_semi").dropDuplicates(["id"])
    cut = texts.join(lists, "id").select("id", "t", "at").mapInArrow(
        run, "i long, n long, s array<struct<start:long,end:long>>, k string, h string")
    whole = F.when(F.col("copy"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))) \
        .otherwise(F.array().cast("array<struct<start:long,end:long>>"))
    return known.join(cut, F.col("id") == F.col("i"), "left").select(
        "id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n", F.lit(0))).alias("n_removed"),
        F.coalesce("s", whole).alias("spans"), F.when(F.col("copy"), F.lit("")).otherwise(F.col("k")).alias("kept"),
        F.when(F.col("copy"), F.lit(NONE)).otherwise(F.coalesce("h", "sha")).alias("kept_sha256"))


def op9_substring(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS f FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM p JOIN f USING (g) WHERE doc_id > f),
q AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i, FROM d),
k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS kept FROM q ANTI JOIN c USING (doc_id, i) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""
