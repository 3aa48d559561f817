"""Ranked lexical search over bit-sliced Bloom signatures, with exact scores for all documents that bounds cannot exclude."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bookloom.llm.words import ALPHANUMERIC, Words, hashed, mix, sliced
from bookloom.session import cut_lineage

#: bits of a signature for each of its tokens (rounded up to a power of two for the whole document), and bits that a token sets
TOKEN_BITS, PROBES = 12, 4
#: documents of one block of signatures, and bits of a whole block: wide signatures come in blocks of fewer documents
DOCS, BLOCK_BITS = 1024, 1 << 23
#: a term that occurs 2 ** j times or more also sets the bits of its j-th token, up to this j
LEVELS = 7
#: items that one pass over the index looks for, and terms of an item whose bits are laid side by side at a time
ITEMS, TERMS = 2000, 1024
#: best bounds of an item whose documents are scored first, to learn how high a score must be
SEEDS = 30
#: ids that are sent to all tasks to pick texts; more are joined by a shuffle
SENT_IDS = 1_000_000
#: constants of the score
UNIT, SCALE, FLAT, SLOPE, STEEP = 1_000_000_000, 1000, 10, 90, 8


def term_counts(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and number of occurrences, sorted by text."""
    text = w.text_of()
    order = np.lexsort((w.hash, text))
    h, t = w.hash[order], text[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))) if len(h) else np.zeros(0, np.int64)
    return t[new], h[new], np.diff(np.append(new, len(h)))


def token(term: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(term + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))


def probes(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Slices of a signature of `bits` bits (a power of two) that each token is in, one column per probe."""
    low, step = tokens & np.uint64(0xFFFFFFFF), (tokens >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


class Block:
    """Signatures of one width, a bit of each document in every slice."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, max(8, min(DOCS, BLOCK_BITS // bits) // 8 * 8)
        self.slices = np.zeros((bits, self.size // 8), np.uint8)
        self.ids: list = []
        self.n: list[int] = []
        self.most: list[int] = []

    def add(self, name, n: int, most: int, tokens: np.ndarray) -> None:
        at = len(self.ids)
        self.slices[probes(tokens, self.bits).ravel(), at >> 3] |= np.uint8(128 >> (at & 7))
        self.ids.append(name)
        self.n.append(n)
        self.most.append(most)

    def row(self) -> list:
        return [self.bits, self.ids, self.n, self.most, self.slices.tobytes()]


@dataclass
class Wanted:
    """Items as term numbers, all items' terms in a row: item q has the terms of[start[q]:start[q + 1]]."""
    terms: np.ndarray
    of: np.ndarray
    start: np.ndarray

    @classmethod
    def of_items(cls, items: list[np.ndarray]) -> Wanted:
        terms = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        return cls(terms, np.searchsorted(terms, np.concatenate(items)) if items else np.zeros(0, np.int64),
                   np.concatenate(([0], np.cumsum([len(i) for i in items]))).astype(np.int64))

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms h are wanted, and their numbers."""
        if not len(self.terms):
            return np.zeros(len(h), bool), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[i] == h
        return hit, i[hit]


def _scan(docs: DataFrame, sent, index: bool) -> DataFrame:
    """One pass over (id, text): a row for each block of signatures, if `index` says so, and one row of counts for each task."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"bits int, ids array<{kind}>, n array<long>, most array<long>, slices binary, docs long, words long, term array<int>, df array<long>"
    empty = [None] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape: list[pa.DataType] = []

        def out(*values) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.list_(shape[0]), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(),
                     pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                              ["bits", "ids", "n", "most", "slices", "docs", "words", "term", "df"])

        blocks: dict[int, Block] = {}
        wanted, many, words = sent.value, 0, 0
        df = np.zeros(len(wanted.terms), np.int64)
        for b in sliced(batches, 1):
            shape[:] = [b.schema.field(0).type]
            w = hashed(b.column(1), ALPHANUMERIC, lower=True)
            text, term, tf = term_counts(w)
            df += np.bincount(wanted.found(term)[1], minlength=len(df))
            n = np.diff(w.first)
            many, words = many + int((n > 0).sum()), words + int(n.sum())
            if not index:
                continue
            tokens, owner = [token(term, 0)], [text]
            for j in range(1, LEVELS + 1):
                again = tf >= 1 << j
                tokens.append(token(term[again], j))
                owner.append(text[again])
            owner, tokens = np.concatenate(owner), np.concatenate(tokens)
            order = np.argsort(owner, kind="stable")
            tokens, edge = tokens[order], np.searchsorted(owner[order], np.arange(b.num_rows + 1))
            edges = np.searchsorted(text, np.arange(b.num_rows + 1))
            for t, name in enumerate(b.column(0).to_pylist()):
                if n[t]:
                    mine = tokens[edge[t]:edge[t + 1]]
                    bits = max(256, 1 << (TOKEN_BITS * len(mine) - 1).bit_length())
                    block = blocks.setdefault(bits, Block(bits)) if bits not in blocks else blocks[bits]
                    block.add(name, int(n[t]), int(tf[edges[t]:edges[t + 1]].max()), mine)
                    if len(block.ids) == block.size:
                        yield out(*blocks.pop(bits).row(), 0, 0, [], [])
        while blocks:
            yield out(*blocks.popitem()[1].row(), 0, 0, [], [])
        if shape:
            seen = np.flatnonzero(df)
            yield out(*empty, many, words, seen.astype(np.int32), df[seen])

    return docs.mapInArrow(run, schema)


@dataclass
class Weighted:
    """Items with the weights of their terms, the number of documents and of their words, and the score to reach for each item."""
    wanted: Wanted
    weight: np.ndarray
    docs: int
    words: int
    floor: np.ndarray

    def damping(self, n: np.ndarray) -> np.ndarray:
        return FLAT + SLOPE * n * self.docs // self.words

    def bounds(self, bits: int, n: np.ndarray, most: np.ndarray, slices: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each item, an upper bound of the score of each document of a block.

        A term at level j occurs less than 2 ** (j + 1) times. So what it adds at most is a sum over its levels, of its weight times
        what the level can add in this document, and the bound is a sum over levels of the document's gain there times the weighted
        sum of the slices. Bits set by other terms only raise it.
        """
        m = self.damping(n).astype(np.float64)

        def worth(tf):
            return UNIT * tf / (SCALE * tf + STEEP * m)

        tops = [worth(np.minimum(most, (2 << j) - 1 if j < LEVELS else most).astype(np.float64)) for j in range(LEVELS + 1)]
        gains = [tops[0], *[b - a for a, b in zip(tops, tops[1:], strict=False)]]
        at = [probes(token(self.wanted.terms, j), bits) for j in range(LEVELS + 1)]
        for q in range(len(self.wanted.start) - 1):
            bound = np.zeros(len(n))
            mine = self.wanted.of[self.wanted.start[q]:self.wanted.start[q + 1]]
            mine = mine[self.weight[mine] > 0]
            for i in range(0, len(mine), TERMS):
                some = mine[i:i + TERMS]
                for j in range(LEVELS + 1):
                    held = slices[at[j][some, 0]]
                    for k in range(1, PROBES):
                        held = held & slices[at[j][some, k]]
                    there = held.any(axis=1)
                    if not there.any():
                        break  # what is at a higher level is also at this one
                    some = some[there]
                    # sums of weights stay exact in single precision below 2 ** 24
                    kind = np.float32 if self.weight[some].sum() < 1 << 24 else np.float64
                    total = self.weight[some].astype(kind) @ np.unpackbits(held[there], axis=1)[:, :len(n)].astype(kind)
                    bound += total * gains[j]
            yield q, bound * (1 + 1e-9) + 1

    def scores(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(text, item, score) where the score is above 0 and reaches the item's floor."""
        text, term, tf = term_counts(w)
        n = np.diff(w.first)
        hit, number = self.wanted.found(term)
        text, tf = text[hit], tf[hit]
        m = self.damping(n)[text]
        worth = self.weight[number] * (UNIT * tf // (SCALE * tf + STEEP * m))
        edge = np.searchsorted(text, np.arange(len(n) + 1))
        for t in range(len(n)):
            here = slice(edge[t], edge[t + 1])
            if here.start < here.stop:
                mine = np.zeros(len(self.wanted.terms), np.int64)
                mine[number[here]] = worth[here]
                total = np.concatenate(([0], np.cumsum(mine[self.wanted.of])))
                total = total[self.wanted.start[1:]] - total[self.wanted.start[:-1]]
                for q in np.flatnonzero((total > 0) & (total >= self.floor)).tolist():
                    yield t, q, int(total[q])


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[list, int, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(b.num_rows):
        bits = b.column("bits")[i].as_py()
        n, most = (np.array(b.column(c)[i].as_py(), np.int64) for c in ("n", "most"))
        slices = np.frombuffer(b.column("slices")[i].as_buffer(), np.uint8).reshape(bits, -1)
        yield b.column("ids")[i].as_py(), bits, n, most, slices


def _best_bounds(index: DataFrame, sent, kind: str, top: int) -> DataFrame:
    """(id): the documents with the highest bounds of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, object]]] = {}
        shape = None
        for b in batches:
            shape = b.schema.field("ids").type.value_type
            for ids, bits, n, most, slices in _blocks(b):
                for q, bound in sent.value.bounds(bits, n, most, slices):
                    i = np.argpartition(-bound, min(top, len(bound)) - 1)[:top]
                    pairs = best.get(q, []) + [(float(bound[k]), ids[k]) for k in i.tolist() if bound[k] > 1]
                    best[q] = sorted(pairs, key=lambda p: -p[0])[:top]
        rows = [(q, s, name) for q, v in best.items() for s, name in v]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]),
                                              pa.array([r[2] for r in rows], shape)], ["q", "bound", "id"])

    found = index.mapInArrow(run, f"q int, bound double, id {kind}")
    first = Window.partitionBy("q").orderBy(F.desc("bound"), "id")
    return found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top).select("id").distinct()


def _not_excluded(index: DataFrame, sent, kind: str) -> DataFrame:
    """(id): the documents whose bound reaches the floor of an item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, bits, n, most, slices in _blocks(b):
                may = np.zeros(len(n), bool)
                for q, bound in sent.value.bounds(bits, n, most, slices):
                    may |= (bound > 1) & (bound >= sent.value.floor[q])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in np.flatnonzero(may).tolist()], b.schema.field("ids").type.value_type)], ["id"])

    return index.mapInArrow(run, f"id {kind}").distinct()


def _scored(docs: DataFrame, ids: DataFrame, sent, kind: str, top: int) -> DataFrame:
    """(q, rank, id, score): the best of the documents with these ids, and of those without id, by exact scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            rows = list(sent.value.scores(hashed(b.column(1), ALPHANUMERIC, lower=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int32()), b.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                 pa.array([r[2] for r in rows], pa.int64())], ["q", "id", "score"])

    picked = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    texts = docs.join(picked.where("id is not null"), "id", "left_semi").select("id", "text").union(docs.where("id is null"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return texts.mapInArrow(run, f"q int, id {kind}, score long").withColumn("rank", F.row_number().over(order)) \
        .where(F.col("rank") <= top).select("q", "rank", "id", "score")


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, terms): the distinct terms of each item as hashes, at least one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            owner, term, _ = term_counts(hashed(b.column(1), ALPHANUMERIC, lower=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(term.view(np.int64))], ["item", "term"])

    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item is not null")
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(run, f"item {kind}, term long").groupBy("item").agg(F.collect_set("term").alias("terms"))


def ranked_search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", top: int = 10) -> DataFrame:
    """(item, rank, id, score): the `top` documents with the highest scores above 0 for each item, equal scores by ascending id.

    One pass over the texts writes a Bloom signature of each document, laid in blocks of up to DOCS documents as bit slices (a bitmap over
    documents for each bit), and counts documents, words and the document frequency of each wanted term. Signatures are as wide as their
    documents ask for. An item's terms are looked up as intersections of slices; weighted sums of these bound a document's score from
    above. The SEEDS best bounds of each item are scored exactly and give the score that the last of its `top` documents reaches at
    least; then all documents whose bound reaches it are scored exactly. The bounds never fall below the scores, so nothing is lost.

    Items are taken in blocks of ITEMS, whose terms and results are what the driver sees. Terms are told apart by 64-bit hashes.

    A null or wordless text has no terms, is in no count and is never found. A document without id counts and ranks like any other, behind
    equal scores with id. Repeated documents are each found. Items without id or terms are nowhere; rows that share an item id are one
    item with the terms of all. Fewer than `top` documents above 0 give fewer rows. Bytes that are no valid UTF-8 are parts of terms; a
    text may be of any length. Empty tables give empty results; other columns are not returned.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    items = cut_lineage(_items(benchmark, item, item_text))
    name = items.schema["item"].dataType
    blocks = max(1, -(-items.count() // ITEMS))
    part = items.withColumn("_b", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    index, out = None, None
    for k in range(blocks):
        rows = part.where(F.col("_b") == k).orderBy("item").collect()  # one block of items
        wanted = Wanted.of_items([np.sort(np.array(r.terms, np.int64).view(np.uint64)) for r in rows])
        scan = cut_lineage(_scan(docs, spark.sparkContext.broadcast(wanted), index is None))
        if index is None:
            index = scan.where("bits is not null").select("bits", "ids", "n", "most", "slices")
        count = scan.agg(F.sum("docs"), F.sum("words")).first()
        n, words = count[0] or 0, count[1] or 0
        df = np.zeros(len(wanted.terms), np.int64)
        for r in scan.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect():
            df[r.term] = r.df  # as many rows as the block of items has terms
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        ask = Weighted(wanted, weight, n, max(1, words), np.ones(len(rows), np.int64))
        sent = spark.sparkContext.broadcast(ask)
        seeds = cut_lineage(_best_bounds(index, sent, kind, max(SEEDS, top)))
        for r in _scored(docs, seeds, sent, kind, top).where(F.col("rank") == top).collect():  # a row per item at most
            ask.floor[r.q] = r.score
        sent = spark.sparkContext.broadcast(Weighted(wanted, weight, n, max(1, words), ask.floor))
        best = _scored(docs, cut_lineage(_not_excluded(index, sent, kind)), sent, kind, top)
        names = spark.createDataFrame([(q, r.item) for q, r in enumerate(rows)], f"q int, item {name.simpleString()}")
        best = best.join(F.broadcast(names), "q").select("item", "rank", "id", "score")  # one block of items
        out = best if out is None else out.union(best)
    return out


def op12_ranked_search(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = ranked_search(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf
      FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY r, doc_id, len(w), term),
q AS (SELECT DISTINCT item_id, term FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL)),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, n_docs),
p AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_words))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""
