"""Benchmark decontamination: a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bookloom.llm.frames import tidy
from bookloom.llm.words import ALPHANUMERIC, Words, hashed, parts, sliced

#: words of a window; an item of fewer words is one window
WINDOW = 10
#: words of a shingle, the token of the set join
SHINGLE = 3
#: item windows that one pass over the documents looks for; a larger benchmark takes more passes, in blocks
BLOCK = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(win, items): each different window as lower-cased words joined by a blank, and the ids of its items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = hashed(b.column(1), ALPHANUMERIC, lower=True)
            ids, wins = [], []
            for t, name in enumerate(b.column(0).to_pylist()):
                words = w.joined(t).lower().split(b" ") if w.first[t] < w.first[t + 1] else []
                here = {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()
                ids += [name] * len(here)
                wins += sorted(here)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary())], ["item", "win"])

    rows = benchmark.select(F.col(item).cast("string"), F.col(text)).where(F.col(item).isNotNull()) \
        .mapInArrow(run, "item string, win binary")
    return rows.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Index:
    """A block of windows: their shingles, and after rarity is known one or more prefix shingles for each.

    Containment of a window with m shingles to the degree t needs at least ceil(t * m) of them in the document's stretch, so one of
    any m - ceil(t * m) + 1 is there; the rarest ones make the fewest candidates. Here t is 1 and the prefix one shingle.
    """

    def __init__(self, wins: list[bytes], items: list[list[str]], shingle: int):
        self.wins, self.items, self.shingle = wins, items, shingle
        w = hashed(pa.array(wins, pa.binary()), ALPHANUMERIC)
        self.size = np.diff(w.first)
        self.parts: list[np.ndarray] = []
        runs = {k: w.runs(k) for k in range(1, shingle + 1)}
        for t, n in enumerate(self.size.tolist()):
            k = min(shingle, n)
            self.parts.append(runs[k][w.first[t]:w.first[t + 1] - k + 1] + np.uint64(k))
        self.vocabulary = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.uint64)
        self.lengths = sorted({min(shingle, n) for n in self.size.tolist()})
        self.select(self.vocabulary)

    def select(self, wanted: np.ndarray) -> None:
        """The shingles that a pass looks for, and a small table that turns away nearly all others."""
        self.wanted = wanted
        bits = max(10, math.ceil(math.log2(16 * len(wanted) + 1)))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(wanted >> self.shift).astype(np.int64)] = True

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which a wanted shingle starts, and which one it is."""
        at, which = [], []
        rest = w.rest()
        for k in self.lengths:
            h = w.runs(k) + np.uint64(k)
            p = np.flatnonzero(self.maybe[(h >> self.shift).astype(np.int64)] & (rest >= k))
            i = np.minimum(np.searchsorted(self.wanted, h[p]), len(self.wanted) - 1)
            hit = self.wanted[i] == h[p]
            at.append(p[hit])
            which.append(i[hit])
        return np.concatenate(at), np.concatenate(which)

    def by_rarity(self, count: np.ndarray) -> None:
        """Keep, for each window, its rarest shingle and where in the window it stands."""
        entries: dict[int, list[tuple[int, int]]] = {}
        for t, part in enumerate(self.parts):
            i = np.searchsorted(self.vocabulary, part)
            prefix = int(np.lexsort((i, count[i]))[0])
            if count[i[prefix]]:  # a window with a shingle that no document has is nowhere
                entries.setdefault(int(i[prefix]), []).append((t, prefix))
        keys = sorted(entries)
        self.postings = [entries[k] for k in keys]
        self.select(self.vocabulary[keys])
        self.parts, self.vocabulary = [], self.vocabulary[:0]  # not needed any more where this is sent

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are inside an occurrence of a window, and the windows of each text."""
        inside = np.zeros(len(w.hash) + 1, np.int64)
        windows: dict[int, set[int]] = {}
        if not len(self.wanted):
            return inside[:-1] > 0, windows
        at, which = self.found(w)
        texts = np.searchsorted(w.first, at, "right") - 1
        for p, i, t in zip(at.tolist(), which.tolist(), texts.tolist(), strict=True):
            for win, offset in self.postings[i]:
                a = p - offset
                b = a + int(self.size[win])
                if a < w.first[t] or b > w.first[t + 1]:
                    continue  # the window would reach over an end of the text
                words = [w.data[s:e].tobytes() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
                if b" ".join(words).lower() == self.wins[win]:  # bytes.lower() changes A-Z only
                    inside[a] += 1
                    inside[b] -= 1
                    windows.setdefault(t, set()).add(win)
        return inside.cumsum()[:-1] > 0, windows


def _counts(docs: DataFrame, text: str, index) -> DataFrame:
    """(i, n): how often the i-th shingle of the vocabulary occurs in all documents."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.value.vocabulary), np.int64)
        for b in sliced(batches, 0):
            total += np.bincount(index.value.found(hashed(b.column(0), ALPHANUMERIC, lower=True))[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["i", "n"])

    return docs.select(text).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Add n_words, spans (word ranges start..end, end not included, inside occurrences of item windows) and items (ids, as
    sorted strings, of the items that have them).

    A window's shingles are ordered by how often they occur in all documents; the rarest is its prefix. Documents meet
    windows on prefix shingles only; a candidate whose window would not fit between the ends of the document is dropped, and
    the rest is compared word by word. The windows are sent to the tasks in blocks of a fixed number, each with one pass for the counts and one for the
    search, so that no text is shuffled and what is sent is bounded.

    A null or wordless text has no words, spans or items; items without id or words are nowhere; equal items are each
    found; repeated documents each get their result; overlapping windows give one span. Empty tables are fine. Other columns
    are kept; a column with the name of an added one is replaced.
    """
    spark = docs.sparkSession
    base = docs.drop("n_words", "spans", "items")
    kind = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    out = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("r"), F.lit(None).cast(f"struct<{_ddl(kind)}>").alias("m"))
    wins = _windows(benchmark, item, item_text, window)
    blocks = max(1, -(-wins.count() // BLOCK))
    wins = wins.withColumn("_block", F.pmod(F.xxhash64("win"), F.lit(blocks)))
    for k in range(blocks):
        rows = wins.where(F.col("_block") == k).select("win", "items").orderBy("win").collect()  # one block
        index = Index([bytes(r.win) for r in rows], [list(r["items"]) for r in rows], shingle)
        sent = spark.sparkContext.broadcast(index)
        count = np.zeros(len(index.vocabulary), np.int64)
        for r in _counts(docs, text, sent).collect() if len(count) else ():  # as many as the block has shingles
            count[r.i] = r.n
        sent.unpersist()
        index.by_rarity(count)
        sent = spark.sparkContext.broadcast(index)

        found = F.arrow_udf(_marking(sent), kind).asNondeterministic()  # computed once, whatever filters follow
        out = out.select("r", found(F.col(f"r.`{text}`"), F.col("m")).alias("m"))
    return out.select("r.*", "m.*")


def _ddl(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(", "))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _marking(sent):
    @tidy
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        none = pa.array([], pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))]))
        for texts, before in columns:
            yield pa.concat_arrays([none, *[_marked(part, before, sent.value, at) for at, part in parts(texts)]])
    return run


def _marked(texts: pa.Array, before: pa.Array, index: Index, at: int) -> pa.Array:
    """n_words, spans and items of a few texts, with what earlier blocks of windows found in them."""
    w = hashed(texts, ALPHANUMERIC, lower=True)
    inside, windows = index.hits(w)
    spans, items = [], []
    for t in range(len(texts)):
        old = before[at + t].as_py() or {"spans": [], "items": []}
        ranges, ids = [(s["start"], s["end"]) for s in old["spans"]], old["items"]
        if t in windows:
            here = inside[w.first[t]:w.first[t + 1]].copy()
            for s, e in ranges:
                here[s:e] = True
            edge = np.flatnonzero(np.diff(np.concatenate(([0], here.astype(np.int8), [0]))))
            ranges = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
            ids = sorted({i for v in windows[t] for i in index.items[v]} | set(ids))
        spans.append([{"start": s, "end": e} for s, e in ranges])
        items.append(ids)
    return pa.StructArray.from_arrays([pa.array(np.diff(w.first), pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                                      ["n_words", "spans", "items"])


def op2_decontamination(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    marked = mark_contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p:p + {WINDOW} - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS p FROM i WHERE len(w) > 0)),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
dw AS (
  SELECT doc_id, p, s.n, array_to_string(w[p:p + s.n - 1], ' ') AS win
  FROM dp, (SELECT DISTINCT n FROM iw) s WHERE p + s.n - 1 <= len(w)),
m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids
      FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
