"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

All that is learned - two lexicons, the trees, the calibration - comes from a bounded sample of labelled rows (SAMPLE of each
class), in three parts that share no row: words that are learned on one part look the same on the next as on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.frames import plus
from bookloom.llm.langid import fold
from bookloom.llm.samples import smallest_hashes
from bookloom.llm.words import ALPHANUMERIC, Words, hashed, sliced
from bookloom.session import cut_lineage

#: labelled rows of each class, at most, that are learned from
SAMPLE = 6_000
#: entries of the learned lexicon, and texts of the toxic class that must have one
ENTRIES, LEAST = 4_000, 5
#: log odds of an entry, at least; occurrences of a word in one text that count, at most
ODDS, OFTEN = 1.5, 10
#: bytes of the word beginnings that count besides whole words (stems)
STEMS = (3, 4, 5, 6, 7)
TREES, DEPTH, RATE, BINS, RIDGE = 60, 3, 0.2, 32, 2.0
THRESHOLD = 0.3
#: words between a lexicon word and a second person
NEAR = 5

# Common English insults, and second-person words of some languages.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting",
           "clown", "fool", "imbecile", "ugly", "filthy", "hate", "shut", "liar", "coward")
SECOND = ("you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "du", "dich",
          "dir", "dein", "deine", "ihr", "euch", "tú", "ti", "usted", "ustedes", "vosotros", "tus")

FEATURES = ("insults", "insult_rate", "learned", "learned_rate", "learned_weight", "learned_best", "strong", "strong_rate", "learned_stretch", "repeated_stem", "second_rate", "second_near",
            "capital_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "punctuation_runs", "digit_in_word",
            "symbol_in_word", "stretched", "log_words")


def _hashes(words) -> np.ndarray:
    return np.unique(hashed(pa.array(list(words)), ALPHANUMERIC, lower=True).hash)


def keys(w: Words) -> list[np.ndarray]:
    """For each word its hash, and the first bytes of words that are longer; 0 where there are not so many."""
    size = w.end - w.start
    packed = np.zeros(len(size), np.uint64)
    out = [w.hash]
    for j in range(max(STEMS)):
        at = np.minimum(w.start + j, len(w.data) - 1)
        byte = w.data[at].astype(np.uint64)
        byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
        packed |= np.where(size > j, byte, np.uint64(0)) << np.uint64(8 * j)
        if j + 1 in STEMS:
            out.append(np.where(size > j + 1, packed | (np.uint64(j + 1) << np.uint64(56)), np.uint64(0)))
    return out


class Lookup:
    """Values by 64-bit key; absent keys give 0."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = np.append(key[order], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(value[order], 0.0)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._low(self.key)] = True

    @staticmethod
    def _low(key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> np.uint64(20)) ^ (key >> np.uint64(40))) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key))
        at = np.flatnonzero(self.maybe[self._low(key)])
        i = np.searchsorted(self.key, key[at])
        out[at] = np.where(self.key[i] == key[at], self.value[i], 0.0)
        return out


_UPPER, _DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~(_LETTER | _DIGIT | _BLANK)


def features(column: pa.Array, lexicon: Lookup) -> np.ndarray:
    """A row of FEATURES per text, over the whole text; an empty or null text has zeros."""
    w = hashed(column, ALPHANUMERIC, lower=True)
    texts = len(w.first) - 1
    out = np.zeros((texts, len(FEATURES)))
    insults, second = Lookup(_hashes(INSULTS), np.ones(len(INSULTS))), Lookup(_hashes(SECOND), np.ones(len(SECOND)))
    n_words = np.diff(w.first)

    def per_text(v: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(v, dtype=float)))
        return total[w.first[1:]] - total[w.first[:-1]]

    if len(w.hash):
        all_keys = keys(w)
        weight = np.max([lexicon.of(k) for k in all_keys], axis=0)
        bad = insults.of(w.hash) > 0
        hit = bad | (weight > 0)
        you = second.of(w.hash) > 0
        of = w.text_of()
        near = np.zeros(len(hit), bool)
        for d in range(1, NEAR + 1):
            same = of[d:] == of[:-d]
            near[d:] |= you[:-d] & same
            near[:-d] |= you[d:] & same
        digit = np.add.reduceat(_DIGIT[w.data].astype(np.int32), w.start)  # up to the next word: no digits between words
        size = w.end - w.start
        upper = np.add.reduceat(_UPPER[w.data].astype(np.int32), w.start)
        a, b = per_text(bad), per_text(weight > 0)
        many = np.maximum(n_words, 1)
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = a, a / many, b, b / many
        out[:, 4] = per_text(weight) / many
        best = np.zeros(texts)
        np.maximum.at(best, of[weight > 0], weight[weight > 0])
        out[:, 5] = best
        strong = per_text(weight >= 3)
        out[:, 6], out[:, 7] = strong, strong / many
        out[:, 8] = per_text(weight) / np.sqrt(many)
        out[:, 9] = _most_repeated(all_keys, weight, of, texts) / many
        out[:, 10], out[:, 11] = per_text(you) / many, per_text(hit & near)
        out[:, 13] = per_text((upper == size) & (size > 2)) / many
        out[:, 17] = per_text((digit > 0) & (digit < size)) / many
        out[:, 20] = np.log1p(n_words)
    # characters of whole texts, a text at a time
    at = np.concatenate(([0], np.cumsum([0 if v is None else v for v in _sizes(column)])))
    for t in range(texts):
        part = w.data[at[t]:at[t + 1]]
        if not len(part):
            continue
        letters, mark = max(1, int(_LETTER[part].sum())), _MARK[part]
        out[t, 12] = _UPPER[part].sum() / letters
        out[t, 14] = mark.sum() / len(part)
        out[t, 15] = (part == 33).sum() / len(part)
        out[t, 16] = (mark[1:] & mark[:-1]).sum() / len(part)
        out[t, 18] = (mark[1:-1] & _LETTER[part[:-2]] & _LETTER[part[2:]]).sum() / len(part)
        same = (part[2:] == part[1:-1]) & (part[1:-1] == part[:-2]) & _LETTER[part[2:]]
        out[t, 19] = same.sum() / len(part)
    return out


def _most_repeated(all_keys: list[np.ndarray], weight: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """For each text the weight of the learned stem that sums up highest: one stem again and again."""
    out = np.zeros(texts)
    at = np.flatnonzero(weight > 0)
    for k in all_keys[1:]:
        some = at[k[at] != 0]
        if len(some):
            order = some[np.lexsort((k[some], of[some]))]
            new = np.flatnonzero(np.concatenate(([True], (k[order][1:] != k[order][:-1]) | (of[order][1:] != of[order][:-1]))))
            np.maximum.at(out, of[order][new], np.add.reduceat(weight[order], new))
    return out


def _sizes(column: pa.Array) -> list[int | None]:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf."""
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - (2 ** DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Logistic loss, second order, split on histograms of quantile bins."""
    inner = 2 ** DEPTH - 1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # few texts differ from zero in some features; quantiles alone would not see them
    edges = [np.unique(np.concatenate((e, np.quantile(x[x[:, j] > 0, j], np.linspace(0, 1, 9)[:-1]) - 1e-9)))
             if (x[:, j] > 0).any() else e for j, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    p0 = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), base)
    fs, ts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        f, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for k in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if not len(rows):
                    continue
                best = 1e-6
                gr, hr = g[rows], h[rows]
                whole = gr.sum() ** 2 / (hr.sum() + RIDGE)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.bincount(binned[rows, j], gr, len(e) + 1).cumsum()[:-1]
                    hl = np.bincount(binned[rows, j], hr, len(e) + 1).cumsum()[:-1]
                    gain = gl ** 2 / (hl + RIDGE) + (gr.sum() - gl) ** 2 / (hr.sum() - hl + RIDGE) - whole
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, f[k], t[k] = gain[i], j, e[i]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        at = node - inner
        top = np.bincount(at, g, inner + 1)
        leaf = -RATE * top / (np.bincount(at, h, inner + 1) + RIDGE)
        score += leaf[at]
        fs.append(f)
        ts.append(t)
        leaves.append(leaf)
    return Trees(np.array(fs), np.array(ts), np.array(leaves), base)


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points (score, probability) of a rising line between which values are interpolated. One
    pseudo-row of either label keeps the ends off 0 and 1."""
    at, of = np.unique(score, return_inverse=True)
    w, v = np.bincount(of, weight), np.bincount(of, weight * y)
    blocks: list[list[float]] = []  # weight, weighted sum, first and last score
    for s, wi, vi in zip(at.tolist(), w.tolist(), v.tolist(), strict=True):
        blocks.append([wi, vi, s, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    unit = float(weight.mean())
    xs, ps = [], []
    for wi, vi, a, b in blocks:
        xs += [a, b]
        ps += [(vi + 0.01 * unit) / (wi + 0.02 * unit)] * 2
    return np.array(xs), np.maximum.accumulate(np.array(ps))


@dataclass
class Model:
    lexicon: Lookup
    trees: Trees
    xs: np.ndarray
    ps: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(features(column, self.lexicon)), self.xs, self.ps), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from labelled documents where `learn` (of the key) holds. Several labels of one document count as toxic if one is;
    null labels and texts are left out. Without labels of both classes the score is 0 everywhere."""
    spark = docs.sparkSession
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")) \
        .agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("y")).withColumn("h", F.xxhash64("k"))
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    ids = smallest_hashes(known, "y", "h", SAMPLE).drop("r")  # 2 * SAMPLE rows
    chosen = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")) \
        .join(F.broadcast(ids), "k").groupBy("k", "y", "h").agg(F.min("t").alias("t")) \
        .withColumn("part", F.pmod(F.col("h"), F.lit(5)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            w = hashed(b.column(1), ALPHANUMERIC, lower=True)
            y = b.column(0).to_numpy()
            all_keys = keys(w)
            found, times, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t in range(len(y)):
                k, n = np.unique(np.concatenate([k[w.first[t]:w.first[t + 1]] for k in all_keys]), return_counts=True)
                found.append(k)
                times.append(np.minimum(n, OFTEN))
                of.append(np.full(len(k), y[t], np.int64))
            key, at = np.unique(np.concatenate(found), return_inverse=True)
            toxic, n = np.concatenate(of), np.concatenate(times)
            sums = [np.bincount(at, v, len(key)).astype(np.int64) for v in (toxic, n * toxic, n * (1 - toxic))]
            words = np.diff(w.first)
            both = [int(words[y == c].sum()) for c in (1, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(key, np.uint64(0)).view(np.int64)), *[pa.array(np.append(v, x)) for v, x in zip(sums, (0, *both), strict=True)]],
                ["w", "texts", "n", "m"])

    part = chosen.where("part < 2")
    # copies of one text are one witness
    part = part.groupBy("y", F.xxhash64("t").alias("c")).agg(F.min("t").alias("t")).select("y", "t")
    counts = cut_lineage(part.mapInArrow(words, "w long, texts long, n long, m long").groupBy("w")
                         .agg(F.sum("texts").alias("texts"), F.sum("n").alias("n"), F.sum("m").alias("m")))
    whole = counts.where("w = 0").first()  # key 0 has the numbers of words
    odds = F.log((F.col("n") + 0.5) / ((whole.n if whole else 0) + 1.0)) - F.log((F.col("m") + 0.5) / ((whole.m if whole else 0) + 1.0))
    best = counts.where((F.col("texts") >= LEAST) & (F.col("w") != 0)).withColumn("o", odds).where(F.col("o") >= ODDS) \
        .orderBy(F.desc("o"), F.desc("texts"), "w").limit(ENTRIES).collect()
    lexicon = Lookup(np.array([r.w for r in best], np.int64).view(np.uint64), np.array([r.o for r in best], float))
    sent = spark.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            x = features(b.column(2), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["part", "y", "x"])

    rows = chosen.where("part >= 2").orderBy("h", "k").select(F.col("part").cast("int"), "y", "t") \
        .mapInArrow(measured, "part int, y int, x array<double>").collect()  # 2 * SAMPLE rows of 21 numbers
    part_of, y = np.array([r.part for r in rows]), np.array([r.y for r in rows], float)
    nothing = Model(lexicon, Trees(np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)), 0.0), np.array([0.0]), np.array([0.0]))
    if len(set(y)) < 2:
        return nothing
    x = np.array([r.x for r in rows])
    seen = {c: min(total[c], SAMPLE) for c in total}
    weight = np.where(y == 1, total[1] / seen[1], total[0] / seen[0])
    weight /= weight.mean()
    grow = part_of < 4
    check = ~grow if len(set(y[~grow])) == 2 and len(set(y[grow])) == 2 else np.ones(len(y), bool)
    grow = grow if check.sum() < len(y) else check
    trees = boost(x[grow], y[grow], weight[grow])
    return Model(lexicon, trees, *isotonic(trees.raw(x[check]), y[check], weight[check]))


def predict(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1, calibrated) and predicted (1 from the threshold on) from the whole text alone.

    A null text is scored as an empty one. Equal texts get equal scores; no row is lost. Other columns are kept; a column
    with the name of an added one is replaced.
    """
    base = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            s = sent.value.score(b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             [*b.schema.names, "score", "predicted"])

    return base.mapInArrow(run, plus(base, "score double, predicted int"))


def op6_toxicity(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels, fold("doc_id", 4) != 2)
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
