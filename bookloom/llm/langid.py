"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The document frequencies cover all rows that may be learned from. The weights are fitted by follow-the-regularised-leader
with elastic-net penalties on a bounded sample (SAMPLE rows), a part of which is held back to fit the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.frames import tidy
from bookloom.llm.samples import smallest_hashes

#: labelled rows that the weights are fitted on, dealt evenly over the languages
SAMPLE = 2_400
#: hashed n-grams
SPACE = 1 << 14
ORDERS = (1, 2, 3)
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 2e-3, 1e-3
#: each how-many-th row of the sample is for the temperature
HELD = 5
UNKNOWN = "und"
#: characters that are worked on at a time
PIECE = 1 << 18

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Counts of the hashed character n-grams of a whole text: lower case, one blank for all that is no letter. All zero
    for a null and for a text without letters."""
    total = np.zeros(SPACE, np.int64)
    if not text:
        return total
    letter, tail = _letter_table(), np.zeros(0, np.uint32)
    any_letter = False
    for i in range(0, len(text), PIECE):
        code = np.frombuffer(text[i:i + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        real = letter[code]
        any_letter |= bool(real.any())
        code = np.where(real, code, np.uint32(32))
        code = np.concatenate((tail if i else np.array([32], np.uint32), code))
        if i + PIECE >= len(text):
            code = np.append(code, np.uint32(32))
        code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
        old = min(len(tail), len(code)) if i else 0  # n-grams that end before this are counted
        h = code * np.uint32(0x9E3779B1)
        run = h
        for n in ORDERS:
            if n > 1:
                if len(code) < n:
                    break
                run = (run[:-1] ^ (run[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + h[n - 1:]
            new = run[max(0, old - n + 1):]
            plain = code[max(0, old - n + 1):len(code) - n + 1]
            if n == 1:
                new = new[plain != 32]
            total += np.bincount(((new ^ (new >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> np.uint32(18), minlength=SPACE)
        tail = code[-(max(ORDERS) - 1):]
    return total if any_letter else np.zeros(SPACE, np.int64)


def weighted(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of one text as (places, values) of unit length."""
    at = np.flatnonzero(count)
    x = np.log1p(count[at]) * idf[at]
    size = np.sqrt((x * x).sum())
    return at, x / size if size else x


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (SPACE + 1, classes), the last row the bias."""
    z, n = np.zeros((SPACE + 1, classes)), np.zeros((SPACE + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in rows:
            i, v = np.append(at, SPACE), np.append(x, 1.0)
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[i] = more
    return weights(z, n)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the smallest log loss, by golden-section search."""
    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-12)).mean()

    a, b, r = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        count = grams(text)
        if not self.languages or not count.any():
            return UNKNOWN, 0.0
        at, x = weighted(count, self.idf)
        p = softmax((x @ self.weights[at] + self.weights[SPACE]) / self.temperature)
        i = int(p.argmax())
        return self.languages[i], float(p[i])


def readable(text: pa.StringScalar) -> str | None:
    """The text of a value; bytes that are no valid UTF-8 count as replacement characters, which are no letters."""
    raw = text.as_buffer()
    return None if raw is None else raw.to_pybytes().decode("utf-8", "replace")


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learn from the rows where `learn` holds and text and lang are not null; without any, every text is `und`."""
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    @tidy
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SPACE, np.int64), 0
        for b in batches:
            for t in b.column(0):
                count = grams(readable(t))
                n += 1
                seen += count > 0
        at = np.append(np.flatnonzero(seen), SPACE)  # the last is the number of texts
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen, n)[at])], ["i", "n"])

    df = np.zeros(SPACE + 1)
    for r in rows.select("text").mapInArrow(frequencies, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r.i] = r.n  # SPACE + 1 rows at most
    idf = np.log((1 + df[SPACE]) / (1 + df[:SPACE])) + 1

    ranked = smallest_hashes(rows.select("lang", F.xxhash64("k", "text").alias("h")).distinct(), "lang", "h", SAMPLE)
    ids = ranked.orderBy("r", "h").limit(SAMPLE).select("h", "lang", "r")
    chosen = rows.withColumn("h", F.xxhash64("k", "text")).join(F.broadcast(ids), ["h", "lang"]).dropDuplicates(["h", "lang"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted((r["r"], r["h"], r["lang"], r["at"], r["x"]) for b in batches for r in b.to_pylist())
        names = sorted({d[2] for d in data})
        if not names:
            return
        code = {v: i for i, v in enumerate(names)}
        rows = [(np.array(at, np.int64), np.array(x), code[v]) for _, _, v, at, x in data]
        train = [r for i, r in enumerate(rows) if (i // len(names)) % HELD] or rows
        held = [r for i, r in enumerate(rows) if not (i // len(names)) % HELD]
        w = ftrl(train, len(names))
        logits = np.array([x @ w[at] + w[SPACE] for at, x, _ in held])
        t = temperature(logits, np.array([y for *_, y in held]))
        at, of = np.nonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*names, *[None] * len(at)]), pa.array([*range(len(names)), *of.tolist()], pa.int32()),
             pa.array([None] * len(names) + at.tolist(), pa.int32()), pa.array([t] * len(names) + w[at, of].tolist())],
            ["name", "c", "i", "v"])

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [weighted(grams(readable(t)), idf) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array([m[0] for m in made], pa.list_(pa.int64())),
                 pa.array([m[1] for m in made], pa.list_(pa.float64()))], ["h", "lang", "r", "at", "x"])

    sparse = chosen.select("h", "lang", "text", F.col("r").cast("int").alias("r")) \
        .mapInArrow(features, "h long, lang string, r int, at array<long>, x array<double>")
    found = sparse.repartition(1).mapInArrow(learned, "name string, c int, i int, v double").collect()  # non-zero weights
    names = {r.c: (r.name, r.v) for r in found if r.name is not None}
    weights = np.zeros((SPACE + 1, len(names)))
    for r in found:
        if r.name is None:
            weights[r.i, r.c] = r.v
    return Model([names[i][0] for i in range(len(names))], idf, weights, names[0][1] if names else 1.0)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score (calibrated probability, 0 to 1) from the whole text alone.

    A null and a text without letters get `und` with score 0, as all texts do where nothing could be learned. Equal texts
    get equal results; no row is lost. Bytes that are no valid UTF-8 are no letters; a text may be of any length. Other columns are kept; a column with the name of an added one is replaced.
    """
    base = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            made = [sent.value.predict(readable(t)) for t in column]
            yield pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                                             ["lang_pred", "score"])

    # the text alone goes to Python; a function that is not to be repeated is computed once, whatever filters follow
    found = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()(F.col(text))
    packed_row = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("r"), found.alias("p"))
    return packed_row.select("r.*", "p.*")


def fold(key: str, parts: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % parts


def op5_language_id(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, fold("doc_id", 5) != 0)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
