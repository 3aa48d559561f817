"""Language identification and toxicity: held-out accuracy, parts against plain versions, edge cases."""

import random

import numpy as np
import pyarrow as pa
from edge import edge_docs, none, rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bookloom.llm import langid, samples, toxicity
from bookloom.llm.langid import grams
from bookloom.llm.toxicity import Lookup, boost, features, isotonic

FOLDER = "/root/testdata/sf0.01"


def test_language_is_told_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    got = langid.op5_language_id(spark, FOLDER).join(docs, "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score"), F.count("*")).first()
    assert held[0] >= 0.98 and 0 <= held[1] <= held[2] <= 1 and held[3] > 100


def test_language_edge_rows(spark):
    docs = edge_docs(spark)
    model = langid.fit(docs, F.lit(True))
    assert set(model.languages) == {"en", "de", "fr"}
    out = langid.predict(docs, model)
    assert out.columns == [c for c in docs.columns if c != "lang_pred"] + ["lang_pred", "score"][0:] or set(out.columns) >= {"lang_pred", "score"}
    got = out.collect()
    assert len(got) == len(rows())
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in model.languages and 0 < r.score <= 1) if letters else (r.lang_pred, r.score) == ("und", 0.0)
    nothing = langid.fit(none(spark), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(none(spark), model).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB éß1 .İ東", max_size=80), st.integers(3, 50))
def test_grams_do_not_depend_on_the_piece(text, piece):
    was, langid.PIECE = langid.PIECE, piece
    try:
        parts = grams(text)
    finally:
        langid.PIECE = was
    if len(text.lower()) == len(text):
        assert (parts == grams(text)).all()


def test_temperature_sharpens_and_softens():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    right = np.where(rng.random(400) < 0.8, y, (y + 1) % 3)
    for scale in (0.1, 30.0):
        t = langid.temperature(np.eye(3)[right] * scale, y)
        p = langid.softmax(np.eye(3)[right] * scale / t).max(axis=1)
        assert abs(p.mean() - 0.8) < 0.05


def test_toxicity_is_told_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op6_toxicity(spark, folder).join(labels, "doc_id").where("held_out")
    r = got.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic"), F.min("score"), F.max("score")).first()
    assert r[0] / r[1] >= 0.9 and r[0] / r[2] >= 0.85 and 0 <= r[3] <= r[4] <= 1


def test_toxicity_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(1, 140)] + [(None, 1), (2, None), (4, 1), (777, 1)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.predict(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r.text or "", r.score) == r.score
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.predict(docs, toxicity.fit(docs, few, F.lit(True))).collect()} == {0.0}
    assert toxicity.predict(none(spark), model).count() == 0


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    lexicon = Lookup(np.array([5], np.uint64), np.array([1.0]))
    texts = ["You idiot!!", "", None, "ÉTÉ 1diot YOU stoooop", "plain words here", "x"]
    together = features(pa.array(texts), lexicon)
    for t, text in enumerate(texts):
        assert np.allclose(together[t], features(pa.array([text], pa.string()), lexicon)[0])
    named = dict(zip(toxicity.FEATURES, together[0]))
    assert named["insults"] == 1 and named["second_near"] == 1 and named["exclamation_rate"] == 2 / 11
    assert not together[1].any()


def test_isotonic_rises_and_keeps_the_mean_of_pools():
    rng = random.Random(4)
    s = np.array([rng.random() for _ in range(500)])
    y = np.array([float(rng.random() < v) for v in s])
    xs, ps = isotonic(s, y, np.ones(500))
    assert (np.diff(ps) >= 0).all() and 0 < ps[0] <= ps[-1] < 1
    assert abs(np.interp(s, xs, ps).mean() - y.mean()) < 0.01


def test_trees_learn_a_rule_of_two_features():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] > 0.5)).astype(float)
    trees = boost(x[:1500], y[:1500], np.ones(1500))
    assert ((trees.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.93


def test_smallest_hashes_are_those_of_a_sort(spark, monkeypatch):
    rng = random.Random(6)
    data = [(g, rng.getrandbits(64) - 2 ** 63, i) for g, n in (("a", 30_000), ("b", 40), ("c", 5), (None, 9)) for i in range(n)]
    data += [("near", 2 ** 62 + i, i) for i in range(5_000)]  # hashes that are not spread
    want = {(g, h, i) for n in ("a", "b", "c", "near") for g, h, i in sorted(d for d in data if d[0] == n)[:20]}
    df = spark.createDataFrame(data, "g string, h long, i long").repartition(6)
    for sent in (100, 0):
        monkeypatch.setattr(samples, "SENT_GROUPS", sent)
        got = samples.smallest_hashes(df, "g", "h", 20).collect()
        assert {(r.g, r.h, r.i) for r in got} == want and max(r.r for r in got) == 20
    assert samples.smallest_hashes(df.limit(0), "g", "h", 20).count() == 0
