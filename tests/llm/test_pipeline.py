"""The pipeline against brute force, stage by stage on each stage's own input, and its edge cases."""

import random
from collections import Counter

import corpus_pipeline as cp
from edge import edge_docs, none, rows, sentence
from test_pairs_and_spans import brute_components, brute_hits, family
from test_rows import brute_targets


def run_stages(spark, docs, folder):
    seen = [docs]
    for _, stage in cp.STAGES:
        out = stage(spark, seen[-1], folder)
        path = f"{folder}/stage{len(seen)}"
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
    return seen


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(6)
    items = [(i, sentence(rng, 30)) for i in range(5)]
    texts = [t for f in [(6, 80, 1), (6, 80, 3), (9, 150, 4)] for t in family(rng, *f)]
    texts += [sentence(rng, rng.randrange(5, 70)) for _ in range(120)] + [sentence(rng, 20) + " " + items[i % 5][1] for i in range(8)] + ["123 !!", ""]
    rng.shuffle(texts)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en" if i % 9 else None, f"s{i % 5}", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    start, told, single, clean, mixed, sharded = run_stages(spark, docs, str(tmp_path))
    for df in (told, single, clean, mixed):
        assert df.schema.simpleString() == docs.schema.simpleString()
    assert ids(told) == Counter(i for i, t in enumerate(texts) if any(c.isalpha() for c in t))
    comp = brute_components([(r.doc_id, r.text) for r in told.collect()], 5, 80, 100)
    assert ids(single) == Counter(i for i, (_, c) in comp.items() if i == c)
    assert ids(clean) == Counter(r.doc_id for r in single.collect() if not brute_hits(r.text, items, 10)[2])
    have = clean.collect()
    taken, sizes, got = ids(mixed), Counter(), Counter()
    for r in have:
        sizes[r.source] += len(r.text.split())
        got[r.source] += len(r.text.split()) * taken[r.doc_id]
        assert taken[r.doc_id] <= 3
    assert set(taken) <= {r.doc_id for r in have}
    for s, target in brute_targets(dict(sizes)).items():
        assert abs(got[s] - target) < 0.05 * target + 10
    assert ids(sharded) == taken
    home = {}
    for r in sharded.collect():
        assert 0 <= r.shard < cp.SHARDS and home.setdefault(r.text, r.shard) == r.shard


def test_stages_take_edge_rows(spark, tmp_path):
    spark.createDataFrame([(1, "w1x w2x w3x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = edge_docs(spark).drop("shard")
    for stage_input in (docs, none(spark)):
        for name, stage in cp.STAGES:
            out = stage(spark, stage_input, str(tmp_path))
            assert set(out.columns) - {"shard"} == set(stage_input.columns), name
            assert out.count() <= 3 * stage_input.count()
    single = cp.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted(
        i for i, (_, c) in brute_components({(r[0], r[1]) for r in rows() if r[0] is not None}, 5, 80, 100).items() if i == c)
    assert sum(r.doc_id is None for r in single) == 2


def test_run_gives_the_last_stage(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert "shard" in out.columns and out.count() > 50
