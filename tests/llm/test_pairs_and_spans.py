"""Near-duplicates, substring deduplication and decontamination against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re

import pytest
from edge import edge_docs, none, rows, sentence

from bookloom.llm import decontaminate, minhash, substring
from bookloom.llm.decontaminate import mark_contamination
from bookloom.llm.graph import components
from bookloom.llm.minhash import collection_size, near_duplicates
from bookloom.llm.substring import without_repeats

BLANK = r"[^\x20\x09-\x0D]+"


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def shingles(text, k):
    w = re.findall(BLANK, lower(text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(docs, k, num, den):
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, n, words, edits):
    """A text and copies with some words changed; copies resemble the text more than each other."""
    base = [f"v{rng.randrange(3000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(words)] = f"n{rng.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, k, num):
    rng = random.Random(k)
    texts = [t for f in [(12, 90, 2), (12, 90, 4), (20, 120, 5), (6, 40, 1), (25, 200, 6)] for t in family(rng, *f)]
    texts += [texts[0].upper(), texts[0] + " tail", *[sentence(rng, 50) for _ in range(30)]]
    rng.shuffle(texts)
    docs = list(enumerate(texts, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=k, similarity=(num, 100)).collect()}
    assert got == brute_components(docs, k, num, 100)


def test_texts_joined_by_a_shuffle_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    docs = list(enumerate([t for _ in range(4) for t in family(rng, 6, 60, 2)], 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(minhash, "SENT_IDS", 0)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=3, similarity=(85, 100)).collect()}
    assert got == brute_components(docs, 3, 85, 100)


def test_an_id_with_two_texts_keeps_the_links_of_the_one_it_is_compared_by(spark):
    rng = random.Random(12)
    for _ in range(4):  # whichever of the two texts has the smaller digest
        a, other = sentence(rng, 60, 2_000), sentence(rng, 60, 2_000)
        near = a.split()
        near[30] = "changed"
        near = " ".join(near)
        near_other = other.split()
        near_other[20] = "changed"
        rows = [(1, a), (2, near), (2, other), (2, "A short one"), (3, " ".join(near_other)), (4, "a short one")]
        got = {(r.id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3).collect()}
        linked = [i for i in (1, 3, 4) if dict(got)[i] == dict(got)[2]]
        assert len(linked) == 1  # id 2 is the text with the smallest digest, and that one finds its like
        assert len({c for i, c in got if i == 2}) == 1


def test_blocks_cut_by_bytes_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    docs = list(enumerate([t for f in [(40, 90, 4), (40, 120, 5)] for t in family(rng, *f)], 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2_000)  # three or four texts
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=3, similarity=(85, 100)).collect()}
    assert got == brute_components(docs, 3, 85, 100)


def test_near_duplicates_edge_rows(spark):
    got = sorted((r.id is None, r.id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(edge_docs(spark), shingle=3).collect())
    want = {i: v for i, v in brute_components({(r[0], r[1]) for r in rows() if r[0] is not None}, 3, 80, 100).items()}
    for missing, i, n, comp, kept in got:
        if missing:
            assert comp is None and kept is None
        else:
            assert (n, comp, kept) == (*want[i], i == want[i][1])
    assert len(got) == len(rows())
    assert near_duplicates(none(spark)).count() == 0


def test_tables_grow_with_the_square_of_the_collections():
    for s in (0.8, 0.85):
        m = collection_size(s)
        assert 2 * (1 - s ** minhash.ROWS) ** m <= minhash.MISS < 2 * (1 - s ** minhash.ROWS) ** (m - 1)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200, 260)] + [(5, i) for i in range(6, 40)] + [(7, 41), (41, 42), (3, 42), (90, 90)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 200 for i in range(200, 261)}, **{i: 3 for i in [3, *range(5, 40), 41, 42]}}


def brute_repeats(docs, window):
    words = {i: re.findall(BLANK, t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p:p + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(v for p, v in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def passages(rng, n):
    pool = [[f"p{rng.randrange(500)}" for _ in range(rng.randrange(8, 40))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(1, 6)):
            part = rng.choice(pool) if rng.random() < 0.6 else [f"u{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))]
            a = rng.randrange(0, max(1, len(part) // 3))
            w += part[a:a + rng.randrange(1, len(part) + 1)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed, sent", [(1, 10 ** 6), (2, 0)])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, seed, sent):
    monkeypatch.setattr(substring, "SENT_IDS", sent)
    rng = random.Random(seed)
    texts = passages(rng, 160)
    texts += [texts[3], texts[3], "a b " * 40, "a b " * 30, " ".join(["same"] * 50), texts[7] + " x  y\n\nz"]
    rng.shuffle(texts)
    docs = list(enumerate(texts, 10))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in without_repeats(df).collect()}
    assert got == brute_repeats(docs, 13)


def test_substring_edge_rows(spark):
    out = without_repeats(edge_docs(spark)).collect()
    want = brute_repeats({(r[0], r[1]) for r in rows() if r[0] is not None}, 13)
    assert len(out) == len(rows())
    for r in out:
        if r.id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.id]
            assert sum(s.end - s.start for s in r.spans) == r.n_removed
            assert r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert without_repeats(none(spark)).count() == 0


def test_an_id_with_two_texts_is_left_as_it_is(spark):
    a, b = sentence(random.Random(1), 30), sentence(random.Random(2), 30)
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, a)], "doc_id long, text string")
    assert sorted((r.id, r.n_removed) for r in without_repeats(df).collect()) == [(1, 0), (1, 0), (2, 30), (3, 30)]


def brute_hits(text, items, window):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = re.findall(pattern, lower(text or "")), set(), set()
    for name, item in items:
        v = re.findall(pattern, lower(item or ""))
        if name is None or not v:
            continue
        n = min(window, len(v))
        for q in {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) == q:
                    hit |= set(range(p, p + n))
                    found.add(str(name))
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("block", [250_000, 7])
def test_decontamination_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(9)
    items = [(i, " ".join(f"q{rng.randrange(9)}" for _ in range(rng.randrange(1, 25)))) for i in range(15)]
    items += [(20, items[0][1].upper()), (None, "q1 q2"), (21, None), (22, "..."), (23, "Q8-q8, q8"), (24, "é-É q1")]
    docs = [(i, " . ".join([sentence(rng, 4), rng.choice(items)[1] or "", sentence(rng, 3), rng.choice(items)[1] or ""])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "q8 q8 q8 q8"), (103, items[0][1]), (103, items[0][1]), (104, "é É q1")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = mark_contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {i: brute_hits(t, items, 10) for i, t in docs}
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, [p for s in r.spans for p in range(s.start, s.end)], r["items"]) == want[r.doc_id]


def test_decontamination_edge_rows(spark):
    items = spark.createDataFrame([(1, "w1x w2x"), (2, None)], "item_id long, text string")
    out = mark_contamination(edge_docs(spark), items)
    assert out.count() == len(rows()) and out.where("size = 'kept'").count() == len(rows())
    assert mark_contamination(none(spark), items).count() == 0
    empty = mark_contamination(edge_docs(spark), items.limit(0)).collect()
    assert len(empty) == len(rows()) and not any(r["items"] for r in empty)
