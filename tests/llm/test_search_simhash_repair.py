"""SimHash, ranked search and conversation repair against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from edge import edge_docs, none, rows, sentence

from bookloom.llm import repair as repair_module
from bookloom.llm import search, simhash
from bookloom.llm.queries import QUERIES
from bookloom.llm.repair import START, damaged, repair, tables
from bookloom.llm.search import ranked_search
from bookloom.llm.simhash import forest, masks, simhash_duplicates

BLANK = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")


# --- SimHash -------------------------------------------------------------------------------------------------------------


def brute_print(text, k):
    w = re.findall(BLANK, lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(prints, distance):
    """prints: one per row -> class number per row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(prints))]


def expected_simhash(docs, k, distance):
    prints = [brute_print(t, k) for _, t in docs]
    groups = brute_classes(prints, distance)
    least = defaultdict(list)
    for (i, _), g in zip(docs, groups, strict=True):
        least[g] += [i] if i is not None else []
    return Counter((i, p, min(least[g]) if least[g] else None) for (i, _), p, g in zip(docs, prints, groups, strict=True))


def near_texts(rng, n):
    base = [f"v{rng.randrange(3000)}" for _ in range(400)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(400)] = f"n{rng.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_simhash_matches_brute_force(spark, k):
    rng = random.Random(k)
    docs = [(i, t) for i, t in enumerate(near_texts(rng, 60) + near_texts(rng, 30) + [sentence(rng, rng.randrange(0, 30)) for _ in range(60)])]
    docs += [(1000 + i, docs[i][1].upper()) for i in range(10)] + [(None, docs[0][1]), (None, sentence(rng, 50)), (3, sentence(rng, 40))]
    got = simhash_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shingle=k).collect()
    want = expected_simhash(docs, k, 4)
    assert Counter((r.id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert len({c for _, _, c in want}) < len(want) - 20  # there are links to find


def test_simhash_edges(spark):
    docs = [(r[0], r[1]) for r in rows()]
    got = simhash_duplicates(edge_docs(spark)).collect()
    assert Counter((r.id, r.fp % (1 << 64), r.component_id) for r in got) == expected_simhash(docs, 5, 4)
    assert simhash_duplicates(none(spark)).collect() == []


def test_any_two_near_prints_agree_in_a_mask():
    rng = random.Random(3)
    for count in (0, 10, 10 ** 6, 10 ** 9):
        some = masks(count, 4)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any((x ^ y) & m % (1 << 64) == 0 for m in some)


def test_forest_connects_what_pairs_connect():
    rng = random.Random(8)
    prints = sorted({rng.getrandbits(16) for _ in range(300)})
    got = list(forest(np.array(prints, np.uint64), 2))
    classes = brute_classes(prints, 2)
    assert len(got) == len(prints) - len(set(classes))
    of = dict(zip(prints, classes, strict=True))
    assert all(of[int(a)] == of[int(b)] for a, b in got)


def test_large_groups_are_cut_and_still_whole(spark, monkeypatch):
    """Fingerprints around one point and some apart, with groups cut on the driver's side into many parts."""
    rng = random.Random(9)
    monkeypatch.setattr(simhash, "GROUP", 40)
    monkeypatch.setattr(simhash, "PIVOTS", 3)
    centre = rng.getrandbits(64)
    prints = set()
    while len(prints) < 700:
        x = centre
        for b in rng.sample(range(64), rng.randrange(2, 12)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    got = {r.id % (1 << 64): r.comp for r in simhash.linked(spark.createDataFrame(signed, "fp long"), 4).collect()}
    classes = brute_classes(prints, 4)
    members = defaultdict(set)
    for x, c in zip(prints, classes, strict=True):
        members[c].add(x)
    found = defaultdict(set)
    for x in prints:
        found[got.get(x, ("alone", x))].add(x)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, members.values()))
    assert 1 < len(members) < 700


# --- ranked search -------------------------------------------------------------------------------------------------------


def brute_search(docs, items, top=10):
    bags = [(i, Counter(re.findall(TERM, lower(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, words = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = defaultdict(set)
    for q, t in items:
        if q is not None:
            asked[q] |= set(re.findall(TERM, lower(t)))
    out = []
    for q, terms in asked.items():
        scored = []
        for i, b, size in bags:
            m = 100 - 90 + (90 * size * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(q, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


def test_search_matches_brute_force(spark):
    rng = random.Random(12)
    docs = [(i, sentence(rng, int(rng.paretovariate(0.7) * 10) % 4000, 900)) for i in range(300)]
    docs += [(400 + i, docs[i][1]) for i in range(20)] + [(0, docs[5][1]), (None, docs[7][1]), (None, "w1x"), (900, None), (901, "")]
    docs += [(950, " ".join(["w3x"] * 500 + ["W5X!"] * 3))]
    items = [(f"q{j}", sentence(rng, rng.randrange(1, 60), 1000)) for j in range(40)]
    items += [("q1", "w3x w5x"), (None, "w1x"), ("empty", " . "), ("null", None), ("unknown", "nowhere at all"), ("long", sentence(rng, 5000, 3000))]
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id string, text string"))
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items)


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 7)
    rng = random.Random(13)
    docs = [(i, sentence(rng, rng.randrange(1, 50), 60)) for i in range(80)]
    items = [(j, sentence(rng, 6, 70)) for j in range(25)]
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), top=3)
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items, 3)


def test_search_edges(spark):
    items = [(1, "w1x w2x w3x one"), (2, "東京 çödé"), (3, None)]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as score", "'x' as rank", "'x' as id")
    got = ranked_search(edge_docs(spark), asked)
    assert Counter(map(tuple, got.collect())) == brute_search([(r[0], r[1]) for r in rows()], items)
    assert ranked_search(none(spark), asked).collect() == []
    assert ranked_search(edge_docs(spark), asked.limit(0)).collect() == []


def test_bounds_are_never_below_scores():
    rng = random.Random(14)
    import pyarrow as pa
    texts = [sentence(rng, rng.randrange(1, 300), 40) for _ in range(50)]
    w = search.hashed(pa.array(texts), search.ALPHANUMERIC, lower=True)
    text, term, tf = search.term_counts(w)
    asked = search.Wanted.of_items([np.unique(term[rng.sample(range(len(term)), 12)]) for _ in range(9)])
    ask = search.Weighted(asked, np.array([rng.randrange(1, 9000) for _ in asked.terms]), 50, len(w.hash), np.ones(9, np.int64))
    block = search.Block(2048)
    for t in range(50):
        mine = text == t
        tokens = [search.token(term[mine & (tf >= 1 << j)], j) for j in range(search.LEVELS + 1)]
        block.add(t, int((w.first[t + 1] - w.first[t])), int(tf[mine].max()), np.concatenate(tokens))
    bound = dict(ask.bounds(2048, np.array(block.n), np.array(block.most), block.slices))
    exact = {(t, q): s for t, q, s in ask.scores(w)}
    assert len(exact) > 100
    assert all(bound[q][t] >= s for (t, q), s in exact.items())


# --- conversation repair -------------------------------------------------------------------------------------------------


def order(r):
    return (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest())


def damage(conversations):
    out = []
    for c, turn, role, text in conversations:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (c, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return out


def brute_repair(rows):
    """The result of one conversation, by shortest paths over (row, state) with the audit as a tie-break."""
    rows = sorted(rows, key=order)
    seen, faults, kinds = set(), Counter(), []
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        kind = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults[kind] += 1
        kinds.append(kind)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def put(to, state, value):
        if state not in to or value < to[state]:
            to[state] = value

    def inserted(ways):
        for _ in range(3):
            for (state, initial), after in step.items():
                if initial in name and state in ways:
                    cost, audit, lines = ways[state]
                    put(ways, after, (cost + 3, audit + "I", (*lines, name[initial] + ":")))

    inserted(best)
    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        then = {}
        for state, (cost, audit, lines) in best.items():
            put(then, state, (cost + 4, audit + "D", lines))
            if kind in ("blank", "duplicate"):
                continue
            late = 3 * (kind == "truncated")
            if (state, role[:1]) in step:
                put(then, step[state, role[:1]], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
            for initial in name:
                if (state, initial) in step:
                    put(then, step[state, initial], (cost + late + 3, audit + "R", (*lines, f"{name[initial]}:{text}")))
        inserted(then)
        best = then
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_all(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return Counter((c, *brute_repair(v)) for c, v in by.items())


def random_conversations(rng, n, most):
    roles = ["user", "assistant", "system", "tool", "", "User", None, "user", "assistant", "user", "assistant"]
    out = []
    for c in range(n):
        for t in range(rng.randrange(most)):
            text = rng.choice(["Yes.", "no", "", " \n", "why?", None, f"text {rng.randrange(9)}.", f"so {rng.randrange(9)} \t", "Größe!"])
            out.append((c, rng.choice([t, t, t, t, t + 5, None]), rng.choice(roles), text))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_matches_brute_force(spark):
    conversations = random_conversations(random.Random(21), 300, 14) + [(None, 0, "user", "hello"), (None, 1, "assistant", "hi.")]
    got = repair(damaged(spark.createDataFrame(conversations, SCHEMA).repartition(6))).collect()
    assert Counter(map(tuple, got)) == brute_all(damage(conversations))


def test_a_conversation_over_many_partitions_and_segments(spark):
    """Half of all rows are one conversation; texts repeat over its whole length, and some rows are there many times."""
    rng = random.Random(22)
    conversations = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"line {rng.randrange(30_000)}" + rng.choice([".", ""]))
                     for t in range(20_000)]
    conversations += [(c + 100, t, r, x) for c, t, r, x in random_conversations(rng, 400, 8)] + [(500, 3, "user", "again.")] * 600
    rows = damage(conversations)
    got = repair(damaged(spark.createDataFrame(conversations, SCHEMA).repartition(6))).collect()
    want = brute_all([r for r in rows if r[0] != 7])
    assert Counter(map(tuple, (r for r in got if r.conv_id != 7))) == want
    hot = next(r for r in got if r.conv_id == 7)
    assert tuple(hot)[1:] == brute_repair([r for r in rows if r[0] == 7])


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "a."), (2000, 1, "user", "b.")], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert (got[gone].cost, got[gone].audit, got[gone].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) == {gone, 2000}


def test_repair_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(damaged(empty)).collect() == []
    clash = spark.createDataFrame([(1, 1, "user", "a.")], SCHEMA).selectExpr("*", "'x' as part", "'x' as copies", "'x' as digest", "'x' as cost")
    assert repair(damaged(clash)).count() == 1


def test_block_lookups_equal_single_steps():
    t, rng = tables(), random.Random(23)
    assert len(t.vectors) < 200
    for n in (0, 1, 3, 4, 5, 17):
        symbols = np.array([rng.randrange(repair_module.SYMBOLS) for _ in range(n)], np.int64)
        at, cost = t.through(symbols)
        for v in range(len(t.vectors)):
            a, c = v, 0
            for s in symbols[::-1]:
                c += t.cost[a, s]
                a = t.step[a, s]
            assert (at[v], cost[v]) == (a, c)
        edits, _ = t.trace(symbols, 0, START)
        assert sum(e != "I" for e in edits) == n
