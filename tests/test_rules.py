"""Rule tables: the tables of the fixed lists give what the lists give, other rules give something else."""

import pytest
from pyspark.sql import functions as F

from bookloom import constants as K
from bookloom.functions import html as H, text as X
from bookloom.operators import rules as R, segment as G

SCHEMA = "kind string, ord int, rule_id string, pattern string, label string"


def rule_table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_ad_lines_and_their_rules(spark):
    docs = spark.createDataFrame([(1, "keep\nSEE www.x.com now\nalso keep\nvisit x"), (2, ""), (3, None), (4, "www.y.com visit"), (4, "plain")], "doc_id long, text string")
    rules = rule_table(spark, [("ad_line", 2, "call", r"visit", None), ("ad_line", 1, "site", r"www\.\w+", None), ("ad_line", 3, "none", None, None), ("other", 0, "x", "keep", None)])
    clean, audit = R.drop_ad_lines(docs, rules)
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == [(1, "keep\nalso keep"), (2, ""), (3, ""), (4, ""), (4, "plain")]
    assert sorted((r.doc_id, r.line_no, r.rule_id) for r in audit.collect()) == [(1, 2, "site"), (1, 4, "call"), (4, 1, "site")]
    clean, audit = R.drop_ad_lines(docs, rules.where("kind = 'other'"))
    assert clean.count() == docs.count() and audit.count() == 0


def test_phrases_have_their_rule(spark):
    docs = spark.createDataFrame([(1, "text 最新章節在這裡等你。more\n正在閱讀第3章 abc。")], "doc_id long, text string")
    rules = rule_table(spark, [("ad_phrase", i, f"p{i}", p, None) for i, p in enumerate(K.AD_PHRASES)])
    clean, audit = R.strip_ads(docs, rules)
    want_clean, want = G.strip_ads(docs)
    assert [tuple(r) for r in clean.collect()] == [tuple(r) for r in want_clean.collect()]
    ids = {p: f"p{i}" for i, p in enumerate(K.AD_PHRASES)}
    got = sorted((r.line_no, r.kind, r.rule_id, r.fragment) for r in audit.collect())
    assert got == sorted((r.line_no, r.kind, ids.get(r.rule), r.fragment) for r in want.collect()) and got


def test_gate_genre_and_tags_from_tables(spark):
    pages = ["x probe.js", "cf.errors.css", "f.submit()", "pop_enabled_t", "fine", "", "my own wall"]
    gate = rule_table(spark, [(f"gate_{k}", i, f"{k}{i}", m, None) for k, ms in K.GATE_RULES.items() for i, m in enumerate(ms)])
    d = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(99, None)], "id long, html string")

    def same(a, b, df=d):
        assert [tuple(r) for r in df.select("id", a).orderBy("id").collect()] == [tuple(r) for r in df.select("id", b).orderBy("id").collect()]
    args = (F.lit(200), F.col("html"), F.lit(""))
    same(H.page_gate(*args), R.page_gate(*args, gate))
    more = gate.unionByName(rule_table(spark, [("gate_body", 9, "own", "my own wall", None)]))
    assert [r.g for r in d.where("id = 6").select(R.page_gate(*args, gate).alias("g"), R.page_gate(*args, more).alias("h")).collect()] == ["ok"]
    assert d.where("id = 6").select(R.page_gate(*args, more)).first()[0] == "blocked"

    genres = rule_table(spark, [(f"genre_{k}", 100 * i + j, f"{g}{j}", w, g) for k, lists in (("author", K.GENRE_BY_AUTHOR), ("title", K.GENRE_BY_TITLE))
                                for i, (g, ws) in enumerate(lists) for j, w in enumerate(ws)])
    books = spark.createDataFrame([(1, "修仙", "priest"), (2, "异世界重生", None), (3, None, "x"), (4, "plain", ""), (5, "末日", "渡航")], "id long, t string, a string")
    same(X.genre_guess("t", "a"), R.genre_guess("t", "a", genres), books)
    assert {r[0] for r in books.select(R.genre_guess("t", "a", genres.limit(0))).collect()} == {"unknown"}

    tags = spark.createDataFrame([(1, "热血+正版、签约 校园，恋爱"), (2, None), (3, "")], "id long, tags string")
    same(X.tags_clean("tags"), R.tags_clean("tags", rule_table(spark, [("tag_noise", i, str(i), p, None) for i, p in enumerate(K.TAG_NOISE.split("|"))])), tags)


def test_a_table_that_is_too_large_is_refused(spark):
    table = rule_table(spark, [("k", i, str(i), f"p{i}", None) for i in range(5)])
    assert [r.pattern for r in R.read_rules(table, "k", most=5)] == [f"p{i}" for i in range(5)]
    with pytest.raises(ValueError):
        R.read_rules(table, "k", most=4)


def test_clean_books(spark):
    raw = "========\n《书名》\n作者：某人\n========\n第一章 起\n正文。\n\n\n\n请记住本站\n第二章 承\n" + "字" * 1200 + "\n第三章 转\n完"
    got = {r.doc_id: r for r in G.clean_books(spark.createDataFrame([(1, raw), (2, "短"), (3, None), (4, "")], "doc_id long, text string")).collect()}
    assert (got[1].title, got[1].author, got[1].headings, got[1].reason) == ("书名", "某人", 3, None)
    assert got[1].text.startswith("第一章 起\n\n正文。\n\n第二章 承\n\n字") and "本站" not in got[1].text
    assert got[2].reason == "few_headings" and got[4].reason == "few_headings" and got[3].text is None and got[3].reason is None
