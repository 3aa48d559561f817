"""Small hand-made cases, mostly CJK, for rules the fixture tables cannot show."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from bookloom import constants as K
from bookloom.functions import html as H, lines as L, pyudf as P, similarity as S, text as X
from bookloom.operators import lookups, matching as M, ordering as O, segment as G, webpages as W
from bookloom.sources import readers as R, registry, writers as Wr


def column(spark, values, expr, schema="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_norm_title(spark):
    simp = X.simplified_map(spark)
    cases = {"《赘婿》": "赘婿", "赘婿（郭麒麟、宋轶主演影视剧同名原著）": "赘婿", "败犬女主太多了 第八卷": "败犬女主太多了", "完结：魔道祖师": "魔道祖师",
             "轉生後龍傲天": "转生后龙傲天", "天下": "天", "《（番外）》": "", "Ｒｅ：Zero": "rezero", "十日终焉·囚笼": "十日终焉囚笼", "": "", "斗罗大陆·3": "斗罗大陆",
             "書名（番外（上））": "书名"}
    assert column(spark, list(cases), lambda c: X.norm_title(c, simplified=simp)) == list(cases.values())
    folded = {"十日终焉·囚笼": "十日终焉", "魔道祖师：无羁": "魔道祖师", "赘婿：我的八个姐姐风华绝代": "赘婿我的八个姐姐风华绝代"}
    assert column(spark, list(folded), lambda c: X.norm_title(c, fold_tail=True)) == list(folded.values())


def test_norm_title_is_stable_on_its_output(spark):
    titles = ["《赘婿》", "魔道祖师：无羁", "无职转生 ～到了异世界就拿出真本事～", "small ring", "A·B"]
    once = column(spark, titles, X.norm_title)
    assert column(spark, once, X.norm_title) == once


def test_search_title_and_volume_tail(spark):
    assert column(spark, ["败犬女主太多了 第八卷", "《赘婿（同名原著）》", "（全）", "A-"], X.search_title) == ["败犬女主太多了", "赘婿", "（全）", "A"]
    cases = {"弹珠汽水瓶里的千岁同学 第 4 卷": "弹珠汽水瓶里的千岁同学", "弹珠汽水 6.5": "弹珠汽水", "斗罗大陆3": "斗罗大陆3", "弹珠汽水 短篇集 Days of Endless Summer": "弹珠汽水",
             "某书 EX": "某书", "特典": "特典", "冒姓琅琊": "冒姓琅琊", "某某书 第3卷 特典": "某某书"}
    assert column(spark, list(cases), X.strip_volume_tail) == list(cases.values())


def test_authors(spark):
    assert column(spark, ["[英]萨拉·杜楠特 著", "（日）川原砾", "等", None], X.clean_author) == ["萨拉·杜楠特", "川原砾", "", ""]
    df = spark.createDataFrame([("萨拉·杜楠特", "萨拉杜楠特"), ("路过天涯", "萨拉杜楠特"), ("", "a"), ("x", ""), ("[英] A. B", "ab")], "a string, h string")
    assert [r[0] for r in df.select(X.author_matches("a", "h")).collect()] == [True, False, False, True, True]


def test_numbers(spark):
    assert column(spark, ["九", "十二", "二十", "二十三", "十", "百", "", "两"], X.cn_number) == [9, 12, 20, 23, 10, 0, 0, 2]
    got = column(spark, ["败犬女主太多了 第九卷", "败北女角太多了 第9卷", "無題", "第１２冊 书", "书 第百卷"], X.parse_volume)
    assert [tuple(r) for r in got] == [(9, "败犬女主太多了"), (9, "败北女角太多了"), (1, "無題"), (12, "书"), (1, "书")]
    assert column(spark, ["读", "12.5万", None, "v3"], X.first_number) == [0.0, 12.5, 0.0, 3.0]
    assert column(spark, ["2026-08-01 00:00:00", "1700000000", "x", None], lambda c: F.round(X.recency(c), 6)) == [round(20260801 / 21000000, 6), 0.85, 0.0, 0.0]
    df = spark.createDataFrame([("败北女角太多了！ 8.5", "败北女角太多了！", 1), ("… SSS短篇集", "…", 2), ("", "x", 3)], "r string, t string, n int")
    assert [r[0] for r in df.select(X.volume_label("r", "t", "n")).collect()] == ["第 8.5 卷", "SSS短篇集", "第 3 卷"]


def test_title_similarity_bands(spark):
    pairs = [("赘婿", "《赘婿》", 1.0), ("十日终焉", "十日终焉·囚笼", 0.97), ("赘婿", "赘婿当道", 0.93), ("当道", "赘婿当道", 0.80), ("（番外）", "赘婿", 0.0), ("天地玄黄宇宙", "天地玄黄宇洪", 0.487879)]
    df = spark.createDataFrame([(q, c) for q, c, _ in pairs], "q0 string, c0 string")
    d = M.with_keys(M.with_keys(df, "q0", "q", "qf"), "c0", "c", "cf")
    assert [round(r[0], 6) for r in d.select(S.title_similarity("q", "qf", "c", "cf")).collect()] == [s for _, _, s in pairs]


def test_download_score(spark):
    df = spark.createDataFrame([("赘婿", "赘婿 校对版"), ("斗破苍穹", "斗破苍穹之萧宇"), ("赘婿", "婿"), ("", "x")], "q string, c string")
    assert [round(r[0], 4) for r in df.select(S.download_title_score("q", "c")).collect()] == [0.95, 0.8, 0.3, 0.0]


def test_fanfic_cluster_and_lift(spark):
    rows = [(1, "无职转生", "", "无职转生", "幼稚园校霸", "", "jjwxc", 0, None, 0)] + [
        (1, "无职转生", "", f"无职转生之{n}", "某某", "c", "weread", i, None, i) for i, n in enumerate("甲乙丙", 1)] + [
        (1, "无职转生", "", "正传", "作者", "c", "bilinovel", 4, "site", 4)]
    df = spark.createDataFrame(rows, "query_id int, query string, author_hint string, title string, author string, cover string, source string, position int, matched_by string, cand_no int")
    got = {r["cand_no"]: r for r in M.rank_candidates(df, ["weread", "bilinovel", "jjwxc"]).collect()}
    assert got[0]["fanfic_suspect"] and got[0]["title_score"] == 0.90
    assert got[4]["title_score"] == 0.99 and got[4]["rank"] == 1


def test_chapters(spark):
    text = "前文\n第一章 开端\n第一章 开端\n正文甲\n\n后记\n第2卷Intermission\n这是特典\n第二章\n正文乙\n第一章 开端\n末尾\n第三章很长很长很长很长很长很长很长很长很长很长很长很长很长"
    got = G.split_chapters(spark.createDataFrame([(1, text), (2, "没有标题\n的文本")], "doc_id int, text string")).orderBy("doc_id", "chapter_no").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "第一章 开端", 2, "正文甲"), (1, 2, "后记", 6, ""),
        (1, 3, "第二章", 9, "正文乙\n第一章 开端\n末尾\n第三章很长很长很长很长很长很长很长很长很长很长很长很长很长"), (2, 1, "全文", 0, "没有标题\n的文本")]


def test_heading_rule_is_anchored_and_custom_rules_work(spark):
    docs = spark.createDataFrame([(1, "他说第一章\nChapter 3\n第一章第二节\n== A ==\nx")], "doc_id int, text string")
    assert [r["title"] for r in G.detect_headings(docs).collect()] == ["Chapter 3"]
    assert [r["title"] for r in G.split_chapters(docs, heading_regex=r"^== .* ==$").collect()] == ["== A =="]


def test_txt_book(spark):
    raw = "========\n《剑来》 作者：烽火戏诸侯 一句话简介：x\n========\n\n\n正文 第一章 起\n　　你好\n请记住本站\n\n\n\n第二章\n内容  \n番外 一\n完"
    r = G.prepare_book_text(spark.createDataFrame([(1, raw)], "doc_id int, text string")).collect()[0]
    assert (r["title"], r["author"]) == ("剑来", "烽火戏诸侯")
    assert r["text"] == "正文 第一章 起\n\n　　你好\n\n第二章\n\n内容\n\n番外 一\n\n完"
    check = G.completeness_check(spark.createDataFrame([(1, "第一章\n" * 3), (2, "第一章\n第二章\n第三章\n" + "字" * 1000), (3, "x")], "doc_id int, text string"))
    assert [r["reason"] for r in check.orderBy("doc_id").collect()] == ["short_text", None, "few_headings"]


def test_title_echo_keeps_short_notices(spark):
    long = "正文" * 20
    df = spark.createDataFrame([("第八十八章星星点灯（求月票）\n" + long, "第八十八章 星星点灯"), ("更新推迟到半夜，不建议等，抱歉。", "更新推迟到半夜"), ("短名\n" + long, "短名")], "b string, t string")
    assert [r[0] for r in df.select(L.drop_title_echo("b", "t")).collect()] == [long, "更新推迟到半夜，不建议等，抱歉。", "短名\n" + long]


def test_ad_phrases_keep_harmless_mentions(spark):
    text = "「正在閱讀」這四個字，是他最討厭的詞。\n他走了。正在閱讀第329章 夜，沉浸其中無法自拔。\n最新章節已就位！書迷速歸。"
    clean, audit = G.strip_ads(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    row = clean.collect()[0]
    assert row["text"].split("\n")[:2] == ["「正在閱讀」這四個字，是他最討厭的詞。", "他走了。"] and row["removed"] >= 2
    assert {r["line_no"] for r in audit.collect()} == {2, 3}


def test_titles_are_not_touched_by_ad_rules(spark):
    assert column(spark, ["第八十八章星星点灯（求月票）"], H.inline_text) == ["第八十八章星星点灯（求月票）"]
    assert column(spark, ["a<br>第八十八章（求月票）<br>b"], lambda c: H.strip_html(c, ad_rules=K.SERIAL_AD_LINES)) == ["a\nb"]


def test_encodings(spark):
    text = "中文小说，第一章。"
    raw = [text.encode("utf-8"), b"\xef\xbb\xbf" + text.encode("utf-8"), b"\xff\xfe" + text.encode("utf-16le"), text.encode("gbk"), "㐂𠀀".encode("gb18030"),
           "テスト".encode("shift-jis"), b"\xff\xff\x80\x00", bytes.fromhex("D0A1CBB5")]
    got = column(spark, raw, P.decode_ladder, "binary")
    assert [g["encoding"] for g in got[:5]] == ["utf-8", "utf-8-sig", "utf-16le", "gbk", "gb18030"]
    assert [g["text"] for g in got[:4]] == [text] * 4 and got[6]["lossy"]
    assert got[7]["encoding"] == "utf-8"  # GBK bytes that are valid UTF-8 are taken as UTF-8
    df = spark.createDataFrame([(text.encode("gbk"), "text/html; charset=GBK"), (text.encode("gb18030"), ""), (b"\x81", "x")], "c binary, t string")
    assert [(r["encoding"], r["lossy"]) for r in R.decode_strict(df, "c", "t").collect()] == [("gbk", False), ("gb18030", False), ("gb18030", True)]


def test_phrase_conversion(spark):
    groups = [[{"著急": "着急", "乾坤": "乾坤"}, {"裡": "里", "乾": "干 乾"}], [{"里面": "内"}]]
    assert column(spark, ["他著急在裡面，乾坤乾燥。"], lambda c: P.phrase_convert(c, groups)) == ["他着急在内，乾坤干燥。"]
    chars_first = [[{"甲": "乙"}, {"乙丙": "丁"}]]  # what a table replaced is not seen by the next table of the group
    assert column(spark, ["甲丙乙丙"], lambda c: P.phrase_convert(c, chars_first)) == ["乙丙丁"]
    assert column(spark, ["a, b"], lambda c: P.phrase_convert(c, [[{"a, b": "x", "b": "y"}]])) == ["a, y"]


def test_title_list_and_dictionary_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\ufeff赘婿\n# note\n\n  魔道祖师 \n赘婿\n", encoding="utf-8")
    got = sorted((r["line_no"], r["title"]) for r in R.read_title_list(spark, str(tmp_path / "a.txt")).collect())
    assert got == [(1, "赘婿"), (4, "魔道祖师")]
    rows = spark.createDataFrame([(2, 1, "里面", "内"), (1, 2, "裡", "里"), (1, 1, "著急", "着急")], "group int, dict int, key string, value string")
    assert R.load_phrase_tables(rows) == [[{"著急": "着急"}, {"裡": "里"}], [{"里面": "内"}]]
    with pytest.raises(ValueError):
        R.load_phrase_tables(rows, 2)


def test_epub(spark, tmp_path):
    def book(opf, container=True, **files):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            if container:
                z.writestr("META-INF/container.xml", '<rootfile full-path="O/b.opf"/>')
            z.writestr("O/b.opf", opf)
        return buf.getvalue()
    (tmp_path / "a.epub").write_bytes(book('<dc:title>甲<b>x</b></dc:title><dc:creator>乙</dc:creator><item href="i/c.jpg" id="z" properties="cover-image"/>'))
    (tmp_path / "b.EPUB").write_bytes(book('<title>丙</title><item id="k" href="../up.png"/><meta name="cover" content="k"/>', container=False))
    (tmp_path / "c.epub").write_bytes(book('<item href="x.jpg"/><item href="my-Cover.JPG"/>'))
    (tmp_path / "d.epub").write_bytes(b"broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in R.read_epub_metadata(spark, str(tmp_path)).collect()}
    assert (got["a.epub"]["title"], got["a.epub"]["author"], got["a.epub"]["cover_href"]) == ("甲x", "乙", "O/i/c.jpg")
    assert (got["b.EPUB"]["title"], got["b.EPUB"]["cover_href"]) == ("丙", "up.png")
    assert got["c.epub"]["cover_href"] == "O/my-Cover.JPG" and not got["d.epub"]["ok"]


def test_catalog_tree_layouts(spark):
    old = ('<h1>书</h1><div class="volume-list"><div class="volume clearfix"><img src="/no.svg" data-original="/c/1.jpg"><h2 class="v-line"><a href="/novel/9/vol_1.html">书 8.5</a></h2>'
           '<ul><li><a href="/novel/9/11.html">插图</a></li><li><a href="/novel/9/12.html">第&amp;一</a></li></ul></div></div>')
    new = '<title>新书小说在线阅读_作者甲作品_x</title><div class="catalog-volume"><a href="/novel/9/vol_2.html"><h3>新书 短篇集</h3></a><a href="/novel/9/21.html"><span>章</span></a></div>'
    bare = '<h1>无</h1><a href="/novel/9/vol_3.html">无 1</a><a href="/novel/9/31.html"></a><a href="/novel/9/vol_4.html">无 2</a>'
    got = W.catalog_tree(spark.createDataFrame([(1, old), (2, new), (3, bare)], "page_id int, html string"), base="https://h").orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["name"], r["url"]) for r in got] == [(1, "第 8.5 卷", "https://h/novel/9/vol_1.html"), (2, "短篇集", "https://h/novel/9/vol_2.html"),
                                                                  (3, "第 1 卷", "https://h/novel/9/vol_3.html"), (3, "第 2 卷", "https://h/novel/9/vol_4.html")]
    assert got[0]["cover"] == "https://h/c/1.jpg" and [c["title"] for c in got[0]["chapters"]] == ["插图", "第&一"]
    assert (got[1]["title"], got[1]["author"]) == ("新书", "作者甲") and got[2]["chapters"][0]["title"] == "（无标题）"


def test_toc_stays_inside_the_container(spark):
    page = ('<a href="/b/1/99.html">最新</a><div id="list"><a href="1.html">第一章（求月票）</a><a href="2.html">二<b>x</b></a><a href="1.html">again</a><a href="/other/3.html">away</a><a href="4.html"> </a></div>')
    got = W.extract_toc(spark.createDataFrame([(1, "http://h/b/1/", page)], "page_id int, url string, html string")).orderBy("pos").collect()
    assert [(r["name"], r["url"]) for r in got] == [("第一章（求月票）", "http://h/b/1/1.html"), ("二x", "http://h/b/1/2.html")]


def test_short_chapter_is_not_replaced(spark):
    page = '<h1>请假</h1><div class="nav">' + "很长的导航" * 50 + '</div><div id="content">今天请假一天，明天继续更新。</div>'
    r = W.chapter_text(spark.createDataFrame([(1, page)], "page_id int, html string")).collect()[0]
    assert (r["heading"], r["text"]) == ("请假", "今天请假一天，明天继续更新。")


def test_volume_covers(spark):
    vols = [(1, "书", 0, "书 6", "c6"), (1, "书", 1, "书 6.5", "c65"), (1, "书", 2, "书 短篇集", "cs"), (1, "书", 3, "1", "c1"), (1, "书", 4, "4 特装版", "c4")]
    want = [(1, 1, "书 第 6 卷", "书"), (1, 2, "第6.5卷", "书"), (1, 3, "书 短篇集 Days", "书"), (1, 4, "短篇集1", "书"), (1, 5, "第4卷", "书"), (1, 6, "第 9 卷", "书")]
    got = lookups.volume_cover_match(spark.createDataFrame(want, "work_id int, req_id int, volume string, title string"),
                                     spark.createDataFrame(vols, "work_id int, title string, pos int, name string, cover string")).collect()
    assert {r["req_id"]: r["cover"] for r in got} == {1: "c6", 2: "c65", 3: "cs", 4: "cs", 5: "c4"}


def test_page_gate_and_state(spark):
    df = spark.createDataFrame([(200, "x" * 5000, "ok page"), (403, "x", ""), (200, "pop_enabled_t", ""), (200, "y", "Attention Required! | x"), (200, " ", "")], "s int, h string, t string")
    assert [r[0] for r in df.select(H.page_gate(F.col("s"), "h", "t")).collect()] == ["ok", "blocked", "challenge", "blocked", "empty"]
    note = '<div id="acontent"><center class="center-note">请稍候</center></div>'
    assert column(spark, ['<div id="TextContent"><p>a</p></div>', '<div id="acontent">没有可阅读的章节</div>', note, None], H.body_state) == ["full", "locked", "empty", "empty"]


def test_page_objects(spark):
    page = 'x "page":{"t":"a}\\"{","u":undefined,"v":NaN,"w":-Infinity,"s":"undefined","d":{"e":1}} tail'
    assert column(spark, [page, '"page":{"a":1', "none"], lambda c: P.page_object(c, r'"page"\s*:\s*\{')) == [
        '{"t":"a}\\"{","u":null,"v":null,"w":null,"s":"undefined","d":{"e":1}}', None, None]


def test_second_search_uses_the_title_as_written(spark):
    cat = spark.createDataFrame([(0, "特典 EX 外传"), (1, "赘婿")], "pos int, title string")
    q = spark.createDataFrame([(1, "某某 番外 特典 EX 外传"), (2, "赘婿 第 3 卷"), (3, "没有的书")], "query_id int, query string")
    got = {r["query_id"]: r["pos"] for r in M.lookup_with_retry(q, cat, "query_id", min_score=0.72, limit=1).collect()}
    assert got == {1: 0, 2: 1}


def test_site_order_and_failover(spark):
    rows = [(1, "site", 0.5, None, 0), (1, "site", 0.9, None, 1), (1, "scored", 0.99, None, 0), (2, "site", 0.3, "site", 0), (3, "index", 1.0, None, 9), (3, "site", 1.0, None, 0), (4, "scored", 0.9, None, 0)]
    df = spark.createDataFrame(rows, "query_id int, origin string, title_score double, matched_by string, position int")
    got = {r["query_id"]: (r["origin"], r["position"]) for r in M.resolve_by_site_order(df).collect()}
    assert got == {1: ("site", 1), 2: ("site", 0), 3: ("index", 9)}


def test_tiers_of_small_groups(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3)], "g string, v int")
    got = {(r["g"], r["v"]): r["tier"] for r in O.split_tiers(df, ["g"], [F.col("v").desc()]).collect()}
    assert got == {("a", 1): "hot", ("b", 2): "hot", ("b", 1): "new", ("c", 3): "hot", ("c", 2): "new", ("c", 1): "new"}


def test_broken_sources_do_not_stop_the_pool(spark):
    reg = registry.SourceRegistry()
    reg.register(registry.Source("b", "B", 2, lambda: spark.range(2).selectExpr("id AS n")))
    reg.register(registry.Source("a", "A", 1, lambda: spark.range(1).selectExpr("id AS n", "'x' AS extra")))
    reg.register(registry.Source("gone", "G", 3, lambda: spark.read.parquet("/no/such/place")))
    reg.register(registry.Source("off", "O", 0, lambda: spark.range(9), default=False))
    assert reg.names() == ["a", "b", "gone"] and reg.names(True)[0] == "off"
    pool, notes = reg.pool(spark)
    assert pool.count() == 3 and {r["source"]: r["ok"] for r in notes.collect()} == {"a": True, "b": True, "gone": False}
    with pytest.raises(KeyError):
        reg.get("nope")


def test_snapshots_expire(spark, tmp_path):
    path = str(tmp_path / "snap")
    for at, n in ((100, 3), (200, 5)):
        Wr.snapshot_write(spark.range(n), path, F.lit(at))
    Wr.snapshot_write(spark.range(4), path, F.lit(200))  # replaces only that time
    read = lambda now, ttl, **kw: Wr.snapshot_read_fresh(spark, path, now, ttl, **kw).count()
    assert (read(210, 10), read(211, 10), read(9999, -1), read(150, 60), read(210, 10, min_rows=5)) == (4, 0, 4, 3, 0)


def test_utf8_files_never_reach_the_decoder(spark):
    text = "中文小说\ufeff，第一章。"
    raw = [text.encode(), b"\xef\xbb\xbf" * 2 + text.encode(), b"\xef\xbb\xbf\xef\xbf\xbd", b"", None, text.encode("utf-16"), "第一章".encode("gbk"), b"\xef\xbb\xbf\xff",
           b"\xed\xa0\x80", b"\xf0\x80\x80\x80"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, content binary")
    got = [tuple(r)[1:] for r in R.decode_corpus(df).orderBy("i").collect()]
    assert got == [tuple(r) if r is not None else (None,) * 3 for r in column(spark, raw, P.decode_ladder, "binary")]
    pages = spark.createDataFrame([(v, t) for v in raw for t in (None, "", "text/html; charset=UTF-8", "x; charset=ascii", "x; charset=gbk")], "c binary, t string")
    declared = F.lower(F.regexp_extract("t", "(?i)charset=(.*)", 1))
    want = pages.select("t", P.decode_declared(F.col("c"), F.when(declared != "", declared)).alias("d")).select("t", "d.*")
    assert sorted(map(str, R.decode_strict(pages, "c", "t").collect())) == sorted(map(str, want.collect()))


def test_resolve_url_is_urljoin(spark):
    from urllib.parse import urljoin
    bases = ["https://a.example/b/c.html", "http://a.example", "http://a.example:80/", "https://a.example/b/../c/d", "https://a.example/b/?q=1", "", "x", "http://h://x",
             "https://a.example//b//c"]
    hrefs = ["", "/", "x", "x/", "/x.html", "../x", "./x", "x/../y", "//h.example/x", "https://h.example/x?y=http://z", "HTTP://h/x", "?q", "#f", "x#f", "x?y:z", "a:b",
             "x;p", "/x//y", "/x/.y", "x?", "x?y#z", "书/1.html", "https://h.example", "javascript:void(0)", " x"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs] + [(None, "x"), (bases[0], None)], "b string, h string")
    for r in df.select("b", "h", X.resolve_url("b", "h").alias("u")).collect():
        assert r["u"] == (None if r["b"] is None or r["h"] is None else urljoin(r["b"], r["h"])), r


def test_volume_links_once_in_page_order(spark):
    link = lambda n, name: f'<a href="/novel/1/{n}.html">{name}</a>'
    page = '<h1>T</h1><div class="volume"><h2 class="v-line">V</h2>' + link(9, "a") + link(2, "b") + link(9, "c") + link(5, "") + link(2, "d") + "</div>"
    got = W.catalog_tree(spark.createDataFrame([(1, page)], "page_id int, html string"), base="https://h").first()["chapters"]
    assert [tuple(c) for c in got] == [("a", "https://h/novel/1/9.html"), ("b", "https://h/novel/1/2.html"), ("（无标题）", "https://h/novel/1/5.html")]


def test_tree_with_a_cycle_ends(spark):
    from bookloom.operators.reports import toc_tree_flatten
    df = spark.createDataFrame([("a", None, 1), ("b", "a", 1), ("a", "b", 1), ("c", "b", 2)], "node string, parent string, ordinal int")
    assert [(r["node"], r["depth"]) for r in toc_tree_flatten(df).orderBy("position").collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_long_texts_are_few_python_objects():
    """Of a batch of 50 MB only a few texts at a time are held as Python objects."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T
    inner = P.by_value(lambda v: v and v[1:-1], T.StringType()).func
    batch = pa.array([None, *(f"<{i}" + "x" * 50_000 + ">" for i in range(1000))])
    tracemalloc.start()
    out = inner(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000 and out.to_pylist() == [v and v[1:-1] for v in batch.to_pylist()]
    assert len(inner(batch.slice(0, 0))) == 0
