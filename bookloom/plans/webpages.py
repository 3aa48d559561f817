"""Queries over pages (A5-A9, B24, B25, H1-H5)."""

from pyspark.sql import functions as F

from bookloom import constants as K
from bookloom.functions import html as H
from bookloom.functions.pyudf import balanced_div
from bookloom.operators import webpages as W
from bookloom.plans import sqltext as S
from bookloom.plans.registry import query

STATE = "concat('<script>window.__INITIAL_STATE__={\"page\":{\"bookId\":', page_id, ',\"note\":\"a}\\\\\"b{\",\"x\":undefined,\"n\":[{\"bookId\":\"z', page_id, '\",\"title\":\"t', page_id, '\"},{\"bookId\":\"z', page_id, '\",\"title\":\"again\"}]}};</script>', html)"


def states(t, opening):
    return W.page_state(t.pages.select("page_id", F.expr(STATE).alias("html")), opening)


@query("a5_extract_page_state", """SELECT page_id, CAST(page_id AS VARCHAR) AS book_id, 'a}"b{' AS note, true AS no_x FROM pages""")
def _(t):
    d = states(t, r'"page"\s*:\s*\{')
    return d.select("page_id", F.get_json_object("state", "$.bookId").alias("book_id"), F.get_json_object("state", "$.note").alias("note"),
                    F.get_json_object("state", "$.x").isNull().alias("no_x"))


@query("a6_walk_objects", """SELECT page_id, 'z' || page_id AS book_id, 't' || page_id AS title FROM pages""")
def _(t):
    return W.walk_objects(states(t, r"__INITIAL_STATE__\s*=\s*\{")).select("page_id", "book_id", "title")


@query("a7_extract_records", """WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>.*?</li>')) AS b, generate_subscripts(regexp_extract_all(html, '(?s)<li>.*?</li>'), 1) AS pos FROM pages)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(b, 'href="/([^"]*)"', 1) AS id, trim(regexp_replace(regexp_extract(b, '<a[^>]*>([^<]*)', 1), '\\s+', ' ', 'g')) AS title FROM b WHERE regexp_extract(b, 'href="/([^"]*)"', 1) <> ''""")
def _(t):
    return W.extract_records(t.pages, r"(?s)<li>.*?</li>", {"id": r'href="/([^"]*)"', "title": r"<a[^>]*>([^<]*)"}, ["id", "title"])


@query("a8_extract_meta_tags", f"""SELECT page_id, trim({S.strip(S.rx(S.unescape("regexp_extract(html, '<h1>(.*?)</h1>', 1)"), chr(92) + 's+', ' '))}) AS title, 'n' || page_id AS author,
    'utf-8 & more' AS intro FROM pages""")
def _(t):
    head = F.concat(F.lit('<meta content="utf-8 &amp; more" name="description"><meta property="og:novel:author" content="n'), F.col("page_id").cast("string"), F.lit('">'), "html")
    return W.extract_meta(t.pages.select("page_id", head.alias("html")), {"title": ["og:novel:book_name", "og:title"],
                          "author": ["og:novel:author", "author"], "intro": ["og:description", "description"]})


@query("a9_last_page_number", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id + 7 ELSE coalesce(list_max(list_transform(regexp_extract_all(url, '[?&]page=(\d+)', 1), lambda x: CAST(x AS BIGINT))), 1) END AS pages FROM pages""")
def _(t):
    page = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(' <a class="last" href="x">'), (F.col("page_id") + 7).cast("string"), F.lit("</a>"))).otherwise(F.col("url"))
    return t.pages.select("page_id", H.last_page_number(page).alias("pages"))


@query("b24_balanced_div", """SELECT page_id, html || '<div>x<div>y</div></div>tail' AS body, 'open ' || page_id AS unclosed FROM pages""")
def _(t):
    wrapped = F.concat(F.lit('<p>a</p><div id="list" class="q">'), "html", F.lit("<div>x<div>y</div></div>tail</div><div>after</div>"))
    loose = F.concat(F.lit('<div id="list">open '), F.col("page_id").cast("string"))
    return t.pages.select("page_id", balanced_div(wrapped, K.TOC_CONTAINER).alias("body"), balanced_div(loose, K.TOC_CONTAINER).alias("unclosed"))


LINES_OF = S.page_lines("html")


@query("b25_pick_content", f"""WITH l AS (SELECT page_id, {LINES_OF} AS ls FROM pages), x AS (SELECT page_id, array_to_string(list_filter(ls, lambda l, i: i = 1 OR l <> ls[i - 1]), chr(10)) AS text FROM l)
    SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'long enough text of the biggest block ' || page_id ELSE text END AS text FROM x""")
def _(t):
    page = F.expr("CASE page_id % 3 WHEN 0 THEN concat('<div class=\"nav\">menu</div><div id=\"content\">', html, '</div>') WHEN 1 THEN concat('<div id=\"content\">tiny</div><div class=\"a showtxt\">', html, '</div>') "
                  "ELSE concat('<div>short</div><div><p>long enough text of the biggest block ', page_id, '</p></div>') END")
    return W.pick_content(t.pages.select("page_id", page.alias("html"))).drop("html")


@query("h1_extract_toc", """WITH b AS (SELECT page_id, url, regexp_extract_all(html, '<a href="/([^"#]+)">([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a href="/([^"#]+)">([^<]*)</a>', 2) AS ns FROM pages),
    e AS (SELECT page_id, url, unnest(hs) AS h, unnest(ns) AS n, generate_subscripts(hs, 1) AS pos FROM b),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_id, h ORDER BY pos) AS r FROM e WHERE trim(n) <> '')
    SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, trim(n) AS name, regexp_extract(url, '^https?://[^/]+') || '/' || h AS url FROM f WHERE r = 1""")
def _(t):
    return W.extract_toc(t.pages, same_path=False)


def trees(t):
    """Catalog pages of conversations: a volume per turn in one of the two layouts or with bare links."""
    # the first forty turns only name what one catalog page lists
    block = F.expr("CASE conv_id % 3 WHEN 0 THEN concat('<div class=\"volume clearfix\"><a class=\"volume-cover\"><img src=\"/no.svg\" data-original=\"//c/', turn, '.jpg\"></a><h2 class=\"v-line\"><a href=\"/novel/', conv_id, '/vol_', turn, '.html\">Book', conv_id, ' ', turn, '</a></h2>') "
                   "WHEN 1 THEN concat('<div class=\"catalog-volume\"><ul class=\"volume-chapters\"><a href=\"/novel/', conv_id, '/vol_', turn, '.html\"><h3>Book', conv_id, ' ', turn, '</h3></a><img src=\"/no.svg\" data-src=\"//c/', turn, '.jpg\" alt=\"x\"/>') "
                   "ELSE concat('<a href=\"/novel/', conv_id, '/vol_', turn, '.html\">Book', conv_id, ' ', turn, '</a><img data-src=\"//c/', turn, '.jpg\">') END")
    links = F.expr("concat('<a href=\"/novel/', conv_id, '/', turn, '1.html\">one &amp; ', role, '</a><a href=\"/novel/', conv_id, '/', turn, '1.html\">twice</a><a href=\"/novel/', conv_id, '/', turn, '2.html\"></a>')")
    # one page per turn pair: a page never holds more than two volumes, whatever the size of a conversation
    d = t.conversations.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / 2).cast("string")).alias("page_id"), "conv_id", "turn", F.concat(block, links).alias("b"))
    return d.groupBy("page_id", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "b"))).alias("bs")).select(
        "page_id", F.concat(F.lit("<h1>Book"), F.col("conv_id").cast("string"), F.lit("</h1>作者：Ann <p>x</p>"), F.array_join(F.transform("bs", lambda x: x["b"]), "")).alias("html"))


@query("h2_catalog_tree", """SELECT conv_id || '-' || turn // 2 AS page_id, 'Book' || conv_id AS title, 'Ann' AS author, '第 ' || turn || ' 卷' AS name, 'https://b/novel/' || conv_id || '/vol_' || turn || '.html' AS url,
    'https://c/' || turn || '.jpg' AS cover, 'one & ' || role || '|（无标题）' AS chapters FROM conversations""")
def _(t):
    d = W.catalog_tree(trees(t), base="https://b")
    return d.select("page_id", "title", "author", "name", "url", "cover", F.array_join(F.transform("chapters", lambda c: c["title"]), "|").alias("chapters"))


P_SQL = S.strip(S.unescape(S.rx("b", "<[^>]+>")))


@query("h3_content_blocks", f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<img\\b[^>]*>|<p[^>]*>.*?</p>')) AS b, generate_subscripts(regexp_extract_all(html, '(?is)<img\\b[^>]*>|<p[^>]*>.*?</p>'), 1) AS n FROM pages),
    t AS (SELECT page_id, n, 'p' AS kind, {P_SQL} AS value FROM b), i AS (SELECT page_id, 100000 + g AS n, 'img' AS kind, CASE g WHEN 1 THEN 'https://i/' || page_id || '.jpg' WHEN 2 THEN 'https://b/x.png' ELSE 'https://i/' || page_id || '.jpg' END AS value FROM pages, (SELECT unnest([1, 2, 3]) AS g)),
    u AS (SELECT * FROM t WHERE value <> '' UNION ALL SELECT * FROM i) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INTEGER) AS pos, kind, value FROM u""")
def _(t):
    return W.content_blocks(_illustrated(t), base="https://b")


def _illustrated(t):
    tail = F.expr("concat('<img src=\"/images/sloading.svg\" data-src=\"https://i/', page_id, '.jpg\"><img src=\"/images/x.svg\"><img src=\"/x.png\"><img class=\"c\" src=\"https://i/', page_id, '.jpg\">')")
    return t.pages.select("page_id", F.concat("html", tail).alias("html"))


@query("h5_illustration_set", "SELECT page_id, 'https://i/' || page_id || '.jpg' AS url, true AS is_cover FROM pages UNION ALL SELECT page_id, 'https://b/x.png', false FROM pages")
def _(t):
    return W.illustration_set(W.content_blocks(_illustrated(t), base="https://b")).drop("pos")


CHAPTER_PAGE = "concat('<h1>Chapter number ', page_id, '</h1><div id=\"content\">Chapter number ', page_id, ' (求月票)<br>笔趣阁 ad line<br>', html, '</div>')"
TEXT_OF = S.page_lines(CHAPTER_PAGE.replace("<h1>Chapter number ', page_id, '</h1><div id=\"content\">Chapter number ', page_id, ' (求月票)<br>笔趣阁 ad line<br>", "<br>"))


@query("h4_chapter_text", f"""WITH l AS (SELECT page_id, {TEXT_OF} AS ls FROM pages) SELECT page_id, 'Chapter number ' || page_id AS heading,
    array_to_string(list_filter(ls, lambda l, i: i = 1 OR l <> ls[i - 1]), chr(10)) AS text FROM l""")
def _(t):
    return W.chapter_text(t.pages.select("page_id", F.expr(CHAPTER_PAGE).alias("html")), ad_rules=("笔趣阁",))
