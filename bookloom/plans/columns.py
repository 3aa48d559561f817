"""Queries for the column functions (group B), each over a whole table."""

from pyspark.sql import functions as F

from bookloom import constants as K
from bookloom.functions import html as H, text as X
from bookloom.functions.pyudf import phrase_convert, unescape_all
from bookloom.plans import sqltext as S
from bookloom.plans.registry import query


def titles(t):
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", F.expr(S.MESSY_TITLE).alias("raw"))


RAW = f"(SELECT p_partkey, p_name, p_brand, p_type, {S.MESSY_TITLE} AS raw FROM part)"
AUTHORS = f"(SELECT s_suppkey, s_name, {S.MESSY_AUTHOR} AS raw FROM supplier)"


@query("b1_norm_title", f"""SELECT p_partkey, {S.norm_title('raw')} AS norm, {S.norm_title('raw', brackets=False)}
    AS norm_brackets, {S.norm_title('raw', fold=True)} AS folded FROM {RAW}""")
def _(t):
    return titles(t).select("p_partkey", X.norm_title("raw").alias("norm"),
                            X.norm_title("raw", strip_brackets=False).alias("norm_brackets"),
                            X.norm_title("raw", fold_tail=True).alias("folded"))


@query("b2_search_title", f"""SELECT p_partkey, coalesce(nullif(trim({S.strip(S.stripped_title('raw'))},
    '{K.SEARCH_TRIM}'), ''), {S.strip('raw')}) AS search FROM {RAW}""")
def _(t):
    return titles(t).select("p_partkey", X.search_title("raw").alias("search"))


# on these titles two rounds are enough: the decorations are at most a volume and one word deep
@query("b3_strip_volume_tail", f"""SELECT p_partkey, CASE p_partkey % 10 WHEN 4 THEN p_name WHEN 9 THEN p_name
    WHEN 2 THEN p_name ELSE raw END AS stripped FROM {RAW}""")
def _(t):
    return titles(t).select("p_partkey", X.strip_volume_tail("raw").alias("stripped"))


@query("b4_fold_short_tail", f"""SELECT p_partkey, CASE WHEN regexp_matches(trim(raw), {S.lit(K.SHORT_TAIL)})
    THEN trim(regexp_extract(trim(raw), {S.lit(K.SHORT_TAIL)}, 1)) ELSE raw END AS base FROM {RAW}""")
def _(t):
    return titles(t).select("p_partkey", X.fold_short_tail("raw").alias("base"))


AUTHOR_HALF = S.rx("translate(raw, '（）', '()')", K.AUTHOR_BRACKETS, " ")


@query("b5_clean_author", f"""SELECT s_suppkey, trim({S.rx(S.rx(S.rx(S.strip(AUTHOR_HALF), K.AUTHOR_ROLE),
    K.AUTHOR_ROLE_TAIL), chr(92) + 's+', ' ')}, '{K.AUTHOR_TRIM}') AS author,
    lower({S.rx(S.rx('raw', K.AUTHOR_ORIGIN), K.AUTHOR_PUNCT)}) AS author_key FROM {AUTHORS}""")
def _(t):
    a = t.supplier.select("s_suppkey", F.expr(S.MESSY_AUTHOR).alias("raw"))
    return a.select("s_suppkey", X.clean_author("raw").alias("author"), X.norm_author("raw").alias("author_key"))


@query("b6_author_matches", f"""SELECT s_suppkey, CASE WHEN h = '' THEN true WHEN a = '' THEN false
    ELSE contains(a, h) OR contains(h, a) END AS matches FROM (SELECT s_suppkey,
    lower({S.rx(S.rx('raw', K.AUTHOR_ORIGIN), K.AUTHOR_PUNCT)}) AS a,
    lower({S.rx("CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN '' ELSE 'Customer#0000' END", K.AUTHOR_PUNCT)}) AS h
    FROM {AUTHORS})""")
def _(t):
    hint = F.expr("CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN '' ELSE 'Customer#0000' END")
    return t.supplier.select("s_suppkey", X.author_matches(F.expr(S.MESSY_AUTHOR), hint).alias("matches"))


@query("b7_to_simplified_chars", """SELECT doc_id, translate(text, 'éèêçÉÀ', 'eeecEA') AS plain FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.to_simplified(F.col("text"), ("éèêçÉÀ", "eeecEA")).alias("plain"))


@query("b8_convert_phrases", """SELECT doc_id, replace(replace(replace(replace(text, 'tion', '1'), 'ment', '2'),
    'é', 'e'), 'è', 'e') AS converted FROM documents""")
def _(t):
    return t.documents.select("doc_id", phrase_convert(
        F.col("text"), [[{"tion": "1", "ment": "2"}, {"é": "e", "è": "e"}]]).alias("converted"))


@query("b9_key_title", f"""SELECT p_partkey, {S.key_title('raw')} AS key, {S.bare('raw')} AS bare,
    lower({S.bare('raw')}) AS alnum FROM {RAW}""")
def _(t):
    return titles(t).select("p_partkey", X.key_title("raw").alias("key"), X.bare_text("raw").alias("bare"),
                            X.alnum_key("raw").alias("alnum"))


@query("b10_first_number", f"""SELECT event_id, {S.first_number('props')} AS n FROM events""")
def _(t):
    return t.events.select("event_id", X.first_number("props").alias("n"))


@query("b11_strip_pua", """SELECT p_partkey, p_name AS title, p_partkey % 3 = 0 AS hidden FROM part""")
def _(t):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(""), "p_name", F.lit(""))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.strip_pua(raw).alias("title"), X.has_pua(raw).alias("hidden"))


@query("b12_strip_controls", """SELECT doc_id, replace(text, 'e', '') AS clean, text AS plain FROM documents""")
def _(t):
    dirty = F.replace(F.col("text"), F.lit("e"), F.lit("\x07"))
    marked = F.concat(F.lit("﻿"), F.replace(F.col("text"), F.lit(" "), F.lit(" ​")))
    return t.documents.select("doc_id", X.strip_controls(dirty).alias("clean"), X.strip_zero_width(marked).alias("plain"))


CN_TEXT = ("CASE WHEN p_size < 10 THEN substr('零一二三四五六七八九', p_size + 1, 1) ELSE concat("
           "CASE WHEN p_size < 20 THEN '' ELSE substr('零一二三四五六七八九', CAST(floor(p_size / 10) AS INT) + 1, 1) END, '十', "
           "CASE WHEN p_size % 10 = 0 THEN '' ELSE substr('零一二三四五六七八九', p_size % 10 + 1, 1) END) END")


@query("b13_cn_number", "SELECT p_partkey, CAST(p_size AS INTEGER) AS n FROM part")
def _(t):
    return t.part.select("p_partkey", X.cn_number(F.expr(CN_TEXT)).alias("n"))


@query("b14_parse_volume", """SELECT p_partkey, CAST(CASE WHEN p_size = 0 OR p_partkey % 4 = 3 THEN 1 ELSE p_size END AS INTEGER)
    AS volume, p_name AS title FROM part""")
def _(t):
    num = (f"CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' 第', {CN_TEXT}, '卷') WHEN 1 THEN concat('第 ', p_size, ' 冊 ', p_name) "
           "WHEN 2 THEN concat(p_name, '·第', translate(CAST(p_size AS STRING), '0123456789', '０１２３４５６７８９'), '卷') "
           "ELSE p_name END")
    v = X.parse_volume(F.expr(num))
    return t.part.select("p_partkey", v["volume"].alias("volume"), v["title"].alias("title"))


@query("b15_volume_label", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('第 ', p_size, ' 卷')
    WHEN 1 THEN concat('第 ', p_partkey, ' 卷') WHEN 2 THEN p_type ELSE concat('第 ', p_size, '.5 卷') END AS label FROM part""")
def _(t):
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ', p_size) WHEN 1 THEN p_name "
                 "WHEN 2 THEN concat(p_name, ' - ', p_type) ELSE concat(p_size, '.5') END")
    return t.part.select("p_partkey", X.volume_label(raw, "p_name", "p_partkey").alias("label"))


@query("b16_split_title_author", """SELECT doc_id,
    trim(CASE WHEN contains(text, '@') THEN substr(text, 1, strpos(text, '@') - 1) ELSE text END, chr(10) || ' ') AS title,
    CASE WHEN contains(text, '@') THEN trim(substr(text, strpos(text, '@') + 1), chr(10) || ' ') ELSE '' END AS author
    FROM documents""")
def _(t):
    p = X.split_title_author("text")
    return t.documents.select("doc_id", p["title"].alias("title"), p["author"].alias("author"))


REF_TEXT = ("CASE page_id % 5 WHEN 0 THEN concat('https://fanqienovel.com/page/', page_id) "
            "WHEN 1 THEN concat('https://fanqienovel.com/x?a=1&book_id=', page_id) "
            "WHEN 2 THEN concat(' 7000000000000000', page_id, ' ') "
            "WHEN 3 THEN concat('http://www.bilinovel.com/novel/', page_id, '.html') ELSE url END")


@query("b17_parse_ref", f"""SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL WHEN 3 THEN 'bilinovel' ELSE 'fanqie' END
    AS source, CASE page_id % 5 WHEN 4 THEN NULL WHEN 2 THEN concat('7000000000000000', page_id)
    ELSE CAST(page_id AS VARCHAR) END AS id FROM pages""")
def _(t):
    r = X.parse_ref(F.expr(REF_TEXT))
    return t.pages.select("page_id", r["source"].alias("source"), r["id"].alias("id"))


@query("b18_abs_url", r"""SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END
    AS absolute, 'https://host.example' || regexp_replace(url, '^https?://[^/]+', '') AS rooted,
    regexp_extract(url, '^https?://[^/]+') || '/next.html' AS joined FROM pages""")
def _(t):
    path = F.regexp_replace("url", r"^https?://[^/]+", "")
    return t.pages.select("page_id", X.abs_url("url").alias("absolute"),
                          X.abs_url(path, F.lit("https://host.example/")).alias("rooted"),
                          X.resolve_url("url", F.lit("/next.html")).alias("joined"))


@query("b19_cover_variants", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat_ws(' ', concat('https://c/t9_', p_partkey),
    concat('https://c/t7_', p_partkey), concat('https://c/b_', p_partkey), concat('https://c/m_', p_partkey),
    concat('https://c/s_', p_partkey)) WHEN 1 THEN concat_ws(' ', concat('https://c/t9_', p_partkey),
    concat('https://c/t7_', p_partkey), concat('https://c/b_', p_partkey), concat('https://c/m_', p_partkey))
    ELSE concat('https://c/x', p_partkey) END AS variants FROM part""")
def _(t):
    url = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('https://c/s_', p_partkey) WHEN 1 THEN concat('https://c/t9_', p_partkey) "
                 "ELSE concat('https://c/x', p_partkey) END")
    return t.part.select("p_partkey", F.array_join(X.cover_variants(url), " ").alias("variants"))


@query("b20_safe_filename", r"""SELECT doc_id, coalesce(nullif(rtrim(substr(trim(regexp_replace(regexp_replace(trim(text, chr(10) || ' '),
    '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), ' .'), 1, 80), ' .'), ''), 'cover') AS name FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.safe_filename("text").alias("name"))


@query("b21_strip_html", f"""WITH l AS (SELECT page_id, {S.page_lines('html')} AS ls FROM pages)
    SELECT page_id, array_to_string(list_filter(ls, lambda l, i: i = 1 OR l <> ls[i - 1]), chr(10)) AS text FROM l""")
def _(t):
    return t.pages.select("page_id", H.strip_html("html").alias("text"))


TITLE_TAG = "regexp_extract(html, '<title>(.*?)</title>', 1)"


@query("b22_inline_text", f"""WITH l AS (SELECT page_id, {S.page_lines(TITLE_TAG, breaks=False)} AS ls FROM pages)
    SELECT page_id, trim(array_to_string(ls, ' ')) AS label FROM l""")
def _(t):
    return t.pages.select("page_id", H.inline_text(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("label"))


@query("b23_unescape_entities", f"SELECT page_id, {S.unescape('html')} AS fixed, replace(replace(url, '/', '&'), '.', '>') AS full FROM pages")
def _(t):
    return t.pages.select("page_id", H.unescape_fixed("html").alias("fixed"),
                          unescape_all(F.replace(F.replace("url", F.lit("/"), F.lit("&#x26;")), F.lit("."), F.lit("&gt;")))
                          .alias("full"))


@query("b26_content_hit_count", r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS h,
    regexp_replace(regexp_extract(text, '^\S+\s+\S+'), '\s+', '', 'g') || 'zq' AS n FROM documents)
    SELECT doc_id, coalesce(nullif((length(h) - length(replace(h, n, ''))) // greatest(length(n), 1), 0),
    CASE WHEN length(n) > 4 THEN nullif((length(h) - length(replace(h, n[1:4], ''))) // 4, 0) END,
    CASE WHEN length(n) > 3 THEN nullif((length(h) - length(replace(h, n[1:3], ''))) // 3, 0) END, 0) AS hits FROM d""")
def _(t):
    probe = F.concat(F.regexp_extract("text", r"^\S+\s+\S+", 0), F.lit("zq"))
    return t.documents.select("doc_id", X.content_hit_count("text", probe).alias("hits"))


GATED = ("CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN 'x=pop_enabled_t' WHEN 2 THEN concat('f.submit()', substr(url, 1, 20)) "
         "WHEN 3 THEN concat('<b>CAPTCHA</b>', html) ELSE '  ' END")


@query("b27_page_gate", """SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'challenge' WHEN page_id % 5 = 2 THEN 'junk'
    WHEN page_id % 7 = 0 OR page_id % 5 = 3 THEN 'blocked' WHEN page_id % 5 = 4 THEN 'empty' ELSE 'ok' END AS gate FROM pages""")
def _(t):
    status = F.when(F.col("page_id") % 7 == 0, 429).otherwise(200)
    return t.pages.select("page_id", H.page_gate(status, F.expr(GATED), F.lit("")).alias("gate"))


@query("b28_body_state", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'truncated' WHEN 2 THEN 'locked'
    ELSE 'empty' END AS state FROM pages""")
def _(t):
    body = F.expr("CASE page_id % 4 WHEN 0 THEN concat('<div id=\"TextContent\">', html, '</div><footer>x') "
                  "WHEN 1 THEN concat('<div class=\"c\" id=\"acontent\">內容加載失敗', html) "
                  "WHEN 2 THEN '<div id=\"acontent\">沒有可閱讀的章節</div>' ELSE html END")
    return t.pages.select("page_id", H.body_state(body).alias("state"))


KIND = ("CASE p_partkey % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'svg' WHEN 4 THEN 'webp' "
        "ELSE '' END")


@query("b29_cover_ok", f"""SELECT p_partkey, {KIND} IN ('jpg', 'png', 'webp') AND p_size * 100 >= 3000 AS usable,
    {KIND} IN ('jpg', 'png', 'webp') AND p_size * 100 >= 512 AS cacheable FROM part""")
def _(t):
    size = F.col("p_size") * 100
    return t.part.select("p_partkey", X.cover_ok(F.expr(KIND), size).alias("usable"),
                         X.cover_ok(F.expr(KIND), size, K.COVER_CACHE_MIN_BYTES).alias("cacheable"))


GENRE_TITLE = ("CASE p_partkey % 7 WHEN 0 THEN concat(p_name, '纯爱重生') WHEN 1 THEN concat('修仙', p_name) WHEN 2 THEN "
               "concat(p_name, '末日') WHEN 3 THEN concat('异世界', p_name) WHEN 4 THEN concat('无限流魔法', p_name) ELSE p_name END")
GENRE_AUTHOR = "CASE p_partkey % 9 WHEN 0 THEN '辰东' WHEN 1 THEN 'priest' WHEN 2 THEN '杀虫队队员' WHEN 3 THEN '渡航著' ELSE p_brand END"


@query("b30_genre_guess", "SELECT p_partkey, CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains({src}, {S.lit(w)})' for w in ws)} THEN '{g}'"
    for src, rules in (("a", K.GENRE_BY_AUTHOR), ("t", K.GENRE_BY_TITLE)) for g, ws in rules)
    + f" ELSE 'unknown' END AS genre FROM (SELECT p_partkey, {GENRE_TITLE} AS t, {GENRE_AUTHOR} AS a FROM part)")
def _(t):
    return t.part.select("p_partkey", X.genre_guess(F.expr(GENRE_TITLE), F.expr(GENRE_AUTHOR)).alias("genre"))


@query("b31_recency", f"""SELECT o_orderkey, round({S.recency("CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 100000 AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END")}, 6) AS recency FROM orders""")
def _(t):
    text = (F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") * 100000).cast("string"))
            .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon"))
    return t.orders.select("o_orderkey", F.round(X.recency(text), 6).alias("recency"))


@query("b32_prefer_file_title", f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' 第 ', p_size, ' 卷')
    WHEN 1 THEN p_name ELSE p_brand END AS title FROM part""")
def _(t):
    meta = F.expr("CASE p_partkey % 3 WHEN 2 THEN ' ' ELSE p_name END")
    stem = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' 第 ', p_size, ' 卷') ELSE p_brand END")
    return t.part.select("p_partkey", X.prefer_file_title(meta, stem).alias("title"))


@query("b33_pick_first", """SELECT event_id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN event_type END, ''),
    nullif(trim(CASE WHEN event_id % 3 = 0 THEN props ELSE ' ' END), ''), CAST(user_id AS VARCHAR)) AS picked FROM events""")
def _(t):
    return t.events.select("event_id", X.pick_first(
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(" "),
        F.col("user_id").cast("string")).alias("picked"))


TAG_TEXT = "concat(p_type, '、', p_brand, '+签约 ', p_name, '，', p_type, ',正版')"


@query("b34_tags_clean", f"""SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array({TAG_TEXT}, '[+＋、,，\\s]+'),
    lambda w: w <> '' AND NOT regexp_matches(w, '{K.TAG_NOISE}'))[1:3], '|') AS tags,
    array_to_string(list_filter([p_type, '', p_brand, p_name, 'x'], lambda w: w <> '')[1:4], '|') AS board FROM part""")
def _(t):
    extra = F.array(F.lit("原创"), F.col("p_name"), F.lit("完结"), F.lit("x"))
    return t.part.select("p_partkey", F.array_join(X.tags_clean(F.expr(TAG_TEXT)), "|").alias("tags"),
                         F.array_join(X.board_tags("p_type", F.lit(""), "p_brand", extra), "|").alias("board"))


@query("b36_volume_tag", r"""WITH v AS (SELECT conv_id, list(role || turn ORDER BY turn) AS ns FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN len(ns) > 3 THEN '全书' ELSE array_to_string(ns, '+') END AS tag FROM v""")
def _(t):
    from bookloom.operators.sections import volume_tags
    return volume_tags(t.conversations.select("conv_id", "turn", F.concat("role", F.col("turn").cast("string")).alias("name")),
                       "conv_id", "turn", "name")


DISPOSITION = ("CASE p_partkey % 3 WHEN 0 THEN concat('attachment; filename*=UTF-8''''%E3%80%8A', replace(p_name, ' ', '%20'), "
               "'%E3%80%8B.txt') WHEN 1 THEN concat('attachment; filename=\"', p_name, '作者：', p_brand, '.txt\"') ELSE 'inline' END")


@query("b37_title_from_filename", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_type ELSE p_name END AS title FROM part""")
def _(t):
    return t.part.select("p_partkey", X.title_from_filename(F.expr(DISPOSITION), "p_type").alias("title"))


REDACT = ("concat(text, CASE doc_id % 3 WHEN 0 THEN concat(' access_token=', doc_id, '&x') WHEN 1 THEN concat(' \"refresh_token\": \"', doc_id, '\"') "
          "ELSE ' session_secret=abc' END)")


@query("b38_redact_secrets", "SELECT doc_id, " + S.rx(S.rx(S.rx(S.rx(S.rx(S.rx(
    REDACT, r"(access_token=)[^\s&\"']+", r"\1***"), r"(['\"]?refresh_token['\"]?\s*[:=]\s*['\"]?)[^\s'\",}]+", r"\1***"),
    r"(['\"]?session_secret['\"]?\s*[:=]\s*['\"]?)[^\s'\",}]+", r"\1***"),
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<邮箱已隐藏>"), r"\b1[3-9]\d{9}\b", "<手机号已隐藏>"),
    r"\b\d{3}-\d{3}-\d{4}\b", "<电话已隐藏>") + " AS clean FROM documents")
def _(t):
    return t.documents.select("doc_id", X.redact_secrets(F.expr(REDACT)).alias("clean"))


@query("b39_cache_key", r"""SELECT page_id, sha1(url) || coalesce(nullif(regexp_extract(string_split(url, '?')[1],
    '\.[A-Za-z0-9]{3,4}$'), ''), '.jpg') AS key FROM pages""")
def _(t):
    return t.pages.select("page_id", X.cache_key("url").alias("key"))


@query("b40_format_size", """SELECT o_orderkey, CASE WHEN n = 0 THEN '—' WHEN n < 1024 THEN concat(n, ' B')
    WHEN n < 1048576 THEN concat(CAST(floor(n / 1024.0 + 0.5) AS BIGINT), ' KB') ELSE printf('%.1f MB', floor(n * 10 / 1048576.0 + 0.5) / 10) END AS size,
    strftime(o_orderdate, '%-m-%-d %H:%M') AS time FROM (SELECT *, (o_orderkey * o_orderkey * 3) % 90000000 AS n FROM orders)""")
def _(t):
    n = (F.col("o_orderkey") * F.col("o_orderkey") * 3) % 90000000
    return t.orders.select("o_orderkey", X.format_size(n).alias("size"), X.format_time("o_orderdate").alias("time"))
