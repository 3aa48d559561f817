"""Records, links, trees and texts out of fetched pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bookloom import constants as K
from bookloom.functions import html as H
from bookloom.functions.lines import drop_title_echo
from bookloom.functions.pyudf import balanced_div, div_spans, nested_objects, page_object
from bookloom.functions.text import abs_url, nonempty, resolve_url, volume_label
from bookloom.operators.scale import first_rows


def extract_records(pages: DataFrame, item: str, fields: dict[str, str], required: Sequence[str], key: str = "page_id",
                    html: str = "html") -> DataFrame:
    """One row per item block: (key, pos, fields...). A field is the first match of its pattern, without tags; blocks
    lacking a required field are dropped (positions count all blocks)."""
    d = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(item), F.lit(0))).alias("pos", "_b"))
    d = d.select(key, (F.col("pos") + 1).alias("pos"), *[H.flat_text(H.unescape_fixed(F.regexp_extract("_b", p, 1))).alias(n)
                                                         for n, p in fields.items()])
    for name in required:
        d = d.where(F.col(name) != "")
    return d


def extract_meta(pages: DataFrame, props: dict[str, Sequence[str]], key: str = "page_id", html: str = "html") -> DataFrame:
    """Named meta tags (the first non-empty of each list); `title` falls back to the first heading and the page title."""
    def value(name: str, wanted: Sequence[str]) -> Column:
        chain = [H.meta_content(html, p) for p in wanted]
        if name == "title":
            chain += [nonempty(H.inline_text(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))) for tag in ("h1", "title")]
        return F.coalesce(*[nonempty(F.trim(H.unescape_fixed(c))) for c in chain], F.lit("")).alias(name)
    return pages.select(key, *[value(n, w) for n, w in props.items()])


def page_state(pages: DataFrame, opening: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, state): the JSON object after `opening`, null when there is none or it does not parse."""
    d = pages.select(key, page_object(F.col(html), opening).alias("_s"))
    return d.select(key, F.to_json(F.try_parse_json("_s")).alias("state"))


def walk_objects(states: DataFrame, key: str = "page_id", state: str = "state") -> DataFrame:
    """(key, pos, book_id, title, object): nested book objects, the first of each id."""
    d = states.select(key, F.posexplode(nested_objects(state)).alias("pos", "object"))
    return d.select(key, "pos", F.get_json_object("object", "$.bookId").alias("book_id"),
                    F.coalesce(F.get_json_object("object", "$.title"), F.get_json_object("object", "$.bookName")).alias("title"), "object")


LINK = r'(?is)<a[^>]+href="([^"#]+)"[^>]*>(.*?)</a>'


def extract_toc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", container: str | None = K.TOC_CONTAINER,
                link: str = LINK, same_path: bool = True) -> DataFrame:
    """(key, pos, name, url): links of the container (of the page when it has none) in page order, resolved, each url
    once, only below the page's own path when same_path is set, blank names dropped."""
    scope = F.coalesce(balanced_div(F.col(html), container), F.col(html)) if container else F.col(html)
    d = pages.select(key, F.col(url).alias("_page"), scope.alias("_scope"))
    links = F.arrays_zip(F.regexp_extract_all("_scope", F.lit(link), F.lit(1)).alias("href"),
                         F.regexp_extract_all("_scope", F.lit(link), F.lit(2)).alias("label"))
    d = d.select(key, "_page", F.posexplode(links).alias("pos", "l"))
    d = d.select(key, "_page", "pos", resolve_url("_page", "l.href").alias("url"), H.inline_text("l.label").alias("name"))
    if same_path:
        path = lambda c: F.regexp_extract(c, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
        d = d.where(path("url").startswith(F.regexp_replace(path("_page"), "[^/]*$", "")))
    return first_rows(d.where(F.col("name") != ""), [key, "url"], [F.col("pos")]).select(key, "pos", "name", "url")


VOLUME_OPEN = r'(?i)<div\b[^>]*\bclass="(?:[^"]*\s)?(?:catalog-)?volume(?:\s[^"]*)?"[^>]*>'
VOLUME_LINK = r'(?i)href="[^"]*/vol_\d+\.html"'


def catalog_tree(pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "") -> DataFrame:
    """(key, title, author, pos, name, url, cover, chapters array<struct<title,url>>), one row per volume. Volume blocks of
    either site layout, else the stretch from one volume link to the next."""
    page = F.col(html)
    mark = "\u0001"
    cut = F.when(page.rlike(VOLUME_OPEN), F.regexp_replace(page, f"({VOLUME_OPEN})", mark + "$1")) \
           .otherwise(F.regexp_replace(page, f"({VOLUME_LINK})", mark + "$1"))
    pieces = F.split(cut, mark)
    title = F.coalesce(nonempty(H.flat_text(F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1))),
                       nonempty(F.regexp_replace(F.regexp_extract(page, "(?i)<title>([^<]+)</title>", 1), "(?:小说在线阅读|分卷章节目录).*$|[ _-]+$", "")), F.lit(""))
    author = F.coalesce(nonempty(F.trim(F.regexp_extract(page, "<title>[^<]*?_([^_]{2,20})作品", 1))),
                        F.regexp_extract(page, r"作者[：:]\s*([^<\s]{2,20})", 1))
    d = pages.select(key, title.alias("title"), author.alias("author"),
                     F.posexplode(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))).alias("pos", "_b"))

    def first(*patterns: str) -> Column:
        return F.coalesce(*[nonempty(H.flat_text(F.regexp_extract("_b", p, 1))) for p in patterns], F.lit(""))
    raw = first(r'(?is)<h2[^>]*class="[^"]*v-line[^"]*"[^>]*>(.*?)</h2>', r'(?is)href="[^"]*vol_\d+\.html"[^>]*>\s*<h3[^>]*>(.*?)</h3>',
                r'(?is)href="[^"]*vol_\d+\.html"[^>]*>([^<]{2,120})<', r'(?is)<img[^>]+alt="([^"]{1,120})"')
    cover = first(r'data-original="([^"]+)"', r'data-src="([^"]+)"', r'<img[^>]+src="([^"]+)"')
    chapter = r'(?is)href="((?:/[^"]*)?/\d+\.html)"[^>]*>(.*?)</a>'
    urls, names = (F.regexp_extract_all("_b", F.lit(chapter), F.lit(g)) for g in (1, 2))
    d = d.withColumn("_links", F.array_sort(F.transform(F.arrays_zip(urls.alias("url"), names.alias("name")),
                                                        lambda x, i: F.struct(x["url"].alias("url"), i.alias("i"), x["name"].alias("name")))))
    once = F.filter("_links", lambda x, i: (i == 0) | (F.get("_links", i - 1)["url"] != x["url"]))  # sorted: the first place of each url
    in_order = F.array_sort(F.transform(once, lambda x: F.struct(x["i"].alias("i"), x["url"].alias("url"), x["name"].alias("name"))))
    kept = F.transform(in_order, lambda x: F.struct(
        F.coalesce(nonempty(H.unescape_fixed(H.flat_text(x["name"]))), F.lit("（无标题）")).alias("title"),
        F.concat(F.lit(base), x["url"]).alias("url")))
    vol = F.regexp_extract("_b", r'href="([^"]*/vol_\d+\.html)"', 1)
    return d.select(key, "title", "author", (F.col("pos") + 1).alias("pos"), volume_label(raw, "title", F.col("pos") + 1).alias("name"),
                    F.when(vol != "", F.concat(F.lit(base), vol)).otherwise("").alias("url"), abs_url(cover, F.lit(base)).alias("cover"),
                    kept.alias("chapters"))


def tree_chapters(tree: DataFrame, key: str = "page_id") -> DataFrame:
    return tree.select(key, F.col("pos").alias("volume"), F.posexplode("chapters").alias("n", "c")) \
               .select(key, "volume", (F.col("n") + 1).alias("chapter"), "c.title", "c.url")


def content_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "") -> DataFrame:
    return pages.select(key, F.explode(H.blocks(html, base)).alias("b")).select(key, "b.pos", "b.kind", "b.value")


def illustration_set(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, pos, is_cover): every image once at its first place; the first one of all is the cover."""
    img = blocks.where(F.col("kind") == "img").groupBy(key, F.col("value").alias("url")).agg(F.min("pos").alias("pos"))
    first = img.groupBy(key).agg(F.min("pos").alias("_cover"))
    return img.join(first, key).select(key, "url", "pos", (F.col("pos") == F.col("_cover")).alias("is_cover"))


def pick_content(pages: DataFrame, html: str = "html", out: str = "text", ad_rules: Sequence[str] = K.SERIAL_AD_LINES) -> DataFrame:
    """Add the chapter text: of the id container when it has ten characters, of a class container when it has eighty, else
    the longest text of any div. Each step only looks at the pages the step before could not settle."""
    need = lambda text, least: F.coalesce(F.length(text), F.lit(0)) < least
    d = once(pages.withColumn("_body", balanced_div(F.col(html), K.CONTENT_ID)), "_id", H.strip_html("_body", ad_rules=ad_rules))
    left = F.when(need("_id", K.CONTENT_ID_MIN), F.col(html))
    d = once(d.withColumn("_body", balanced_div(left, K.CONTENT_CLASS)), "_class", H.strip_html("_body", ad_rules=ad_rules))
    left = F.when(need("_id", K.CONTENT_ID_MIN) & need("_class", K.CONTENT_MIN), F.regexp_replace(html, H.SCRIPT, ""))
    d = once(d, "_page", left).withColumn("_spans", div_spans("_page"))
    longest = longest_text("_page", "_spans", lambda b: H.strip_html(b, ad_rules=ad_rules))
    return d.withColumn(out, F.when(~need("_id", K.CONTENT_ID_MIN), F.col("_id"))
                        .when(~need("_class", K.CONTENT_MIN), F.col("_class")).otherwise(longest)).drop("_id", "_class", "_body", "_page", "_spans")


def once(d: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once for each row. The planner writes a plain column anew into every expression that reads it when
    these go to Python; it does not look through an exploded array of one."""
    return d.select("*", F.explode(F.array(value)).alias(name))


def longest_text(page: str, spans: str, text) -> Column:
    """The longest text of the spans of a page, the first of equal ones. Spans come with a bound on their text, in falling order; one
    that can be no longer than the best so far is not read, and only the best text is held."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(-1).alias("place"))

    def better(best: Column, span: Column) -> Column:
        body = text(F.substring(page, span["start"] + 1, span["length"]))
        # an array of one, so that the text is made once for its length and for itself
        read = F.transform(F.array(body), lambda t: F.struct(t.alias("text"), F.length(t).alias("n"), span["place"].alias("place")))[0]
        longer = lambda r: (r["n"] > best["n"]) | ((r["n"] == best["n"]) & (r["n"] > 0) & (r["place"] < best["place"]))
        kept = F.transform(F.array(read), lambda r: F.when(longer(r), r).otherwise(best))[0]
        can = (span["most"] > best["n"]) | ((span["most"] == best["n"]) & (span["place"] < best["place"]))
        return F.when(can, kept).otherwise(best)
    return F.coalesce(F.aggregate(spans, start, better)["text"], F.lit(""))


def chapter_text(pages: DataFrame, key: str = "page_id", html: str = "html", ad_rules: Sequence[str] = K.SERIAL_AD_LINES,
                 convert=None) -> DataFrame:
    """(key, heading, text): content container, ad and repeated lines out, title echo out, and the phrase conversion last
    (the ad rules are written for the original script)."""
    heading = H.inline_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    d = pick_content(pages.select(key, html, heading.alias("heading")), html, "text", ad_rules).drop(html)
    d = d.withColumn("text", drop_title_echo("text", "heading"))
    return d.withColumn("text", convert(F.col("text"))) if convert else d
