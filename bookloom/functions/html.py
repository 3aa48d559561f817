"""Column expressions over fetched pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from bookloom import constants as K
from bookloom.functions.lines import adjacent_distinct, alternation, squeeze
from bookloom.functions.text import _c, nonempty, strip

SCRIPT = r"(?is)<(script|style)[^>]*>.*?</\1>"
COMMENT = r"(?s)<!--.*?-->"
BREAK = r"(?i)<br\s*/?>|</p>|</div>|</dd>"
TAG = r"<[^>]+>"


def unescape_fixed(c) -> Column:
    """The entities book pages use, in the fixed order."""
    out = _c(c)
    for entity, text in K.ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(text))
    return out


def text_lines(c, keep_breaks: bool = True, ad_rules: Sequence[str] = ()) -> Column:
    """Text lines of a page: scripts, styles and comments out, breaks kept, blank, ad and repeated lines dropped."""
    page = F.regexp_replace(F.regexp_replace(_c(c), SCRIPT, ""), COMMENT, "")
    if keep_breaks:
        page = F.regexp_replace(page, BREAK, "\n")
    lines = F.transform(F.split(unescape_fixed(F.regexp_replace(page, TAG, "")), "\n", -1), squeeze)
    keep = (lambda x: (x != "") & ~x.rlike(alternation(ad_rules))) if ad_rules else (lambda x: x != "")
    return adjacent_distinct(F.filter(lines, keep))


def strip_html(c, keep_breaks: bool = True, ad_rules: Sequence[str] = ()) -> Column:
    return F.array_join(text_lines(c, keep_breaks, ad_rules), "\n")


def inline_text(c) -> Column:
    """Short label of a page: one line, never touched by ad rules."""
    return strip(F.array_join(text_lines(c, keep_breaks=False), " "))


def flat_text(c) -> Column:
    """Tags replaced by blanks, blanks squeezed."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(_c(c), F.lit("")), TAG, " "), r"(?U)\s+", " "))


def meta_content(page, prop: str) -> Column:
    """Content of a meta tag by property or name, whichever attribute order."""
    p = prop.replace(".", r"\.")
    named = rf'(?:property|name)="{p}"'
    return F.coalesce(
        nonempty(F.regexp_extract(_c(page), rf'(?i)<meta[^>]+{named}[^>]+content="([^"]*)"', 1)),
        nonempty(F.regexp_extract(_c(page), rf'(?i)<meta[^>]+content="([^"]*)"[^>]+{named}', 1)))


def last_page_number(page, last: str = r'class="last"[^>]*>(\d+)<',
                     link: str = r"[?&]page=(\d+)|/wenku/[^\"]*?_(\d+)\.html") -> Column:
    """Declared last page, else the highest page number among the links, else 1."""
    numbers = F.concat(*[F.regexp_extract_all(_c(page), F.lit(link), F.lit(g)) for g in range(1, link.count("(\\d") + 1)])
    return F.coalesce(nonempty(F.regexp_extract(_c(page), last, 1)).cast("long"),
                      F.array_max(F.transform(numbers, lambda n: nonempty(n).cast("long"))), F.lit(1)).cast("long")


def _any(c: Column, markers: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | c.contains(m)
    return out


def page_gate(status, page, title, rules=K.GATE_RULES, head: int = K.GATE_HEAD) -> Column:
    """ok / empty / blocked / challenge / junk. `rules` has the markers of each kind (see K.GATE_RULES); those of the kind `head` are
    looked for in the first `head` characters."""
    html = F.coalesce(_c(page), F.lit(""))
    low, start = F.lower(html), F.lower(F.substring(html, 1, head))
    marked = lambda text, kind: _any(text, rules.get(kind, ()))
    blocked = (_c(status).isin(*K.BLOCK_STATUS) | marked(F.lower(F.coalesce(_c(title), F.lit(""))), "title")
               | marked(low, "body") | marked(start, "head"))
    return (F.when((F.length(html) < K.CHALLENGE_MAX) & marked(html, "challenge"), "challenge")
            .when((F.length(html) < K.JUNK_MAX) & marked(html, "junk"), "junk")
            .when(F.coalesce(blocked, F.lit(False)), "blocked").when(F.trim(html) == "", "empty").otherwise("ok"))


def body_segment(page) -> Column:
    """The body container up to the first end marker, without scripts and ad blocks; null when there is none."""
    start = F.regexp_instr(_c(page), F.lit(K.BODY_OPEN))
    rest = F.when(start > 0, F.substring(_c(page), start, F.length(_c(page))))
    rest = F.regexp_replace(rest, r"(?s)^<[^>]*>", "")
    end = F.regexp_instr(rest, F.lit(K.BODY_END))
    seg = F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
    seg = F.regexp_replace(seg, r"(?s)<script.*?</script>|<ins.*?</ins>", " ")
    return F.regexp_replace(
        seg, r'(?s)<div[^>]*class="[^"]*(?:ad|adsbygoogle|recommend|comment)[^"]*".*?</div>', " ")


def body_state(page) -> Column:
    """full / truncated / locked / empty; only the exact sentences of the site count."""
    seg = body_segment(page)
    has_p = seg.rlike(r"(?i)<p[\s>]")
    return (F.when(seg.isNull(), "empty").when(~has_p & _any(seg, K.LOCKED_NOTES), "locked").when(~has_p, "empty")
            .when(_any(seg, K.TRUNCATED_NOTES), "truncated").otherwise("full"))


def blocks(page, base: str = "") -> Column:
    """array<struct<pos,kind,value>>: paragraphs and images in page order, lazy image sources first."""
    tags = F.regexp_extract_all(_c(page), F.lit(r"(?is)<img\b[^>]*>|<p[^>]*>.*?</p>"), F.lit(0))

    def image(tag: Column) -> Column:
        url = F.trim(F.coalesce(nonempty(F.regexp_extract(tag, r'(?i)data-src="([^"]+)"', 1)),
                                F.regexp_extract(tag, r'(?i)src="([^"]+)"', 1)))
        real = F.when(~(url.endswith("sloading.svg") | url.startswith("/images/")), nonempty(url))
        return F.when(real.startswith("http"), real).otherwise(F.concat(F.lit(base), real))

    def paragraph(tag: Column) -> Column:
        text = unescape_fixed(F.regexp_replace(tag, TAG, ""))
        return nonempty(strip(F.regexp_replace(text, "[​﻿]", "")))

    parsed = F.transform(tags, lambda t: F.when(
        F.lower(F.substring(t, 1, 4)) == "<img", F.struct(F.lit("img").alias("kind"), image(t).alias("value")))
        .otherwise(F.struct(F.lit("p").alias("kind"), paragraph(t).alias("value"))))
    kept = F.filter(parsed, lambda b: b["value"].isNotNull())
    return F.transform(kept, lambda b, i: F.struct((i + 1).alias("pos"), b["kind"].alias("kind"),
                                                   b["value"].alias("value")))
