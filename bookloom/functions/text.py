"""Column expressions for titles, authors, labels, urls and short texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession, functions as F

from bookloom import constants as K
from bookloom.functions import pyudf

BLANK = r"[\s　]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def pick_first(*cols) -> Column:
    """First value of a fallback chain that is not blank, else the empty text."""
    return F.coalesce(*[nonempty(F.trim(_c(c))) for c in cols], F.lit(""))


# --- titles -----------------------------------------------------------------------------------------------

def simplified_map(spark: SparkSession) -> tuple[str, str]:
    """Traditional to simplified characters as a translate() pair, derived from the Unicode transliteration rule
    that ships with Spark's ICU; characters with several readings stay out."""
    block = "".join(chr(c) for c in range(0x4E00, 0xA000))
    rule = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    pairs = [(a, b) for a, b in zip(block, rule.transliterate(block)) if a != b and a not in K.AMBIGUOUS_TRADITIONAL]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def to_simplified(c: Column, mapping: tuple[str, str] | None) -> Column:
    return F.translate(c, *mapping) if mapping and mapping[0] else c


def stripped_title(title: Column, strip_brackets: bool, normalized: bool) -> Column:
    text = strip(title if normalized else nfkc(title))
    for _ in range(2):
        text = strip(F.regexp_replace(text, K.TITLE_MARK, "$1"))
    if strip_brackets:
        for _ in range(3):
            text = F.regexp_replace(text, K.BRACKETED, "")
    text = F.regexp_replace(text, K.LEADING_NOISE, "")
    for _ in range(2):
        text = F.regexp_replace(text, K.VOLUME_TAIL, "")
    return text


def fold_short_tail(c) -> Column:
    """Drop a separator and a subtitle of at most three characters."""
    text = strip(_c(c))
    return F.when(text.rlike(K.SHORT_TAIL), strip(F.regexp_extract(text, K.SHORT_TAIL, 1))).otherwise(_c(c))


def norm_title(c, strip_brackets: bool = True, fold_tail: bool = False,
               simplified: tuple[str, str] | None = None, normalized: bool = False) -> Column:
    """Comparison form of a title. `normalized=True` says the input is NFKC already (no Python step then)."""
    return title_key(stripped_title(_c(c), strip_brackets, normalized), fold_tail, simplified)


def title_key(stripped: Column, fold_tail: bool, simplified: tuple[str, str] | None = None) -> Column:
    """Last step of norm_title: the optional fold, simplified characters, no punctuation, lower case."""
    text = F.regexp_replace(strip(stripped), K.SHORT_TAIL, "$1") if fold_tail else stripped
    text = F.regexp_replace(to_simplified(text, simplified), K.TITLE_PUNCT, "")
    return F.coalesce(F.lower(text), F.lit(""))


def search_title(c, normalized: bool = False) -> Column:
    """Readable form for literal search boxes: decorations go, punctuation stays."""
    text = trim_chars(strip(stripped_title(_c(c), True, normalized)), K.SEARCH_TRIM)
    return F.coalesce(nonempty(text), strip(_c(c)), F.lit(""))


def strip_volume_tail(c) -> Column:
    """Up to five rounds of dropping a trailing volume number or volume word; a round that would leave less
    than two characters is undone and ends the work."""
    volume = (rf"(?i)[{K.TAIL_SEP}]*[（(【\[]?{BLANK}*(?:第{BLANK}*[0-9一二三四五六七八九十百零〇.]+{BLANK}*[部卷册季集]"
              rf"|[0-9]+(?:\.[0-9]+)?{BLANK}*[部卷册季集]|{K.TAIL_DECOR}){BLANK}*[）)】\]]?{BLANK}*$")
    number = rf"[{K.TAIL_SEP}]+[0-9]+(?:\.[0-9]+)?{BLANK}*$"
    subtitle = rf"(?is)^(.{{2,}}?)[{K.TAIL_SEP}]+[（(【\[]?{BLANK}*(?:{K.TAIL_DECOR}).*$"
    early = rf"(?is)^.?[{K.TAIL_SEP}]+[（(【\[]?{BLANK}*(?:{K.TAIL_DECOR})"
    start = strip(_c(c))

    def one_round(state: Column) -> Column:
        before = state["q"]
        cut = strip(F.regexp_replace(before, volume, ""))
        cut = F.when(cut == before, strip(F.regexp_replace(before, number, ""))).otherwise(cut)
        cut = F.when(cut.rlike(early), cut).otherwise(strip(F.regexp_replace(cut, subtitle, "$1")))
        stop = (cut == before) | (F.length(cut) < 2)
        return F.when(state["done"], state).otherwise(
            F.struct(F.when(stop, before).otherwise(cut).alias("q"), stop.alias("done")))

    # a fold over five rounds keeps the plan small (nesting the rounds would double it each time)
    final = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.struct(start.alias("q"), F.lit(False).alias("done")),
                        lambda acc, _: one_round(acc), lambda acc: acc["q"])
    return F.coalesce(nonempty(final), start)


def key_title(c) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), K.KEY_TITLE_DROP, ""))


def bare_text(c) -> Column:
    """Letters, digits and underscores only, case kept."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), K.NON_WORD, "")


def alnum_key(c) -> Column:
    return F.lower(bare_text(c))


# --- authors ----------------------------------------------------------------------------------------------

def clean_author(c, normalized: bool = False) -> Column:
    text = F.regexp_replace(_c(c) if normalized else nfkc(_c(c)), K.AUTHOR_BRACKETS, " ")
    text = F.regexp_replace(strip(text), K.AUTHOR_ROLE, "")
    text = F.regexp_replace(text, K.AUTHOR_ROLE_TAIL, "")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.coalesce(trim_chars(text, K.AUTHOR_TRIM), F.lit(""))


def norm_author(c) -> Column:
    text = F.regexp_replace(F.coalesce(_c(c), F.lit("")), K.AUTHOR_ORIGIN, "")
    return F.lower(F.regexp_replace(text, K.AUTHOR_PUNCT, ""))


def author_matches(author, hint) -> Column:
    a, h = norm_author(author), norm_author(hint)
    return F.when(h == "", True).when(a == "", False).otherwise(a.contains(h) | h.contains(a))


# --- numbers ----------------------------------------------------------------------------------------------

def first_number(c) -> Column:
    digits = F.regexp_extract(F.coalesce(_c(c).cast("string"), F.lit("")), r"\d+(?:\.\d+)?", 0)
    return F.coalesce(nonempty(digits).cast("double"), F.lit(0.0))


def recency(c) -> Column:
    """Newer dates score higher: yyyymmdd/21000000 for ISO dates, seconds/2e9 for plain digits, both capped at 1."""
    text = F.coalesce(_c(c).cast("string"), F.lit(""))
    ymd = F.concat(*[F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})", i) for i in (1, 2, 3)])
    return (F.when(ymd != "", F.least(ymd.cast("double") / 21000000.0, F.lit(1.0)))
            .when(text.rlike(r"^\d+$"), F.least(text.cast("double") / 2000000000.0, F.lit(1.0)))
            .otherwise(F.lit(0.0)))


def cn_number(c) -> Column:
    """Chinese numerals up to 99; anything else is 0."""
    text = F.coalesce(_c(c), F.lit(""))

    def digit(x: Column, missing: int, other: int) -> Column:
        one = F.when(F.length(x) == 1, nonempty(F.translate(x, "零一二两三四五六七八九", "01223456789"))
                     .try_cast("int"))
        return F.when(x == "", F.lit(missing)).otherwise(F.coalesce(one, F.lit(other)))

    at = F.instr(text, "十")
    tens = digit(F.substring(text, F.lit(1), at - 1), 1, 1)
    ones = digit(F.substring(text, at + 1, F.length(text)), 0, 0)
    return F.when(at > 0, tens * 10 + ones).otherwise(digit(text, 0, 0)).cast("int")


def parse_volume(c) -> Column:
    """struct(volume, title): the volume number named in a title and the title without it."""
    pattern = r"第[\s　]*([0-9０-９一二三四五六七八九十百千]+)[\s　]*[卷冊册]"
    text = strip(F.coalesce(_c(c), F.lit("")))
    raw = F.translate(F.regexp_extract(text, pattern, 1), "０１２３４５６７８９", "0123456789")
    number = F.when(raw.rlike(r"^[0-9]+$"), raw.try_cast("int")).otherwise(cn_number(raw))
    # only the first mention goes
    found = F.regexp_extract(text, pattern, 0)
    at = F.instr(text, found)
    rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(found), F.length(text)))
    clean = trim_chars(rest, " ·・-—–,，、")
    return F.struct(
        F.when((raw == "") | (number == 0), F.lit(1)).otherwise(number).cast("int").alias("volume"),
        F.when(raw == "", text).otherwise(F.coalesce(nonempty(clean), text)).alias("title"))


def volume_label(raw, title, ordinal) -> Column:
    name, book = F.trim(F.coalesce(_c(raw), F.lit(""))), F.coalesce(_c(title), F.lit(""))
    tail = trim_chars(F.substring(name, F.length(book) + 1, F.length(name)), " -_·|/　")
    name = F.when((book != "") & name.startswith(book), tail).otherwise(name)
    name = F.when(name.rlike(r"^\d+(?:\.\d+)?$"), F.concat(F.lit("第 "), name, F.lit(" 卷"))).otherwise(name)
    return F.coalesce(nonempty(name), F.concat(F.lit("第 "), _c(ordinal).cast("string"), F.lit(" 卷")))


def format_size(c) -> Column:
    n = _c(c).cast("double")
    return (F.when(n.isNull() | (n == 0), F.lit("—"))
            .when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
            .when(n < 1048576, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB")))
            .otherwise(F.concat(F.regexp_replace(F.format_number(F.floor(n * 10 / 1048576 + 0.5) / 10, 1), ",", ""), F.lit(" MB"))))


def format_time(c) -> Column:
    return F.coalesce(F.date_format(_c(c), "M-d HH:mm"), F.lit("—"))


# --- cleaning ---------------------------------------------------------------------------------------------

def strip_pua(c) -> Column:
    return F.regexp_replace(_c(c), K.PRIVATE_USE, "")


def has_pua(c) -> Column:
    return F.coalesce(_c(c).rlike(K.PRIVATE_USE), F.lit(False))


def strip_controls(c) -> Column:
    return F.regexp_replace(_c(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def strip_zero_width(c) -> Column:
    return F.regexp_replace(_c(c), "[​-‏‪-‮⁠﻿]", "")


def safe_filename(c, max_length: int = 80, default: str = "cover") -> Column:
    text = F.regexp_replace(strip(F.coalesce(_c(c), F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]', "_")
    text = trim_chars(F.regexp_replace(text, r"(?U)\s+", " "), " .")
    text = F.rtrim(F.substring(text, 1, max_length), F.lit(" ."))
    return F.coalesce(nonempty(text), F.lit(default))


def title_from_filename(header, default) -> Column:
    """Book title from a Content-Disposition header."""
    star = F.try_url_decode(nonempty(F.regexp_extract(_c(header), r"filename\*=UTF-8''([^;]+)", 1)))
    plain = F.try_url_decode(nonempty(F.regexp_extract(_c(header), r'filename="([^"]+)"', 1)))
    name = trim_chars(strip(F.coalesce(star, plain, F.lit(""))), '"')
    name = strip(F.regexp_replace(F.regexp_replace(name, "[《》【】]", ""), "作者[：:].*$", ""))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(nonempty(F.trim(F.regexp_replace(stem, r'[\\/:*?"<>|]', "_"))), _c(default))


def redact_secrets(c) -> Column:
    text = F.regexp_replace(_c(c), r"(access_token=)[^\s&\"']+", "$1***")
    for name in ("refresh_token", "session_secret"):
        text = F.regexp_replace(text, rf"(['\"]?{name}['\"]?\s*[:=]\s*['\"]?)[^\s'\",}}]+", "$1***")
    text = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<邮箱已隐藏>")
    text = F.regexp_replace(text, r"\b1[3-9]\d{9}\b", "<手机号已隐藏>")
    return F.regexp_replace(text, r"\b\d{3}-\d{3}-\d{4}\b", "<电话已隐藏>")


def prefer_file_title(meta, stem) -> Column:
    m, s = F.trim(F.coalesce(_c(meta), F.lit(""))), F.trim(F.coalesce(_c(stem), F.lit("")))
    return F.when((m != "") & (s != "") & s.contains(m), s).when(m != "", m).otherwise(s)


def split_title_author(c) -> Column:
    at = F.instr(_c(c), "@")
    return F.struct(
        strip(F.when(at > 0, F.substring(_c(c), F.lit(1), at - 1)).otherwise(_c(c))).alias("title"),
        F.when(at > 0, strip(F.substring(_c(c), at + 1, F.length(_c(c))))).otherwise(F.lit("")).alias("author"))


def tags_clean(c, keep: int = 3, noise: str = K.TAG_NOISE) -> Column:
    words = F.split(F.coalesce(_c(c), F.lit("")), r"[+＋、,，\s]+")
    return F.slice(F.filter(words, lambda w: (w != "") & ~w.rlike(noise)), 1, keep)


def board_tags(genre, era, theme, all_tags) -> Column:
    """genre, era, theme, then the specific tags; blanks dropped, at most four."""
    extra = F.filter(F.coalesce(_c(all_tags), F.array().cast("array<string>")),
                     lambda t: ~t.isin(*K.GENERIC_TAGS))
    return F.slice(F.filter(F.concat(F.array(_c(genre), _c(era), _c(theme)), extra),
                            lambda t: t.isNotNull() & (t != "")), 1, 4)


def volume_tag(names) -> Column:
    named = F.filter(_c(names), lambda n: n != "")
    n = F.size(_c(names))
    return (F.when((n == 1) & (F.size(named) == 1), named[0]).when(n > 3, F.lit("全书"))
            .otherwise(F.array_join(named, "+")))


def genre_guess(title, author, by_author=K.GENRE_BY_AUTHOR, by_title=K.GENRE_BY_TITLE) -> Column:
    """First matching keyword rule: author lists, then title lists; a list is (genre, keywords)."""
    t, a = F.coalesce(_c(title), F.lit("")), F.coalesce(_c(author), F.lit(""))

    def hit(text: Column, words) -> Column:
        return reduce(lambda x, y: x | y, [text.contains(w) for w in words])
    rules = [(hit(a, ws), g) for g, ws in by_author] + [(hit(t, ws), g) for g, ws in by_title]
    out = F.when(F.lit(False), "unknown")
    for cond, genre in rules:
        out = out.when(cond, genre)
    return out.otherwise("unknown")


# --- references, urls, covers -----------------------------------------------------------------------------

def parse_ref(c) -> Column:
    """struct(source, id) of a book url or a bare id; null when nothing is recognised."""
    text = strip(F.coalesce(_c(c), F.lit("")))
    rules = [F.when(text.rlike(p), F.struct(F.lit(s).alias("source"), F.regexp_extract(text, p, 1).alias("id")))
             for p, s in K.REF_RULES]
    return F.when((text != "") & (F.length(text) <= 500), F.coalesce(*rules))


def decode_url_escapes(c) -> Column:
    """Undo the JSON escapes and entities that occur inside urls of page states."""
    text = F.regexp_replace(_c(c), r"\\/", "/")
    for code, ch in (("002[fF]", "/"), ("003[aA]", ":"), ("0026", "&"), ("003[dD]", "="), ("003[fF]", "?")):
        text = F.regexp_replace(text, rf"\\u{code}", ch)
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def nfkc(c) -> Column:
    """Compatibility form; ASCII is its own and stays in the JVM."""
    c, other = _c(c), r"[^\x00-\x7F]"
    return F.when(c.rlike(other), pyudf.nfkc(F.when(c.rlike(other), c))).otherwise(c)


def abs_url(c, base=None) -> Column:
    url = decode_url_escapes(F.trim(F.coalesce(_c(c), F.lit(""))))
    root = F.rtrim(_c(base), F.lit("/")) if base is not None else F.lit("")
    return (F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
            .when(url.startswith("http://"), F.concat(F.lit("https://"), F.substring(url, F.lit(8), F.length(url))))
            .when(url.startswith("/") & (root != ""), F.concat(root, url)).otherwise(url))


def resolve_url(base, href) -> Column:
    """href as seen from the page `base`. Plain addresses, rooted paths and paths below the page's folder are put together
    in the JVM; dot segments, empty segments, fragments and the like go to the helper."""
    b, h = _c(base), _c(href)
    site, path, ask = r"^https?://[\w.-]+(?::\d+)?/", r"[\w~%=,+./-]*", r'(?:\?[!-"$-~]+)?$'
    odd = r"[^:]//|/\."
    page = b.rlike(site + path + "$") & ~b.rlike(odd)
    whole, rooted = h.rlike(site + path + ask), h.rlike("^/" + path + ask)
    below = h.rlike(r"^[\w~%=,+-]" + path + ask)
    sure = page & (whole | rooted | below) & ~h.rlike(odd) & ~h.startswith("//")
    plain = (F.when(whole, h).when(rooted, F.concat(F.regexp_extract(b, "^https?://[^/]+", 0), h))
             .otherwise(F.concat(F.regexp_extract(b, "^.*/", 0), h)))
    return F.when(sure, plain).otherwise(pyudf.join_url(F.when(~sure, b), h))


def cover_variants(c) -> Column:
    """The same cover in other sizes, largest first; [url] when the name carries no size prefix."""
    url = F.coalesce(_c(c), F.lit(""))
    prefix = "|".join(K.COVER_PREFIXES)
    head = F.regexp_extract(url, rf"^(.*/)(?:{prefix})([^/]+)$", 1)
    base = F.regexp_extract(url, rf"^(.*/)(?:{prefix})([^/]+)$", 2)
    sized = [F.concat(head, F.lit(p), base) for p in K.COVER_TRY]
    return (F.when(url == "", F.array().cast("array<string>"))
            .when(head == "", F.array(url)).otherwise(F.array_distinct(F.array(*sized, url))))


def cover_ok(kind, size, min_bytes: int = K.COVER_MIN_BYTES) -> Column:
    k = F.lower(F.coalesce(_c(kind), F.lit("")))
    return k.isin("jpg", "jpeg", "png", "bmp", "webp", "avif") & (_c(size) >= min_bytes)


def cache_key(c) -> Column:
    ext = F.regexp_extract(F.split(_c(c), r"\?")[0], r"(?i)\.[a-z0-9]{3,4}$", 0)
    return F.concat(F.sha1(_c(c)), F.coalesce(nonempty(ext), F.lit(".jpg")))


def content_hit_count(text, query) -> Column:
    """Occurrences of the query, else of its first four, else of its first three characters; blanks ignored."""
    hay = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)\s+", "")
    needle = F.regexp_replace(F.coalesce(_c(query), F.lit("")), r"(?U)\s+", "")

    def count(n: Column) -> Column:
        gone = F.length(hay) - F.length(F.replace(hay, n, F.lit("")))
        return F.when(F.length(n) > 0, (gone / F.length(n)).cast("long"))
    short = [F.when(F.length(needle) > k, F.nullif(count(F.substring(needle, 1, k)), F.lit(0))) for k in (4, 3)]
    return F.coalesce(F.nullif(count(needle), F.lit(0)), *short, F.lit(0)).cast("long")


def media_kind(c) -> Column:
    """File kind by magic bytes: images by header, zip, mobi, fb2."""
    h = F.hex(F.substring(_c(c), 1, 12))
    brand = F.hex(F.substring(_c(c), 1, 32))
    head = F.regexp_replace(F.decode(F.substring(_c(c), 1, 400), "ISO-8859-1"), r"^(?:ï»¿)?\s+", "")
    head = F.regexp_replace(head, "^ï»¿", "")
    return (F.when(h.startswith("FFD8FF"), "jpg").when(h.startswith("89504E470D0A1A0A"), "png")
            .when(h.startswith("47494638"), "gif").when(h.startswith("424D"), "bmp")
            .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
            .when(brand.contains("6674797061766966") | brand.contains("6674797061766973"), "avif")
            .when(h.rlike("^504B0[357]"), "zip")
            .when(F.hex(F.substring(_c(c), 61, 8)) == "424F4F4B4D4F4249", "mobi")
            .when(head.startswith("<?xml") | head.startswith("<FictionBook"), "fb2"))


def png_gif_size(c) -> Column:
    """struct(width, height) of PNG and GIF headers, from the bytes alone."""
    def number(at: int, n: int, little: bool) -> Column:
        order = range(n, 0, -1) if little else range(1, n + 1)
        return F.conv(F.concat(*[F.hex(F.substring(_c(c), at + i, 1)) for i in order]), 16, 10).cast("int")
    kind = media_kind(c)
    return (F.when(kind == "png", F.struct(number(16, 4, False).alias("width"), number(20, 4, False).alias("height")))
            .when(kind == "gif", F.struct(number(6, 2, True).alias("width"), number(8, 2, True).alias("height"))))
