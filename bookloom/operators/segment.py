"""Lines, headings and chapters. A document's lines stay in its own row: no operator here shuffles text, except
the user marker table, which is joined by (document, line)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bookloom import constants as K
from bookloom.functions import lines as L
from bookloom.functions.text import nonempty, strip


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return docs.select(key, F.posexplode(L.split_lines(text)).alias("pos", "line")) \
               .select(key, (F.col("pos") + 1).alias("line_no"), "line")


def read_list(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Title list of many list files: trimmed, invisible characters out, blank and # lines dropped; every title
    once, with the first place (key, line_no) it occurs at."""
    from bookloom.functions.text import strip_zero_width
    rows = explode_lines(docs, key, text).withColumn("title", strip(strip_zero_width("line")))
    rows = rows.where((F.col("title") != "") & ~F.col("title").startswith("#"))
    return (rows.groupBy("title").agg(F.min(F.struct(key, "line_no")).alias("at"))
            .select(F.col(f"at.{key}"), "at.line_no", "title"))


def _heads(arr: Column, heading_regex: str, max_len: int) -> Column:
    lines = F.transform(arr, lambda x, i: F.struct(strip(x).alias("title"), i.alias("at")))
    return F.filter(lines, lambda h: (h["title"] != "") & (F.length(h["title"]) <= max_len)
                    & h["title"].rlike(heading_regex))


def _first_of_each_title(heads: Column) -> Column:
    """Drop repeated titles (the first stays), by sorting on (title, place) instead of searching."""
    by_title = F.array_sort(heads)
    before = F.concat(F.array(F.lit(None).cast("struct<title:string,at:int>")), by_title)
    first = F.zip_with(by_title, before, lambda a, b: F.when(
        a.isNotNull() & (b.isNull() | (a["title"] != b["title"])),
        F.struct(a["at"].alias("at"), a["title"].alias("title"))))
    return F.array_sort(F.filter(first, lambda h: h.isNotNull()))


def detect_headings(docs: DataFrame, key: str = "doc_id", text: str = "text", heading_regex: str = K.HEADING,
                    max_len: int = K.HEADING_MAX) -> DataFrame:
    """(key, line_no, title) of the heading lines."""
    return (docs.select(key, F.explode(_heads(L.split_lines(text), heading_regex, max_len)).alias("h"))
            .select(key, (F.col("h.at") + 1).alias("line_no"), F.col("h.title").alias("title")))


def _content(segment: Column, title: Column, noise: Sequence[str]) -> Column:
    body = F.when(strip(F.get(segment, F.lit(0))) == title, F.slice(segment, 2, F.greatest(F.size(segment), F.lit(1)))) \
            .otherwise(segment)
    return F.array_join(L.clean_chapter_lines(body, noise), "\n")


def split_chapters(docs: DataFrame, key: str = "doc_id", text: str = "text", heading_regex: str = K.HEADING,
                   max_len: int = K.HEADING_MAX, noise: Sequence[str] = K.CHAPTER_NOISE) -> DataFrame:
    """(key, chapter_no, title, line, content). Text before the first heading is dropped, a repeated heading stays
    in the chapter it is in, a document without headings is one chapter at line 0."""
    d = docs.select(key, L.split_lines(text).alias("_lines"))
    d = d.withColumn("_heads", _first_of_each_title(_heads(F.col("_lines"), heading_regex, max_len)))
    spans = F.zip_with("_heads", F.slice("_heads", F.lit(2), F.greatest(F.size("_heads"), F.lit(1))),
                       lambda a, b: F.struct(a["title"].alias("title"), a["at"].alias("at"),
                                             F.coalesce(b["at"], F.size("_lines")).alias("end")))
    parts = F.transform(spans, lambda s: F.struct(
        s["title"].alias("title"), (s["at"] + 1).alias("line"),
        _content(F.slice("_lines", s["at"] + 2, s["end"] - s["at"] - 1), s["title"], noise).alias("content")))
    whole = F.array(F.struct(F.lit(K.WHOLE_TEXT).alias("title"), F.lit(0).alias("line"),
                             F.array_join("_lines", "\n").alias("content")))
    d = d.select(key, F.posexplode(F.when(F.size("_heads") > 0, parts).otherwise(whole)).alias("pos", "c"))
    return d.select(key, (F.col("pos") + 1).alias("chapter_no"), "c.title", "c.line", "c.content")


def split_by_markers(docs: DataFrame, markers: DataFrame, key: str = "doc_id", text: str = "text",
                     noise: Sequence[str] = K.CHAPTER_NOISE) -> DataFrame:
    """Chapters at user markers (key, line from 1, title, ord). A marker outside the text has empty content, of
    several markers on one line the last gets the text.

    Only the distinct marker lines inside the text meet the document row, so there are at most as many as the
    document has lines; the markers themselves are joined back by (key, line), which spreads a long list.
    """
    at = markers.select(key, F.col("line").cast("int").alias("line")).distinct()
    sized = docs.select(key, F.size(L.split_lines(text)).alias("_n"))
    inside = at.join(sized, key).where((F.col("line") >= 1) & (F.col("line") <= F.col("_n")))
    cuts = inside.groupBy(key).agg(F.array_sort(F.collect_set("line")).alias("_cuts"))
    d = docs.select(key, L.split_lines(text).alias("_lines")).join(cuts, key)
    spans = F.zip_with("_cuts", F.slice("_cuts", F.lit(2), F.greatest(F.size("_cuts"), F.lit(1))),
                       lambda a, b: F.struct(a.alias("line"), F.coalesce(b, F.size("_lines") + 1).alias("end")))
    pieces = (d.select(key, F.explode(F.transform(spans, lambda s: F.struct(
        s["line"].alias("line"), F.slice("_lines", s["line"], s["end"] - s["line"]).alias("segment")))).alias("p"))
        .select(key, "p.line", "p.segment"))
    last = markers.groupBy(key, F.col("line").cast("int").alias("line")).agg(F.max("ord").alias("ord"))
    owned = pieces.join(last, [key, "line"]).select(key, F.col("ord").alias("_ord"), "segment")
    out = markers.join(owned.withColumnRenamed("_ord", "ord"), [key, "ord"], "left")
    return out.select(key, "ord", "title", F.col("line").cast("int").alias("line"),
                      F.coalesce(_content(F.col("segment"), F.col("title"), noise), F.lit("")).alias("content"))


def clean_chapters(chapters: DataFrame, content: str = "content", noise: Sequence[str] = K.CHAPTER_NOISE) -> DataFrame:
    return chapters.withColumn(content, F.array_join(L.clean_chapter_lines(F.split(content, "\n", -1), noise), "\n"))


def drop_ad_lines(docs: DataFrame, rules: Sequence[str], text: str = "text") -> DataFrame:
    return docs.withColumn(text, F.array_join(L.drop_matching(L.split_lines(text), rules), "\n"))


def ad_line_audit(docs: DataFrame, rules: Sequence[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, rule_id, line): the lines that `drop_ad_lines` drops, each with the first rule it matches. `rules` is (rule id, pattern)
    in order; all of them together are tried first, so that lines without an ad are looked at once."""
    any_rule = L.alternation([pattern for _, pattern in rules])
    lines = F.transform(L.split_lines(text), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    hits = F.filter(lines, lambda r: r["line"].rlike(any_rule))

    def first(line: Column) -> Column:
        return F.coalesce(*[F.when(line.rlike("(?i)" + pattern), F.lit(name)) for name, pattern in rules])
    d = docs.select(key, F.explode(hits).alias("h"))
    return d.select(key, "h.line_no", first(F.col("h.line")).alias("rule_id"), "h.line")


def drop_adjacent_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, F.array_join(L.adjacent_distinct(L.split_lines(text)), "\n"))


def strip_ads(docs: DataFrame, key: str = "doc_id", text: str = "text",
              rules: Sequence[str] = K.AD_PHRASES) -> tuple[DataFrame, DataFrame]:
    """(documents with clean text and the number of cuts, audit rows (key, line_no, kind, rule, fragment))."""
    work = docs.withColumn("_w", L.strip_ad_phrases(text, rules))
    kept = F.filter(F.transform("_w", lambda r: r["kept"]), lambda x: x.isNotNull())
    count = F.aggregate("_w", F.lit(0), lambda n, r: n + F.size(r["removed"]))
    clean = work.select(*[c for c in docs.columns if c != text], F.array_join(kept, "\n").alias(text),
                        count.alias("removed"))
    hits = F.filter("_w", lambda r: r["kind"].isNotNull())
    whole = lambda r: F.array(F.struct(F.lit(None).cast("string").alias("rule"), r["line"].alias("fragment")))
    rows = F.flatten(F.transform(hits, lambda r: F.transform(
        F.when(r["kind"] == "line", whole(r)).otherwise(r["removed"]),
        lambda f: F.struct(r["line_no"].alias("line_no"), r["kind"].alias("kind"), f["rule"].alias("rule"),
                           f["fragment"].alias("fragment")))))
    audit = work.select(key, F.explode(rows).alias("a")).select(key, "a.*")
    return clean, audit


def drop_header_block(docs: DataFrame, key: str = "doc_id", text: str = "text", fallback: Column | None = None,
                      first: int = K.HEADER_LINES) -> DataFrame:
    """(key, title, author, text): the part of the first lines (40) up to the last rule line is cut, title and
    author are read from it."""
    d = docs.select(key, (fallback if fallback is not None else F.lit("")).alias("_fb"), L.split_lines(text).alias("_lines"))
    marks = F.transform(F.slice("_lines", 1, first),
                        lambda x, i: F.when(x.contains(K.HEADER_RULE), i + 1).otherwise(F.lit(0)))
    d = d.withColumn("_end", F.coalesce(F.array_max(marks), F.lit(0)))
    head = F.array_join(F.slice("_lines", F.lit(1), F.col("_end")), "\n")
    return d.select(
        key, F.coalesce(nonempty(strip(F.regexp_extract(head, K.HEADER_META, 1))), "_fb").alias("title"),
        F.coalesce(strip(F.regexp_extract(head, K.HEADER_META, 2)), F.lit("")).alias("author"),
        F.array_join(F.slice("_lines", F.col("_end") + 1, F.size("_lines")), "\n").alias("text"))


def with_completeness(docs: DataFrame, text: str = "text", heading_regex: str = K.TXT_HEADING, min_headings: int = K.BOOK_MIN_HEADINGS,
                      min_chars: int = K.BOOK_MIN_CHARS) -> DataFrame:
    """Add headings, chars and reason; a null reason means the text is complete."""
    heads = F.size(F.filter(F.transform(L.split_lines(text), strip), lambda x: x.rlike(heading_regex)))
    d = docs.withColumns({"headings": heads.cast("long"),
                          "chars": F.length(F.regexp_replace(text, r"(?U)\s+", "")).cast("long")})
    return d.withColumn("reason", F.when(F.col("headings") < min_headings, "few_headings")
                        .when(F.col("chars") < min_chars, "short_text"))


def completeness_check(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """(key, headings, chars, reason): a null reason means the text is complete."""
    return with_completeness(docs.select(key, text), text, **kw).drop(text)


def clean_books(docs: DataFrame, key: str = "doc_id", text: str = "text", ad_rules: Sequence[str] = K.TXT_AD_LINES,
                heading_regex: str = K.TXT_HEADING, **kw) -> DataFrame:
    """Raw text files to books in one pass over each row: (key, title, author, text, headings, chars, reason). The header block and ad lines
    go, headings are set off, and the clean text is checked; what is not complete keeps its row, with the reason. A null
    text has a null text and no reason."""
    return with_completeness(prepare_book_text(docs.select(key, text), key, text, ad_rules, heading_regex), "text", heading_regex, **kw)


def prepare_book_text(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      ad_rules: Sequence[str] = K.TXT_AD_LINES, heading_regex: str = K.TXT_HEADING) -> DataFrame:
    """Raw text file to clean book text: header block out, ad lines out, headings set off by blank lines."""
    from bookloom.functions.text import strip_zero_width
    d = drop_header_block(docs.withColumn(text, strip_zero_width(text)), key, text)
    lines = F.filter(L.split_lines("text"), lambda x: ~strip(x).rlike(L.alternation(ad_rules)) | (strip(x) == ""))
    laid = F.transform(lines, lambda x: F.when(strip(x).rlike(heading_regex), F.concat(F.lit("\n"), strip(x), F.lit("\n")))
                       .otherwise(F.regexp_replace(x, r"(?U)\s+$", "")))
    return d.withColumn("text", L.collapse_blank_runs(F.array_join(laid, "\n")))


def select_ordinals(volumes: DataFrame, picks: DataFrame, book: str = "book", pos: str = "pos") -> DataFrame:
    """Keep the chosen 1-based volumes; a request none of whose choices exists gives one error row."""
    kept = volumes.join(picks.select(book, pos).distinct(), [book, pos], "left_semi").withColumn("error", F.lit(None).cast("string"))
    lost = picks.select(book).distinct().join(kept.select(book).distinct(), book, "left_anti")
    return kept.unionByName(lost.withColumn("error", F.lit("no such volume")), allowMissingColumns=True)
