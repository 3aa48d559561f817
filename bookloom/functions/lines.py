"""Line work inside one row: a document is split, filtered and joined as an array, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from bookloom import constants as K
from bookloom.functions.text import _c, bare_text, strip


def alternation(rules: Sequence[str], ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + "|".join(f"(?:{r})" for r in rules)


def split_lines(c) -> Column:
    return F.split(F.regexp_replace(_c(c), r"\r\n?", "\n"), "\n", -1)


def previous(arr: Column) -> Column:
    """The array shifted by one: element i of the result is element i-1."""
    return F.concat(F.array(F.lit(None).cast("string")), arr)


def adjacent_distinct(arr: Column) -> Column:
    """Drop every element equal to the one before it. An array of one holds the lines, so that they are made once for both uses."""
    def distinct(lines: Column) -> Column:
        return F.filter(F.zip_with(lines, previous(lines), lambda a, b: F.when(~a.eqNullSafe(b), a)), lambda x: x.isNotNull())
    return F.transform(F.array(arr), distinct)[0]


def squeeze(line: Column) -> Column:
    return strip(F.regexp_replace(line, "[ \\t　]+", " "))


def drop_matching(arr: Column, rules: Sequence[str]) -> Column:
    return F.filter(arr, lambda x: ~x.rlike(alternation(rules)))


def clean_chapter_lines(arr: Column, rules: Sequence[str] = K.CHAPTER_NOISE) -> Column:
    """Trimmed non-blank lines without the noise lines."""
    noise = alternation(rules, ignore_case=False)
    return F.filter(F.transform(arr, strip), lambda x: (x != "") & ~x.rlike(noise))


def drop_title_echo(text, title) -> Column:
    """Drop a first line that repeats the chapter title, unless too little text would remain."""
    body, name = _c(text), bare_text(title)
    first = bare_text(F.substring_index(body, "\n", 1))
    rest = F.when(F.instr(body, "\n") > 0,
                  strip(F.substring(body, F.instr(body, "\n") + 1, F.length(body)))).otherwise(F.lit(""))
    echo = ((F.length(name) >= K.ECHO_TITLE_MIN) & first.startswith(name)
            & (F.length(first) <= F.length(name) + K.ECHO_EXTRA_MAX)
            & (F.length(F.regexp_replace(rest, r"(?U)\s+", "")) >= K.ECHO_REST_MIN))
    return F.when(echo, rest).otherwise(body)


def collapse_blank_runs(text) -> Column:
    """At most one blank line between text lines, none at either end."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def strip_ad_phrases(text, rules: Sequence[str] = K.AD_PHRASES) -> Column:
    """array<struct<line_no,kept,removed array<struct<rule,fragment>>,kind>> for the non-blank lines of a text.

    The rules run one after the other over each line; fragments of at least AD_PHRASE_MIN characters are cut.
    """
    lines = F.transform(split_lines(text), lambda x, i: F.struct((i + 1).alias("line_no"), squeeze(x).alias("line")))
    lines = F.filter(lines, lambda r: r["line"] != "")
    no_hits = F.array().cast("array<struct<rule:string,fragment:string>>")
    rows = F.transform(lines, lambda r: F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"), r["line"].alias("kept"),
                                                 no_hits.alias("removed")))

    # one pass to find and one to cut per rule: the rule stays a constant pattern and nothing is matched twice
    def find(rule: str):
        return lambda r: r.withField("frags", F.filter(F.regexp_extract_all(r["kept"], F.lit(rule), F.lit(0)),
                                                       lambda f: F.length(F.trim(f)) >= K.AD_PHRASE_MIN))

    def cut(rule: str):
        return lambda r: F.when(F.size(r["frags"]) == 0, r.dropFields("frags")).otherwise(F.struct(
            r["line_no"].alias("line_no"), r["line"].alias("line"),
            F.aggregate(r["frags"], r["kept"], lambda acc, f: F.replace(acc, f, F.lit(""))).alias("kept"),
            F.concat(r["removed"], F.transform(r["frags"], lambda f: F.struct(F.lit(rule).alias("rule"), f.alias("fragment")))).alias("removed")))
    for rule in rules:
        rows = F.transform(F.transform(rows, find(rule)), cut(rule))
    rows = F.transform(rows, lambda r: r.withField("kept", squeeze(r["kept"])))

    def judged(r: Column) -> Column:
        gone = r["kept"].rlike("^[（(]?\\s*[)）]?$")
        return F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"),
                        F.when(~gone, r["kept"]).alias("kept"), r["removed"].alias("removed"),
                        F.when(F.size(r["removed"]) > 0, F.lit("inline")).when(gone, F.lit("line")).alias("kind"))
    return F.transform(rows, judged)
