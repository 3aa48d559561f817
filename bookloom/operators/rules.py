"""Rule tables: patterns, markers and keywords that come as DataFrames instead of constants.

A rule table has the columns kind, ord, rule_id and pattern, and label where a rule stands for something (a genre). Rules become
constant patterns of column expressions, so that each is compiled once and no line ever meets a table of rules in a join. That needs the
rules on the driver: a table is small by nature, and one with more than MOST rules of a kind is refused, never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from bookloom import constants as K
from bookloom.functions import html as H, text as X
from bookloom.functions.lines import alternation
from bookloom.operators import segment

#: most rules of a kind
MOST = 5_000


def read_rules(rules: DataFrame, kind: str, most: int = MOST) -> list[Row]:
    """The rules of a kind in order (ord, then rule_id); rules without a pattern are left out."""
    mine = rules.where((F.col("kind") == kind) & (F.col("pattern") != ""))
    label = F.col("label") if "label" in rules.columns else F.lit(None).cast("string")
    found = mine.select("ord", F.col("rule_id").cast("string").alias("rule_id"), "pattern", label.alias("label")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules of kind {kind}")
    return sorted(found, key=lambda r: (r.ord is None, r.ord or 0, r.rule_id or "", r.pattern))


def drop_ad_lines(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "ad_line") -> tuple[DataFrame, DataFrame]:
    """(documents without the lines that match a rule, audit rows (key, line_no, rule_id, line)). Without rules nothing is dropped."""
    found = read_rules(rules, kind)
    if not found:
        return docs, segment.ad_line_audit(docs, [("", "(?!)")], key, text)
    return (segment.drop_ad_lines(docs, [r.pattern for r in found], text),
            segment.ad_line_audit(docs, [(r.rule_id, r.pattern) for r in found], key, text))


def strip_ads(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "ad_phrase") -> tuple[DataFrame, DataFrame]:
    """`segment.strip_ads` with the rule ids in the audit instead of the patterns; a pattern that is listed twice has its first id."""
    found = read_rules(rules, kind)
    ids = {r.pattern: r.rule_id for r in reversed(found)}
    clean, audit = segment.strip_ads(docs, key, text, tuple(dict.fromkeys(r.pattern for r in found)))
    name = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])[F.col("rule")] if ids else F.lit(None).cast("string")
    return clean, audit.select(key, "line_no", "kind", name.alias("rule_id"), "fragment")


def page_gate(status, page, title, rules: DataFrame, head: int = K.GATE_HEAD) -> Column:
    """`html.page_gate` with the markers of a table; kinds gate_title, gate_body, gate_head, gate_challenge and gate_junk."""
    return H.page_gate(status, page, title, {k: [r.pattern for r in read_rules(rules, f"gate_{k}")] for k in K.GATE_RULES}, head)


def genre_guess(title, author, rules: DataFrame) -> Column:
    """`text.genre_guess` with keywords of a table (pattern: the keyword, label: the genre); kinds genre_author and genre_title.
    The first keyword in order decides, those of authors before those of titles."""
    by = [[(r.label, (r.pattern,)) for r in read_rules(rules, kind)] for kind in ("genre_author", "genre_title")]
    return X.genre_guess(title, author, *by)


def tags_clean(tags, rules: DataFrame, keep: int = 3) -> Column:
    """`text.tags_clean` with the noise patterns of a table, kind tag_noise."""
    found = read_rules(rules, "tag_noise")
    return X.tags_clean(tags, keep, alternation([r.pattern for r in found], ignore_case=False) if found else "(?!)")
