"""Queries for lines, headings and chapters (group C) and the title list (A1)."""

from pyspark.sql import functions as F

from bookloom.functions import lines as L
from bookloom.operators import library, rules, segment as G
from bookloom.plans import sqltext as S
from bookloom.plans.registry import query

LINES = ("(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
         "generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)")
TRIM = S.strip("line")
IS_HEAD = f"{TRIM} <> '' AND length({TRIM}) <= 25 AND regexp_matches({TRIM}, '{S.HEADING_SQL}')"
AD_RULES = (r"https?://", r"@", r"licen[sc]e", r"^\S+[.]$")
PHRASES = (r"[^\n.]{0,12}tion[^\n.]{0,6}\.", r"der [a-z]{4,9}")


@query("a1_read_title_list", f"""SELECT first(doc_id ORDER BY doc_id, line_no) AS doc_id,
    CAST(first(line_no ORDER BY doc_id, line_no) AS INTEGER) AS line_no, {TRIM} AS title FROM {LINES}
    WHERE {TRIM} <> '' AND {TRIM} NOT LIKE '#%' GROUP BY {TRIM}""")
def _(t):
    return G.read_list(t.documents)


@query("c1_explode_lines", f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM {LINES}")
def _(t):
    return G.explode_lines(t.documents)


@query("c2_drop_ad_lines", f"""SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no)
    FILTER (WHERE NOT regexp_matches(line, '(?i){"|".join(AD_RULES)}')), '') AS text FROM {LINES} GROUP BY doc_id""")
def _(t):
    return G.drop_ad_lines(t.documents.select("doc_id", "text"), AD_RULES)


def ad_rules(t):
    """The ad rules as a rule table."""
    return t.spark.createDataFrame([("ad_line", i, f"ad{i}", p) for i, p in enumerate(AD_RULES)], "kind string, ord int, rule_id string, pattern string")


@query("c2_ad_line_audit", f"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE {" ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN 'ad{i}'" for i, p in enumerate(AD_RULES))} END AS rule_id, line
    FROM {LINES} WHERE regexp_matches(line, '(?i){"|".join(AD_RULES)}')""")
def _(t):
    return rules.drop_ad_lines(t.documents.select("doc_id", "text"), ad_rules(t))[1]


def _phrase(x, rule):
    frags = f"list_filter(regexp_extract_all({x}, {S.lit(rule)}), lambda f: length(trim(f)) >= 6)"
    return frags


SQUEEZED = S.strip(S.rx("line", "[ \\t]+", " "))
CUT = "list_reduce({f}, lambda a, b: replace(a, b, ''), {x})"
STEPS = f"""l0 AS (SELECT doc_id, line_no, {SQUEEZED} AS s FROM {LINES}),
    l1 AS (SELECT *, {_phrase('s', PHRASES[0])} AS f1 FROM l0 WHERE s <> ''),
    l2 AS (SELECT *, {CUT.format(f='f1', x='s')} AS s1 FROM l1),
    l3 AS (SELECT *, {_phrase('s1', PHRASES[1])} AS f2 FROM l2),
    l4 AS (SELECT *, {S.strip(S.rx(CUT.format(f='f2', x='s1'), '[ 	]+', ' '))} AS s2 FROM l3)"""


@query("c3_strip_ad_phrases", f"""WITH {STEPS} SELECT doc_id, CAST(sum(len(f1) + len(f2)) AS INTEGER) AS removed,
    coalesce(string_agg(s2, chr(10) ORDER BY line_no) FILTER (WHERE NOT regexp_matches(s2, '^[（(]?\\s*[)）]?$')), '') AS text
    FROM l4 GROUP BY doc_id""")
def _(t):
    return G.strip_ads(t.documents.select("doc_id", "text"), rules=PHRASES)[0]


@query("c3_strip_ad_audit", f"""WITH {STEPS}, a AS (
    SELECT doc_id, line_no, 'inline' AS kind, {S.lit(PHRASES[0])} AS rule, unnest(f1) AS fragment FROM l4 UNION ALL
    SELECT doc_id, line_no, 'inline', {S.lit(PHRASES[1])}, unnest(f2) FROM l4 UNION ALL
    SELECT doc_id, line_no, 'line', NULL, s FROM l4 WHERE len(f1) + len(f2) = 0 AND regexp_matches(s2, '^[（(]?\\s*[)）]?$'))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind, rule, fragment FROM a""")
def _(t):
    return G.strip_ads(t.documents.select("doc_id", "text"), rules=PHRASES)[1]


@query("c4_drop_adjacent_repeats", f"""SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE keep) AS text FROM (
    SELECT *, line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS keep FROM {LINES}) GROUP BY doc_id""")
def _(t):
    return G.drop_adjacent_repeats(t.documents.select("doc_id", "text"))


ECHO_TITLE = "regexp_extract(text, '^[^ ]+ [^ .]+', 0)"
ECHO_BODY = f"CASE conv_id % 2 WHEN 0 THEN concat({ECHO_TITLE}, ' (x)', chr(10), text) ELSE text END"


@query("c5_drop_title_echo", f"""WITH b AS (SELECT conv_id, turn, {S.bare(ECHO_TITLE)} AS n, {ECHO_BODY} AS body FROM conversations),
    f AS (SELECT *, {S.bare("string_split(body, chr(10))[1]")} AS first,
      CASE WHEN contains(body, chr(10)) THEN {S.strip("substr(body, strpos(body, chr(10)) + 1)")} ELSE '' END AS rest FROM b)
    SELECT conv_id, turn, CASE WHEN length(n) >= 4 AND starts_with(first, n) AND length(first) <= length(n) + 12
      AND length({S.rx('rest', chr(92) + 's+')}) >= 30 THEN rest ELSE body END AS text FROM f""")
def _(t):
    return t.conversations.select("conv_id", "turn",
                                  L.drop_title_echo(F.expr(ECHO_BODY), F.expr(ECHO_TITLE)).alias("text"))


@query("c6_collapse_blank_runs", r"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, '. ', chr(10) || chr(10) || chr(10) || chr(10)),
    '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text FROM documents""")
def _(t):
    return t.documents.select("doc_id", L.collapse_blank_runs(
        F.replace("text", F.lit(". "), F.lit("\n\n\n\n"))).alias("text"))


HEADED = ("CASE doc_id % 3 WHEN 0 THEN concat('==========', chr(10), '《', source, '》', chr(10), '作者：', lang, ' x', chr(10), '========', chr(10), text) "
          "WHEN 1 THEN concat('a', chr(10), '========', chr(10), text) ELSE text END")


@query("c7_drop_header_block", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'none' END AS title,
    CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS author, text FROM documents""")
def _(t):
    docs = t.documents.withColumn("text", F.expr(HEADED))
    return G.drop_header_block(docs, fallback=F.lit("none"))


@query("c8_completeness_check", f"""WITH h AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches({TRIM}, '{S.HEADING_SQL}')) AS headings
    FROM {LINES} GROUP BY doc_id), d AS (SELECT doc_id, headings, length({S.rx('text', chr(92) + 's+')}) AS chars
    FROM h JOIN documents USING (doc_id)) SELECT *, CASE WHEN headings < 3 THEN 'few_headings' WHEN chars < 1000 THEN 'short_text' END AS reason FROM d""")
def _(t):
    return G.completeness_check(t.documents, heading_regex=S.HEADING_SQL)


CLEAN_LINE = f"CASE WHEN regexp_matches({S.strip('x')}, '{S.HEADING_SQL}') THEN chr(10) || {S.strip('x')} || chr(10) ELSE {S.rx('x', chr(92) + 's+$')} END"


# files with and without a header block, from raw text to checked books
@query("c16_clean_books", f"""WITH l AS (SELECT doc_id, source, lang, list_transform(list_filter(string_split({S.rx('text', '[\u200b-\u200f\u202a-\u202e\u2060\ufeff]')}, chr(10)),
      lambda x: {S.strip('x')} = '' OR NOT regexp_matches({S.strip('x')}, '(?i){"|".join(AD_RULES[:3])}')), lambda x: {CLEAN_LINE}) AS ls FROM documents),
    b AS (SELECT *, {S.rx(S.rx("array_to_string(ls, chr(10))", chr(92) + 'n{3,}', chr(10) * 2), '^' + chr(92) + 'n+|' + chr(92) + 'n+$')} AS text FROM l),
    d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS title, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS author, text,
      len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches({S.strip('x')}, '{S.HEADING_SQL}'))) AS headings, length({S.rx('text', chr(92) + 's+')}) AS chars FROM b)
    SELECT *, CASE WHEN headings < 3 THEN 'few_headings' WHEN chars < 1000 THEN 'short_text' END AS reason FROM d""")
def _(t):
    docs = t.documents.select("doc_id", F.expr(HEADED).alias("text"))
    return G.clean_books(docs, ad_rules=AD_RULES[:3], heading_regex=S.HEADING_SQL)


@query("c9_detect_headings", f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {TRIM} AS title FROM {LINES} WHERE {IS_HEAD}")
def _(t):
    return G.detect_headings(t.documents, heading_regex=S.HEADING_SQL)


CHAPTERS = f"""l AS MATERIALIZED (SELECT doc_id, line_no, line, {TRIM} AS s FROM {LINES}),
    h AS (SELECT doc_id, {TRIM} AS title, min(line_no) AS n FROM {LINES} WHERE {IS_HEAD} GROUP BY 1, 2),
    b AS (SELECT *, lead(n) OVER w AS nx, row_number() OVER w AS no FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    c AS (SELECT b.doc_id, no AS chapter_no, title, n AS line, coalesce(string_agg(s, chr(10) ORDER BY line_no)
      FILTER (WHERE s <> ''), '') AS content FROM b LEFT JOIN l ON l.doc_id = b.doc_id AND line_no > n
      AND (nx IS NULL OR line_no < nx) AND NOT (line_no = n + 1 AND s = title) GROUP BY ALL),
    chapters AS (SELECT doc_id, CAST(chapter_no AS INTEGER) AS chapter_no, title, CAST(line AS INTEGER) AS line, content FROM c
      UNION ALL SELECT doc_id, 1, '全文', 0, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h))"""


@query("c10_split_chapters", f"WITH {CHAPTERS} SELECT * FROM chapters")
def _(t):
    return G.split_chapters(t.documents, heading_regex=S.HEADING_SQL)


# markers: line label_no*2+1 of every labelled document, twice on that line, and one far outside
def _markers(t):
    base = t.labels.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ord"))
    line = F.when(F.col("ord") == 4, F.lit(1000000)).when(F.col("ord") == 3, F.lit(3)).otherwise(F.lit(2))
    return base.select("doc_id", "ord", line.alias("line"), F.concat(F.lit("part "), F.col("ord").cast("string")).alias("title"))


@query("c11_split_by_markers", f"""WITH l AS (SELECT doc_id, line_no, {TRIM} AS s FROM {LINES}), m AS (SELECT doc_id, o AS ord,
    CASE o WHEN 4 THEN 1000000 WHEN 3 THEN 3 ELSE 2 END AS line, concat('part ', o) AS title FROM labels, (SELECT unnest([1, 2, 3, 4]) AS o)),
    k AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY ord), 2000000) AS nx FROM m)
    SELECT k.doc_id, CAST(ord AS INTEGER) AS ord, title, CAST(line AS INTEGER) AS line, coalesce(string_agg(s, chr(10) ORDER BY line_no)
    FILTER (WHERE s <> ''), '') AS content FROM k LEFT JOIN l ON l.doc_id = k.doc_id AND line_no >= line AND line_no < nx GROUP BY ALL""")
def _(t):
    return G.split_by_markers(t.documents, _markers(t))


@query("c12_clean_chapters", f"""SELECT doc_id, coalesce(string_agg({TRIM}, chr(10) ORDER BY line_no) FILTER (WHERE {TRIM} <> ''), '') AS content
    FROM {LINES} GROUP BY doc_id""")
def _(t):
    noisy = F.concat(F.lit("  特典 \n\n"), F.col("text"), F.lit("\n后记\n第3卷 Intermission"))
    return G.clean_chapters(t.documents.select("doc_id", noisy.alias("content")))


FILE = "concat('/lib/', p_name, CASE p_partkey % 3 WHEN 0 THEN '.EPUB' WHEN 1 THEN '.epub' ELSE '.txt' END)"


@query("c13_only_type", "SELECT p_partkey, p_partkey % 3 = 2 AS ignored FROM part")
def _(t):
    files = t.part.select("p_partkey", F.expr(FILE).alias("path"))
    kept, ignored = library.only_type(files, "path", ("epub",))
    return kept.select("p_partkey", F.lit(False).alias("ignored")).unionByName(
        ignored.select("p_partkey", F.lit(True).alias("ignored")))


@query("c13_missing_inputs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return library.missing_inputs(t.documents.select("doc_id"), t.labels, "doc_id")


@query("c14_library_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def _(t):
    return library.search(t.part, "RING ", ("p_name", "p_brand", "p_type")).select("p_partkey")


@query("c15_select_ordinals", """WITH p AS (SELECT c_custkey AS book, c_custkey % 7 AS pos FROM customer UNION ALL SELECT c_custkey, 2 FROM customer),
    v AS (SELECT conv_id AS book, turn AS pos, role FROM conversations), k AS (SELECT * FROM v SEMI JOIN p USING (book, pos))
    SELECT book, pos, role, NULL AS error FROM k UNION ALL
    SELECT DISTINCT book, NULL, NULL, 'no such volume' FROM p WHERE book NOT IN (SELECT book FROM k)""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("book"))
    picks = c.withColumn("pos", F.col("book") % 7).unionByName(c.withColumn("pos", F.lit(2).cast("long")))
    volumes = t.conversations.select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), "role")
    return G.select_ordinals(volumes, picks)
