"""SQL fragments shared by the DuckDB side of several queries, and derived inputs both engines can compute."""

from bookloom import constants as K


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# titles as they arrive: every p_name, decorated in one of ten ways (valid in Spark SQL and DuckDB)
MESSY_TITLE = ("CASE p_partkey % 10 WHEN 1 THEN concat('《', p_name, '》') WHEN 2 THEN concat(p_name, '（番外）') "
               "WHEN 3 THEN concat('完结：', p_name) WHEN 4 THEN concat(p_name, ' 第3卷') "
               "WHEN 5 THEN concat(p_name, '：abc') WHEN 6 THEN concat(p_name, ' 上') "
               "WHEN 7 THEN concat(p_name, '【', p_type, '】') WHEN 8 THEN concat(p_name, ' - the story') "
               "WHEN 9 THEN concat(p_name, ' 第 4 卷 特典') ELSE p_name END")
# authors as they arrive
MESSY_AUTHOR = ("CASE s_suppkey % 5 WHEN 1 THEN concat('[英]', s_name) WHEN 2 THEN concat(s_name, ' 著') "
                "WHEN 3 THEN concat('  ', s_name, '·') WHEN 4 THEN concat('（美）', s_name, '  等') ELSE s_name END")
# the five rank sources the parts are dealt into
POOL_SOURCE = ("CASE p_partkey % 5 WHEN 0 THEN '微信读书' WHEN 1 THEN '起点·月票榜' WHEN 2 THEN '晋江·积分月榜' "
               "WHEN 3 THEN '番茄(gender=0)' ELSE '番茄(gender=1)' END")


def rx(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, {lit(flags)})"


def strip(x: str) -> str:
    return rx(x, r"^\s+|\s+$")


def half_width(x: str) -> str:
    """The part of NFKC the derived titles need."""
    return f"translate({x}, '（）：', '():')"


def stripped_title(x: str, brackets: bool = True) -> str:
    t = strip(half_width(x))
    for _ in range(2):
        t = strip(rx(t, K.TITLE_MARK, r"\1"))
    for _ in range(3 if brackets else 0):
        t = rx(t, K.BRACKETED)
    t = rx(t, K.LEADING_NOISE)
    for _ in range(2):
        t = rx(t, K.VOLUME_TAIL)
    return t


def norm_title(x: str, fold: bool = False, brackets: bool = True) -> str:
    t = stripped_title(x, brackets)
    if fold:
        t = rx(strip(t), K.SHORT_TAIL, r"\1")
    return f"lower({rx(t, K.TITLE_PUNCT)})"


def bare(x: str) -> str:
    return rx(x, r"[^\p{L}\p{N}_]+")


def key_title(x: str) -> str:
    return f"lower({rx(x, K.KEY_TITLE_DROP)})"


def first_number(x: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract({x}, '\\d+(?:\\.\\d+)?'), '') AS DOUBLE), 0.0)"


def recency(x: str) -> str:
    ymd = f"replace(regexp_extract({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), '-', '')"
    return (f"CASE WHEN {ymd} <> '' THEN least(CAST({ymd} AS DOUBLE) / 21000000.0, 1.0) "
            f"WHEN regexp_matches({x}, '^\\d+$') THEN least(CAST({x} AS DOUBLE) / 2000000000.0, 1.0) ELSE 0.0 END")


def page_lines(x: str, breaks: bool = True, drop: str = "false") -> str:
    """List of text lines of a page, before the adjacent repeats go."""
    t = rx(rx(rx(x, r"(?is)<script[^>]*>.*?</script>"), r"(?is)<style[^>]*>.*?</style>"), r"(?s)<!--.*?-->")
    if breaks:
        t = rx(t, r"(?i)<br\s*/?>|</p>|</div>|</dd>", "\n")
    t = rx(t, "<[^>]+>")
    for a, b in K.ENTITIES:
        t = f"replace({t}, {lit(a)}, {lit(b)})"
    squeezed = strip(rx("l", "[ \\t　]+", " "))
    return f"list_filter([{squeezed} for l in string_split({t}, chr(10))], lambda l: l <> '' AND NOT ({drop}))"


def unescape(x: str) -> str:
    for a, b in K.ENTITIES:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


HEADING_SQL = r"^\S+( \S+){0,2}[.]$"  # the heading rule the fixture documents are split with


def ratio_ctes(pairs: str, name: str = "ratio") -> str:
    """CTEs (to follow WITH RECURSIVE) that add the matching ratio to the distinct texts (a, b) of `pairs`: the longest common part (the
    earliest in a, then in b) counts, then what is left of it in both texts, and what is right of it."""
    return f"""{name}_open AS (SELECT DISTINCT a, b, a AS x, b AS y, 0::BIGINT AS n FROM {pairs}
      UNION ALL SELECT a, b, unnest([substr(x, 1, i - 1), substr(x, i + l)]) AS x, unnest([substr(y, 1, j - 1), substr(y, j + l)]) AS y, unnest([l, 0]) AS n
      FROM (SELECT a, b, x, y, m.l AS l, -m.i AS i, strpos(y, substr(x, -m.i, m.l)) AS j FROM (
        SELECT a, b, x, y, list_max(flatten(list_transform(range(1, length(x) + 1), lambda l: list_transform(
          list_filter(range(1, length(x) - l + 2), lambda i: contains(y, substr(x, i, l))), lambda i: {{'l': l, 'i': -i}})))) AS m FROM {name}_open WHERE x <> '' AND y <> '')
        WHERE m IS NOT NULL)),
    {name} AS MATERIALIZED (SELECT a, b, 2.0::DOUBLE * sum(n) / (length(a) + length(b)) AS ratio FROM {name}_open GROUP BY a, b)"""
