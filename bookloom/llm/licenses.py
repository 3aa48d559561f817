"""Licence scan: canonical digests of entire texts looked up in a table of known licences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookloom.llm.digests import DIGESTS
from bookloom.llm.notices import BSD, KNOWN

#: steps of the canonical form, in order. A notice is told by a (c), a sign or a year, and goes to the end of its line; a line of
#: running text that only begins with the word stays
COPYRIGHT_LINE = (r"(?m)^[ \t]*((copyright[ \t:,]*(\(c\)|©|[\[{<]?(\d{4}|yyyy|year)\b)|\(c\)[ \t]*(copyright\b|\d{4})|©)[^\n]*"
                  r"|all rights reserved[ \t.!]*)$")
#: notices that belong to licence texts themselves, wherever the lines are broken
OWN_NOTICE = (r"copyright\s+(\(c\)\s+(\d{4},\s*)*\d{4}\s+free\s+software\s+foundation,\s+inc\.,?(\s+<https?://(www\.)?fsf\.org/>)?"
              r"|(\(c\)\s+)?[\[{<]?(yyyy|year|19yy|19xx)[\]}>]?\s+[\[{<]?(name\s+of\s+(copyright\s+owner|author)|your\s+name)[\]}>]?)")
SPELLINGS = (  # equivalent spellings, applied in order to lower-cased text
    ("licence", "license"), ("sub license", "sublicense"), ("sub-license", "sublicense"), ("non commercial", "noncommercial"),
    ("non-commercial", "noncommercial"), ("noninfringement", "non infringement"), ("organisation", "organization"), ("favour", "favor"),
    ("merchantibility", "merchantability"), ("whilst", "while"), ("https://", ""), ("http://", ""), ("&", " and "))
PERCENT = (r"\bper cent\b", "percent")
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a table of known licences is sent to all tasks up to this many entries; a larger one is shuffled
SENT_ENTRIES = 100_000


def canonical(text: Column) -> Column:
    """Lower case (A-Z), without copyright notices, in one spelling, with one blank for all punctuation and white space.

    A pattern is only tried where the text has the words without which it cannot match; such a test costs far less than the pattern.
    """
    def once(c: Column, step) -> Column:
        """step(c), with c computed once however often the step names it."""
        return F.get(F.transform(F.array(c), step), F.lit(0))

    def where(c: Column, words: tuple[str, ...], pattern: str, into: str) -> Column:
        return once(c, lambda x: F.when(reduce(lambda a, b: a | b, [x.contains(w) for w in words]), F.regexp_replace(x, pattern, into)).otherwise(x))

    c = where(F.translate(text, UPPER, LOWER), ("copyright",), OWN_NOTICE, " ")
    c = where(c, ("copyright", "(c)", "©", "all rights reserved"), COPYRIGHT_LINE, " ")
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(where(c, ("per cent",), *PERCENT), PUNCTUATION, " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null for a text without words."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_licenses(spark: SparkSession, entries=KNOWN + BSD, digests=DIGESTS) -> DataFrame:
    """(license_id, digest) of known licence texts and notices; a digest of several entries keeps the first id.

    Long texts are known by their digests alone, of the canonical form above.
    """
    df = spark.createDataFrame(list(entries), "license_id string, body string")
    long = spark.createDataFrame(list(digests), "license_id string, digest string")
    return df.select("license_id", digest(F.col("body")).alias("digest")).where("digest is not null").union(long) \
        .groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _sent(known: DataFrame) -> DataFrame:
    return F.broadcast(known) if known.limit(SENT_ENTRIES + 1).count() <= SENT_ENTRIES else known


def license_scan(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Add `digest` and `license_id` of each entire text, null where it is no known licence.

    A null text and one without words have no digest and no licence; repeated rows each get their result. No row is lost;
    other columns are kept, a column with the name of an added one is replaced.
    """
    base = texts.drop("digest", "license_id").withColumn("digest", digest(F.col(text)))
    return base.join(_sent(known.select("digest", "license_id")), "digest", "left") \
        .select(*base.columns, "license_id")


def license_lines(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, license_id): the lines, from 1, of each document that are, as entire texts, a known licence or notice."""
    # digests are made before the lines become rows, so that no later filter or join makes them again
    digests = F.transform(F.split(F.col(text), "\n"), lambda line: digest(line))
    lines = docs.select(F.col(key).alias(key), F.posexplode(digests).alias("line", "digest")).where("digest is not null")
    return lines.join(_sent(known.select("digest", "license_id")), "digest") \
        .select(key, (F.col("line") + 1).alias("line"), "license_id")


def op1_license_scan(spark, folder: str) -> DataFrame:
    """Per document: digest and licence of the whole text, and the notices that stand as lines of it. Rows that share a
    doc_id share their lines."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    known = known_licenses(spark)
    lines = license_lines(docs, known).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_notices"), F.sort_array(F.collect_set("license_id")).alias("_ids"))  # as many ids as are known
    whole = license_scan(docs, known).drop("text")
    at = lines.withColumnRenamed("doc_id", "_d")
    return whole.join(at, F.col("doc_id").eqNullSafe(F.col("_d")), "left").select(
        "doc_id", "digest", "license_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce(F.concat_ws(",", "_ids"), F.lit("")).alias("notices"))


def _sql_canonical(c: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({c}, '{UPPER}', '{LOWER}')"
    for pattern in (OWN_NOTICE, COPYRIGHT_LINE):
        out = f"regexp_replace({out}, {quoted(pattern)}, ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    out = f"regexp_replace({out}, {quoted(PERCENT[0])}, {quoted(PERCENT[1])}, 'g')"
    return f"trim(regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g'))"


def _op1_sql() -> str:
    values = ",\n".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN + BSD)
    long = ",\n".join(f"('{i}', '{x}')" for i, x in DIGESTS)
    d = lambda c: f"sha256(nullif({_sql_canonical(c)}, ''))"
    return f"""
WITH k AS (SELECT min(i) AS license_id, d AS digest FROM (
  SELECT i, {d('t')} AS d FROM (VALUES {values}) AS v(i, t)
    UNION ALL SELECT i, d FROM (VALUES {long}) AS v(i, d)) WHERE d IS NOT NULL GROUP BY d),
l AS (SELECT doc_id, {d('line')} AS digest FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices
      FROM l JOIN k USING (digest) GROUP BY doc_id),
w AS (SELECT doc_id, {d('text')} AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license_id, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN k USING (digest) LEFT JOIN n ON w.doc_id IS NOT DISTINCT FROM n.doc_id
"""


OP1_SQL = _op1_sql()
