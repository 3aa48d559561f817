"""Queries for lookups and exclusions (group D)."""

from pyspark.sql import functions as F

from bookloom.operators import library, lookups as L
from bookloom.plans import sqltext as S
from bookloom.plans.registry import query


@query("d4_enrich_missing", """SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 AND l.doc_id IS NOT NULL AND l.quality = 1 THEN 'good' ELSE source END AS source,
    CASE WHEN d.doc_id % 2 = 0 AND l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE lang END AS tags FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t):
    rows = t.documents.select("doc_id", "source", F.array("lang").alias("tags"))
    detail = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("source"),
                             F.array(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("tags"))
    out = L.enrich_missing(rows, detail, "doc_id", ["source", "tags"], F.col("doc_id") % 2 == 0)
    return out.withColumn("tags", F.array_join("tags", ","))


@query("d5_exclude_seen", f"""SELECT p_partkey FROM part WHERE p_name <> '' AND CAST(p_partkey AS VARCHAR) NOT IN (SELECT CAST(s_suppkey * 3 AS VARCHAR) FROM supplier)
    AND {S.key_title('p_name')} NOT IN (SELECT {S.key_title("concat('《', p_name, '》')")} FROM part WHERE p_size = 7)
    AND {S.key_title('p_name')} NOT IN (SELECT {S.key_title('p_name')} FROM part WHERE p_size = 9)""")
def _(t):
    seen = t.supplier.select((F.col("s_suppkey") * 3).cast("string").alias("v")).unionByName(
        t.part.where("p_size = 9").select(F.col("p_name").alias("v")))
    lib = t.part.where("p_size = 7").select(F.concat(F.lit("《"), "p_name", F.lit("》")).alias("title"))
    return L.exclude_seen(t.part, seen, lib, "p_partkey", "p_name").select("p_partkey")


@query("d6_pending_items", "SELECT conv_id, turn FROM conversations WHERE NOT (role = 'user' AND length(text) > 0)")
def _(t):
    cache = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("payload"))
    return L.pending_items(t.conversations.select("conv_id", "turn"), cache, ["conv_id", "turn"], "payload")


FILES = "(SELECT doc_id AS pos, concat('book', doc_id % 300, CASE WHEN doc_id % 3 = 0 THEN '_1' ELSE '' END) AS file, octet_length(encode(text)) AS size, sha256(text) AS digest FROM documents)"


def files(t):
    name = F.concat(F.lit("book"), (F.col("doc_id") % 300).cast("string"), F.when(F.col("doc_id") % 3 == 0, "_1").otherwise(""))
    return library.with_fingerprint(t.documents.select(F.col("doc_id").alias("pos"), name.alias("file"), "text"), "text")


@query("d7_import_new", f"""WITH f AS (SELECT * FROM {FILES}), lib AS (SELECT size, digest, min(file) AS lib FROM f WHERE digest < '4' GROUP BY ALL),
    n AS (SELECT *, min(pos) OVER (PARTITION BY size, digest) AS fp, first(file) OVER (PARTITION BY size, digest ORDER BY pos) AS fn FROM f)
    SELECT pos, file, coalesce(lib, CASE WHEN pos <> fp THEN fn END) AS existing, CASE WHEN lib IS NOT NULL OR pos <> fp THEN 'skip' ELSE 'import' END AS action
    FROM n LEFT JOIN lib USING (size, digest)""")
def _(t):
    f = files(t)
    return library.import_new(f, f.where("digest < '4'")).select("pos", "file", "existing", "action")


@query("f3_dedup_by_content", f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY size, digest ORDER BY CASE WHEN regexp_matches(file, '_\\d+$') THEN 100000 ELSE 0 END + length(file), pos) AS n,
    first(file) OVER (PARTITION BY size, digest ORDER BY CASE WHEN regexp_matches(file, '_\\d+$') THEN 100000 ELSE 0 END + length(file), pos) AS k FROM {FILES})
    SELECT pos, file, CASE WHEN n > 1 THEN k END AS kept FROM f""")
def _(t):
    kept, removed = library.dedup_by_content(files(t), "file", "pos")
    return kept.select("pos", "file").withColumn("kept", F.lit(None).cast("string")).unionByName(removed.select("pos", "file", "kept"))


@query("d8_host_rule_join", """WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM pages), r(host, value) AS (
      VALUES ('example.com', 'A'), ('example.net', 'B'), ('m.example.net', 'C'), ('org', 'D'))
    SELECT page_id, coalesce((SELECT last(value ORDER BY length(host)) FROM r WHERE h = host OR h LIKE '%.' || host), '-') AS value FROM u""")
def _(t):
    rules = t.spark.createDataFrame([("example.com", "A"), ("example.net", "B"), ("m.example.net", "C"), ("org", "D")], "host string, value string")
    return L.host_rules(t.pages.select("page_id", "url"), rules, default="-").drop("url")


VOLS = """v AS (SELECT conv_id AS work_id, 'Title' || conv_id AS title, turn AS pos, CASE turn % 4 WHEN 0 THEN concat('Title', conv_id, ' ', turn + 1) WHEN 1 THEN concat('第 ', turn + 1, '.5 卷')
    WHEN 2 THEN concat(turn + 1, ' 特装版') ELSE concat('短篇集 ', turn) END AS name, concat('cov', conv_id, '-', turn) AS cover FROM conversations)"""


# every request asks for the volume of its own row in another spelling
@query("d9_volume_cover_match", """SELECT conv_id AS work_id, turn AS req_id, CASE turn % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS tier, concat('cov', conv_id, '-', turn) AS cover FROM conversations""")
def _(t):
    vols = t.conversations.selectExpr("conv_id AS work_id", "concat('Title', conv_id) AS title", "turn AS pos",
        "CASE turn % 4 WHEN 0 THEN concat('Title', conv_id, ' ', turn + 1) WHEN 1 THEN concat('第 ', turn + 1, '.5 卷') WHEN 2 THEN concat(turn + 1, ' 特装版') ELSE concat('短篇集 ', turn) END AS name",
        "concat('cov', conv_id, '-', turn) AS cover")
    want = t.conversations.selectExpr("conv_id AS work_id", "turn AS req_id", "concat('Title', conv_id) AS title",
        "CASE turn % 4 WHEN 0 THEN concat('第', turn + 1, '卷') WHEN 1 THEN concat('Title', conv_id, ' 第 ', turn + 1, '.5 卷') WHEN 2 THEN concat('第 ', turn + 1, ' 卷') ELSE concat('Title', conv_id, ' 短篇集', turn) END AS volume")
    return L.volume_cover_match(want, vols).select("work_id", "req_id", "tier", "cover")


@query("d10_patch_metadata", """WITH p AS (SELECT doc_id, last(CASE WHEN quality = 1 THEN 'good' END ORDER BY doc_id) AS source FROM labels GROUP BY doc_id)
    SELECT d.doc_id, coalesce(p.source, d.source) AS source, lang FROM documents d LEFT JOIN p USING (doc_id)""")
def _(t):
    patches = t.labels.select("doc_id", F.lit(2).alias("ord"), F.when(F.col("quality") == 1, "good").alias("source")).unionByName(
        t.labels.select("doc_id", F.lit(1).alias("ord"), F.lit("old").alias("source")))
    return library.patch_metadata(t.documents.select("doc_id", "source", "lang"), patches, "doc_id", ["source"])


@query("d11_delete_rows", "SELECT d.doc_id, 'left' AS status FROM documents d WHERE doc_id NOT IN (SELECT doc_id + 500 FROM labels) UNION ALL "
       "SELECT l.doc_id + 500, CASE WHEN d.doc_id IS NULL THEN 'failed' ELSE 'deleted' END FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 500")
def _(t):
    left, report = library.delete_rows(t.documents.select("doc_id"), t.labels.select((F.col("doc_id") + 500).alias("doc_id")), "doc_id")
    return left.withColumn("status", F.lit("left")).unionByName(report)


@query("d13_small_cover_upgrade", """WITH b AS (SELECT p_partkey AS query_id, p_name AS title, p_brand AS author, p_size * 5 AS px, 'b' || p_partkey AS cover FROM part),
    l AS (SELECT l_partkey AS query_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE '' END AS author,
      'c' || l_orderkey || '-' || l_linenumber AS cover, CAST(l_quantity AS INT) * 6 AS px FROM lineitem JOIN part ON p_partkey = l_partkey),
    n AS (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM l JOIN b USING (query_id) WHERE b.px < 200),
    a AS (SELECT query_id, max(CASE WHEN n = 1 THEN px END) AS p1, max(CASE WHEN n = 2 THEN px END) AS p2, max(CASE WHEN n = 3 THEN px END) AS p3,
      max(CASE WHEN n = 1 THEN cover END) AS c1, max(CASE WHEN n = 2 THEN cover END) AS c2, max(CASE WHEN n = 3 THEN cover END) AS c3 FROM n GROUP BY 1),
    s1 AS (SELECT b.query_id, b.px AS x0, b.cover AS y0, p2, p3, c2, c3, CASE WHEN b.px < 200 AND p1 > b.px THEN p1 ELSE b.px END AS x1, CASE WHEN b.px < 200 AND p1 > b.px THEN c1 ELSE b.cover END AS y1 FROM b LEFT JOIN a USING (query_id)),
    s2 AS (SELECT *, CASE WHEN x1 < 200 AND p2 > x1 THEN p2 ELSE x1 END AS x2, CASE WHEN x1 < 200 AND p2 > x1 THEN c2 ELSE y1 END AS y2 FROM s1)
    SELECT query_id, CAST(CASE WHEN x2 < 200 AND p3 > x2 THEN p3 ELSE x2 END AS INTEGER) AS px, CASE WHEN x2 < 200 AND p3 > x2 THEN c3 ELSE y2 END AS cover FROM s2""")
def _(t):
    best = t.part.selectExpr("p_partkey AS query_id", "p_name AS title", "p_brand AS author", "p_size * 5 AS px", "concat('b', p_partkey) AS cover")
    cands = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).selectExpr(
        "l_partkey AS query_id", "l_orderkey * 10 + l_linenumber AS pos", "p_name AS title", "CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE '' END AS author",
        "concat('c', l_orderkey, '-', l_linenumber) AS cover", "CAST(l_quantity AS INT) * 6 AS px")
    return library.small_cover_upgrade(best, cands).select("query_id", "px", "cover")


@query("d14_stitch_pages", """WITH p AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND turn >= 2 THEN turn + 2 ELSE turn + 1 END AS page, text FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS n FROM p)
    SELECT CAST(conv_id AS VARCHAR) AS chapter_id, CAST(count(*) AS INTEGER) AS pages, string_agg(text, chr(10) ORDER BY page) AS text FROM n WHERE n = page GROUP BY conv_id""")
def _(t):
    pages = t.conversations.selectExpr(
        "concat('https://x/novel/9/', conv_id, CASE WHEN turn = 0 THEN '' WHEN conv_id % 3 = 0 AND turn >= 2 THEN concat('_', turn + 2) "
        "ELSE concat('_', turn + 1) END, '.html') AS url", "text")
    return L.stitch_pages(pages)
