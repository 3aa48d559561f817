"""Queries for aggregates and reports (group E)."""

from pyspark.sql import functions as F

from bookloom.operators import reports as R, segment as G
from bookloom.plans import sqltext as S
from bookloom.plans.registry import query
from bookloom.plans.text import CHAPTERS, PHRASES, STEPS


@query("e1_field_fill_rates", """SELECT count(*) FILTER (WHERE text <> '') || '/' || count(*) AS text,
    count(*) FILTER (WHERE contains(text, '@')) || '/' || count(*) AS author, count(*) FILTER (WHERE quality = 1) || '/' || count(*) AS tags
    FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").select(
        "text", F.when(F.col("text").contains("@"), "x").otherwise("").alias("author"),
        F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return R.field_fill_rates(d, ["text", "author", "tags"])


@query("e2_source_distribution", """SELECT source, count(*) AS rows, count(*) FILTER (WHERE lang = 'fr') AS hidden_titles FROM documents GROUP BY source""")
def _(t):
    return R.source_distribution(t.documents.select("source", F.when(F.col("lang") == "fr", "\ue000x").otherwise("x").alias("title")))


@query("e3_source_diagnostics", """WITH a AS (SELECT user_id AS query_id, concat('src', event_id % 4) AS source, event_type <> 'error' AS ok, event_id % 9 AS hits, props AS error,
    event_type = 'error' AS blocked, CAST(round(value * 100) AS BIGINT) AS ms, event_id FROM events)
    SELECT query_id, source, bool_or(ok) AS ok, CAST(sum(hits) AS BIGINT) AS hits, max_by(error, event_id) FILTER (WHERE NOT ok) AS error, bool_or(blocked) AS blocked, min(ms) AS ms FROM a GROUP BY ALL""")
def _(t):
    a = t.events.selectExpr("user_id AS query_id", "concat('src', event_id % 4) AS source", "event_type <> 'error' AS ok", "event_id % 9 AS hits",
                            "props AS error", "event_type = 'error' AS blocked", "CAST(round(value * 100) AS BIGINT) AS ms", "event_id AS at")
    return R.source_diagnostics(a, ["query_id", "source"])


@query("e6_chapter_stats", f"""WITH {CHAPTERS} SELECT doc_id, count(*) AS chapters, CAST(sum(length({S.rx('content', chr(92) + 's+')})) AS BIGINT) AS words,
    CAST(sum(CASE WHEN content = '' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM chapters GROUP BY doc_id""")
def _(t):
    return R.chapter_stats(G.split_chapters(t.documents, heading_regex=S.HEADING_SQL), "doc_id", failed=F.col("content") == "")


@query("e6_failed_chapters", f"WITH {CHAPTERS} SELECT doc_id, chapter_no, title FROM chapters WHERE content = ''")
def _(t):
    return R.failed_chapters(G.split_chapters(t.documents, heading_regex=S.HEADING_SQL), "doc_id", "chapter_no", "title", "content")


STATE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'cached' ELSE 'done' END"


@query("e7_failure_summary", f"""WITH s AS (SELECT user_id, ts, {STATE} AS state FROM events), a AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE state = 'done') AS done,
    count(*) FILTER (WHERE state = 'cached') AS cached, count(*) FILTER (WHERE state = 'failed') AS failed, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM s GROUP BY 1)
    SELECT user_id, total, done, cached, failed, CAST(floor((done + cached) * 100.0 / total) AS BIGINT) AS percent, round(done / greatest(us / 1e6, 0.001), 6) AS rate FROM a""")
def _(t):
    return R.failure_summary(t.events.select("user_id", "ts", F.expr(STATE).alias("state")), "user_id", "ts")


# an upload log per order customer: one file per order, the lines come from the order's lines
LOG_LINE = ("CASE WHEN l_linenumber % 7 = 1 AND l_orderkey % 3 = 0 THEN '<E> [12] rapidupload 31023' WHEN l_linenumber % 7 = 2 AND l_orderkey % 5 = 0 THEN '<E> broken pipe' "
            "WHEN l_linenumber = 3 THEN concat('a', CASE l_orderkey % 4 WHEN 0 THEN ' ==> ' WHEN 1 THEN ' =R=> ' WHEN 2 THEN ' =C=> ' ELSE ' >>==> ' END, CASE WHEN l_orderkey % 7 = 0 THEN 'FAILED.' ELSE 'OK.' END) "
            "WHEN l_linenumber = 4 THEN 'Remote file x already exists, skip uploading' WHEN l_linenumber = 1 THEN 'Local and remote file size matches' ELSE '<E> Failed to save settings' END")


@query("e8_transfer_report", f"""WITH l AS (SELECT o_custkey AS log_id, l_orderkey AS file_no, l_linenumber AS line_no, {LOG_LINE} AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    k AS (SELECT *, CASE WHEN contains(line, 'OK.') AND contains(line, '=R=>') THEN 'rapid' WHEN contains(line, 'OK.') AND contains(line, '==>') THEN 'uploaded' WHEN contains(line, 'OK.') AND contains(line, '=C=>') THEN 'copied'
      WHEN contains(line, 'size matches') THEN 'evidence' WHEN contains(line, 'skip uploading') THEN 'skipped' WHEN line LIKE '<E>%' THEN 'error' END AS kind FROM l),
    f AS (SELECT log_id, file_no, count(*) FILTER (WHERE kind = 'rapid') AS rapid, count(*) FILTER (WHERE kind = 'uploaded') AS up, count(*) FILTER (WHERE kind = 'copied') AS copied,
      count(*) FILTER (WHERE kind = 'skipped') AS skipped, count(*) FILTER (WHERE kind = 'evidence') AS ev FROM k GROUP BY ALL),
    g AS (SELECT log_id, CAST(sum(up + CASE WHEN ev > 0 AND rapid + up + copied = 0 THEN 1 ELSE 0 END) AS BIGINT) AS uploaded, CAST(sum(rapid) AS BIGINT) AS rapid, CAST(sum(copied) AS BIGINT) AS copied,
      CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(CASE WHEN ev > 0 AND rapid + up + copied = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fallback FROM f GROUP BY 1),
    e AS (SELECT *, line_no - row_number() OVER (PARTITION BY log_id, file_no ORDER BY line_no) AS b FROM k WHERE kind = 'error'),
    b AS (SELECT log_id, count(*) AS n, bool_or(contains(line, 'rapidupload') OR contains(line, '31023') OR contains(line, 'Failed to save settings')) AS warn FROM e GROUP BY log_id, file_no, b),
    x AS (SELECT log_id, CAST(sum(CASE WHEN warn THEN n ELSE 0 END) AS BIGINT) AS warnings, CAST(sum(CASE WHEN warn THEN 0 ELSE n END) AS BIGINT) AS failed FROM b GROUP BY 1)
    SELECT g.*, coalesce(warnings, 0) AS warnings, coalesce(failed, 0) AS failed, CASE WHEN coalesce(failed, 0) > 0 THEN 'errors' WHEN uploaded + rapid + copied <= 0 THEN 'nothing sent' ELSE 'ok' END AS verdict
    FROM g LEFT JOIN x USING (log_id)""")
def _(t):
    d = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return R.transfer_report(d.selectExpr("o_custkey AS log_id", "l_orderkey AS file_no", "l_linenumber AS line_no", f"{LOG_LINE} AS line"))


@query("e9_toc_tree_flatten", """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, CAST(r_regionkey AS BIGINT) AS ordinal, r_name AS label FROM region UNION ALL
      SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_name FROM customer),
    w AS (SELECT *, 0 AS depth, [ordinal] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.*, w.depth + 1, list_append(w.path, n.ordinal) FROM n JOIN w ON n.parent = w.node)
    SELECT node, label, depth, node IN (SELECT parent FROM n WHERE parent IS NOT NULL) AS has_children, row_number() OVER (ORDER BY path) AS position FROM w""")
def _(t):
    n = (t.region.selectExpr("concat('r', r_regionkey) AS node", "CAST(NULL AS STRING) AS parent", "CAST(r_regionkey AS BIGINT) AS ordinal", "r_name AS label")
         .unionByName(t.nation.selectExpr("concat('n', n_nationkey) AS node", "concat('r', n_regionkey) AS parent", "CAST(n_nationkey AS BIGINT) AS ordinal", "n_name AS label"))
         .unionByName(t.customer.selectExpr("concat('c', c_custkey) AS node", "concat('n', c_nationkey) AS parent", "CAST(c_custkey AS BIGINT) AS ordinal", "c_name AS label")))
    return R.toc_tree_flatten(n).select("node", "label", "depth", "has_children", "position")


@query("e10_seen_ledger", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 300")
def _(t):
    return R.seen_ledger(t.orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_orderkey")


@query("e11_rotate_check", f"SELECT {S.key_title('p_name')} AS key, count(*) AS picks FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return R.rotate_check(t.part, "p_name")


@query("e12_removed_audit", f"""WITH {STEPS}, a AS (SELECT doc_id, 'inline' AS kind, {S.lit(PHRASES[0])} AS rule, len(f1) AS n FROM l4 UNION ALL SELECT doc_id, 'inline', {S.lit(PHRASES[1])}, len(f2) FROM l4 UNION ALL
    SELECT doc_id, 'line', NULL, 1 FROM l4 WHERE len(f1) + len(f2) = 0 AND regexp_matches(s2, '^[（(]?\\s*[)）]?$'))
    SELECT doc_id % 7 AS day, kind, rule, CAST(sum(n) AS BIGINT) AS removed FROM a GROUP BY ALL HAVING sum(n) > 0""")
def _(t):
    return R.removed_audit(G.strip_ads(t.documents.select("doc_id", "text"), rules=PHRASES)[1], F.col("doc_id") % 7)


@query("e13_all_locked", "SELECT o_custkey AS book, count(*) AS chapters, count(*) >= 2 AND bool_and(o_orderstatus = 'F') AS all_locked FROM orders GROUP BY 1")
def _(t):
    d = t.orders.select(F.col("o_custkey").alias("book"), F.when(F.col("o_orderstatus") == "F", "locked").otherwise("full").alias("state"))
    return R.all_locked(d, ["book"])
