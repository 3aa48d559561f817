"""Queries for the stateful operators (group I). Streams run over the given tables to the end and are read back."""

from pyspark.sql import functions as F

from bookloom.operators import events as E, webpages as W
from bookloom.plans import sqltext as S
from bookloom.plans.registry import query
from bookloom.plans.sources import shared_folder
from bookloom.sources.files import is_folder
from bookloom.streaming import jobs as J
from bookloom.streaming.current import read_current

PROGRESS = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def stream(t, name):
    """The rows of a table, be it one file or a folder of files."""
    path, schema = f"{t.folder}/{name}.parquet", getattr(t, name).schema
    if is_folder(t.spark, path):
        return J.files_stream(t.spark, path, schema)
    return J.files_stream(t.spark, t.folder, schema, f"{name}.parquet")


@query("i1_progress_stream", PROGRESS)
def _(t):
    out, ck = shared_folder(t, "progress"), shared_folder(t, "ck")
    J.latest_stream(stream(t, "events"), "user_id", ["event_id"], ["event_type", "value"], out, ck, once=True).awaitTermination()
    return read_current(t.spark, out, ["user_id"])


#: rows of one stretch of the events that arrives before the next one; there are some in any case
STRETCH, STRETCHES = 5_000_000, 6


def arriving(t, rows, order, start):
    """The rows in several arrivals, one after the other in the order of a long column. Each arrival is a set of files that Spark writes in
    parallel, and the job goes on over it before the next one comes."""
    files = shared_folder(t, "arrivals")
    count = max(STRETCHES, rows.count() // STRETCH)
    edges = rows.approxQuantile(order, [i / count for i in range(1, count)], 0.001)
    place = F.coalesce(sum(((F.col(order) >= int(e)).cast("int") for e in edges), F.lit(0)), F.lit(0))
    for k in range(count):
        rows.where(place == k).write.mode("append").parquet(files)
        start(J.files_stream(t.spark, files, rows.schema, per_batch=1_000_000)).awaitTermination()


POSITION = "SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query("i2_latest_position_stream", POSITION)
def _(t):
    out, ck = shared_folder(t, "positions"), shared_folder(t, "ck")
    arriving(t, t.events.select("user_id", "ts", "event_id", "props"), "event_id", lambda feed: J.latest_stream(
        feed, "user_id", ["ts", "event_id"], ["props"], out, ck, once=True, ttl_ms=30 * 24 * 3600 * 1000))
    return read_current(t.spark, out, ["user_id"]).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "props")


@query("i2_latest_position", POSITION)
def _(t):
    d = E.latest_by_key(t.events, "user_id", ["ts", "event_id"], ["props"])
    return d.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "props")


BREAKER = """WITH n AS (SELECT user_id, event_type IN ('error', 'view') AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT *, b AND lag(b) OVER w AND lag(b, 2) OVER w AS hit FROM n WINDOW w AS (PARTITION BY user_id ORDER BY n))
    SELECT user_id, coalesce(bool_or(hit), false) AS tripped, min(n) FILTER (WHERE hit) AS tripped_at, coalesce(max(n), 0) - coalesce(max(n) FILTER (WHERE NOT b), 0) AS run FROM r GROUP BY 1"""


@query("i3_block_breaker", BREAKER)
def _(t):
    return E.block_breaker(t.events, "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type").isin("error", "view"))


@query("i3_block_breaker_stream", BREAKER)
def _(t):
    out, ck = shared_folder(t, "breaker"), shared_folder(t, "ck")
    rows = t.events.select("user_id", "ts", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    arriving(t, rows, "at", lambda feed: J.breaker_stream(
        feed, "user_id", [F.col("at"), F.col("event_id")], F.col("event_type").isin("error", "view"), out, ck, once=True))
    return read_current(t.spark, out, ["user_id"])


TTL_SQL = """WITH RECURSIVE s AS (SELECT user_id, ts, event_id FROM events), k AS (SELECT user_id, min(ts) AS ts FROM s GROUP BY 1 UNION ALL
      (SELECT k.user_id, min(s.ts) FROM k JOIN s ON s.user_id = k.user_id AND s.ts > k.ts + INTERVAL 7 DAY GROUP BY k.user_id))
    SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM k"""


@query("i4_ttl_dedup", TTL_SQL)
def _(t):
    d = E.ttl_dedup(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", F.expr("INTERVAL 7 DAYS"), "event_id")
    return d.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("i4_ttl_dedup_stream", TTL_SQL)
def _(t):
    out, ck = shared_folder(t, "dedup"), shared_folder(t, "ck")
    rows = t.events.select("user_id", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    arriving(t, rows, "at", lambda feed: J.dedup_stream(feed, "user_id", "ts", 7 * 24 * 3600 * 1_000_000, "event_id", out, ck, once=True))
    return t.spark.read.parquet(out).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


# an add in front for every event but errors; an error deletes the second bookmark
BOOKMARKS = """WITH RECURSIVE e AS (SELECT user_id, CAST(event_id AS VARCHAR) AS item, event_type = 'error' AS del, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    st AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::VARCHAR[] AS l FROM events UNION ALL
      SELECT st.user_id, e.n, CASE WHEN del THEN list_concat(l[1:1], l[3:]) ELSE list_prepend(item, l) END FROM st JOIN e ON e.user_id = st.user_id AND e.n = st.n + 1)
    SELECT user_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS place, unnest(l) AS item FROM st JOIN (SELECT user_id, max(n) AS n FROM st GROUP BY 1) USING (user_id, n)"""


def bookmark_events(t):
    return t.events.select("user_id", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("action"),
                           F.col("event_id").cast("string").alias("item"), F.when(F.col("event_type") == "error", F.lit(1)).cast("int").alias("ordinal"))


@query("i5_bookmark_fold", BOOKMARKS)
def _(t):
    return E.bookmark_fold(bookmark_events(t), "user_id", "event_id")


@query("i5_bookmark_fold_stream", BOOKMARKS)
def _(t):
    out, ck = shared_folder(t, "bookmarks"), shared_folder(t, "ck")
    arriving(t, bookmark_events(t), "event_id", lambda feed: J.bookmark_stream(feed, "user_id", "event_id", out, ck, once=True))
    return read_current(t.spark, out, ["user_id"]).select("user_id", F.posexplode("items").alias("place", "item"))


HEADING_TEXT = S.rx(S.unescape("regexp_extract(html, '<h1>(.*?)</h1>', 1)"), chr(92) + "s+", " ")


@query("i6_ingest_pages_stream", f"SELECT page_id, trim({HEADING_TEXT}) AS heading FROM pages")
def _(t):
    out, ck = shared_folder(t, "ingest"), shared_folder(t, "ck")
    J.ingest_stream(stream(t, "pages"), W.chapter_text, out, ck, once=True).awaitTermination()
    return t.spark.read.parquet(out).select("page_id", "heading")
