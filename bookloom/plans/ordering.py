"""Queries for order, duplicates, tiers, boards and recommendation (groups F and G9-G13)."""

import re

from pyspark.sql import functions as F

from bookloom.operators import boards as B, library, ordering as O, sections
from bookloom.plans import sqltext as S
from bookloom.plans.registry import query
from bookloom.plans.sources import shared_folder
from bookloom.session import cut_lineage


@query("f1_dedup_keep_first", "SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name")
def _(t):
    return O.dedup_keep_first(t.part.select("p_partkey", "p_name"), ["p_name"], [F.col("p_partkey")])


@query("f2_dedup_prefer", """SELECT p_name, first(p_partkey ORDER BY CASE WHEN p_size > 40 THEN 0 ELSE 1 END, p_partkey) AS p_partkey FROM part GROUP BY p_name""")
def _(t):
    return O.dedup_prefer(t.part.select("p_partkey", "p_name", "p_size"), ["p_name"], F.col("p_size") > 40, [F.col("p_partkey")]).drop("p_size")


PATHY = "CASE page_id % 2 WHEN 0 THEN upper(replace(url, '/', '\\')) ELSE url END"


@query("f4_dedup_by_path", r"""SELECT min(page_id) AS page_id FROM pages GROUP BY regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/]+')), '/+', '/', 'g')""")
def _(t):
    host = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    path = F.when(F.col("page_id") % 2 == 0, F.upper(F.translate(host, "/", "\\"))).otherwise(host)
    return O.dedup_by_path(t.pages.select("page_id", path.alias("path")), "path", [F.col("page_id")]).select("page_id")


@query("f5_assign_unique_names", """WITH p AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part),
    taken AS (SELECT p_name || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS name, p_name, n FROM (SELECT DISTINCT p_name FROM part), (SELECT unnest([0, 2, 3, 7]) AS n)),
    free AS (SELECT p_name, n, row_number() OVER (PARTITION BY p_name ORDER BY n) AS k FROM (SELECT DISTINCT p_name FROM part), (SELECT unnest(range(0, 20000)) AS n) WHERE n NOT IN (0, 2, 3, 7))
    SELECT p_partkey, p_name || '_' || n || '.epub' AS name FROM p JOIN free USING (p_name, k)""")
def _(t):
    rows = t.part.select("p_partkey", F.col("p_name").alias("base"), F.lit(".epub").alias("ext"))
    n = t.part.select("p_name").distinct().withColumn("n", F.explode(F.array(*[F.lit(i) for i in (0, 2, 3, 7)])))
    taken = n.select(F.concat("p_name", F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), F.lit(".epub")).alias("name"))
    return library.assign_unique_names(rows, "base", "ext", [F.col("p_partkey")], taken).select("p_partkey", "name")


@query("f6_split_tiers", """SELECT p_partkey, CASE WHEN row_number() OVER w <= greatest(1, count(*) OVER (PARTITION BY p_type) // 2) THEN 'hot' ELSE 'new' END AS tier
    FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_size DESC, p_partkey)""")
def _(t):
    return O.split_tiers(t.part.select("p_partkey", "p_type", "p_size"), ["p_type"], [F.col("p_size").desc(), F.col("p_partkey")]).select("p_partkey", "tier")


BOARD = "CASE l_suppkey % 2 WHEN 0 THEN 'newhot' ELSE 'monthvisit' END"


@query("f7_board_merge", f"""WITH b AS (SELECT {BOARD} AS board, CAST(l_suppkey // 2 AS VARCHAR) || '-' || l_partkey AS book, l_linenumber AS page, l_orderkey AS pos FROM lineitem),
    f AS (SELECT *, row_number() OVER (PARTITION BY board, book ORDER BY page, pos) AS n FROM b)
    SELECT board, book, page, row_number() OVER (PARTITION BY board ORDER BY page, pos, book) AS rank_pos FROM f WHERE n = 1""")
def _(t):
    b = t.lineitem.selectExpr(f"{BOARD} AS board", "concat(CAST(floor(l_suppkey / 2) AS BIGINT), '-', l_partkey) AS book", "l_linenumber AS page", "l_orderkey AS pos")
    return O.board_merge(b, "board", "page", "pos", "book").select("board", "book", "page", "rank_pos")


@query("f8_page_slice", """SELECT p_partkey, p_type, n FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n > 30 AND n <= 60""")
def _(t):
    return O.page_slice(t.part.select("p_partkey", "p_type", "p_size"), ["p_type"], [F.col("p_size").desc(), F.col("p_partkey")], 2).drop("p_size")


@query("f9_newest_n", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def _(t):
    return O.newest_n(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 25, [F.col("o_orderkey")],
                      F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("f10_recent_urls", "SELECT props AS url, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 20")
def _(t):
    return O.recent_urls(t.events, "props", "ts").select(F.col("props").alias("url"), F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"))


@query("f11_stable_path_order", "SELECT url, page_id FROM pages ORDER BY url")
def _(t):
    return O.stable_path_order(t.pages.select("url", "page_id"), "url")


@query("f12_union_sources", "SELECT p_partkey AS id, p_name AS title, p_brand AS author, NULL AS tags, 'part' AS loader FROM part UNION ALL SELECT doc_id, source, NULL, lang, 'documents' FROM documents")
def _(t):
    pool, _notes = O.union_sources(t.spark, {
        "part": lambda: t.part.selectExpr("p_partkey AS id", "p_name AS title", "p_brand AS author"),
        "gone": lambda: t.no_such_table,
        "documents": lambda: t.documents.selectExpr("doc_id AS id", "source AS title", "lang AS tags")})
    return pool


# --- the rank pool: every part is a book of one of five sources ------------------------------------------------
POOL_COLS = {
    "title": "p_name", "author": "p_brand", "source": S.POOL_SOURCE, "free": "p_partkey % 4 = 0",
    "max_free_chapter": "CASE WHEN p_partkey % 6 = 1 THEN concat(p_size, ' ch') END", "rating": "CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size * 20 AS {s}) END",
    "rating_count": "CAST(p_partkey % 400 AS {s})", "read_count": "concat(CAST(p_size * 1000 + p_partkey AS {s}), '读')", "publish_time": "CASE WHEN p_partkey % 2 = 0 THEN '2026-08-01 00:00:00' ELSE '1700000000' END",
    "ispub": "CASE WHEN p_partkey % 10 = 0 THEN 1 END", "book_id": "CAST(p_partkey AS {s})", "pos": "p_partkey", "type": "p_type", "brand": "p_brand",
}


def pool(t):
    p = t.part.selectExpr(*[f"{e.format(s='STRING')} AS {c}" for c, e in POOL_COLS.items()])
    p = p.withColumn("tags", F.when(F.col("pos") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("type", "brand")))
    return B.mark_tiers(p.withColumn("tier", F.lit(None).cast("string")))


POOL = f"""p0 AS (SELECT {', '.join(f"{e.format(s='VARCHAR')} AS {c}" for c, e in POOL_COLS.items())}, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type || ' ' || p_brand END AS tags FROM part),
    pool AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {S.first_number('read_count')} DESC, pos) <= greatest(1, count(*) OVER (PARTITION BY source) // 2) THEN 'hot' ELSE 'new' END AS tier FROM p0),
    sc AS MATERIALIZED (SELECT *, CASE WHEN coalesce(free, false) OR {S.first_number('max_free_chapter')} > 0 THEN 3.0::DOUBLE ELSE 0.0 END + least({S.first_number('rating')} / 1000.0, 1.0) * 2.0 + least({S.first_number('rating_count')} / 300.0, 1.0)
      + least({S.first_number('read_count')} / 100000.0, 1.0) + {S.recency('publish_time')} AS pick_score,
      CASE WHEN starts_with(source, '起点·') THEN CASE WHEN tier = 'hot' THEN '男频起点大火' ELSE '男频起点新作' END WHEN starts_with(source, '晋江·') THEN CASE WHEN tier = 'hot' THEN '女频晋江大火' ELSE '女频晋江新作' END
      WHEN contains(source, 'gender=0') THEN '女频番茄' WHEN contains(source, 'gender=1') THEN '男频番茄' WHEN coalesce(ispub, 0) = 1 OR tags = '' THEN '正经书' ELSE '出版' END AS bucket FROM pool)"""


@query("f6_mark_tiers", f"WITH {POOL} SELECT pos, source, tier FROM pool")
def _(t):
    return pool(t).select("pos", "source", "tier")


@query("g9_pool_score", f"WITH {POOL} SELECT pos, round(pick_score, 6) AS pick_score FROM sc")
def _(t):
    return pool(t).select("pos", F.round(B.pool_score(), 6).alias("pick_score"))


@query("g10_bucket", f"WITH {POOL} SELECT pos, bucket FROM sc")
def _(t):
    return pool(t).select("pos", B.bucket().alias("bucket"))


@query("g11_pick_rotation", f"""WITH {POOL}, r AS (SELECT pos, bucket, row_number() OVER (PARTITION BY bucket ORDER BY pick_score DESC, pos) - 1 AS k, count(*) OVER (PARTITION BY bucket) AS n FROM sc)
    SELECT pos, bucket, ((k - 51) % n + n) % n AS turn FROM r""")
def _(t):
    return B.rotated(pool(t), 3).select("pos", "bucket", "turn")


def request_lists(t):
    library_ = t.part.where("p_size = 50").select(F.col("p_name").alias("title"))
    seen = t.supplier.select(F.col("s_suppkey").cast("string").alias("id"))
    return library_, seen


def pick_sql(title, batch, n=14, tag="", library="p_size = 50", more=""):
    """The greedy as a walk over all visits: quota pass in bucket order, then fill pass; one recursion step per visit. `tag` makes the
    names of the parts differ where several walks stand in one statement, `more` is a query of further seen ids."""
    seats = B.quotas(n)
    plan = ", ".join(f"('{b}', {i}, {seats[b]})" for i, b in enumerate(("正经书", "男频起点大火", "男频起点新作", "男频番茄", "女频晋江大火", "女频晋江新作"), 1))
    parts = _walk(title, batch, n, library, more, plan)
    return POOL + ", " + (re.sub(r"\b(lib|seen|cand|fit|r0|r|plan|fill|visits|st|picked)\b", lambda m: m[0] + tag, parts) if tag else parts)


def _walk(title, batch, n, library, more, plan):
    return f"""lib AS (SELECT DISTINCT {S.key_title('p_name')} AS k FROM part WHERE {library}), seen AS (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier{more}),
    cand AS (SELECT *, {title} AS shown FROM sc WHERE title <> '' AND book_id NOT IN (SELECT k FROM seen)),
    fit AS (SELECT * FROM cand WHERE {S.key_title('shown')} NOT IN (SELECT k FROM lib) AND {S.key_title('shown')} NOT IN (SELECT k FROM seen)),
    r0 AS (SELECT *, split_part(tags, ' ', 1) AS tag, row_number() OVER (PARTITION BY bucket ORDER BY pick_score DESC, pos) - 1 AS k, count(*) OVER (PARTITION BY bucket) AS n FROM fit),
    r AS (SELECT *, ((k - {batch * 17}) % n + n) % n AS turn FROM r0),
    plan(bucket, ord, seats) AS (VALUES {plan}),
    fill(bucket, ord, seats) AS (VALUES ('正经书', 11, 99), ('男频起点大火', 12, 99), ('男频起点新作', 13, 99), ('女频晋江大火', 14, 99), ('女频晋江新作', 15, 99), ('出版', 16, 99), ('女频番茄', 17, 99)),
    visits AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ord, turn) AS v, * FROM (SELECT ord, seats, turn, pos, tag, source FROM r JOIN plan USING (bucket) UNION ALL SELECT ord, seats, turn, pos, tag, source FROM r JOIN fill USING (bucket))),
    st AS (SELECT 0::BIGINT AS v, []::BIGINT[] AS ids, []::VARCHAR[] AS tags, []::VARCHAR[] AS sources, 0 AS got, 0 AS cur UNION ALL
      SELECT v, CASE WHEN take THEN list_append(ids, pos) ELSE ids END, CASE WHEN take THEN list_append(tags, tag) ELSE tags END, CASE WHEN take THEN list_append(sources, source) ELSE sources END,
        CASE WHEN take THEN g + 1 ELSE g END, ord FROM (SELECT *, len(ids) < {n} AND g < seats AND NOT list_contains(ids, pos) AND (tag = '' OR len(list_filter(tags, lambda x: x = tag)) < 2)
        AND len(list_filter(sources, lambda x: x = source)) < 6 AS take FROM (SELECT x.v, x.ord, x.seats, x.pos, x.tag, x.source, st.ids, st.tags, st.sources, CASE WHEN st.cur = x.ord THEN st.got ELSE 0 END AS g
        FROM st JOIN visits x ON x.v = st.v + 1))),
    picked AS (SELECT unnest(ids) AS pos, generate_subscripts(ids, 1) AS seat FROM st WHERE v = (SELECT max(v) FROM visits))"""


@query("g11_pick", f"WITH RECURSIVE {pick_sql('title', 2)} SELECT seat, pos, title, source, bucket FROM picked JOIN sc USING (pos)")
def _(t):
    lib, seen = request_lists(t)
    return B.pick(pool(t), lib, seen, n=14, batch=2).select("seat", "pos", "title", "source", "bucket")


@query("g12_recommend", f"""WITH RECURSIVE {pick_sql("CASE WHEN pos % 3 = 0 THEN chr(57345) || title ELSE title END", 1)}
    SELECT seat, pos, title, author, CASE WHEN pos % 3 = 0 THEN type ELSE '' END AS intro FROM picked JOIN sc USING (pos)""")
def _(t):
    lib, seen = request_lists(t)
    p = pool(t).withColumn("title", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("\ue001"), "title")).otherwise(F.col("title"))).withColumn("intro", F.lit(""))
    detail = t.part.select(F.col("p_partkey").cast("string").alias("book_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
                           F.array("p_type").alias("tags"), F.col("p_type").alias("intro"))
    return B.recommend(p, lib, seen, detail, n=14, batch=1).select("seat", "pos", "title", "author", "intro")


# several requests in one job, each with its own library, batch and number of seats
REQUESTS = ((1, 10, 1, "p_size = 50"), (2, 14, 2, "p_name LIKE 'b%'"), (3, 23, 7, "p_partkey % 97 = 3"))


def request_tables(t):
    asked = t.spark.createDataFrame([r[:3] for r in REQUESTS], "request long, n long, batch long")
    own = [t.part.where(cond).select(F.lit(r).cast("long").alias("request"), F.col("p_name").alias("title")) for r, _, _, cond in REQUESTS]
    seen = t.supplier.select(F.explode(F.array(*[F.lit(r[0]).cast("long") for r in REQUESTS])).alias("request"), F.col("s_suppkey").cast("string").alias("id"))
    return asked, own[0].union(own[1]).union(own[2]), seen


def requests_sql():
    walks = [pick_sql("title", batch, n, f"_{r}", library) for r, n, batch, library in REQUESTS]
    every = " UNION ALL ".join(f"SELECT {r}::BIGINT AS request, seat, pos, title, source, bucket FROM picked_{r} JOIN sc USING (pos)" for r, *_ in REQUESTS)
    return f"WITH RECURSIVE {POOL}, " + ", ".join(w.removeprefix(POOL + ", ") for w in walks) + " " + every


@query("g11_pick_requests", requests_sql())
def _(t):
    return B.pick_requests(pool(t), *request_tables(t)).select("request", "seat", "pos", "title", "source", "bucket")


def batches_sql():
    """Three batches in a row; what the earlier ones picked is seen by the later ones."""
    walks, more = [], ""
    for k in (1, 2, 3):
        walks.append(pick_sql("title", k, 12, f"_{k}", more=more).removeprefix(POOL + ", "))
        more += f" UNION ALL SELECT CAST(pos AS VARCHAR) FROM picked_{k}"
    every = " UNION ALL ".join(f"SELECT {k}::BIGINT AS batch, seat, pos, title FROM picked_{k} JOIN sc USING (pos)" for k in (1, 2, 3))
    return f"WITH RECURSIVE {POOL}, " + ", ".join(walks) + " " + every


@query("g12_recommend_batches", batches_sql())
def _(t):
    lib, seen = (d.select(F.lit(1).cast("long").alias("request"), F.col(d.columns[0]).alias(n)) for d, n in zip(request_lists(t), ("title", "id"), strict=True))
    asked = t.spark.range(1, 2).select(F.col("id").alias("request"), F.lit(12).cast("long").alias("n"))
    detail = t.part.select(F.col("p_partkey").cast("string").alias("book_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
                           F.array("p_type").alias("tags"), F.col("p_type").alias("intro"))
    ledger, books = shared_folder(t, "ledger"), cut_lineage(pool(t).withColumn("intro", F.lit("")))
    out = [B.recommend_next(books, asked, lib, seen, detail, ledger, k).withColumn("batch", F.lit(k).cast("long")) for k in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("batch", "seat", "pos", "title")


@query("g13_full_text_search", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
    h AS (SELECT *, strpos(lower(line), 'tion') AS place FROM l WHERE contains(lower(line), 'tion'))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(place AS INTEGER) AS place, substr(line, greatest(place - 20, 1), CAST(place - greatest(place - 20, 1) + 24 AS BIGINT)) AS excerpt,
    CAST(row_number() OVER w AS INTEGER) AS ordinal, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def _(t):
    return sections.full_text_search(t.documents, "TION")


@query("b35_category_ids", """SELECT DISTINCT id FROM (SELECT regexp_extract(props, '"k": (\\d+)', 1) AS id FROM events UNION ALL
    SELECT unnest(regexp_extract_all(url, '/(\\d{1,8})\\b', 1)) FROM pages) WHERE id <> ''""")
def _(t):
    nested = t.events.select(F.array(F.struct(F.get_json_object("props", "$.k").alias("categoryId"))).alias("categories"))
    return sections.category_ids(nested, "categories", t.pages, "url", (r"/(\d{1,8})\b",))
