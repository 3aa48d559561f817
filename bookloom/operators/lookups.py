"""Left lookups, exclusions and keyed matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bookloom.functions.text import key_title, nonempty, strip, trim_chars
from bookloom.operators.scale import first_rows, ranked, salted_join


def enrich_missing(rows: DataFrame, detail: DataFrame, on: str, fields: Sequence[str], flag: Column) -> DataFrame:
    """Flagged rows take the non-empty fields of their detail row; all other rows never meet the join."""
    d = detail.select(on, *[F.col(f).alias(f"_d_{f}") for f in fields])
    kinds = dict(rows.dtypes)

    def filled(f: str) -> Column:
        got = F.when(F.size(f"_d_{f}") > 0, F.col(f"_d_{f}")) if kinds[f].startswith("array") else nonempty(F.col(f"_d_{f}"))
        return F.coalesce(got, F.col(f)).alias(f)
    need = F.coalesce(flag, F.lit(False))
    done = rows.where(need).join(d, on, "left").select(*[filled(c) if c in fields else F.col(c) for c in rows.columns])
    return rows.where(~need).unionByName(done)


def exclude_seen(pool: DataFrame, seen: DataFrame, library: DataFrame, id_col: str = "book_id", title: str = "title") -> DataFrame:
    """Drop rows without a title, with a seen id, with a seen title key, or with a title key in the library.
    seen and library have one text column each; seen entries may be ids or titles."""
    s = seen.select(F.col(seen.columns[0]).cast("string").alias("_v"))
    keys = s.select(key_title("_v").alias("_key")).unionByName(library.select(key_title(library.columns[0]).alias("_key"))).distinct()
    d = pool.where(F.coalesce(F.col(title), F.lit("")) != "").withColumn("_key", key_title(title)).withColumn(
        "_v", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    left = salted_join(d, s.distinct(), ["_v"], "left_anti")
    return salted_join(left, keys, ["_key"], "left_anti", hot_from=d).drop("_key", "_v")


def pending_items(toc: DataFrame, cache: DataFrame, on: Sequence[str], payload: str) -> DataFrame:
    """Items whose cached payload is missing or empty."""
    done = cache.where(F.length(F.coalesce(payload, F.lit(""))) > 0).select(*on).distinct()
    return toc.join(done, list(on), "left_anti")


def host_rules(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "") -> DataFrame:
    """The value of the longest rule host that is the url's host or a parent domain of it. Rules: (host, value).
    Hosts are matched once each; the rows then look their host up."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    d = urls.withColumn("_host", host)
    labels = F.split("_host", r"\.")
    hosts = d.select("_host").distinct().withColumn("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hit = hosts.join(rules, "host").groupBy("_host").agg(F.max_by("value", F.length("host")).alias("value"))
    return salted_join(d, hit, ["_host"], "left").withColumn("value", F.coalesce("value", F.lit(default))).drop("_host")


def _volume_rest(raw: Column, title: Column) -> Column:
    tail = trim_chars(F.substring(raw, F.length(title) + 1, F.length(raw)), " -_·|/　")
    short = F.when((title != "") & raw.startswith(title), tail).otherwise(raw)
    return strip(F.regexp_replace(short, r"^第\s*", ""))


def _number_text(n: Column) -> Column:
    return F.regexp_replace(n.cast("double").cast("string"), r"\.0$", "")


def volume_cover_match(wanted: DataFrame, volumes: DataFrame, on: str = "work_id", req: str = "req_id") -> DataFrame:
    """Cover of the asked volume: equal number, else the number standing alone in the name; for named volumes the equal
    name without blanks, else the longest containment of at least two characters.

    wanted (work, request, volume, title), volumes (work, title, pos, name, cover). Every rule is an equi-join on a derived
    key, so a work with many volumes and many requests never pairs all of them.
    """
    raw = strip(F.coalesce("volume", F.lit("")))
    title = F.coalesce("title", F.lit(""))
    num = F.coalesce(nonempty(F.regexp_extract(raw, r"([0-9]+(?:\.[0-9]+)?)\s*[部卷册季集]", 1)),
                     nonempty(F.regexp_extract(raw, r"第\s*([0-9]+(?:\.[0-9]+)?)", 1)))
    w = wanted.select(on, req, _number_text(num).alias("_num"),
                      F.regexp_replace(_volume_rest(raw, title), r"\s+", "").alias("_txt"))
    v = volumes.where(F.coalesce("cover", F.lit("")) != "").select(
        on, "pos", "cover", _volume_rest(F.trim(F.coalesce("name", F.lit(""))), title).alias("_s"))
    v = v.withColumn("_k", F.regexp_replace("_s", r"\s+", ""))
    keys = [on]
    numbered, named = w.where(F.col("_num").isNotNull()), w.where(F.col("_num").isNull() & (F.col("_txt") != ""))
    alone = r"^([0-9]+(?:\.[0-9]+)?)\s*[部卷册季集]?$"
    exact = v.withColumn("_num", _number_text(nonempty(F.regexp_extract("_s", alone, 1))))
    inside = v.withColumn("_num", F.explode(F.array_distinct(F.regexp_extract_all(
        "_s", F.lit(r"(?<![0-9.])[0-9]+(?:\.[0-9]+)?(?![0-9.])"), F.lit(0)))))

    def parts(c: str) -> Column:
        n = F.length(c)
        cut = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda m: F.transform(
            F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda p: F.substring(c, p, m))))
        return F.explode(F.array_distinct(F.filter(cut, lambda x: F.length(x) >= 2)))
    size = F.length("_k").alias("_len")
    cols = lambda tier, length: [on, req, "pos", "cover", F.lit(tier).alias("tier"), length]
    none = F.lit(0).alias("_len")
    hits = [numbered.join(exact, keys + ["_num"]).select(*cols(1, none)),
            numbered.join(inside, keys + ["_num"]).select(*cols(2, none)),
            named.join(v.withColumn("_txt", F.col("_k")), keys + ["_txt"]).select(*cols(3, none)),
            named.withColumn("_k", parts("_txt")).join(v, keys + ["_k"]).select(*cols(4, size)),
            named.join(v.withColumn("_txt", parts("_k")), keys + ["_txt"]).select(*cols(4, size))]
    return first_rows(reduce(DataFrame.unionByName, hits), [on, req], [F.col("tier"), F.col("_len").desc(), F.col("pos")]).drop("_len")


def page_runs(pages: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """(chapter_id, page, text): the pages x.html, x_2.html, ... of each chapter up to the first missing one, a row per page. Of pages
    that occur twice the smaller text counts. A chapter may have any number of pages: they are numbered across partitions."""
    name = r"/(\d+)(?:_(\d+))?\.html"
    d = pages.select(F.regexp_extract(url, name, 1).alias("chapter_id"),
                     F.coalesce(nonempty(F.regexp_extract(url, name, 2)).try_cast("int"), F.lit(1)).alias("page"), F.col(text).alias("text"))
    one = d.where((F.col("chapter_id") != "") & (F.col("page") >= 1)).groupBy("chapter_id", "page").agg(F.min("text").alias("text"))
    # pages are different numbers from 1 on, so the n-th one is n exactly up to the first gap
    return ranked(one, ["chapter_id"], [F.col("page")], "_n").where(F.col("page") == F.col("_n")).drop("_n")


def stitch_pages(pages: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """(chapter_id, pages, text): page_runs put together, for chapters that fit in a row."""
    c = page_runs(pages, url, text).groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return c.select("chapter_id", F.size("p").alias("pages"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
