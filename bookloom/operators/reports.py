"""Aggregates and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bookloom import constants as K
from bookloom.functions.text import has_pua, key_title
from bookloom.operators.scale import ranked
from bookloom.session import cut_lineage


def field_fill_rates(pool: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: filled/total per field, as text."""
    kinds = dict(pool.dtypes)

    def filled(c: str) -> Column:
        return F.coalesce(F.size(c) > 0 if kinds[c].startswith("array") else F.col(c).cast("string") != "", F.lit(False))
    return pool.agg(*[F.concat(F.coalesce(F.sum(filled(c).cast("long")), F.lit(0)).cast("string"), F.lit("/"),
                               F.count(F.lit(1)).cast("string")).alias(c) for c in fields])


def source_distribution(pool: DataFrame, source: str = "source", title: str = "title") -> DataFrame:
    return pool.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.sum(has_pua(title).cast("long")).alias("hidden_titles"))


def source_diagnostics(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: ok, hits, the error of the last failed attempt, blocked, fastest ms; good ones first, then by ms."""
    d = attempts.groupBy(*keys).agg(
        F.bool_or("ok").alias("ok"), F.sum("hits").alias("hits"), F.max_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.col("at"))).alias("error"),
        F.bool_or("blocked").alias("blocked"), F.min("ms").alias("ms"))
    return d.orderBy(*[k for k in keys[:-1]], F.col("ok").desc(), "ms")


def chapter_stats(chapters: DataFrame, book: str, content: str = "content", images: str | None = None, failed: Column | None = None) -> DataFrame:
    """Chapters, words (non-blank characters), images and failed chapters per book."""
    words = F.length(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)\s+", "")).cast("long")
    aggs = [F.count(F.lit(1)).alias("chapters"), F.sum(words).alias("words")]
    if images:
        aggs.append(F.sum(images).alias("images"))
    if failed is not None:
        aggs.append(F.sum(failed.cast("long")).alias("failed"))
    return chapters.groupBy(book).agg(*aggs)


def failed_chapters(chapters: DataFrame, book: str, pos: str, name: str, content: str) -> DataFrame:
    """(book, pos, name) of the chapters without content; a table, so a book may fail completely."""
    return chapters.where(F.trim(F.coalesce(content, F.lit(""))) == "").select(book, pos, name)


def failure_summary(items: DataFrame, job: str, ts: str) -> DataFrame:
    """Per job: done, cached, failed, percent, and done per second between first and last event."""
    # wall-clock timestamps are read as UTC, so that no session time zone bends a duration
    at = F.to_timestamp(F.concat(F.col(ts).cast("string"), F.lit("Z"))) if dict(items.dtypes)[ts] == "timestamp_ntz" else F.col(ts)
    d = items.groupBy(job).agg(
        F.count(F.lit(1)).alias("total"), *[F.sum((F.col("state") == s).cast("long")).alias(s) for s in ("done", "cached", "failed")],
        (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("_us"))
    elapsed = F.greatest(F.col("_us") / 1e6, F.lit(0.001))
    return d.withColumn("percent", F.floor((F.col("done") + F.col("cached")) * 100 / F.greatest("total", F.lit(1)))) \
            .withColumn("rate", F.round(F.col("done") / elapsed, 6)).drop("_us")


def transfer_report(lines: DataFrame, log: str = "log_id", file: str = "file_no", no: str = "line_no", line: str = "line") -> DataFrame:
    """Outcome of an upload log. Lines with OK count by their arrow, runs of <E> lines are one error block and only a
    warning when the block names a harmless cause, a file with other evidence but no OK line counts as uploaded."""
    c = F.col(line)
    ok = c.contains("OK.")
    kind = (F.when(ok & c.contains("=R=>"), "rapid").when(ok & c.contains("==>"), "uploaded").when(ok & c.contains("=C=>"), "copied")
            .when(ok, "other").when(c.contains("Local and remote file size matches") | c.contains("Faking error_code 31061 to 0"), "evidence")
            .when(c.contains("already exists, skip uploading"), "skipped").when(c.startswith("<E>"), "error"))
    d = lines.select(log, file, no, line, kind.alias("kind"))
    counted = d.groupBy(log, file).agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k)
                                         for k in ("rapid", "uploaded", "copied", "skipped", "evidence")])
    files = counted.withColumn("fallback", ((F.col("evidence") > 0) & (F.col("rapid") + F.col("uploaded") + F.col("copied") == 0)).cast("long"))
    total = files.groupBy(log).agg(F.sum(F.col("uploaded") + F.col("fallback")).alias("uploaded"), F.sum("rapid").alias("rapid"),
                                   F.sum("copied").alias("copied"), F.sum("skipped").alias("skipped"), F.sum("fallback").alias("fallback"))
    e = ranked(d.where(F.col("kind") == "error"), [log, file], [F.col(no)], "_r")
    harmless = F.col(line).contains("rapidupload") | F.col(line).contains("31023") | F.col(line).contains("Failed to save settings")
    blocks = e.groupBy(log, file, (F.col(no) - F.col("_r")).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(harmless).alias("warn"))
    errors = blocks.groupBy(log).agg(F.sum(F.when(F.col("warn"), F.col("n")).otherwise(0)).alias("warnings"),
                                     F.sum(F.when(F.col("warn"), 0).otherwise(F.col("n"))).alias("failed"))
    out = total.join(errors, log, "left").fillna(0, ["warnings", "failed"])
    good = F.col("uploaded") + F.col("rapid") + F.col("copied")
    return out.withColumn("verdict", F.when(F.col("failed") > 0, "errors").when(good <= 0, "nothing sent").otherwise("ok"))


def toc_tree_flatten(nodes: DataFrame, node: str = "node", parent: str = "parent", ordinal: str = "ordinal") -> DataFrame:
    """Pre-order rows of a tree: depth, path of ordinals, has_children, position. One join per level, until a level is
    empty; each level is kept so that no level is computed twice. A node that occurs on its own path again is not followed."""
    edges = nodes.select(*[F.col(c).alias(c) for c in nodes.columns])
    level = cut_lineage(nodes.where(F.col(parent).isNull()).withColumn("depth", F.lit(0)).withColumn("path", F.array(F.col(ordinal)))
                        .withColumn("_on", F.array(F.col(node))))
    out = level
    while not level.isEmpty():
        up = level.select(F.col(node).alias("_up"), F.col("depth").alias("_d"), F.col("path").alias("_p"), "_on")
        level = cut_lineage(edges.join(up, F.col(parent) == F.col("_up")).where(~F.array_contains("_on", F.col(node)))
                            .withColumn("depth", F.col("_d") + 1).withColumn("path", F.concat("_p", F.array(F.col(ordinal))))
                            .withColumn("_on", F.concat("_on", F.array(F.col(node)))).drop("_up", "_d", "_p"))
        out = out.unionByName(level)
    inner = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias(node)).distinct().withColumn("has_children", F.lit(True))
    flat = out.drop("_on").join(inner, node, "left").fillna(False, ["has_children"])
    return ranked(flat, [], [F.col("path")], "position")


def seen_ledger(picks: DataFrame, order: Sequence[Column], cap: int = K.SEEN_CAP) -> DataFrame:
    """The newest `cap` picks; the cap is what a ledger is."""
    return picks.orderBy(*order).limit(cap)


def rotate_check(batches: DataFrame, title: str = "title") -> DataFrame:
    """Title keys that occur in more than one pick of several batches."""
    return batches.groupBy(key_title(title).alias("key")).agg(F.count(F.lit(1)).alias("picks")).where(F.col("picks") > 1)


def removed_audit(audit: DataFrame, day: Column) -> DataFrame:
    return audit.groupBy(day.alias("day"), "kind", "rule").agg(F.count(F.lit(1)).alias("removed"))


def all_locked(chapters: DataFrame, keys: Sequence[str], state: str = "state") -> DataFrame:
    """Volumes of at least two chapters whose every chapter is locked."""
    d = chapters.groupBy(*keys).agg(F.count(F.lit(1)).alias("chapters"), F.bool_and(F.col(state) == "locked").alias("_all"))
    return d.select(*keys, "chapters", ((F.col("chapters") >= 2) & F.col("_all")).alias("all_locked"))
