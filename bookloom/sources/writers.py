"""Sinks: assembled books, resolutions, snapshots with a time to live."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookloom.sources.files import children, get_text, put_text, remove


def book_fragments(chapters: DataFrame, books: DataFrame, book: str, pos: str, name: str, text: str, title: str = "title") -> DataFrame:
    """(book, pos, fragment): the title line, then every chapter as its own fragment in order. The text of a book is the
    concatenation of its fragments; keeping them as rows lets a book be larger than any task."""
    head = books.select(book, F.lit(-1).cast("long").alias("pos"), F.concat(title, F.lit("\n\n")).alias("fragment"))
    body = chapters.select(book, F.col(pos).cast("long").alias("pos"),
                           F.concat(F.lit("\n\n"), name, F.lit("\n\n"), text, F.lit("\n")).alias("fragment"))
    return head.unionByName(body)


def book_markdown(chapters: DataFrame, books: DataFrame, book: str, number: str, name: str, text: str, date: Column,
                  title: str = "title", author: str = "author") -> DataFrame:
    """(book, pos, fragment) in Markdown: a YAML head, then every chapter (numbered from 1) with an anchor and its non-blank
    lines as paragraphs."""
    line = lambda k, v: F.concat(F.lit(f'{k}: "'), v, F.lit('"\n'))
    head = books.select(book, F.lit(0).cast("long").alias("pos"), F.concat(
        F.lit("---\n"), line("title", F.col(title)), line("author", F.col(author)), line("date", date), F.lit("lang: zh-CN\n---\n\n")).alias("fragment"))
    paras = F.transform(F.filter(F.split(text, "\n", -1), lambda p: F.trim(p) != ""), lambda p: F.concat(p, F.lit("\n\n")))
    body = chapters.select(book, F.col(number).cast("long").alias("pos"), F.concat(
        F.lit("# "), name, F.lit(" {#ch-"), F.col(number).cast("string"), F.lit("}\n\n"), F.array_join(paras, "")).alias("fragment"))
    return head.unionByName(body)


def write_books(fragments: DataFrame, path: str, book: str, files: int | None = None) -> None:
    """Fragments (book, pos, fragment) as few large files below <path>/data, and below <path>/manifest a row per book and file with the
    first and last position there. Range partitioning puts the fragments of one book next to each other and splits a very large book
    over several files; the number of files follows the data (or `files`), not the number of books."""
    n = files or int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = fragments.select(F.col(book).alias("book"), "pos", "fragment").repartitionByRange(n, F.col("book"), F.col("pos"))
    laid.sortWithinPartitions("book", "pos").write.mode("overwrite").parquet(f"{path}/data")
    written = fragments.sparkSession.read.parquet(f"{path}/data").select("book", "pos", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    written.groupBy("book", "file").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("fragments")) \
           .repartitionByRange(max(1, n // 8), "book").sortWithinPartitions("book").write.mode("overwrite").parquet(f"{path}/manifest")


def read_books(spark: SparkSession, path: str, wanted: Sequence | None = None) -> DataFrame:
    """(book, pos, fragment) of all books, or of the wanted ones: the manifest, sorted by book, names the files that have them, and only
    these are opened."""
    if wanted is None:
        return spark.read.parquet(f"{path}/data")
    here = spark.read.parquet(f"{path}/manifest").where(F.col("book").isin(*wanted)).select("file").distinct()
    files = sorted(r.file for r in here.collect())  # as many as the wanted books lie in
    rows = spark.read.parquet(*[f"{path}/data/{f}" for f in files]) if files else spark.read.parquet(f"{path}/data").limit(0)
    return rows.where(F.col("book").isin(*wanted))


def resolution_rows(resolved: DataFrame, query: str = "query_id") -> DataFrame:
    """Report form of resolutions: scores with four decimals, only the parts that are there."""
    def four(c: Column) -> Column:
        return F.when(c.isNotNull(), c.withField("score", F.round(c["score"], 4)).withField("title_score", F.round(c["title_score"], 4)))
    return resolved.select(
        query, F.col("best").isNotNull().alias("found"), four(F.col("best")).alias("best"), four(F.col("weak")).alias("weak_match"),
        "ambiguous", F.when(F.col("ambiguous"), F.transform("same_title", four)).alias("same_title_matches"),
        F.transform("alternatives", four).alias("alternatives"), "cover_from")


def write_resolution(resolved: DataFrame, path: str, query: str = "query_id", mode: str = "overwrite") -> None:
    resolution_rows(resolved, query).write.mode(mode).json(path)


#: file that names the folder of every snapshot; what it does not name does not count
COMMITTED = "COMMITTED.json"


def _committed(spark: SparkSession, path: str) -> dict:
    text = get_text(spark, f"{path}/{COMMITTED}")
    return json.loads(text) if text else {"at": {}, "replaced": []}


def snapshot_write(df: DataFrame, path: str, built_at: Column) -> None:
    """Add or replace the snapshot(s) of the given time (whole seconds). They are written to a folder of their own; then one small file, replaced
    at once, names it, so a reader sees the old snapshots or the new ones, never a mixture. A failed write leaves what
    was there. Folders that were replaced are removed by the next write, when no reader is at them any more. One writer at a time."""
    spark, folder = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.withColumn("built_at", built_at).write.partitionBy("built_at").parquet(f"{path}/{folder}")
    fresh = {name.split("=")[1]: f"{folder}/{name}" for name in children(spark, f"{path}/{folder}") if name.startswith("built_at=")}
    fresh.pop("__HIVE_DEFAULT_PARTITION__", None)
    before = _committed(spark, path)
    state = {"at": before["at"] | fresh, "replaced": [before["at"][t] for t in fresh if t in before["at"]]}
    put_text(spark, f"{path}/{COMMITTED}", json.dumps(state))
    for old in before["replaced"]:
        remove(spark, f"{path}/{old}")


def snapshot_read_fresh(spark: SparkSession, path: str, now: int, ttl: int, min_rows: int = 1) -> DataFrame:
    """Rows of the newest snapshot (built_at in seconds) when it is at most ttl old and has at least min_rows rows, else none.
    A negative ttl accepts any age. Only the folder that counts is opened."""
    at = {int(t): folder for t, folder in _committed(spark, path)["at"].items()}
    if not at:
        raise ValueError(f"no snapshot has been committed to {path}")
    known = [t for t in at if t <= now]
    newest = max(known, default=max(at))
    rows = spark.read.parquet(f"{path}/{at[newest]}").withColumn("built_at", F.lit(newest).cast("long"))
    fresh = bool(known) and (ttl < 0 or newest >= now - ttl) and rows.limit(min_rows).count() >= min_rows
    return rows if fresh else rows.limit(0)
