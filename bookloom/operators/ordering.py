"""Keep-first, tiers, pages, newest and union."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookloom import constants as K
from bookloom.operators.scale import first_rows, ranked


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_rows(df, keys, order)


def dedup_prefer(df: DataFrame, keys: Sequence[str], has: Column, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first that has the wanted value, else the first."""
    return first_rows(df.withColumn("_has", F.coalesce(has, F.lit(False)).cast("int")), keys,
                      [F.col("_has").desc(), *order]).drop("_has")


def dedup_by_path(df: DataFrame, path: str, order: Sequence[Column]) -> DataFrame:
    """One row per path, compared without case and with forward slashes."""
    canonical = F.lower(F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"/\./", "/"))
    return first_rows(df.withColumn("_path", canonical), ["_path"], order).drop("_path")


def split_tiers(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "tier") -> DataFrame:
    """hot for the first max(1, n // 2) rows of each group in the given order, new for the rest."""
    d = ranked(df, group, order, "_pos", size="_size")
    return d.withColumn(out, F.when(F.col("_pos") <= F.greatest(F.lit(1), F.floor(F.col("_size") / 2)), "hot").otherwise("new")) \
            .drop("_pos", "_size")


def board_merge(pages: DataFrame, board: str, page: str, pos: str, book: str, limit: int = 0) -> DataFrame:
    """Pages of a board in order, each book once, positions renumbered. How many pages are fetched is not its business."""
    kept = first_rows(pages, [board, book], [F.col(page), F.col(pos)])
    out = ranked(kept, [board], [F.col(page), F.col(pos), F.col(book)], "rank_pos")
    return out.where(F.col("rank_pos") <= limit) if limit else out


def page_slice(df: DataFrame, group: Sequence[str], order: Sequence[Column], page: int, size: int = K.PAGE_SIZE) -> DataFrame:
    return ranked(df, group, order, "n").where((F.col("n") > (page - 1) * size) & (F.col("n") <= page * size))


def newest_n(files: DataFrame, mtime: str, n: int, tie: Sequence[Column], since: Column | None = None) -> DataFrame:
    """The n newest rows (not older than `since`); a distributed top-n, no full sort."""
    d = files.where(F.col(mtime) >= since) if since is not None else files
    return d.orderBy(F.col(mtime).desc(), *tie).limit(n)


def recent_urls(events: DataFrame, url: str, ts: str, n: int = 20) -> DataFrame:
    return events.groupBy(url).agg(F.max(ts).alias("last")).orderBy(F.col("last").desc(), url).limit(n)


def stable_path_order(files: DataFrame, path: str) -> DataFrame:
    return files.orderBy(path)


def union_sources(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """(union of all sources that can be read, one diagnostic row per source). A broken source is reported only."""
    pool, notes = None, []
    for name, load in loaders.items():
        try:
            df = load().withColumn("loader", F.lit(name))
            df.schema  # unresolved columns and missing files show up here
        except (PySparkException, OSError) as exc:
            notes.append((name, False, type(exc).__name__))
            continue
        notes.append((name, True, None))
        pool = df if pool is None else pool.unionByName(df, allowMissingColumns=True)
    return pool, spark.createDataFrame(notes, "source string, ok boolean, error string")
