"""A table of current values behind a stream in update mode: changes per micro-batch, folded into a snapshot from time to time.

    <table>/changes/batch_id=<n>   the keys that a micro-batch changed; a repeated batch replaces its own folder
    <table>/whole/upto=<n>         one row per key after batch n
    <table>/CURRENT                the n of the snapshot that counts, replaced at once when it is complete

A reader takes the snapshot that CURRENT names and the later changes. Changes that the snapshot before that one holds already, and
older snapshots, are removed, so what is listed and read does not grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookloom.operators.scale import first_rows
from bookloom.sources.files import children, get_text, put_text, remove

#: micro-batches between two snapshots
EVERY = 16


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(name.split("=")[1]) for name in children(spark, folder) if "=" in name)


def _newest(spark: SparkSession, table: str, keys: Sequence[str], last: int | None = None) -> DataFrame | None:
    """The current row of each key, after batch `last` if that is given."""
    done = get_text(spark, f"{table}/CURRENT")
    upto = -1 if done is None else int(done)
    later = [n for n in _numbers(spark, f"{table}/changes") if n > upto and (last is None or n <= last)]
    parts = [spark.read.parquet(f"{table}/changes/batch_id={n}").withColumn("_batch", F.lit(n)) for n in later]
    if upto >= 0:
        parts.append(spark.read.parquet(f"{table}/whole/upto={upto}").withColumn("_batch", F.lit(upto)))
    if not parts:
        return None
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return first_rows(every, keys, [F.col("_batch").desc()]).drop("_batch")


def read_current(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """One row per key, as of the last finished micro-batch."""
    found = _newest(spark, table, keys)
    if found is None:
        raise ValueError(f"no batch has been written to {table}")
    return found


def current_sink(table: str, keys: Sequence[str], every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the table above. A batch that is repeated after a failure writes the same again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/changes/batch_id={batch_id}")
        if (batch_id + 1) % every:
            return
        before = get_text(spark, f"{table}/CURRENT")
        if before is not None and int(before) >= batch_id:
            return  # this batch had been folded in before it was repeated
        _newest(spark, table, keys, batch_id).write.mode("overwrite").parquet(f"{table}/whole/upto={batch_id}")
        put_text(spark, f"{table}/CURRENT", str(batch_id))
        if before is not None:  # readers may still be at the snapshot before this one, and at the changes behind it
            for n in _numbers(spark, f"{table}/changes"):
                if n <= int(before):
                    remove(spark, f"{table}/changes/batch_id={n}")
            for n in _numbers(spark, f"{table}/whole"):
                if n < int(before):
                    remove(spark, f"{table}/whole/upto={n}")
    return write
