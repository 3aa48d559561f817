"""Structured Streaming jobs. What has to be remembered is in the state store (see `stateful`); tables of current values keep themselves
small (see `current`); every micro-batch owns the folder it writes, so a batch that is repeated replaces its own output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from bookloom.streaming.current import current_sink
from bookloom.streaming.stateful import Bookmarks, Breaker, Latest, Sparing, processed


def files_stream(spark: SparkSession, path: str, schema, glob: str | None = None, per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def _append(table: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
    return write


def _start(df: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool, timed: bool = False) -> StreamingQuery:
    """`once`: what is there now, then stop. A job that is timed by the clock has always another batch to run, so that one takes all in one."""
    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(once=True) if timed else writer.trigger(availableNow=True)
    return writer.start()


def _plain(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Timestamps as microseconds, as the state store keeps them, and the way back."""
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name in columns and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    there = df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in kinds}) if kinds else df
    return there, lambda d: d.withColumns({c: F.timestamp_micros(c).cast(k) for c, k in kinds.items()}) if kinds else d


def latest_stream(events: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], table: str, checkpoint: str,
                  once: bool = False, ttl_ms: int | None = None) -> StreamingQuery:
    """Latest progress or position per key, as a table for read_current. A batch writes only the keys it changed. With `ttl_ms`, the state
    forgets a key that is silent for so long (by the clock), so that it holds the active keys only; the table keeps its last value."""
    names = [*order, *fields]
    if ttl_ms is None:
        latest = events.groupBy(key).agg(F.max(F.struct(*names)).alias("_v")).select(key, *[f"_v.{c}" for c in names])
    else:
        rows, back = _plain(events.select(key, *names), names)
        latest = back(processed(rows, key, Latest(names, rows.schema, ttl_ms), rows.schema, "update"))
    return _start(latest, "update", current_sink(table, [key]), checkpoint, once, ttl_ms is not None)


def dedup_stream(events: DataFrame, key: str, ts: str, ttl_micros: int, tie: str, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep an event when no kept event of its key is younger than the time to live. The state of a key is the time of its last kept
    event; events come in order of time from batch to batch. Rows without key or time are left out."""
    kind = {f.name: f.dataType for f in events.schema.fields}
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(tie).alias("_tie"))
    kept = processed(rows, key, Sparing(key, ttl_micros), rows.schema, "append")
    kept = kept.select(key, F.timestamp_micros("_at").cast(kind[ts]).alias(ts), F.col("_tie").alias(tie))
    return _start(kept, "append", _append(table), checkpoint, once)


def breaker_stream(events: DataFrame, source: str, order: Sequence[Column], blocked: Column, table: str, checkpoint: str,
                   limit: int = 3, once: bool = False) -> StreamingQuery:
    """Block breaker: a table for read_current with (source, tripped, tripped_at, run), the same as the batch form over all events. The state
    of a source is how many answers it gave, how many were blocked last, and where it tripped."""
    names = [f"_o{i}" for i in range(len(order))]
    rows = events.select(source, *[o.alias(n) for o, n in zip(order, names, strict=True)], F.coalesce(blocked, F.lit(False)).alias("_b"))
    kind = dict(rows.dtypes)[source]
    shape = f"{source} {kind}, tripped boolean, tripped_at long, run long"
    return _start(processed(rows, source, Breaker(source, names, limit), shape, "update"), "update", current_sink(table, [source]), checkpoint, once)


def bookmark_stream(events: DataFrame, key: str, order: str, table: str, checkpoint: str, action: str = "action", item: str = "item",
                    ordinal: str = "ordinal", once: bool = False) -> StreamingQuery:
    """Current bookmark list of each book, as a table for read_current with one row per book: (key, items), the newest first. Add and
    delete events come in order from batch to batch."""
    rows = events.select(key, order, action, item, ordinal)
    kind = dict(rows.dtypes)[key]
    lists = processed(rows, key, Bookmarks(key, order, action, item, ordinal), f"{key} {kind}, items array<string>", "update")
    return _start(lists, "update", current_sink(table, [key]), checkpoint, once)


def ingest_stream(pages: DataFrame, shape: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """New page files through a stateless transformation (chapter_text and the like) into a parquet table."""
    writer = shape(pages).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
