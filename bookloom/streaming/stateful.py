"""Stateful processors: what a key needs from one micro-batch to the next lives in the state store, and no table is read back. Keys go to
Python in groups, with their states, so a key costs no round trip of its own.

Rows of a key come in order of time from batch to batch; within a batch they are sorted here. Of a batch only the few columns that a
processor needs are held, and the state of a key has a fixed size (bookmarks: the list itself).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState

from bookloom.operators.events import Places

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """States outgrow the memory of a task, so they are kept in the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _named(d: pd.DataFrame, names: Sequence[str]) -> pd.DataFrame:
    """Columns come by place: names that Python does not allow for attributes are lost on the way to a processor."""
    d.columns = list(names)
    return d


def _plain(v):
    """A value as the state keeps it."""
    return None if v is None or v is pd.NaT or v != v else v.item() if hasattr(v, "item") else v


class Latest:
    """The greatest row of a key so far by its order columns; emitted whenever it changes. With a time to live a key that stays
    silent for that long (by the clock) leaves the state."""

    def __init__(self, order: Sequence[str], shape: T.StructType, ttl_ms: int | None):
        self.order, self.ttl_ms = list(order), ttl_ms
        self.whole = [isinstance(f.dataType, T.IntegralType) for f in shape.fields[1:]]
        self.state = T.StructType([*shape.fields[1:], T.StructField("_since", T.LongType())])

    def step(self, columns: Sequence[np.ndarray], old: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        new = [v if v is None or not whole else int(v) for v, whole in zip((_plain(c[-1]) for c in columns), self.whole, strict=True)]
        rank = lambda r: [(o is not None, o) for o in r[:len(self.order)]]
        if old is not None and rank(old) > rank(new):
            return old, []
        return (*new, now), [tuple(new)]


class Breaker:
    """Blocked answers in a row; `limit` of them trip the source for good, and an answer that is not blocked resets the count."""

    ttl_ms = None

    def __init__(self, source: str, order: Sequence[str], limit: int):
        self.order, self.limit = list(order), limit
        self.state = T.StructType.fromDDL("seen long, run long, tripped_at long")

    def step(self, columns: Sequence[np.ndarray], old: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        blocked = columns[-1].astype(bool)
        seen, run, at = old or (0, 0, None)
        # length of the run that each answer ends: places since the last answer that was not blocked, or since before the batch
        place = np.arange(1, len(blocked) + 1)
        runs = place - np.maximum.accumulate(np.where(blocked, -run, place))
        hit = np.flatnonzero(runs >= self.limit)
        if at is None and len(hit):
            at = seen + int(hit[0]) + 1
        seen, run = seen + len(blocked), int(runs[-1])
        return (seen, run, at), [(at is not None, at, run)]


class Sparing:
    """Events of a key that no kept event within the time to live suppresses; the state is the time of the last one kept."""

    ttl_ms = None

    def __init__(self, key: str, ttl_micros: int):
        self.order, self.ttl = ["_at", "_tie"], ttl_micros
        self.state = T.StructType.fromDDL("at long")

    def step(self, columns: Sequence[np.ndarray], old: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        at, tie = columns
        i, kept = 0 if old is None else int(np.searchsorted(at, old[0] + self.ttl, "right")), []
        while i < len(at):
            kept.append((int(at[i]), _plain(tie[i])))
            i = int(np.searchsorted(at, at[i] + self.ttl, "right"))
        return (kept[-1][:1] if kept else old), kept


class Bookmarks:
    """The bookmark list of a book, oldest first in the state; an add comes in front, a delete names a place from the front. Emits the
    list after each batch that touched it."""

    ttl_ms = None

    def __init__(self, key: str, order: str, action: str, item: str, ordinal: str):
        self.order = [order]
        self.state = T.StructType.fromDDL("items array<string>")

    def step(self, columns: Sequence[np.ndarray], old: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        _, actions, names, ordinals = columns
        items = list(old[0]) if old else []
        places, alive = Places(), len(items)
        for act, it, at in zip(actions, names, ordinals, strict=True):
            if act == "add":
                items.append(it)
                alive += 1
            elif not pd.isna(at) and 0 <= at < alive:
                places.take(places.nth(alive - 1 - int(at)))
                alive -= 1
        items = [it for i, it in enumerate(items) if i not in places]
        return ((items,) if items else None), [(items[::-1],)]


#: groups of keys that share one entry of the state store; fixed for good by the first run of a job
GROUPS = 512


def processed(df: DataFrame, key: str, processor, shape: str | T.StructType, mode: str) -> DataFrame:
    """df with its key column first; `processor.step(columns, state, now)` takes the rows of one key in order (nulls first) as one array per
    column, and gives the key's new state (None: forget it) and its rows. Rows without key are left out.

    Keys are dealt to GROUPS by hash and a group goes to Python at once, with the states of its keys, so that a key costs neither a call of
    its own nor a round trip. A group's rows of one micro-batch and its states are held together.
    """
    stateful(df.sparkSession)
    names, order, ttl = df.columns, processor.order, processor.ttl_ms
    fields = (T.StructType.fromDDL(shape) if isinstance(shape, str) else shape).fieldNames()
    held = T.StructType([T.StructField("keys", T.ArrayType(T.StructType([T.StructField("_key", df.schema[key].dataType), *processor.state.fields])))])

    def step(_, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if ttl is not None else 0
        states = {e[0]: tuple(e[1:]) for e in state.get[0]} if state.exists else {}
        if ttl is not None:  # the time of a state is its last field
            states = {k: v for k, v in states.items() if v[-1] + ttl > now}
        out = []
        parts = [] if state.hasTimedOut else [_named(d, ["_group", *names]) for d in rows]
        if parts:
            d = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            d = d.sort_values([key, *order], kind="stable", na_position="first", ignore_index=True)
            ids, columns = d[key].to_numpy(), [d[c].to_numpy() for c in names if c != key]
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                k = _plain(ids[a])
                new, made = processor.step([c[a:b] for c in columns], states.pop(k, None), now)
                if new is not None:
                    states[k] = new
                out += [(k, *row) for row in made]
        if states:
            state.update(([(k, *v) for k, v in states.items()],))
            if ttl is not None:
                state.setTimeoutDuration(max(1, min(v[-1] for v in states.values()) + ttl - now))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=fields, dtype=object)
    grouped = df.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("_group"), *names).groupBy("_group")
    return grouped.applyInPandasWithState(step, shape, held, mode, "NoTimeout" if ttl is None else "ProcessingTimeTimeout")
