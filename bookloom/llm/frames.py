"""Schemas for Arrow maps, and rows kept whole beside what is computed from them."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

ROW = "_row"


def plus(df: DataFrame, added: str) -> T.StructType:
    """The columns of df and some more, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as one struct beside the columns that an operator needs, so that no column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *columns)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def give_back() -> None:
    """Hand the memory that Arrow and numpy no longer use back to the system; a Python worker lives on for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with this C library
        pass


def tidy(run: Callable) -> Callable:
    """A map over batches that gives unused memory back when it ends."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped
