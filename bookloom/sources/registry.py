"""Pluggable sources: name, label, priority, loader; some are off unless asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bookloom.operators.ordering import union_sources


@dataclass(frozen=True)
class Source:
    name: str
    label: str
    priority: int
    load: Callable[[], DataFrame]
    default: bool = True


class SourceRegistry:
    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def register(self, source: Source) -> None:
        self._sources[source.name] = source

    def get(self, name: str) -> Source:
        key = (name or "").strip().lower()
        if key not in self._sources:
            raise KeyError(f"unknown source {name!r}, known: {', '.join(self.names(True))}")
        return self._sources[key]

    def names(self, include_optional: bool = False) -> list[str]:
        """Names by priority; this order is what ranking and failover take as source priority."""
        chosen = [s for s in self._sources.values() if s.default or include_optional]
        return [s.name for s in sorted(chosen, key=lambda s: s.priority)]

    def pool(self, spark: SparkSession, names: list[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
        return union_sources(spark, {n: self.get(n).load for n in (names or self.names())})
