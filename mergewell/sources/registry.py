"""Extractors by source type: each reads a path into raw records."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession


@runtime_checkable
class Extractor(Protocol):
    source_type: str

    def can_handle(self, path: str) -> bool: ...

    def extract(self, spark: SparkSession, path: str) -> DataFrame: ...


class Registry:
    """Extractor classes by their ``source_type``; a later registration replaces an earlier one and is reported."""

    def __init__(self) -> None:
        self._classes: dict[str, type] = {}
        self.replaced: list[str] = []

    def register(self, cls: type) -> type:
        """Class decorator. AttributeError without a source_type."""
        kind = getattr(cls, "source_type", None)
        if not kind:
            raise AttributeError(f"{cls.__name__} has no source_type")
        if kind in self._classes:
            self.replaced.append(kind)
        self._classes[kind] = cls
        return cls

    def get(self, kind: str) -> type:
        if kind not in self._classes:
            raise KeyError(f"no extractor for '{kind}'; there are: {', '.join(sorted(self._classes)) or 'none'}")
        return self._classes[kind]

    def instantiate(self, kind: str):
        return self.get(kind)()

    def detect(self, path: str):
        """An instance of the first registered extractor that can handle the path, or None."""
        for cls in self._classes.values():
            one = cls()
            if getattr(one, "can_handle", lambda _: False)(path):
                return one
        return None

    def all_registered(self) -> dict[str, type]:
        return dict(self._classes)

    def clear(self) -> None:
        self._classes.clear()


REGISTRY = Registry()
