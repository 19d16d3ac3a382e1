"""Editions of a set of tables: a run's batches and lookups appear together, and a reader keeps the edition that it began with.

A table is a list of folders that never change once written.  An edition is one small file that names each table's
folders; it appears under the next number by a rename, which either happens or doesn't.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.writers import _names, _path


class Conflict(RuntimeError):
    """Another run has published in the meantime."""


@dataclass(frozen=True)
class Layout:
    """How a table's files are laid out: sorted, so that row groups have narrow ranges, and with bloom filters for columns sought by value."""

    sort: Sequence[str] = ()
    bloom: Sequence[str] = ()
    options: Mapping[str, str] = field(default_factory=dict)

    def write(self, df: DataFrame, path: str) -> None:
        if self.sort:
            df = df.repartitionByRange(*self.sort).sortWithinPartitions(*self.sort)
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.bloom}
        df.write.options(**blooms, **self.options).parquet(path)


@dataclass(frozen=True)
class Edition:
    """A pinned edition: what it names stays as it is, whatever is published later."""

    spark: SparkSession
    path: str
    number: int
    folders: Mapping[str, Sequence[str]]

    def table(self, name: str) -> DataFrame:
        """All rows of a table; columns that older folders lack are null there."""
        if name not in self.folders:
            raise KeyError(f"edition {self.number} has no table {name!r}, but {sorted(self.folders)}")
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/data/{f}" for f in self.folders[name]])


@dataclass(frozen=True)
class Editions:
    """The editions below a folder, numbered from 1 on."""

    spark: SparkSession
    path: str

    def numbers(self) -> list[int]:
        found = (re.fullmatch(r"(\d{12})\.json", n) for n in _names(self.spark, f"{self.path}/editions"))
        return sorted(int(m.group(1)) for m in found if m)

    def at(self, number: int | None = None) -> Edition:
        """An edition, by default the newest; edition 0 has no tables."""
        number = max(self.numbers(), default=0) if number is None else number
        folders = {}
        if number:
            at, files = _path(self.spark, self._file(number))
            stream = files.open(at)
            try:
                folders = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
        return Edition(self.spark, self.path, number, folders)

    def publish(self, append: Mapping[str, DataFrame] | None = None, replace: Mapping[str, DataFrame] | None = None, *, layouts: Mapping[str, Layout] | None = None, base: Edition | None = None) -> Edition:
        """The next edition: rows appended to some tables, others replaced as wholes, the rest as in ``base`` (by default the newest).

        Nothing of it is seen before all of it is written.  A failed run leaves folders that no edition names; ``forget``
        removes them.  Raises Conflict if ``base`` isn't the newest edition any more, so that no run's rows get lost.
        """
        base = base or self.at()
        folders = {name: list(known) for name, known in base.folders.items()}
        for name, df in {**(append or {}), **(replace or {})}.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            (layouts or {}).get(name, Layout()).write(df, f"{self.path}/data/{folder}")
            folders[name] = [folder] if name in (replace or {}) else [*folders.get(name, []), folder]
        staged, files = _path(self.spark, f"{self.path}/editions/_{uuid.uuid4().hex}")
        stream = files.create(staged, False)
        try:
            stream.write(bytearray(json.dumps(folders).encode()))
        finally:
            stream.close()
        to = _path(self.spark, self._file(base.number + 1))[0]
        if files.exists(to) or not files.rename(staged, to):
            files.delete(staged, False)
            raise Conflict(f"edition {base.number + 1} has been published by another run")
        return Edition(self.spark, self.path, base.number + 1, folders)

    def forget(self, keep: int = 2) -> None:
        """Removes all but the newest editions, and folders that none of those names; for times when no run is writing."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            at, files = _path(self.spark, self._file(n))
            files.delete(at, False)
        named = {f for n in numbers[-keep:] for folders in self.at(n).folders.values() for f in folders}
        for folder in set(_names(self.spark, f"{self.path}/data")) - named:
            at, files = _path(self.spark, f"{self.path}/data/{folder}")
            files.delete(at, True)

    def _file(self, number: int) -> str:
        return f"{self.path}/editions/{number:012d}.json"
