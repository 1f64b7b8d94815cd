"""2.12: folds over ordered groups of rows as table functions that SQL can call.

A *fold* is an object with ``start(options)``, ``step(row)`` and ``finish()``; the last two give
rows.  ``register`` makes it a Python table function: one instance folds one partition, so

    SELECT * FROM name(TABLE(t) PARTITION BY (k) ORDER BY (o), 3)

calls it once for each k.  ``analyze`` checks the columns and options when the query is
planned, and refuses a call before any row is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Fold(Protocol):
    columns: tuple[str, ...]
    options: int

    def output(self, columns: dict[str, DataType]) -> StructType: ...

    def start(self, options: tuple[Any, ...]) -> None: ...

    def step(self, row: Row) -> Iterator[tuple]: ...

    def finish(self) -> Iterator[tuple]: ...


def register(spark: SparkSession, name: str, fold: type[Fold]) -> None:
    """Make ``fold`` the table function ``name`` of a session."""

    class Folded:
        @staticmethod
        def analyze(table: AnalyzeArgument, *options: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError(f"{name} takes a table first")
            if len(options) != fold.options or any(o.isTable or not o.isConstantExpression for o in options):
                raise ValueError(f"{name} takes {fold.options} constants after the table")
            found = {f.name: f.dataType for f in table.dataType.fields}
            lacking = [c for c in fold.columns if c not in found]
            if lacking:
                raise ValueError(f"{name} needs the columns {lacking}")
            return AnalyzeResult(schema=fold().output(found))

        def __init__(self) -> None:
            self._fold = None

        def eval(self, row: Row, *options: Any) -> Iterator[tuple]:
            if self._fold is None:
                self._fold = fold()
                self._fold.start(options)
            yield from self._fold.step(row)

        def terminate(self) -> Iterator[tuple]:
            if self._fold is not None:
                yield from self._fold.finish()

    spark.udtf.register(name, udtf(Folded))


class GapRuns:
    """Runs of ascending ``at`` in which no step exceeds the option; (key, run, first, last, n) of each.

    A null ``at`` is passed over; a group of such has no runs.
    """

    columns = ("key", "at")
    options = 1

    def output(self, columns: dict[str, DataType]) -> StructType:
        out = StructType().add("key", columns["key"])
        for name in ("run", "first", "last", "n"):
            out = out.add(name, LongType())
        return out

    def start(self, options: tuple[Any, ...]) -> None:
        self._gap, self._run = options[0], None

    def step(self, row: Row) -> Iterator[tuple]:
        at, run = row["at"], self._run
        if at is None:
            return
        if run is not None and at - run[3] <= self._gap:
            run[3], run[4] = at, run[4] + 1
            return
        if run is not None:
            yield tuple(run)
        self._run = [row["key"], 0 if run is None else run[1] + 1, at, at, 1]

    def finish(self) -> Iterator[tuple]:
        if self._run is not None:
            yield tuple(self._run)
