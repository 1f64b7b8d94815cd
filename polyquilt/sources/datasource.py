"""S3, S4, S6, K1 as a Python data source: record files that Spark reads in splits and writes with commit and abort.

    spark.dataSource.register(RecordFiles)
    df.write.format("polyquilt_records").option("layout", "text").mode("append").save(path)
    spark.read.format("polyquilt_records").schema(...).load(path).filter("lang = 'de'")

Layouts, one value a column in order of the schema, each as JSON:

* ``text``: a line with the mark, then one line a value.  JSON has no raw line ends and no
  value begins as the mark does, so a reader may start anywhere: a split's records are those
  whose mark line begins in it.
* ``packed``: the number of records in eight bytes, then each record behind its length in
  four, low bytes first.  Such a file is read whole, so the writer begins a new one after
  ``splitBytes``.  A file that ends early or goes on after its last record is an error.

A write stages its files beside the others; commit moves them in one by one under names of
their own and then states success, abort removes them.  Paths are opened by Arrow's file systems,
on executors too, so they must be shared ones.

With the option ``push`` set to true (and ``spark.sql.python.filterPushdown.enabled``), filters
on single columns that the reader can test (equality, order, sets, nulls) are pushed to it,
and others stay with Spark.  Spark keeps what was pushed with the loaded DataFrame, and
would use it again in a later query over the same one that pushes nothing: so with ``push``,
load anew for each query.  Without it, no filter is pushed and a DataFrame may be used freely.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

MARK = b"Number of polygons:"
ENDINGS = {"text": ".txt", "packed": ".bin"}
KINDS = (BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType)
SPLIT_BYTES = 32 << 20
#: Records of a batch that a reader hands on, and bytes of their files.
BATCH, BATCH_BYTES = 10_000, 4 << 20

_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda x, y: x is not None and x == y,
    EqualNullSafe: lambda x, y: x == y,
    GreaterThan: lambda x, y: x is not None and x > y,
    GreaterThanOrEqual: lambda x, y: x is not None and x >= y,
    LessThan: lambda x, y: x is not None and x < y,
    LessThanOrEqual: lambda x, y: x is not None and x <= y,
    In: lambda x, y: x is not None and x in y,
    IsNull: lambda x, _: x is None,
    IsNotNull: lambda x, _: x is not None,
}


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


def _open(options: dict[str, str]) -> tuple[fs.FileSystem, str]:
    path = options.get("path")
    if not path:
        raise ValueError("a path is needed")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _layout(options: dict[str, str]) -> str:
    layout = options.get("layout", "text")
    if layout not in ENDINGS:
        raise ValueError(f"layout {layout!r} is none of {sorted(ENDINGS)}")
    return layout


def text_records(file: io.BufferedIOBase, start: int, end: int, columns: int) -> Iterator[list[Any]]:
    """The records whose mark line begins in [start, end)."""
    file.seek(max(start - 1, 0))
    if start:
        file.readline()  # the rest of a line that begins before the split, or its line end only
    at, values = file.tell(), None
    while True:
        line = file.readline()
        if not line or line.rstrip(b"\r\n") == MARK:
            if values is not None:
                if len(values) != columns:
                    raise ValueError(f"a record of {len(values)} values instead of {columns} ends at {at}")
                yield [json.loads(x) for x in values]
            if not line or at >= end:
                return
            values = []
        elif values is not None:
            values.append(line)
        elif line.strip() and not start:
            raise ValueError(f"{line[:20]!r} stands before the first record")
        at += len(line)


def packed_records(file: io.BufferedIOBase, columns: int) -> Iterator[list[Any]]:
    """All records of a counted file."""

    def take(n: int) -> bytes:
        data = file.read(n)
        if len(data) < n:
            raise ValueError("a counted file ends early")
        return data

    for _ in range(int.from_bytes(take(8), "little")):
        values = json.loads(take(int.from_bytes(take(4), "little")))
        if len(values) != columns:
            raise ValueError(f"a record of {len(values)} values instead of {columns}")
        yield values
    if file.read(1):
        raise ValueError("a counted file goes on after its last record")


class RecordReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options, self.layout = schema, dict(options), _layout(options)
        self.tests: list[tuple[int, type, Any]] = []
        odd = [f.name for f in schema if not isinstance(f.dataType, KINDS)]
        if odd:
            raise ValueError(f"columns of other than plain types: {odd}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        place = {f.name: k for k, f in enumerate(self.schema)}
        for f in filters:
            if self.options.get("push") == "true" and type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in place:
                self.tests.append((place[f.attribute[0]], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, path = _open(self.options)
        size = int(self.options.get("splitBytes", SPLIT_BYTES))
        found = files.get_file_info(fs.FileSelector(path, recursive=False))
        out: list[InputPartition] = []
        for f in sorted((f for f in found if f.is_file and f.base_name.endswith(ENDINGS[self.layout]) and f.base_name[0] not in "._"), key=lambda f: f.path):
            step = size if self.layout == "text" else max(f.size, 1)
            out += [Split(f.path, a, min(a + step, f.size)) for a in range(0, f.size, step)]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _open(self.options)
        kinds = to_arrow_schema(self.schema)
        n = len(kinds)
        tests = [(k, _TESTS[kind], value) for k, kind, value in self.tests]
        with io.BufferedReader(files.open_input_file(partition.path), 1 << 20) as file:
            own = text_records(file, partition.start, partition.end, n) if self.layout == "text" else packed_records(file, n)
            held, last = [], 0
            for values in own:
                if all(test(values[k], value) for k, test, value in tests):
                    held.append(values)
                if len(held) >= BATCH or file.tell() - last > BATCH_BYTES:
                    yield self._batch(held, kinds)
                    held, last = [], file.tell()
            if held:
                yield self._batch(held, kinds)

    @staticmethod
    def _batch(rows: list[list[Any]], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.options, self.layout, self.overwrite = dict(options), _layout(options), overwrite
        self.size = int(options.get("splitBytes", SPLIT_BYTES))
        self.job = uuid.uuid4().hex
        odd = [f.name for f in schema if not isinstance(f.dataType, KINDS)]
        if odd:
            raise ValueError(f"columns of other than plain types: {odd}")

    def _stage(self, path: str) -> str:
        return f"{path}/_staged-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, path = _open(self.options)
        files.create_dir(self._stage(path), recursive=True)
        names: list[str] = []
        held, size = [], 0

        def out() -> None:
            # a name of its own for each attempt, so that a second one of a task never meets the first
            names.append(f"part-{uuid.uuid4().hex}{ENDINGS[self.layout]}")
            with files.open_output_stream(f"{self._stage(path)}/{names[-1]}") as file:
                if self.layout == "packed":
                    file.write(len(held).to_bytes(8, "little"))
                file.write(b"".join(held))

        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if self.layout == "text":
                    data = b"".join([MARK, b"\n", *(json.dumps(x).encode() + b"\n" for x in row)])
                else:
                    data = json.dumps(row).encode()
                    data = len(data).to_bytes(4, "little") + data
                held.append(data)
                size += len(data)
                if size >= self.size:
                    out()
                    held, size = [], 0
        if held:
            out()
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        files, path = _open(self.options)
        files.create_dir(path, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.is_file] if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):
            files.move(f"{self._stage(path)}/{name}", f"{path}/{name}")
        for f in old:
            files.delete_file(f)
        self._clear(files, path)
        with files.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Staged | None]) -> None:
        files, path = _open(self.options)
        self._clear(files, path)

    def _clear(self, files: fs.FileSystem, path: str) -> None:
        if files.get_file_info(self._stage(path)).type != fs.FileType.NotFound:
            files.delete_dir(self._stage(path))


class RecordFiles(DataSource):
    """``polyquilt_records``: options ``path``, ``layout`` (text, packed), ``splitBytes`` and ``push``; the schema is the user's."""

    @classmethod
    def name(cls) -> str:
        return "polyquilt_records"

    def schema(self) -> StructType:
        raise ValueError("record files do not state their columns: give a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(schema, self.options, overwrite)
