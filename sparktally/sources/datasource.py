"""Declared text tables as a Spark data source: ``spark.read.format("declared")`` and ``df.write.format("declared")``.

Options: ``path``; ``layout`` (delimited, sparse or fixed); ``meta``, the declaration's path, or
``declaration``, its text; ``n``, the number of columns of a sparse table; ``bytes``, the
length of a partition. The schema comes from the declaration. Files are cut into ranges of
bytes: a range reads the lines that begin in it, so large files are read by many tasks.
Writers leave their files in a folder of their own; only the commit moves them to the table.
Paths are those that Arrow's file systems open (local or mounted, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .pmeta import parse_pmeta

#: Bytes of a partition where none are given, and lines of one batch.
RANGE, BATCH = 64 << 20, 10_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path if path.startswith("/") else path.replace("file:", "file://", 1))


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def lines_of(path: str, start: int, end: int) -> Iterator[str]:
    """The lines that begin at a byte from ``start`` to before ``end``, without their ends."""
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        # the line that goes over the start belongs to the range before
        where = max(0, start - 1)
        f.seek(where)
        rest, skip = b"", start > 0
        while True:
            block = f.read(1 << 20)
            rest += block
            *whole, tail = rest.split(b"\n")
            if not block:
                whole, tail = ([tail] if tail else []), b""
            for line in whole:
                if not skip:
                    if where >= end:
                        return
                    yield line.removesuffix(b"\r").decode()
                skip = False
                where += len(line) + 1
            rest = tail
            if not block or (where >= end and not skip):
                return


def parser(layout: str, schema: T.StructType, n: int) -> Callable[[str], list]:
    """Values of a line in the schema's order; what the declaration does not allow is an error."""

    def typed(f: T.StructField) -> Callable[[str], object]:
        if "domain" in f.metadata:
            names = {v.lower(): v for v in f.metadata["domain"]}

            def category(raw: str) -> str:
                if (v := names.get(raw.strip().lower())) is None:
                    raise ValueError(f"unknown value of {f.name}: {raw.strip()}")
                return v

            return category

        def number(raw: str) -> float | None:
            if raw.strip() == "?" and f.metadata.get("missing"):
                return None
            try:
                return float(raw)
            except ValueError:
                raise ValueError(f"no number for {f.name}: {raw.strip()}") from None

        return number

    if layout == "sparse":

        def sparse(line: str) -> list:
            y, *pairs = line.split()
            row = [0.0] * n
            for p in pairs:
                i, _, v = p.partition(":")
                row[int(i) - 1] = float(v)
            return [y, *row]

        return sparse
    kinds = [typed(f) for f in schema.fields]
    if layout == "fixed":
        ends = [sum(f.metadata["width"] for f in schema.fields[: i + 1]) for i in range(len(kinds))]
        return lambda line: [k(line[a:b]) for k, a, b in zip(kinds, [0, *ends], ends)]

    def delimited(line: str) -> list:
        parts = line.split(",")
        if len(parts) != len(kinds):
            raise ValueError(f"expected {len(kinds)} values: {line}")
        return [k(p) for k, p in zip(kinds, parts, strict=True)]

    return delimited


class DeclaredReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.schema = options, schema

    def partitions(self) -> list[ByteRange]:
        system, path = _opened(self.options["path"])
        info = system.get_file_info(path)
        inside = lambda x: x.path.removeprefix(path).strip("/").split("/")
        # what a writer has not committed waits in a folder whose name begins with a line
        files = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in inside(x))]
        root = self.options["path"].removesuffix("/")
        step = int(self.options.get("bytes", RANGE))
        full = lambda x: root + x.path.removeprefix(path.removesuffix("/"))
        return [ByteRange(full(x), a, min(a + step, x.size)) for x in sorted(files, key=lambda x: x.path) for a in range(0, x.size, step)] or [ByteRange(root, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        parse, held = parser(self.options.get("layout", "delimited"), self.schema, int(self.options.get("n", 0))), []
        kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.float64() for f in self.schema.fields]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=self.schema.fieldNames())

        for line in lines_of(partition.path, partition.start, partition.end):
            if line.strip():
                held.append(parse(line))
            if len(held) >= BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    file: str


class DeclaredWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.options, self.schema, self.overwrite = options, schema, overwrite
        self.table = options["path"].removesuffix("/")
        self.waiting = f"{self.table}/_waiting-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, folder = _opened(self.waiting)
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.pdata"
        text = lambda v: "?" if v is None else f"{v:.17g}" if isinstance(v, float) else str(v)
        widths = [f.metadata.get("width") for f in self.schema.fields] if self.options.get("layout") == "fixed" else None
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                if self.options.get("layout") == "sparse":
                    line = " ".join([str(row[0]), *(f"{i}:{v:.17g}" for i, v in enumerate(row[1:], 1) if v)])
                elif widths:
                    line = "".join(text(v).rjust(w) for v, w in zip(row, widths, strict=True))
                else:
                    line = ",".join(map(text, row))
                out.write(line.encode() + b"\n")
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.waiting)
        _, table = _opened(self.table)
        mine = {m.file for m in messages if m}
        old = [x.path for x in system.get_file_info(fs.FileSelector(table, allow_not_found=True)) if x.type == fs.FileType.File]
        for name in sorted(mine):
            system.move(f"{folder}/{name}", f"{table}/{name}")
        if self.overwrite:
            for path in old:
                system.delete_file(path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = _opened(self.waiting)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class DeclaredSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "declared"

    def schema(self) -> T.StructType:
        if self.options.get("layout") == "sparse":
            return T.StructType([T.StructField("class", T.StringType()), *(T.StructField(f"a_{i}", T.DoubleType()) for i in range(1, int(self.options["n"]) + 1))])
        text = self.options.get("declaration")
        if text is None:
            system, path = _opened(self.options["meta"])
            with system.open_input_stream(path) as f:
                text = f.read().decode()
        return parse_pmeta(text)

    def reader(self, schema: T.StructType) -> DeclaredReader:
        # Spark hands on names and types only; domains and widths are the declaration's
        return DeclaredReader(dict(self.options), self.schema())

    def writer(self, schema: T.StructType, overwrite: bool) -> DeclaredWriter:
        declared = self.schema() if {"declaration", "meta"} & set(self.options) else schema
        return DeclaredWriter(dict(self.options), declared, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(DeclaredSource)
