"""A Spark data source for records of binary matrices: HDF5 datasets of a group, or the struct of a MAT file.

    records.use(spark)
    spark.read.format("records").option("layout", "hdf5").option("group", "rec").load(folder)
    df.write.format("records").option("layout", "mat").mode("overwrite").save(folder)

A row is the k-th entry of every field. Vectors are numbers, matrices arrays, matrices
of bytes text padded with blanks, which reading takes off at both ends; a field of one
entry holds for all rows. Fields that a given schema leaves out are not read.

A read plans SPLIT_BYTES of a file a task at most: HDF5 is read by ranges of rows, so
that a task opens the bytes or chunks of its own; a MAT struct is deflated as a whole
and is one task a file, so writers keep files at ROWS rows. A write goes to a folder of
its own; when all tasks have ended, the driver moves the files that they report to
their places, and where one has failed for good it removes the folder, so that nothing
of it is seen. A repeated or lost task leaves files that no report names. The folder is
open while it has a file of the driver's; a task that outlives the write finds it closed.

Null text is written as empty, an empty one as a blank; a null number is NaN, and an
error in a field of integers; arrays of a field have one length. Files are reached
through Arrow, by path or URI.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from threading import Lock
from weakref import WeakSet

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from skeinwork.sources import hdf5, mat5

SPLIT_BYTES, ROWS, BATCH = 32 << 20, 100_000, 8192
ENDING = {"hdf5": ".h5", "mat": ".mat"}
#: The file of a folder that tasks may write into, and how often it is tried to remove one.
OPEN, TRIES = "_open", 9
BLANKS = " \t\r\n"
TYPES = {"f8": DoubleType(), "f4": FloatType(), "i8": LongType(), "i4": IntegerType(), "i2": ShortType(), "i1": ByteType(), "u1": ShortType(), "u2": IntegerType(), "u4": LongType()}


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, layout: str) -> list[fs.FileInfo]:
    """The files of a folder that are in place, or the file itself."""
    system, root = located(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(ENDING[layout])), key=lambda f: f.path)


def kind_of(dtype: np.dtype, lines: int, text: bool) -> DataType:
    if text:
        return StringType()
    own = TYPES[dtype.str[1:]]
    return own if lines == 1 else ArrayType(own)


@dataclass
class Slice(InputPartition):
    path: str
    part: int
    parts: int


class Fields:
    """The fields of one file by name: their types, and ranges of their rows."""

    def __init__(self, system: fs.FileSystem, path: str, layout: str, group: str) -> None:
        self.file = system.open_input_file(path)
        self.layout = layout
        self.found = hdf5.datasets(self.read, group) if layout == "hdf5" else mat5.columns(self.file.read(), group)

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def types(self) -> StructType:
        out = StructType()
        for name, d in self.found.items():
            if isinstance(d, hdf5.Dataset):
                out.add(name, kind_of(d.dtype, int(np.prod(d.shape[:-1])), d.dtype == np.uint8))
            else:
                out.add(name, StringType() if isinstance(d, list) else kind_of(d.dtype, 1 if d.ndim == 1 else d.shape[1], False))
        return out

    def length(self, names: Sequence[str]) -> int:
        """Rows that the fields have; those of one entry go with any."""
        sizes = {n: self.found[n].rows if self.layout == "hdf5" else len(self.found[n]) for n in names}
        most = max(sizes.values(), default=0)
        if any(s not in (1, most) for s in sizes.values()):
            raise ValueError(f"fields differ in length: {sizes}")
        return most

    def rows(self, name: str, low: int, high: int, kind: pa.DataType) -> pa.Array:
        d = self.found[name]
        single = (d.rows if self.layout == "hdf5" else len(d)) == 1
        a, b = (0, 1) if single else (low, high)
        values = hdf5.rows_of(self.read, d, a, b) if self.layout == "hdf5" else d[a:b]
        if isinstance(values, np.ndarray) and pa.types.is_string(kind):
            values = [bytes(r).decode().strip(BLANKS) for r in np.ascontiguousarray(values)]
        elif isinstance(values, np.ndarray) and pa.types.is_list(kind):
            values = list(values.reshape(b - a, -1))
        elif isinstance(values, np.ndarray):
            values = values.reshape(-1)
            values = values.astype(values.dtype.newbyteorder("="))
        else:
            values = [v.strip(BLANKS) for v in values]
        return pa.array(list(values) * (high - low) if single else values, kind)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.layout, self.group, self.split = options["path"], options.get("layout", "hdf5"), options.get("group", "rec"), int(options.get("split", SPLIT_BYTES))
        self.schema = schema

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for f in listed(self.path, self.layout):
            parts = -(-f.size // self.split) if self.layout == "hdf5" else 1
            out += [Slice(f.path, k, parts) for k in range(parts)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Slice):  # a folder without files has no partitions of its own
            return
        fields = Fields(located(self.path)[0], partition.path, self.layout, self.group)
        arrow = to_arrow_schema(self.schema)
        n = fields.length(arrow.names)
        low, high = (n * (partition.part + k) // partition.parts for k in (0, 1))
        for a in range(low, high, BATCH):
            b = min(a + BATCH, high)
            yield pa.RecordBatch.from_arrays([fields.rows(f.name, a, b, f.type) for f in arrow], schema=arrow)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.layout, self.group, self.size = options["path"], options.get("layout", "hdf5"), options.get("group", "rec"), int(options.get("rows", ROWS))
        self.overwrite, self.pending = overwrite, f"_pending-{uuid.uuid4().hex}"

    def begin(self) -> None:
        """Make the folder, once and before any task: one that a task makes could come after its removal."""
        system, root = located(self.path)
        system.create_dir(f"{root}/{self.pending}")
        with system.open_output_stream(f"{root}/{self.pending}/{OPEN}"):
            pass

    def column(self, x: pa.ChunkedArray, name: str) -> np.ndarray | list[str]:
        x = x.combine_chunks()
        if pa.types.is_string(x.type) or pa.types.is_large_string(x.type):
            texts = x.fill_null("").to_pylist()
            if self.layout == "mat":
                return texts
            raw = [t.encode() for t in texts]
            width = max(1, *map(len, raw))
            return np.frombuffer(b"".join(t.ljust(width) for t in raw), np.uint8).reshape(-1, width)
        if pa.types.is_list(x.type):
            rows = x.to_pylist()
            if len({-1 if r is None else len(r) for r in rows}) > 1 or rows[0] is None:
                raise ValueError(f"{name}: arrays of one field have one length")
            return np.array(rows, x.type.value_type.to_pandas_dtype()).reshape(len(rows), -1)
        if x.null_count and not pa.types.is_floating(x.type):
            raise ValueError(f"{name}: a null among integers")
        if not (pa.types.is_integer(x.type) or pa.types.is_floating(x.type)):
            raise ValueError(f"{name}: fields of {x.type} have no place in a matrix")
        return x.to_numpy(zero_copy_only=False)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = located(self.path)
        names: list[str] = []
        held: list[pa.RecordBatch] = []

        def put() -> None:
            table = pa.Table.from_batches(held)
            fields = {n: self.column(table[n], n) for n in table.column_names}
            name = f"part-{uuid.uuid4().hex}{ENDING[self.layout]}"
            with system.open_output_stream(f"{root}/{self.pending}/{name}") as out:
                out.write((hdf5 if self.layout == "hdf5" else mat5).written(self.group, fields))
            if system.get_file_info(f"{root}/{self.pending}/{OPEN}").type != fs.FileType.File:  # stores make a file's folder with it
                self.abort([])
                raise OSError(f"{self.path}: the write that this task belongs to has ended")
            names.append(name)

        for batch in iterator:
            while batch.num_rows:
                room = self.size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == self.size:
                    put()
                    held.clear()
        if held:
            put()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        system.create_dir(root)
        before = [f.path for f in listed(self.path, self.layout)] if self.overwrite else []
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{root}/{self.pending}/{name}", f"{root}/{name}")
        for path in before:
            system.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        folder = f"{root}/{self.pending}"
        for k in range(TRIES):
            if system.get_file_info(folder).type != fs.FileType.Directory:
                return
            try:
                if system.get_file_info(f"{folder}/{OPEN}").type == fs.FileType.File:
                    system.delete_file(f"{folder}/{OPEN}")
                system.delete_dir(folder)
            except OSError:  # a task is putting a file there, or removes the folder too
                if k == TRIES - 1:
                    raise
                time.sleep(0.1 * k)


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> StructType:
        layout = self.options.get("layout", "hdf5")
        found = listed(self.options["path"], layout)
        if not found:
            raise FileNotFoundError(f"no {ENDING[layout]} file in {self.options['path']}; state a schema")
        return Fields(located(self.options["path"])[0], found[0].path, layout, self.options.get("group", "rec")).types()

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        out = RecordWriter(self.options, overwrite)
        out.begin()
        return out


_USED: WeakSet[SparkSession] = WeakSet()
_USING = Lock()


def use(spark: SparkSession) -> None:
    """Make the format known to a session, once. Spark looks formats up in a thread's active session, which a thread of Python's own has not."""
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    with _USING:
        if spark not in _USED:
            spark.dataSource.register(Records)
            _USED.add(spark)
