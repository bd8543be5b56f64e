"""Array files (.npy) as a table, a row a file: path, dtype, shape and data as bytes, row after row.
A file's data is one value, of 2 GB at most."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.staging import StagedWriter, Written, listed, opened

ARRAYS = "path string, dtype string, shape array<int>, data binary"
#: Bytes of files that a task reads, about.
PART = 64 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class ArrayReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.root = schema.names, options["path"]

    def partitions(self) -> list[InputPartition]:
        _, scheme, found = listed(self.root, ".npy")
        out, some, size = [], [], 0
        for info in found:
            some, size = [*some, scheme + info.path], size + info.size + PART // 1000
            if size >= PART:
                out.append(Files(some))
                some, size = [], 0
        return [*out, *([Files(some)] if some else [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            files, at = opened(path)
            with files.open_input_stream(at) as stream:
                if "data" in self.columns:
                    own = np.load(io.BytesIO(stream.read()), allow_pickle=False)
                    row = {"dtype": own.dtype.str, "shape": list(own.shape), "data": own.tobytes()}
                else:  # the header alone
                    head = io.BytesIO(stream.read(4096))
                    version = np.lib.format.read_magic(head)
                    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                    shape, _, dtype = read(head)
                    row = {"dtype": dtype.str, "shape": list(shape)}
            row["path"] = path
            yield tuple(row[c] for c in self.columns)


class ArrayWriter(StagedWriter):
    def write(self, iterator: Iterator) -> Written:
        files, at, stage = self.stage()
        done: list[tuple[str, str]] = []
        for row in iterator:
            to = f"{stage}/{len(done)}.npy"
            with files.open_output_stream(to) as out:
                made = io.BytesIO()
                np.save(made, np.frombuffer(bytes(row.data), row.dtype).reshape(row.shape), allow_pickle=False)
                out.write(made.getvalue())
            done.append((to, f"{at}/{row.path}"))
        return Written(done)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return ARRAYS

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], overwrite)


def arrays(spark: SparkSession, root: str, columns: str = ARRAYS) -> DataFrame:
    """The array files below a folder; without ``data`` among the columns, from headers alone."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("npy").schema(columns).load(root)


def write(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """A file below a folder for each row (path: relative, dtype, shape, data)."""
    rows.sparkSession.dataSource.register(ArraySource)
    rows.select("path", "dtype", "shape", "data").write.format("npy").mode("overwrite" if overwrite else "append").save(root)


def packed(values: DataFrame, column: str, dtype: str, name: str = "data") -> DataFrame:
    """A column of numbers as an array's bytes; nulls are not a number."""
    others = [c for c in values.columns if c != column]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*others).schema)

    def run(frames):
        for frame in frames:
            yield frame[others].assign(**{name: [np.array(v, dtype).tobytes() for v in frame[column]]})

    return values.select(*others, column).mapInPandas(run, f"{kinds}, {name} binary")


def unpacked(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and values, an array of numbers, of each row (dtype, data)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(frames):
        for frame in frames:
            yield frame[keep].assign(values=[np.frombuffer(d, t).astype(float) for d, t in zip(frame["data"], frame["dtype"], strict=True)])

    return rows.select(*dict.fromkeys([*keep, "dtype", "data"])).mapInPandas(run, f"{kinds}, values array<double>")
