"""Reading the corpus tables and running batch functions over them."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``_text``: the text as UTF-8 bytes, empty for null."""
    return docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))


def decoded(raw: bytes) -> str:
    """Text of UTF-8 bytes; malformed bytes become U+FFFD instead of failing the task."""
    return raw.decode("utf-8", "replace")


def release_memory() -> None:
    """Hands back what Python's and Arrow's allocators keep: workers live on between tasks,
    and several of them share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Batches) -> Batches:
    """A batch function that leaves no memory behind when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def map_texts(
    docs: DataFrame,
    keep: list[str],
    fields: list[pa.Field],
    start: Callable[[], Callable[[bytes], tuple]],
    text: str = "text",
) -> DataFrame:
    """One output row for each input row: ``keep`` and the values that a function gives for
    the text. ``start`` is called once a task, where it loads what the function needs."""
    source = text_bytes(docs, *keep, text=text)
    types = [pa.field(c, t) for c, t in zip(keep, arrow_types(docs, keep), strict=True)]
    schema = pa.schema([*types, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in batches:
            if not len(batch):
                continue
            rows = [of(raw.as_py()) for raw in batch.column(len(keep))]
            made = [pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return source.mapInArrow(lean(run), from_arrow_schema(schema))


def arrow_types(df: DataFrame, columns: list[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[c].dataType) for c in columns]


_open = threading.local()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where the
    setting is missing, a single machine (tests) gets a temporary folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    getattr(_open, "made", []).append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that this thread asks for within are deleted at the end. What is to last is
    written to a folder asked for before."""
    outer, _open.made = getattr(_open, "made", []), []
    try:
        yield
    finally:
        made, _open.made = _open.made, outer
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts its lineage:
    a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
