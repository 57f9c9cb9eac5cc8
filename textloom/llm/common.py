"""Shared pieces of the training-data operators: scratch tables, word rules, Arrow mappers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: A word, in every contract of this subpackage. ``bytes.split()`` cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Documents that one step of a mapper holds as Python objects; Arrow batches are cut to this many rows.
STEP_ROWS = 512

_local_scratch: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on a local master without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_scratch:
        _local_scratch.append(f"file://{tempfile.mkdtemp(prefix='textloom-')}")
    return _local_scratch[0]


#: Folders with tables that returned frames read, and how to delete each.
_kept: dict[str, Callable[[], None]] = {}


def drop_kept() -> None:
    """Deletes the tables that frames returned so far read. For long-lived drivers, once results are written; else it happens at exit."""
    for path in list(_kept):
        _kept.pop(path)()


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone; it deletes the folders itself when it ends
        drop_kept()


atexit.register(_at_exit)


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor is recomputed from them.

    Tables from :meth:`keep` live until :func:`drop_kept` or the end of the process, as a returned frame reads
    them, also if the session was stopped before; those from :meth:`save` go when the ``with`` block ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/textloom/{uuid.uuid4().hex}"
        self.made: list[str] = []
        self.n = 0
        # These outlive the session, which the process may stop before it ends.
        self._path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.base).getFileSystem(conf)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.drop()

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _write(self, df: DataFrame, label: str) -> tuple[str, DataFrame]:
        path = f"{self.base}/{self.n}-{label}"
        self.n += 1
        df.write.parquet(path)
        self._fs.deleteOnExit(self._path(self.base))
        return path, self.spark.read.schema(df.schema).parquet(path)

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path, out = self._write(df, label)
        self.made.append(path)
        return out

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        _, out = self._write(df, label)
        _kept[self.base] = lambda: self._delete(self.base)
        return out

    def drop(self) -> None:
        """Deletes what :meth:`save` has made so far, and the folder if nothing else is in it."""
        for path in self.made if self.base in _kept else [self.base]:
            self._delete(path)
        self.made = []


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is written meanwhile: texts of a batch are held by the JVM and by Python, both outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names; others never travel."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def id_type(docs: DataFrame, id_col: str) -> T.DataType:
    return docs.schema[id_col].dataType


def arrow_steps(batches: Iterator[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that the Python objects of few documents live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(row: Callable[..., tuple], schema: pa.Schema, inputs: tuple[str, ...], as_bytes: bool) -> Callable:
    """A ``mapInArrow`` function that gives one output row for each input row.

    ``row`` gets the values of ``inputs`` (texts as UTF-8 bytes if ``as_bytes``, null as empty)
    and returns the columns of ``schema`` after the first, which is doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_steps(batches):
            texts = part.column("text")
            values = [(texts.cast(pa.binary()) if as_bytes else texts).to_pylist()]
            values += [part.column(c).to_pylist() for c in inputs]
            empty = b"" if as_bytes else ""
            made = [row(t if t is not None else empty, *rest) for t, *rest in zip(*values, strict=True)]
            columns = zip(*made, strict=True) if made else [[] for _ in schema.names[1:]]
            arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(schema.field(0).type), *arrays], schema=schema)

    return run


def arrow_schema(first: T.DataType, **rest: pa.DataType) -> pa.Schema:
    """doc_id of the input's own type, then the named columns."""
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("doc_id", to_arrow_type(first)), *rest.items()])


def spark_schema(schema: pa.Schema) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)
