"""Streams that run until nothing is left to read, with their files in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_deletes: list = []


@atexit.register
def _at_exit() -> None:
    for delete in _deletes:
        with contextlib.suppress(Exception):  # the JVM may be gone; it deletes the folders itself when it ends
            delete()


def at_exit(delete: Callable[[], object]) -> None:
    """Runs when the process ends; failures don't matter then."""
    _deletes.append(delete)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, deleted when the process ends; on a local master without the setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(f"file://{tempfile.mkdtemp(prefix='textloom-')}")
        base = _local[0]
    folder = f"{base}/textloom/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    at_exit(lambda: files.delete(path, True))
    return folder


STORE = "spark.sql.streaming.stateStore.providerClass"
#: The store that timers and maps of keyed state need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in the store that :data:`ROCKS` names."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def finish(stream: DataFrame, folder: str, seconds: int | None = None) -> DataFrame:
    """Runs a stream over all that its sources hold, to a table below ``folder``, and gives that table; run again, it goes on from its checkpoint.

    It takes the time that its rows take, unless ``seconds`` says that it must end before.
    """
    spark = stream.sparkSession
    with keyed_state(spark):
        query = (
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        )
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream didn't end within {seconds} seconds")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


#: Bytes of a table, as its files hold it, for which an arrival gets one file.
ARRIVAL_BYTES = 16 << 20


def files_for(table: DataFrame) -> int:
    """Files of each arrival of a table that is read from files."""
    return max(1, -(-int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // ARRIVAL_BYTES))


def arrivals(parts: list[DataFrame], folder: str, label: str, files: int = 1) -> DataFrame:
    """A stream that reads each of ``parts``, which share a schema, as a batch of its own, in order.

    A part is written as ``files`` files and a batch reads as many. A part of fewer rows has fewer files, and shares its batch with the start of the next one.
    """
    spark = parts[0].sparkSession
    for i, part in enumerate(parts):
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(f"{folder}/{label}/{i:04}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{label}/*")
