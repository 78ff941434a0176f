"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_held: set[str] = set()
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(cores: str | int = 8, app: str = "glossaflow") -> SparkSession:
    """Session for tests and single-machine runs. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder named in ``spark.checkpoint.dir``.

    What stands there when the application ends is deleted. Every executor must reach it, so a machine-local folder is used in local
    mode only, and only where the session names no folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _held.add(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder as it stands, and read back.

    Cuts the lineage of rows that are dear to compute: what follows may scan
    them twice (range partitioning samples its input) or lose an executor
    without computing them again. A table that is stored already is returned
    as it is. :func:`discard` deletes it; what is left goes with the application.
    """
    if df in _places:
        return df
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[back] = path
    return back


def at_place(table: DataFrame, path: str) -> DataFrame:
    """``table``, known as the whole of what is stored in ``path``: :func:`stored` does not copy it."""
    _places[table] = path
    return table


def stored_bytes(table: DataFrame) -> int:
    """Bytes that a table made by :func:`stored` takes."""
    at, fs = _location(table.sparkSession.sparkContext, _places[table])
    return fs.getContentSummary(at).getLength()


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored`."""
    for table in tables:
        path = _places.pop(table)
        _delete(table.sparkSession.sparkContext, path)


def _location(context: SparkContext, path: str):
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def _delete(context: SparkContext, path: str) -> None:
    at, fs = _location(context, path)
    fs.delete(at, True)
    _held.discard(path)


@atexit.register
def _delete_rest() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        for path in list(_held):
            _delete(context, path)
