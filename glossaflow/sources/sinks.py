"""Writers. Output keeps row order: part names sort like the rows they hold.

Rows are stored as they are computed, once; their measured size gives the number of
tasks and files, and a lost executor repeats a copy at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.sources.ordering import tasks_for
from glossaflow.sources.scratch import discard, stored, stored_bytes


def _tasks(table: DataFrame) -> int:
    return tasks_for(table.sparkSession, stored_bytes(table))


def _release(table: DataFrame, given: DataFrame) -> None:
    if table is not given:
        discard(table)


def write_jsonl(df: DataFrame, path: str, order: str = "row_idx") -> None:
    """One JSON object per line, in ``order``; the order column is not written.

    Absent fields are left out of the objects. Positions are cut into equally long
    runs, one per file; rows without a position stand at the end of the last one.
    """
    table = stored(df, "rows")
    top = table.agg(F.max(order)).first()[0] or 0
    parts = _tasks(table)
    run = F.floor(F.col(order) / F.lit(top + 1) * parts).cast("int")
    part = F.coalesce(F.least(run, F.lit(parts - 1)), F.lit(parts - 1))
    (
        table.repartitionById(parts, part).sortWithinPartitions(F.col(order).asc_nulls_last()).drop(order)
        .write.mode("overwrite").json(path)
    )
    _release(table, df)


def _bracketed(begin: str, end: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines that make one JSON value of all items of a partition, streamed."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = begin
        for batch in batches:
            if not batch.num_rows:
                continue
            items = batch.column(0).cast(pa.large_string())
            leads = pa.array([lead] + [","] * (len(items) - 1), pa.large_string())
            joined = pc.binary_join_element_wise(leads, items, pa.scalar("", pa.large_string()))
            yield pa.RecordBatch.from_arrays([joined.cast(pa.string())], ["value"])
            lead = ","
        if lead == ",":
            yield pa.RecordBatch.from_arrays([pa.array([end])], ["value"])
    return lines


def _write_bracketed(df: DataFrame, path: str, order: str, item: Column, marks: str, compression: str = "none") -> None:
    table = stored(df, "rows")
    # The place in the stored table tells rows of one id, or of none, apart.
    key = F.col(order).asc_nulls_last(), F.col("_place").asc()
    ranged = (
        table.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(_tasks(table), *key).sortWithinPartitions(*key)
    )
    # Of gzip, the fastest level: lines of words shrink nearly as much by it.
    writer = ranged.select(item.alias("value")).mapInArrow(_bracketed(*marks), "value string").write.mode("overwrite")
    writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)
    _release(table, df)


def write_predictions(
    df: DataFrame, path: str, order: str = "id", columns: Sequence[str] | None = None, compression: str = "none"
) -> None:
    """Prediction rows as JSON arrays, one per file, in ``order``; rows without an id come last.

    An array is written as its rows pass by, a row to a line, so none is ever held
    whole. Files are bounded by their bytes, however many rows share an id or have none.

    ``columns`` are the fields of a row (all, if not given); a table that is stored
    already is not copied to leave some out. ``compression`` is that of Spark's text
    files: an array is read in one go, so ``gzip`` costs no split.
    """
    row = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    _write_bracketed(df, path, order, row, "[]", compression)


def write_report(df: DataFrame, path: str, by: str | None = None) -> None:
    """Metric rows as JSON with nulls kept; ``by`` makes one folder per system."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    if by:
        writer = writer.partitionBy(by)
    writer.json(path)


def write_sharded(df: DataFrame, path: str, shard: str = "shard", order: str = "row_idx") -> None:
    """One folder ``<shard>=<name>`` per input shard, from a single job.

    Rows are ranged over (shard, order), so a huge shard is written by many
    tasks, and small shards share one.
    """
    table = stored(df, "rows")
    (
        table.repartitionByRange(_tasks(table), shard, order).sortWithinPartitions(shard, order)
        .write.mode("overwrite").partitionBy(shard).json(path)
    )
    _release(table, df)


def write_path_index(index: DataFrame, path: str) -> None:
    """JSON objects ``{audio_path: idx}``, one per file, streamed and bounded by bytes."""
    entry = F.to_json(F.create_map("audio_path", "idx"))
    _write_bracketed(index, path, "idx", F.substring(entry, F.lit(2), F.length(entry) - 2), "{}")
