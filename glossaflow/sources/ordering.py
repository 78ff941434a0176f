"""Explicit row positions.

Files have an order and tables do not, so every reader attaches a dense
``row_idx`` that counts rows in (sorted path, position in file) order. It comes
from the position inside the file or split plus the number of rows before that
file or split. The rows themselves are never shuffled: they look up the offset of
their file or split by a 64-bit key, in a table of a few numbers per split that is
broadcast. Its size is bound by the list of files and splits, which the driver
holds, at many times that size, to plan any scan.

Offsets are prefix sums on two levels: runs of splits are summed side by side, and
only one total per run meets in one place. There is one plan for every size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaflow.sources.scratch import stored

# Runs that a table of counts is cut into; as many totals are added up by themselves.
RUNS = 128
# A scan is dealt anew where one of its tasks has more than so many times its share of the rows.
UNEVEN = 4
# Stored bytes per file of an ingested table, and the least that is worth a task.
FILE_BYTES, LEAST_FILE_BYTES = 32 << 20, 1 << 18


def decoded(path: Column) -> Column:
    """File path as plain text; the metadata column holds an encoded URI."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def prefix_sums(counts: DataFrame, *order: str, n: str = "_n") -> DataFrame:
    """``counts`` with ``_offset``: the sum of ``n`` over all rows before, by ``order``.

    The rows are ranged over ``RUNS`` runs and stored with the number of their run, so
    that later reads agree on it; the sum inside a run takes one task, and the totals
    of the runs, ``RUNS`` numbers, are added up on the driver.
    """
    ranged = counts.repartitionByRange(RUNS, *order).withColumn("_run", F.spark_partition_id())
    ranged = stored(ranged, "counts")
    totals = dict(ranged.groupBy("_run").agg(F.sum(n)).collect())
    before, total = [], 0
    for run in range(max(totals, default=-1) + 1):
        before.append(F.lit(total).cast("long"))
        total += totals.get(run) or 0
    earlier = Window.partitionBy("_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(n).over(earlier), F.lit(0))
    base = F.get(F.array(*before), F.col("_run")) if before else F.lit(0).cast("long")
    return ranged.withColumn("_offset", base + inside).drop("_run")


def _unique(table: DataFrame) -> DataFrame:
    """Stop where two splits share a key, instead of mixing their rows."""
    same = F.count("*").over(Window.partitionBy("_key"))
    key = F.when(same == 1, F.col("_key")).otherwise(F.raise_error(F.lit("two files share a 64-bit hash")))
    return table.withColumn("_key", key.cast("long"))


def file_counts(scan: DataFrame) -> DataFrame:
    """Stored table of a scan's files in path order: ``_file`` (URI), ``_path``, ``_n`` rows, ``_offset``.

    Of a Parquet scan it reads no data column: row counts come from the footers.
    """
    counts = (
        scan.select(F.col("_metadata.file_path").alias("_file"))
        .groupBy("_file").agg(F.count("*").alias("_n"))
        .withColumn("_path", decoded(F.col("_file")))
    )
    return stored(prefix_sums(counts, "_path"), "files")


def overlapping(files: DataFrame, start: int, stop: int) -> tuple[list[str], int]:
    """Paths of the files that hold positions ``start`` up to ``stop``, and the first one's offset.

    Only these are listed on the driver, as its plan of the scan does anyway.
    """
    inside = (F.col("_offset") < stop) & (F.col("_offset") + F.col("_n") > start) & (F.col("_n") > 0)
    found = files.filter(inside).select("_offset", "_path").orderBy("_offset").collect()
    # Readers take paths for glob patterns.
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["_path"]) for r in found]
    return paths, found[0]["_offset"] if found else 0


def index_columnar(scan: DataFrame, columns: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Prepend ``row_idx`` to a Parquet scan, using the row positions it records.

    ``files`` is the scan's table of :func:`file_counts`, where one is kept.
    """
    names = columns or scan.columns
    rows = scan.select(
        F.xxhash64("_metadata.file_path").alias("_key"),
        F.col("_metadata.row_index").alias("_pos"),
        *names,
    )
    if files is None and len(scan.inputFiles()) <= 1:
        return rows.select(F.col("_pos").alias("row_idx"), *names)
    files = file_counts(scan) if files is None else files
    offsets = _unique(files.select(F.xxhash64("_file").alias("_key"), "_offset"))
    return rows.join(F.broadcast(offsets), "_key").select(
        (F.col("_offset") + F.col("_pos")).alias("row_idx"), *names
    )


def _numbered(marked: DataFrame, counts: DataFrame, *order: str) -> DataFrame:
    """Rows with ``_key`` and ``_mono``, and their position from the counts of their split.

    Rows of a split are numbered one after the other, so a split needs only its first
    number and its row count. Both come from another run of the same scan: where that
    one cut the files differently, the job stops.
    """
    table = _unique(prefix_sums(counts, *order).withColumnRenamed("_n", "_rows"))
    place = F.col("_mono") - F.col("_first")
    known = (place >= 0) & (place < F.col("_rows"))
    position = F.when(known, F.col("_offset") + place).otherwise(
        F.raise_error(F.lit("files were split differently when their rows were counted"))
    )
    return marked.join(F.broadcast(table), "_key", "left").withColumn("_position", position.cast("long"))


def index_lines(lines: DataFrame) -> DataFrame:
    """``row_idx``, ``file``, ``uri`` and ``value`` of a text scan, after any row filter.

    ``lines`` holds ``_file`` (the URI), ``_start`` (of the split) and ``value``.
    """
    marked = lines.withColumn("_key", F.xxhash64("_file", "_start")).withColumn("_mono", F.monotonically_increasing_id())
    counts = (
        marked.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
        .select(F.xxhash64("_file", "_start").alias("_key"), decoded(F.col("_file")).alias("_path"), "_start", "_n", "_first")
    )
    rows = _numbered(marked.select("_key", "_mono", "_file", "value"), counts, "_path", "_start")
    return rows.select(
        F.col("_position").alias("row_idx"), F.col("_path").alias("file"), F.col("_file").alias("uri"), "value"
    )


def close_up(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    """Positions of filtered rows made dense again, in their order.

    ``rows`` come from one file scan through filters, projections and look-ups in
    broadcast tables, so splits still hold contiguous runs of them; the kept rows of
    each split are counted, and nothing is shuffled or written but those counts. Other
    rows (after a shuffle, or out of order over the splits) stop the job.
    """
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    marked = rows.withColumns({"_key": split, "_mono": F.monotonically_increasing_id()})
    found = marked.select("_key", "_mono", F.col(order).alias("_order")).groupBy("_key").agg(
        F.count("*").alias("_n"), F.min("_mono").alias("_first"), F.max("_mono").alias("_last"),
        F.min("_order").alias("_low"), F.max("_order").alias("_high"),
    )
    whole = F.col("_last") - F.col("_first") + 1 == F.col("_n")
    counts = found.withColumn("_n", F.when(whole, F.col("_n")).otherwise(
        F.raise_error(F.lit("rows do not come straight from one file scan"))
    ).cast("long"))
    numbered = _numbered(marked, counts, "_low")
    inside = F.col(order).between(F.col("_low"), F.col("_high"))
    position = F.when(inside, F.col("_position")).otherwise(F.raise_error(F.lit("rows changed between two reads")))
    return numbered.withColumn(order, position.cast("long")).select(*rows.columns)


def ingest(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Parquet table with a stored ``row_idx``, in files of bounded size, enough for all cores.

    Written once, read often: jobs that start from ``out`` need neither offsets
    nor a shuffle to fill the cluster, and filters on positions skip whole files.
    """
    scan = spark.read.parquet(path)
    parts = tasks_for(spark, _scan_bytes(scan))
    rows = index_columnar(scan)
    rows.repartitionByRange(parts, "row_idx").sortWithinPartitions("row_idx").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a Parquet scan, over enough tasks for their bytes.

    The scan's own tasks do where its row groups are even enough, and nothing is
    shuffled; row counts of its tasks come from the footers.
    """
    parts = tasks_for(scan.sparkSession, _scan_bytes(scan))
    rows = scan.groupBy(F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_n"))
    most, total = rows.agg(F.max("_n"), F.sum("_n")).first()
    if not total or most * parts <= UNEVEN * total:
        return scan
    # By position, so no key is frequent and a repeated task deals rows alike.
    return scan.select("*", F.col("_metadata.row_index").alias("_at")).repartition(parts, "_at").drop("_at")


def _scan_bytes(scan: DataFrame) -> int:
    return int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(spark: SparkSession, size: int) -> int:
    """Tasks for so many stored bytes: of bounded size, and enough for all cores where there is work."""
    cores = spark.sparkContext.defaultParallelism
    return max(-(-size // FILE_BYTES), min(2 * cores, -(-size // LEAST_FILE_BYTES)), 1)
