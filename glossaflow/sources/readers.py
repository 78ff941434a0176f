"""Readers for JSON Lines, JSON arrays, Parquet and Arrow corpora, and path indexes."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaflow.functions.text import is_blank, strip_ws
from glossaflow.sources import arrow_shards
from glossaflow.sources.ordering import decoded, file_counts, index_columnar, index_lines, overlapping

CHAT_SCHEMA = (
    "messages ARRAY<STRUCT<role: STRING, content: STRING>>, audios ARRAY<STRING>"
)
ASR_SCHEMA = "idx BIGINT, pred_zh STRING, ref_zh STRING"
PREDICTION_SCHEMA = (
    "id BIGINT, audio STRING, reference STRING, prediction STRING, "
    "status STRING, latency_s DOUBLE"
)
TEXT_PREDICTION_SCHEMA = (
    "idx BIGINT, src_en STRING, ref_zh STRING, pred_zh STRING, "
    "latency_sec DOUBLE, error STRING"
)
# Every field name prediction files of other systems use.
PAIR_SCHEMA = (
    "pred_zh STRING, pred STRING, ref_zh STRING, ref STRING, "
    "sentence_en_gt STRING, sentence_en STRING, src_en STRING, en STRING"
)


def named(spark: SparkSession, pattern: str) -> list[str]:
    """What a path or glob pattern names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in fs.globStatus(path) or []]


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob pattern names anything."""
    return bool(named(spark, pattern))


def resolve_inputs(spark: SparkSession, pattern: str) -> list[str]:
    """Inputs named by a glob pattern, or else by paths parted by white space.

    The glob itself is returned unexpanded; the scan lists it in parallel.
    """
    if exists(spark, pattern):
        return [pattern]
    paths = [p for p in pattern.split() if exists(spark, p)]
    if not paths:
        raise FileNotFoundError(f"no input matches {pattern!r}")
    return paths


def _lines(spark: SparkSession, paths: str | list[str], glob: str | None, separator: str | None = None) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if separator:
        reader = reader.option("lineSep", separator)
    return reader.text(paths)


def _placed(lines: DataFrame, on_blank: str) -> DataFrame:
    """Lines that take a position, with their file and split."""
    if on_blank not in ("skip", "fail"):
        raise ValueError("on_blank is 'skip' or 'fail'")
    if on_blank == "skip":
        lines = lines.filter(~is_blank(F.col("value")))
    return lines.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), "value"
    )


def count_lines(
    spark: SparkSession, paths: str | list[str], on_blank: str = "skip", glob: str | None = None
) -> DataFrame:
    """Stored table of line files, the positions in each and before it, for ``read_jsonl(files=...)``."""
    lines = _lines(spark, paths, glob)
    return file_counts(lines.filter(~is_blank(F.col("value"))) if on_blank == "skip" else lines)


def read_jsonl(
    spark: SparkSession,
    paths: str | list[str],
    schema: str,
    on_blank: str = "skip",
    glob: str | None = None,
    required: Sequence[str] = (),
    rows: tuple[int, int] | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """One record per line, with ``row_idx`` and ``file`` in front.

    A record that lacks a ``required`` field, or holds null in it, stops the job.

    ``on_blank="skip"`` leaves blank lines out (they take no position);
    ``"fail"`` stops at them. A malformed line always stops the job.

    ``rows=(start, stop)`` keeps the positions from ``start`` up to ``stop`` and reads
    only the files that hold them, by the table ``files`` of :func:`count_lines`
    (counted here where none is kept).
    """
    value, base = F.col("value"), 0
    if rows is not None:
        files = count_lines(spark, paths, on_blank, glob) if files is None else files
        paths, base = overlapping(files, *rows)
        if not paths:
            return spark.createDataFrame([], f"row_idx BIGINT, file STRING, {schema}")
        glob = None
    lines = index_lines(_placed(_lines(spark, paths, glob), on_blank))
    if rows is not None:
        lines = lines.withColumn("row_idx", F.col("row_idx") + base)
        lines = lines.filter((F.col("row_idx") >= rows[0]) & (F.col("row_idx") < rows[1]))
    # Only lines that do not begin and end like an object need stripping.
    bare = F.when(F.startswith(value, F.lit("{")) & F.endswith(value, F.lit("}")), value)
    parsed = F.from_json(F.coalesce(bare, strip_ws(value)), schema, {"mode": "FAILFAST"})

    def stop(message: str):
        return F.raise_error(F.concat(F.lit(message), decoded(F.col("uri"))))

    record = F.when(~is_blank(value), parsed).otherwise(stop("blank line in "))
    out = lines.select("row_idx", "file", "uri", record.alias("_r")).select("row_idx", "file", "uri", "_r.*")
    for name in required:
        out = out.withColumn(
            name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(stop(f"no {name} in a record of "))
        )
    return out.drop("uri")


def read_jsonl_dir(
    spark: SparkSession,
    folder: str,
    schema: str,
    glob: str = "*.jsonl",
    required: Sequence[str] = (),
    rows: tuple[int, int] | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """All line files of a folder whose name fits ``glob``, in path order.

    What :func:`write_jsonl` wrote is read with ``glob="*.json"``.
    """
    return read_jsonl(spark, folder, schema, glob=glob, required=required, rows=rows, files=files)


def read_chat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Chat records; the schema is given, so there is no inference pass."""
    return read_jsonl(spark, paths, CHAT_SCHEMA)


def read_predictions(
    spark: SparkSession, paths: str | list[str], schema: str = PREDICTION_SCHEMA
) -> DataFrame:
    """Prediction rows kept as JSON arrays, one array per file.

    An array file cannot be split, so its writer bounds the rows per file.
    """
    return (
        spark.read.schema(schema)
        .option("multiLine", True).option("mode", "FAILFAST")
        .json(paths)
    )


def read_corpus(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    split: str | None = None,
    rows: tuple[int, int] | None = None,
    files: DataFrame | None = None,
    format: str = "parquet",
) -> DataFrame:
    """Sharded corpus with ``row_idx``; shards count in name order.

    ``split`` picks the shards whose name contains ``-<split>-`` or starts with
    ``<split>-``. ``rows=(start, stop)`` keeps those positions and reads only the shards
    that hold them, by the table ``files`` of :func:`count_corpus` (counted here where
    none is kept). ``format`` is ``parquet`` or ``arrow`` (Arrow IPC, stream or file),
    whose record batches are counted and skipped one by one.
    """
    if format == "arrow":
        return arrow_shards.read(spark, path, columns, _of_split(split, "arrow"), rows)
    if format != "parquet":
        raise ValueError("format is 'parquet' or 'arrow'")
    scan = _corpus(spark, path, split)
    if rows is None:
        return index_columnar(scan, columns, files)
    files = file_counts(scan) if files is None else files
    paths, _ = overlapping(files, *rows)
    names = columns or scan.columns
    if not paths:
        empty = spark.createDataFrame([], scan.schema).select(*names)
        return empty.select(F.lit(0).cast("long").alias("row_idx"), *names)
    part = index_columnar(spark.read.schema(scan.schema).parquet(*paths), names, files)
    return part.filter((F.col("row_idx") >= rows[0]) & (F.col("row_idx") < rows[1]))


def count_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Stored table of a Parquet corpus's shards with their rows, from the footers."""
    return file_counts(_corpus(spark, path, split))


def _of_split(split: str | None, suffix: str) -> str:
    return f"{{*-,}}{split}-*.{suffix}" if split else f"*.{suffix}"


def _corpus(spark: SparkSession, path: str, split: str | None) -> DataFrame:
    reader = spark.read
    if split:
        reader = reader.option("pathGlobFilter", _of_split(split, "parquet"))
    return reader.parquet(path)


# One whole entry between two commas, with the object's brackets at either end.
_ENTRY = r'(?s)\A\s*\{?\s*("(?:[^"\\]|\\.)*+"\s*:\s*-?[0-9]+)\s*\}?\s*\z'
_NOTHING = r"\A\s*\{?\s*\}?\s*\z"
# The end of an entry: a quote that is no part of the string, and the number.
_CLOSES = r'(?s)(?<!\\)(?:\\\\)*"\s*:\s*-?[0-9]+\s*\}?\s*\z'


def read_path_index(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """Rows ``(audio_path, idx, split)`` of JSON objects ``{path: position}``.

    ``files`` maps a split name to the place of its objects, one object per file;
    splits whose place does not exist are left out, with a warning where none is left.

    Files are read in splits and cut at commas, so an object of any size is many rows
    from the start. A path that holds commas itself comes in pieces, which are put
    together again in file order. What is no entry stops the job.
    """
    found = {s: p for s, p in files.items() if exists(spark, p)}
    if not found:
        warnings.warn(f"no path index among {list(files.values())}: the cache is empty", stacklevel=2)
        return spark.createDataFrame([], "audio_path STRING, idx BIGINT, split STRING")
    rows = None
    for split, place in found.items():
        one = _entries(_lines(spark, place, None, ",")).withColumn("split", F.lit(split))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _entries(pieces: DataFrame) -> DataFrame:
    """``audio_path, idx`` of the entries that ``pieces`` (text between commas) make up."""
    value = F.col("value")
    placed = pieces.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mono"), "value",
    )
    whole = F.rlike(value, F.lit(_ENTRY))
    # An object without entries; between other pieces, such text is part of a path.
    cut = _joined(placed.filter(~whole)).filter(~F.rlike(value, F.lit(_NOTHING)))
    return _parsed(placed.filter(whole)).unionByName(_parsed(cut))


def _parsed(entries: DataFrame) -> DataFrame:
    entry = F.regexp_extract("value", _ENTRY, 1)
    known = F.when(entry != "", entry).otherwise(
        F.raise_error(F.concat(F.lit("no entry of a path index: "), F.left("value", F.lit(100))))
    )
    parsed = F.from_json(F.concat(F.lit("{"), known, F.lit("}")), "MAP<STRING, BIGINT>", {"mode": "FAILFAST"})
    return entries.select(F.explode(parsed).alias("audio_path", "idx"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Texts of entries that commas have cut: each begins behind the piece that ends another one.

    Pieces of one split are joined there. What a split begins or ends within an entry is
    at most one text at either end, and these few are joined in the order of the splits.
    """
    closes = F.rlike("value", F.lit(_CLOSES)).cast("int")

    def runs(rows: DataFrame, order: list[str], *by: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        numbered = rows.withColumn("_run", F.coalesce(F.sum("_closes").over(before), F.lit(0)))
        parts = F.array_sort(F.collect_list(F.struct(*order, "value")))
        return numbered.groupBy(*by, "_run").agg(
            F.array_join(F.transform(parts, lambda p: p["value"]), ",").alias("value"),
            F.max("_closes").alias("_closes"),
        )

    inside = runs(pieces.withColumn("_closes", closes), ["_mono"], "_file", "_start")
    # The first run may go on from the split before, the one that does not close goes on in the next.
    at_edge = (F.col("_run") == 0) | (F.col("_closes") == 0)
    across = runs(inside.filter(at_edge).withColumn("_place", F.col("_run")), ["_start", "_place"], "_file")
    return inside.filter(~at_edge).select("value").unionByName(across.select("value"))
