"""Inputs of the registered queries, derived by Spark from the given tables.

Whole tables and whole texts throughout. Variation that the tables lack comes
from what the texts hold: junk marks (``#``, ``|``, ``@``) stand for failed or
blank rows, the language picks an output format, vowels become ideographs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import text as X
from glossaflow.operators.cache import path_index
from glossaflow.sources.ordering import file_counts, ingest, overlapping, spread
from glossaflow.sources.scratch import at_place, scratch_path

VOWELS, IDEOGRAPHS = "aeiou", "天气很好的"
FOLDER = "/audio"


def has(c: Column, mark: str) -> Column:
    return F.contains(c, F.lit(mark))


def ideographs(c: Column) -> Column:
    """Mixed-script text: brings ideographs into every row."""
    return F.translate(c, VOWELS, IDEOGRAPHS)


_stored: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, d: str, name: str, write) -> DataFrame:
    """A derived table, written to the shared folder once per application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        write(path)
        _stored[key] = path
    return at_place(spark.read.parquet(_stored[key]), _stored[key])


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table with ``row_idx``, ingested once: positions stored, files of bounded size."""
    return _once(spark, d, name, lambda out: ingest(spark, f"{d}/{name}.parquet", out))


def slice_of(spark: SparkSession, d: str, name: str, start: int, stop: int) -> DataFrame:
    """The files of a given table that hold positions ``start`` up to ``stop``."""
    table = source(spark, d, name)
    files = _once(spark, d, f"{name}-files", lambda out: file_counts(table).write.parquet(out))
    paths, _ = overlapping(files, start, stop)
    return spark.read.schema(table.schema).parquet(*paths) if paths else table.limit(0)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return source(spark, d, "documents")


def pairs(spark: SparkSession, d: str, mixed: bool = True) -> DataFrame:
    """Stored prediction rows of every document, as a prediction run leaves them.

    They need no positions, so they are made from the given table as it is scanned;
    both long texts are alike, which zstd makes use of.
    """
    def write(out: str) -> None:
        rows = _pairs(spread(spark.read.parquet(f"{d}/documents.parquet")), mixed)
        rows.write.option("compression", "zstd").parquet(out)

    return _once(spark, d, "pairs-mixed" if mixed else "pairs", write)


def _pairs(docs: DataFrame, mixed: bool) -> DataFrame:
    """Words of three letters are missed, one syllable is misheard."""
    ref = ideographs(F.col("text")) if mixed else F.col("text")
    heard = F.filter(F.split("reference", " "), lambda w: F.length(w) != 3)
    said, misheard = ("t很好n", "c很好n") if mixed else ("tion", "cion")
    prediction = F.replace(F.array_join(heard, " "), F.lit(said), F.lit(misheard))
    status = (
        F.when(has(F.col("text"), "|"), "OOM")
        .when(has(F.col("text"), "#"), "ERR:decode").otherwise("ok")
    )
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("system"),
        "lang",
        X.media_path(FOLDER, F.col("doc_id")).alias("audio"),
        ref.alias("reference"),
        status.alias("status"),
        (F.length("text") / F.lit(1000.0)).alias("latency_s"),
    )
    kept = F.when(F.col("status") == "ok", prediction).otherwise("")
    return rows.withColumn("prediction", kept)


def raw_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Undecorated model answers, formatted by language."""
    p = F.col("text")
    answer = (
        F.when(F.col("lang") == "en", F.concat(
            F.lit("Transcription: "), F.col("source"),
            F.lit("\n  TRANSLATION: "), p, F.lit(" 父 <|im_end|>")))
        .when(F.col("lang") == "fr", F.concat(p, F.lit("<|endoftext|>⽗ \n ")))
        .when(F.col("lang") == "de", F.concat(F.lit("　"), p))
        .otherwise(p)
    )
    return documents(spark, d).select(
        F.col("doc_id").alias("id"), answer.alias("answer")
    )


def corpus(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Corpus rows; documents with junk marks have a blank translation."""
    junk = has(F.col("text"), "@") | has(F.col("text"), "#") | has(F.col("text"), "|")
    return (documents(spark, d) if rows is None else rows).select(
        "row_idx",
        F.col("text").alias("sentence"),
        F.when(junk, F.lit(" \n")).otherwise(ideographs(F.col("text"))).alias("translation"),
    )


def asr(spark: SparkSession, d: str) -> DataFrame:
    """ASR rows; a side is blank or absent, and ``idx`` absent, by content."""
    text = F.col("text")
    return documents(spark, d).select(
        "row_idx",
        F.when(F.col("lang") != "es", F.col("row_idx") + 1).alias("idx"),
        F.when(has(text, "@"), F.lit(None)).when(has(text, "#"), "  ").otherwise(text).alias("pred_zh"),
        F.when(has(text, "|"), "").otherwise(ideographs(text)).alias("ref_zh"),
        F.col("source").alias("shard"),
    )


def chunks(spark: SparkSession, d: str) -> list[DataFrame]:
    """Prediction files of three field conventions, told apart by language."""
    rows = pairs(spark, d)
    one = rows.filter("lang = 'en'").select(
        "id", "system", F.col("prediction").alias("pred_zh"), F.col("reference").alias("ref_zh"))
    two = rows.filter("lang IN ('de', 'fr')").select(
        "id", "system", F.col("prediction").alias("pred"), F.col("reference").alias("ref"))
    three = rows.filter("lang = 'es'").select(
        "id", "system", F.lit(" ").alias("pred_zh"), F.col("prediction").alias("pred"),
        F.lit(None).cast("string").alias("ref_zh"), F.col("reference").alias("ref"))
    return [one, two, three]


def media_items(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows; neighbours with one label share a media path."""
    path = F.concat(
        F.lit("/audio/"), F.col("label"), F.lit("/"),
        F.floor(F.col("row_idx") / 3), F.lit(".wav"))
    return source(spark, d, "embeddings").select(
        "row_idx", path.alias("audio_path"), "label",
        F.col("embedding").alias("features"),
        (62 + F.floor(F.col("label") / 2)).cast("int").alias("expected_len"),
    )


def split_items(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """Train and validation items; labels 4 and 5 are in both, 9 in neither."""
    items = media_items(spark, d)
    return [
        ("train", items.filter("label <= 5")),
        ("val", items.filter("label BETWEEN 4 AND 8")),
    ]


def split_indexes(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    return [(s, path_index(one)) for s, one in split_items(spark, d)]
