"""One callable ``(spark, sf_dir) -> DataFrame`` per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import frames as FR
from glossaflow.functions import records as R
from glossaflow.functions import text as X
from glossaflow.functions.pair_stats import TOKEN_FIELDS, stat_names
from glossaflow.operators import cache as C
from glossaflow.operators import metrics as M
from glossaflow.operators import rows as O
from glossaflow.operators.predict import batch_predict
from glossaflow.plans import datasets as D
from glossaflow.plans import feature_cache, prediction, reports
from glossaflow.sources import readers, sinks
from glossaflow.sources.ordering import close_up, index_columnar
from glossaflow.sources.scratch import scratch_path
from workload import views as V

SYSTEM = "You turn spoken English into written Chinese."
INSTRUCTION = "Give the Chinese text only."
PREFIX = "Put into Chinese: "


# -- predictors used by the prediction queries --------------------------------

def text_predictor():
    """Stand-in for a model on plain text: fails on junk marks."""
    def predict(text: str) -> str:
        if "#" in text:
            raise ValueError("decode")
        if "|" in text:
            raise MemoryError
        return text.replace("th", "d")
    return predict


def prompt_text_predictor():
    """The same on a structured prompt whose last part is a text."""
    predict = text_predictor()
    return lambda prompt: predict(prompt[-1]["content"][-1]["text"])


def clip_predictor():
    """Stand-in for a speech model: answers with the clip's name."""
    def predict(prompt) -> str:
        clip = prompt[-1]["content"][0]["audio"]
        if clip.endswith("7.wav"):
            raise RuntimeError(f"unreadable {clip}")
        return f" Transcription: {clip}\n Translation: 片{clip}\n父<|im_end|> "
    return predict


def clip_extractor():
    """Stand-in for an encoder: one frame per path part, failing on some clips."""
    def extract(path: str) -> list[list[float]]:
        if path.endswith("7.wav"):
            raise OSError("unreadable")
        return [[float(len(part))] for part in path.split("/")]
    return extract


def _digest(text: Column) -> Column:
    """A number that tells texts apart; sums of it tell sets of texts apart."""
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint")


def _flat(records: DataFrame, audio: bool = True) -> DataFrame:
    """Chat records as plain columns."""
    turn = lambda i: F.get("messages", F.lit(i))["content"]
    cols = [
        "row_idx", turn(0).alias("system_turn"), turn(1).alias("user_turn"),
        turn(2).alias("assistant_turn"), F.size("messages").cast("bigint").alias("n_turns"),
    ]
    if audio:
        cols.append(R.first_media(F.col("audios")).alias("audio"))
    return records.select(*cols)


def _speech(spark, d) -> DataFrame:
    return D.speech_records(V.corpus(spark, d), V.FOLDER, SYSTEM, INSTRUCTION)


def _kept_speech(spark, d) -> DataFrame:
    """Speech records as a file of them is read: positions closed up over skipped rows."""
    return close_up(_speech(spark, d))


# -- sources and sinks --------------------------------------------------------

def jsonl_dir_scan(spark, d):
    path = scratch_path(spark, "jsonl")
    rows = V.documents(spark, d).select("row_idx", "doc_id", "text", "lang")
    sinks.write_jsonl(rows, path)
    back = readers.read_jsonl_dir(spark, path, "doc_id BIGINT, text STRING, lang STRING", glob="*.json")
    return back.select("row_idx", "doc_id", "lang", F.md5("text").alias("text_md5"))


def predictions_scan(spark, d):
    path = scratch_path(spark, "predictions")
    fields = ["id", "audio", "reference", "prediction", "status", "latency_s"]
    sinks.write_predictions(V.pairs(spark, d), path, columns=fields, compression="gzip")
    return readers.read_predictions(spark, path).select(
        "id", "audio", F.md5("reference").alias("reference_md5"),
        F.md5("prediction").alias("prediction_md5"), "status", "latency_s",
    )


def chat_scan(spark, d):
    turns = V.source(spark, d, "conversations")
    return O.assemble_chats(turns).select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("contents"),
    )


def corpus_scan(spark, d):
    rows = readers.read_corpus(spark, f"{d}/documents.parquet", ["doc_id", "source", "text"])
    return rows.select("row_idx", "doc_id", "source", F.md5("text").alias("text_md5"))


def row_ordinal(spark, d):
    """Positions over the many files of the ingested table, stored ones aside."""
    return index_columnar(V.documents(spark, d), ["doc_id"])


def path_index_scan(spark, d):
    places = {}
    for split, index in V.split_indexes(spark, d):
        places[split] = scratch_path(spark, f"index-{split}")
        sinks.write_path_index(index, places[split])
    return readers.read_path_index(spark, places)


def shard_fanout(spark, d):
    path = scratch_path(spark, "shards")
    rows = prediction.predict_texts(
        V.asr(spark, d), prompt_text_predictor, SYSTEM, PREFIX, "row_idx", "shard"
    )
    sinks.write_sharded(sinks.stored(rows, "predicted"), path)
    back = spark.read.schema(readers.TEXT_PREDICTION_SCHEMA + ", row_idx BIGINT, shard STRING").json(path)
    return back.groupBy("shard").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("error") == "empty src/ref").alias("empty"),
        F.count_if(F.col("error") == "OOM").alias("oom"),
        F.sum(F.length("pred_zh").cast("bigint")).alias("pred_chars"),
        F.sum(_digest(F.col("pred_zh"))).alias("pred_digest"),
    )


def inputs_scan(spark, d):
    """Line files of two systems, found by one glob and by a list of places."""
    base = scratch_path(spark, "systems")
    rows = V.documents(spark, d).select("row_idx", "doc_id", "text", "lang")
    for lang in ("de", "fr"):
        sinks.write_jsonl(rows.filter(F.col("lang") == lang), f"{base}/{lang}")
    found = []
    for how, pattern in (("glob", f"{base}/*"), ("list", f"{base}/fr {base}/none {base}/de")):
        places = readers.resolve_inputs(spark, pattern)
        read = readers.read_jsonl(spark, places, "doc_id BIGINT, text STRING, lang STRING", glob="*.json")
        found.append(read.select(F.lit(how).alias("how"), "row_idx", "doc_id", F.md5("text").alias("text_md5")))
    return O.merge_chunks(found)


def report_files(spark, d):
    """One metrics object per system, written beside each other and read back."""
    path = scratch_path(spark, "reports")
    sinks.write_report(M.run_summary(V.pairs(spark, d), "system").withColumn("COMET", F.lit(None).cast("double")), path, by="system")
    schema = "total BIGINT, ok BIGINT, valid BIGINT, COMET DOUBLE, system STRING"
    return spark.read.schema(schema).json(path)


# -- text functions -----------------------------------------------------------

def _answers(spark, d, name, column):
    return V.raw_outputs(spark, d).select("id", column.alias(name))


def normalize_text(spark, d):
    return _answers(spark, d, "normalized", X.normalize_text(F.col("answer")))


def clean_prediction(spark, d):
    return _answers(spark, d, "cleaned", X.clean_prediction(F.col("answer")))


def extract_translation(spark, d):
    cleaned = X.clean_prediction(F.col("answer"))
    return _answers(spark, d, "translation", X.labelled_line(cleaned))


def tokenize_mixed(spark, d):
    docs = V.documents(spark, d)
    toks = docs.select("doc_id", X.tokenize_mixed(V.ideographs(F.col("text"))).alias("t"))
    return toks.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"),
        F.array_join("t", "|").alias("tokens"),
    )


def extract_entities(spark, d):
    docs = V.documents(spark, d)
    found = docs.select("doc_id", F.array_sort(X.entities(F.col("text"))).alias("e"))
    return found.select(
        "doc_id", F.size("e").cast("bigint").alias("n_entities"),
        F.array_join("e", "|").alias("entities"),
    )


def coalesce_fields(spark, d):
    merged = O.merge_chunks(V.chunks(spark, d))
    kept = O.coalesced_pairs(merged, ("pred_zh", "pred"), ("ref_zh", "ref"))
    return kept.select("id", "pred", "ref")


def merge_chunks(spark, d):
    merged = O.merge_chunks(V.chunks(spark, d))
    return merged.select("id", "system", *[
        column.alias(f"{c}_{kind}")
        for c in ("pred_zh", "pred", "ref_zh", "ref")
        for kind, column in (("chars", F.length(c).cast("bigint")), ("md5", F.md5(c)))
    ])


def url_parts(spark, d):
    pages = V.source(spark, d, "pages")
    return pages.select(
        "page_id", X.path_name(F.col("url")).alias("name"),
        X.path_stem(F.col("url")).alias("stem"), X.path_parent(F.col("url")).alias("parent"),
    )


# -- records ------------------------------------------------------------------

def speech_chat_records(spark, d):
    return _flat(_speech(spark, d))


def test_chat_records(spark, d):
    """Records of exactly the first rows (their number is the feature)."""
    corpus = V.corpus(spark, d, V.slice_of(spark, d, "documents", 0, 120))
    return _flat(D.test_records(corpus, 120, V.FOLDER, SYSTEM, INSTRUCTION))


def text_chat_records(spark, d):
    return _flat(D.text_records(V.asr(spark, d), SYSTEM, PREFIX), audio=False)


def two_step_records(spark, d):
    records = _kept_speech(spark, d)
    return _flat(D.two_step_records(records, V.corpus(spark, d), SYSTEM, INSTRUCTION))


def positional_join(spark, d):
    records = _kept_speech(spark, d)
    joined = O.positional_join(records, V.corpus(spark, d), "sentence")
    return joined.select(
        "row_idx", R.first_media(F.col("audios")).alias("audio"), "sentence"
    )


def keyed_join(spark, d):
    records = _kept_speech(spark, d)
    path = R.first_media(F.col("audios"))
    joined = O.keyed_join(records, V.corpus(spark, d), path, "sentence")
    return joined.select("row_idx", path.alias("audio"), "sentence")


def alignment_check(spark, d):
    return D.target_mismatches(_kept_speech(spark, d), V.corpus(spark, d))


def prompt_records(spark, d):
    docs = V.documents(spark, d)
    built = docs.select("doc_id", R.prompt(
        SYSTEM, F.concat(F.lit(PREFIX), X.normalize_text(F.col("text"))),
        X.media_path(V.FOLDER, F.col("doc_id")),
    ).alias("p"))
    parts = built.select("doc_id", F.posexplode("p").alias("turn", "m")).select(
        "doc_id", "turn", F.col("m.role").alias("role"),
        F.posexplode("m.content").alias("part", "c"),
    )
    return parts.select(
        "doc_id", F.col("turn").cast("bigint").alias("turn"), "role",
        F.col("part").cast("bigint").alias("part"), "c.type", "c.text", "c.audio",
    )


def last_assistant(spark, d):
    turns = V.source(spark, d, "conversations")
    return O.last_turn(turns, "assistant")


# -- prefixes and slices (their limits are the feature) -----------------------

def first_n_valid(spark, d):
    rows = O.first_n_valid(V.asr(spark, d), 100, "pred_zh", "ref_zh")
    return rows.select(
        "row_idx", X.normalize_text(F.col("pred_zh")).alias("src"),
        X.normalize_text(F.col("ref_zh")).alias("tgt"),
    )


def head_n(spark, d):
    rows = V.slice_of(spark, d, "documents", 0, 120).select("row_idx", "doc_id", "source")
    return O.head_n(rows, 120, strict=True)


def slice_n(spark, d):
    rows = V.slice_of(spark, d, "documents", 150, 250).select("row_idx", "doc_id", "source")
    return O.slice_n(rows, 150, 100)


# -- prediction ---------------------------------------------------------------

def batch_predict_query(spark, d):
    docs = V.documents(spark, d)
    out = batch_predict(docs, F.col("text"), text_predictor)
    return out.select("doc_id", "prediction", "status")


def asr_defaults(spark, d):
    rows = prediction.predict_texts(V.asr(spark, d), prompt_text_predictor, SYSTEM, PREFIX)
    return rows.select("idx", "src_en", "ref_zh", "pred_zh", "error")


def prediction_job(spark, d):
    rows = prediction.predict_chats(
        _speech(spark, d), clip_predictor, SYSTEM, INSTRUCTION
    )
    return rows.select("id", "audio", "reference", "prediction", "status")


def valid_predictions(spark, d):
    return O.valid_predictions(V.pairs(spark, d)).select("id", "system", "prediction")


def run_summary(spark, d):
    return M.run_summary(V.pairs(spark, d), "system")


def latency_summary(spark, d):
    return M.latency_summary(V.pairs(spark, d), "system")


def status_counts(spark, d):
    return M.status_counts(V.pairs(spark, d))


# -- evaluation ---------------------------------------------------------------

def _valid(spark, d, mixed=True):
    return O.valid_predictions(V.pairs(spark, d, mixed))


def char_ngram_stats(spark, d):
    rows = M.with_stats(_valid(spark, d), tokens=False)
    return rows.select("id", *[F.col(f"st.{n}").alias(n) for n in stat_names()])


def token_counts(spark, d):
    docs = V.documents(spark, d).withColumn("text", V.ideographs(F.col("text")))
    return M.token_counts(docs, "doc_id", "text")


def token_overlap(spark, d):
    rows = M.with_stats(_valid(spark, d), order=0)
    counts = rows.select("id", *[F.col(f"st.{n}").alias(n) for n in TOKEN_FIELDS])
    return counts.filter("pred_tokens > 0 AND ref_tokens > 0")


def hallucination_coverage(spark, d):
    return M.hallucination_coverage(_valid(spark, d), "system")


def chrf_corpus(spark, d):
    return M.corpus_chrf(_valid(spark, d), "system")


def bleu_corpus(spark, d):
    return M.corpus_bleu(_valid(spark, d), "system")


def entity_accuracy(spark, d):
    return M.entity_accuracy(_valid(spark, d, mixed=False), "system")


def entity_retention(spark, d):
    return M.entity_retention(_valid(spark, d, mixed=False), "system")


def entity_report(spark, d):
    return reports.entity_report(V.pairs(spark, d, mixed=False))


def intrinsic_report(spark, d):
    return reports.intrinsic_report(V.pairs(spark, d), source="pairs")


def system_report(spark, d):
    named = [c.withColumn("file", F.lit(f"chunk{k}.jsonl")) for k, c in enumerate(V.chunks(spark, d))]
    report = reports.system_report(O.merge_chunks(named).withColumnRenamed("system", "model"))
    return report.withColumn("files", F.array_join("files", ","))


# -- feature cache ------------------------------------------------------------

def path_index(spark, d):
    return C.path_index(V.media_items(spark, d))


def merge_index(spark, d):
    return C.merge_index(V.split_indexes(spark, d))


def cache_lookup(spark, d):
    found = C.cache_lookup(V.media_items(spark, d), C.merge_index(V.split_indexes(spark, d)))
    return found.select("row_idx", "audio_path", "split", "idx", "hit")


def pending_items(spark, d):
    cache = C.merge_index(V.split_indexes(spark, d))
    return C.pending_items(V.media_items(spark, d), cache).select("row_idx", "audio_path")


def extract_pending(spark, d):
    cache = C.merge_index(V.split_indexes(spark, d))
    rows = feature_cache.extract_pending(V.media_items(spark, d), cache, clip_extractor)
    lengths = F.transform("features", lambda f: f[0].cast("int").cast("string"))
    return rows.select(
        "audio_path", "idx", "status", F.array_join(lengths, ",").alias("frames")
    )


def _values(rows: DataFrame, *keys: str) -> DataFrame:
    exploded = rows.select(*keys, F.posexplode("features").alias("pos", "v"))
    return exploded.select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("double").alias("value")
    )


def align_features(spark, d):
    rows = C.with_aligned(V.media_items(spark, d))
    return _values(rows, "row_idx", "adjustment")


def strip_padding(spark, d):
    mask = F.transform("features", lambda x: x > 0)
    rows = V.media_items(spark, d).withColumn("mask", mask)
    kept = rows.select(
        "row_idx", FR.valid_length(F.col("mask")).cast("bigint").alias("valid_length"),
        FR.strip_padding(F.col("features"), F.col("mask")).alias("features"),
    )
    return _values(kept, "row_idx", "valid_length")


def batch_concat(spark, d):
    rows = C.with_aligned(V.media_items(spark, d))
    return _values(C.batch_concat(rows, 32), "batch", "samples")


def _cached_features(spark, d) -> DataFrame:
    features = None
    for split, one in V.split_items(spark, d):
        rows = one.select(
            F.lit(split).alias("split"), F.col("row_idx").alias("idx"), "features"
        )
        features = rows if features is None else features.unionByName(rows)
    return features


def cache_audit(spark, d):
    return feature_cache.audit(
        V.media_items(spark, d).drop("features"), V.split_indexes(spark, d), _cached_features(spark, d), "label"
    )


def cached_batches(spark, d):
    """Batches of the items that are cached; the others would stop the job."""
    indexes = V.split_indexes(spark, d)
    known = C.merge_index(indexes).select("audio_path")
    items = V.media_items(spark, d).drop("features").join(known, "audio_path", "left_semi")
    return _values(feature_cache.cached_batches(items, indexes, _cached_features(spark, d), 32), "batch", "samples")


QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        jsonl_dir_scan, predictions_scan, chat_scan, corpus_scan, row_ordinal,
        path_index_scan, shard_fanout, inputs_scan, report_files, test_chat_records, normalize_text, clean_prediction,
        extract_translation, tokenize_mixed, extract_entities, coalesce_fields,
        merge_chunks, url_parts, speech_chat_records, text_chat_records,
        two_step_records, positional_join, keyed_join, alignment_check,
        prompt_records, last_assistant, first_n_valid, head_n, slice_n,
        batch_predict_query, asr_defaults, prediction_job, valid_predictions,
        run_summary, latency_summary, status_counts, char_ngram_stats,
        token_counts, token_overlap, hallucination_coverage, chrf_corpus,
        bleu_corpus, entity_accuracy, entity_retention, entity_report,
        intrinsic_report, system_report, path_index, merge_index, cache_lookup,
        pending_items, extract_pending, align_features, strip_padding, batch_concat, cache_audit,
        cached_batches,
    )
}
