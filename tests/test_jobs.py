"""Curation, prediction and cache jobs on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import records as R
from glossaflow.operators import cache as C
from glossaflow.operators import rows as O
from glossaflow.operators.predict import batch_predict
from glossaflow.plans import datasets, feature_cache, prediction, reports
from glossaflow.sources import readers, sinks
from glossaflow.streaming.incremental import bucket_of, cached_paths, fill_cache


@pytest.fixture()
def corpus(spark):
    rows = [(0, "zero", "零"), (1, "one", " \n"), (2, "two", "二 "), (3, "three", "三")]
    return spark.createDataFrame(rows, "row_idx bigint, sentence string, translation string")


@pytest.fixture()
def closed(spark, corpus, tmp_path):
    sinks.write_jsonl(datasets.speech_records(corpus, "/w", "s", "go"), str(tmp_path / "j"))
    return readers.read_chat(spark, str(tmp_path / "j"))


def test_speech_records_keep_gaps(corpus):
    rows = datasets.speech_records(corpus, "/w", "s", "go").orderBy("row_idx").collect()
    assert [r.audios for r in rows] == [["/w/0.wav"], ["/w/2.wav"], ["/w/3.wav"]]
    assert [r.messages[2].content for r in rows] == ["零", "二", "三"]
    assert datasets.test_records(corpus, 2, "/w", "s", "go").count() == 1
    with pytest.raises(ValueError):
        datasets.test_records(corpus, 5, "/w", "s", "go")


def test_positions_drift_and_keys_do_not(corpus, closed):
    path = R.first_media(F.col("audios"))
    by_position = {r.row_idx: r.sentence for r in O.positional_join(closed, corpus, "sentence").collect()}
    by_key = {r.row_idx: r.sentence for r in O.keyed_join(closed, corpus, path, "sentence").collect()}
    assert by_position == {0: "zero", 1: "one", 2: "two"}
    assert by_key == {0: "zero", 1: "two", 2: "three"}
    drift = datasets.target_mismatches(closed, corpus).orderBy("row_idx").collect()
    assert [(r.row_idx, r.record_preview, r.corpus_preview) for r in drift] == [(1, "二", " \n"), (2, "三", "二 ")]


def test_short_corpus_stops(corpus, closed):
    with pytest.raises(Exception, match="no row 2"):
        O.positional_join(closed, corpus.filter("row_idx < 2"), "sentence").collect()


def test_two_step_records(corpus, closed):
    rows = datasets.two_step_records(closed, corpus, "s", "go", offset=1, n=5, by_key=True).orderBy("row_idx").collect()
    assert [r.messages[2].content for r in rows] == [
        "Transcription: two\nTranslation: 二 ", "Transcription: three\nTranslation: 三"]
    assert rows[0].audios == ["/w/2.wav"]


def test_text_records(spark):
    asr = spark.createDataFrame(
        [(i, None, p, r) for i, (p, r) in enumerate([("a", ""), ("b\n c", "二"), (" ", "x"), ("d", "四"), ("e", "五")])],
        "row_idx bigint, idx bigint, pred_zh string, ref_zh string").repartition(4)
    rows = datasets.text_records(asr, "s", "Go: ").orderBy("row_idx").collect()
    assert [r.messages[1].content for r in rows] == ["Go: b c", "Go: d", "Go: e"]
    assert [r.row_idx for r in datasets.text_records(asr, "s", "Go: ", 2).collect()] == [1, 3]
    assert datasets.text_records(asr, "s", "Go: ", 0).count() == 0


def test_conversations(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (2, 0, "user", "x")],
        "conv_id bigint, turn bigint, role string, text string").repartition(3)
    chats = {r.conv_id: [(m.role, m.content) for m in r.messages] for r in O.assemble_chats(turns).collect()}
    assert chats == {1: [("user", "q"), ("assistant", "a"), ("assistant", "b")], 2: [("user", "x")]}
    assert {r.conv_id: r.content for r in O.last_turn(turns, "assistant").collect()} == {1: "b", 2: None}
    parts = {(r.conv_id, r.part): len(r.messages) for r in O.assemble_chats(turns, part_turns=2).collect()}
    assert parts == {(1, 0): 2, (1, 1): 1, (2, 0): 1}
    long = spark.range(1030).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "string(id) AS text")
    (whole,) = O.assemble_chats(long).collect()
    assert [m.content for m in whole.messages] == [str(k) for k in range(1030)]


def test_keyed_join_stops_at_missing_rows(spark):
    corpus = spark.createDataFrame([(0, "s")], "row_idx bigint, sentence string")
    for path in ("/a/1.wav", "/a/b.wav", None):
        records = spark.createDataFrame([(5, path)], "row_idx bigint, p string")
        with pytest.raises(Exception, match="no corpus row for media"):
            O.keyed_join(records, corpus, F.col("p"), "sentence").collect()


def test_batches_stop_at_missing_frames(spark):
    todo = spark.createDataFrame([(0, "p", 3), (1, "q", 1)], "row_idx bigint, audio_path string, expected_len int")
    index = [("train", C.path_index(items(spark, ["p", "q"])))]
    cached = spark.createDataFrame([("train", 0, [[1.0]])], "split string, idx bigint, features array<array<float>>")
    with pytest.raises(Exception, match="no cached features for q"):
        feature_cache.cached_batches(todo, index, cached, 2).collect()


def test_require_rows(spark):
    df = spark.createDataFrame([(" ", "x"), (None, "y")], "a string, ref_zh string")
    with pytest.raises(ValueError):
        O.require_rows(O.coalesced_pairs(df, ("a",), ("ref_zh",)), "no pairs")


def test_failures_stay_rows(spark, tmp_path):
    marks = tmp_path / "loads"
    marks.mkdir()

    def make():
        (marks / f"{id(object())}-{__import__('uuid').uuid4()}").write_text("")

        class OutOfMemoryError(RuntimeError):
            pass

        def predict(text):
            if text == "3":
                raise MemoryError
            if text == "4":
                raise OutOfMemoryError("gpu")
            if text == "5":
                raise ValueError("bad: x")
            return text * 2
        return predict

    df = spark.range(0, 8, 1, 2).select("id", F.when(F.col("id") != 6, F.col("id").cast("string")).alias("t"))
    rows = sorted(batch_predict(df, F.col("t"), make).collect())
    assert [r.prediction for r in rows] == ["00", "11", "22", "", "", "", None, "77"]
    assert [r.status for r in rows] == ["ok"] * 3 + ["OOM", "OOM", "ERR:bad: x", None, "ok"]
    assert all(r.latency_s is None or r.latency_s == round(r.latency_s, 3) for r in rows)
    assert len(list(marks.iterdir())) == 2, "one load per task"


def test_predict_is_called_once_per_row(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def make():
        def predict(text):
            (log / f"{text}-{__import__('uuid').uuid4()}").write_text("")
            return text
        return predict

    df = spark.range(6).select(F.col("id").cast("string").alias("t"))
    out = batch_predict(df, F.col("t"), make).filter("status = 'ok' AND prediction <> '2'")
    assert len(out.select("prediction", "status").collect()) == 5
    assert len(list(log.iterdir())) == 6


def test_chat_predictions(spark):
    chats = spark.createDataFrame(
        [(0, [("user", "q"), ("assistant", "a")], ["/1.wav"]), (1, [("user", "q")], None), (2, [], [])],
        "row_idx bigint, " + readers.CHAT_SCHEMA)
    make = lambda: lambda p: f"Transcription: {p[1]['content'][0]['audio']}\ntranslation: 好父\n<|im_end|>"
    rows = prediction.predict_chats(chats, make, "s", "go", limit=2).orderBy("id").collect()
    assert [(r.id, r.audio, r.reference, r.prediction, r.status) for r in rows] == [
        (0, "/1.wav", "a", "好", "ok"), (1, None, None, "好", "ok")]


def test_text_predictions(spark):
    asr = spark.createDataFrame(
        [(0, 9, " a\nb ", "x"), (1, None, None, "x"), (2, None, "boom", "x"), (3, None, "c", "　")],
        "row_idx bigint, idx bigint, pred_zh string, ref_zh string")

    def make():
        def predict(prompt):
            text = prompt[-1]["content"][0]["text"]
            if "boom" in text:
                raise ValueError("broken")
            return f" {text} "
        return predict

    rows = prediction.predict_texts(asr, make, "s", "Go: ").orderBy("ref_zh", "idx").collect()
    got = {r.idx: (r.src_en, r.pred_zh, r.error, r.latency_sec is None) for r in rows}
    assert got == {
        9: ("a b", "Go: a b", None, False), 1: ("", "", "empty src/ref", True),
        2: ("boom", "", "broken", True), 3: ("c", "", "empty src/ref", True)}


def items(spark, paths):
    return spark.createDataFrame(list(enumerate(paths)), "row_idx bigint, audio_path string")


def test_index_and_lookup(spark):
    train, val = C.path_index(items(spark, ["p", "q", "p"])), C.path_index(items(spark, ["q", "r"]))
    assert {(r.audio_path, r.idx) for r in train.collect()} == {("p", 2), ("q", 1)}
    merged = C.merge_index([("train", train), ("val", val)])
    assert {tuple(r) for r in merged.collect()} == {("p", "train", 2), ("q", "val", 0), ("r", "val", 1)}
    wanted = items(spark, ["p", "z"])
    assert [r.audio_path for r in C.pending_items(wanted, merged).collect()] == ["z"]
    found = {r.audio_path: (r.idx, r.hit) for r in C.cache_lookup(wanted, merged).collect()}
    assert found == {"p": (2, True), "z": (None, False)}
    with pytest.raises(Exception, match="no cached features for z"):
        C.cache_lookup(wanted, merged, strict=True).collect()


def test_batch_concat_and_audit(spark):
    feats = spark.createDataFrame(
        [(0, [[1.0], [2.0]]), (1, [[3.0]]), (2, [[4.0]])], "row_idx bigint, features array<array<float>>").repartition(3)
    got = {r.batch: (r.samples, r.features) for r in C.batch_concat(feats, 2).collect()}
    assert got == {0: (2, [[1.0], [2.0], [3.0]]), 1: (1, [[4.0]])}
    gap = feats.withColumn("features", F.when(F.col("row_idx") != 1, F.col("features")))
    with pytest.raises(Exception, match="no frames for the sample at position 1"):
        C.batch_concat(gap, 2).collect()
    told = {r.batch: (r.samples, r.missing, r.features) for r in C.batch_concat(gap, 2, on_missing="report").collect()}
    assert told == {0: (2, 1, [[1.0], [2.0]]), 1: (1, 0, [[4.0]])}
    todo = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3), ("z", 3), ("e", 2)], "audio_path string, expected_len int")
    index = [("train", spark.createDataFrame([("p", 0), ("q", 1), ("e", 2)], "audio_path string, idx bigint"))]
    cached = spark.createDataFrame(
        [("train", 0, [1.0, 2.0]), ("train", 1, [1.0]), ("train", 2, [])], "split string, idx bigint, features array<float>")
    row = feature_cache.audit(todo, index, cached).first()
    assert (row["items"], row.hits, row.misses, row.padded, row.cut, row.exact, row["empty"], row.frames) == (5, 4, 1, 1, 1, 1, 1, 6)


def test_cached_batches(spark):
    todo = spark.createDataFrame(
        [(0, "p", 3), (1, "q", 1), (2, "p", 1)], "row_idx bigint, audio_path string, expected_len int").repartition(3)
    index = [("train", C.path_index(items(spark, ["p", "q"])))]
    cached = spark.createDataFrame(
        [("train", 0, [[1.0], [2.0]]), ("train", 1, [[3.0], [4.0]])], "split string, idx bigint, features array<array<float>>")
    got = {r.batch: r.features for r in feature_cache.cached_batches(todo, index, cached, 2).collect()}
    assert got == {0: [[1.0], [2.0], [2.0], [3.0]], 1: [[1.0]]}
    lost = todo.withColumn("audio_path", F.lit("z"))
    with pytest.raises(Exception, match="no cached features for z"):
        feature_cache.cached_batches(lost, index, cached, 2).collect()


def test_extraction_failures_are_rows(spark):
    def make():
        def extract(path):
            if path == "bad":
                raise OSError("gone")
            return [[float(len(path))]]
        return extract

    todo = items(spark, ["aa", "bad", "aa", "old"])
    done = spark.createDataFrame([("old",)], "audio_path string")
    got = {r.audio_path: (r.idx, r.features, r.status) for r in feature_cache.extract_pending(todo, done, make).collect()}
    assert got == {"aa": (2, [[2.0]], "ok"), "bad": (1, None, "ERR:gone")}


def test_hot_path_lookup(spark):
    """One path holds most items: every item keeps its row."""
    todo = spark.range(3000).select(
        F.col("id").alias("row_idx"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("audio_path"))
    index = C.merge_index([("train", C.path_index(todo))])
    found = C.cache_lookup(todo, index)
    assert found.filter("hit").count() == 3000 and index.count() == 1001
    assert C.pending_items(todo, index.filter("audio_path <> 'hot'")).count() == 2000


def test_incremental_cache(spark, tmp_path):
    src, cache, point = tmp_path / "src", str(tmp_path / "cache"), str(tmp_path / "point")
    src.mkdir()

    def drop(name, paths):
        (src / name).write_text("".join(json.dumps({"audio_path": p}) + "\n" for p in paths))
        stream = spark.readStream.schema("audio_path string").json(str(src))
        compute = lambda df: df.withColumn("features", F.array(F.length("audio_path")))
        fill_cache(stream, cache, compute, point).awaitTermination(120)
        return sorted(r.audio_path for r in spark.read.parquet(cache).collect())

    assert drop("1.json", ["p", "q", "p"]) == ["p", "q"]
    assert drop("2.json", ["q", "r"]) == ["p", "q", "r"]
    assert drop("3.json", ["r"]) == ["p", "q", "r"]


def test_odd_answers_are_rows(spark):
    def make():
        answers = {"a": 7, "b": "\ud800", "c": None, "d": "fine", "e": ["x"]}

        def predict(value):
            if value == "f":
                raise ValueError("odd \udcff message")
            return answers[value]
        return predict

    df = spark.createDataFrame([(c,) for c in "abcdef"], "v string").coalesce(1)
    got = {r.v: (r.prediction, r.status) for r in batch_predict(df, F.col("v"), make).collect()}
    assert got["d"] == ("fine", "ok")
    assert all(got[c][0] == "" and got[c][1].startswith("ERR:") for c in "abcef")


def test_system_report_needs_a_pair(spark):
    rows = spark.createDataFrame([("m", " ", "x", "f1")], "model string, pred string, ref string, file string")
    with pytest.raises(ValueError, match="no valid pairs"):
        reports.system_report(rows.selectExpr("model", "pred", "pred AS pred_zh", "ref", "ref AS ref_zh", "file"))
    both = spark.createDataFrame([("m", " ", "x", "f1"), ("n", "a", "a", "f2")], "model string, pred_zh string, ref_zh string, file string")
    both = both.withColumn("pred", F.col("pred_zh")).withColumn("ref", F.col("ref_zh"))
    got = {r.model: (r.samples, r.files) for r in reports.system_report(both).collect()}
    assert got == {"m": (0, ["f1"]), "n": (1, ["f2"])}


def test_a_batch_opens_only_its_own_buckets(spark, tmp_path):
    src, cache, point = tmp_path / "src", str(tmp_path / "cache"), str(tmp_path / "point")
    src.mkdir()
    computed = []

    def compute(df):
        computed.append(sorted(r.audio_path for r in df.collect()))
        return df.select("audio_path", F.length("audio_path").alias("n"))

    def run(name, paths):
        (src / name).write_text("".join(json.dumps({"audio_path": p, "row_idx": k}) + "\n" for k, p in enumerate(paths)))
        stream = spark.readStream.schema("audio_path string, row_idx long").json(str(src))
        fill_cache(stream, cache, compute, point, buckets=64).awaitTermination(120)

    first = [f"/a/{k}" for k in range(200)]
    run("1.json", first + first)
    files = list((tmp_path / "cache").glob("bucket=*/*.parquet"))
    folders = {f.parent.name for f in files}
    assert len(files) == len(folders) > 50
    run("2.json", ["/a/3", "/a/new", "/a/3"])
    assert computed == [sorted(first), ["/a/new"]]
    own = [r[0] for r in spark.createDataFrame([("/a/3",), ("/a/new",)], "p string").select(bucket_of(F.col("p"), 64)).collect()]
    opened = cached_paths(spark, cache, own).inputFiles()
    assert {f.split("/")[-2] for f in opened} == {f"bucket={b}" for b in own}
    assert cached_paths(spark, cache, []).collect() == []
    assert sorted(r.audio_path for r in spark.read.parquet(cache).collect()) == sorted([*first, "/a/new"])
