"""Ordering, round trips and guards of readers and writers."""

import gzip
import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glossaflow.operators import rows as O
from glossaflow.plans import reports
from glossaflow.sources import arrow_shards, ordering, readers, scratch, sinks
from glossaflow.sources.scratch import at_place, scratch_path
from workload import views


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_jsonl_order_over_files_and_splits(spark, tmp_path, small_splits):
    want = []
    for name, ending in (("b +x.jsonl", "\n"), ("a.jsonl", "\r\n"), ("é%41.jsonl", "\n")):
        lines = []
        for i in range(700):
            lines.append(json.dumps({"k": f"{name}-{i}"}, ensure_ascii=False) + ending)
            if i % 50 == 0:
                lines.append("  " + ending)
        (tmp_path / name).write_text("".join(lines), newline="")
    (tmp_path / "ignored.txt").write_text("no json")
    for path in sorted(tmp_path.glob("*.jsonl")):
        want += [json.loads(s)["k"] for s in path.read_text().splitlines() if s.strip()]
    df = readers.read_jsonl_dir(spark, str(tmp_path), "k string")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
    rows = df.orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(2100))
    assert [r.k for r in rows] == want
    mixed = df.repartition(7).filter("row_idx % 2 = 1").orderBy("row_idx").collect()
    assert [r.k for r in mixed] == want[1::2]


def test_corpus_order_over_files(spark, tmp_path):
    for n, name in enumerate(("train-1.parquet", "train-0.parquet", "val-0.parquet")):
        spark.range(n * 100, n * 100 + 40 + n).coalesce(1).write.parquet(str(tmp_path / name))
    train = readers.read_corpus(spark, str(tmp_path / "train-*"))
    assert [r.id for r in train.orderBy("row_idx").collect()] == [*range(100, 141), *range(40)]
    parts = tmp_path / "flat"
    parts.mkdir()
    for n, shard in enumerate(("x-train-1", "x-train-0", "val-0")):
        pq.write_table(pa.table({"id": list(range(n * 10, n * 10 + 5))}), parts / f"{shard}.parquet", row_group_size=2)
    got = readers.read_corpus(spark, str(parts), split="train").orderBy("row_idx").collect()
    assert [(r.row_idx, r.id) for r in got] == list(enumerate([10, 11, 12, 13, 14, 0, 1, 2, 3, 4]))
    assert readers.read_corpus(spark, str(parts), split="val").count() == 5


def test_blank_and_malformed_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"k": 1}\n\n{"k": 2}\n')
    assert readers.read_jsonl(spark, str(path), "k int").count() == 2
    with pytest.raises(Exception, match="blank line"):
        readers.read_jsonl(spark, str(path), "k int", on_blank="fail").collect()
    path.write_text('{"k": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(path), "k int").collect()


def test_resolve_inputs(spark, tmp_path):
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text("")
    glob = f"{tmp_path}/*.jsonl"
    assert readers.resolve_inputs(spark, glob) == [glob]
    two = f"{tmp_path}/b.jsonl  {tmp_path}/nope {tmp_path}/a.jsonl"
    assert readers.resolve_inputs(spark, two) == [f"{tmp_path}/b.jsonl", f"{tmp_path}/a.jsonl"]
    with pytest.raises(FileNotFoundError):
        readers.resolve_inputs(spark, f"{tmp_path}/nope")


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.range(500).select(
        F.col("id").alias("row_idx"), F.concat(F.lit("天气\n"), "id").alias("v")).repartition(9)
    out = str(tmp_path / "out")
    sinks.write_jsonl(df, out)
    sinks.write_jsonl(df, out)
    text = "".join(p.read_text() for p in sorted(Path(out).glob("part-*")))
    assert [json.loads(s)["v"] for s in text.splitlines()] == [f"天气\n{i}" for i in range(500)]
    assert "天气" in text
    back = readers.read_jsonl_dir(spark, out, "v string", glob="*.json").orderBy("row_idx").collect()
    assert [(r.row_idx, r.v) for r in back] == [(i, f"天气\n{i}") for i in range(500)]


@pytest.fixture()
def small_files(monkeypatch):
    monkeypatch.setattr(ordering, "FILE_BYTES", 4_096)


def arrays_in(out: str) -> list:
    return [json.loads(p.read_text()) for p in sorted(Path(out).glob("part-*")) if p.stat().st_size]


def test_prediction_arrays(spark, tmp_path, small_files):
    df = spark.range(4_500).select("id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("prediction"))
    out = str(tmp_path / "out")
    sinks.write_predictions(df, out)
    arrays = arrays_in(out)
    assert len(arrays) > 3
    assert [r["id"] for a in arrays for r in a] == list(range(4_500))
    assert arrays[0][0] == {"id": 0, "status": "ok", "prediction": None}
    assert readers.read_predictions(spark, out).count() == 4_500
    one = tmp_path / "one.json"
    one.write_text(json.dumps([{"id": 3, "status": "OOM"}], indent=2))
    assert readers.read_predictions(spark, str(one)).first().id == 3


def test_arrays_stay_bounded_for_null_and_repeated_ids(spark, tmp_path, small_files):
    ids = F.when(F.col("id") < 3_000, 7).when(F.col("id") < 6_000, F.lit(None)).otherwise(F.col("id"))
    df = spark.range(9_000).select(ids.cast("long").alias("id"), F.md5(F.col("id").cast("string")).alias("prediction"))
    out = str(tmp_path / "out")
    sinks.write_predictions(df.withColumn("prediction", F.when(F.col("id") == 7, "same").otherwise(F.col("prediction"))), out)
    arrays = arrays_in(out)
    assert sum(map(len, arrays)) == 9_000 and max(map(len, arrays)) < 1_500
    got = [r["id"] for a in arrays for r in a]
    assert got == [7] * 3_000 + list(range(6_000, 9_000)) + [None] * 3_000
    long = spark.createDataFrame([(k, "x" * 1_000_000) for k in range(4)], "id long, prediction string")
    sinks.write_predictions(long, out)
    assert [len(r["prediction"]) for a in arrays_in(out) for r in a] == [1_000_000] * 4
    sinks.write_predictions(df.limit(0), out)
    assert arrays_in(out) == [] and readers.read_predictions(spark, out).count() == 0


def test_stored_rows_become_arrays_without_a_copy(spark, tmp_path, small_files, monkeypatch):
    df = spark.range(4_500).select(
        F.when(F.col("id") % 9 > 0, F.col("id")).alias("id"), F.md5(F.col("id").cast("string")).alias("prediction"), F.lit("s").alias("system")
    )
    df.write.parquet(str(tmp_path / "rows"))
    table = at_place(spark.read.parquet(str(tmp_path / "rows")), str(tmp_path / "rows"))
    copies = []
    monkeypatch.setattr(scratch, "scratch_path", lambda _, label: copies.append(label) or str(tmp_path / label))
    out = tmp_path / "out"
    sinks.write_predictions(table, str(out), columns=["id", "prediction"], compression="gzip")
    assert not copies and table.count() == 4_500
    found = sorted(out.glob("part-*"))
    arrays = [json.loads(text) for p in found if (text := gzip.decompress(p.read_bytes()))]
    assert len(arrays) > 3 and sum(map(len, arrays)) == 4_500 and set(arrays[0][0]) == {"id", "prediction"}
    assert [r["id"] for a in arrays for r in a] == [k for k in range(4_500) if k % 9] + [None] * 500
    back = readers.read_predictions(spark, str(out), "id bigint, prediction string")
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, df.drop("system").collect())))


def test_tasks_follow_the_bytes_alone(spark, tmp_path, small_files):
    df = spark.range(20_000).select(F.col("id").alias("row_idx"), F.md5(F.col("id").cast("string")).alias("v"))
    files = []
    for n in (2, 50):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sinks.write_jsonl(df, str(tmp_path / str(n)))
        files.append([p.stat().st_size for p in sorted((tmp_path / str(n)).glob("part-*"))])
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(files[0]) > 50 and files[0] == files[1]
    assert max(files[0]) < 1.2 * min(files[0])


def test_report_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("ok", "a", "a", "s1"), ("ok", "b", "b", "s2")], "status string, prediction string, reference string, system string")
    sinks.write_report(reports.entity_report(df, "system"), str(tmp_path / "r"), by="system")
    texts = [p.read_text() for p in sorted((tmp_path / "r").glob("system=*/part-*"))]
    assert len(texts) == 2 and all(json.loads(t)["COMET"] is None for t in texts)


def test_sharded_output(spark, tmp_path, monkeypatch):
    df = spark.range(900).select(
        F.col("id").alias("row_idx"), F.when(F.col("id") < 600, "hot").otherwise("cold").alias("shard"))
    out = str(tmp_path / "s")
    monkeypatch.setattr(ordering, "FILE_BYTES", 1_000)
    sinks.write_sharded(sinks.stored(df, "rows"), out)
    files = list(Path(out).glob("shard=hot/part-*"))
    assert len(files) > 1, "a hot shard is written by several tasks"
    ids = [json.loads(s)["row_idx"] for p in sorted(files) for s in p.read_text().splitlines()]
    assert ids == list(range(600))


ODD_PATHS = [
    "/a/b,c.wav", ",", ",,", "/a\\,b", '/q"uote,"x": 5, y', "/q\\", "/é 天,\u2028x", "{", "}", "", '"', '":1', "/x: 7", "a,b" * 40,
]


def test_path_index_files(spark, tmp_path, small_files):
    paths = [f"/a/{i}" for i in range(2_000)] + ODD_PATHS
    index = spark.createDataFrame(list(zip(paths, range(len(paths)))), "audio_path string, idx long").repartition(5)
    sinks.write_path_index(index, str(tmp_path / "train"))
    objects = arrays_in(str(tmp_path / "train"))
    assert len(objects) > 3 and {p: i for o in objects for p, i in o.items()} == dict(zip(paths, range(len(paths))))
    got = readers.read_path_index(spark, {"train": str(tmp_path / "train"), "val": str(tmp_path / "val")})
    assert sorted((r.audio_path, r.idx, r.split) for r in got.collect()) == sorted((p, i, "train") for i, p in enumerate(paths))
    with pytest.warns(UserWarning, match="empty"):
        assert readers.read_path_index(spark, {"val": str(tmp_path / "val")}).collect() == []


@pytest.mark.parametrize("style", [{}, {"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_path_index_of_one_object_in_many_splits(spark, tmp_path, small_splits, style):
    """Neither a task nor a row holds the object: a split gives rows from its first comma on."""
    want = {f"/clips/{i},{'x,' * (i % 7)}.wav" if i % 3 else f"/clips/{i}.wav": i - 9 for i in range(6_000)}
    want |= dict(zip(ODD_PATHS, range(100)))
    (tmp_path / "index.json").write_text(json.dumps(want, **style) + "\n", newline="")
    (tmp_path / "none.json").write_text(" { }\n")
    pieces = spark.read.option("lineSep", ",").text(str(tmp_path))
    assert pieces.rdd.getNumPartitions() > 20
    rows = readers.read_path_index(spark, {"train": str(tmp_path)}).collect()
    assert len(rows) == len(want) and {r.audio_path: r.idx for r in rows} == want


def test_path_index_stops_at_what_is_no_entry(spark, tmp_path):
    for text in ('{"a": 1, oops, "b": 2}', '{"a": 1.5}', '{"a": null}', '[1, 2]', '{"a": 1, "b'):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(Exception, match="no entry of a path index"):
            readers.read_path_index(spark, {"train": str(tmp_path / "x.json")}).collect()


def test_ingest_and_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordering, "LEAST_FILE_BYTES", 64)
    spark.range(30).coalesce(1).write.parquet(str(tmp_path / "t"))
    out = ordering.ingest(spark, str(tmp_path / "t"), scratch_path(spark, "t"))
    assert out.rdd.getNumPartitions() > 1
    assert [(r.row_idx, r.id) for r in out.orderBy("row_idx").collect()] == [(i, i) for i in range(30)]
    assert [r.id for r in ordering.index_columnar(out, ["id"]).orderBy("row_idx").collect()] == list(range(30))
    assert O.head_n(out, 3, strict=True).count() == 3
    with pytest.raises(ValueError):
        O.head_n(out, 31, strict=True)
    assert O.head_n(out, 31).count() == 30


def test_pairs_are_made_from_the_scan_alone(spark, tmp_path, monkeypatch):
    rows = [(k % 7 if k % 5 else None, f"one two|{k}", "en", "src0", 7) for k in range(400)] + [(None, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(ordering, "LEAST_FILE_BYTES", 64)
    for name, files, shuffled in (("even", 8, False), ("one", 1, True)):
        path = str(tmp_path / name / "documents.parquet")
        table.repartition(files).write.parquet(path)
        scan = ordering.spread(spark.read.parquet(path))
        assert ("Exchange" in plan_of(scan)) == shuffled
        assert scan.rdd.getNumPartitions() > 1 and sorted(map(repr, map(tuple, scan.collect()))) == sorted(map(repr, rows))

        def refuse(*_):
            raise AssertionError("the table is copied first")

        with monkeypatch.context() as patch:
            patch.setattr(views, "ingest", refuse)
            made = views.pairs(spark, str(tmp_path / name)).select("id", "status").collect()
        assert sorted(map(repr, map(tuple, made))) == sorted(repr((r[0], "OOM" if r[1] else "ok")) for r in rows)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def line_files(folder: Path, files: int = 12, lines: int = 50) -> list[str]:
    folder.mkdir()
    want = []
    for f in range(files):
        own = [f"{f}-{k}" for k in range(lines + f)]
        (folder / f"part [{f:02}] {{x}}.jsonl").write_text("".join(json.dumps({"k": k}) + "\n\n" for k in own))
        want += own
    return want


def test_positions_shuffle_no_text_and_no_table_of_splits_meets_in_one_task(spark, tmp_path, small_splits):
    line_files(tmp_path / "lines")
    df = readers.read_jsonl_dir(spark, str(tmp_path / "lines"), "k string")
    text = plan_of(df)
    assert "SinglePartition" not in text and text.count("FileScan text") == 1
    # The scan of the lines is the streamed side of a broadcast join; what is dealt out are counts.
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "value" not in "".join(
        x for x in text.splitlines() if "Exchange hashpartitioning" in x
    )
    assert "UrlCodec" not in plan_of(df.select("row_idx", "file"))
    spark.range(300).repartition(9).write.parquet(str(tmp_path / "t"))
    assert "SinglePartition" not in plan_of(readers.read_corpus(spark, str(tmp_path / "t")))


def test_prefix_sums_over_many_runs(spark):
    counts = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), (F.col("id") % 3).alias("_n"))
    rows = ordering.prefix_sums(counts, "k").orderBy("k").collect()
    total = 0
    for k, row in enumerate(rows):
        assert (row.k, row._offset) == (k, total)
        total += row._n
    assert ordering.prefix_sums(counts.limit(0), "k").collect() == []


def test_line_slices_read_only_their_files(spark, tmp_path):
    want = line_files(tmp_path / "lines")
    folder = str(tmp_path / "lines")
    files = readers.count_lines(spark, folder)
    assert files.count() == 12
    for start, stop in ((0, 10), (49, 52), (200, 330), (600, 10_000), (0, 10**9)):
        df = readers.read_jsonl_dir(spark, folder, "k string", rows=(start, stop), files=files)
        got = [(r.row_idx, r.k) for r in df.orderBy("row_idx").collect()]
        assert got == list(enumerate(want))[start:stop]
        if stop - start < 200:
            assert 0 < sum("/lines/" in f for f in df.inputFiles()) <= 4
    assert readers.read_jsonl_dir(spark, folder, "k string", rows=(5_000, 6_000)).collect() == []


def test_corpus_slices_read_only_their_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for f in range(10):
        pq.write_table(pa.table({"id": list(range(f * 20, f * 20 + 20))}), tmp_path / "c" / f"s-{f} {{y}}.parquet", row_group_size=7)
    files = readers.count_corpus(spark, str(tmp_path / "c"))
    for start, stop in ((0, 5), (19, 21), (100, 190), (195, 500)):
        df = readers.read_corpus(spark, str(tmp_path / "c"), ["id"], rows=(start, stop), files=files)
        assert [(r.row_idx, r.id) for r in df.orderBy("row_idx").collect()] == [(i, i) for i in range(start, min(stop, 200))]
        assert sum("/c/" in f for f in df.inputFiles()) == -(-min(stop, 200) // 20) - start // 20
    nothing = readers.read_corpus(spark, str(tmp_path / "c"), ["id"], rows=(900, 950))
    assert nothing.columns == ["row_idx", "id"] and nothing.collect() == []


def test_close_up(spark, tmp_path):
    spark.range(3_000).select(F.col("id").alias("row_idx"), F.md5(F.col("id").cast("string")).alias("v")).repartitionByRange(
        7, "row_idx").sortWithinPartitions("row_idx").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).filter("v > '8' AND row_idx NOT BETWEEN 800 AND 1500")
    kept = ordering.close_up(rows)
    want = [(k, r.v) for k, r in enumerate(rows.orderBy("row_idx").collect())]
    assert [tuple(r) for r in kept.orderBy("row_idx").collect()] == want
    assert "SinglePartition" not in plan_of(kept)
    assert ordering.close_up(rows.filter("v > 'z'")).collect() == []
    with pytest.raises(Exception, match="straight from one file scan"):
        ordering.close_up(rows.repartition(4)).collect()


def arrow_table(start: int, n: int) -> pa.Table:
    ids = list(range(start, start + n))
    return pa.table({
        "id": pa.array(ids, pa.int64()), "text": pa.array([f"天 {k}" if k % 5 else None for k in ids], pa.large_string()),
        "audio": pa.array([{"path": f"/{k}.wav", "n": k} for k in ids]),
        "kind": pa.array([f"k{k % 3}" for k in ids]).dictionary_encode(), "v": pa.array([[k / 2, None] for k in ids]),
    })


def test_arrow_shards_equal_parquet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrow_shards, "TASK_BYTES", 2_000)
    for kind in ("arrow", "parquet"):
        (tmp_path / kind).mkdir()
    for f, n in enumerate((95, 0, 30, 61)):
        table, name = arrow_table(1_000 * f, n), f"a +b-train-{3 - f}"
        if n:
            pq.write_table(table, tmp_path / "parquet" / f"{name}.parquet", row_group_size=40)
        make = pa.ipc.new_stream if f % 2 else pa.ipc.new_file
        options = pa.ipc.IpcWriteOptions(compression="zstd" if f == 2 else None)
        with make(str(tmp_path / "arrow" / f"{name}.arrow"), table.schema, options=options) as out:
            for batch in table.to_batches(max_chunksize=10):
                out.write_batch(batch)
    (tmp_path / "arrow" / "val-0.arrow").write_bytes((tmp_path / "arrow" / "a +b-train-3.arrow").read_bytes())
    places = str(tmp_path / "arrow"), str(tmp_path / "parquet")
    columns = ["row_idx", "id", "text", "audio", "kind", "v"]
    read = [
        readers.read_corpus(spark, p, split="train", format=f).select(*columns).orderBy("row_idx").collect()
        for p, f in zip(places, ("arrow", "parquet"))
    ]
    assert read[0] == read[1] and len(read[0]) == 186 and [r.row_idx for r in read[0]] == list(range(186))
    one = readers.read_corpus(spark, places[0], ["text"], split="train", format="arrow", rows=(60, 75))
    assert one.columns == ["row_idx", "text"]
    assert [(r.row_idx, r.text) for r in one.orderBy("row_idx").collect()] == [(r.row_idx, r.text) for r in read[0][60:75]]
    with pytest.raises(FileNotFoundError):
        readers.read_corpus(spark, places[1], format="arrow")


def test_arrow_shards_are_read_batch_by_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrow_shards, "TASK_BYTES", 1)
    table = arrow_table(0, 400)
    with pa.ipc.new_stream(str(tmp_path / "x.arrow"), table.schema) as out:
        for batch in table.to_batches(max_chunksize=20):
            out.write_batch(batch)
    found = list(arrow_shards.messages(arrow_shards._open(str(tmp_path / "x.arrow"))))
    assert [rows for kind, _, _, rows in found if kind == arrow_shards.BATCH_HEADER] == [20] * 20
    df = readers.read_corpus(spark, str(tmp_path), ["id"], format="arrow")
    assert df.select("id", F.spark_partition_id().alias("p")).groupBy("p").count().filter("count > 20").collect() == []
    assert [(r.row_idx, r.id) for r in df.orderBy("row_idx").collect()] == [(i, i) for i in range(400)]


def test_stray_files_and_absent_fields(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "1", "v": "x"}\n{"k": "2"}\n')
    for name in ("b.jsonl.tmp", "c.json.bak", "d.json"):
        (tmp_path / name).write_text('{"k": "9"}\n')
    rows = readers.read_jsonl_dir(spark, str(tmp_path), "k string, v string")
    assert sorted(r.k for r in rows.collect()) == ["1", "2"]
    assert readers.read_jsonl_dir(spark, str(tmp_path), "k string", required=["k"]).count() == 2
    with pytest.raises(Exception, match="no v in a record of"):
        readers.read_jsonl_dir(spark, str(tmp_path), "k string, v string", required=["v"]).collect()
