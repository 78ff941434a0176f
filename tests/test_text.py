"""Golden values and properties of the text functions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import frames, records
from glossaflow.functions import text as X
from glossaflow.functions.retention import count_found, retained

SPACES = [
    c for c in map(chr, range(0x3001))
    if c.isspace()
]


def apply(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").repartition(3)
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def random_texts(n=3000):
    rng = random.Random(7)
    parts = [
        "父", "⽗", "<|im_end|>", "<|endoftext|>", " ", "\n", "\r\n", "\x1c", "　", "\x85",
        "Translation:", "TRANSLATION: ", "transcription: ", "a", "Tom", "天气", "１２", "2.5", ".",
    ]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]


def test_white_space_is_the_python_set(spark):
    assert apply(spark, X.strip_ws, [c + "x" + c for c in SPACES]) == ["x"] * len(SPACES)
    near = ["​", "᠎", "﻿"]
    assert apply(spark, X.strip_ws, near) == near


def test_normalize(spark):
    assert apply(spark, X.normalize_text, ["　a b\x1cc ", " \n ", "a\t\tb\nc"]) == [
        "a b c", "", "a b c"]
    texts = random_texts()
    once = apply(spark, X.normalize_text, texts)
    assert once == [" ".join(t.split()) for t in texts]
    assert apply(spark, X.normalize_text, once) == once


def test_blank(spark):
    texts = ["", " 　\n", "x", None, "​"] + random_texts(300)
    assert apply(spark, X.is_blank, texts) == [not (t or "").strip() for t in texts]


def test_clean_prediction(spark):
    def by_hand(text):
        before = None
        while before != text:
            before = text
            text = re.sub(r"(⽗|父|<\|im_end\|>|<\|endoftext\|>)\Z", "", text.strip())
        return text

    assert apply(spark, X.clean_prediction, ["他的祖父 <|im_end|> 父 "]) == ["他的祖"]
    texts = random_texts()
    once = apply(spark, X.clean_prediction, texts)
    assert once == [by_hand(t) for t in texts]
    assert apply(spark, X.clean_prediction, once) == once


def test_long_blank_and_tail_runs(spark):
    texts = [" " * 40_000 + "x" + " " * 40_000, "x" + "父 " * 40_000, "父 " * 20_000 + "x"]
    assert apply(spark, X.clean_prediction, texts) == ["x", "x", texts[2]]
    assert apply(spark, X.strip_ws, texts[:1]) == ["x"]


def test_labelled_line(spark):
    def by_hand(text):
        hits = [s.strip() for s in text.splitlines()]
        hits = [s for s in hits if s.lower().startswith("translation:")]
        return hits[0].split(":", 1)[1].strip() if hits else text.strip()

    assert apply(spark, X.labelled_line, [
        "Transcription: a\n  TRANSLATION: b c\nrest", " x ", "Translation:", ""]) == ["b c", "x", "", ""]
    texts = random_texts()
    assert apply(spark, X.labelled_line, texts) == [by_hand(t) for t in texts]


def test_tokens_and_entities(spark):
    assert apply(spark, X.tokenize_mixed, ["今天a1 b,好", "", "ß-x"]) == [
        ["今", "天", "a1", "b", "好"], [], ["x"]]
    assert apply(spark, X.capitalized_words, [
        "他叫Tom去", "Straße Zoo", "T_1 Tom_ Tom", "A Bc Bc"]) == [[], ["Zoo"], ["Tom"], ["Bc"]]
    assert apply(spark, X.numbers, ["2.5 １２ 3. 2.5"]) == [["2.5", "１２", "3."]]
    assert apply(spark, X.entities, ["Tom 12"]) == [["Tom", "12"]]
    hits = lambda c: retained(F.array(F.lit("2"), F.lit("Tom")), c)
    assert apply(spark, hits, ["12", "tom", "Tomas 2"]) == [1, 0, 2]


def test_coalesce_fields(spark):
    df = spark.createDataFrame(
        [(0, "", "x"), (1, None, " x "), (2, None, None), (3, " ", "y")], "i int, a string, b string")
    out = df.select("i", X.coalesce_fields(F.col("a"), F.col("b")).alias("o")).orderBy("i")
    assert [r.o for r in out.collect()] == ["", "x", "", ""]
    number = spark.range(1).select(X.coalesce_fields(F.lit(None), F.lit(7)).alias("o"))
    assert number.first().o == "7"


def test_paths(spark):
    paths = ["/a/b/c.tar.gz", "/a/b/", "x.jsonl", ".hid", "http://h/p/7?x=1"]
    assert apply(spark, X.path_name, paths) == ["c.tar.gz", "b", "x.jsonl", ".hid", "7?x=1"]
    assert apply(spark, X.path_stem, paths) == ["c.tar", "b", "x", ".hid", "7?x=1"]
    assert apply(spark, X.path_parent, paths) == ["/a/b", "/a", "", "", "http://h/p"]
    assert apply(spark, X.media_ordinal, ["/d/12.wav", "/d/x.wav", "/d/1.wav.bak"]) == [12, None, None]
    back = spark.range(3).select(X.media_ordinal(X.media_path("/d", F.col("id"))).alias("o"), "id")
    assert all(r.o == r.id for r in back.collect())


def test_records(spark):
    df = spark.range(1).select(
        records.speech_messages("s", "go", F.lit("t")).alias("m"),
        records.two_step_answer(F.lit(" en "), F.lit("zh")).alias("two"),
        records.prompt("s", "go", F.lit("/a.wav")).alias("p"))
    row = df.select("*", records.last_content(F.col("m")).alias("last"),
                    records.last_content(F.col("m"), "tool").alias("none")).first()
    assert [(m.role, m.content) for m in row.m] == [
        ("system", "s"), ("user", "<audio>go"), ("assistant", "t")]
    assert row.two == "Transcription:  en \nTranslation: zh"
    assert (row.last, row.none) == ("t", None)
    assert [[p.type for p in m.content] for m in row.p] == [["text"], ["audio", "text"]]
    assert row.p[1].content[0].audio == "/a.wav"


@pytest.mark.parametrize("have,want,out", [
    ([1, 2], 4, [1, 2, 2, 2]), ([1, 2, 3], 2, [1, 2]), ([], 2, []), ([5], 1, [5]), ([5], 0, [])])
def test_align(spark, have, want, out):
    df = spark.createDataFrame([(have, want)], "f array<int>, n int")
    assert df.select(frames.align_length(F.col("f"), F.col("n")).alias("o")).first().o == out


def test_strip_padding(spark):
    df = spark.createDataFrame([([1, 2, 3], [True, False, None])], "f array<int>, m array<boolean>")
    row = df.select(frames.strip_padding(F.col("f"), F.col("m")).alias("f"),
                    frames.valid_length(F.col("m")).alias("n")).first()
    assert (row.f, row.n) == ([1], 1)


def test_retained_equals_one_search_per_entity(spark):
    rng = random.Random(4)
    table = []
    for _ in range(300):
        text = "".join(rng.choice("AbAb12é天 ") for _ in range(rng.randint(0, 60)))
        found = list({"".join(rng.choice("AbAb12é天") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))})
        table.append((found, text))
    table += [(None, "A"), (["A"], None), ([], "A"), (["1", "11", "111"], "1" * 50)]
    df = spark.createDataFrame(table, "e array<string>, t string")
    got = [r[0] for r in df.select(retained(F.col("e"), F.col("t"))).collect()]
    assert got == [None if e is None else sum(x in (t or "") for x in e) for e, t in table]


def test_many_entities_take_one_pass():
    entities = [f"Word{k}" for k in range(20_000)]
    text = " ".join(entities[::2]) + " x" * 200_000
    began = time.perf_counter()
    got = count_found(entities, text)
    assert time.perf_counter() - began < 5
    beginnings = {word[:n] for word in entities[::2] for n in range(len(word) + 1)}
    assert got == sum(e in beginnings for e in entities)
