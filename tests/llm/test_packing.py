import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glossaflow.llm import packing as P
from llm import fixtures as X

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("window", [64, 4096])
def test_pack_keeps_every_token_once(spark, window):
    table = X.rows()
    got = P.pack(spark.createDataFrame(table, X.SCHEMA).repartition(4), PATH, window).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in table:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), window):
            piece = ids[at:at + window]
            want.append((r[0], at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    filled: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= window
    assert sorted(filled) == list(range(len(filled)))
    assert len(filled) <= 1 + sum(filled.values()) / window * 1.1


def test_best_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 7))]
        counts = {k: items.count(k) for k in items}
        capacity = rng.randint(0, 60)
        best = max(sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= capacity)
        used = P.best_fill(counts, capacity)
        assert sum(k * v for k, v in used.items()) == best
        assert all(v <= counts[k] for k, v in used.items())


def test_plan_uses_up_all_rests():
    rng = random.Random(2)
    counts = {k: rng.randint(0, 500) for k in range(1, 256)}
    used: dict[int, int] = {}
    for times, lengths in P.plan(counts, 256):
        assert sum(k * v for k, v in lengths.items()) <= 256
        for k, v in lengths.items():
            used[k] = used.get(k, 0) + times * v
    assert used == {k: v for k, v in counts.items() if v}


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], X.SCHEMA), PATH).collect() == []


@pytest.mark.parametrize("text", [
    "Hello, World!!! it's DON'T 3.5% a... ...b", "<|endoftext|> x <|ENDOFTEXT|>. END<|startoftext|>!", "Straße, É. é̀! Á. ≠ a≠",
    "", " \n", "漢字。 漢字. x y, \x1cz.", "a.b.c. ,a .!", "I'S. we'LL, 'tis' ''", "ΟΔΟΣ. Σ!",
])
def test_word_by_word_ids_are_the_whole_texts_ids(text):
    known = P.encoder(PATH)
    data = np.frombuffer(text.encode(), np.uint8)
    words = known.words(data, np.array([0, len(data)]))
    sizes, flat = known.encode(words.vocab.to_pylist())
    begin = np.concatenate(([0], np.cumsum(sizes)))
    got = [int(i) for c in words.codes for i in flat[begin[c]:begin[c + 1]]]
    assert got == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_new_words_are_encoded_as_few_texts(monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 300)
    monkeypatch.setattr(P, "JOINED_WORDS", 50)
    known, tokenizer = P.WordEncoder(PATH), Tokenizer.from_file(PATH)
    asked: list[int] = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **options)

    rng = random.Random(4)
    odd = ["\x01", "a\x01b", "\x01\x01 \x01", "<|endoftext|>", "\u0301x", "é\u0301", "\u3000", "\x1cz", "", " "]
    texts = ["the " + " ".join(f"{rng.choice('abcé')}{rng.randrange(900)}q." for _ in range(120)) for _ in range(40)]
    texts += odd + [f"x{k} {o} y{k}" for k, o in enumerate(odd)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(known, "_tokenizer", Counting())
    for at in range(0, len(texts), 3):
        part = [t.encode() for t in texts[at:at + 3]]
        stream, ends = known.texts(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))
        assert [stream[a:b].tolist() for a, b in zip(ends, ends[1:])] == want[at:at + 3]
        assert len(known._known) <= 300 + 400 and len(known._older) <= 300 + 400
    # 4,800 words of 40 texts, of which some come back after they were forgotten.
    assert sum(asked) < 600


def test_tokenizers_whose_ids_depend_on_neighbours_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert P.WordEncoder(PATH).by_word and not P.WordEncoder(path).by_word
    tokenizer, texts = Tokenizer.from_file(path), ["Hello  there, world", "", None, " a\n b", "x" * 300]
    got = P.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 64).collect()
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want = [(at, zlib.crc32(ids[at:at + 64].tobytes()), len(ids)) for at in range(0, len(ids), 64)]
        assert sorted((r.start, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == k) == want


def test_equal_rows_fill_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 8)
    table = [(1, "one two three")] * 500 + [(k, "a " * (k % 9)) for k in range(200)]
    rows = P.pack(spark.createDataFrame(table, "doc_id long, text string").repartition(5), PATH, 64).collect()
    assert len(rows) == 700
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (t, p, _) in zip(places, places[1:]):
        assert (t, p) == ((s, o + n) if t == s else (s + 1, 0))
