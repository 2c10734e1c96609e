import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumage.llm import bestfit as B


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(B.default_path())
    found.no_padding()
    found.no_truncation()
    return lambda text: np.array([*found.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check(rows, capacity):
    """Sequences without gaps or overlaps; returns how many there are."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in held.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(held)


def test_odd_texts_are_encoded_as_the_library_does(library):
    rng = random.Random(4)
    parts = ["a", "b's", "'s", "é", "<|endoftext|>", "中文", "1", "12", "_", "\n", "\n\n", " ", "  ", "\t", "\r\n", " ", " ", "\x1c", "🙂", "é", "", "don't", "I'll", "\x00", "﻿"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None, "", " ".join(parts)]
    for text, ids in zip(texts, B.encoder(B.default_path()).encode(texts), strict=True):
        assert ids == library(text)[:-1].tobytes(), text


def test_latin_texts_take_the_ranks_and_equal_the_library(library):
    found = B.encoder(B.default_path())
    assert found.ranked is not None  # every token of the file is merged to itself
    rng = random.Random(8)
    characters = [chr(c) for c in range(0x250)]
    texts = ["".join(rng.choices(characters, k=rng.randint(1, 40))) for _ in range(1000)]
    texts += ["".join(rng.choices("aeionrst' \n", k=200)) for _ in range(1000)]
    assert not any(map(found.other, texts))
    assert [library(t)[:-1].tobytes() for t in texts] == found.encode(texts)


def test_vocabulary_that_ranks_do_not_fit_goes_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(B.default_path(), encoding="utf-8") as file:
        spec = json.load(file)
    chars = sorted(t for t in spec["model"]["vocab"] if len(t) == 1)
    # "ab" comes first, so "abc" by "a", "bc" is never reached from the text "abc"
    spec["model"] |= {"vocab": {t: i for i, t in enumerate([*chars, "ab", "bc", "abc"])}, "merges": ["a b", "b c", "a bc"]}
    spec["added_tokens"] = []
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(spec))
    found = B.Encoder(str(path))
    assert found.ranked is None
    assert [np.frombuffer(x, "<u4").tolist() for x in found.encode(["abc bc"])] == [Tokenizer.from_file(str(path)).encode("abc bc").ids]


def test_pieces_of_every_length():
    for n in range(1, 40):
        cut = B.pieces_of(n, 8)
        assert [s for s, _ in cut] == list(np.cumsum([0, *[m for _, m in cut]])[:-1]) and sum(m for _, m in cut) == n
        assert 1 <= cut[0][1] <= 8 and all(m == 8 for _, m in cut[1:]) and (n > 8 or len(cut) == 1)


def test_whole_query_against_the_library(spark, make, odd, prose, library):
    docs = odd + [(100 + i, prose(i, 5 + 37 * i % 900)) for i in range(80)] + [(7, None), (None, prose(3, 60)), (9, "x " * 4095), (10, "a<|endoftext|>b")]
    cut = B.pieces(make(docs).repartition(3), B.default_path())
    rows = B.packed(cut, cut.columns, "length").collect()
    want = []
    for i, text in docs:
        ids = library(text)
        want += [(i, k, s, n, crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(B.pieces_of(len(ids)))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    total = sum(n for *_, n, _ in want)
    assert -(-total // 2048) <= check(rows, 2048) <= -(-total // 2048) + 1


def lengths(spark, sizes):
    return spark.createDataFrame([(i, s, 5) for i, s in enumerate(sizes)], "k long, length long, offset int")


@pytest.mark.parametrize("high", [20, 60, 100])
def test_levels_come_near_one_best_fit(spark, monkeypatch, high):
    monkeypatch.setattr(B, "LOCAL", 512)
    monkeypatch.setattr(B, "OPEN", 32)
    rng = random.Random(high)
    sizes = [rng.randint(1, high) for _ in range(6000)]
    rows = B.packed(lengths(spark, sizes), ["k", "length", "offset"], "length", 100).collect()
    assert sorted((r.k, r.length) for r in rows) == list(enumerate(sizes))
    assert check(rows, 100) <= 1.03 * len(B.best_fit(sizes, 100)) + 1


def test_best_fit_takes_the_fullest_that_has_room():
    assert B.best_fit([60, 50, 40, 30, 10], 100) == [[0, 2], [1, 3, 4]]
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 30))]
        plain = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [b for b in plain if sum(sizes[j] for j in b) + sizes[i] <= 12]
            if fits:
                max(fits, key=lambda b: sum(sizes[j] for j in b)).append(i)
            else:
                plain.append([i])
        found = B.best_fit(sizes, 12)
        assert sorted(sum(found, [])) == list(range(len(sizes))) and sorted(sum(sizes[j] for j in b) for b in found) == sorted(sum(sizes[j] for j in b) for b in plain)


def test_hopeless_items_empty_table_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(B, "LOCAL", 64)
    monkeypatch.setattr(B, "OPEN", 8)
    rows = B.packed(lengths(spark, [60] * 1000), ["k", "length"], "length", 100).collect()  # no two share a sequence
    assert check(rows, 100) == 1000
    assert B.packed(lengths(spark, []), ["k", "length"], "length").count() == 0
    assert B.pieces(lengths(spark, []).select(F.col("k").alias("doc_id"), F.lit("").alias("text")), B.default_path()).count() == 0
    out = B.packed(lengths(spark, [3]).withColumns({"size": F.lit(1), "items": F.lit(2), "_length": F.lit(9)}), ["k", "length", "size", "items", "_length", "offset"], "length").first()
    assert (out.length, out.size, out["items"], out._length, out.offset) == (3, 1, 2, 9, 0)
