import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumage.llm import bpe


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.default_path())
    found.no_padding()
    found.no_truncation()
    return found


LIBRARY = library()


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'<|>"), st.characters(exclude_categories=["Cs"]), st.sampled_from(["a", "the", "<|endoftext|>"]).map(lambda s: s[0])), max_size=60))
def test_same_ids_and_text_as_the_library(text):
    own = bpe.tokenizer(bpe.default_path())
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(own.encode(text)) == expected and own.decode(own.encode(text)) == LIBRARY.decode(expected, skip_special_tokens=False)


def test_special_tokens_runs_and_long_pieces():
    own = bpe.tokenizer(bpe.default_path())
    for text in ("<|endoftext|>", " a<|endoftext|><|endoftext|> b ", "x" * 20_000, "ab" * 5_000 + " \n\n " + "é" * 999, "it's we'LL  you're", "\n a\n\nb \n"):
        assert ids(own.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_memory_can_run_out():
    own = bpe.ByteLevelBpe(bpe.default_path())
    own.room = 10
    text = "some words that do not fit at all in so little memory " * 3
    assert ids(own.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids and own.room <= bpe.MEMO_CHARS


def test_bad_bytes_decode_as_the_library_does():
    own = bpe.tokenizer(bpe.default_path())
    for numbers in ([447], [447, 247], [50256, 447, 100], list(range(120, 256))):
        assert own.decode(struct.pack(f"<{len(numbers)}I", *numbers)) == LIBRARY.decode(numbers, skip_special_tokens=False)


def test_columns_round_trip(spark, make, odd):
    docs = make(odd).withColumns({"ids": F.lit(1), "decoded": F.lit(2), "batch": F.lit(3)})
    done = bpe.coded(docs, bpe.default_path(), decoded="decoded")
    assert done.columns == ["doc_id", "lang", "source", "n_chars", "batch", "ids", "decoded"]
    back = bpe.decode(done.drop("decoded"), bpe.default_path())
    key = lambda r: (r[0] or 0, r[1])
    given_texts = sorted([(r.doc_id, r.text or "") for r in docs.collect()], key=key)
    assert sorted([(r.doc_id, r.text) for r in back.collect()], key=key) == given_texts == sorted([(r.doc_id, r.decoded) for r in done.collect()], key=key)
    assert bpe.coded(make([]), bpe.default_path()).count() == 0
