from plumage.llm import token_counts as T
from plumage.llm.common import new_path


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_path())


def test_counts_equal_the_library(spark, make, odd):
    tricky = [(20, "it's  WE'LL <|endoftext|> x<|startoftext|>y"), (21, "á ́b   c　d\x1ce\x85f"), (22, "ΣΑΣ ΟΔΟΣ ς x"), (23, "9" * 300 + " \U0001f600\U0001f600"), (24, "  a\tb\r\nc\x0bd\x0c ")]
    docs = make(odd + tricky)
    out = T.with_token_counts(docs, T.create_cache(spark, new_path(spark, "cache")), T.default_path())
    assert out.columns == [*docs.columns, "n_tokens"] and out.count() == docs.count()
    lib = library()
    for r in out.collect():
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids), r.text


def test_cache_is_appended_once_and_read(spark, make):
    cache = T.create_cache(spark, new_path(spark, "cache"))
    T.with_token_counts(make([(1, "a b"), (2, "a  b"), (3, "c")]), cache, T.default_path()).collect()
    assert spark.read.parquet(cache).count() == 2
    spark.createDataFrame([(b"x", "other version", 9)], T.CACHE_SCHEMA).write.mode("append").parquet(cache)
    out = T.with_token_counts(make([(1, "a b"), (4, "new words")]), cache, T.default_path())
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {1: 2, 4: 2}
    assert spark.read.parquet(cache).count() == 4
    known = {r.content: r.n_tokens for r in spark.read.parquet(cache).collect()}
    poisoned = spark.createDataFrame([(k, T.tokenizer_digest(T.default_path()), v + 100) for k, v in known.items() if k != b"x"], T.CACHE_SCHEMA)
    path = new_path(spark, "cache")
    poisoned.write.parquet(path)
    assert {r.n_tokens for r in T.with_token_counts(make([(1, "a b")]), path, T.default_path()).collect()} == {102}  # it was read, not encoded


def test_empty_and_clashing_names(spark, make):
    from pyspark.sql import functions as F

    cache = T.create_cache(spark, new_path(spark, "cache"))
    assert T.with_token_counts(make([]), cache, T.default_path()).count() == 0
    docs = make([(1, "a b")]).withColumns({"content": F.lit(1), "_content": F.lit(2), "n_tokens": F.lit(-1), "_row": F.lit(3)})
    row = T.with_token_counts(docs, cache, T.default_path()).first()
    assert (row.content, row._content, row._row, row.n_tokens) == (1, 2, 3, 2)


def test_memory_is_bounded():
    c = T.WordCounter(T.default_path())
    c.room = 50
    assert c.counts(["abc def " * 20]) == [40] and c.counts(["x" * 100]) == [len(library().encode("x" * 100).ids)]
    assert c.room < T.MEMO_BYTES and c.counts(["abc"]) == [1]
