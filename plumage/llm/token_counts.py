"""Token counts through a cache keyed by content and tokenizer digests.

The cache is a Parquet table ``(content, tokenizer, n_tokens)`` in shared storage.
A document's count is looked up by the SHA-256 of its normalised text and the
SHA-256 of the tokenizer file; only distinct texts without a row are encoded, and
their counts are appended.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, documents, new_path, utf8_bytes

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
OVER = 2048
#: Bytes of words whose counts a worker remembers (some 600,000 words).
MEMO_BYTES = 12_000_000


def normalised(text: Column) -> Column:
    """The text with runs of ASCII white space as one space, and none at the ends.

    The tokenizer does the same to all white space before it splits, so equal
    normalised texts have equal tokens. Null counts as empty.
    """
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " "))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class WordCounter:
    """Counts the tokens of texts word by word, with a bounded memory of words.

    A tokenizer that drops white space and never merges across it gives a text as
    many tokens as its words have one by one. Words are cut at ASCII white space
    only; each is encoded by the library, special strings inside as its default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.memo: dict[bytes, int] = {}
        self.room = MEMO_BYTES

    def counts(self, texts: list[str | None]) -> list[int]:
        if self.room < 0:
            self.memo.clear()
            self.room = MEMO_BYTES
        memo = self.memo
        out = []
        for at in range(0, len(texts), 64):
            words = [(t or "").encode("utf-8").split() for t in texts[at : at + 64]]
            missing = list(set().union(*[set(w).difference(memo) for w in words]))
            if missing:
                found = self.library.encode_batch_fast([m.decode("utf-8") for m in missing], add_special_tokens=False)
                memo.update(zip(missing, map(len, found), strict=True))
                self.room -= sum(map(len, missing)) + 8 * len(missing)
            out += [sum(map(memo.__getitem__, w)) for w in words]
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> WordCounter:
    """One counter a worker process and file."""
    return WordCounter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fill_cache(docs: DataFrame, cache: str, tokenizer_path: str, text: str = "text") -> None:
    """Encode the distinct texts of ``docs`` that the cache lacks, and append them.

    Equal texts meet once in every task before the shuffle, so a text that a third
    of the rows have is no hot key.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    rows = docs.select(content_digest(F.col(text)).alias("content"), F.coalesce(text, F.lit("")).alias("text"))
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version).select("content")
    misses = rows.join(known, "content", "left_anti") if not known.isEmpty() else rows
    distinct = misses.groupBy("content").agg(F.first("text").alias("text"))

    def batches(source):
        import pyarrow as pa

        found = counter(tokenizer_path)
        for batch in source:
            counts = found.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["content", "tokenizer", "n_tokens"])

    distinct.mapInArrow(batches, CACHE_SCHEMA).write.mode("append").parquet(cache)


def create_cache(spark, cache: str) -> str:
    """An empty cache at a new path."""
    spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)
    return cache


def with_token_counts(docs: DataFrame, cache: str, tokenizer_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) and ``n_tokens``, which replaces one of that name.

    ``cache`` is the path of a cache table in storage that all executors share. A
    null text counts as empty and has no tokens. Repeated rows keep their number;
    an empty table gives no rows and leaves the cache as it is.
    """
    fill_cache(docs, cache, tokenizer_path, text)
    version = tokenizer_digest(tokenizer_path)
    counts = docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    counts = counts.groupBy("content").agg(F.max("n_tokens").alias("_n_tokens"))  # two runs may have appended the same text
    kept = [c for c in (docs.columns if keep is None else keep) if c != "n_tokens"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), content_digest(F.col(text)).alias("_content"))
    return rows.join(counts, F.col("_content") == F.col("content"), "left").select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_n_tokens").alias("n_tokens"))


def op2_cached_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, counted through a cache that starts empty."""
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("n_bytes", utf8_bytes(F.col("text")))
    cache = create_cache(spark, new_path(spark, "token-cache"))
    out = with_token_counts(docs, cache, default_path(), keep=["doc_id", "n_bytes"])
    return out.withColumn("over_limit", F.col("n_tokens") > OVER)
