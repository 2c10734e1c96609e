"""Byte-level BPE: encoding by a priority queue of merge ranks, and decoding.

The symbols of a piece form a doubly linked list. A heap holds the ranks of
adjacent pairs with their places; the least rank is merged first, the leftmost of
equal ones. A heap entry whose pair has changed since is stale and skipped.
Decoding concatenates the byte strings of the vocabulary.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Characters (and 8 for each piece) that a worker remembers: some 600,000 words, below 200 MB.
MEMO_CHARS = 12_000_000
#: Longer pieces are encoded each time they occur.
MEMO_PIECE = 64


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteLevelBpe:
    """Tokenizer of a byte-level BPE file in the JSON format of the tokenizers library.

    Special tokens found in a text are single tokens, as is that library's default.
    """

    #: Fixed value: the split pattern that byte-level vocabularies of this kind are used with.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        chars = byte_characters()
        bytes_of = {c: b for b, c in chars.items()}
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab[chars[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocabulary = {i: bytes(bytes_of[c] for c in token) for token, i in vocab.items() if all(c in bytes_of for c in token)}
        self.vocabulary |= {i: token.encode("utf-8") for token, i in self.special.items()}
        self.split = regex.compile(self.PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.packed_special = {name: struct.pack("<I", i) for name, i in self.special.items()}
        self.memo: dict[str, bytes] = {}
        self.room = MEMO_CHARS

    def merged(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        symbols = [self.byte_ids[b] for b in data]
        n = len(symbols)
        if n < 2:
            return symbols
        merge = self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*found, i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := merge(pair))]
        heapify(heap)
        while heap:
            _, new, at, one, two = heappop(heap)
            right = after[at]
            if symbols[at] != one or right < 0 or symbols[right] != two:
                continue  # stale: another pair, or none, stands here now
            symbols[at], symbols[right] = new, -1
            follow = after[at] = after[right]
            if follow >= 0:
                before[follow] = at
                if found := merge((new, symbols[follow])):
                    heappush(heap, (*found, at, new, symbols[follow]))
            left = before[at]
            if left >= 0 and (found := merge((symbols[left], new))):
                heappush(heap, (*found, left, symbols[left], new))
        return [s for s in symbols if s >= 0]

    def piece(self, text: str) -> bytes:
        """Packed ids of a piece between safe boundaries, remembered with its parts."""
        parts = self.split(text)
        if len(parts) > 1:
            memo, piece = self.memo, self.piece
            out = b"".join([memo.get(p) or piece(p) for p in parts])
        else:
            ids = self.merged(text.encode("utf-8"))
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= MEMO_PIECE:
            self.room -= len(text) + 8
            if self.room < 0:
                self.memo.clear()
                self.room = MEMO_CHARS
            self.memo[text] = out
        return out

    def plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens.

        Where all white space is single spaces and line feeds between other
        characters, pieces can be cut before each of them; other texts are split
        by the pattern as a whole.
        """
        memo, piece = self.memo, self.piece
        if text.replace("\n", " ").split(" ") != text.split():
            return b"".join([memo.get(p) or piece(p) for p in self.split(text)])
        out = []
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            first = "\n" + words[0] if i else words[0]
            out.append(memo.get(first) or piece(first))
            out += [memo.get(w) or piece(w) for w in [" " + x for x in words[1:]]]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null and empty: none."""
        if not text:
            return b""
        if self.specials is None or not any(name in text for name in self.special):
            return self.plain(text)
        return b"".join([self.packed_special.get(part) or (self.plain(part) if part else b"") for part in self.specials.split(text)])

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become replacement characters, unknown ids are nothing."""
        import numpy as np

        vocabulary = self.vocabulary
        return b"".join([vocabulary.get(i, b"") for i in np.frombuffer(packed, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteLevelBpe:
    """One tokenizer a worker process and file."""
    return ByteLevelBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coded(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the packed ids of a text column and, if named, the text decoded from them.

    The text column is replaced by them, as are columns that have their names;
    other columns stay. A null text counts as
    empty. No shuffle; a task holds one Arrow batch and its bounded memory of pieces.
    """
    others = [c for c in df.columns if c not in (text, ids, decoded)]

    def batches(source):
        import pyarrow as pa

        bpe = tokenizer(path)
        for batch in source:
            packed = [bpe.encode(t) for t in batch.column(len(others)).to_pylist()]
            arrays = [*batch.columns[: len(others)], pa.array(packed, pa.binary())]
            if decoded:
                arrays.append(pa.array([bpe.decode(p) for p in packed], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*others, ids, *([decoded] if decoded else [])])

    rows = df.select(*[F.col(f"`{c}`") for c in others], text)
    schema = rows.drop(text).withColumn(ids, F.lit(b"").cast("binary"))
    schema = schema.withColumn(decoded, F.lit("")) if decoded else schema
    return rows.mapInArrow(batches, schema.schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replace packed ids by the text that they stand for; null ids: empty text."""
    others = [c for c in df.columns if c not in (ids, text)]

    def batches(source):
        import pyarrow as pa

        bpe = tokenizer(path)
        for batch in source:
            texts = [bpe.decode(p or b"") for p in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string())], [*others, text])

    rows = df.select(*[F.col(f"`{c}`") for c in others], ids)
    return rows.mapInArrow(batches, rows.drop(ids).withColumn(text, F.lit("")).schema)


def op10_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    done = coded(documents(spark, sf_dir, "doc_id", "text"), default_path(), decoded="decoded")
    return done.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
