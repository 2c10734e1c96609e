"""Best-fit packing of documents into token sequences, by merging residues in a tree.

Every task packs its own items by best fit, largest first: an item goes to the
fullest sequence that has room. Sequences that come out nearly full are done. The
others become items themselves, of their filled length, and are packed again with
those of other tasks, until what is left fits one task. Each level leaves at most
one sixteenth of a task's items open, so the levels are few and no task, the last
one included, holds more than a fixed number of items.
"""

from __future__ import annotations

import functools
import os
import re
from functools import lru_cache
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteLevelBpe, default_path
from .common import documents, written

CAPACITY = 2048
#: Items of a task; twice as many at most where rows are dealt unevenly.
LOCAL = 32_768
#: Sequences of a task that stay open for the next level, the emptiest first.
OPEN = LOCAL // 16
#: A sequence that lacks no more than this part of the capacity is nearly full.
NEARLY = 512
#: Characters whose classes (letter, number, space) every library's tables agree on.
COMMON = "\u0000-\u024f"


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, at the speed of rank-based merging.

    A rank-based encoder merges two neighbours whenever their concatenation is a
    token, the library only if the pair is in the list of merges. Both do the same
    where every token, taken by itself, is merged to that token by the list: what
    lies between a token's ends is merged as if nothing stood around it. This is
    checked when the file is loaded. A file that fails it, texts with special strings
    and texts with characters outside ``COMMON`` are encoded by the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        listed = ByteLevelBpe(path)
        ids = listed.byte_ids + [new for _, new in listed.merges.values()]
        ranks = {listed.vocabulary[i]: rank for rank, i in enumerate(ids)}
        same = len(ranks) == len(ids) and all(listed.merged(listed.vocabulary[i]) == [i] for i in ids)
        self.ranked = tiktoken.Encoding("ranks", pat_str=listed.PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None
        self.ids = np.array(ids, dtype="<u4")
        self.other = re.compile("|".join([f"[^{COMMON}]", *map(re.escape, listed.special)])).search

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null and empty: none."""
        import numpy as np

        texts = [t or "" for t in texts]
        by_library = [t for t in texts if self.ranked is None or self.other(t)]
        found = iter(self.library.encode_batch_fast(by_library, add_special_tokens=False))
        return [np.array(next(found).ids, dtype="<u4").tobytes() if self.ranked is None or self.other(t) else self.ids[self.ranked.encode_to_numpy(t)].tobytes() for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)


def pieces_of(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: only the first may be shorter than the capacity."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the tokens of each text, then id ``end``, cut.

    A null text counts as empty: it has the one id ``end``. Repeated rows and rows
    without a doc_id are documents of their own; other columns are not read. A task
    holds one Arrow batch of texts and the ids of 512 of them.
    """
    closing = end.to_bytes(4, "little")

    def batches(source):
        import pyarrow as pa

        found = encoder(path)
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), found.encode(part.column(1).to_pylist()), strict=True):
                    ids += closing
                    rows += [(doc_id, i, start, n, crc32(ids[4 * start : 4 * (start + n)])) for i, (start, n) in enumerate(pieces_of(len(ids) // 4, capacity))]
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each sequence, by best fit from the largest item down.

    Sequences wait by their room; a bit set of the rooms that occur finds the least
    one that suffices without a search.
    """
    waiting: dict[int, list[int]] = {}
    rooms, out = 0, []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
            out[at].append(i)
        else:
            room, at = capacity, len(out)
            out.append([i])
        room -= size
        if room > 0:
            waiting.setdefault(room, []).append(at)
            rooms |= 1 << room
    return out


def packed_level(items: DataFrame, parts: int, capacity: int, last: bool) -> DataFrame:
    """Sequences ``(size, items, done)`` packed from ``(size, items)`` in ``parts`` tasks.

    ``items`` is an array of structs; their field ``_length`` is read and ``_offset`` set.
    Rows are dealt in turn, so no value of theirs can fill one task.
    """
    schema = items.withColumn("done", F.lit(True)).schema

    def sequences(batches):
        import numpy as np
        import pyarrow as pa

        table = pa.Table.from_batches(batches).combine_chunks()
        bins = best_fit(table.column("size").to_pylist(), capacity)
        order = np.concatenate(bins).astype(np.int64)
        first = np.concatenate([[0], np.cumsum([len(b) for b in bins])])[:-1]
        sizes = np.add.reduceat(table.column("size").to_numpy()[order], first)
        lists = table.column("items").combine_chunks().take(pa.array(order))
        counts = np.add.reduceat(lists.value_lengths().to_numpy(), first)
        heads = np.concatenate([[0], np.cumsum(counts)])
        values = lists.flatten()
        names = [field.name for field in values.type]
        lengths = values.field("_length").to_numpy()
        before = np.cumsum(lengths) - lengths
        offsets = pa.array(before - np.repeat(before[heads[:-1]], counts))
        structs = pa.StructArray.from_arrays([offsets if n == "_offset" else values.field(n) for n in names], names)
        done = np.ones(len(bins), dtype=bool)
        if not last:
            emptiest = np.argsort(sizes, kind="stable")[:OPEN]
            done[emptiest] = capacity - sizes[emptiest] <= capacity // NEARLY
        return pa.RecordBatch.from_arrays([pa.array(sizes), pa.ListArray.from_arrays(pa.array(heads, pa.int32()), structs), pa.array(done)], ["size", "items", "done"])

    def tasks(source):
        block, rows = [], 0
        for batch in source:
            block.append(batch)
            rows += batch.num_rows
            if rows >= 2 * LOCAL:
                yield sequences(block)
                block, rows = [], 0
        if rows:
            yield sequences(block)

    return items.repartition(parts).mapInArrow(tasks, schema)


def packed(rows: DataFrame, keys: list[str], length: str, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``keys``: few sequences of at most ``capacity``.

    ``keys`` are the columns to keep, ``length`` (a long from 1 to the capacity)
    among them; keys named like the added columns are replaced by those. Equal rows
    each get a place. The number of a sequence has no meaning. An empty table gives
    no rows. Each level reads and writes a table, so a lost executor costs its own
    tasks, and their repetition makes the same sequences.
    """
    keys = [c for c in keys if c not in ("sequence_id", "offset")]
    fields = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]  # inner names can't clash
    one = F.struct(*fields, F.col(f"`{length}`").cast("long").alias("_length"), F.lit(0).cast("long").alias("_offset"))
    items = rows.select(F.col(f"`{length}`").cast("long").alias("size"), F.array(one).alias("items"))
    done, n = [], rows.count()
    while True:
        parts = max(1, -(-n // LOCAL))
        level = written(packed_level(items, parts, capacity, parts == 1), f"best-fit-{len(done)}")
        done.append(level.filter("done").select("items"))
        items = level.filter("not done").select("size", "items")
        n = 0 if parts == 1 else items.count()
        if not n:
            break
    sequences = functools.reduce(DataFrame.unionByName, done).withColumn("sequence_id", F.monotonically_increasing_id())
    placed = sequences.select("sequence_id", F.inline("items"))
    return placed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], "sequence_id", F.col("_offset").alias("offset"))


def op12_best_fit_sequences(spark, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    cut = written(pieces(documents(spark, sf_dir, "doc_id", "text"), default_path()), "pieces")
    return packed(cut, cut.columns, "length")
