"""Fuzzy passages that documents share, by collinear chaining of k-mer seeds.

1. Seeds: every document's 8-word k-mers are winnowed (the least hash of each 16
   neighbours), so two texts that share 23 words in a row share a seed.
2. Join: every seed is matched with the first document that has it, and seeds that
   no passage covers then with the last one before theirs. Pairs of such seeds that
   no passage covers even then are matched with the first document that has both
   within ``REACH`` words: documents that quote less of a passage than lies between
   two of its seeds have no such pair, however many of them own its seeds. Matches
   grow with the seeds, however many documents share one.
3. Chain: matches of a document with one earlier document are chained in order in
   both, with gap costs, through a Fenwick tree of prefix maxima.
4. Align: the words between and around a chain's seeds are compared, chains with
   too little in common are cut at their widest gap, and passages of at least 50
   words whose 5-word shingles have a Jaccard similarity of 0.8 or more remain.
5. Complete: windows of 50 words around matched seeds that no passage covers are
   matched with the first document that has the whole window, so that no exact run
   of 50 words is lost where the documents of its seeds have parts of it. As few of
   these runs are taken as cover all their words.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE_CLASS, among, documents, one_row_each, unwritten, written

K = 8
WINNOW = 16
SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 50
#: Cost of a word between two seeds, on either side; a seed earns K.
GAP_COST = 0.05
#: Words around a chain that alignment may extend it by; slices are cut at multiples.
MARGIN = 32
GRID = 64
#: Least holders of seeds that are worth a task of their own when they are put in order.
HOLDERS = 4_096
#: Most words from one seed to another that it is matched together with.
REACH = 96
#: Words among which one seed is chosen for a pair.
STEP = 16
#: Bytes of texts that are taken apart at once.
PART_BYTES = 1 << 20

SPAN_SCHEMA = "doc_id long, start_word int, end_word int, src_doc_id long, src_start_word int, src_end_word int, n_matched int, similarity double"
CHAIN_SCHEMA = "doc long, src long, lo int, hi int, slo int, shi int, at array<int>, sat array<int>"


def hashed_words(texts):
    """Hashes of all words of an Arrow array of texts (A-Z in lower case), and where each text's begin, and the last one's end.

    Each word of the array is hashed once, however often it comes.
    """
    import numpy as np
    import pyarrow.compute as pc
    from xxhash import xxh64_intdigest

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    filled = pc.binary_length(words).to_numpy() > 0  # white space at an end gives an empty word
    bounds = np.concatenate([[0], np.cumsum(filled)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
    coded = words.dictionary_encode()
    once = np.fromiter(map(xxh64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(coded.dictionary))  # of their UTF-8
    return once[coded.indices.to_numpy()[filled]], bounds


def runs_of(hashed, size: int):
    """Hashes of all runs of ``size`` words, from those of the words."""
    import numpy as np

    n = len(hashed) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed += hashed[j : j + n]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def ranges(starts, counts):
    """``counts`` whole numbers from each of the ``starts`` on, one range after the other."""
    import numpy as np

    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def least_of(mixed):
    """Place of the least hash of each ``WINNOW`` neighbours."""
    import numpy as np

    if len(mixed) <= WINNOW:
        return np.array([int(mixed.argmin())] if len(mixed) else [], dtype=np.int64)
    least, value, width = np.arange(len(mixed)), mixed, 1
    while width < WINNOW:  # the least of a run, from those of two that make it up; of equals the first
        step = min(width, WINNOW - width)
        later = value[step:] < value[:-step]
        least, value = np.where(later, least[step:], least[:-step]), np.where(later, value[step:], value[:-step])
        width += step
    return least


def seeds_of(texts):
    """Winnowed k-mers of an Arrow array of texts: ``(text, pos, h, first, words)``, see :func:`seeds`; ``text`` counts from 0."""
    import numpy as np

    hashed, bounds = hashed_words(texts)
    mixed, begins, words = runs_of(hashed, K), bounds[:-1], np.diff(bounds)
    places = [np.zeros(0, dtype=np.int64)]
    whole = words >= K + WINNOW - 1
    if whole.any():
        places.append(least_of(mixed)[ranges(begins[whole], words[whole] - K - WINNOW + 2)])
    for i in np.flatnonzero((words >= K) & ~whole):
        places.append(begins[i] + least_of(mixed[begins[i] : begins[i] + words[i] - K + 1]))
    at = np.unique(np.concatenate(places))
    text, h = np.searchsorted(bounds, at, side="right") - 1, mixed[at]
    order = np.lexsort((h, text))  # equal seeds of a text by place
    first = np.ones(len(at), dtype=bool)
    first[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    return text, at - bounds[text], h, first, words[text]


def windows_of(texts, shared):
    """Runs of ``MIN_WORDS`` words of an Arrow array of texts whose seeds are all at the places ``shared`` (a list for each): ``(text, pos, w)``.

    Seeds of a run are the least k-mers of neighbours inside it, so equal runs have
    equal ones. A run's hash is made of those of the k-mers that it consists of.
    """
    import numpy as np
    import pyarrow.compute as pc

    hashed, bounds = hashed_words(texts)
    mixed, begins, words = runs_of(hashed, K), bounds[:-1], np.diff(bounds)
    counts = np.maximum(words - MIN_WORDS + 1, 0)
    if not counts.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least = least_of(mixed)
    inside = MIN_WORDS - K + 1 - WINNOW + 1
    lonely = np.ones(len(mixed), dtype=bool)
    lonely[np.repeat(begins, pc.list_value_length(shared).to_numpy()) + shared.flatten().to_numpy()] = False
    alone = np.concatenate([[0], np.cumsum(lonely[least])])
    at = ranges(begins, counts)
    text = np.repeat(np.arange(len(counts)), counts)
    kept = alone[at + inside] == alone[at]
    at, text = at[kept], text[kept]
    whole = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in (*range(0, MIN_WORDS - K, K), MIN_WORDS - K):
            whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + mixed[at + part]
    return text, at - bounds[text], whole


def parts_of(batch, column: int):
    """Slices of an Arrow batch of about ``PART_BYTES`` of the texts in ``column``, one text at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = np.flatnonzero(np.diff(ends // PART_BYTES)) + 1
    for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def seeds(docs: DataFrame) -> DataFrame:
    """``(h, doc, pos, first, words)``: seeds of all documents; ``first``: not seen before in the text; ``words`` in the text."""

    def batches(source):
        import numpy as np
        import pyarrow as pa

        for batch in source:
            for part in parts_of(batch, 1):
                text, pos, h, first, words = seeds_of(part.column(1))
                columns = [h.view(np.int64), part.column(0).to_numpy()[text], pos.astype(np.int32), first, words.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "doc", "pos", "first", "words"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(batches, "h long, doc long, pos int, first boolean, words int")


def owners_of(found: DataFrame) -> DataFrame:
    """The first document of each seed that two or more have: ``(h, src, spos)``."""
    return found.filter("first").groupBy("h").agg(F.min("doc").alias("src"), F.min_by("pos", "doc").alias("spos"), F.max("doc").alias("last")).filter("src < last").select("h", "src", "spos")


def shared_seeds(found: DataFrame, owners: DataFrame) -> DataFrame:
    """Seeds that two or more documents have, with the first of these: ``(h, doc, pos, first, words, src, spos)``.

    ``owners``, see :func:`owners_of`, is a table of its own, so that Spark can split
    the join for a seed that very many documents have.
    """
    return found.join(owners.hint("shuffle_hash"), "h").select("h", "doc", "pos", "first", "words", "src", "spos")


def nearest_matches(found: DataFrame, left: DataFrame) -> DataFrame:
    """Seeds ``left(h)`` matched with the last document before theirs that has them: ``(doc, src, pos, spos, words)``.

    The documents that hold a seed are put in order in ranges of seeds and ids that
    have about equally many rows, and the first of a range follows the last of the
    range before it. So no task has to sort all holders of a frequent seed, however
    their ids are spread.
    """
    holders = written(found.filter("first").join(left, "h").select("h", "doc", "pos", "words"), "open-holders")
    most = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = holders.repartitionByRange(max(1, min(most, holders.count() // HOLDERS)), "h", "doc")
    placed = written(ranges.withColumn("block", F.spark_partition_id()), "open-blocks")
    at = F.struct("doc", "pos")
    before = F.lag("last").over(Window.partitionBy("h").orderBy("block"))
    ends = placed.groupBy("h", "block").agg(F.max(at).alias("last")).select("h", "block", before.alias("before"))
    ordered = placed.withColumn("near", F.lag(at).over(Window.partitionBy("h", "block").orderBy("doc")))
    near = ordered.join(ends, ["h", "block"]).select("doc", "pos", "words", F.coalesce("near", "before").alias("near")).filter("near is not null")
    return near.select("doc", F.col("near.doc").alias("src"), "pos", F.col("near.pos").alias("spos"), "words")


def seed_pairs(rows: DataFrame) -> DataFrame:
    """Each of the seeds ``rows(doc, pos, h, src, spos, asks)`` with those after it that it is paired with: ``(doc, pos, pos2, h, h2, asks)``.

    See :func:`pair_matches`. The seeds of a text are compared with the next ones,
    those after the next ones and so on, as far as ``REACH``, all at once.
    """

    def batches(source):
        import numpy as np
        import pyarrow as pa

        def closed(rows):
            doc, pos, h, src, spos, asks = rows
            chosen = np.full((REACH // STEP, len(doc)), -1)
            for step in range(1, len(doc)):
                apart, other = pos[step:] - pos[:-step], spos[step:] - spos[:-step]
                near = (doc[step:] == doc[:-step]) & (apart <= REACH)
                if not near.any():
                    break
                again = (src[step:] == src[:-step]) & (K <= other) & (other <= REACH)
                at = np.flatnonzero(near & (apart >= K) & (h[step:] != h[:-step]) & ~again)
                stretch = (apart[at] - 1) // STEP
                held = chosen[stretch, at]
                less = (held < 0) | (h[at + step] < h[held])  # of equals the first
                chosen[stretch[less], at[less]] = at[less] + step
            at = np.flatnonzero((chosen >= 0).ravel())
            to, at = chosen.ravel()[at], at % max(1, len(doc))
            columns = [doc[at], pos[at], pos[to], h[at], h[to], asks[at] & asks[to]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "pos", "pos2", "h", "h2", "asks"])

        yield from map(closed, whole_groups(source))

    ordered = rows.select("doc", "pos", "h", "src", "spos", "asks").repartition("doc").sortWithinPartitions("doc", "pos")
    return ordered.mapInArrow(batches, "doc long, pos int, pos2 int, h long, h2 long, asks boolean")


def pair_matches(shared: DataFrame, left: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of seeds ``left(h)`` matched with the first document that has both, seed by seed: ``(doc, src, pos, spos)``.

    Each seed is paired, among the seeds that follow it within ``REACH`` words, with
    the one of the least hash in each ``STEP`` words, so that texts in which that
    one is left alone choose the same, and pairs grow with the seeds. A pair whose
    seeds have one owner, as near to each other, would meet that one again, and is
    left out. Pairs of which ``spans`` cover a seed ask for no match, but may be the match.
    """
    covers = spans.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))  # at most the seeds of one text
    covered = F.exists("spans", lambda s: (s["start_word"] <= F.greatest(F.col("pos") + K - MIN_WORDS, F.lit(0))) & (F.least(F.col("pos") + MIN_WORDS, "words") <= s["end_word"]))
    rows = shared.join(left.hint("shuffle_hash"), "h").join(covers, "doc", "left").withColumn("asks", ~F.coalesce(covered, F.lit(False)))
    pairs = written(seed_pairs(rows).select(F.xxhash64("h", "h2").alias("p"), "doc", "pos", "pos2", "asks"), "seed-pairs")
    first = pairs.groupBy("p").agg(F.min(F.struct("doc", "pos", "pos2")).alias("o"), F.max("doc").alias("last")).filter("o.doc < last").select("p", "o")
    first = written(first, "pair-owners")
    met = pairs.filter("asks").join(first, "p").filter("doc <> o.doc")
    ends = F.explode(F.array(F.struct("pos", F.col("o.pos").alias("spos")), F.struct(F.col("pos2").alias("pos"), F.col("o.pos2").alias("spos"))))
    out = written(met.select("doc", F.col("o.doc").alias("src"), ends.alias("at")).select("doc", "src", "at.*").distinct(), "pair-matches")
    for table in (pairs, first):
        unwritten(table)
    return out


def whole_groups(source):
    """Columns of Arrow batches sorted by the first, as numpy arrays, so that equal values of the first come together."""
    import numpy as np

    held = None
    for batch in source:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        # the last document may go on in the next batch; its matches are no more than its seeds
        cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
        if cut:
            yield [c[:cut] for c in rows]
        held = [c[cut:] for c in rows]
    if held is not None:
        yield held


def chain(pos, spos) -> list[list[int]]:
    """Collinear chains of matches sorted by ``pos``; lists of indexes, best chains first.

    The score of a chain is ``K`` a match less ``GAP_COST`` for each step that it
    takes in either text. ``score + GAP_COST * (pos + spos)`` does not depend on the
    match that follows, so the best predecessor is a prefix maximum over ``spos``,
    which a Fenwick tree keeps while ``pos`` rises.
    """
    n = len(pos)
    ranks = sorted(set(spos))
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    score, back = [0.0] * n, [-1] * n
    at = 0
    while at < n:
        end = at
        while end < n and pos[end] == pos[at]:
            end += 1
        for i in range(at, end):  # all of one place first: they can't follow each other
            r, best = bisect_left(ranks, spos[i]), (float("-inf"), -1)
            while r > 0:
                best = max(best, tree[r])
                r -= r & -r
            gain = best[0] - GAP_COST * (pos[i] + spos[i])
            score[i] = K + max(0.0, gain)
            back[i] = best[1] if gain > 0 else -1
        for i in range(at, end):
            r, value = bisect_left(ranks, spos[i]) + 1, (score[i] + GAP_COST * (pos[i] + spos[i]), i)
            while r <= len(ranks):
                if value > tree[r]:
                    tree[r] = value
                r += r & -r
        at = end
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        path, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(at)
            at = back[at]
        if len(path) > 1:
            out.append(path[::-1])
    return out


def chains(found: DataFrame) -> DataFrame:
    """Chains of two or more seeds between a document and an earlier one."""

    def batches(source):
        import numpy as np
        import pyarrow as pa

        def closed(rows):
            doc, src, pos, spos = rows
            out = []
            edges = np.flatnonzero((np.diff(doc) != 0) | (np.diff(src) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(doc)], strict=True):
                if hi - lo > 1:
                    p, s = pos[lo:hi].tolist(), spos[lo:hi].tolist()
                    for path in chain(p, s):
                        a, b = [p[i] for i in path], [s[i] for i in path]
                        out.append((int(doc[lo]), int(src[lo]), a[0], a[-1] + K, b[0], b[-1] + K, a, b))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names)

        names = ["doc", "src", "lo", "hi", "slo", "shi", "at", "sat"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield from map(closed, whole_groups(source))

    return found.select("doc", "src", "pos", "spos").repartition("doc").sortWithinPartitions("doc", "src", "pos", "spos").mapInArrow(batches, CHAIN_SCHEMA)


def lcs(a: list, b: list) -> int:
    """Words that the best alignment of two gaps has in common; a bit for each word of ``a``."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole  # a zero where the longest alignment grows
    for y in b:
        same = row & places.get(y, 0)
        row = (row + same | row - same) & whole
    return len(a) - row.bit_count()


def similarity(a: list, b: list) -> float:
    """Jaccard similarity of the 5-word shingles (whole sequences, if shorter)."""
    grams = lambda w: set(zip(*[w[i:] for i in range(SHINGLE)], strict=False)) or {tuple(w)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def aligned(a: list, b: list, at: list[int], bat: list[int], unequal: list[int] | None = None) -> list[tuple[int, int, int, int, int, float]]:
    """Passages around a chain: ``(lo, hi, slo, shi, matched, similarity)`` in word places.

    ``at`` and ``bat`` are the places of the chain's seeds in the words ``a`` and ``b``.
    The ends grow while words are equal; the words between two seeds are matched as
    far as they are equal from the left, and the rest is aligned. A chain that isn't
    similar enough is cut in its gap with the most unequal words; its parts take along
    how many are ``unequal`` in each of their gaps.
    """
    lo, slo = at[0], bat[0]
    while lo > 0 and slo > 0 and a[lo - 1] == b[slo - 1]:
        lo, slo = lo - 1, slo - 1
    hi, shi = min(at[-1] + K, len(a)), min(bat[-1] + K, len(b))
    while hi < len(a) and shi < len(b) and a[hi] == b[shi]:
        hi, shi = hi + 1, shi + 1
    if min(hi - lo, shi - slo) < MIN_WORDS:
        return []
    if a[lo:hi] == b[slo:shi] and all(p - s == lo - slo for p, s in zip(at, bat, strict=True)):  # the same in every gap
        return [(lo, hi, slo, shi, hi - lo, 1.0)]
    if unequal is None:
        unequal = []
        for i in range(len(at) - 1):
            p, s = at[i] + K, bat[i] + K
            while p < at[i + 1] and s < bat[i + 1] and a[p] == b[s]:
                p, s = p + 1, s + 1
            gap, other = max(0, at[i + 1] - p), max(0, bat[i + 1] - s)
            common = lcs(a[p : p + gap], b[s : s + other]) if gap and other else 0
            unequal.append(max(gap, other) - common)
    found = similarity(a[lo:hi], b[slo:shi])
    if found >= SIMILARITY:
        return [(lo, hi, slo, shi, max(0, max(hi - lo, shi - slo) - sum(unequal)), found)]
    if not unequal or max(unequal) == 0:
        return []
    cut = unequal.index(max(unequal)) + 1
    return aligned(a, b, at[:cut], bat[:cut], unequal[: cut - 1]) + aligned(a, b, at[cut:], bat[cut:], unequal[cut:])


def passages(docs: DataFrame) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` that an earlier document (smaller doc_id) has too.

    One row a passage, see :data:`SPAN_SCHEMA`; places count white-space words from
    0, ends are exclusive. Documents that share nothing have no row. ``doc_id`` names
    a document; of rows that repeat it one counts (:func:`one_row_each`), and rows
    without one, null texts and texts below 50 words take no part. Very long texts
    are compared whole. An empty table gives no rows.
    """
    docs = one_row_each(docs).select("doc_id", "text")
    found = written(seeds(docs), "seeds")
    owners = written(owners_of(found), "seed-owners")
    shared = written(shared_seeds(found, owners), "shared-seeds")
    for table in (found, owners):  # all that follows is about seeds that two or more have
        unwritten(table)
    met = shared.filter("doc <> src")
    first = written(alignments(docs, written(chains(met), "chains")), "first-passages")
    open_first = written(uncovered(met, first), "open-matches")
    near = uncovered(nearest_matches(shared, seeds_in(open_first)), first)
    second = written(alignments(docs, written(chains(near), "near-chains")), "second-passages")
    open_second = written(uncovered(open_first, second), "open-matches")
    paired = pair_matches(shared, seeds_in(open_second), first.unionByName(second))
    third = written(alignments(docs, written(chains(paired), "pair-chains")), "third-passages")
    known = first.unionByName(second).unionByName(third)
    runs = window_runs(docs, shared, seeds_in(uncovered(open_second, third)), known)
    out = written(first.unionByName(covering(first, second.unionByName(third).unionByName(runs))), "passages")
    for table in (shared, open_first, open_second, paired, first, second, third):
        unwritten(table)
    return out


def uncovered(met: DataFrame, spans: DataFrame) -> DataFrame:
    """Seeds of ``met`` around which no span of their document covers every window of ``MIN_WORDS`` words."""
    covered = spans.select(F.col("doc_id").alias("_doc"), "start_word", "end_word")
    around = (F.col("doc") == F.col("_doc")) & (F.col("start_word") <= F.greatest(F.col("pos") + K - MIN_WORDS, F.lit(0))) & (F.least(F.col("pos") + MIN_WORDS, "words") <= F.col("end_word"))
    return met.join(covered, around, "left_anti")


def seeds_in(met: DataFrame) -> DataFrame:
    """``(h)``: the seeds of matches, each once."""
    return written(met.select("h").distinct(), "open-seeds")


def window_runs(docs: DataFrame, shared: DataFrame, left: DataFrame, spans: DataFrame) -> DataFrame:
    """Exact runs of at least ``MIN_WORDS`` words of an earlier document outside ``spans``.

    The documents of a run's seeds may be several that each have less of it. So
    where a matched seed is in a window of 50 words that no span covers, the windows
    around it and the equal seeds of other documents are matched with the first
    document that has the whole window. Other seeds take no part, and windows need
    all their seeds, so common lines below 50 words bring in few.
    """
    marks = shared.join(left.hint("shuffle_hash"), "h").groupBy("doc").agg(F.collect_set("pos").alias("marks")).filter(F.size("marks") > 1)  # at most the seeds of one text
    marks = written(marks, "window-seeds")

    def batches(source):
        import numpy as np
        import pyarrow as pa

        for batch in source:
            for part in parts_of(batch, 1):
                text, pos, w = windows_of(part.column(1), part.column(2))
                columns = [w.view(np.int64), part.column(0).to_numpy()[text], pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w", "doc", "pos"])

    texts = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), marks.select(F.col("doc").alias("marked"))).join(marks, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "marks")
    windows = written(texts.mapInArrow(batches, "w long, doc long, pos int"), "windows")
    owners = windows.groupBy("w").agg(F.min(F.struct("doc", "pos")).alias("o"), F.max("doc").alias("last")).filter("o.doc < last").select("w", F.col("o.doc").alias("src"), F.col("o.pos").alias("spos"))
    owners = written(owners, "window-owners")
    covered = spans.select(F.col("doc_id").alias("_doc"), "start_word", "end_word")
    inside = (F.col("doc") == F.col("_doc")) & (F.col("start_word") <= F.col("pos")) & (F.col("pos") + MIN_WORDS <= F.col("end_word"))
    same = windows.join(owners, "w").filter("doc <> src").select("doc", "src", "pos", "spos").join(covered, inside, "left_anti")
    # windows at one distance follow each other where place less rank is the same
    line = Window.partitionBy("doc", "src", F.col("pos") - F.col("spos")).orderBy("pos")
    runs = same.withColumn("run", F.col("pos") - F.row_number().over(line)).groupBy("doc", "src", (F.col("pos") - F.col("spos")).alias("apart"), "run").agg(F.min("pos").alias("start_word"), (F.max("pos") + MIN_WORDS).alias("end_word"))
    length = F.col("end_word") - F.col("start_word")
    return runs.select(F.col("doc").alias("doc_id"), "start_word", "end_word", F.col("src").alias("src_doc_id"), (F.col("start_word") - F.col("apart")).alias("src_start_word"), (F.col("end_word") - F.col("apart")).alias("src_end_word"), length.alias("n_matched"), F.lit(1.0).alias("similarity"))


def least_cover(fixed: list[tuple[int, int]], runs: list[tuple[int, int]]) -> list[int]:
    """Indexes of as few of the ``runs`` as, with the ``fixed`` spans, cover the words of all; both are sorted."""
    chosen, reach, i, f = [], 0, 0, 0
    while i < len(runs):
        reach = max(reach, runs[i][0])
        while f < len(fixed) and fixed[f][0] <= reach:
            reach, f = max(reach, fixed[f][1]), f + 1
        best = -1
        while i < len(runs) and runs[i][0] <= reach:
            if runs[i][1] > reach and (best < 0 or runs[i][1] > runs[best][1]):
                best = i
            i += 1
        if best >= 0:
            chosen.append(best)
            reach = runs[best][1]
    return chosen


def covering(spans: DataFrame, more: DataFrame) -> DataFrame:
    """As few of ``more`` as, with the ``spans`` of a document, cover all words that they do."""
    rows = spans.withColumn("fixed", F.lit(True)).unionByName(more.withColumn("fixed", F.lit(False)))

    def batches(source):
        import numpy as np
        import pyarrow as pa

        def chosen(table):
            doc, start, end = (table.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            fixed = table.column(len(SPAN_NAMES)).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(doc)) + 1
            of = lambda at: list(zip(start[at].tolist(), end[at].tolist(), strict=True))
            keep = []
            for lo, hi in zip([0, *edges], [*edges, len(doc)], strict=True):
                at = np.arange(lo, hi)
                free = at[~fixed[lo:hi]]
                keep += free[least_cover(of(at[fixed[lo:hi]]), of(free))].tolist()
            return table.take(pa.array(keep, pa.int64())).select(SPAN_NAMES)

        held = None
        for batch in source:
            held = batch if held is None else pa.concat_batches([held, batch])
            ids = held.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(ids, ids[-1], side="left")) if len(ids) else 0
            if cut:  # the last document may go on in the next batch; its runs are no more than its words
                yield chosen(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield chosen(held)

    order = ["start_word", "end_word", "src_doc_id", "src_start_word"]
    return rows.select(*SPAN_NAMES, "fixed").repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(batches, SPAN_SCHEMA)


def alignments(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Passages around chains, see :func:`aligned`."""
    down = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - MARGIN) / GRID).cast("int") * GRID)
    up = lambda c: F.ceil((F.col(c) + MARGIN) / GRID).cast("int") * GRID
    linked = linked.withColumns({"qlo": down("lo"), "qhi": up("hi"), "qslo": down("slo"), "qshi": up("shi")})
    wanted = linked.select(F.col("doc").alias("doc_id"), F.col("qlo").alias("from"), F.col("qhi").alias("to")).unionByName(linked.select(F.col("src").alias("doc_id"), F.col("qslo").alias("from"), F.col("qshi").alias("to"))).distinct()
    wanted = written(wanted, "wanted-slices")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then texts stay where they are
    cuts = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("cuts"))  # at most the chains of one text
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(cuts) if few else cuts, "doc_id").select("doc_id", "text", "cuts")

    def sliced(source):
        import pyarrow as pa

        for batch in source:
            for part in parts_of(batch, 1):
                out = []
                for doc, text, cuts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.encode("utf-8").split()  # each text once, whatever is wanted of it
                    out += [(doc, x["from"], x["to"], b" ".join(words[x["from"] : x["to"]])) for x in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.string()], strict=True)], ["doc_id", "from", "to", "words"])

    slices = written(texts.mapInArrow(sliced, "doc_id long, from int, to int, words string"), "slices")
    own = slices.select(F.col("doc_id").alias("doc"), F.col("from").alias("qlo"), F.col("to").alias("qhi"), F.col("words").alias("a"))
    other = slices.select(F.col("doc_id").alias("src"), F.col("from").alias("qslo"), F.col("to").alias("qshi"), F.col("words").alias("b"))
    pairs = linked.join(own, ["doc", "qlo", "qhi"]).join(other, ["src", "qslo", "qshi"]).select("doc", "src", "qlo", "qslo", "at", "sat", "a", "b")

    def batches(source):
        import pyarrow as pa

        for batch in source:
            out = []
            for doc, src, base, sbase, at, sat, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = a.encode("utf-8").lower().split(), b.encode("utf-8").lower().split()
                for lo, hi, slo, shi, n, same in aligned(a, b, [p - base for p in at], [p - sbase for p in sat]):
                    out.append((doc, lo + base, hi + base, src, slo + sbase, shi + sbase, n, same))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types(pa), strict=True)], SPAN_NAMES)

    return pairs.mapInArrow(batches, SPAN_SCHEMA)


SPAN_NAMES = [x.strip().split(" ")[0] for x in SPAN_SCHEMA.split(",")]


def types(pa) -> list:
    return [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that an earlier document has too.

    Words inside a passage go, with the white space before them; ``n_chars``, if
    there, is counted anew. Documents of which nothing is left go. Of rows that
    repeat a doc_id one stays (:func:`one_row_each`); rows without one, null, empty
    and short texts stay as they are, and other columns go along, whatever their
    names. An empty table stays empty.
    """
    unnamed, docs = docs.filter("doc_id is null"), one_row_each(docs)
    spans = passages(docs).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))  # at most the seeds of one text
    spans = written(spans, "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    joined = rows.join(spans, F.col("_id") == F.col("_doc"), "left")
    given = F.col("_row").getField("text")
    pieces = F.regexp_extract_all(given, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    left = F.filter(pieces, lambda _, i: ~F.exists("_spans", lambda s: (s["start_word"] <= i) & (i < s["end_word"])))
    joined = joined.withColumn("_left", F.when(F.col("_spans").isNotNull(), F.regexp_replace(F.array_join(left, ""), "^" + SPACE_CLASS, ""))).filter("_left is null or _left <> ''")
    out = []
    for c in docs.columns:
        kept = F.col("_row").getField(c)
        if c == "text":
            kept = F.coalesce("_left", kept)
        elif c == "n_chars":
            kept = F.when(F.col("_left").isNull(), kept).otherwise(F.length("_left").cast(docs.schema[c].dataType))
        out.append(kept.alias(c))
    return joined.select(*out).unionByName(unnamed)


def op7_shared_passages(spark, sf_dir: str) -> DataFrame:
    """All fuzzy passages of at least 50 words that a document shares with an earlier one."""
    return passages(documents(spark, sf_dir, "doc_id", "text"))
