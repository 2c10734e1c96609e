"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into parts of bits that vary together. If two
fingerprints differ in at most ``t`` bits and the parts have thresholds ``t_i`` with
``sum(t_i + 1) = t + 1``, then some part differs in at most its ``t_i`` bits
(a threshold of -1 leaves a part out). A dynamic program spreads the thresholds
unevenly, by estimated probes and candidates, over cuts into one to four parts.

Equal fingerprints are one class from the start. A key that very many classes
share is not joined with itself: two fingerprints are at most two bits apart
exactly if one fingerprint lies within one bit of both, so those classes are linked
through their 65 neighbours, with work in proportion to their number.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, among, documents, one_row_each, unwritten, written
from .components import connected_components

BITS = 64
DISTANCE = 2
SHINGLE = 3
#: Keys with more classes than this are linked through neighbours, not by a join.
DENSE = 256
#: Work of one probe in units of one verified candidate.
PROBE_COST = 4.0
CUTS = (1, 2, 3, 4)
#: Near copies: words of a shingle, and Jaccard similarity of the sets of shingles.
COPY_SHINGLE = 5
SIMILARITY = 0.8
#: Shingles of a segment, on average.
SEGMENT = 12
#: Common shingles come last in the order of keys: those counted so often, and as many at most.
COMMON, MOST_COMMON = 32, 2_000_000
#: Shingles whose hash is in the first 90 of 256 parts are counted exactly; keys are the lowest fifth of a text.
COUNTED = 90
#: Open texts meet by up to so many keys that they share; a pair costs as much as so many rows of keys;
#: groups are cut while the pairs of those that should be are more than so many for each text.
SHARED, PAIR_COST, PAIRS_EACH = 8, 4, 4
#: Bits of a text's parities, eight longs.
PARITIES = 512
#: Hashes that a Python worker holds before it hands them on.
CHUNK = 1_000_000


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text: bit ``k`` is set in more than half the shingles' XXH64.

    A-Z become lower case; words are split at ASCII white space; a text of fewer
    words than a shingle is one shingle; one without words has fingerprint 0.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and ASCII space count
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype="<u8", count=len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    def batches(source):
        import numpy as np
        import pyarrow as pa

        for batch in source:
            values = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(batches, "doc_id long, fp long")


def segments_of(text: str | None, shingle: int):
    """``(digest, fp, segments, hashes)``: of the words, the whole text, its segments and distinct shingles.

    A segment starts where a shingle's hash says so, every ``SEGMENT`` shingles on
    average, and has a SimHash of its own. Of long texts, those segments represent
    the text whose first hash ends in zeros, so that 16 to 32 of them are expected;
    a text of similar length has the same ones, or twice or half as many.
    """
    import numpy as np
    from xxhash import xxh3_128_digest, xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    digest = xxh3_128_digest(b" ".join(words), 42)
    if len(words) <= shingle:
        whole = np.array([xxh64_intdigest(b" ".join(words), 42)], dtype="<u8")
        return digest, int(whole.view(np.int64)[0]), whole.view(np.int64), whole
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype="<u8", count=len(words) - shingle + 1)
    starts = np.union1d([0], np.flatnonzero(hashes % np.uint64(SEGMENT) == 0))
    length = np.diff(np.append(starts, len(hashes)))
    ones = np.zeros((len(starts), BITS), dtype=np.int32)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, at + len(bits))
        ones[lo:hi] += np.add.reduceat(bits, np.maximum(starts[lo:hi] - at, 0), axis=0, dtype=np.int32)
    fp = np.packbits(2 * ones.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<i8")[0]
    level = max(0, (len(hashes) // (16 * SEGMENT)).bit_length() - 1)
    opening = hashes[starts] >> np.uint64(32)
    chosen = (opening & np.uint64((1 << level) - 1)) == 0
    chosen[opening.argmin()] = True
    found = np.packbits(2 * ones[chosen] > length[chosen][:, None], axis=1, bitorder="little").view("<i8").ravel()
    return digest, int(fp), np.unique(found), np.unique(hashes)


def hashes_of(text: str | None, shingle: int):
    """XXH64 of the distinct shingles of a text, in rising order."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype="<u8"))


def common_shingles(docs: DataFrame, shingle: int):
    """``(hashes, ranks)`` of common shingles, by hash; the rarest of them has rank 1.

    They only set the order of keys (:func:`keys_of`): any order finds every pair,
    and this one keeps shared passages out of the keys. All texts are counted. Most
    keys have low hashes, whose counts are exact; of others, those found fewer than
    three times in a chunk are left out, so large groups of copies still count.
    Shingles found ``COMMON`` times are common, or so often that ``MOST_COMMON`` of
    them are at most.
    """
    import numpy as np

    def batches(source):
        import numpy as np
        import pyarrow as pa

        def counted(held):
            h, n = np.unique(np.concatenate(held), return_counts=True)
            kept = (h < np.uint64(COUNTED << 56)) | (n > 2)
            return pa.RecordBatch.from_arrays([pa.array(h[kept].view(np.int64)), pa.array(n[kept])], ["h", "n"])

        held, room = [], CHUNK
        for batch in source:
            for text in batch.column(0):
                held.append(hashes_of(text.as_py(), shingle))
                room -= len(held[-1])
                if room < 0:
                    yield counted(held)
                    held, room = [], CHUNK
        if held:
            yield counted(held)

    counts = docs.select("text").mapInArrow(batches, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = written(counts.filter(F.col("n") >= COMMON), "shingle-counts")
    size = counts.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).first()
    often = COMMON if size.rows <= MOST_COMMON else size.total // MOST_COMMON + 1
    rows = counts.filter(F.col("n") >= often).toArrow()  # MOST_COMMON rows at most
    unwritten(counts)
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    ranks = np.empty(len(h), dtype=np.int64)
    ranks[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], ranks[order]


def keys_of(hashes, common, least: float):
    """``(keys, lead, rare)``: of the sorted hashes, those that a similar text must share one of.

    With the shingles of all texts in one order, two sets with a Jaccard similarity
    of ``least`` share one of the first ``n - ceil(least * n) + 1`` of each (prefix
    filter); of the smaller set the first ``lead`` are enough. For every shingle more
    that they have in common, they share one more key where one more is looked at, so
    ``SHARED - 1`` keys follow. The first ``rare`` of the keys aren't common.
    """
    import numpy as np

    known, ranks = common
    n = len(hashes)
    rank = np.zeros(n, dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, ranks[at], 0)
    first = lambda share: n - math.ceil(share * n - 1e-9) + 1
    chosen = np.argsort(rank, kind="stable")[: first(least) + SHARED - 1]
    return hashes[chosen].view(np.int64), first(2 * least / (1 + least)), int((rank[chosen] == 0).sum())


def parities(hashes):
    """``PARITIES`` bits as longs: whether an even or odd number of the hashes falls on each.

    Two sets differ in at least as many elements as their bits do.
    """
    import numpy as np

    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def sketches(docs: DataFrame, shingle: int = COPY_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """A row for every one of ``docs``: digest, number of shingles, whole and segment fingerprints, keys, parities."""
    common = common_shingles(docs, shingle)
    names = ["doc_id", "digest", "n", "fp", "segments", "keys", "lead", "rare", "odd"]

    def batches(source):
        import pyarrow as pa

        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in source:
            out, room = [], CHUNK
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                digest, fp, segments, hashes = segments_of(text.as_py(), shingle)
                keys, lead, rare = keys_of(hashes, common, least)
                out.append((doc, digest, len(hashes), fp, segments, keys, lead, rare, parities(hashes)))
                room -= len(keys) + 100
                if room < 0:
                    yield table(out)
                    out, room = [], CHUNK
            if out:
                yield table(out)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(batches, "doc_id long, digest binary, n long, fp long, segments array<long>, keys array<long>, lead int, rare int, odd array<long>")


def bit_counts(classes: DataFrame):
    """How often each two bits are set together: a 64 x 64 matrix, summed in Spark."""
    import numpy as np

    def batches(source):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((BITS, BITS))
        for batch in source:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    rows = classes.select("fp").mapInArrow(batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,096 rows
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def correlated_parts(together, n: int, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` groups; each grows by the bit most correlated with it."""
    import numpy as np

    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with ``sum(t_i + 1) = units``; ``costs[p][u]`` is for ``t = u - 1``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for u in range(min(units - used, len(row) - 1) + 1):
                offer = (cost + row[u], [*chosen, u - 1])
                if used + u not in step or offer < step[used + u]:
                    step[used + u] = offer
        best = step
    return best[units]


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def flips_of(bits: list[int], most: int) -> list[int]:
    """XOR masks of all changes of up to ``most`` of the bits, none included."""
    return [mask_of(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


def plan_parts(classes: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts with thresholds for these fingerprints (those left out are omitted).

    Pairs that agree on a whole part are counted over all fingerprints. Pairs that
    differ in one or two bits of it are estimated from the bits' shares.
    """
    import numpy as np

    n = classes.count()
    together = bit_counts(classes)
    cuts = {m: correlated_parts(together, n, m) for m in CUTS}
    keys = F.explode(F.array(*[F.struct(F.lit(100 * m + p).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("key")) for m, parts in cuts.items() for p, bits in enumerate(parts)]))
    sizes = classes.select(keys.alias("k")).groupBy("k.part", "k.key").agg(F.count(F.lit(1)).alias("n"))
    pairs = {r.part: float(r.pairs or 0) for r in sizes.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2).alias("pairs")).collect()}  # a row a part
    share = np.diag(together) / max(n, 1)
    differ = np.clip(2 * share * (1 - share), 1e-9, 1 - 1e-9)
    odds = differ / (1 - differ)
    options = []
    for m, parts in cuts.items():
        costs = []
        for p, bits in enumerate(parts):
            o, w = odds[bits], len(bits)
            ones, twos = o.sum(), (o.sum() ** 2 - (o**2).sum()) / 2
            same = max(pairs.get(100 * m + p, 0.0), 0.0)
            # independent bits give a floor where no pair agrees on the whole part
            same = max(same, n * (n - 1) / 2 * float(np.prod(1 - differ[bits])))
            found, probes = [same, same * (1 + ones), same * (1 + ones + twos)], [1, 1 + w, 1 + w + w * (w - 1) / 2]
            costs.append([0.0, *[found[t] + PROBE_COST * n * probes[t] for t in range(distance + 1)]])
        options.append((*allocate(costs, distance + 1), m))
    _, thresholds, m = min(options)
    return [(bits, t) for bits, t in zip(cuts[m], thresholds, strict=True) if t >= 0]


def links(classes: DataFrame, parts: list[tuple[list[int], int]], distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints that differ in at most ``distance`` bits.

    Sparse keys give every such pair; dense keys give edges that connect the same
    fingerprints. Every edge is a true link.
    """
    if distance != 2:
        raise ValueError("dense keys are linked through common neighbours, which needs a distance of 2")
    probes: Column = F.array(*[F.struct(F.lit(p).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).bitwiseXOR(F.lit(x)).alias("key"), F.lit(x == 0).alias("own")) for p, (bits, t) in enumerate(parts) for x in flips_of(bits, t)])
    rows = classes.select("fp", F.explode(probes).alias("k")).select("fp", "k.part", "k.key", "k.own")
    crowded = written(rows.groupBy("part", "key").agg(F.count_if("own").alias("n")).filter(F.col("n") > dense).select("part", "key", F.lit(True).alias("crowded")), "crowded-keys")
    rows = rows.join(crowded, ["part", "key"], "left")
    sparse = rows.filter("crowded is null")
    a = sparse.filter("own").select("part", "key", F.col("fp").alias("a"))
    b = sparse.select("part", "key", F.col("fp").alias("b"))
    near = a.join(b, ["part", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    around = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)).alias("mid") for x in flips_of(list(range(BITS)), 1)]))
    spread = rows.filter("crowded").select("fp").distinct().select("fp", around.alias("mid"))
    centre = spread.groupBy("mid").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("mid", "a")
    starred = spread.join(centre, "mid").select("a", F.col("fp").alias("b")).filter("a <> b").distinct()
    return near.unionByName(starred)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links of at most two
    differing bits, the row's own included. Null texts have fingerprint 0, as texts
    without words, and link with each other. A null doc_id is passed over by the
    minimum. Repeated rows are copies of each other. An empty table gives no rows.
    """
    marks = written(fingerprints(docs), "fingerprints")
    classes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    if classes.isEmpty():
        return marks.withColumn("component_id", F.lit(None).cast("long"))
    labels = connected_components(links(classes, plan_parts(classes)))
    rooted = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = rooted.groupBy("label").agg(F.min("first").alias("component_id"))
    placed = written(rooted.join(smallest, "label").select("fp", "component_id"), "components")
    unwritten(classes)
    unwritten(labels)
    return marks.join(placed, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``(doc_id, component_id)``: groups of texts whose shingles have a Jaccard similarity of ``least``.

    ``doc_id`` must be unique and not null (:func:`deduplicated` sees to that). A
    fingerprint of a whole text moves by about ten bits where a tenth of its
    shingles change, which no cut into parts can probe for. Besides the probes of
    whole fingerprints, texts therefore meet through equal fingerprints of segments,
    which are cut where the content says so: a fiftieth of the words may change and
    most short segments stay. Every pair that meets is verified on all its shingles.

    Of a segment and length class, texts meet the first one and the one that shares
    most segments with others (of copies edited apart, that is their original), so
    pairs grow with the segments, however many texts share one. That links most;
    then all other pairs that can be similar meet, see :func:`open_pairs`, so none
    is missed. Texts of the same words are copies, null and blank ones of each
    other. An empty table gives no rows.
    """
    marks = written(sketches(docs, shingle, least), "sketches")
    reps = written(marks.groupBy("digest").agg(F.min("doc_id").alias("rep")), "text-classes")
    classes = written(marks.join(reps.select("rep"), F.col("doc_id") == F.col("rep")).select("rep", "n", "fp", "segments"), "classes")
    prints = written(classes.groupBy("fp").agg(F.min("rep").alias("first")), "prints")
    if prints.isEmpty():
        return marks.select("doc_id", F.col("doc_id").alias("component_id"))
    found = links(prints, plan_parts(prints))
    first = prints.select(F.col("fp").alias("_fp"), "first")
    linked = found.join(first, F.col("a") == F.col("_fp")).select(F.col("first").alias("a"), "b").join(first, F.col("b") == F.col("_fp")).select("a", F.col("first").alias("b"))
    alike = classes.join(prints, "fp").filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    pairs = segment_pairs(classes, least).unionByName(linked).unionByName(alike).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    near = verified(docs, plausible(marks, pairs.distinct(), least), shingle, least)
    early = connected_components(near)
    rest = verified(docs, plausible(marks, open_pairs(marks, classes, early, least), least), shingle, least)
    labels = connected_components(near.unionByName(rest))
    rooted = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    placed = written(rooted, "components")
    for table in (classes, prints, near, rest, early, labels):
        unwritten(table)
    return marks.select("doc_id", "digest").join(placed, "digest").select("doc_id", "component_id")


def segment_pairs(classes: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of texts that share a segment: each with two texts of its segment and length class."""
    own = classes.select("rep", "n", F.explode("segments").alias("segment"))
    shared = own.groupBy("segment").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("segment")
    met = written(own.join(shared, "segment"), "segments")
    central = met.groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    # half a step is wider than the ratio of two sizes can be, so two similar sizes have a class in common
    step = F.log(F.greatest(F.col("n"), F.lit(1))) / (2.1 * math.log(1 / least) + 1e-9)
    sizes = F.explode(F.array(F.floor(step) * 2, F.floor(step + 0.5) * 2 + 1))
    met = met.join(central, "rep").select("rep", "n", "segment", "shared", sizes.alias("size"))
    one = F.struct("rep", "n")
    owners = met.groupBy("segment", "size").agg(F.min(one).alias("o"), F.max_by(one, F.struct("shared", -F.col("rep"))).alias("c"), F.max("rep").alias("last")).filter("o.rep < last").drop("last")
    both = met.join(owners, ["segment", "size"]).select("rep", "n", F.explode(F.array("o", "c")).alias("o"))
    return both.filter((F.col("rep") != F.col("o.rep")) & (F.least("n", "o.n") >= least * F.greatest("n", "o.n"))).select(F.col("rep").alias("a"), F.col("o.rep").alias("b"))


def plausible(marks: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those pairs ``(a, b)`` whose sketches allow the similarity; none that has it is lost.

    First the parities must not differ in more elements than the similarity allows,
    which few and short rows tell. Then the keys: two sets with ``o`` elements in
    common have ``l`` of them among their first ``n - o + l`` each, in the common order.
    """
    met = written(pairs, "candidates")
    sizes = written(marks.select("doc_id", "n", "odd"), "parities")
    side = lambda x: sizes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
    rows = met.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    rows = rows.withColumn("o", F.ceil((F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9).cast("int"))
    apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = written(rows.filter(apart <= F.col("n_a") + F.col("n_b") - 2 * F.col("o")).select("a", "b", "n_a", "n_b", "o"), "near-parities")
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), "wanted")
    keys = written(among(marks.select("doc_id", "keys"), wanted), "candidate-keys")
    rows = near.join(keys.select(F.col("doc_id").alias("a"), F.col("keys").alias("k_a")), "a").join(keys.select(F.col("doc_id").alias("b"), F.col("keys").alias("k_b")), "b")
    rows = rows.withColumn("l", F.least(*[F.size(f"k_{x}") - F.col(f"n_{x}").cast("int") + F.col("o") for x in "ab"]))
    prefix = lambda x: F.slice(f"k_{x}", F.lit(1), F.greatest(F.col(f"n_{x}").cast("int") - F.col("o") + F.col("l"), F.lit(0)))
    out = written(rows.filter(F.size(F.array_intersect(prefix("a"), prefix("b"))) >= F.col("l")).select("a", "b"), "plausible")
    for table in (met, sizes, near, wanted, keys):
        unwritten(table)
    return out


def spare(least: float) -> Column:
    """Shingles of ``n`` that a similar text need not have."""
    return F.col("n") - F.ceil(F.col("n") * least - 1e-9)


def open_pairs(marks: DataFrame, classes: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Every pair ``(a, b)`` of texts in different groups that can be similar enough.

    Similar texts share a key (:func:`keys_of`). Keys whose texts are of one group
    are done. Of others, all texts meet that aren't in one group, where they are few;
    where they are many, those that share more keys (:func:`meetings`). Keys that
    aren't common have few texts each and are looked at in one shuffle; a common one
    may have very many, so those are summed up before the shuffle and joined again.
    """
    named = classes.select("rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    named = written(named, "text-labels")
    texts = named.count()
    few = texts <= BROADCAST_ROWS  # then keys are moved once only
    keyed = marks.filter("n > 1").join(F.broadcast(named) if few else named, F.col("doc_id") == F.col("rep"))
    keyed = keyed.select("rep", "n", "label", "lead", "rare", F.posexplode(F.slice("keys", F.lit(1), (spare(least) + 1).cast("int"))).alias("at", "key"))
    keys = keyed.select("key", "rep", "n", "label", "at", (F.col("at") < F.col("lead")).alias("lead"), (F.col("at") < F.col("rare")).alias("rare"))
    of_key = Window.partitionBy("key")
    scarce = keys.filter("rare").withColumns({"lo": F.min("label").over(of_key), "hi": F.max("label").over(of_key), "led": F.max("lead").over(of_key)}).filter("lo < hi and led")
    many = keys.filter("not rare")
    mixed = many.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("lead").alias("led")).filter("lo < hi and led").select("key")
    columns = ["key", "rep", "n", "label", "at"]
    met = written(scarce.select(*columns).unionByName(many.join(mixed, "key").select(*columns)).withColumnRenamed("key", "group"), "shared-keys")
    held = written(first_met(met), "open-keys")
    for table in (named, met):
        unwritten(table)
    return meetings(marks, held, texts, least)


def first_met(held: DataFrame, *within: str) -> DataFrame:
    """``held(group, rep, at, ...)`` without groups whose texts all meet in one earlier group.

    ``group`` stands for the key at place ``at`` of a text, within a group of fewer
    keys if ``within`` names its column. Where the key before it, of those that are in
    ``held``, is the same in all texts of a group, each two of them share that one
    first. The shingles of a line therefore count once, not each with each other.
    """
    before = F.lag("group").over(Window.partitionBy(*within, "rep").orderBy("at"))
    late = held.withColumn("before", before).groupBy("group").agg(F.count_if(F.col("before").isNull()).alias("alone"), F.min("before").alias("lo"), F.max("before").alias("hi"))
    return held.join(late.filter("alone = 0 and lo = hi").select("group"), "group", "left_anti")


def meetings(marks: DataFrame, held: DataFrame, texts: int, least: float) -> DataFrame:
    """Pairs of different labels that meet in a group of ``held(group, rep, n, label, at)``.

    A group's texts share one key, at place ``at`` of each. A group whose pairs would
    be more work than its texts' later keys is cut by the next key that two texts
    share, and again, up to ``SHARED`` keys: boilerplate makes many texts share one
    key, but few share many. Two similar texts have that next key, and early enough
    (of ``o`` shared shingles, ``l`` are in the first ``n - o + l``), unless they need
    no more than they share; those meet at once. Work is counted in pairs that share
    enough for their lengths: texts of unlike lengths are dropped as they meet, while a
    cut writes a row for every later key. Cutting ends where the pairs left are no more
    than some for each text. In what isn't cut, the texts outside the group's
    largest label meet all, in blocks of ``DENSE``. No pair that can be similar is lost.
    """
    needed = F.ceil((F.col("n1") + F.col("n2")) * (least / (1 + least)) - 1e-9)
    columns = ["rep", "n", "label", "at"]

    def met_in(rows: DataFrame, shared: int) -> DataFrame:
        """Pairs of ``rows`` that share enough, once for each group they meet in."""
        one = rows.filter("label <> main").select("group", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), *[F.col(c).alias(f"{c}1") for c in columns])
        two = rows.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}2") for c in columns])
        enough = (F.col("n1") - F.col("at1") + shared - 1 >= needed) & (F.col("n2") - F.col("at2") + shared - 1 >= needed)
        return one.join(two, ["group", "block"]).filter((F.col("label1") != F.col("label2")) & enough)

    found = []
    for shared in range(1, SHARED + 1):
        ahead = F.sum(spare(least) + shared - F.col("at"))  # keys among which the next shared one is
        sizes = held.groupBy("group", "label").agg(F.count(F.lit(1)).alias("c"), ahead.alias("ahead")).groupBy("group")
        sizes = sizes.agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), (F.sum("c") - F.max("c")).alias("others"), F.sum("ahead").alias("ahead")).filter("others > 0")
        may = (F.lit(shared < SHARED)) & (F.col("others") * F.col("size") * PAIR_COST > F.col("ahead"))
        sizes = written(sizes.withColumns({"may": may, "blocks": F.ceil(F.col("others") / DENSE)}), "open-sizes")
        large = held.join(sizes.filter("may").select("group", "main", "blocks"), "group")
        cost = met_in(large, shared).groupBy("group").agg(F.count(F.lit(1)).alias("pairs"))  # counted in the join, none is kept
        cuts = sizes.filter("may").join(cost, "group").filter(F.col("pairs") * PAIR_COST > F.col("ahead")).select("group", "size", "pairs", F.lit(True).alias("cut"))
        cuts = written(cuts, "open-cuts")
        left = cuts.agg(F.sum("pairs")).first()[0] or 0
        going = left > PAIRS_EACH * texts
        rows = held.join(sizes.select("group", "main", "blocks"), "group")
        if going:
            rows = rows.join(cuts.select("group", "cut"), "group", "left").filter(F.col("cut").isNull() | (F.col("n") - spare(least) <= shared))
        pairs = met_in(rows, shared)
        found.append(written(pairs.select(F.greatest("rep1", "rep2").alias("a"), F.least("rep1", "rep2").alias("b")).distinct(), "open-pairs"))
        done = (held, sizes, cuts)
        if going:
            held = cut_by_next(marks, held.join(cuts.select("group", "size"), "group"), shared, least)
        for table in done:
            unwritten(table)
        if not going:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def cut_by_next(marks: DataFrame, groups: DataFrame, shared: int, least: float) -> DataFrame:
    """Groups whose texts share ``shared`` keys, cut by one more key each; columns as in :func:`meetings`.

    A key that all texts of a group have is shared by each two of them, so none of
    them first meets in a later one; a group of one key that all its texts have after
    such a key has no pair of its own. Shingles of one line therefore count once.
    """
    groups = written(groups, "cut-groups")
    keys = among(marks.select("doc_id", "keys"), groups.select("rep").distinct()).withColumnRenamed("doc_id", "rep")
    spread = groups.join(keys, "rep").select("group", "size", "rep", "n", "label", "at", F.posexplode("keys").alias("pos", "key"))
    after = (F.col("pos") > F.col("at")) & (F.col("pos") <= spare(least) + shared)
    later = written(spread.filter(after | (F.lit(shared == 1) & (F.col("pos") < F.col("at")))), "later-keys")
    counted = later.groupBy("group", "key").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("size"), F.max(F.col("pos") < F.col("at")).alias("before"))
    whole = written(counted.filter("c = size").select("group", "key", "before"), "whole-keys")
    dead = whole.filter("before").select("group").distinct()
    first = later.filter("pos > at").join(whole.filter("not before"), ["group", "key"]).groupBy("group", "rep").agg(F.min("pos").alias("first"))
    kept = later.filter("pos > at").join(dead, "group", "left_anti").join(first, ["group", "rep"], "left").filter("first is null or pos <= first")
    rows = kept.select(F.col("group").alias("cut"), F.xxhash64("group", "key", F.lit(shared)).alias("group"), "rep", "n", "label", F.col("pos").alias("at"))
    of_group = Window.partitionBy("group")
    mixed = rows.withColumns({"lo": F.min("label").over(of_group), "hi": F.max("label").over(of_group)}).filter("lo < hi").drop("lo", "hi")
    mixed = written(mixed, "shared-keys")
    out = written(first_met(mixed, "cut").drop("cut"), "open-keys")
    for table in (groups, later, whole, mixed):
        unwritten(table)
    return out


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those pairs ``(a, b)`` of documents whose texts' shingles are similar enough.

    The shingles of every document in a pair are hashed once (XXH64); the pairs
    are then compared in joins of those arrays, without Python and texts.
    """
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), "wanted")

    def batches(source):
        import pyarrow as pa

        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc_id", "h"])
        for batch in source:
            out, room = [], CHUNK
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.append((doc, hashes_of(text.as_py(), shingle).view("int64")))
                room -= len(out[-1][1])
                if room < 0:
                    yield table(out)
                    out, room = [], CHUNK
            if out:
                yield table(out)

    texts = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted)
    hashed = written(texts.mapInArrow(batches, "doc_id long, h array<long>"), "candidate-shingles")
    rows = pairs.join(hashed.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), "a").join(hashed.select(F.col("doc_id").alias("b"), F.col("h").alias("hb")), "b")
    rows = rows.select("a", "b", (F.size("ha") + F.size("hb")).alias("n"), F.size(F.array_intersect("ha", "hb")).alias("same"))
    out = written(rows.filter(F.col("same") >= least * (F.col("n") - F.col("same"))).select("a", "b"), "verified")
    for table in (hashed, wanted, pairs):
        unwritten(table)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (:func:`near_copies`): that of the smallest doc_id.

    ``doc_id`` names a document: of rows that repeat it one stays, see
    :func:`one_row_each`. Rows without a doc_id stay, as they can't be named. Null
    and blank texts are copies of each other; other columns go along, whatever their
    names; an empty table stays empty.
    """
    named = one_row_each(docs)
    found = near_copies(named)
    gone = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")), "near-copies")
    return among(named, gone, "left_anti").unionByName(docs.filter("doc_id is null"))
