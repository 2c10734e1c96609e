import random

import pytest

from plumage.llm import simhash as S
from plumage.llm.components import connected_components


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles_of(text, shingle):
    words = text.encode().lower().split()
    return {tuple(words)} if len(words) <= shingle else set(zip(*[words[i:] for i in range(shingle)], strict=False))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_fingerprint_by_definition():
    import re

    import xxhash

    for text in ("The Cat sat on THE mat É ß", "a b", "A", "x  y\tz\nw", "ab " * 50, None, "", " \n"):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        assert S.simhash(text) == sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("dense", [1, 4, 256])
def test_links_connect_what_brute_force_connects(spark, dense):
    rng = random.Random(dense)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set(centres)
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(map(signed, fps))
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2]
    for parts in ([(list(range(64)), 2)], [(list(range(0, 64, 2)), 1), (list(range(1, 64, 2)), 0)], S.plan_parts(classes)):
        edges = [(r.a, r.b) for r in S.links(classes, parts, dense=dense).collect()]
        assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2 for a, b in edges)
        assert brute_components(edges, fps) == brute_components(near, fps)


def test_thresholds_of_least_cost():
    import itertools

    rng = random.Random(2)
    for _ in range(30):
        costs = [[0.0, *sorted(rng.random() * 10 for _ in range(3))] for _ in range(4)]
        best = min(sum(c[u] for c, u in zip(costs, us, strict=True)) for us in itertools.product(range(4), repeat=4) if sum(us) == 3)
        cost, thresholds = S.allocate(costs, 3)
        assert abs(cost - best) < 1e-9 and sum(t + 1 for t in thresholds) == 3


def test_parts_group_correlated_bits(spark):
    rng = random.Random(4)
    rows = [signed(sum(((rng.random() < 0.5) * 0xFFFF) << (16 * k) for k in range(4)) ^ (1 << rng.randrange(64))) for _ in range(300)]
    classes = spark.createDataFrame([(r,) for r in set(rows)], "fp long")
    parts = S.correlated_parts(S.bit_counts(classes), classes.count(), 4)
    assert sorted(map(tuple, parts)) == [tuple(range(16 * k, 16 * k + 16)) for k in range(4)]


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(6)
    names = rng.sample(range(10**9), 400)
    edges = list(zip(names[:200], names[1:201], strict=True)) + [(names[300], n) for n in names[301:]] + [(names[250], names[250])]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(edges, {x for e in edges for x in e})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_against_brute_force(spark, make, prose):
    rng = random.Random(11)
    texts, group = {}, {}
    for g in range(25):
        base = prose(500 + g, rng.choice([60, 150, 400, 1500])).split()
        for k in range(5):
            words = [w if rng.random() > 0.004 * k else prose(rng.random(), 1) for w in base]
            texts[10 * g + k], group[10 * g + k] = " ".join(words), g
    passage = prose(3, 55)
    texts |= {1000 + i: passage + " " + prose(2000 + i, 40) for i in range(30)}  # a shared passage is no near copy
    sets = {i: shingles_of(t, 5) for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    want = brute_components(near, list(texts))
    got = {r.doc_id: r.component_id for r in S.near_copies(make(list(texts.items()))).collect()}
    assert got.keys() == texts.keys()
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near) > 100


def edited(rng, text, share, prose):
    return " ".join(prose(rng.random(), 1) if rng.random() < share else w for w in text.split())


def assert_exact(spark, make, texts):
    sets = {i: shingles_of(t, 5) for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in S.near_copies(make(list(texts.items()))).collect()} == brute_components(near, list(texts))
    assert near


def test_near_copies_are_exact(spark, make, prose, monkeypatch):
    """An original in the middle of copies that were edited apart; short texts with one changed word; small blocks."""
    monkeypatch.setattr(S, "DENSE", 4)
    rng = random.Random(21)
    base = prose(700, 150)
    texts = {i: base if i == 60 else edited(rng, base, 0.018, prose) for i in range(120)}
    for g in range(120):
        words = prose(9000 + g, 20 + g % 4 * 10).split()
        texts[1000 + 2 * g], texts[1001 + 2 * g] = " ".join(words), " ".join([*words[:-1], "zzz"] if g % 2 else ["zzz", *words[1:]])
    assert_exact(spark, make, texts)


def boilerplate(prose, n, lines=40, of=12):
    """Texts of lines drawn from a few common ones."""
    common = [prose(40_000 + i, 8) for i in range(lines)]
    rng = random.Random(n)
    return {i: "\n".join(rng.choice(common) for _ in range(of)) for i in range(n)}


def found_open(spark, make, texts):
    """Pairs that :func:`open_pairs` finds where nothing is linked before."""
    from pyspark.sql import functions as F

    marks = S.sketches(make(list(texts.items()))).cache()
    classes = marks.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    found = {tuple(r) for r in S.open_pairs(marks, classes.select("rep"), spark.createDataFrame([], "node long, label long"), S.SIMILARITY).collect()}
    marks.unpersist()
    return found


def test_boilerplate_makes_pairs_in_proportion(spark, make, prose):
    few, many = (len(found_open(spark, make, boilerplate(prose, n))) for n in (500, 2000))
    assert many <= 4.5 * few  # all pairs of a key's texts grow by 16


def test_cut_groups_lose_no_pair(spark, make, prose, monkeypatch):
    """Common lines, edited copies of them, and texts so short that they share all they need at once."""
    monkeypatch.setattr(S, "PAIR_COST", 1000)
    monkeypatch.setattr(S, "PAIRS_EACH", 0)
    rng = random.Random(31)
    texts = boilerplate(prose, 150, 12, 6)
    texts |= {1000 + i: edited(rng, texts[i], 0.02, prose) for i in range(150)}
    opening = prose(77, 12)
    texts |= {2000 + i: opening + " " + prose(3000 + i % 9, i % 4) for i in range(60)}
    texts |= {3000 + i: prose(78, 30) + " " + prose(4000 + i, i % 8) for i in range(40)}
    sets = {i: shingles_of(t, 5) for i, t in texts.items()}
    first = {}
    for i, t in texts.items():
        first.setdefault(" ".join(t.lower().split()), i)
    reps = sorted(first.values())
    near = {(a, b) for a in reps for b in reps if a > b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    found = found_open(spark, make, texts)
    assert near <= found and len(near) > 300
    assert_exact(spark, make, texts)


def test_groups_of_unlike_lengths_are_not_cut(spark, make, prose, monkeypatch):
    """Few of a group's texts are of similar length: meeting is less work than a row for every later key."""

    def cut(*_):
        raise AssertionError("groups are cut whose pairs are few")

    monkeypatch.setattr(S, "COMMON", 10**6)
    monkeypatch.setattr(S, "cut_by_next", cut)
    texts = {i: prose(91, 40) + " " + prose(5000 + i, round(60 * 1.03**i)) for i in range(150)}
    texts |= {1000 + i: texts[i] + " tail" for i in range(0, 150, 15)}
    assert {(1000 + i, i) for i in range(0, 150, 15)} <= found_open(spark, make, texts)


def test_keys_that_follow_the_same_key_meet_once(spark):
    """Three keys of one line, a key of two texts of it, and one that another text has without the line."""
    rows = [(k, rep, 50, rep, at) for rep in range(4) for k, at in ((11, 1), (12, 2), (13, 3))]
    rows += [(14, 0, 50, 0, 4), (14, 1, 50, 1, 4), (15, 2, 50, 2, 5), (15, 9, 50, 9, 0)]
    held = spark.createDataFrame(rows, "group long, rep long, n long, label long, at int")
    assert {r.group for r in S.first_met(held).collect()} == {11, 15}


def test_keys_of_similar_sets_meet():
    import numpy as np

    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 60)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), max(1, n - rng.randint(0, n // 4)))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 3))}
        common = np.array(sorted(rng.sample(sorted(a | b), len(a | b) // 2)), dtype=np.uint64), np.array(rng.sample(range(1, 999), len(a | b) // 2))
        (x, lx, _), (y, ly, _) = (S.keys_of(np.array(sorted(s), dtype=np.uint64), common, 0.8) for s in (a, b))
        met = set(x[:lx]) & set(y) if len(a) <= len(b) else set(x) & set(y[:ly])
        assert met or 10 * len(a & b) < 8 * len(a | b)


def test_parities_bound_the_difference():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        a = {rng.getrandbits(64) for _ in range(rng.randint(1, 900))}
        b = set(rng.sample(sorted(a), len(a) // 2)) | {rng.getrandbits(64) for _ in range(rng.randint(1, 300))}
        x, y = (S.parities(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
        assert sum(bin(int(p) & (2**64 - 1)).count("1") for p in x ^ y) <= len(a ^ b)


def test_segments_bear_any_text():
    for text in (None, "", "one", "a b c d e", "a b c d e f", "ab " * 200_000, "x\ty " * 7):
        digest, fp, segments, hashes = S.segments_of(text, 5)
        assert len(digest) == 16 and len(hashes) >= 1 and len(segments) >= 1 and -(2**63) <= fp < 2**63
    long = " ".join(str(i * 7919 % 100_003) for i in range(70_000))
    assert S.segments_of(long, 5)[1] == signed(S.simhash(long, 5)) and len(S.segments_of(long, 5)[2]) < 64


def test_odd_rows(spark, make, odd, prose):
    near = [(30, prose(9, 300)), (31, prose(9, 300) + " tail"), (32, "".join(c.upper() if c.isascii() else c for c in prose(9, 300)))]
    docs = make(odd + near)
    rows = [(r.doc_id, r.fp, r.component_id) for r in S.near_duplicates(docs).collect()]
    assert len(rows) == docs.count()
    component = {i: c for i, _, c in rows}
    assert component[1] == component[2] == component[3] == 1 and component[5] == component[6] == 5 and component[4] == 4
    assert component[30] == component[32] == 30
    kept = S.deduplicated(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 4, 5, 7, 8, 30] and kept[0].asDict().keys() == set(docs.columns)


def test_empty_and_clashing_names(spark, make):
    from pyspark.sql import functions as F

    assert S.near_duplicates(make([])).count() == 0 and S.deduplicated(make([])).count() == 0
    docs = make([(1, "a"), (2, "a")]).withColumns({"fp": F.lit("x"), "component_id": F.lit("y"), "_rows": F.lit(1)})
    assert [(r.doc_id, r.fp, r.component_id, r._rows) for r in S.deduplicated(docs).collect()] == [(1, "x", "y", 1)]
