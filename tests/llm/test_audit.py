import itertools
import re

import duckdb
import pytest

from plumage.llm import audit as A


def brute(docs, labels):
    """Each order applied by hand to each part."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                before = len(left)
                left = [r for r in left if not r[1][f]]
                removed_in_all[f] += len(gone)
                redundant = sum(r[1][f] for r in mine) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                found.append([part, "".join(order), step, f, len(left), before - len(left), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out += [(*r, removed_in_all[r[3]]) for r in found]
    return sorted(out)


@pytest.fixture(scope="module")
def texts(prose):
    plain = " ".join(prose(7, 260).split())
    return [plain, plain, prose(8, 210) + " #", "A B " * 150, prose(9, 250) + " " + "ABC" * 60, "", None, " \n\t ", "w " * 300, "x & y", plain, prose(10, 5000)]


def tables(spark, docs, labels):
    d = spark.createDataFrame([(*r, 7, "z") for r in docs], "doc_id long, text string, source string, mask int, part string")
    return d, spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, toxic int, n int")


def test_against_brute_force_and_sql(spark, texts):
    docs = [(100 - i, t, [None, "", "s", "t"][i % 4]) for i, t in enumerate(texts)] + [(100, texts[0], "s"), (100, texts[0], "t"), (None, texts[0], "s"), (None, "one", None), (3, texts[0], "u")]
    labels = [(100, 1, 1), (99, 0, 1), (98, 1, None), (98, 0, 0), (97, None, None), (None, 1, 1), (95, 1, 0), (3, 1, 0)]
    d, l = tables(spark, docs, labels)
    got = sorted(tuple(r) for r in A.audited(d, l).collect())
    assert got == brute(docs, labels)
    con = duckdb.connect()
    con.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", l.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    assert sorted(con.sql(A.OP11_SQL).fetchall()) == got


def test_order_sums_hold(spark, texts):
    docs = [(i, t, "s") for i, t in enumerate(texts * 3)]
    got = A.audited(*tables(spark, docs, [])).collect()
    assert len(got) == 600
    last = {r.kept for r in got if r.step == 5}
    assert len(last) == 1 and not any(r.good_lost or r.toxic_lost for r in got)
    assert sum({r.filter: r.shapley for r in got}.values()) == 120 * (len(docs) - last.pop())


def test_empty_tables(spark):
    assert A.audited(*tables(spark, [], [(1, 1, 1)])).count() == 0
    assert A.audited(*tables(spark, [(1, None, None)], [])).filter("kept + removed > 0").count() > 0


def test_steps_do_not_depend_on_data(spark):
    rows = A.steps(spark).collect()
    assert len(rows) == 32 * 120 * 5
    r = next(r for r in rows if r["mask"] == 21 and r.filter_order == "CBEAD" and r.step == 4)
    assert (r.filter, r.bit, r.fails, r.before) == ("A", 1, 1, 20)
