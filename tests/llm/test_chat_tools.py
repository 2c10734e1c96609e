import json

from plumage.llm import chat_tools as C

CALLS = "conv_id long, turn long, index int, id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, index int, id string, content string"
SCHEMAS = {"add": json.dumps({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"enum": ["x", "y"]}}}, "additionalProperties": False})}


def units(spark, calls, results, large=C.LARGE):
    done = C.formatted(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS, large)
    return {(r.conv_id, r.turn, r["index"], r.kind): r for r in done.collect()}


def test_links_orders_and_validates(spark):
    calls = [
        (1, 0, 0, "a", "add", '{"a": 1.0}', None), (1, 0, 1, "b", "add", '{"a": -1, "z": 0}', ["a"]), (1, 2, 0, "c", "add", '{"tags": ["q"]}', ["b", "a", "gone"]), (1, 4, 0, "d", "nope", "{}", []),
        (1, 5, 0, "e", "add", '{"a": NaN}', ["f"]), (1, 6, 0, "f", "add", None, ["e"]), (None, 0, 0, "a", "add", '{"a": 2}', None), (2, 0, 0, None, "add", '{"a": 2}', None),
    ]
    results = [(1, 1, 0, "b", "rb"), (1, 1, 1, "a", "ra"), (1, 3, 0, "zz", "lost"), (2, 1, 0, None, "null id"), (1, 9, 0, "a", "second")]
    for large in (C.LARGE, 1):
        found = units(spark, calls, results, large)
        level = {k[1:3]: r.level for k, r in found.items() if k[0] == 1 and k[3] != "orphan"}
        assert level == {(0, 0): 0, (0, 1): 1, (2, 0): 2, (4, 0): 0, (5, 0): -1, (6, 0): -1}
        assert found[1, 0, 0, "linked"].content == "ra" and found[1, 0, 0, "linked"].valid
        assert sorted(found[1, 0, 1, "linked"].errors) == ["$.a: minimum", "$.z: unknown"]
        assert sorted(found[1, 2, 0, "unanswered"].errors) == ["$.a: required", "$.tags[0]: enum"]
        assert found[1, 4, 0, "unanswered"].errors == ["tool: unknown"] and found[1, 5, 0, "unanswered"].errors == ["$: not JSON"]
        assert {(k[0], k[1]) for k in found if k[3] == "orphan"} == {(1, 3), (1, 9), (2, 1)}
        assert found[None, 0, 0, "unanswered"].level == 0 and found[2, 0, 0, "unanswered"].content is None
        for r in found.values():
            assert C.canonical(json.loads(r.json)) == r.json


def test_repeated_ids_pair_in_order(spark):
    calls = [(1, t, 0, "x", "add", '{"a": 1}', None) for t in (0, 2, 4)]
    found = units(spark, calls, [(1, 1, 0, "x", "r1"), (1, 3, 0, "x", "r2")])
    assert [found[1, t, 0, k].content for t, k in ((0, "linked"), (2, "linked"), (4, "unanswered"))] == ["r1", "r2", None]


def test_empty(spark):
    assert units(spark, [], []) == {}


def test_canonical_json():
    value = {"b": [1.0, 1e21, 1e-7, 0.1, -0.5, None, True], "a": "\u00e9\n", "\U0001f600": 1, "\ufb33": 2}
    assert C.canonical(value) == '{"a":"\u00e9\\n","b":[1,1e+21,1e-7,0.1,-0.5,null,true],"\U0001f600":1,"\ufb33":2}'
    assert C.number_text(0.000001) == "0.000001" and C.number_text(123456789012345680000.0) == "123456789012345680000"


def test_levels_against_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 12)
        ids = [f"i{rng.randint(0, n)}" for _ in range(n)]
        after = [[f"i{rng.randint(0, n)}" for _ in range(rng.randint(0, 2))] for _ in range(n)]
        first = {x: ids.index(x) for x in ids}

        def depth(i, seen=(), first=first, after=after):
            if i in seen:
                return None
            below = [depth(first[x], (*seen, i)) for x in after[i] if x in first]
            return None if None in below else 1 + max(below, default=-1)

        assert C.levels_of(ids, after) == [-1 if depth(i) is None else depth(i) for i in range(n)]


def test_plain_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "ok"), (1, 2, "assistant", "ok"), (2, 0, "assistant", "early"), (None, 0, "user", "x " * 5000), (3, 0, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = {(r.conv_id, r.turn, r.kind): r for r in C.formatted(*C.calls_of_turns(turns), {"reply": C.REPLY_SCHEMA}).collect()}
    assert set(done) == {(1, 0, "unanswered"), (1, 1, "linked"), (2, 0, "orphan"), (None, 0, "unanswered"), (3, 0, "unanswered")}
    assert done[1, 1, "linked"].level == 1 and not done[1, 1, "linked"].valid and done[1, 0, "unanswered"].valid
    assert not done[3, 0, "unanswered"].valid and done[None, 0, "unanswered"].valid


def test_a_long_chain_by_joins(spark):
    """A chain of 1,000 calls, one that ends in a cycle, and calls that wait for several."""
    calls = [(1, t, 0, f"c{t}", "add", "{}", [f"c{t - 1}"] if t else []) for t in range(1000)]
    calls += [(2, t, 0, f"c{t}", "add", "{}", [f"c{max(t - 1, 5)}", f"c{t // 2}"] if t % 7 else [f"c{t - 1}"]) for t in range(8, 40)] + [(3, t, 0, f"c{t}", "add", "{}", [f"c{(t + 1) % 9}"]) for t in range(12)]
    got = {(r.conv_id, r.turn): r.level for r in C.call_levels(spark.createDataFrame(calls, CALLS), 5).collect()}
    want = {}
    for conv in (1, 2, 3):
        own = [c for c in calls if c[0] == conv]
        want |= {(conv, c[1]): level for c, level in zip(own, C.levels_of([c[3] for c in own], [c[6] for c in own]), strict=True)}
    assert got == want and want[1, 999] == 999 and -1 in want.values()


def test_arguments_that_break_rules(spark):
    schemas = {"any": "{}", "one": json.dumps({"properties": {"a": {"enum": [1, "x"]}}})}
    given = {0: '{"a": "\\ud800"}', 1: "[" * 3000 + "]" * 3000, 2: "[" * 150 + "]" * 150, 3: '{"\\udfff": 1}', 4: '{"a": true}', 5: '{"a": 1.0}', 6: "9" * 5000}
    calls = spark.createDataFrame([(1, t, 0, f"c{t}", "one" if t > 3 else "any", x, None, "clash") for t, x in given.items()], CALLS + ", content string")
    done = {r.turn: r for r in C.formatted(calls, spark.createDataFrame([], RESULTS), schemas).collect()}
    assert {t: r.valid for t, r in done.items()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True, 6: False}
    assert done[1].errors == ["$: not JSON"] and done[4].errors == ["$.a: enum"]
    for r in done.values():
        assert C.canonical(json.loads(r.json)) == r.json
