"""The request loop, its shared rate and budget, and routing between two ways with failures as rows."""

import itertools
import json
import random

from pyspark.sql import functions as F

from plumage.operators import routing
from plumage.sources import remote


def test_model_requests(spark):
    def factory():
        calls = {"n": 0}

        def transport(url, body):
            calls["n"] += 1
            assert body["thinking"] == {"type": "disabled"}
            if body["model"] == "refused":
                raise PermissionError
            if calls["n"] == 2:
                raise BlockingIOError
            return {"choices": [], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}

        return transport

    rows = spark.createDataFrame([("i1", "[]"), ("i2", "[]"), ("i3", None)], "image string, request string").coalesce(1)
    got = {r.image: r for r in remote.ask_models(rows, factory, ["refused", "m"], "u", sleep=lambda s: None).collect()}
    assert {(r.image, r.model, r.total_tokens, r.outcome) for r in got.values()} == {("i1", "m", 7, "ok"), ("i2", "m", 7, "ok"), ("i3", "m", None, "broken")}
    assert got["i1"].attempts == 3 and got["i3"].attempts == 5
    usage = remote.usage_of(remote.ask_models(rows, factory, ["m"], "u", sleep=lambda s: None), "2024-05-01")
    assert [(str(r.day), r["model"], r.tokens) for r in usage.collect()] == [("2024-05-01", "m", 14)]
    assert remote.usage_today(usage, "2024-05-01") == {"m": 14} and remote.usage_today(usage, "2024-05-02") == {} and remote.usage_today(usage) == {}


def plain_loop(models, blocked, used, threshold, events, retries):
    """One request by the written rules, with lists only: models asked, waits and the outcome."""
    free = [m for m in models if m not in blocked]
    if not free:
        blocked.clear()
        free = list(models)
    now = next((m for m in free if used[m] < threshold), None) or sorted(free, key=lambda m: used[m])[0]
    asked, waits = [], []

    def step_on():
        nonlocal now
        pool = [m for m in models if m not in blocked]
        if not pool or (len(pool) == 1 and pool[0] == now):
            return False
        now = pool[0] if now not in pool else (pool + pool)[pool.index(now) + 1]
        return True

    for attempt in range(retries):
        event, after = next(events)
        asked.append(now)
        last = attempt == retries - 1
        if event == "ok":
            used[now] += 1000
            return asked, waits, "ok"
        if last:
            break
        if event == "limited":
            step_on()
            waits.append(min(after, 120) if after else min(2.0**attempt, 120))
        elif event in ("missing", "refused"):
            blocked.add(now)
            if not step_on():
                break
            waits.append(min(2.0 if event == "missing" else 3.0, 0.5 * (attempt + 1)))
        elif event == "timeout":
            step_on()
            waits.append(min(8.0, 2.0 * (attempt + 1)))
        elif event == "failed":
            waits.append(min(6.0, 1.0 * (attempt + 1)))
        else:
            waits.append(1.0)
    return asked, waits, event


def test_loop_against_the_plain_rules():
    rng = random.Random(9)
    for _ in range(300):
        models = [f"m{i}" for i in range(rng.randint(1, 4))]
        retries = rng.randint(1, 7)
        loop = remote.ModelLoop(models, limit=8000, ratio=0.5, retries=retries)
        blocked, used = set(), dict.fromkeys(models, 0)
        for _ in range(12):
            script = [(rng.choice(["ok", "limited", "missing", "refused", "timeout", "failed", "broken"]), rng.choice([None, 0.5, 500.0])) for _ in range(retries)]
            want = plain_loop(models, blocked, used, 4000, iter(script), retries)
            loop.begin()
            asked, waits = [], []
            for attempt, (event, after) in enumerate(script):
                asked.append(loop.model)
                if event == "ok":
                    loop.spent(1000)
                    break
                wait = loop.after(attempt, event, after)
                if wait is None:
                    break
                waits.append(wait)
            assert (asked, waits, event) == want
            assert loop.blocked == blocked and loop.used == used


def test_replies_and_messages(spark):
    assert [remote.event_of(remote.Reply(s)) for s in (200, 429, 404, 401, 403, 500, 418)] == ["ok", "limited", "missing", "refused", "refused", "failed", "failed"]
    assert remote.tokens_of({"usage": {"total_tokens": 0, "prompt_tokens": 9}}) == 0 and remote.tokens_of({}) == 0
    text = spark.createDataFrame([(bytearray(b"\xff\xd8x" * 60), 'say "x"')], "content binary, prompt string").select(remote.image_messages(F.col("content"), F.col("prompt")).alias("m")).first().m
    (message,) = json.loads(text)
    assert message["role"] == "user" and message["content"][1] == {"type": "text", "text": 'say "x"'}
    assert message["content"][0]["image_url"]["url"].startswith("data:image/jpeg;base64,/9h4") and "\n" not in message["content"][0]["image_url"]["url"]


class Clock:
    """Time that passes only when somebody sleeps; every task has its own copy, all begin at 0."""

    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_all_tasks_together_keep_the_rate_and_share_the_budget(spark, tmp_path):
    log = str(tmp_path / "requests")
    clock = Clock()

    def factory():
        def transport(url, body):
            with open(log, "a") as file:
                file.write(f"{clock.now} {body['model']}\n")
            return remote.Reply(200, {"usage": {"total_tokens": 100}})

        return transport

    rows = spark.range(400).select(F.col("id").cast("string").alias("image"), F.lit("[]").alias("request"))
    got = remote.ask_models(rows, factory, ["a", "b"], "u", interval=0.5, parts=5, given={"a": 2000}, limit=20_000, ratio=0.5, clock=clock, sleep=clock.sleep).collect()
    assert len(got) == 400 and {r.outcome for r in got} == {"ok"}
    times = sorted(float(line.split()[0]) for line in open(log))
    assert len(times) == 400 and all(b - a >= 0.5 - 1e-9 for a, b in zip(times, times[1:], strict=False))
    by_model = {m: sum(r["model"] == m for r in got) for m in "ab"}
    assert 8000 <= 100 * by_model["a"] <= 8000 + 5 * 100 + 22_000  # up to its threshold first, b next, then the less used of both
    first = [line.split()[1] for line in sorted(open(log), key=lambda x: float(x.split()[0]))]
    assert first[:80] == ["a"] * 80 and "b" in first[80:90]


def test_a_restarted_task_makes_no_burst():
    clock = Clock()
    throttle = remote.Throttle(1.0, 3, 4, clock, clock.sleep)
    throttle.wait()
    assert clock.now == 3.0
    clock.now = 100.0
    throttle.wait()
    throttle.wait()
    assert clock.now == 104.0  # idle time isn't saved up


def plain_route(local, online, use_local, fallback):
    """What two ways give, step by step; each is None (absent), ok, empty or raised."""
    results, method = [], "unknown"
    if not use_local and online:
        if online != "raised":
            results, method = (["r"] if online == "ok" else []), "豆包API(m)"
            if results:
                return results, method
        elif not fallback:
            return [], "豆包API(失败)"
    if local and local != "raised":
        return (["l"] if local == "ok" else []), "本地模型" if use_local else "本地模型(豆包无可用结果，已回退)"
    if local == "raised":
        pass
    if fallback and online and use_local and online != "raised":
        return (["r"] if online == "ok" else []), "豆包API(m)(回退)"
    return results, method


def test_every_outcome_of_two_ways(spark):
    states = [("ok", "ok"), ("ok", "empty"), ("ok", "raised"), ("empty", "ok"), ("empty", "empty"), ("empty", "raised"), ("raised", "ok"), ("raised", "empty"), ("raised", "raised")]
    items = spark.createDataFrame([(i, *s, first) for i, (s, first) in enumerate(itertools.product(states, (True, False)))], "k int, lo string, re string, here boolean")

    def way(column, name, model):
        one = F.array(F.struct(F.lit(1).alias("rank"), F.lit(name).alias("name"), F.lit(0.5).alias("confidence")))
        none = F.array().cast("array<struct<rank:int,name:string,confidence:double>>")
        return lambda rows: rows.filter(f"{column} != 'raised' or k % 2 = 0").select("k", F.col(column).alias("status"), F.lit(model).alias("model"), F.when(F.col(column) == "ok", one).otherwise(none).alias("candidates"))  # half of the faults have no row at all

    seen = set()
    for has_local, has_remote, fallback in itertools.product((True, False), repeat=3):
        got = routing.hybrid(items, "k", way("lo", "l", None) if has_local else None, way("re", "r", "m") if has_remote else None, F.col("here"), fallback).collect()
        assert len(got) == len(states) * 2
        for r in got:
            want = plain_route(r.lo if has_local else None, r["re"] if has_remote else None, r.here, fallback)
            assert ([c.name for c in r.candidates], r.method) == want, (r, has_local, has_remote, fallback)
            seen.add(r.method)
    assert len(seen) == 6
    plain = routing.hybrid(items.drop("here"), "k", way("lo", "l", None), way("re", "r", ""), use_local=False).filter("re = 'ok'").first()
    assert plain.method == "豆包API"
    assert routing.hybrid(items.filter("false"), "k", way("lo", "l", None), way("re", "r", "m"), True).count() == 0


def test_each_way_is_asked_once_and_only_for_what_is_left(spark, tmp_path):
    log = str(tmp_path / "asked")

    def counted(rows):
        def batches(source):
            import pandas as pd

            for pdf in source:
                with open(log, "a") as file:
                    file.writelines(f"{k}\n" for k in pdf["k"])
                yield pd.DataFrame({"k": pdf["k"], "status": "empty", "model": None, "candidates": [[] for _ in pdf["k"]]})

        return rows.select("k").mapInPandas(batches, "k int, " + routing.ATTEMPT)

    items = spark.createDataFrame([(i,) for i in range(20)], "k int")
    local = lambda rows: rows.select("k", F.when(F.col("k") < 15, "ok").otherwise("raised").alias("status"), F.lit(None).cast("string").alias("model"), F.array(F.struct(F.lit(1).alias("rank"), F.lit("l").alias("name"), F.lit(0.5).alias("confidence"))).alias("candidates"))
    out = routing.hybrid(items, "k", local, counted, True)
    assert out.count() == 20 and out.filter("method like '%回退%'").count() == 5
    assert sorted(int(x) for x in open(log)) == list(range(15, 20))


def test_answers_become_attempts(spark):
    answers = spark.createDataFrame([("a", "m", "{}", 5, "ok", 1, 0.0), ("b", "m", None, None, "limited", 5, 9.0), ("c", "m", "{}", 5, "ok", 1, 0.0)], remote.ANSWERS)
    parsed = spark.createDataFrame([("a", [(1, "x", 0.9)]), ("c", [])], "image string, candidates array<struct<rank:int,name:string,confidence:double>>")
    assert {r.image: r.status for r in routing.answered(answers, parsed).collect()} == {"a": "ok", "b": "empty", "c": "empty"}
