"""Model choice in a stream against a plain replay, across batches and a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from plumage.streaming import budgets

SCHEMA = "account string, ts timestamp, request string, model string, status int, tokens long"
START = datetime.datetime(2024, 5, 1, 6)


@pytest.fixture(scope="module")
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, budgets.STORE)
    yield
    spark.conf.set(key, before)


def events(seed, n):
    """Requests and replies of two accounts over three days, in order of time."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = START + datetime.timedelta(minutes=9 * i)
        account = rng.choice("xy")
        if rng.random() < 0.5:
            out.append((account, ts, f"r{i:04}", None, None, None))
        else:
            out.append((account, ts, f"r{i:04}", rng.choice("abc"), rng.choice([200, 200, 200, 200, 429, 404, 403]), rng.choice([None, 100, 250])))
    return out


def replay(rows, models, threshold):
    state, out = {}, {}
    for account, ts, request, model, status, tokens in rows:
        day, used, blocked = state.get(account, (None, {}, set()))
        if day != ts.date():
            day, used, blocked = ts.date(), {}, set()
        if status is None:
            free = [m for m in models if m not in blocked]
            if not free:
                blocked, free = set(), models
            best = next((m for m in free if used.get(m, 0) < threshold), None) or min(free, key=lambda m: used.get(m, 0))
            out[request] = (account, best, used.get(best, 0))
        else:
            used[model] = used.get(model, 0) + (tokens or 0)
            if status in (401, 403, 404):
                blocked.add(model)
        state[account] = (day, used, blocked)
    return out


def run(spark, folder, checkpoint, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = budgets.chosen_models(stream, ["a", "b", "c"], limit=1000, ratio=0.5)
    query = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", name).trigger(availableNow=True).start()
    query.awaitTermination(600)
    assert query.exception() is None


def test_replay_across_batches_and_a_restart(spark, store, tmp_path):
    rows = events(3, 420)
    folder, checkpoint, name = (str(tmp_path / d) for d in ("in", "state", "out"))
    for at in range(0, 280, 70):
        spark.createDataFrame(rows[at : at + 70], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, checkpoint, name)
    for at in range(280, 420, 70):  # another query takes over where the first one ended
        spark.createDataFrame(rows[at : at + 70], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, checkpoint, name)
    got = {r.request: (r.account, r.model, r.used) for r in spark.read.parquet(name).collect()}
    want = replay(rows, ["a", "b", "c"], 500)
    assert got == want and len({m for _, m, _ in want.values()}) == 3


def test_no_models():
    with pytest.raises(ValueError, match="no models"):
        budgets.chosen_models(None, [" ", ""])
