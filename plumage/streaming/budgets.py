"""Model choice over arriving requests: one budget and one block list for all tasks, in Spark's state.

Requests and replies are rows of one stream, keyed by account. Tokens and blocked
models of the day are state of the account, kept by Spark's store and its checkpoint,
so they hold across tasks, batches and restarts; a timer at the day's end clears them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.routing import DAILY_LIMIT, SWITCH_RATIO

DAY_MS = 86_400_000
#: Replies that block their model until the day ends: the model is missing or refuses.
BLOCKING = (401, 403, 404)
CHOICES = "account string, request string, ts timestamp, model string, used long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ModelChoice(StatefulProcessor):
    """Per account: the day, and by model its tokens and whether it is blocked."""

    def __init__(self, models: list[str], threshold: int):
        self.models, self.threshold = models, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", "day long")
        self.state = handle.getMapState("models", "model string", "tokens long, blocked boolean")

    def _begun(self, day: int) -> bool:
        """Whether ``day`` is the state's day; a later one clears it, an earlier one is over."""
        known = self.day.get()[0] if self.day.exists() else None
        if known is not None and day < known:
            return False
        if known is None or day > known:
            if known is not None:
                self._cleared(known)
            self.day.update((day,))
            self.handle.registerTimer((day + 1) * DAY_MS)
        return True

    def _cleared(self, day: int) -> None:
        self.handle.deleteTimer((day + 1) * DAY_MS)
        self.day.clear()
        self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        pdf = pd.concat(rows).sort_values(["ms", "status", "request"], na_position="last", kind="stable")
        known = {k[0]: tuple(v) for k, v in self.state.iterator()} if self.state.exists() else {}
        day = self.day.get()[0] if self.day.exists() else None
        changed: set[str] = set()
        out = []
        for row in pdf.itertuples(index=False):
            today = row.ms // DAY_MS
            if not self._begun(today):
                continue
            if day is not None and today != day:
                known, changed = {}, set()
            day = today
            if not pd.isna(row.status):
                if row.model in self.models:
                    tokens, blocked = known.get(row.model, (0, False))
                    spent = 0 if pd.isna(row.tokens) else max(0, int(row.tokens))
                    known[row.model] = (tokens + spent, blocked or int(row.status) in BLOCKING)
                    changed.add(row.model)
                continue
            usable = [m for m in self.models if not known.get(m, (0, False))[1]]
            if not usable:  # all allowed again
                known = {m: (n, False) for m, (n, _) in known.items()}
                changed |= set(known)
                usable = self.models
            used = lambda m: known.get(m, (0, False))[0]
            model = next((m for m in usable if used(m) < self.threshold), None) or min(usable, key=used)
            out.append((key[0], row.request, row.ts, model, used(model)))
        for m in changed:
            self.state.updateValue((m,), known[m])
        yield pd.DataFrame(out, columns=["account", "request", "ts", "model", "used"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.day.exists() and (self.day.get()[0] + 1) * DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
            self.day.clear()
            self.state.clear()
        yield pd.DataFrame({"account": [], "request": [], "ts": pd.to_datetime([]), "model": [], "used": []})

    def close(self) -> None:
        pass


def chosen_models(events: DataFrame, models: list[str], limit: int = DAILY_LIMIT, ratio: float = SWITCH_RATIO, late: str = "10 minutes") -> DataFrame:
    """STM5, STM6: the model of every arriving request: ``account, request, ts, model, used``.

    ``events(account, ts, request, model, status, tokens)``: a request has a null status,
    a reply its model, status and tokens. In a batch they count in the order of ``ts``,
    replies before requests of the same time. The first model below its part of the
    day's budget is chosen, else the least used; models that were missing or refused
    are left out till the day's end, unless none is left. Rows of a day that is over
    for their account, or later than the watermark, have no effect. Needs the RocksDB
    state store (``STORE``).
    """
    names = list(dict.fromkeys(m.strip() for m in models if m and m.strip()))
    if not names:
        raise ValueError("no models given")
    threshold = int(limit * min(0.99, max(0.1, ratio)))
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("account is not null and ts is not null").withWatermark("ts", late)
    rows = timed.select("account", "ts", "request", "model", "status", "tokens", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("account").transformWithStateInPandas(ModelChoice(names, threshold), CHOICES, "Append", "EventTime")
