"""Requests to remote vision models: a loop over models as a state machine, a shared rate, a daily budget.

A transport is ``transport(url, body) -> Reply`` (or the body's dict alone), made in
each task by a factory. It may raise ``TimeoutError`` or ``OSError``; ``PermissionError``
stands for a reply of 403 and ``BlockingIOError`` for one of 429. Rate and budget are
shares: requests are dealt over a fixed number of tasks, each with its part of both,
so all tasks together keep them without talking to each other.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import backoff_seconds
from ..operators.routing import DAILY_LIMIT, SWITCH_RATIO

#: Tries of a request, base of the waits between them and the longest, seconds between requests.
RETRIES = 5
BACKOFF_BASE = 2.0
LONGEST_WAIT = 120.0
INTERVAL = 1.0
#: By event, the wait's step and its bound in seconds; too many requests wait otherwise.
WAITS = {"missing": (0.5, 2.0), "refused": (0.5, 3.0), "timeout": (2.0, 8.0), "failed": (1.0, 6.0), "broken": (0.0, 1.0)}
#: Fixed value: what a request body holds beside model and messages.
OPTIONS = {"thinking": {"type": "disabled"}}

ANSWERS = "image string, model string, answer string, total_tokens long, outcome string, attempts int, waited double"


class Reply(NamedTuple):
    status: int
    body: object = None
    retry_after: float | None = None


class ModelLoop:
    """Which model is asked next, after which wait: one state for all requests of a task.

    ``given`` are tokens used before by model, ``parts`` the number of tasks that share
    the budget. A model that refuses or is missing is blocked for the task's lifetime;
    when all are, all are allowed again for the next request.
    """

    def __init__(self, models: list[str], given: dict[str, int] | None = None, parts: int = 1, limit: int = DAILY_LIMIT, ratio: float = SWITCH_RATIO, retries: int = RETRIES, base: float = BACKOFF_BASE, most: float = LONGEST_WAIT):
        self.models = list(dict.fromkeys(m.strip() for m in models if m and m.strip()))
        if not self.models:
            raise ValueError("no models given")
        self.retries, self.base, self.most = retries, base, most
        self.blocked: set[str] = set()
        self.used = {m: (given or {}).get(m, 0) / parts for m in self.models}
        self.threshold = int(limit * min(0.99, max(0.1, ratio))) / parts
        self.model = self.models[0]

    def usable(self) -> list[str]:
        return [m for m in self.models if m not in self.blocked]

    def begin(self) -> str:
        """The model for a new request: the first below its share of the budget, else the least used."""
        if not self.usable():
            self.blocked.clear()
        below = [m for m in self.usable() if self.used[m] < self.threshold]
        self.model = below[0] if below else min(self.usable(), key=self.used.__getitem__)
        return self.model

    def _moved(self, block: bool = False) -> bool:
        if block:
            self.blocked.add(self.model)
        pool = self.usable()
        if not pool or pool == [self.model]:
            return False
        self.model = pool[(pool.index(self.model) + 1) % len(pool)] if self.model in pool else pool[0]
        return True

    def after(self, attempt: int, event: str, retry_after: float | None = None, draw: float = 0.0) -> float | None:
        """Seconds to wait before the next try, or None if there is none."""
        if attempt >= self.retries - 1:
            return None
        if event == "limited":
            self._moved()
            return backoff_seconds(attempt, retry_after, self.base, self.most, draw)
        if event in ("missing", "refused") and not self._moved(block=True):
            return None
        if event == "timeout":
            self._moved()
        step, bound = WAITS[event]
        return min(bound, step * (attempt + 1)) if step else bound

    def spent(self, tokens: int) -> None:
        self.used[self.model] += max(0, tokens)


class Throttle:
    """One task's share of a rate: slots ``parts * interval`` seconds apart, its first moved by its number."""

    def __init__(self, interval: float, part: int, parts: int, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.step, self.clock, self.sleep = interval * parts, clock, sleep
        self.slot = clock() + interval * part

    def wait(self) -> None:
        if self.step <= 0:
            return
        now = self.clock()
        if self.slot > now:
            self.sleep(self.slot - now)
        self.slot = max(self.slot, now) + self.step


def event_of(reply: Reply) -> str:
    """Name of what a reply means for the loop."""
    known = {429: "limited", 404: "missing", 401: "refused", 403: "refused"}
    return known.get(reply.status, "ok" if 200 <= reply.status < 400 else "failed")


def tokens_of(body: dict) -> int:
    """AGG8: the total, else prompt and completion."""
    usage = body.get("usage") or {}
    total = usage.get("total_tokens")
    return int(total) if total is not None else int(usage.get("prompt_tokens") or 0) + int(usage.get("completion_tokens") or 0)


def image_messages(content: Column, prompt: Column) -> Column:
    """SRC31, STR19: the messages of a request as JSON: a JPEG in base64 and a text."""
    kind = lambda k: F.lit(k).alias("type")
    encoded = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    picture = F.struct(kind("image_url"), F.struct(F.concat(F.lit("data:image/jpeg;base64,"), encoded).alias("url")).alias("image_url"), F.lit(None).cast("string").alias("text"))
    text = F.struct(kind("text"), F.lit(None).cast("struct<url:string>").alias("image_url"), prompt.alias("text"))
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.array(picture, text).alias("content"))))


def usage_today(usage: DataFrame, day: str | None = None) -> dict[str, int]:
    """SRC33: tokens by model on one day, today if none is named; other days count as none.

    ``usage(day, model, tokens)``; a row a model comes to the driver.
    """
    that = F.current_date() if day is None else F.lit(day).cast("date")
    rows = usage.filter((F.col("day").cast("date") == that) & (F.col("tokens") > 0)).groupBy("model").agg(F.sum("tokens").alias("n")).collect()
    return {r["model"]: r.n for r in rows}


def ask_models(
    images: DataFrame, factory: Callable[[], Callable], models: list[str], url: str, retries: int = RETRIES, interval: float = 0.0, parts: int | None = None, given: dict[str, int] | None = None,
    limit: int = DAILY_LIMIT, ratio: float = SWITCH_RATIO, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """SRC31, MTH8, MTH9: one chat request a row of ``images(image, request)``, its answer or what went wrong.

    ``request`` is the JSON text of the messages. ``interval`` seconds lie between
    requests of all tasks together: with it (or ``parts``) rows are dealt in turn over
    that many tasks, each with its share of the rate and of the budget. ``outcome`` is
    ``ok`` or the last event (``limited``, ``missing``, ``refused``, ``timeout``, ``failed``,
    ``broken``). A null request is ``broken``. Write the result before it is used
    twice: each evaluation asks again.
    """
    dealt = parts or (8 if interval else None)
    rows = images.select(F.col("image").cast("string"), "request")
    rows = rows.repartition(dealt) if dealt else rows

    def batches(source):
        import json
        import random

        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        transport = factory()
        loop = ModelLoop(models, given, dealt or 1, limit, ratio, retries)
        throttle = Throttle(interval, part, dealt or 1, clock, sleep)
        rng = random.Random(part)

        def one(request: str | None):
            loop.begin()
            waited, event = 0.0, "broken"
            for attempt in range(retries):
                retry_after = None
                asked = loop.model
                throttle.wait()
                try:
                    reply = transport(url, {"model": asked, **OPTIONS, "messages": json.loads(request)})
                    reply = reply if isinstance(reply, Reply) else Reply(200, reply)
                    event, retry_after = event_of(reply), reply.retry_after
                    if event == "ok":
                        tokens = tokens_of(reply.body)
                        loop.spent(tokens)
                        return asked, json.dumps(reply.body, ensure_ascii=False), tokens, "ok", attempt + 1, waited
                except TimeoutError:
                    event = "timeout"
                except PermissionError:
                    event = "refused"
                except BlockingIOError as e:
                    event, retry_after = "limited", getattr(e, "retry_after", None)
                except OSError:
                    event = "failed"
                except (ValueError, TypeError, AttributeError):
                    event = "broken"
                wait = loop.after(attempt, event, retry_after, rng.random())
                if wait is None:
                    break
                waited += wait
                sleep(wait)
            return asked, None, None, event, attempt + 1, waited

        names = [c.split()[0] for c in ANSWERS.split(", ")]
        for pdf in source:
            yield pd.DataFrame([(i, *one(r)) for i, r in zip(pdf["image"], pdf["request"], strict=True)], columns=names).astype({"total_tokens": "Int64"})

    return rows.mapInPandas(batches, ANSWERS)


def usage_of(answers: DataFrame, day: str | None = None) -> DataFrame:
    """AGG8: ``(day, model, tokens)`` of written answers, for the table of usage."""
    that = F.current_date() if day is None else F.lit(day).cast("date")
    return answers.filter("total_tokens > 0").groupBy("model").agg(F.sum("total_tokens").alias("tokens")).select(that.alias("day"), "model", "tokens")
