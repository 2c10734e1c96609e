"""Tool-call linking in chats: join, order, validate, serialise.

Messages have calls (each with an identifier, a tool's name, JSON arguments and the
identifiers that it waits for) or results (each with the identifier it answers).
Calls and results meet in a hash join by conversation and identifier. A call's level
is the longest chain of calls before it; (level, turn, index) is a topological
order. Arguments are checked against the tool's schema, and every linked unit is
serialised as canonical JSON.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import json_schema
from .common import unwritten, written

#: Conversations with more calls than this are levelled by joins, not in one task.
LARGE = 20_000
#: Arguments that are nested deeper are no arguments.
MAX_DEPTH = 200

REPLY_SCHEMA = json.dumps({
    "type": "object",
    "required": ["n_words", "text"],
    "properties": {"text": {"type": "string", "minLength": 1}, "n_words": {"type": "integer", "minimum": 1}, "after": {"type": ["string", "null"]}},
    "additionalProperties": False,
})


def number_text(x: float) -> str:
    """A finite double as ECMAScript prints it."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(Decimal(repr(x))))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa
    e = int(exponent)
    digits = mantissa.lstrip("-").replace(".", "").rstrip("0")
    sign = "-" if x < 0 else ""
    if -7 < e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{digits}"
    tail = f".{digits[1:]}" if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{tail}e{'+' if e > 0 else '-'}{abs(e)}"


def well_formed(text: str) -> str:
    """The text with lone surrogates, which UTF-8 lacks, as ``\\udxxx``."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON without spaces, keys in the order of their UTF-16 units, shortest numbers, lone surrogates escaped."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return number_text(value)
    return well_formed(json.dumps(value, ensure_ascii=False))


def depth_of(value) -> int:
    """How deep objects and arrays are nested."""
    deepest, left = 0, [(value, 0)]
    while left:
        x, depth = left.pop()
        deepest = max(deepest, depth)
        if isinstance(x, dict | list):
            left += [(y, depth + 1) for y in (x.values() if isinstance(x, dict) else x)]
    return deepest


def parse(text: str | None):
    """The value of a JSON text; ValueError for bad JSON, repeated keys, NaN, infinities and over ``MAX_DEPTH`` levels."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(name)

    def finite(digits):
        x = float(digits)
        if x in (float("inf"), float("-inf")):
            raise ValueError("number out of range")
        return x

    try:
        value = json.loads(text or "", object_pairs_hook=unique, parse_constant=refuse, parse_float=finite)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    if depth_of(value) > MAX_DEPTH:
        raise ValueError("nested too deeply")
    return value


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls ``(conv_id, turn, index, id, name, arguments, after)`` with their results.

    ``results``: ``(conv_id, turn, index, id, content)``. Where an identifier occurs
    more than once in a conversation, its first call takes its first result, and so
    on. Calls without a result and results without a call stay, as ``kind``
    ``unanswered`` and ``orphan``; null identifiers match nothing. Other columns go.
    """
    calls, results = calls.select("conv_id", "turn", "index", "id", "name", "arguments", "after"), results.select("conv_id", "turn", "index", "id", "content")
    nth = F.row_number().over(Window.partitionBy("conv_id", "id").orderBy("turn", "index"))
    c = calls.withColumn("nth", nth)
    r = results.withColumn("nth", nth).select(F.col("conv_id").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("index").alias("r_index"), F.col("id").alias("r_id"), "content", F.col("nth").alias("r_nth"))
    both = c.join(r, (F.col("conv_id") == F.col("r_conv")) & (F.col("id") == F.col("r_id")) & (F.col("nth") == F.col("r_nth")), "full")
    kind = F.when(F.col("turn").isNull() & F.col("nth").isNull(), "orphan").when(F.col("r_nth").isNull(), "unanswered").otherwise("linked")
    return both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("turn", "r_turn").alias("turn"), F.coalesce("index", "r_index").alias("index"), kind.alias("kind"),
        F.coalesce("id", "r_id").alias("id"), "name", "arguments", "after", F.col("r_turn").alias("result_turn"), "content",
    )


def levels_of(ids: list, after: list) -> list[int]:
    """Level of each call of a conversation; -1 for calls in or behind a cycle.

    Identifiers that no call has are passed over; a repeated one means its first call.
    """
    first: dict = {}
    for i, x in enumerate(ids):
        first.setdefault(x, i)
    waits = [{first[x] for x in (a or []) if x in first} for a in after]
    behind: list[list[int]] = [[] for _ in ids]
    for i, w in enumerate(waits):
        for j in w:
            behind[j].append(i)
    left, level = [len(w) for w in waits], [0] * len(ids)
    ready = [i for i, n in enumerate(left) if n == 0]
    done = set(ready)
    while ready:
        i = ready.pop()
        for j in behind[i]:
            level[j] = max(level[j], level[i] + 1)
            left[j] -= 1
            if left[j] == 0:
                ready.append(j)
                done.add(j)
    return [level[i] if i in done else -1 for i in range(len(ids))]


def call_levels(calls: DataFrame, large: int = LARGE) -> DataFrame:
    """``(conv_id, turn, index, level)`` of calls ``(conv_id, turn, index, id, after)``.

    Only identifiers move, no texts. A conversation of ordinary size is levelled in
    one task; the calls of larger ones are levelled by joins, so that no task holds a
    conversation (:func:`_levels_by_joins`).
    """
    calls = calls.select("conv_id", "turn", "index", "id", "after")
    big = written(calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select(F.col("conv_id").alias("_big")), "large-conversations")
    tagged = calls.join(big, F.col("conv_id").eqNullSafe(F.col("_big")), "left")
    small = tagged.filter("_big is null").drop("_big")

    def batches(source):
        import pyarrow as pa

        def levelled(rows):
            out = [(*r[:3], level) for _, group in groupby(rows, key=lambda r: r[0]) for g in (list(group),) for r, level in zip(g, levels_of([r[3] for r in g], [r[4] for r in g]), strict=True)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], ["conv_id", "turn", "index", "level"])

        held: list[tuple] = []
        for batch in source:
            held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1  # the last conversation may go on
            yield levelled(held[:cut])
            held = held[cut:]
        yield levelled(held)

    schema = "conv_id long, turn long, index int, level int"
    out = small.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "index").mapInArrow(batches, schema)
    if big.isEmpty():
        return out
    return out.unionByName(_levels_by_joins(tagged.filter("_big is not null").drop("_big")))


def _levels_by_joins(calls: DataFrame) -> DataFrame:
    """Levels where no task may hold a conversation.

    Calls that wait for one other form chains. Pointer doubling leads each of them
    to its chain's anchor, a call that waits for none or several, in a logarithm of
    the longest chain of rounds. Then those that wait for several are levelled once
    the anchors behind them are. Calls that reach no anchor are in or behind a cycle.
    """
    base = written(calls.select(F.struct("conv_id", "turn", "index").alias("v"), "conv_id", "id", "after"), "calls")
    first = base.filter("id is not null").groupBy("conv_id", "id").agg(F.min("v").alias("d")).select(F.col("conv_id").alias("_c"), F.col("id").alias("_id"), "d")
    waits = base.select("v", "conv_id", F.explode(F.array_distinct("after")).alias("dep")).join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("dep") == F.col("_id"))).select("v", "d")
    waits = written(waits.distinct(), "waits")
    degree = waits.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
    nodes = base.select("v").distinct().join(degree, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"), "d")
    one = F.col("n") == 1
    nodes = written(nodes.select("v", "n", F.when(one, F.col("d")).otherwise(F.col("v")).alias("p"), one.cast("long").alias("far")), "call-nodes")
    jumps = nodes.select("v", "p", "far")
    for _ in range(max(1, nodes.count().bit_length())):
        ahead = jumps.select(F.col("v").alias("p"), F.col("p").alias("q"), F.col("far").alias("more"))
        step = written(jumps.join(ahead, "p").select("v", F.col("q").alias("p"), (F.col("far") + F.col("more")).alias("far"), (F.col("p") != F.col("q")).alias("moved")), "jumps")
        unwritten(jumps)
        jumps = step
        if step.filter("moved").isEmpty():
            break
    anchors = nodes.filter("n <> 1").select(F.col("v").alias("p"), "n")
    placed = written(jumps.select("v", "p", "far").join(anchors, "p"), "placed")  # a cycle's calls have no anchor and go
    of = placed.select(F.col("v").alias("d"), "p", "far")
    behind = written(waits.join(nodes.filter("n > 1").select("v"), "v").join(of, "d", "left").select("v", "p", "far"), "waits-for-anchors")
    done = written(nodes.filter("n = 0").select("v", F.lit(0).cast("long").alias("level")), "levels")
    before, count = -1, done.count()
    while count != before:
        state = behind.join(done.select(F.col("v").alias("p"), "level"), "p", "left").groupBy("v").agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        ready = state.filter("open = 0").select("v", (F.col("level") + 1).alias("level"))
        after = written(nodes.filter("n = 0").select("v", F.lit(0).cast("long").alias("level")).unionByName(ready), "levels")
        unwritten(done)
        done, before, count = after, count, after.count()
    known = placed.join(done.select(F.col("v").alias("p"), "level"), "p").select("v", (F.col("level") + F.col("far")).alias("level"))
    out = base.select("v").join(known, "v", "left").select("v.*", F.coalesce("level", F.lit(-1)).cast("int").alias("level"))
    return out.select("conv_id", "turn", F.col("index").cast("int").alias("index"), "level")


def formatted(calls: DataFrame, results: DataFrame, schemas: dict[str, str], large: int = LARGE) -> DataFrame:
    """Linked units with ``level``, ``valid``, ``errors`` and ``json`` (canonical).

    Arguments that are no JSON, and tools without a schema, are errors and not
    valid, as are those nested over ``MAX_DEPTH`` levels; such arguments stay as text
    in the JSON, whole. A schema that can't be applied in full is refused before the
    run, with a ValueError (see :mod:`json_schema`). Orphans have level 0. Other columns of either table go. Empty
    tables give no rows. The keys (conv_id, turn, index) must be unique.
    """
    for text in schemas.values():
        json_schema.load(text)
    units = linked(calls, results)
    levels = call_levels(calls, large).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("index").alias("_i"), "level")
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & F.col("index").eqNullSafe(F.col("_i")) & (F.col("kind") != "orphan")
    units = units.join(levels, on, "left").withColumn("level", F.coalesce("level", F.lit(0))).select("conv_id", "turn", "index", "kind", "id", "name", "arguments", "result_turn", "content", "level")

    def batches(source):
        import pyarrow as pa

        known = {name: json_schema.load(text) for name, text in schemas.items()}
        for batch in source:
            valid, errors, out = [], [], []
            for row in batch.to_pylist():
                unit, bad = {"id": row["id"], "kind": row["kind"], "level": row["level"]}, []
                if row["kind"] != "orphan":
                    try:
                        arguments = parse(row["arguments"])
                        bad = json_schema.violations(arguments, known[row["name"]], canonical) if row["name"] in known else ["tool: unknown"]
                    except ValueError:
                        arguments, bad = row["arguments"], ["$: not JSON"]
                    except RecursionError:  # a schema that refers to itself without going down
                        bad = ["$: schema without end"]
                    unit["call"] = {"arguments": arguments, "name": row["name"], "turn": row["turn"]}
                unit["result"] = None if row["kind"] == "unanswered" else {"content": row["content"], "turn": row["result_turn"]}
                valid.append(not bad)
                errors.append([well_formed(x) for x in bad])
                out.append(canonical(unit))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(valid), pa.array(errors, pa.list_(pa.string())), pa.array(out, pa.string())], [*batch.schema.names, "valid", "errors", "json"])

    schema = "conv_id long, turn long, index int, kind string, id string, name string, arguments string, result_turn long, content string, level int, valid boolean, errors array<string>, json string"
    return units.mapInArrow(batches, schema)


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns ``(conv_id, turn, role, text)`` as calls and results.

    Each user or system turn is a call of the tool ``reply``, with its text and word
    count as arguments, that waits for the call before it; an assistant's turn is
    the result of the last call. Equal rows are one message; other rows of the same
    turn are told apart by ``index``.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").distinct()
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("index", (F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1).cast("int"))
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("index").cast("string"))
    is_call = F.coalesce(F.col("role") != "assistant", F.lit(True))
    rows = rows.withColumn("is_call", is_call).withColumn("own", F.when(is_call, name))
    rows = rows.withColumn("last", F.last("own", ignorenulls=True).over(by_turn.rowsBetween(Window.unboundedPreceding, -1)))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    arguments = F.to_json(F.struct(F.col("last").alias("after"), words.alias("n_words"), F.col("text").alias("text")), {"ignoreNullFields": "false"})
    calls = rows.filter("is_call").select("conv_id", "turn", "index", F.col("own").alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array_compact(F.array("last")).alias("after"))
    results = rows.filter("not is_call").select("conv_id", "turn", "index", F.col("last").alias("id"), F.col("text").alias("content"))
    return calls, results


def op1_tool_call_links(spark, sf_dir: str) -> DataFrame:
    """All turns of ``conversations`` as linked calls and results, with digests of their JSON."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = formatted(*calls_of_turns(turns), {"reply": REPLY_SCHEMA})
    return done.select("conv_id", "turn", "index", "kind", "id", "level", "result_turn", "valid", F.concat_ws(";", "errors").alias("errors"), F.octet_length("json").cast("long").alias("json_bytes"), F.sha2("json", 256).alias("json_sha256"))
