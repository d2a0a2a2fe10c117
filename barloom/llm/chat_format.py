"""Chat formatting with tool calls: calls meet results by id, stand in topological order, are validated, and become canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import materialize, release

_KINDS = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: (isinstance(x, int) or isinstance(x, float) and x.is_integer()) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "array": lambda x: isinstance(x, list),
    "object": lambda x: isinstance(x, dict),
    "null": lambda x: x is None,
}


def same(a, b) -> bool:
    """Whether two JSON values are equal: 1 and 1.0 are, true and 1 are not."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def canonical_json(value) -> str:
    """Keys sorted by code point, no white space, non-ASCII characters as they are, no NaN and no infinity.

    Integers are written in digits and other numbers as the shortest text that gives the double again, so 1.0 stays 1.0
    and differs from 1, and -0 is an integer 0 but -0.0 stays. Of keys that repeat in the source the last counts.
    """
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema's type, enum, bounds, required, properties, additionalProperties and items a value breaks."""
    kinds = schema.get("type")
    if kinds and not any(_KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    found = []
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        found.append(f"{at}: not one of the values allowed")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{at}: out of bounds")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        found.append(f"{at}: length out of bounds")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{at}[{i}]")
    return found


def _lines(schemas: dict[str, dict]):
    def check(name: str | None, arguments: str | None) -> tuple[object, list[str]]:
        try:
            value = json.loads(arguments or "", parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
            canonical_json(value).encode()
        except (ValueError, RecursionError):  # a number beyond doubles and a lone surrogate are no values either
            return arguments, ["$: not JSON"]
        return value, problems(value, schemas[name]) if name in schemas else [f"unknown tool {name}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ("conv_id", "turn", "step", "part", "call_id", "status")
        for b in batches:
            lines, errors = [], []
            for part, role, text, name, arguments, call_id, parents in zip(*(b.column(c).to_pylist() for c in ("part", "role", "text", "name", "arguments", "call_id", "parents")), strict=True):
                wrong: list[str] = []
                if part == 0:
                    line = {"role": role, "content": text}
                elif part == 1:
                    value, wrong = check(name, arguments)
                    line = {"role": "assistant", "tool_call": {"id": call_id, "name": name, "arguments": value}}
                    if parents:
                        line["tool_call"]["after"] = sorted(parents)
                else:
                    line = {"role": "tool", "tool_call_id": call_id, "content": text}
                lines.append(canonical_json(line))
                errors.append("; ".join(wrong) or None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(errors, pa.string()), pa.array(lines, pa.string())], names=[*kept, "problem", "line"])

    return run


def _depths(calls: list[str], parents: list[list[str] | None]) -> list[int | None]:
    """The step of each call of one conversation; None on a cycle and behind one."""
    known = set(calls)
    waits = {c: known.intersection(ps or ()) for c, ps in zip(calls, parents, strict=True)}
    after: dict[str, list[str]] = {}
    for c, ps in waits.items():
        for p in ps:
            after.setdefault(p, []).append(c)
    open_parents = {c: len(ps) for c, ps in waits.items()}
    step: dict[str, int] = {}
    ready = [(c, 0) for c, n in open_parents.items() if not n]
    while ready:
        following = []
        for c, at in ready:
            step[c] = at
            for d in after.get(c, ()):
                open_parents[d] -= 1
                if not open_parents[d]:
                    following.append((d, at + 1))
        ready = following
    return [step.get(c) for c in calls]


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for conv, calls in zip(b.column("conv_id").to_pylist(), b.column("calls").to_pylist(), strict=True):
            ids = [c["call_id"] for c in calls]
            out += [(conv, i, s) for i, s in zip(ids, _depths(ids, [c["parents"] for c in calls]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int32()))], names=["conv_id", "call_id", "step"])


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b by keys; null is a key like any other."""
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    return a.join(other, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), how).drop(*(f"_{k}" for k in keys))


def order_calls(calls: DataFrame, whole_edges: int = 10_000) -> DataFrame:
    """(conv_id, call_id, step) of one row per (conv_id, call_id), with parents: 0 without known parents, else 1 + the largest of theirs.

    Conversations of up to whole_edges calls and parents are ordered as one row each. In longer ones, rounds of joins
    settle the calls whose parents are all settled, and drop them; there are as many rounds as their longest chain has
    calls. What lies on a cycle, or behind one, never settles and has a null step. Parents that do not occur are left out.
    """
    size = calls.groupBy("conv_id").agg(F.sum(F.lit(1) + F.coalesce(F.array_size("parents"), F.lit(0))).alias("size"))
    long = materialize(size.where(F.col("size") > whole_edges).select("conv_id"))
    short = _met(calls, long, ["conv_id"], "left_anti").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "parents")).alias("calls"))
    ordered = short.select(F.col("conv_id").cast("long").alias("conv_id"), "calls").mapInArrow(_ordered, "conv_id long, call_id string, step int")
    if long.isEmpty():
        return ordered
    known = materialize(_met(calls, long, ["conv_id"], "left_semi").select("conv_id", "call_id", "parents"))
    edges = known.select("conv_id", "call_id", F.explode("parents").alias("parent")).distinct()
    waiting = materialize(_met(edges, known.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"]).withColumn("above", F.lit(-1)))
    rounds = [materialize(_met(known, waiting, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("step")))]
    while not rounds[-1].isEmpty():
        # a settled parent leaves its step with the edge; calls without open edges settle, and take their edges along
        met = _met(waiting, rounds[-1].select("conv_id", F.col("call_id").alias("parent"), "step"), ["conv_id", "parent"], "left")
        met = materialize(met.select("conv_id", "call_id", "parent", F.coalesce("step", "above").alias("above")))
        ready = met.groupBy("conv_id", "call_id").agg(F.min("above").alias("least"), (F.max("above") + 1).alias("step")).where("least >= 0")
        rounds.append(materialize(ready.select("conv_id", "call_id", "step")))
        waiting, before = materialize(_met(met, rounds[-1], ["conv_id", "call_id"], "left_anti")), waiting
        release(before, met)
    settled = reduce(DataFrame.unionByName, rounds)
    return ordered.unionByName(_met(known.select("conv_id", "call_id"), settled, ["conv_id", "call_id"], "left"))


def format_conversations(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message, call and result: conv_id, turn, step, part, call_id, status, problem, line.

    messages (conv_id, turn, role, text), calls (conv_id, turn, call_id, name, arguments, parents), results (conv_id,
    call_id, text). Rows of a conversation stand in the order of (turn, step, call_id, part): its message, then calls by
    step, each (part 1) before its result (part 2). status of a call: linked, pending (no result) or cycle; of a
    result: linked, or orphan (no such call; its turn is null and it comes last). problem says what is wrong with a
    call's arguments. Calls that share an id are one call, the one of the smallest turn, name and arguments; results
    that share one are all kept. Null texts are JSON null; arguments that are no JSON text (or hold a number beyond doubles
    or a lone surrogate) stay as the raw text; calls and results of null id are linked with nothing. Rows
    of a null conv_id are a conversation of their own, a null turn stays null, messages that repeat are all kept, and
    empty tables give no rows. A conversation of any length is many rows in many tasks, never one group. Other columns
    are ignored.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    same = calls.select("conv_id", "call_id", F.struct("turn", "name", "arguments", F.coalesce("parents", F.array().cast("array<string>")).alias("parents")).alias("c"))
    one = materialize(same.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("c").alias("c")).select("conv_id", "call_id", "c.*"))
    steps = order_calls(one)
    placed = _met(one, steps, ["conv_id", "call_id"])
    answered = results.where("call_id is not null").select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    status = F.when(F.col("step").isNull(), "cycle").when(F.col("answered"), "linked").otherwise("pending")
    none = lambda t: F.lit(None).cast(t)
    columns = ("conv_id", "turn", "step", "part", "call_id", "status", "role", "text", "name", "arguments", "parents")
    said = messages.select("conv_id", "turn", F.lit(-1).alias("step"), F.lit(0).alias("part"), none("string").alias("call_id"), F.lit("message").alias("status"), "role", "text", none("string").alias("name"), none("string").alias("arguments"), none("array<string>").alias("parents"))
    called = _met(placed, answered, ["conv_id", "call_id"], "left").withColumns({"status": status, "part": F.lit(1), "role": none("string"), "text": none("string")}).select(*columns)
    idless = calls.where("call_id is null").select("conv_id", "turn", F.lit(0).alias("step"), F.lit(1).alias("part"), none("string").alias("call_id"), F.lit("pending").alias("status"), none("string").alias("role"), none("string").alias("text"), "name", "arguments", "parents")
    back = (
        _met(results.select("conv_id", "call_id", "text"), placed.select("conv_id", "call_id", "turn", "step", F.lit(True).alias("known")), ["conv_id", "call_id"], "left")
        .withColumns({"status": F.when(F.col("known").isNull(), "orphan").otherwise("linked"), "part": F.lit(2), "role": none("string"), "name": none("string"), "arguments": none("string"), "parents": none("array<string>")})
        .select(*columns)
    )
    rows = said.unionByName(called).unionByName(idless).unionByName(back)
    return rows.mapInArrow(_lines(schemas), "conv_id long, turn long, step int, part int, call_id string, status string, problem string, line string")


#: Tools of the calls that are derived from plain conversations.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "top"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 20}, "top": {"type": "integer", "minimum": 1, "maximum": 10}}},
    "count_words": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "least": {"type": "integer", "minimum": 0}}},
    "translate": {"type": "object", "required": ["text", "to"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "to": {"enum": ["de", "en", "es", "fr"]}}},
}


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results over plain conversations, for data that has none of its own.

    Each assistant turn makes a call whose tool, arguments and id follow from the text, each user turn answers the
    call of the turn before it, and a call comes after that of two turns before within the same eight turns.
    """
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    call_id = lambda turn: F.substr(F.sha2(F.concat_ws(":", "conv_id", turn), 256), F.lit(1), F.lit(16))
    pick = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    length = F.length("text")
    search = F.to_json(F.named_struct(F.lit("query"), F.col("text"), F.lit("top"), length % 12))
    count = F.to_json(F.named_struct(F.lit("text"), F.col("text"), F.lit("least"), length - 100))
    translate = F.to_json(F.named_struct(F.lit("text"), F.col("text"), F.lit("to"), F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr", "it"))), (length % 5 + 1).cast("int"))))
    asked = turns.where("role = 'assistant'")
    calls = asked.select(
        "conv_id", "turn", call_id("turn").alias("call_id"),
        F.when(pick == 0, "search").when(pick == 1, "count_words").otherwise("translate").alias("name"),
        F.when(pick == 0, search).when(pick == 1, count).otherwise(translate).alias("arguments"),
        F.when(F.col("turn") % 8 >= 2, F.array(call_id(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("parents"),
    )
    results = turns.where("role = 'user' and turn > 0").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "text")
    return calls, results
