"""Recurrences along series as scans of composable steps: no series is one task.

A step takes the state before a row to the state after it by a small matrix, in the usual algebra or in the max-plus
one, so steps compose. Rows are dealt by ranges of (series, date). In a first pass each range composes the steps of each
of its series (one matrix for each series and range); these are applied one after another along each series, which gives
the state that enters a range; a second pass gives the states of all rows. Within a range the steps of all its series
are composed together by doubling, so many short series cost no more than one long one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ranges import ranged
from barloom.sources.scratch import release, written

#: Rows of a range, about: a row's step is a matrix, of which a task's Python holds a few for each row of a range.
STEPS = 50_000


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


class Recurrence(NamedTuple):
    """steps(x, before, fresh): a matrix for each row, from its value, that of the row before (nan: none), and whether the
    series begins with it; start: the state before a series; outputs(states, x): the columns that are made."""

    steps: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    start: np.ndarray
    outputs: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]
    made: dict[str, str]
    product: Callable[[np.ndarray, np.ndarray], np.ndarray] = times


def composed(steps: np.ndarray, first: np.ndarray, product=times) -> np.ndarray:
    """For each row the product of its step and all before it back to row first[i] (of its series)."""
    out, at, width = steps.copy(), np.arange(len(steps)), 1
    while True:
        rows = at[at - width >= first]
        if not len(rows):
            return out
        out[rows] = product(out[rows], out[rows - width])  # the right side is read as it was before
        width *= 2


def _segments(t: pa.Table, key: str, date: str, value: str, descending: bool) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows in order, each row's value, and the first row of each row's series."""
    t = t.sort_by([(key, "ascending"), (date, "descending" if descending else "ascending")])
    codes = t.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    begins = np.ones(len(t), bool)
    begins[1:] = codes[1:] != codes[:-1]
    return t, t.column(value).to_numpy().astype("f8"), np.maximum.accumulate(np.where(begins, np.arange(len(t)), 0))


def _shifted(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(x)
    before[1:], before[0] = x[:-1], np.nan
    before[np.unique(first)] = np.nan
    return before


def along(df: DataFrame, value: str, rule: Recurrence, key: str, date: str, descending: bool = False) -> DataFrame:
    """df with the columns of a recurrence over `value` along each series in the order of dates (or backwards).

    Null values reach the rule as nan; rows of a null key are a series of their own.
    """
    size, names = len(rule.start), df.columns
    given = written(df)  # computed once, to be counted, cut and dealt
    many = max(1, -(-given.count() // STEPS))
    rows = written(ranged(given, [key], F.desc(date) if descending else F.asc(date), rows=STEPS))
    release(given)
    kind = df.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    made = ", ".join(f"{c} {t}" for c, t in rule.made.items())

    def summed(t: pa.Table) -> pa.Table:
        t, x, first = _segments(t, key, date, value, descending)
        starts = np.unique(first)
        ends = np.append(starts[1:], len(t)) - 1
        steps = rule.steps(x, _shifted(x, first), np.zeros(len(x), bool))
        steps[starts] = _identity(size, rule.product)  # a first row's step waits for the row before
        whole = composed(steps, first, rule.product)[ends]
        return pa.table({"key": t.column(key).take(pa.array(starts)), "_range": t.column("_range").take(pa.array(starts)), "first": x[starts], "last": x[ends], "m": pa.array(list(whole.reshape(len(ends), -1)), pa.list_(pa.float64()))})

    def entered(t: pa.Table) -> pa.Table:
        t, _, first = _segments(t, "key", "_range", "first", False)
        size_of, begins = len(t), first == np.arange(len(t))
        m = t.column("m").combine_chunks().flatten().to_numpy().reshape(size_of, size, size)
        x, last = t.column("first").to_numpy(), t.column("last").to_numpy()
        states, befores = np.tile(rule.start, (size_of, 1)), np.full(size_of, np.nan)
        for i in np.flatnonzero(~begins):  # most series are in one range, and enter it as they start
            own = rule.steps(x[i - 1 : i], befores[i - 1 : i], begins[i - 1 : i])[0]
            states[i], befores[i] = rule.product(m[i - 1], rule.product(own, states[i - 1][:, None]))[:, 0], last[i - 1]
        return pa.table({"key": t.column("key"), "_range": t.column("_range"), "fresh": begins, "before": befores, "state": pa.array(list(states), pa.list_(pa.float64()))})

    def filled(t: pa.Table, into: pa.Table) -> pa.Table:
        t, x, first = _segments(t, key, date, value, descending)
        into = into.sort_by("key")  # one for each series of the range, in the same order
        starts, which = np.unique(first, return_inverse=True)
        before, fresh = _shifted(x, first), np.zeros(len(x), bool)
        before[starts], fresh[starts] = into.column("before").to_numpy(), into.column("fresh").to_numpy()
        entering = np.array(into.column("state").to_pylist(), "f8").reshape(-1, size)[which]
        states = rule.product(composed(rule.steps(x, before, fresh), first, rule.product), entering[:, :, None])[:, :, 0]
        out = rule.outputs(states, x)
        return pa.Table.from_arrays([*(t.column(c) for c in names), *(pa.array(out[c]) for c in rule.made)], names=[*names, *rule.made])

    parts = rows.select(key, date, value, "_range").groupBy("_range").applyInArrow(summed, f"key {kind}, _range int, first double, last double, m array<double>")
    # series go many to a group, as most have one row there
    into = parts.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(many))).groupBy("_b").applyInArrow(entered, f"key {kind}, _range int, fresh boolean, before double, state array<double>")
    return rows.groupBy("_range").cogroup(into.groupBy("_range")).applyInArrow(filled, f"{fields}, {made}")


def _identity(size: int, product) -> np.ndarray:
    return np.eye(size) if product is times else np.where(np.eye(size) > 0, 0.0, -np.inf)
