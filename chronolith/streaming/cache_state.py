"""Steps of a stream that keep a cache: init, step and finalise, checked against what the key's steps did before.

A row is one step of a key: ``op`` (init, step or finalise), ``step`` (its number), and for op step an update of the
cache: ``mode`` (append or replace), ``kind``, ``names`` of its tensors, ``values`` (an array of numbers for each, along the
sequence axis) and ``times`` (one for each place of the sequence). A refused row changes nothing. Its ``reason`` is the first of

* ``unknown_op``: op is none of the three, or null;
* ``active`` / ``inactive``: an init while a run is open; a step or finalise while none is;
* ``step_not_above``: the step's number is null or not above the last accepted one of the run (that of its init at first);
* ``mode``, ``names``: a mode that is neither of both; names that are null, empty, or not distinct;
* ``lengths``: arrays of other lengths than ``times``, or missing ones;
* ``times``: times that are null or fall, within the update or after those kept;
* ``kind``, ``tensors``: an append whose kind or names aren't those of the cache.

``keep`` bounds the cache to its last places (None keeps all: then the state of a run grows with it). The batch form reads keys in
order, a row at a time; the stream keeps a value state (run, last step, kind, names) and a list state (times and values of each place) per key, so an
append writes only what it adds. Rows of one micro-batch are put in order before use; both forms give the same rows
when micro-batches come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the provider that lists in a state need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "op string, step long, reason string, run long, length long, total double"
COLUMNS = ("op", "step", "mode", "kind", "names", "values", "times")


class Steps:
    """The state of one key: run (0 before the first), whether it is open, its last step, and the cache's kind, names and places."""

    def __init__(self, run: int = 0, active: bool = False, last: int | None = None, kind: str | None = None, names: tuple[str, ...] | None = None, places: list[tuple[float, list[float]]] | None = None):
        self.run, self.active, self.last, self.kind, self.names = run, active, last, kind, names
        self.places = places or []
        self.added: list[tuple[float, list[float]]] | None = None  # since the state was written; None: all of it changed

    def refuse(self, op, step, mode, kind, names, values, times) -> str | None:
        if op not in ("init", "step", "finalise"):
            return "unknown_op"
        if (op == "init") == self.active:
            return "active" if self.active else "inactive"
        if op == "finalise":
            return None
        if step is None or op == "step" and step <= self.last:
            return "step_not_above"
        if op == "init":
            return None
        if mode not in ("append", "replace"):
            return "mode"
        if not names or None in names or len(set(names)) < len(names):
            return "names"
        if times is None or values is None or len(values) != len(names) or any(v is None or len(v) != len(times) for v in values):
            return "lengths"
        joins = mode == "append" and self.names is not None
        before = [self.places[-1][0]] if joins and self.places else []
        if any(t is None for t in times) or any(b < a for a, b in zip([*before, *times], times if before else times[1:])):
            return "times"
        if joins and kind != self.kind:
            return "kind"
        return "tensors" if joins and tuple(sorted(names)) != self.names else None

    def push(self, op, step, mode, kind, names, values, times, keep: int | None) -> str | None:
        """The reason why a row is refused, or None after it was taken."""
        reason = self.refuse(op, step, mode, kind, names, values, times)
        if reason is not None:
            return reason
        if op == "init":
            self.run, self.active, self.last, self.kind, self.names, self.places, self.added = self.run + 1, True, step, None, None, [], None
        elif op == "finalise":
            self.active = False
        else:
            order = sorted(range(len(names)), key=lambda i: names[i])
            new = [(float(t), [float(values[i][k]) for i in order]) for k, t in enumerate(times)]
            if mode == "replace" or self.names is None:
                self.kind, self.names, self.places, self.added = kind, tuple(sorted(names)), [], None
            self.places += new
            if self.added is not None:
                self.added += new
            if keep is not None and len(self.places) > keep:
                self.places, self.added = self.places[-keep:], None
            self.last = step
        return None

    def result(self, op, step, reason: str | None) -> tuple:
        return op, step, reason, self.run, len(self.places), float(sum(sum(v) for _, v in self.places))


def _plain(x):
    """A value from pandas with arrays as lists and missing numbers as None."""
    if isinstance(x, np.ndarray):
        items = x.tolist()
        return [_plain(v) for v in items] if x.dtype == object else [None if v != v else v for v in items]
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if hasattr(x, "tolist") and not isinstance(x, (int, float, str)):
        x = x.tolist()
    return None if x is None or x is pd.NA or x != x else x


def _given(part: pd.DataFrame) -> Iterator[tuple]:
    """The values of ``COLUMNS``, row by row; each column is taken out of pandas at once."""
    columns = [[_plain(x) for x in part[c].tolist()] for c in COLUMNS]
    at = COLUMNS.index("step")
    columns[at] = [None if x is None else int(x) for x in columns[at]]
    return zip(*columns)


def _in_order(part: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    """``part`` in order, nulls last; rows that are in order already stay as they are."""
    keys = [part[c].to_numpy() for c in reversed(order)]
    if any(k.dtype == object for k in keys):
        return part.sort_values(order, kind="stable")
    at = np.lexsort(keys)
    return part if (at[1:] > at[:-1]).all() else part.take(at)


def _slim(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.select(F.col(key).alias("__key"), F.struct(*order).alias("__order"), *[F.col(c) for c in order], *[F.col(c).cast("long") if c == "step" else F.col(c) for c in COLUMNS])


def _schema(rows: DataFrame, key: str, order: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([f"`{key}` {kinds[key]}", *[f"`{c}` {kinds[c]}" for c in order], RESULT])


def follow(rows: DataFrame, key: str, order: list[str], keep: int | None = None) -> DataFrame:
    """key, order, op, step, reason (null: accepted), run, length and total (of all values) of the cache after each row.

    Null keys are a key. A key's rows go to one task and are read one at a time in ``order``.
    """
    placed = _slim(rows, key, order).repartition("__key").sortWithinPartitions("__key", *order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), Steps()
        for part in parts:
            out, keys, places = [], part["__key"].tolist(), zip(*[part[c] for c in order])
            for k, place, given in zip(keys, places, _given(part)):
                k = _plain(k)
                if k != current:
                    current, state = k, Steps()
                reason = state.push(*given, keep)
                out.append((k, *place, *state.result(given[0], given[1], reason)))
            yield pd.DataFrame(out, columns=[key, *order, "op", "step", "reason", "run", "length", "total"])

    return placed.drop("__order").mapInPandas(run, _schema(rows, key, order))


class Follower(StatefulProcessor):
    def __init__(self, key: str, order: list[str], keep: int | None):
        self.key, self.order, self.keep = key, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "run long, active boolean, last long, kind string, names array<string>, length long, total double, latest double")
        self.places = handle.getListState("places", "time double, vals array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = self.head.get()
        state = Steps()
        if got is not None:
            run, active, last, kind, names, *_ = got
            state = Steps(run, active, last, kind, None if names is None else tuple(names), [(t, list(v)) for t, v in self.places.get()])
        state.added = []
        parts = list(rows)
        part = _in_order(parts[0] if len(parts) == 1 else pd.concat(parts), self.order)
        out = [state.result(given[0], given[1], state.push(*given, self.keep)) for given in _given(part)]
        total = float(sum(sum(v) for _, v in state.places))
        self.head.update((state.run, state.active, state.last, state.kind, None if state.names is None else list(state.names), len(state.places), total, state.places[-1][0] if state.places else None))
        if state.added is None:
            if state.places:
                self.places.put(state.places)
            else:
                self.places.clear()
        elif state.added:
            self.places.appendList(state.added)
        columns = dict(zip(("op", "step", "reason", "run", "length", "total"), map(list, zip(*out))))
        yield pd.DataFrame({self.key: [key[0]] * len(out), **{c: part[c].to_numpy() for c in self.order}, **columns})

    def close(self) -> None:
        pass


def follow_stream(rows: DataFrame, key: str, order: list[str], keep: int | None = None) -> DataFrame:
    """``follow`` for a streaming frame; the session needs the state store ``ROCKS`` while the stream runs."""
    slim = _slim(rows, key, order).drop("__order")
    return slim.groupBy("__key").transformWithStateInPandas(statefulProcessor=Follower(key, order, keep), outputStructType=_schema(rows, key, order), outputMode="Append", timeMode="None")


def accepted(followed: DataFrame) -> DataFrame:
    return followed.filter(F.col("reason").isNull()).drop("reason")


def refused(followed: DataFrame) -> DataFrame:
    return followed.filter(F.col("reason").isNotNull())
