"""Greedy picks with a pause and a daily cap, day by day side by side.

An event counts if it comes ``gap`` after the last one that counted, or later, and its day has
room. What a day does to the time of the last pick is a step function: only where the first
pick of the day falls depends on what came before, and that within one ``gap`` of midnight.
Each day gives its function (pointers to the next admissible event, followed for all possible
first picks at once), the functions of a key are composed in order, a row a day, and each
day then makes its picks from the time that it begins with.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.sequential import ordered_scan
from quernstone.sources.store import written

DAY = 86_400_000_000


def day_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key (a key of one day) of sorted batches, as a table."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]))
        start = 0
        for i, name in enumerate(names):
            if name != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield key, pa.Table.from_batches(held)
                held, key, start = [], name, i
        held.append(batch.slice(start))
    if held:
        yield key, pa.Table.from_batches(held)


def followed(t: np.ndarray, first: np.ndarray, gap: int, cap: int) -> np.ndarray:
    """The last pick of a day from each possible first one."""
    after = np.searchsorted(t, t + gap)
    at = first
    for _ in range(cap - 1):
        further = after[at]
        at = np.where(further < len(t), further, at)
    return at


def step_function(t: np.ndarray, day: int, gap: int, cap: int) -> tuple[list[int], list[int]]:
    """(bounds, ends): if the day's first pick may come from a time up to bounds[i] on (and beyond the bound before), its last comes at ends[i]."""
    first = np.arange(min(np.searchsorted(t, day * DAY + gap) + 1, len(t)))
    ends = t[followed(t, first, gap, cap)]
    bounds = t[first]
    # equal times are reached by one bound, and neighbours with the same end are one step
    keep = np.concatenate([(ends[1:] != ends[:-1]) & (bounds[1:] != bounds[:-1]), [True]])
    return bounds[keep].tolist(), ends[keep].tolist()


class Days:
    """What each day of a key begins with: the time of the last pick before it."""

    def __init__(self, gap: int):
        self.gap, self.last = gap, None

    def push(self, row: tuple) -> list[tuple]:
        day, bounds, ends = row
        out = (day, self.last)
        i = 0 if self.last is None else bisect_left(bounds, self.last + self.gap)
        if i < len(ends):
            self.last = ends[i]
        return [out]

    def close(self) -> list[tuple]:
        return []


def picked(events: DataFrame, keys: list[str], micros: str, order: str, gap_seconds: int, cap: int) -> DataFrame:
    """(keys, ``micros``, ``order``): the events that count. ``micros`` is a time in microseconds; ``order`` (a long) breaks its ties.

    A task holds the times of one key's day. The first event of a key always counts; nulls in
    ``micros`` or ``order`` never do.
    """
    gap = gap_seconds * 1_000_000
    some = events.select(*keys, F.col(micros).alias("_t"), F.col(order).alias("_o"), F.floor(F.col(micros) / DAY).cast("long").alias("_day")).where("_t IS NOT NULL AND _o IS NOT NULL")
    some = written(some, "events")  # read for the functions and for the picks
    types = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    own = [*keys, "_day"]

    def by_day(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
        return rows.repartition(*own).sortWithinPartitions(*own, "_t", "_o").mapInArrow(run, schema)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in day_groups(batches, own):
            bounds, ends = step_function(rows.column("_t").to_numpy(), key[-1], gap, cap)
            told = [[x] for x in (*key, bounds, ends)]
            kinds = [*[rows.schema.field(k).type for k in own], pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(told, kinds)], [*own, "bounds", "ends"])

    steps = by_day(some, functions, f"{types}, _day long, bounds array<long>, ends array<long>")
    begins = ordered_scan(steps, keys, ["_day"], ["_day", "bounds", "ends"], lambda key: Days(gap), "_day long, _last long")

    def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in day_groups(batches, own):
            t, last = rows.column("_t").to_numpy(), rows.column("_last")[0].as_py()
            at = 0 if last is None else int(np.searchsorted(t, last + gap))
            found = []
            while at < len(t) and len(found) < cap:
                found.append(at)
                at = int(np.searchsorted(t, t[at] + gap))
            yield from rows.take(pa.array(found, pa.int64())).select([*keys, "_t", "_o"]).to_batches()

    same: Column = F.lit(True)
    for k in own:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = some.alias("a").join(begins.alias("b"), same).select("a.*", "b._last")
    return by_day(both, picks, f"{types}, _t long, _o long").withColumnsRenamed({"_t": micros, "_o": order})
