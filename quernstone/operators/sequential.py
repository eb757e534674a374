"""Ordered scans: what only a walk along a series can compute, with bounded memory.

Rows are dealt to tasks by key and sorted inside them, then streamed in Arrow batches. A
kernel keeps a small state from row to row and starts anew with each key, so a task
never holds a series, only a batch of it. Scale comes from the number of keys: series,
and whatever multiplies them (parameter cells, folds, simulations). Values stay what they
are: whole numbers keep all their digits beside a null, and a null key is a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


NAN = float("nan")


class Kernel(Protocol):
    """State of one series."""

    def push(self, row: tuple) -> list[tuple]:
        """Output rows that this input row brings about."""

    def close(self) -> list[tuple]:
        """Output rows at the end of the series."""


def read(column: pa.Array) -> list:
    """A column's values; kernels see a missing double as NaN, and all else that is missing as None."""
    found = column.to_pylist()
    return [NAN if x is None else x for x in found] if pa.types.is_floating(column.type) and column.null_count else found


def values(found: tuple, kind: pa.DataType) -> pa.Array:
    """Values of a kernel as a column; NaN is missing, and times of a kernel carry no zone."""
    if pa.types.is_floating(kind):
        return pa.array([None if x is None or x != x else float(x) for x in found], type=kind)
    if pa.types.is_integer(kind):
        return pa.array([None if x is None or x != x else int(x) for x in found], type=kind)
    return pa.array(found, type=kind)


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], columns: list[str], kernel: Callable[[tuple], Kernel], schema: str) -> DataFrame:
    """Run ``kernel(key)`` over each series: its ``columns``, in order; output rows are prefixed with the key.

    ``schema`` describes what the kernel gives. Series without rows give none.
    """
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    full = f"{key_schema}, {schema}"
    out_schema = to_arrow_schema(T._parse_datatype_string(full))
    n = len(keys)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows)] if rows else [()] * len(out_schema)
        return pa.RecordBatch.from_arrays([values(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            lists = [read(batch.column(batch.schema.get_field_index(c))) for c in [*keys, *columns]]
            for row in zip(*lists):
                if state is None or row[:n] != key:
                    if state is not None:
                        out += [(*key, *x) for x in state.close()]
                    key = row[:n]
                    state = kernel(key)
                out += [(*key, *x) for x in state.push(row[n:])]
            yield told(out)
        if state is not None:
            yield told([(*key, *x) for x in state.close()])

    used = list(dict.fromkeys([*keys, *order, *columns]))
    dealt = df.select(*used).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, full)


def null_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN to null: pandas can't tell them apart, Spark orders NaN above all numbers."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
