"""Ordered scans over chunks of a series, side by side, for kernels whose walks meet.

A chunk needs the state that the one before it ends with. Here every chunk is first walked
from a new state, as if its series began there, and only the state at its end is kept. Then
each chunk is walked again from the end of its predecessor. Where that ends in the same state
as the first walk did, the two walks have met inside the chunk, and what follows is right;
chunks behind one that ended otherwise are walked again from its new end, until no end
changes. The first chunk of a series begins rightly, so each round is right for one more chunk
at least, and stop-and-reverse rules and latches meet within a few turns: one or two rounds
do, whatever the number of chunks. Output comes from a last walk.

Ends are one row a chunk and stay in tables; the driver sees how many have changed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernstone.operators.affine import cut
from quernstone.operators.sequential import Kernel, read, values
from quernstone.sources.store import written

CHUNK = ["_bucket", "_chunk"]
#: Rows of a chunk that is walked: a fraction of a second, and long enough for most walks to meet in.
LONG = 65_536


def long_chunks(df: DataFrame, keys: tuple[str, ...], ts: str = "ts") -> DataFrame:
    """``df`` cut into chunks of ``LONG`` rows, by the numbers of a series' rows."""
    numbered = cut(df, keys, ts, (ts,)).drop(f"_before_{ts}")
    return numbered.withColumns({"_bucket": F.lit(0).cast("long"), "_chunk": F.floor((F.col("_number") - 1) / LONG).cast("int")}).drop("_number")


def told(state: object) -> object:
    """A state as nested tuples, so that equal states are told alike."""
    if hasattr(state, "__dict__"):
        return tuple((k, told(v)) for k, v in sorted(vars(state).items()))
    return tuple(told(v) for v in state) if isinstance(state, list | tuple) else state


def walk(dealt: DataFrame, keys: list[str], columns: list[str], kernel: Callable[[tuple], Kernel], schema: str | None) -> DataFrame:
    """Walk each chunk from ``_begin``, which is called ``_from`` (null: a new state). With a ``schema`` the kernel's rows, without one the state at the end."""
    key_schema = ", ".join(f"`{k}` {dealt.schema[k].dataType.simpleString()}" for k in [*keys, *CHUNK])
    full = f"{key_schema}, {schema or '_end binary, _told string, _with string'}"
    out_schema = to_arrow_schema(T._parse_datatype_string(full))
    n = len(keys) + len(CHUNK)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        parts = [*zip(*rows)] if rows else [()] * len(out_schema)
        return pa.RecordBatch.from_arrays([values(c, f.type) for c, f in zip(parts, out_schema)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, name = None, None, None
        end = lambda: [(*key, pickle.dumps(state), repr(told(state)), name or "")]
        for batch in batches:
            out: list[tuple] = []
            lists = [read(batch.column(batch.schema.get_field_index(c))) for c in [*keys, *CHUNK, "_begin", "_from", *columns]]
            for row in zip(*lists):
                if row[:n] != key:
                    if key is not None and schema is None:
                        out += end()
                    key, name = row[:n], row[n + 1]
                    state = kernel(key[: len(keys)]) if row[n] is None else pickle.loads(row[n])
                made = state.push(row[n + 2 :])
                if schema is not None:
                    out += [(*key, *x) for x in made]
            yield batch_of(out)
        if key is not None and schema is None:
            yield batch_of(end())

    return dealt.mapInArrow(run, full)


def speculative_scan(rows: DataFrame, keys: list[str], ts: str, columns: list[str], kernel: Callable[[tuple], Kernel], schema: str, most_rounds: int = 1_000) -> DataFrame:
    """``kernel`` over each series of rows from ``long_chunks`` or ``affine.cut``; output rows are prefixed with the keys.

    The kernel must be picklable, and its attributes plain values, lists or objects of such.
    It must give all its rows in ``push``. Raises if walks have not met after ``most_rounds``.
    """
    used = list(dict.fromkeys([*keys, *CHUNK, ts, *columns]))
    rows = written(rows.select(*used), "chunks")  # read in each round

    new = [F.lit(None).cast("binary").alias("_begin"), F.lit(None).cast("string").alias("_from")]

    def dealt(begins: DataFrame | None) -> DataFrame:
        some = rows.select("*", *new) if begins is None else rows.join(begins.select(*keys, *CHUNK, "_begin", "_from"), [*keys, *CHUNK])
        return some.repartition(*keys, *CHUNK).sortWithinPartitions(*keys, *CHUNK, ts)

    order = Window.partitionBy(*keys).orderBy(*CHUNK)
    ends = written(walk(dealt(None), keys, columns, kernel, None), "ends")
    for _ in range(most_rounds):
        # beside each chunk's end and what it was walked from (``_with``), what its predecessor ends with now
        begins = ends.withColumns({"_begin": F.lag("_end").over(order), "_from": F.lag("_told").over(order)})
        changed = begins.where(F.col("_from").isNotNull() & (F.col("_from") != F.col("_with")))
        if changed.isEmpty():
            return walk(dealt(begins), keys, columns, kernel, schema).drop(*CHUNK)
        again = walk(dealt(changed), keys, columns, kernel, None)
        ends = written(ends.join(changed.select(*keys, *CHUNK), [*keys, *CHUNK], "left_anti").unionByName(again), "ends")
    raise RuntimeError(f"walks have not met after {most_rounds} rounds")
