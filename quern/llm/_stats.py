"""Corpus statistics of a fixed size: every task fills one dense table, the tables are added in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 14
#: Tables added under one key of the first level, whatever the number of tasks.
FAN_IN = 256
_KINDS = tuple(np.dtype(t) for t in ("<u1", "<u2", "<u4", "<i8"))
_PART = "at int, part int, kind int, data binary"


def _packed(at: list[int], part: list[int], tables: list[np.ndarray]) -> pa.RecordBatch:
    """Chunks of counts, each in the narrowest type that holds it exactly."""
    kind, data = [], []
    for t in tables:
        k = next(k for k, d in enumerate(_KINDS) if int(t.max()) <= np.iinfo(d).max)
        kind.append(k)
        data.append(t.astype(_KINDS[k]).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["at", "part", "kind", "data"])


def add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chunks of equal (at, part) as they stream by; held are only the sums of the keys of this task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for at, part, kind, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
            values = np.frombuffer(data, dtype=_KINDS[kind])
            if (at, part) in sums:
                sums[at, part] += values
            else:
                sums[at, part] = values.astype(np.int64)
    for (at, part), total in sums.items():
        yield _packed([at], [part], [total])


def added(parts: DataFrame) -> DataFrame:
    """One row for each `at` of partial tables `parts(at, part, kind, data)`: first by groups of FAN_IN parts, then all."""
    near = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
    one = near.repartition("at", "part").mapInArrow(add_parts, _PART)
    return one.withColumn("part", F.lit(0)).repartition("at").mapInArrow(add_parts, _PART)


def summed_table(df: DataFrame, fill: Callable[[pa.RecordBatch, np.ndarray], None], length: int) -> np.ndarray:
    """Sum over all rows of `df` of what `fill(batch, table)` adds to an int64 table of `length`.

    Each task sends its table once, in chunks; chunks of only zeros are left out. No task
    gathers more than one chunk at a time beside its sums. The result has a fixed size and
    is the only thing collected.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(length, dtype=np.int64)
        for batch in batches:
            fill(batch, counts)
        at = [k for k in range(0, length, CHUNK) if counts[k : k + CHUNK].any()]
        yield _packed(at, [TaskContext.get().partitionId()] * len(at), [counts[k : k + CHUNK] for k in at])

    out = np.zeros(length, dtype=np.int64)
    for at, _, kind, data in added(df.mapInArrow(partial, _PART)).collect():
        values = np.frombuffer(bytes(data), dtype=_KINDS[kind])
        out[at : at + len(values)] += values
    return out
