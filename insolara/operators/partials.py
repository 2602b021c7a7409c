"""Sums of numpy arrays over partitions.

A task folds its Arrow batches into one array per key; Spark adds the arrays
element by element. What reaches the driver has the size of the model, not of
the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

Batches = Iterator[pa.RecordBatch]
Task = Callable[[Batches], Iterator[tuple[int, np.ndarray]]]

_SCHEMA = "key int, slot int, part array<double>"
FAN = 512


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """An array column as an (n, width) matrix."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(-1, width)


def vector(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(batch.column(column).to_numpy(zero_copy_only=False), dtype=np.float64)


def partial_rows(df: DataFrame, task: Task) -> DataFrame:
    def run(batches: Batches) -> Batches:
        slot = TaskContext.get().partitionId() // FAN
        keys, parts = [], []
        for key, part in task(batches):
            keys.append(key)
            parts.append(np.asarray(part, dtype=np.float64))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([slot] * len(keys), pa.int32()),
                 pa.array(parts, pa.list_(pa.float64()))], names=["key", "slot", "part"])

    return df.mapInArrow(run, _SCHEMA)


def _total(parts: np.ndarray) -> np.ndarray:
    return parts.sum(axis=0)


def combined(df: DataFrame, task: Task, merge: Callable[[np.ndarray], np.ndarray], few: bool = False
             ) -> dict[int, np.ndarray]:
    """Run ``task`` on every partition and merge the arrays per key; ``merge`` takes them stacked, in any grouping.

    One row per task and key is shuffled, whatever the length of the arrays. FAN of them are merged in
    one task, and the driver merges what is left: one array per key and FAN partitions. With ``few`` arrays
    per key (the caller knows a bound) the driver merges all of them.
    """
    def grouped(group: pa.Table) -> pa.Table:
        parts = group.column("part").combine_chunks()
        whole = merge(parts.flatten().to_numpy(zero_copy_only=False).reshape(len(parts), -1))
        return group.slice(0, 1).set_column(2, "part", pa.array([whole], pa.list_(pa.float64())))

    parts = partial_rows(df, task)
    rows = (parts if few else parts.groupBy("key", "slot").applyInArrow(grouped, _SCHEMA)).collect()
    out: dict[int, list[np.ndarray]] = {}
    for row in sorted(rows, key=lambda r: (r["key"], r["slot"])):
        out.setdefault(row["key"], []).append(np.array(row["part"]))
    return {key: merge(np.stack(found)) if len(found) > 1 else found[0] for key, found in out.items()}


def summed(df: DataFrame, task: Task, few: bool = False) -> dict[int, np.ndarray]:
    """:func:`combined` by adding up."""
    return combined(df, task, _total, few)
