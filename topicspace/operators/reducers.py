"""Grouped vector reducers that are no Column aggregate: any function that can be
started, fed vectors, merged and finished.

Every task feeds the vectors of each group it meets into one state, so a group that
holds a third of all rows sends one state for each task; the states of a group are merged
as they stream by, in a fixed order."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from topicspace.session import shared_dir


class Reducer:
    """A mergeable reducer of vectors. A state must stay small whatever it is fed."""

    def init(self) -> Any:
        raise NotImplementedError

    def update(self, state: Any, vectors: np.ndarray, key: Any) -> Any:
        """``state`` with the rows of a matrix fed in."""
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> np.ndarray:
        raise NotImplementedError


class Midrange(Reducer):
    """The middle between the smallest and the largest value of each dimension."""

    def init(self):
        return None

    def update(self, state, vectors, key):
        own = (vectors.min(axis=0), vectors.max(axis=0))
        return own if state is None else self.merge(state, own)

    def merge(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        return np.minimum(a[0], b[0]), np.maximum(a[1], b[1])

    def finish(self, state):
        return (state[0] + state[1]) / 2


class WeiszfeldStep(Reducer):
    """One step towards the geometric median: the mean with weights 1 / distance to the
    group's present center. Each row holds the center and then the vector; a vector at the
    center itself is passed over."""

    def init(self):
        return 0.0, 0.0, None

    def update(self, state, vectors, key):
        half = vectors.shape[1] // 2
        center, own = vectors[0, :half], vectors[:, half:]
        d = np.sqrt(((own - center) ** 2).sum(axis=1))
        w = np.divide(1.0, d, out=np.zeros(len(d)), where=d > 0)
        return self.merge(state, (w @ own, float(w.sum()), center))

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1], a[2] if b[2] is None else b[2]

    def finish(self, state):
        return state[0] / state[1] if state[1] else state[2]


def _partial_task(key: str, vec: str, reducer: Reducer, max_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[Any, Any] = {}

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(list(states), kind), pa.array([part] * len(states), pa.int32()),
                pa.array([pickle.dumps(s) for s in states.values()], pa.binary())],
                names=[key, "part", "state"])

        part, kind = TaskContext.get().partitionId(), None
        for batch in batches:
            kind = batch.column(key).type
            groups: dict[Any, list] = {}
            for k, v in zip(batch.column(key).to_pylist(), batch.column(vec).to_pylist()):
                if v is not None:
                    groups.setdefault(k, []).append(v)
            for k, own in groups.items():
                state = states[k] if k in states else reducer.init()
                states[k] = reducer.update(state, np.array(own, dtype=np.float64), k)
            if len(states) > max_groups:
                yield give()
                states.clear()
        if states:
            yield give()

    return run


def _merge_task(key: str, out: str, reducer: Reducer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, kind, seen = None, None, None, False
        for batch in batches:
            kind, keys, values = batch.column(key).type, [], []
            for k, raw in zip(batch.column(key).to_pylist(), batch.column("state").to_pylist()):
                if seen and k != last:
                    keys.append(last)
                    values.append(reducer.finish(state).tolist())
                    state = None
                own = pickle.loads(raw)
                state = own if state is None else reducer.merge(state, own)
                last, seen = k, True
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(
                values, pa.list_(pa.float64()))], names=[key, out])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array(
                [reducer.finish(state).tolist()], pa.list_(pa.float64()))], names=[key, out])

    return run


def reduce_vectors(df: DataFrame, key: str, vec: str, reducer: Reducer, out: str = "vec",
                   max_groups: int = 1 << 14) -> DataFrame:
    """``(key, out array<double>)``: the reducer's result for the vectors of each group.
    Null vectors are passed over; a group with no other has no row. A task gives on its
    states when it holds more than ``max_groups``."""
    rows = df.select(key, F.col(vec).cast("array<double>").alias(vec))
    own = rows.schema[key]
    kind = own.dataType.simpleString()
    partial = rows.mapInArrow(_partial_task(key, vec, reducer, max_groups),
                              f"`{key}` {kind}, part int, state binary")
    # states are pickled by the tasks of this very job and read by its next stage only
    met = partial.repartition(key).sortWithinPartitions(key, "part")
    schema = StructType([StructField(key, own.dataType), StructField(out, ArrayType(DoubleType()))])
    return met.mapInArrow(_merge_task(key, out, reducer), schema)


def geometric_medians(df: DataFrame, key: str, vec: str, steps: int = 10,
                      out: str = "vec") -> DataFrame:
    """``(key, out)``: the point with the smallest summed distance to the vectors of each
    group, by ``steps`` Weiszfeld steps from their mean. Between the steps the centers,
    one vector for each group, are checkpointed and joined back to the rows by the next
    one."""
    from topicspace.operators.vectors import vector_sum

    spark = df.sparkSession
    shared_dir(spark)
    centers = vector_sum(df.select(key, vec), key, vec, how="mean", out="_center")
    for _ in range(steps):
        centers = centers.where(F.col("_center").isNotNull()).checkpoint(eager=True)
        carried = df.select(key, vec).join(centers, key).select(
            key, F.concat("_center", F.col(vec).cast("array<double>")).alias("_cv"))
        centers = reduce_vectors(carried, key, "_cv", WeiszfeldStep(), out="_center")
    return centers.withColumnRenamed("_center", out)
