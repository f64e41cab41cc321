"""Most frequent items of a column, in bounded memory: conservative count-min sketches and heaps.

Values are combined within Arrow batches, hash-partitioned by value, and each partition keeps a
count-min sketch with conservative update and a bounded heap of heavy candidates. As every value
lives in one partition, the heaps are disjoint and merge by union. A last pass counts the few
candidates exactly, so hash collisions and overestimates can't enter the result.

Defined cases: null items don't count; an empty table gives no rows; ties at the threshold are all
kept; columns of the input other than the two named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.tables import Stage

_PARTIAL = "field int, h bigint, c bigint"
_HEAP = "field int, h bigint, est bigint, total bigint"


class ConservativeSketch:
    """Count-min with conservative update over 64-bit values.

    A batch of distinct values is added at once: each value's cells rise to its estimate plus its count, and
    values that share a cell within the batch leave the larger of both. Every cell stays at or above the true
    count of every value in it.
    """

    def __init__(self, width: int = 1 << 16, depth: int = 4, seed: int = 0x9E3779B97F4A7C15):
        assert width & (width - 1) == 0, "the width is a power of two"
        self.table = np.zeros((depth, width), np.int64)
        self.shift = np.uint64(64 - int(math.log2(width)))
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 1 << 63, depth, dtype=np.uint64) | np.uint64(1)

    def cells(self, values: np.ndarray) -> list[np.ndarray]:
        v = values.view(np.uint64) if values.dtype == np.int64 else values.astype(np.uint64)
        v = v ^ (v >> np.uint64(31))
        return [((v * a) >> self.shift).astype(np.int64) for a in self.odd]

    def add(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds distinct values with their counts; returns the new estimates."""
        at = self.cells(values)
        new = np.min([row[i] for row, i in zip(self.table, at)], axis=0) + counts
        for row, i in zip(self.table, at):
            np.maximum.at(row, i, new)
        return new


class CandidateHeap:
    """The ``size`` values with the largest estimates seen; ``evicted`` is the largest estimate let go."""

    def __init__(self, size: int):
        self.size, self.evicted = size, 0
        self.values, self.estimates = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, values: np.ndarray, estimates: np.ndarray) -> None:
        keep = ~np.isin(self.values, values)
        v, e = np.concatenate([self.values[keep], values]), np.concatenate([self.estimates[keep], estimates])
        if len(v) > self.size:
            cut = np.argpartition(-e, self.size)
            self.evicted = max(self.evicted, int(e[cut[self.size :]].max()))
            v, e = v[cut[: self.size]], e[cut[: self.size]]
        self.values, self.estimates = v, e


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        field, h = b.column(0).to_numpy(), b.column(1).to_numpy()
        for f in np.unique(field):
            v, c = np.unique(h[field == f], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f, np.int32)), pa.array(v), pa.array(c)], ["field", "h", "c"])


def _sketch(heap: int, width: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[ConservativeSketch, CandidateHeap, list[int]]] = {}
        for b in batches:
            field, h, c = (b.column(i).to_numpy() for i in range(3))
            for f in np.unique(field).tolist():
                if f not in state:
                    state[f] = ConservativeSketch(width, depth), CandidateHeap(heap), [0]
                sketch, top, total = state[f]
                v, inverse = np.unique(h[field == f], return_inverse=True)
                n = np.bincount(inverse, c[field == f]).astype(np.int64)
                total[0] += int(n.sum())
                top.offer(v, sketch.add(v, n))
        for f, (_, top, total) in state.items():
            n = len(top.values)
            # the partition's total, and what its heap let go, travel in a row without a value
            out = [np.append(np.full(n, f), f).astype(np.int32), [*top.values.tolist(), None], [*top.estimates.tolist(), top.evicted], [*[0] * n, total[0]]]
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), *[pa.array(x, pa.int64()) for x in out[1:]]], ["field", "h", "est", "total"])

    return run


def heavy_items(items: DataFrame, fields: list[str], share: float, stage: Stage, field: str = "field_name", item: str = "item", heap: int | None = None, width: int = 1 << 16, depth: int = 4) -> DataFrame:
    """(field_name, item, n, est, total) of the named ``fields``: items that make up at least ``share`` of all values of their field.

    ``n`` is exact, ``est`` the sketch's estimate (never below n), ``total`` the field's number of values.
    At most 1/share items a field can be heavy; a heap starts at four times that and is doubled if it ever let
    go an estimate that reaches the threshold, so no heavy item can be lost.
    """
    heap = heap or math.ceil(4 / share)
    rows = items.where(F.col(item).isNotNull()).select(F.col(field).alias("field_name"), F.col(item).alias("item"))
    code = F.coalesce(*[F.when(F.col("field_name") == n, F.lit(i)) for i, n in enumerate(fields)])
    hashed = rows.where(F.col("field_name").isin(fields)).select(code.cast("int").alias("field"), F.xxhash64("item").alias("h"))
    while True:
        heaps = stage.put(hashed.mapInArrow(_combine, _PARTIAL).repartition("h").mapInArrow(_sketch(heap, width, depth), _HEAP))
        totals = {r.field: (r.total, r.evicted) for r in heaps.groupBy("field").agg(F.sum("total").alias("total"), F.max(F.when(F.col("h").isNull(), F.col("est"))).alias("evicted")).collect()}
        if all(evicted < share * total for total, evicted in totals.values()):
            break
        heap *= 2
        stage.drop(heaps)
    spark = items.sparkSession
    limits = spark.createDataFrame([(f, fields[f], n, math.ceil(share * n - 1e-9)) for f, (n, _) in totals.items()], "field int, field_name string, total bigint, least bigint")
    # at most 1/share heavy items a field, and those the sketch overrates: a heap's size at most
    candidates = heaps.where("h is not null").select("field", "h", "est").join(F.broadcast(limits), "field").where("est >= least").select("field_name", "h", "est", "total", "least")
    counted = rows.withColumn("h", F.xxhash64("item")).join(F.broadcast(candidates), ["field_name", "h"]).groupBy("field_name", "item", "h").agg(F.count("*").alias("n"), F.first("est").alias("est"), F.first("total").alias("total"), F.first("least").alias("least"))
    return counted.where("n >= least").select("field_name", "item", "n", "est", "total")
