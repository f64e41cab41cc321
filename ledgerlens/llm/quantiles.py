"""Percentiles of very large numeric columns from dyadic count-sketches.

A non-negative double is encoded by its leading 24 bits (sign, exponent, 12 of the mantissa), which keeps
its order. For each of the 24 binary resolutions of the codes a group keeps a signed sketch (exact counters
where a resolution has no more nodes than the sketch is wide). Sketches are added to combine parts and
subtracted to delete; a rank is the sum over the dyadic nodes left of a code, and a percentile descends the
levels. Values within a relative 2^-12 of each other share a code.

Rank error: with a width of 2,048 the levels of sign and exponent but the last are exact, and a finer level of m occupied nodes errs by about
n / sqrt(m * width) where a row's node collides. A count is the median of ``depth`` independent rows, so it errs only where most
rows collide; their spread around it is the sketch's own measure of its error, see ``rank_with_deviation``.

A part with few codes is kept as the list of its codes and counts and becomes counters where that is smaller. A task keeps one
running part per group, at most ``held`` counters in all, and only parts are shuffled; a group's parts are added in two steps, by a
salt and then in all, one at a time.

Nulls, NaN and negative values don't count; infinite values are the largest ones. A group without values has no sketch. Extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.tables import Stage

BITS = 24
WIDTH, DEPTH = 2048, 5
_SCHEMA = "{group} {kind}, field_name string, n bigint, sketch binary"


def encode(values: np.ndarray) -> np.ndarray:
    """Order-keeping codes of non-negative doubles, below 2^24."""
    return (np.asarray(values, np.float64) + 0.0).view(np.int64) >> 39


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of the codes' values."""
    c = np.asarray(codes, np.int64)
    low, high = (c << 39).view(np.float64), ((c + 1) << 39).view(np.float64)
    return np.where(np.isfinite(high) & (c > 0), low / 2 + high / 2, low)


class DyadicSketch:
    """One group's sketch; ``counters`` is flat: exact levels first (coarse to fine), then depth x width for each finer level."""

    def __init__(self, width: int = WIDTH, depth: int = DEPTH, counters: np.ndarray | None = None):
        assert width & (width - 1) == 0
        self.width, self.depth = width, depth
        self.exact = width.bit_length() - 1  # levels of 2, 4, ... width nodes
        self.size = 2 * width - 2 + (BITS - self.exact) * depth * width
        self.counters = np.zeros(self.size, np.int64) if counters is None else counters
        rng = np.random.default_rng(7)
        self.a = rng.integers(1, 1 << 62, (BITS + 1, depth), dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(1, 1 << 62, (BITS + 1, depth), dtype=np.uint64) | np.uint64(1)
        self.shift = np.uint64(64 - self.exact)

    def _place(self, level: int, row: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counter and sign of nodes at the level of 2^level nodes."""
        x = nodes.astype(np.uint64) + np.uint64(1)
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        at = ((x * self.a[level, row]) >> self.shift).astype(np.int64)
        sign = 1 - 2 * (((x * self.b[level, row]) >> np.uint64(63)).astype(np.int64))
        return 2 * self.width - 2 + ((level - self.exact - 1) * self.depth + row) * self.width + at, sign

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Adds codes with counts; negative counts delete."""
        order = np.argsort(codes, kind="stable")
        nodes, weight = codes[order], counts[order]
        for level in range(BITS, 0, -1):
            first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]])) if len(nodes) else np.empty(0, np.int64)
            nodes, weight = nodes[first], np.add.reduceat(weight, first) if len(first) else weight
            if level <= self.exact:
                self.counters[(1 << level) - 2 + nodes] += weight
            else:
                for row in range(self.depth):
                    at, sign = self._place(level, row, nodes)
                    np.add.at(self.counters, at, sign * weight)
            nodes = nodes >> 1

    def rows(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Counts of nodes at a level as each row of the sketch has them; one row where the level is exact."""
        if level == 0:
            return np.full((1, len(nodes)), self.n, np.float64)
        if level <= self.exact:
            return self.counters[None, (1 << level) - 2 + nodes].astype(np.float64)
        each = []
        for row in range(self.depth):
            at, sign = self._place(level, row, nodes)
            each.append(sign * self.counters[at])
        return np.array(each, np.float64)

    def estimate(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Estimated counts of nodes at a level."""
        return np.median(self.rows(level, nodes), axis=0)

    @property
    def n(self) -> int:
        return int(self.counters[:2].sum())

    def rank_with_deviation(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated number of values with a code below each of ``codes`` (which may be 2^24), and its standard deviation as the rows of
        the sketch show it: the sample variance of a node's rows over their number, added up over the nodes that make up the rank."""
        codes = np.asarray(codes, np.int64)
        total, variance = np.zeros(len(codes)), np.zeros(len(codes))
        for level in range(1, BITS + 1):
            node = codes >> (BITS - level)
            left = (node & 1 == 1) & (codes < 1 << BITS)
            if left.any():
                each = self.rows(level, node[left] - 1)
                total[left] += np.median(each, axis=0)
                if len(each) > 1:
                    variance[left] += each.var(axis=0, ddof=1) / len(each)
        return np.where(codes >= 1 << BITS, self.n, np.clip(total, 0, self.n)), np.sqrt(variance)

    def rank(self, codes: np.ndarray) -> np.ndarray:
        """Estimated number of values with a code below each of ``codes``."""
        return self.rank_with_deviation(codes)[0]

    def percentile(self, share: float) -> float:
        """The value at which the descent of the levels reaches ``share`` of the weight."""
        want, node = share * self.n, 0
        for level in range(1, BITS + 1):
            left = max(0.0, float(self.estimate(level, np.array([node << 1]))[0]))
            if want > left:
                want, node = want - left, (node << 1) | 1
            else:
                node <<= 1
        return float(decode(np.array([node]))[0])

    def blob(self) -> bytes:
        """The counters in the least of 2, 4 and 8 bytes that holds them, compressed, after a byte that says which."""
        most = int(np.abs(self.counters).max(initial=0))
        size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        return bytes([size]) + zlib.compress(self.counters.astype(f"<i{size}").tobytes(), 1)


class Part:
    """What is known of one group: codes and counts while they are few, else a sketch. ``add`` and ``merge`` keep no input."""

    def __init__(self, width: int = WIDTH, depth: int = DEPTH):
        self.shape, self.sketch, self.few = (width, depth), None, DyadicSketch(width, depth, np.empty(0, np.int64)).size // 4
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def held(self) -> int:
        return len(self.codes) * 2 if self.sketch is None else self.sketch.size

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        if self.sketch is None:
            self.codes, at = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            self.counts = np.bincount(at, np.concatenate([self.counts, counts]), len(self.codes)).astype(np.int64)
            if len(self.codes) <= self.few:
                return
            self.sketch, codes, counts = DyadicSketch(*self.shape), self.codes, self.counts
            self.codes = self.counts = np.empty(0, np.int64)
        self.sketch.add(codes, counts)

    def dense(self) -> DyadicSketch:
        if self.sketch is not None:
            return self.sketch
        out = DyadicSketch(*self.shape)
        out.add(self.codes, self.counts)
        return out

    def blob(self) -> bytes:
        if self.sketch is not None:
            return self.sketch.blob()
        return bytes([0]) + zlib.compress(np.concatenate([self.codes, self.counts]).astype("<i8").tobytes(), 1)

    def merge(self, blob: bytes) -> Part:
        body = zlib.decompress(blob[1:])
        if blob[0] == 0:
            pair = np.frombuffer(body, "<i8").reshape(2, -1)
            if pair.shape[1]:
                self.add(pair[0], pair[1])
            return self
        if self.sketch is None:
            self.sketch = self.dense()
            self.codes = self.counts = np.empty(0, np.int64)
        self.sketch.counters = self.sketch.counters + np.frombuffer(body, f"<i{blob[0]}")
        return self

    @classmethod
    def of(cls, blob: bytes, width: int = WIDTH, depth: int = DEPTH) -> Part:
        return cls(width, depth).merge(blob)


def _batch(rows: list[tuple], kind: pa.DataType, group: str) -> pa.RecordBatch:
    types = [kind, pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [group, "field_name", "n", "sketch"])


def _build(group: str, fields: list[str], width: int, depth: int, rows_at_once: int = 200_000, held: int = 16_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple, list] = {}
        kind = None

        def take(chunks: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(chunks)
            coded = t.column(0).combine_chunks().dictionary_encode()
            names = coded.dictionary.to_pylist()
            key = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for j, f in enumerate(fields):
                v = t.column(1 + j).to_numpy().astype(np.float64)
                ok = ~np.isnan(v) & (v >= 0)
                pair, count = np.unique((key[ok].astype(np.int64) << BITS) | encode(v[ok]), return_counts=True)
                k, code = pair >> BITS, pair & ((1 << BITS) - 1)
                cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
                for lo, hi in zip(cuts, [*cuts[1:], len(k)]):
                    own = parts.setdefault((None if k[lo] < 0 else names[int(k[lo])], f), [0, Part(width, depth)])
                    own[0] += int(count[lo:hi].sum())
                    own[1].add(code[lo:hi], count[lo:hi])

        def emit() -> Iterator[pa.RecordBatch]:
            rows = [(*k, n, p.blob()) for k, (n, p) in parts.items()]
            parts.clear()
            for i in range(0, len(rows), 64):
                yield _batch(rows[i : i + 64], kind, group)

        chunks, n = [], 0
        for b in batches:
            kind = b.schema.field(0).type
            chunks.append(b)
            n += b.num_rows
            if n >= rows_at_once:
                take(chunks)
                chunks, n = [], 0
                if sum(p.held for _, p in parts.values()) > held:  # very many groups: their parts go out and start anew
                    yield from emit()
        if n:
            take(chunks)
        if parts:
            yield from emit()

    return run


def build_sketches(df: DataFrame, group: str, fields: list[str], width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(group, field_name, n, sketch): a part of each group and field from each task. No row is shuffled."""
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(group, *[F.col(f).cast("double").alias(f) for f in fields])
    return rows.mapInArrow(_build(group, fields, width, depth), _SCHEMA.format(group=f"`{group}`", kind=kind))


def merge_sketches(parts: DataFrame, group: str, width: int = WIDTH, depth: int = DEPTH, salts: int = 16) -> DataFrame:
    """Adds the parts of each group and field, which may come from different tables, days or batches: first those of one salt,
    then the sums of the salts. A task holds one running part and reads the others one after another."""
    kind = parts.schema[group].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, own, key_type = None, 0, None, None
        for b in batches:
            key_type = b.schema.field(0).type
            for g, f, n, blob in zip(*(b.column(i) for i in range(4))):
                key = (g.as_py(), f.as_py())
                if own is not None and key != last:
                    yield _batch([(*last, total, own.blob())], key_type, group)
                    own = None
                if own is None:
                    last, total, own = key, 0, Part(width, depth)
                own.merge(blob.as_py())
                total += n.as_py()
        if own is not None:
            yield _batch([(*last, total, own.blob())], key_type, group)

    def step(df: DataFrame, *salt) -> DataFrame:
        placed = df.repartition(group, "field_name", *salt).sortWithinPartitions(group, "field_name")
        return placed.select(group, "field_name", "n", "sketch").mapInArrow(add, _SCHEMA.format(group=f"`{group}`", kind=kind))

    return step(step(parts, F.pmod(F.xxhash64("sketch"), F.lit(salts))))


def percentiles(sketches: DataFrame, group: str, shares: list[float], width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(group, field_name, n, pct, value): percentiles read from merged sketches."""
    kind = sketches.schema[group].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, f, n, blob in zip(pdf[group], pdf["field_name"], pdf["n"], pdf["sketch"]):
                s = Part.of(blob, width, depth).dense()
                out += [(g, f, n, p * 100, s.percentile(p)) for p in shares]
            yield pd.DataFrame(out, columns=[group, "field_name", "n", "pct", "value"])

    return sketches.mapInPandas(read, f"`{group}` {kind}, field_name string, n bigint, pct double, value double")


def judge_claims(df: DataFrame, claims: DataFrame, group: str, fields: list[str], stage: Stage, tolerance: float = 4.0, width: int = WIDTH, depth: int = DEPTH, deviations: float = 6.0, claims_at_once: int = 50_000) -> DataFrame:
    """(report_id, group, field_name, pct_rank, claimed_value, verdict): what the sketches say of ``claims``: ``wrong`` by more than
    ``tolerance`` points of rank, ``right``, or ``open`` where an estimated rank is nearer to the tolerance than ``deviations`` times
    its own deviation. Values that share the claim's code count as either.

    A claim without a value, rank, or group with values has no case and isn't returned. A group of very many claims is cut by a salt, its
    sketch is copied to each.
    """
    sketches = merge_sketches(build_sketches(df, group, fields, width, depth), group, width, depth)
    cols = ["report_id", group, "field_name", "pct_rank", "claimed_value"]
    asked = claims.select(*cols[:-1], F.col("claimed_value").cast("double").alias("claimed_value")).where(F.col("claimed_value").isNotNull() & ~F.isnan("claimed_value") & F.col("pct_rank").isNotNull() & F.col(group).isNotNull() & F.col("field_name").isin(fields))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    most = asked.groupBy(group, "field_name").count().agg(F.max("count")).first()[0] or 0
    salts = 1 + most // claims_at_once
    # one stream of a group's sketch and then its claims: the sketch is there once a task, not once a claim
    left = sketches.select(F.lit(None).cast(kinds["report_id"]).alias("report_id"), group, "field_name", F.lit(None).cast(kinds["pct_rank"]).alias("pct_rank"), F.lit(None).cast("double").alias("claimed_value"), "sketch", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    right = asked.withColumn("sketch", F.lit(None).cast("binary")).withColumn("_salt", F.pmod(F.xxhash64("report_id"), F.lit(salts)).cast("int"))
    stream = left.unionByName(right).repartition(group, "field_name", "_salt").sortWithinPartitions(group, "field_name", "_salt", F.col("sketch").isNull()).drop("_salt")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, s = None, None
        for pdf in batches:
            rows = []
            for r, g, f, p, v, blob in zip(pdf["report_id"], pdf[group], pdf["field_name"], pdf["pct_rank"], pdf["claimed_value"], pdf["sketch"]):
                if blob is not None:
                    at, s = (g, f), Part.of(blob, width, depth).dense()
                    continue
                if (g, f) != at or not s.n:
                    continue
                low, high = (p - tolerance) * s.n / 100, (p + tolerance) * s.n / 100
                least = most = 0.0  # of the ranks below and up to the claim: values that share its code may lie on either side
                if v >= 0:
                    rank, dev = s.rank_with_deviation(encode(np.array([v])) + np.arange(2))
                    least, most = rank[0] - deviations * dev[0], rank[1] + deviations * dev[1]
                rows.append((r, g, f, p, v, "wrong" if least > high or most < low else "right" if most <= high and least >= low else "open"))
            yield pd.DataFrame(rows, columns=[*cols, "verdict"])

    return stage.put(stream.mapInPandas(judge, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", verdict string"))


def wrong_claims(df: DataFrame, claims: DataFrame, group: str, fields: list[str], stage: Stage, tolerance: float = 4.0, width: int = WIDTH, depth: int = DEPTH, deviations: float = 6.0) -> DataFrame:
    """The report_id of the rows of ``claims`` (report_id, group, field_name, pct_rank, claimed_value) that are wrong by more than
    ``tolerance`` points of rank. The sketches decide (see ``judge_claims``); the few claims they leave open, so near to the tolerance that
    an estimate can't tell, are counted against the rows of their group.
    """
    judged = judge_claims(df, claims, group, fields, stage, tolerance, width, depth, deviations)
    open_ = judged.where("verdict = 'open'").drop("verdict")
    value = F.coalesce(*[F.when(F.col("field_name") == f, F.col(f)) for f in fields])
    counted = (
        df.select(group, *[F.col(f).cast("double").alias(f) for f in fields])
        .join(open_, group)
        .withColumn("_v", value)
        .where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_v") >= 0))
        .groupBy("report_id", "pct_rank")
        .agg(F.count("*").alias("n"), F.sum((F.col("_v") < F.col("claimed_value")).cast("long")).alias("below"), F.sum((F.col("_v") <= F.col("claimed_value")).cast("long")).alias("upto"))
    )
    exact = counted.where((F.col("below") * 100 > (F.col("pct_rank") + tolerance) * F.col("n")) | (F.col("upto") * 100 < (F.col("pct_rank") - tolerance) * F.col("n")))
    return judged.where("verdict = 'wrong'").select("report_id").unionByName(exact.select("report_id"))
