"""Clusters of mutually similar records: sets that are tighter than they are near to anything else.

A record is a point of up to a few numeric fields; the distance is the largest difference in any field. A
cluster is a set of at least ``min_size`` records whose largest mutual distance D is smaller than the distance
from any of them to any record outside, and which holds no smaller such set.

Candidates come from banding, as in min-hash banding: at a level of width t a record's tokens are its cells of width 4t in four
grids, shifted by t in every field. One grid's cell is one band's key. As a set of diameter t or less crosses a cell border
of at most one of the four shifts in each of up to three fields, one band holds it whole: the bands miss nothing. A bucket
with at most ``leaf`` distinct points is searched exactly; a fuller one is searched at this level on summaries of its 16^3
sub-cells (so no task ever gets an unbounded group) and its points go on to the next level, t/2.

Within a bucket the connected components of the graph of all distances up to a threshold, for every threshold at once, are the nodes of the
single-linkage tree. Distances between summaries are the largest of their points, so a true cluster is a node in any
case. Cells that are connected more widely than the level's sets are left out beforehand. The wide levels are searched at once, on the cells of the whole table at a width at which they are at most 16^3. Nodes whose box is tighter than their next link are candidates; loose ones are split further down the tree.

A set with D below its distance to the rest is exactly what its bounding box holds, so candidates are boxes, and they are verified
exactly against all records: a record within D of the box and outside of it in one field only refutes the candidate,
others are compared with the members. Boxes that hold a smaller verified box are dropped.

Defined cases: records with a null or NaN field (or an id that is null) take no part; an id counts once, with the smallest of its
values; ``min_size`` or more records at one point are a cluster with D = 0; a set of all records has no outside, so it counts if
it holds no smaller cluster; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.sources.tables import Stage

AXES = ("x", "y", "z")
BOX = [f"{e}{a}" for e in ("lo", "hi") for a in AXES]
_BOX_SCHEMA = ", ".join(f"{b} double" for b in BOX)
CELLS = 16**3  # cells of a bucket at most
BROADCAST_BYTES = 32 << 20  # boxes at cells up to so many bytes, of BOX_BYTES each, are broadcast, more are joined by shuffle
BOX_BYTES = 128
FLOOR = 1e-14  # no level is narrower, nor than what doubles of the table's size can tell apart


def tree_boxes(lo: np.ndarray, hi: np.ndarray, count: np.ndarray, least: int, most: float, above: float, exact: bool) -> list[np.ndarray]:
    """Boxes (lo, hi) of the single-linkage nodes of at least ``least`` records whose extent is at most ``most``, more than
    ``above``, and below their next link. If distances are exact, only the smallest such nodes.

    ``lo`` and ``hi`` are 3 x n.
    """
    n = lo.shape[1]
    if n == 0:
        return []
    ends = np.concatenate([hi, -lo])
    turned = np.concatenate([-lo, hi])
    # Prim: the minimum spanning tree of the complete graph, in O(n) memory
    near, parent = np.full(n, np.inf), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    heads, tails, weights = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)
    at = 0
    for k in range(n - 1):
        open_[at] = False
        d = (ends + turned[:, at : at + 1]).max(axis=0)
        nearer = d < near
        near[nearer] = d[nearer]
        parent[nearer] = at
        near[at] = np.inf
        masked = np.where(open_, near, np.inf)
        at = int(masked.argmin())
        heads[k], tails[k], weights[k] = parent[at], at, masked[at]
    order = np.argsort(weights, kind="stable")
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    size, box, done = count.tolist(), np.concatenate([lo, hi]).T.tolist(), [False] * n
    found = []

    def judge(a: int, link: float) -> None:
        if size[a] < least or done[a]:
            return
        b = box[a]
        extent = max(b[3] - b[0], b[4] - b[1], b[5] - b[2])
        if extent > most:
            done[a] = True
        elif extent < link:
            if extent > above:
                found.append(np.array(b))
            done[a] = exact

    for k in order:
        w = float(weights[k])
        a, b = find(int(heads[k])), find(int(tails[k]))
        judge(a, w)
        judge(b, w)
        root[b] = a
        p, q = box[a], box[b]
        box[a] = [min(p[0], q[0]), min(p[1], q[1]), min(p[2], q[2]), max(p[3], q[3]), max(p[4], q[4]), max(p[5], q[5])]
        size[a] += size[b]
        done[a] = done[a] or done[b]
    judge(find(0), math.inf)
    return found


def spread_out(lo: np.ndarray, hi: np.ndarray, t: float) -> np.ndarray:
    """Which cell summaries can't be in any set of width above t/2 and up to t: points of cells of width t/4 that touch are on one
    side of such a set, so connected cells wider than t are in none."""
    at = np.floor(lo / (t / 4)).astype(np.int64)
    at -= at.min(axis=1, keepdims=True)
    grid = np.full(at.max(axis=1) + 3, np.iinfo(np.int64).max)
    i, j, k = at + 1
    grid[i, j, k] = np.arange(len(i))
    filled = grid < np.iinfo(np.int64).max
    while True:  # least numbers spread to touching cells, one axis after another
        new = grid
        for axis in range(3):
            near = new.copy()
            ends = [slice(None)] * 3
            low, high = ends.copy(), ends.copy()
            low[axis], high[axis] = slice(None, -1), slice(1, None)
            low, high = tuple(low), tuple(high)
            near[low] = np.minimum(near[low], new[high])
            near[high] = np.minimum(near[high], new[low])
            new = near
        new = np.where(filled, new, np.iinfo(np.int64).max)
        if (new == grid).all():
            break
        grid = new
    label = grid[i, j, k]
    low, high = np.full((3, len(i)), np.inf), np.full((3, len(i)), -np.inf)
    for a in range(3):
        np.minimum.at(low[a], label, lo[a])
        np.maximum.at(high[a], label, hi[a])
    return ((high - low).max(axis=0) > t)[label]


def _search(least: int):
    """mapInArrow over rows sorted by bucket: (s, bx, by, bz, most, above, leaf, n, box) to candidate boxes."""

    def one(rows: pa.Table) -> list[np.ndarray]:
        most, above, leaf = (rows.column(c)[0].as_py() for c in ("most", "above", "leaf"))
        lo = np.stack([rows.column(f"lo{a}").to_numpy() for a in AXES])
        hi = np.stack([rows.column(f"hi{a}").to_numpy() for a in AXES])
        n = rows.column("n").to_numpy()
        if leaf or most > 2 * above:
            return tree_boxes(lo, hi, n, least, most, above, leaf)
        out = spread_out(lo, hi, most)
        if n[~out].sum() < least:
            return []
        found = tree_boxes(lo[:, ~out], hi[:, ~out], n[~out], least, most, above, leaf)
        # a cell left out that lies within D of a whole box refutes it; all others are judged by the verification
        far = lambda b: np.maximum(b[3:, None] - lo[:, out], hi[:, out] - b[:3, None]).max(axis=0)
        return [b for b in found if not (far(b) <= (b[3:] - b[:3]).max()).any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[np.ndarray]) -> pa.RecordBatch:
            m = np.array(found).reshape(-1, 6)
            return pa.RecordBatch.from_arrays([pa.array(m[:, i]) for i in range(6)], BOX)

        waiting: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            found = []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                key = tuple(keys[lo])
                if waiting and key != last:
                    found += one(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(b.slice(lo, hi - lo))
                last = key
            yield emit(found)
        if waiting:
            yield emit(one(pa.Table.from_batches(waiting)))

    return run


def _extent() -> Column:
    return F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in AXES])


class Clusters:
    """Clusters of ``points`` (id, x, y, z); fewer fields are given as constants."""

    def __init__(self, points: DataFrame, stage: Stage, min_size: int = 8, leaf: int = 1024):
        self.stage, self.least, self.leaf = stage, min_size, leaf
        fine = F.col("id").isNotNull()
        for a in AXES:
            fine = fine & F.col(a).isNotNull() & ~F.isnan(a) & ~F.col(a).isin(float("inf"), float("-inf"))
        self.points = stage.put(points.where(fine).groupBy("id").agg(*[F.min(a).alias(a) for a in AXES]))
        self.places = stage.put(self.points.groupBy(*AXES).agg(F.count("*").alias("n")))

    def candidates(self) -> DataFrame:
        """Distinct boxes, among which all clusters are."""
        out = self.places.where(F.col("n") >= self.least).select(*[F.col(a).alias(f"lo{a}") for a in AXES], *[F.col(a).alias(f"hi{a}") for a in AXES])
        active = self.places.where(F.col("n") < self.least)
        span = active.agg(*[F.max(a) - F.min(a) for a in AXES], F.max(F.greatest(*[F.abs(a) for a in AXES])).alias("far")).first()
        if span[0] is None:
            return out
        span, floor = span[:3], max(FLOOR, span.far * 2.0**-50)  # doubles of that size aren't nearer
        key, summary = ["s", "bx", "by", "bz"], ["most", "above", "leaf", "n", *BOX]
        top = 2.0 ** math.ceil(math.log2(max(*span, 1e-12)))

        def cells(rows: DataFrame, by: list[str], t: float, most: float) -> DataFrame:
            """Summaries of the cells of width t/4: points of one cell are on one side of any set wider than that."""
            grouped = rows.groupBy(*by, *[F.floor(F.col(a) / (t / 4)).alias(f"c{a}") for a in AXES]).agg(F.sum("n").alias("n"), *[F.min(a).alias(f"lo{a}") for a in AXES], *[F.max(a).alias(f"hi{a}") for a in AXES])
            return grouped.withColumns({"most": F.lit(most), "above": F.lit(t / 2), "leaf": F.lit(False)}).select(*(by or [F.lit(0).cast("bigint").alias(k) for k in key]), *summary)

        # The wide levels together: as one bucket, at the finest level at which the whole table has few cells.
        widths = [top / 2**k for k in range(12)]
        counts = active.agg(*[F.approx_count_distinct(F.xxhash64(*[F.floor(F.col(a) / (t / 4)) for a in AXES])) for t in widths]).first()
        t = min([w for w, n in zip(widths, counts) if n <= 0.8 * CELLS], default=top)
        whole = self.stage.put(cells(active, [], t, 1e300))
        while t < top and whole.count() > CELLS:  # the counts were approximate
            t *= 2
            whole = self.stage.put(cells(active, [], t, 1e300))
        out = out.unionByName(self.stage.put(whole.coalesce(1).mapInArrow(_search(self.least), _BOX_SCHEMA)))
        t = max(t / 2, floor)
        while True:
            rows = active.select(*AXES, "n", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), *[F.floor((F.col(a) + s * t) / (4 * t)).alias(f"b{a}") for a in AXES]) for s in range(4)])).alias("k")).select(*AXES, "n", "k.*")
            buckets = self.stage.put(rows.groupBy(*key).agg(F.count("*").alias("places"), F.sum("n").alias("records")).where(F.col("records") >= self.least).withColumn("leaf", F.col("places") <= self.leaf).select(*key, "leaf"))
            placed = rows.join(buckets, key)
            small = placed.where("leaf").select(*key, F.lit(t).alias("most"), F.lit(-1.0).alias("above"), "leaf", "n", *[F.col(a).alias(f"lo{a}") for a in AXES], *[F.col(a).alias(f"hi{a}") for a in AXES])
            full = placed.where("not leaf")
            found = small.unionByName(cells(full, key, t, t)).repartition(*key).sortWithinPartitions(*key).mapInArrow(_search(self.least), _BOX_SCHEMA)
            out = out.unionByName(self.stage.put(found))
            if buckets.where("not leaf").isEmpty():
                break
            if t / 2 < floor:  # a larger ``leaf`` holds them
                raise ValueError(f"more than {self.leaf} distinct points lie within {4 * t:g} of each other")
            active = self.stage.put(full.select(*AXES, "n").distinct())
            t /= 2
        return out.distinct()

    def _at_cells(self, boxes: DataFrame, reach: Column) -> DataFrame:
        """Boxes, each at all cells its surroundings touch: cells of a power of 2 not below D."""
        wide = boxes.withColumn("level", F.ceil(F.log2(F.greatest(F.col("d"), F.lit(1e-12)))).cast("int")).withColumn("w", F.pow(F.lit(2.0), "level"))
        for a in AXES:
            wide = wide.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(f"lo{a}") - reach) / F.col("w")), F.floor((F.col(f"hi{a}") + reach) / F.col("w")))))
        return wide.drop("w")

    def _near(self, rows: DataFrame, boxes: DataFrame, reach: bool) -> DataFrame:
        """Rows with the boxes they lie in, or within D of."""
        cells = self.stage.put(self._at_cells(boxes, F.col("d") * (1 + 1e-9) if reach else F.lit(0.0)))
        levels = [r.level for r in cells.select("level").distinct().collect()]  # powers of two: a few dozen at most
        if not levels:
            return rows.withColumn("box", F.lit(None).cast("bigint")).join(boxes.select("d", *BOX), F.lit(False))
        keyed = rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[F.floor(F.col(a) / (2.0**k)).alias(f"c{a}") for a in AXES]) for k in levels])).alias("k")).select(*rows.columns, "k.*")
        cells = F.broadcast(cells) if cells.count() * BOX_BYTES <= BROADCAST_BYTES else cells
        inside = F.lit(True)
        for a in AXES:
            r = F.col("d") if reach else F.lit(0.0)
            inside = inside & (F.col(a) - F.col(f"hi{a}") <= r) & (F.col(f"lo{a}") - F.col(a) <= r)
        return keyed.join(cells, ["level", "cx", "cy", "cz"]).where(inside).drop("level", "cx", "cy", "cz")

    def verified(self) -> DataFrame:
        """(box, d, lo.., hi.., size): the clusters."""
        boxes = self.stage.put(self.candidates().withColumn("d", _extent()).withColumn("box", F.xxhash64(*BOX)))
        around = self._near(self.places, boxes, True)
        beyond = F.lit(0)
        for a in AXES:
            beyond = beyond + ((F.col(a) > F.col(f"hi{a}")) | (F.col(a) < F.col(f"lo{a}"))).cast("int")
        around = around.withColumn("beyond", beyond)
        judged = around.groupBy("box", "d", *BOX).agg(F.sum(F.when(F.col("beyond") == 0, F.col("n"))).alias("size"), F.max(F.when(F.col("beyond") == 1, 1).otherwise(0)).alias("refuted"), F.max(F.when(F.col("beyond") > 1, 1).otherwise(0)).alias("open"))
        judged = self.stage.put(judged.where((F.col("refuted") == 0) & (F.col("size") >= self.least)).drop("refuted"))
        # records beyond an edge or corner of the box: within D of a member?
        open_ = judged.where("open = 1").drop("open", "size")
        if not open_.isEmpty():
            near = self.stage.put(self._near(self.places, open_, True).withColumn("beyond", beyond))
            outer = near.where("beyond > 1").select("box", "d", *[F.col(a).alias(f"o{a}") for a in AXES])
            members = near.where("beyond = 0").select("box", *AXES)
            close = F.lit(True)
            for a in AXES:
                close = close & (F.abs(F.col(a) - F.col(f"o{a}")) <= F.col("d"))
            bad = outer.join(members, "box").where(close).select("box").distinct()
            judged = self.stage.put(judged.join(bad, "box", "left_anti"))
        # a box that holds a smaller one isn't a cluster; the smaller one's corner member lies in it
        inner = judged.select(*[F.col(f"lo{a}").alias(a) for a in AXES], *[F.col(f"hi{a}").alias(f"top{a}") for a in AXES], F.col("box").alias("inner"))
        held = F.lit(True)
        for a in AXES:
            held = held & (F.col(f"top{a}") <= F.col(f"hi{a}"))
        outer = self._near(inner, judged.drop("open"), False).where(held & (F.col("inner") != F.col("box"))).select("box").distinct()
        return self.stage.put(judged.drop("open").join(outer, "box", "left_anti"))

    def members(self, clusters: DataFrame) -> DataFrame:
        """(id, cluster_id, d, off): ``off`` is the largest distance from the record to any member, the least of which is the
        cluster's medoid."""
        off = F.greatest(*[F.greatest(F.col(a) - F.col(f"lo{a}"), F.col(f"hi{a}") - F.col(a)) for a in AXES])
        return self._near(self.points, clusters.select("box", "d", *BOX), False).select("id", F.col("box").alias("cluster_id"), "d", off.alias("off"))


def typical(members: DataFrame, k: int = 3, salts: int = 32) -> DataFrame:
    """(cluster_id, size, typical): the ids of the k members nearest to all others, most typical first."""
    order = [F.col("off"), F.col("id")]
    salted = members.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(salts)))
    best = salted.withColumn("_r", F.row_number().over(W.partitionBy("cluster_id", "_s").orderBy(*order))).where(F.col("_r") <= k)
    best = best.withColumn("_r", F.row_number().over(W.partitionBy("cluster_id").orderBy(*order))).where(F.col("_r") <= k)
    names = best.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("typical"))
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.first("d").alias("diameter")).join(names, "cluster_id")
