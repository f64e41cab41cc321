"""Groups of similar points by shared cells, exact Jaccard similarity, components, and splitting around medoids.

A point's tokens are its cells in grids of ``levels`` widths, each in four shifts, so two points share the more tokens the nearer they
are. A link is any pair of points whose Jaccard similarity is at least ``least``. Bands of min-hashes would miss some of them by chance, and
comparing all of a bucket would list them one by one, so neither is done: the shifted grids of a level cut space into boxes whose points have
the same tokens down to there. Pairs of boxes are followed from the widest level down. A pair is linked as a whole once it shares enough tokens,
is dropped once it can't get there, and is otherwise replaced by the pairs of its parts. What a point needs of its links (their number and the least
of them) and what the components need are sums, least values and edges of boxes, so all links count and none is listed.
Connected components are the groups; in a loose one, the point of the most links becomes a medoid that keeps what is as similar to it, and the
rest goes on without it.

The similarity is one threshold for all groups: sets that are tight only against their own surroundings need another at each scale, see the
README for the share of the clusters of problem 1 that are found this way.

Defined cases: points with a null or infinite field take no part; equal points are one point with several records; a point without links is no
group; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.components import Components, look_up
from ledgerlens.sources.tables import Stage


def cell_tokens(point: list[Column], levels: int) -> Column:
    """A hash for the cell at each level (widths of the span's halves) and shift, from places in the finest level's boxes."""
    cells = []
    for k in range(levels):
        h = levels - 1 - k
        for s in range(4):
            cells.append(F.xxhash64(F.lit(k * 4 + s), *[F.shiftright(c + F.lit(s << h), h + 2) for c in point]))
    return F.array(*cells)


def jaccard(a: Column, b: Column) -> Column:
    """Of token arrays whose places correspond: token i can only equal token i."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / (F.size(a) + F.size(b) - same)


class Groups:
    """(id, group, medoid) of ``points`` (id, then the axes)."""

    def __init__(self, points: DataFrame, axes: list[str], stage: Stage, levels: int = 12, least: float = 0.8):
        self.stage, self.least, self.levels, self.bits = stage, least, levels, 63 // len(axes)
        if levels + 3 > self.bits:
            raise ValueError(f"{levels} levels of {len(axes)} axes don't fit a box number")
        tokens = 4 * levels
        self.enough = next((s for s in range(1, tokens + 1) if s / (2 * tokens - s) >= least), tokens + 1)  # tokens shared by a link
        known = points.where(F.col("id").isNotNull())
        for a in axes:
            known = known.where(F.col(a).isNotNull() & (F.abs(a) < float("inf")))  # false for NaN too
        self.records = stage.put(known.select("id", *axes, F.xxhash64(*axes).alias("v")))
        span = self.records.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
        self.places_of, places = [f"c{i}" for i in range(len(axes))], []
        for i, a in enumerate(axes):
            low, high = float(span[2 * i] or 0), float(span[2 * i + 1] or 0)
            width = max(high - low, 1e-12, 2.0**-40 * max(abs(low), abs(high)))
            base = int(low // width) << (levels + 1)  # whole cells of the widest level
            places.append(F.greatest(F.floor(F.first(a) / F.lit(width) * F.lit(float(1 << (levels + 1)))) - F.lit(base), F.lit(0)).alias(self.places_of[i]))
        self.places = stage.put(self.records.groupBy("v").agg(*places))

    def _near(self, other: str) -> Column:
        """Whether a row's point is as similar as asked to the point in the struct ``other``."""
        return jaccard(cell_tokens([F.col(c) for c in self.places_of], self.levels), cell_tokens([F.col(f"{other}.{c}") for c in self.places_of], self.levels)) >= self.least

    def _box(self, level: int) -> Column:
        """The number of a point's box at a level."""
        return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(c, self.levels - 1 - level), self.bits * i) for i, c in enumerate(self.places_of)])

    def _shared(self, a: str, b: str) -> Column:
        """How many of a level's four cells two boxes share."""
        at = lambda box, i: F.shiftright(box, self.bits * i).bitwiseAND(F.lit((1 << self.bits) - 1))
        one = lambda s: reduce(lambda x, y: x & y, [F.shiftright(at(a, i) + F.lit(s), 2) == F.shiftright(at(b, i) + F.lit(s), 2) for i in range(len(self.places_of))])
        return sum([one(s).cast("int") for s in range(1, 4)], one(0).cast("int"))

    def links(self) -> DataFrame:
        """(level, a, b): pairs of boxes, each once, that link every point of one to every point of the other."""
        parts = int(self.stage.spark.conf.get("spark.sql.shuffle.partitions"))
        out, pairs, last = [], None, self.levels - 1
        for level in range(self.levels):
            if level:
                parent = self._box(level - 1).alias("up")
                boxes = self.stage.put(self.places.select(parent, self._box(level).alias("box")).distinct())
                down = pairs.join(boxes.select(F.col("up").alias("a"), F.col("box").alias("p")), "a").join(boxes.select(F.col("up").alias("b"), F.col("box").alias("q")), "b").where("a <> b or p <= q")
            else:  # a box is a quarter of the span or more
                boxes = self.stage.put(self.places.select(self._box(0).alias("p")).distinct())
                down = boxes.crossJoin(F.broadcast(boxes.withColumnRenamed("p", "q"))).where("p <= q").withColumns({"same": F.lit(0), "apart": F.lit(False)})
            now = down.withColumn("s", self._shared("p", "q"))
            # two points that share a cell share one of every level two or more above it, and of the level just above it unless the shift is odd
            more = F.when(F.col("s") > 0, 4 * (last - level)).when(F.col("apart"), 0).otherwise(min(2, 4 * (last - level)))
            now = now.select(F.col("p").alias("a"), F.col("q").alias("b"), (F.col("same") + F.col("s")).alias("same"), (F.col("s") == 0).alias("apart"), more.alias("more"))
            now = now.where(F.col("same") + F.col("more") >= self.enough).drop("more")
            now = self.stage.put(now.repartition(parts))
            out.append(now.where(F.col("same") >= self.enough).select(F.lit(level).alias("level"), "a", "b"))
            pairs = now.where(F.col("same") < self.enough)
        return reduce(DataFrame.unionByName, out[(self.enough - 1) // 4 :] or [out[-1].where("false")])  # none can share enough before

    def groups(self, rounds: int = 6) -> DataFrame:
        """(v, group, medoid). After ``rounds`` medoids of a component, what is left goes to the first of a point's own links. Without rounds
        a component is one group."""
        links, top = self.stage.put(self.links()), min((self.enough - 1) // 4, self.levels - 1)
        # all points of a box of the level ``top`` are linked to each other, so it is one vertex: its least point
        levels = F.explode(F.array(*[F.struct(F.lit(m).alias("level"), self._box(m).alias("box")) for m in range(top, self.levels)])).alias("l")
        above = self.stage.put(self.places.select("v", self._box(top).alias("top"), levels).select("v", "top", "l.*"))
        boxes = self.stage.put(above.groupBy("level", "box").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.first("top").alias("top")))
        heads = boxes.where(F.col("level") == top).select("top", F.col("least").alias("head"))
        boxes = self.stage.put(boxes.join(heads, "top").drop("top"))
        side = lambda c: boxes.select("level", *[F.col(x).alias(y) for x, y in (("box", c), ("n", f"n{c}"), ("least", f"least{c}"), ("head", f"head{c}"))])
        known = self.stage.put(links.join(side("a"), ["level", "a"]).join(side("b"), ["level", "b"]))
        one = known.select("level", F.col("a").alias("box"), (F.col("nb") - (F.col("a") == F.col("b")).cast("int")).alias("degree"), F.col("leastb").alias("link"))
        other = known.where("a <> b").select("level", F.col("b").alias("box"), F.col("na").alias("degree"), F.col("leasta").alias("link"))
        gained = one.unionByName(other).groupBy("level", "box").agg(F.sum("degree").alias("degree"), F.min("link").alias("link"))
        degree = above.join(gained, ["level", "box"]).groupBy("v", "top").agg(F.sum("degree").alias("degree"), F.min("link").alias("link")).where("degree > 0")
        labels = self.stage.put(Components(self.stage).labels(known.select(F.col("heada").alias("u"), F.col("headb").alias("v"))))
        degree = self.stage.put(degree.join(heads, "top").drop("top"))
        labelled = degree.join(labels.withColumnRenamed("v", "head"), "head", "left").withColumn("root", F.coalesce("root", "head")).drop("head")
        left = self.stage.put(labelled.join(self.places, "v"))
        out = None
        for _ in range(rounds):
            n = left.count()
            if not n:
                break
            medoids = self.stage.put(left.groupBy("root").agg(F.max(F.struct("degree", F.col("v").alias("medoid"), *self.places_of)).alias("m")))
            near = look_up(left, "root", medoids, self.stage, n).withColumn("ok", self._near("m"))
            near = self.stage.put(near.select("v", "root", "degree", "link", *self.places_of, "ok", F.col("m.medoid").alias("medoid")))
            kept = near.where("ok").select("v", F.col("medoid").alias("group"), "medoid")
            out = kept if out is None else out.unionByName(kept)
            left = near.where("not ok").drop("ok", "medoid")
        own = F.least("v", "link") if rounds else F.col("root")
        rest = left.select("v", own.alias("group"), own.alias("medoid"))
        return self.stage.put(rest if out is None else out.unionByName(rest))

    def members(self, rounds: int = 6) -> DataFrame:
        """(id, group, medoid) of every record in a group."""
        found = self.groups(rounds)
        return look_up(self.records.select("id", "v"), "v", found, self.stage, self.records.count()).select("id", "group", "medoid")
