"""Groups of records linked directly or through others: connected components over many pairs.

The component of the highest-degree vertex is peeled off by frontier breadth-first joins and anti-joined
away; small components are labelled by minimum propagation. Minimum propagation works by contraction: each
vertex hooks to the neighbour of least priority in its closed neighbourhood, the graph of the hooks'
targets (two hops on) replaces the graph, and priorities are redrawn each round, so that the number of rounds is logarithmic
even for long chains. It goes on until no edge is left. A peeled component that isn't exhausted within ``bfs_rounds``, or whose frontier has
become a trickle, is contracted to one vertex and left to the propagation, so neither bound costs links.

Hot vertices: what is peeled maps to its hub by a literal, without a join. In any other lookup by vertex the keys that hold more than a
thousandth of the rows (at most 1,000 of them for either end, so a bounded broadcast) are looked up by broadcast, the others by shuffle.
The edges are partitioned by their source once for all breadth-first rounds.

Defined cases: pairs with a null or blank side are dropped; a pair of a record with itself makes it a group of
one unless it is linked otherwise; repeated and reversed pairs count once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import numbered
from ledgerlens.sources.tables import Stage


def record_key(col: Column) -> Column:
    """White space around is dropped; 64 hex digits are put in lower case, other keys stay as they are."""
    key = F.regexp_replace(col, r"^\s+|\s+$", "")
    return F.when(key.rlike("^[0-9a-fA-F]{64}$"), F.lower(key)).when(key != "", key)


SLOW = 1_000  # breadth-first rounds go on while they reach one vertex in so many edges; propagation is faster on long thin parts
HOT, LEAST = 1_000, 10_000  # a key is hot that holds more than one in HOT of all rows, and more than LEAST of them


def look_up(rows: DataFrame, key: str, table: DataFrame, stage: Stage, n: int, how: str = "inner") -> DataFrame:
    """``rows`` (at most ``n``) joined with ``table``, which has each ``key`` once. Rows of hot keys aren't shuffled."""
    if n <= LEAST:
        return rows.join(table, key, how)
    many = rows.groupBy(key).count().where(F.col("count") > max(n // HOT, LEAST)).select(key)
    many = stage.put(many)  # at most HOT rows
    if many.isEmpty():
        return rows.join(table, key, how)
    hot = table.join(F.broadcast(many), key, "left_semi")
    return rows.join(F.broadcast(many), key, "left_semi").join(F.broadcast(hot), key, how).unionByName(rows.join(F.broadcast(many), key, "left_anti").join(table, key, how))


class Components:
    """Labels of an undirected graph given as (u, v) of bigint; ids in, (v, root) out for every vertex that has an edge.

    ``rounds`` counts the rounds of propagation after a call of ``labels``."""

    def __init__(self, stage: Stage, bfs_rounds: int = 8):
        self.stage, self.bfs_rounds, self.rounds = stage, bfs_rounds, 0

    def _both(self, edges: DataFrame) -> DataFrame:
        return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def peel(self, edges: DataFrame) -> tuple[int | None, DataFrame | None, DataFrame]:
        """The hub, (v) of the vertices reached from it, itself included, and the edges left; edges that leave a part only partly
        reached start at the hub."""
        total = edges.count()
        degrees = self._both(edges).groupBy("u").agg(F.count("*").alias("d"))
        top = degrees.orderBy(F.desc("d"), "u").first()
        if top is None:
            return None, None, edges
        hub, spark = top.u, edges.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # the hub's own edges serve the first round only
        both = self._both(edges).where(F.col("u") != hub).where(F.col("v") != hub).repartition(parts, "u").persist(StorageLevel.DISK_ONLY)
        first = self._both(edges).where(F.col("u") == hub).select(F.col("v").alias("x"))
        frontier = self.stage.put(first)
        seen, done = frontier.unionByName(spark.createDataFrame([(hub,)], "x bigint")), False
        for _ in range(self.bfs_rounds - 1):
            new = both.join(frontier, both.u == frontier.x, "left_semi").select(F.col("v").alias("x")).distinct().join(seen, "x", "left_anti")
            frontier = self.stage.put(new)
            reached = frontier.count()
            if not reached:
                done = True
                break
            seen = seen.unionByName(frontier)
            if reached * SLOW < total:
                break
        both.unpersist()
        seen = self.stage.put(seen)
        at = edges.where((F.col("u") != hub) & (F.col("v") != hub)) if done else edges
        marked = at.join(seen.select(F.col("x").alias("u"), F.lit(True).alias("su")), "u", "left")
        marked = marked.join(seen.select(F.col("x").alias("v"), F.lit(True).alias("sv")), "v", "left") if not done else marked.withColumn("sv", F.col("su"))  # an exhausted component has both ends of an edge or none
        rest = marked.where("su is null or sv is null").select(F.when(F.col("su"), F.lit(hub)).otherwise(F.col("u")).alias("u"), F.when(F.col("sv"), F.lit(hub)).otherwise(F.col("v")).alias("v"))
        return hub, seen.select(F.col("x").alias("v")), self.stage.put(rest.distinct())

    def labels(self, edges: DataFrame) -> DataFrame:
        stage, self.rounds = self.stage, 0
        edges = stage.put(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        hub, peeled, edges = self.peel(edges)
        steps: list[DataFrame] = []
        while (left := edges.count()) > 0:
            self.rounds += 1
            turn = F.lit(self.rounds)
            near = self._both(edges).groupBy("u").agg(F.min(F.struct(F.xxhash64(turn, "v").alias("p"), F.col("v").alias("t"))).alias("m"))
            hook = stage.put(near.select(F.col("u").alias("v"), F.when(F.struct(F.xxhash64(turn, "u").alias("p"), F.col("u").alias("t")) < F.col("m"), F.col("u")).otherwise(F.col("m.t")).alias("to")))
            # a target's own target, of the same component and nearer to its least vertex
            onward = hook.select(F.col("v").alias("to"), F.col("to").alias("next"))
            hook = stage.put(look_up(hook, "to", onward, stage, 2 * left, "left").select("v", F.coalesce("next", "to").alias("to")))
            steps.append((hook, 2 * left))
            moved = look_up(edges, "u", hook.select(F.col("v").alias("u"), F.col("to").alias("tu")), stage, left)
            moved = moved if left <= LEAST else stage.put(moved)  # its keys are counted
            new = stage.put(look_up(moved, "v", hook.select("v", F.col("to").alias("tv")), stage, left).select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).where("u <> v").distinct())
            for df in (edges, moved):
                stage.drop(df)
            edges = new
        # from the last step to the first: what a vertex maps to is mapped on
        out = None
        for step, n in reversed(steps):
            if out is not None:
                onward = look_up(step, "to", out.select(F.col("v").alias("to"), "root"), stage, n, "left")
                out = stage.put(onward.select("v", F.coalesce("root", "to").alias("root")))
            else:
                out = step.select("v", F.col("to").alias("root"))
        if hub is None:
            return edges.select("v", F.col("u").alias("root"))  # no edges
        if out is None:
            return peeled.select("v", F.lit(hub).cast("bigint").alias("root"))
        stands = out.where(F.col("v") == hub).first()
        whole = peeled.select("v", F.lit(stands.root if stands else hub).cast("bigint").alias("root"))
        return out.where(F.col("v") != hub).unionByName(whole)


def link_groups(pairs: DataFrame, left: str, right: str, stage: Stage, bfs_rounds: int = 8) -> DataFrame:
    """(record_key, group_key): every record of a pair with both sides, and the smallest key of its group."""
    both = pairs.select(record_key(F.col(left)).alias("a"), record_key(F.col(right)).alias("b")).where("a is not null and b is not null").distinct()
    both = stage.put(both)
    nodes = both.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # ids in the order of the keys: the smallest id of a group is its smallest key
    ids = stage.put(numbered(nodes, ["key"], stage, name="id"))
    n = both.count()
    half = look_up(both.where("a <> b"), "a", ids.select(F.col("key").alias("a"), F.col("id").alias("u")), stage, n).select("u", "b")
    half = half if n <= LEAST else stage.put(half)
    edges = look_up(half, "b", ids.select(F.col("key").alias("b"), F.col("id").alias("v")), stage, n).select("u", "v")
    roots = Components(stage, bfs_rounds).labels(edges)
    placed = stage.put(ids.join(roots.withColumnRenamed("v", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    least = stage.put(placed.groupBy("root").agg(F.min("key").alias("group_key")))
    return look_up(placed, "root", least, stage, 2 * n).select(F.col("key").alias("record_key"), "group_key")
