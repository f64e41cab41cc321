import numpy as np
import pytest

from ledgerlens.llm.clusters import Clusters, tree_boxes, typical


def brute(x, least=8):
    """Clusters straight from the definition: a set of m is the m nearest of any of its members."""
    found = {}
    n = len(x)
    dist = np.abs(x[:, None] - x[None]).max(2)
    for i in range(n):
        order = np.argsort(dist[i], kind="stable")
        for m in range(least, n + 1):
            s = order[:m]
            d = dist[np.ix_(s, s)].max()
            out = order[m:]
            if not len(out) or d < dist[np.ix_(s, out)].min():
                found[frozenset(s.tolist())] = d
                break
    return {s for s in found if not any(t < s for t in found)}


def frame(spark, x):
    return spark.createDataFrame([(f"t{i:04d}", *map(float, r)) for i, r in enumerate(x)], "id string, x double, y double, z double")


def sets(c):
    got = {}
    for r in c.members(c.verified()).collect():
        got.setdefault(r.cluster_id, set()).add(int(r.id[1:]))
    return {frozenset(v) for v in got.values()}


def planted(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.random((120, 3)) * 4]
    for k, w in ((8, 0.02), (12, 0.05), (7, 0.01), (30, 0.2), (9, 0.001)):
        parts.append(rng.random(3) * 4 + rng.random((k, 3)) * w)
    two = rng.random(3) * 4  # two clumps of 5 that only together are enough
    parts += [two + rng.random((5, 3)) * 0.001, two + 0.01 + rng.random((5, 3)) * 0.001]
    parts.append(np.repeat(rng.random((1, 3)) * 4, 9, axis=0))  # copies
    return np.concatenate(parts)


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_definition(seed):
    x = planted(seed)[:-9]
    boxes = tree_boxes(x.T.copy(), x.T.copy(), np.ones(len(x), int), 8, np.inf, -1.0, True)
    got = {frozenset(np.flatnonzero(((x >= b[:3]) & (x <= b[3:])).all(1)).tolist()) for b in boxes}
    assert got == brute(x)


@pytest.mark.parametrize("seed", range(2))
def test_clusters_equal_definition(spark, stage, seed):
    x = planted(seed)
    assert sets(Clusters(frame(spark, x), stage, leaf=40)) == brute(x)


def test_border_cases(spark, stage):
    x = np.concatenate([np.zeros((8, 3)), np.full((7, 3), 5.0), np.tile(np.arange(9)[:, None] * 40.0 + 100, 3)])
    got = sets(Clusters(frame(spark, x), stage))
    assert got == {frozenset(range(8))}
    bad = spark.createDataFrame([("a", None, 1.0, 1.0), ("b", float("nan"), 1.0, 1.0), (None, 1.0, 1.0, 1.0)] + [("c", 1.0, 1.0, 1.0)] * 20, "id string, x double, y double, z double")
    assert sets_empty(Clusters(bad, stage))
    assert sets_empty(Clusters(bad.where("false"), stage))


def sets_empty(c):
    return c.verified().count() == 0


def test_typical_members(spark):
    df = spark.createDataFrame([(f"m{i}", 1, 0.5, abs(i - 4) * 1.0) for i in range(9)], "id string, cluster_id long, d double, off double")
    r = typical(df, 3).collect()[0]
    assert r["size"] == 9 and r.typical == ["m4", "m3", "m5"]


@pytest.mark.parametrize("seed", range(4))
def test_cells_left_out_are_in_connected_parts_wider_than_the_level(seed):
    from ledgerlens.llm.clusters import spread_out

    rng = np.random.default_rng(seed)
    cells = np.unique(rng.integers(0, 16, (3, (60, 200, 400, 900)[seed])), axis=1)
    lo, hi = cells + 0.2, cells + 0.7
    touch = np.abs(cells[:, :, None] - cells[:, None, :]).max(0) <= 1
    label = np.arange(cells.shape[1])
    while (new := np.array([label[t].min() for t in touch])).tolist() != label.tolist():
        label = new
    want = np.array([(hi[:, label == c].max(1) - lo[:, label == c].min(1)).max() > 4 for c in label])
    assert (spread_out(lo, hi, 4.0) == want).all()


def test_minhash_groups_are_similar_and_whole(spark, stage):
    """Clear clumps far apart: every clump is one group, every member as similar to its medoid as asked, by Jaccard over all tokens."""
    from ledgerlens.llm.minhash import Groups

    rng = np.random.default_rng(8)
    centres = rng.random((12, 3)) * 1000
    x = np.concatenate([c + rng.random((30, 3)) * 1e-3 for c in centres] + [rng.random((20, 3)) * 1000 + 5000])
    df = frame(spark, x).union(spark.createDataFrame([("bad", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0), ("again", *map(float, x[0]))], "id string, x double, y double, z double"))
    g = Groups(df, ["x", "y", "z"], stage, levels=8, least=0.6)
    rows = g.members().collect()
    found = {}
    for r in rows:
        found.setdefault(r.group, set()).add(r.id)
    wanted = [{f"t{i:04d}" for i in range(30 * k, 30 * k + 30)} | ({"again"} if k == 0 else set()) for k in range(12)]
    assert all(w in list(found.values()) for w in wanted)
    assert not {r.id for r in rows} & {"bad", None}
    assert Groups(df.where("false"), ["x", "y", "z"], stage).members().count() == 0


def test_groups_use_every_link(spark, stage):
    """Numbers of links, components and least links of all points, with none left out: by brute force over all pairs."""
    from ledgerlens.llm.minhash import Groups

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 8.0, (60, 3)) for c in rng.random((3, 3)) * 100] + [rng.random((60, 3)) * 200, [[-7.0, 0.0, 3.0]]])
    levels, least = 5, 0.25
    g = Groups(frame(spark, x).union(spark.createDataFrame([("far", float("inf"), 1.0, 1.0)], "id string, x double, y double, z double")), ["x", "y", "z"], stage, levels=levels, least=least)
    links = stage.put(g.links())
    g.links = lambda: links
    width = x.max(0) - x.min(0)
    cells = np.stack([np.floor(x / (width / 2**k) + s / 4) for k in range(levels) for s in range(4)], axis=1)
    same = (cells[:, None] == cells[None]).all(axis=3).sum(axis=2)
    linked = (same / (8 * levels - same) >= least) & ~np.eye(len(x), dtype=bool)
    boxes = {r.v: [r[f"c{i}"] for i in range(3)] for r in g.places.collect()}
    found = {}
    for r in links.collect():
        h = levels - 1 - r.level
        inside = {b: {v for v, c in boxes.items() if sum((c[i] >> h) << (g.bits * i) for i in range(3)) == b} for b in (r.a, r.b)}
        for pair in {frozenset((u, v)) for u in inside[r.a] for v in inside[r.b] if u != v}:
            found[pair] = found.get(pair, 0) + 1
    v = {r.id: r.v for r in g.records.collect()}
    assert found == {frozenset((v[f"t{i:04d}"], v[f"t{j:04d}"])): 1 for i, j in zip(*np.nonzero(np.triu(linked)))}
    label = np.arange(len(x))
    while (new := np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])).tolist() != label.tolist():
        label = new
    medoid = {r.id: r.medoid for r in g.members(1).collect()}
    assert len(medoid) == linked.any(axis=1).sum()
    for c in np.unique(label[linked.any(axis=1)]):
        own = np.flatnonzero(label == c)
        i = max(own, key=lambda i: (linked[i].sum(), v[f"t{i:04d}"]))
        assert {medoid[f"t{j:04d}"] for j in own if linked[i, j] or i == j} == {v[f"t{i:04d}"]}


def test_a_level_below_the_floor_raises(spark, stage):
    x = np.stack([1.0 + np.arange(40) * 2.0**-52, np.zeros(40), np.zeros(40)], axis=1)
    x = np.concatenate([x, [[1e6, 1e6, 1e6]]])
    with pytest.raises(ValueError, match="within"):
        Clusters(frame(spark, x), stage, leaf=4).candidates()
