import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import numbered
from ledgerlens.operators.skew import compress_values, key_profile, top_record

SCHEMA = "k string, v double, id long, measure int"


def brute(rows):
    out = {}
    for k in {r[0] for r in rows}:
        v = sorted(x for q, x, *_ in rows if q == k and x is not None and x == x)
        if v:
            c = Counter(v)
            best = max(v)
            at = lambda p: v[max(0, -(-len(v) * p // 100) - 1)]  # noqa: B023, E731
            out["(null)" if k is None else k] = (len(v), len(c), min(c, key=lambda x: (-c[x], x)), at(50), at(90), str(min((r[2] for r in rows if r[0] == k and r[1] == best), key=str)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, stage, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, float("nan"), *[float(rng.randrange(12)) for _ in range(6)]]), i, 0) for i in range(400)] + [("dry", None, 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    c = compress_values(df, F.col("k"), F.col("v"), F.col("id"))
    assert c.count() <= 12 * 3
    best = {r.key_value: r.record_key for r in top_record(c).collect()}
    got = {r.key_value: (r.n_rows, r.n_distinct, r.mode_value, r.p50, r.p90, best[r.key_value]) for r in key_profile(c, stage, [50, 90]).collect()}
    assert got == brute(rows)


def test_empty_table(spark, stage):
    c = compress_values(spark.createDataFrame([], SCHEMA), F.col("k"), F.col("v"), F.col("id"))
    assert top_record(c).count() == 0 and key_profile(c, stage, [50]).count() == 0


def test_numbers_are_dense_within_groups(spark, stage):
    df = spark.createDataFrame([("a", i % 40) for i in range(300)] + [("b", 1), (None, 2), (None, 1)], "g string, x int")
    got = numbered(df, ["x"], stage, group="g").collect()
    for g in ("a", "b", None):
        own = sorted((r["rank"], r.x) for r in got if r.g == g)
        assert [r for r, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)


@pytest.mark.parametrize("seed", range(2))
def test_interpolated_quantiles(spark, stage, seed):
    import numpy as np

    from ledgerlens.operators.skew import column_quantiles, quantile_row

    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 7, 333).astype(float), rng.normal(size=333)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)] + [(float("nan"), None, None)], "x double, y double, z double")
    shares = [0.0, 0.025, 0.25, 0.5, 0.95, 1.0]
    got = {r.key_value: r.q for r in column_quantiles(df, ["x", "y", "z"], shares, stage).collect()}
    assert set(got) == {"x", "y"}
    assert np.allclose(got["x"], np.quantile(x, shares)) and np.allclose(got["y"], np.quantile(y, shares))
    assert quantile_row(df, ["z"], [0.5], stage).collect()[0].z is None


def test_column_quantiles_from_bounds(spark, stage):
    """Large columns with ties, nulls and NaN: only the values near a quantile are sorted, and it is exact."""
    import numpy as np

    from ledgerlens.operators.skew import column_quantiles

    rng = np.random.default_rng(9)
    a, b = rng.lognormal(3, 2, 30_000), rng.integers(0, 6, 30_000).astype(float)
    a[::50] = np.nan
    df = spark.createDataFrame(list(zip(a.tolist(), [None if i % 7 == 0 else x for i, x in enumerate(b.tolist())], [None] * 30_000)), "a double, b double, c double").repartition(7)
    shares = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    for accuracy in (200, 10_000, 100_000):
        got = {r.key_value: r for r in column_quantiles(df, ["a", "b", "c"], shares, stage, accuracy).collect()}
        assert set(got) == {"a", "b"}
        assert np.allclose(got["a"].q, np.quantile(a[~np.isnan(a)], shares), rtol=1e-12) and got["a"].n_rows == 29_400
        assert np.allclose(got["b"].q, np.quantile([x for i, x in enumerate(b) if i % 7], shares))
