"""Percentile sketches, samples and heavy items."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import heavy, quantiles, sampling


def test_codes_keep_order():
    v = np.sort(np.concatenate([[0.0], np.random.default_rng(1).lognormal(5, 6, 1000), [np.inf]]))
    c = quantiles.encode(v)
    assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 1 << quantiles.BITS
    assert np.allclose(quantiles.decode(c[1:-1]), v[1:-1], rtol=2**-12) and quantiles.decode(c[:1])[0] == 0


@pytest.mark.parametrize("values", [np.random.default_rng(2).lognormal(8, 3, 20_000), np.random.default_rng(3).integers(0, 5, 20_000).astype(float)])
def test_rank_error_merge_and_delete(values):
    code, count = np.unique(quantiles.encode(values), return_counts=True)
    whole, a, b = quantiles.DyadicSketch(), quantiles.DyadicSketch(), quantiles.DyadicSketch()
    whole.add(code, count)
    half = len(code) // 2
    a.add(code[:half], count[:half])
    b.add(code[half:], count[half:])
    assert ((a.counters + b.counters) == whole.counters).all()
    s = np.sort(values)
    for p in (0.05, 0.25, 0.5, 0.75, 0.95):
        q = whole.percentile(p)
        lo, hi = np.searchsorted(s, q * (1 - 2**-11)), np.searchsorted(s, q * (1 + 2**-11), "right")
        assert lo / len(s) - 0.02 <= p <= hi / len(s) + 0.02
    for i in np.searchsorted(s, s[:: len(s) // 50]):
        rank, dev = whole.rank_with_deviation(quantiles.encode(s[[i]]))
        assert abs(rank[0] - np.searchsorted(quantiles.encode(s), quantiles.encode(s[[i]]))[0]) <= 6 * dev[0]
    whole.add(code[half:], -count[half:])
    assert (whole.counters == a.counters).all()
    part = quantiles.Part()
    part.add(code[:half], count[:half])
    assert (quantiles.Part.of(part.blob()).dense().counters == a.counters).all()
    both = quantiles.Part.of(part.blob()).merge(quantiles.Part.of(a.blob()).blob())
    assert (both.dense().counters == 2 * a.counters).all()
    one_by_one = quantiles.Part(16, 3)  # small enough to become counters on the way
    for c, n in zip(np.array_split(code, 7), np.array_split(count, 7)):
        one_by_one.add(c, n)
    direct = quantiles.DyadicSketch(16, 3)
    direct.add(code, count)
    assert (one_by_one.dense().counters == direct.counters).all()


def claims_frame(spark, rows):
    return spark.createDataFrame(rows, "report_id long, shard_id int, field_name string, pct_rank int, claimed_value double, extra string")


def test_wrong_claims(spark, stage):
    rng = np.random.default_rng(4)
    data = [(int(rng.integers(0, 3)) if i % 9 else None, float(rng.lognormal(3, 2)), [None, float("nan"), -1.0, 5.0][i % 4]) for i in range(4000)]
    df = spark.createDataFrame(data, "shard_id int, fee double, other double").withColumn("value", F.lit(1)).withColumn("n", F.lit(2))
    rows, want = [], set()
    for shard in range(3):
        v = np.sort([x for s, x, _ in data if s == shard])
        for p in (0, 10, 50, 90, 100):
            for off in (0, 3, 3.9, 4.2, 6, -3.9, -4.3, -9):
                q = min(1, max(0, (p + off) / 100))
                claim = float(v[min(len(v) - 1, int(q * len(v)))])
                if (v < claim).sum() * 100 > (p + 4) * len(v) or (v <= claim).sum() * 100 < (p - 4) * len(v):
                    want.add(len(rows))
                rows.append((len(rows), shard, "fee", p, claim, "x"))
    rows += [(900, 1, "other", 50, 5.0, ""), (901, 1, "other", 50, -5.0, ""), (902, 1, "fee", 50, None, ""), (903, 7, "fee", 50, 1.0, ""), (904, None, "fee", 50, 1.0, ""), (905, 1, "nothing", 50, 1.0, "")]
    got = {r.report_id for r in quantiles.wrong_claims(df, claims_frame(spark, rows), "shard_id", ["fee", "other"], stage).collect()}
    assert got == want | {901}


def test_sketches_decide_most_claims(spark, stage):
    rng = np.random.default_rng(6)
    values = {s: np.sort(rng.lognormal(5, 2, 3000)) for s in range(4)}
    df = spark.createDataFrame([(s, float(v)) for s, x in values.items() for v in x], "shard_id int, fee double").repartition(5)
    rows = [(100 * s + p, s, "fee", p, float(values[s][min(2999, int(30 * p + 30 * off))]), "") for s in values for p in range(5, 95, 3) for off in [rng.choice([-1.0, 0.0, 1.0, 12.0])]]
    got = {r.report_id: r.verdict for r in quantiles.judge_claims(df, claims_frame(spark, rows), "shard_id", ["fee"], stage, claims_at_once=10).collect()}
    assert len(got) == len(rows) and sum(v == "open" for v in got.values()) < 0.1 * len(rows)
    for r, s, _, p, v, _ in rows:
        wrong = (values[s] < v).sum() > 30 * (p + 4) or (values[s] <= v).sum() < 30 * (p - 4)
        assert got[r] in ("open", "wrong" if wrong else "right")


def test_parts_of_many_groups_are_bounded_and_add_up(spark):
    rng = np.random.default_rng(7)
    x, keys = rng.lognormal(2, 2, 5000), rng.integers(0, 40, 5000)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(v)], ["g", "v"]) for k, v in zip(np.array_split(keys, 20), np.array_split(x, 20))]
    out = [b for b in quantiles._build("g", ["v"], 64, 3, rows_at_once=500, held=2000)(iter(batches))]
    parts = pa.Table.from_batches(out).to_pandas()
    assert len(parts) > 40 and parts["n"].sum() == 5000
    frame = spark.createDataFrame([(int(r.g), r.field_name, int(r.n), bytearray(r.sketch)) for r in parts.itertuples()], "g int, field_name string, n long, sketch binary")
    merged = {r.g: r for r in quantiles.merge_sketches(frame, "g", 64, 3, salts=3).collect()}
    assert len(merged) == 40
    for g, r in merged.items():
        want = quantiles.DyadicSketch(64, 3)
        want.add(*np.unique(quantiles.encode(x[keys == g]), return_counts=True))
        assert r.n == (keys == g).sum() and (quantiles.Part.of(bytes(r.sketch), 64, 3).dense().counters == want.counters).all()


def test_sketches_of_an_empty_table(spark):
    df = spark.createDataFrame([], "shard_id int, fee double")
    assert quantiles.percentiles(quantiles.merge_sketches(quantiles.build_sketches(df, "shard_id", ["fee"]), "shard_id"), "shard_id", [0.5]).count() == 0


def test_percentiles_of_null_group(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(101)] + [(1, None)], "shard_id int, fee double")
    r = quantiles.percentiles(quantiles.merge_sketches(quantiles.build_sketches(df, "shard_id", ["fee"]), "shard_id"), "shard_id", [0.5]).collect()
    assert len(r) == 1 and r[0].shard_id is None and abs(r[0].value - 50) < 3


def test_sample_meets_quotas(spark, stage):
    units = spark.createDataFrame([(f"u{i % 500}", "0_0_1" if i % 500 < 30 else "0_0_0") for i in range(900)] + [("n", None), (None, "0_0_0")], "unit string, stratum string")
    targets = spark.createDataFrame([(1, "0_0_0", 0.9, 0, 100), (1, "0_0_1", 0.1, 25, 100), (2, "0_0_1", 1.0, 0, 40), (2, "1_1_1", 0.0, 3, 40), (3, "0_0_0", None, None, None), (None, "0_0_0", 0.5, 1, 10)], "plan_id int, stratum string, target_share double, min_rows long, sample_rows long")
    draw = sampling.StratifiedDraw(units, targets, stage)
    rows = [tuple(r) for r in draw.sample().collect()]
    assert len(rows) == len(set(rows))
    assert Counter((p, s) for p, s, _ in rows) == {(1, "0_0_0"): 90, (1, "0_0_1"): 25, (2, "0_0_1"): 30}
    short = {(r.plan_id, r.stratum): r.short for r in draw.report().collect()}
    assert short == {(1, "0_0_0"): 0, (1, "0_0_1"): 0, (2, "0_0_1"): 10, (2, "1_1_1"): 3, (3, "0_0_0"): 0}
    empty = sampling.StratifiedDraw(units.where("false"), targets, stage)
    assert empty.sample().count() == 0 and empty.report().where("short > 0").count() == 4


def test_stratum_needs_all_flags(spark):
    df = spark.createDataFrame([(True, False), (None, True)], "a boolean, b boolean")
    assert [r[0] for r in df.select(sampling.stratum_of(["a", "b"])).collect()] == ["1_0", None]


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    s, true = heavy.ConservativeSketch(256, 3), Counter()
    for _ in range(20):
        v, n = np.unique(rng.zipf(1.3, 500).astype(np.int64), return_counts=True)
        est = s.add(v, n)
        true.update(dict(zip(v.tolist(), n.tolist())))
        assert all(e >= true[x] for x, e in zip(v.tolist(), est))


def test_heavy_items(spark, stage):
    rng = random.Random(3)
    rows = [("a", "hot")] * 700 + [("a", f"x{rng.randrange(2000)}") for _ in range(1300)] + [("b", f"y{i % 25}") for i in range(500)] + [("a", None), ("b", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "field_name string, item string").withColumn("total", F.lit(1)).withColumn("h", F.lit(2))
    got = {(r.field_name, r["item"]): (r.n, r.total) for r in heavy.heavy_items(df, ["a", "b"], 0.04, stage, width=1 << 12).collect()}
    assert got == {("a", "hot"): (700, 2000)} | {("b", f"y{i}"): (20, 500) for i in range(25)}
    # a heap that is too small at first is doubled until nothing heavy was let go
    again = {(r.field_name, r["item"]) for r in heavy.heavy_items(df, ["a", "b"], 0.04, stage, heap=1, width=1 << 12).collect()}
    assert again == set(got)
    assert heavy.heavy_items(df.where("false"), ["a", "b"], 0.04, stage).count() == 0
