"""Ordered folds against plain loops, with keys whole and cut into ranges."""

import datetime as dt
import random
import statistics
import time
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from argusframe.operators import correlate, risk, windows

AT = dt.datetime(2024, 1, 1)


def values_of(spark, values, key="k"):
    return [(i, key, v) for i, v in enumerate(values)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, key string, value double")


def z_of(values, rows, warm_up):
    out = []
    for i, v in enumerate(values):
        past = [x for x in values[max(0, i - rows) : i] if x is not None]
        dev = statistics.stdev(map(float, past)) if len(past) > 1 else 0
        out.append(float(abs(Fraction(v) - sum(map(Fraction, past)) / len(past))) / dev if v is not None and len(past) >= warm_up and dev > 0 else None)
    return out


@pytest.mark.parametrize("hot", [10**6, 70])
def test_z_scores(spark, hot):
    """Nulls, drifts, values about 1e15, constants, keys shorter and longer than the frame, and a null key."""
    pick = random.Random(1)
    series = {
        "drift": [1e15 + i * 3 + pick.random() for i in range(400)], "same": [7.0] * 150, "few": [1.0, 2.0, 3.0],
        "holes": [None if i % 5 == 0 else pick.gauss(0, 1) for i in range(300)], None: [float(i % 13) for i in range(200)],
    }
    got = windows.z_scores(frame(spark, [r for k, v in series.items() for r in values_of(spark, v, k)]), "value", ["key"], ["event_id"], 10, 40, hot_rows=hot)
    found = {(r.key, r.event_id): r.z for r in got.collect()}
    assert len(found) == sum(map(len, series.values()))
    for k, values in series.items():
        for i, want in enumerate(z_of(values, 40, 10)):
            assert found[k, i] == (pytest.approx(want, rel=1e-9, abs=1e-12) if want is not None else None), (k, i)


@pytest.mark.parametrize("hot", [10**6, 900])
def test_z_scores_forget_a_huge_value(spark, hot):
    """After a first value of 5e9 and 2,999 ordinary ones, 50,000 is far from the thousand before it."""
    rng = np.random.default_rng(4)
    values = [5e9, *rng.normal(1000, 100, 2999).tolist(), 5e4]
    found = {r.event_id: r.z for r in windows.z_scores(frame(spark, values_of(spark, values)), "value", ["key"], ["event_id"], hot_rows=hot).collect()}
    for i in (1500, 2999, 3000):
        past = values[i - 1000 : i]
        assert found[i] == pytest.approx(abs(values[i] - statistics.fmean(past)) / statistics.stdev(past), rel=1e-9)
    assert found[3000] > 480


@pytest.mark.parametrize("hot", [10**6, 90])
def test_iqr_scores(spark, hot):
    pick = random.Random(2)
    values = [pick.choice([None, pick.gauss(0, 1), float(pick.randint(0, 3)), 100.0 * pick.random()]) for _ in range(500)]
    found = {r.event_id: (r.outlier, r.iqr_score) for r in windows.iqr_scores(frame(spark, values_of(spark, values)), "value", ["key"], ["event_id"], 1.5, 20, 60, hot_rows=hot).collect()}
    for i, v in enumerate(values):
        past = [x for x in values[max(0, i - 60) : i] if x is not None]
        q1, q2, q3 = np.percentile(past, [25, 50, 75]) if len(past) >= 20 else (0, 0, 0)
        ready = q3 > q1 and v is not None
        assert found[i] == ((bool(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)), pytest.approx(abs(v - q2) / (q3 - q1))) if ready else (False, None))


def test_a_million_rows_of_one_key(spark):
    """In ten ranges, each row in a step; a sample of them against a plain computation."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("k").alias("key"), ((F.xxhash64("id") % 1_000_003) / 1000).alias("value"))
    began = time.monotonic()
    got = windows.iqr_scores(df, "value", ["key"], ["event_id"], hot_rows=100_000).where("event_id % 99991 = 5 OR event_id = 999999").collect()
    assert time.monotonic() - began < 120
    every = {r.event_id: r.value for r in df.where(" OR ".join(f"event_id BETWEEN {r.event_id - 1000} AND {r.event_id}" for r in got)).collect()}
    assert len(got) == 12
    for r in got:
        if r.event_id >= 1000:
            q1, q2, q3 = np.percentile([every[i] for i in range(r.event_id - 1000, r.event_id)], [25, 50, 75])
            assert r.iqr_score == pytest.approx(abs(every[r.event_id] - q2) / (q3 - q1))


@pytest.mark.parametrize("alpha", [0.3, 0.9, 1.0, 0.001])
def test_weighted_means(spark, alpha):
    """Folded in ranges: no window and no sort of a whole key in the plan."""
    values = [((i * 7919) % 101) / 7 for i in range(500)]
    df = frame(spark, values_of(spark, values) + [(1, None, 2.0), (0, None, 4.0), (0, "void", None)])
    out = windows.ewma(df.repartition(7), "value", "key", ["event_id"], alpha)
    mean, nulls = values[0], 4.0 + alpha * (2.0 - 4.0)
    for v in values[1:]:
        mean += alpha * (v - mean)
    assert {r.key: r.ewma for r in out.collect()} == {"k": pytest.approx(mean), None: pytest.approx(nulls)}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def plain_greedy(rows, gap):
    last, kept = {}, []
    for e, t, k in sorted(rows, key=lambda r: (r[1], r[0])):
        if k not in last or (t - last[k]).total_seconds() >= gap:
            last[k] = t
            kept.append(e)
    return sorted(kept)


@pytest.mark.parametrize("hot", [10**6, 40])
@pytest.mark.parametrize("gap", [100, 7, 0, 100_000])
def test_greedy(spark, hot, gap):
    """A key with most of the rows, ties, a null key, and gaps longer than a range or than all of it."""
    pick = random.Random(gap)
    rows = [(i, AT + dt.timedelta(seconds=pick.randint(0, 4000)), pick.choice(["a", "a", "a", "b", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp, key string")
    got = correlate.greedy(df.withColumn("g", F.lit(float(gap))), ["key"], "g", hot_rows=hot)
    assert sorted(r.event_id for r in got.collect()) == plain_greedy(rows, gap)


@pytest.mark.parametrize("hot", [10**6, 2])
def test_greedy_keeps_types_and_values(spark, hot):
    """A bigint column with nulls beyond 2 ** 53, decimals, arrays, structs and binary pass unchanged."""
    rows = [(i, AT + dt.timedelta(hours=i), "k", 9007199254740993 + i if i % 2 else None, Decimal("1.10"), [1, None], (None, "x"), b"\x00\xff") for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp, key string, big long, d decimal(20,2), a array<int>, s struct<p: int, q: string>, b binary")
    got = correlate.greedy(df, ["key"], 60, hot_rows=hot)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def plain_risk(bases):
    out = []
    for base in bases:
        recent = out[-10:]
        mean = sum(recent) / len(recent) if recent else 0
        factor = 0.1 if len(out) < 5 else min(1.0, mean / 100) if mean > 50 else 0.4 if mean > 30 else 0.1
        out.append(min(100.0, base + 50 * factor))
    return out


@pytest.mark.parametrize(("hot", "look_back"), [(10**6, 1000), (60, 100), (60, 12)])
def test_risk_history_feeds_back(spark, hot, look_back):
    """Each score counts in the next ten. A short look back leaves ranges unsure, and their address is then scored whole."""
    pick = random.Random(3)
    bases = [pick.choice([10.0, 35.0, 60.0, 90.0]) + pick.random() for _ in range(400)]
    rows = [(i, AT + dt.timedelta(seconds=i), "1.1.1.1", b) for i, b in enumerate(bases)] + [(1000 + i, AT, None, 60.0) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp, source_ip string, base double")
    weights = dict.fromkeys(risk.WEIGHTS, 0) | {"historical": 50}
    got = risk.risk_scores(df, weights, [("base", lambda d: F.col("base"), 1.0)], look_back=look_back, hot_rows=hot)
    found = {r.event_id: r.risk_score for r in got.collect()}
    assert [found[i] for i in range(400)] == pytest.approx(plain_risk(bases), abs=1e-12)
    assert {found[1000 + i] for i in range(20)} == {65.0}


def test_limits_in_a_stream(spark, tmp_path):
    """Over many batches in order of time as in one pass, types kept; a null key is a key, and a late row does not count."""
    from argusframe.sources import sinks
    from argusframe.streaming import streams

    pick = random.Random(8)
    rows = sorted(((i, AT + dt.timedelta(seconds=pick.randint(0, 4000), microseconds=i), pick.choice(["a", "a", None]), 9007199254740993 + i if i % 3 else None) for i in range(120)), key=lambda r: r[1])
    for k in range(4):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], "event_id long, timestamp timestamp, key string, big long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([(999, AT + dt.timedelta(seconds=1), "a", 1)], "event_id long, timestamp timestamp, key string, big long").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema("event_id long, timestamp timestamp, key string, big long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streams.limit_stream(stream, ["key"], 300, "10 days").writeStream.foreachBatch(sinks.each_batch(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()
    assert sorted(r.event_id for r in found) == plain_greedy([r[:3] for r in rows], 300)
    assert {(r.event_id, r.timestamp, r.key, r.big) for r in found} <= set(rows)
