"""Work batch by batch: exact cooldown out of order, sums of fits, sketches; blocks of hours, selected splits, pages."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast import config as C
from gridcast.models import additive as ADD
from gridcast.models import autoregressive as AR
from gridcast.models import sums as SU
from gridcast.models.ridge import Sums
from gridcast.operators import alerts as AL
from gridcast.operators import align as J
from gridcast.operators import grid as G
from gridcast.operators import windows as WI
from gridcast.streaming import jobs as S

from test_streaming import _land

T0 = dt.datetime(2024, 1, 1)


def plain_cooldown(times, cooldown):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= dt.timedelta(seconds=cooldown):
            out.append(t)
            last = t
    return out


def alert_times(rnd, n, span):
    times = [T0 + dt.timedelta(microseconds=rnd.randrange(span * 1_000_000)) for _ in range(n)]
    return times + rnd.sample(times, n // 10)                           # some at the same instant


@pytest.mark.parametrize("block_alerts", [1, 7, 100_000])
def test_cooldown_by_blocks(spark, block_alerts):
    """Blocks of one cooldown, of a few, and one for all give the plain answer, in bursts and over long gaps."""
    rnd = random.Random(3)
    rows = [("a", t) for t in alert_times(rnd, 600, 40_000)] + [("b", t) for t in alert_times(rnd, 60, 4_000_000)]
    rows += [("c", T0 + dt.timedelta(seconds=k)) for k in range(0, 4000, 7)] + [(None, T0), ("d", None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "series_id string, timestamp timestamp_ntz, n int")
    got = AL.dedupe_alerts(df, 300, block_alerts=block_alerts)
    assert got.count() == len(rows)
    for s in "abc":
        mine = sorted(r["timestamp"] for r in got.where((F.col("series_id") == s) & F.col("admitted")).collect())
        assert mine == plain_cooldown([t for k, t in rows if k == s], 300)
    assert got.where("admitted and (series_id is null or timestamp is null)").count() == 0


def test_stream_admits_exactly_out_of_order(spark, tmp):
    """Files out of order within the delay: what the watermark has passed equals the plain cooldown, whichever file a row came in."""
    rnd = random.Random(8)
    rows = [("a", t, float(i)) for i, t in enumerate(alert_times(rnd, 500, 30_000))] + [("b", t, 1.0) for t in alert_times(rnd, 80, 30_000)]
    landed = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rnd.random() * 3000))
    cut = [landed[k:k + 100] for k in range(0, len(landed), 100)]
    _land(f"{tmp}/in", cut, ["series_id", "ds", "load_mw"])
    stream = spark.readStream.schema("series_id string, ds timestamp, load_mw double").option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    with S.rocksdb_state(spark):
        q = S.stream_admit_alerts(stream, 300, "3600 seconds").writeStream.format("parquet").option("path", f"{tmp}/out").option(
            "checkpointLocation", f"{tmp}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.conf.get(S.STATE_STORE) != S.ROCKSDB
    got = [(r["series_id"], r["ds"].replace(tzinfo=None), r["load_mw"]) for r in spark.read.parquet(f"{tmp}/out").collect()]
    newest = max(t for _, t, _ in rows)
    passed = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - dt.timedelta(seconds=3600)
    for s in "ab":
        want = [t for t in plain_cooldown([t for k, t, _ in rows if k == s], 300) if t <= passed]
        assert sorted(t for k, t, _ in got if k == s) == want and len(want) > 20
    smallest = {}
    for s, t, v in rows:
        smallest[s, t] = min(v, smallest.get((s, t), v))
    assert all(v == smallest[s, t] for s, t, v in got)


def hours(spark, n, series=("a", "b"), skip=lambda s, h: False, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(s, T0 + dt.timedelta(hours=h), float(15 + 4 * np.sin(h / 24 * 2 * np.pi) + rng.normal() + h / 200), float(20 + rng.normal()))
            for s in series for h in range(n) if not skip(s, h)]
    return spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, load_mw double, temp_c double")


def _models(df, names):
    return {r["series_id"]: [np.array(r[c], float) for c in names] for r in df.collect()}


def test_fit_from_batches_equals_fit_from_history(spark, tmp):
    df = hours(spark, 400, skip=lambda s, h: s == "b" and (h % 37 == 5 or 200 < h < 230)).cache()
    hour = F.timestamp_diff("HOUR", F.lit(T0.isoformat()).cast("timestamp_ntz"), F.col("ds"))
    ends = [0, 90, 110, 300, 400]
    for b, (low, high) in enumerate(zip(ends, ends[1:])):
        SU.add_batch(df.where((hour >= low) & (hour < high)), b, f"{tmp}/s", frame_days=399 / 24)
    SU.add_batch(df.where((hour >= 110) & (hour < 300)), 2, f"{tmp}/s", frame_days=399 / 24)       # a replayed batch replaces itself
    both = {"autoregressive": AR.fit_autoregressive(df, df.select("series_id", "ds", "temp_c")), "additive": ADD.fit_additive(df)}
    for model, whole in both.items():
        parts = SU.fit_from_sums(spark, f"{tmp}/s", model)
        a, b = (_models(m, ["coef", "sigma", "n"]) for m in (parts, whole))
        for s in "ab":
            assert a[s][2] == b[s][2]
            assert np.allclose(a[s][0], b[s][0], atol=1e-6) and np.allclose(a[s][1], b[s][1], rtol=1e-6)
    before = _models(SU.fit_from_sums(spark, f"{tmp}/s", "autoregressive"), ["coef", "n"])
    SU.compact(spark, f"{tmp}/s", 1)
    SU.compact(spark, f"{tmp}/s", 2)
    after = _models(SU.fit_from_sums(spark, f"{tmp}/s", "autoregressive"), ["coef", "n"])
    assert all(np.allclose(before[s][0], after[s][0], atol=1e-9) and before[s][1] == after[s][1] for s in "ab")


def test_autoregression_against_plain_least_squares(spark):
    df = hours(spark, 300, ("a",), lambda s, h: h in (50, 51, 160))
    rows = {r["ds"]: r for r in df.collect()}
    load = np.array([r["load_mw"] for r in rows.values()])
    temp = np.array([r["temp_c"] for r in rows.values()])
    low, span = load.min(), np.ptp(load)
    x, y = [], []
    for t, r in rows.items():
        lags = [rows.get(t - dt.timedelta(hours=k)) for k in range(24, 0, -1)]
        if all(lags):
            hs = [np.sin(2 * np.pi * q.hour / 24) for q in rows]
            hc = [np.cos(2 * np.pi * q.hour / 24) for q in rows]
            wd = [q.weekday() / 6 for q in rows]
            scale = [(v - min(a)) / (max(a) - min(a)) for v, a in ((r["temp_c"], temp), (np.sin(2 * np.pi * t.hour / 24), hs),
                                                                   (np.cos(2 * np.pi * t.hour / 24), hc), (t.weekday() / 6, wd))]
            x.append([1.0, *[(q["load_mw"] - low) / span for q in lags], *scale])
            y.append((r["load_mw"] - low) / span)
    x, y = np.array(x), np.array(y)
    want = np.linalg.solve(x.T @ x + np.diag(AR.penalties()), x.T @ y)
    got = AR.fit_autoregressive(df, df.select("ds", "temp_c")).first()
    assert got["n"] == len(y) and np.allclose(got["coef"], want, atol=1e-7)


def test_laplace_prior_meets_its_conditions_and_is_sparse():
    rng = np.random.default_rng(4)
    days = np.arange(600) / 24
    daily = (("daily", 1.0, 3),)
    x = ADD.design_matrix(days, 0.0, days[-1], seasonalities=daily)
    y = 15 + 3 * np.maximum(days / days[-1] - 0.4, 0) * 5 + rng.normal(size=len(days))
    sums = Sums(np.r_[(x.T @ x)[np.triu_indices(x.shape[1])], x.T @ y, y @ y, len(y)], x.shape[1])
    b, sigma, weight = ADD.additive_solver("laplace", seasonalities=daily)(sums, {})
    at = ADD.changepoint_columns()
    pen = np.array(ADD.penalties(seasonalities=daily))
    pen[at.start:at.stop] = 0
    g = x.T @ (y - x @ b) - pen * b
    d = b[at.start:at.stop]
    inside = g[at.start:at.stop]
    scale = np.abs(x.T @ y).max()
    assert np.abs(np.delete(g, np.r_[at.start:at.stop])).max() < 1e-8 * scale
    assert (np.abs(inside) <= weight + 1e-8 * scale).all() and np.allclose(inside[d != 0], np.sign(d[d != 0]) * weight, atol=1e-8 * scale)
    assert 0 < (d != 0).sum() < len(d) / 2 and abs(sigma - 1) < 0.2


def test_sampled_band_is_repeatable_wider_ahead_and_covers(spark):
    df = hours(spark, 700)
    daily = (("daily", 1.0, 3),)
    model = ADD.fit_additive(df.where(F.col("ds") < F.lit("2024-01-26").cast("timestamp_ntz")), seasonalities=daily).cache()
    one, two = (sorted(map(tuple, ADD.forecast_additive(model, 72, band="sampled", generated_at="2024-02-01", seasonalities=daily).collect()))
                for _ in range(2))
    assert one == two
    fc = ADD.forecast_additive(model, 72, band="sampled", seasonalities=daily)
    both = J.align_actuals(fc, df.select("series_id", "ds", "load_mw"))
    share = both.select(F.avg(F.col("actual").between(F.col("lower_mw"), F.col("upper_mw")).cast("double"))).first()[0]
    assert 0.6 < share <= 1.0
    coef = np.r_[0.0, 0.0, np.full(25, 0.5)]
    band = ADD.trend_quantiles(coef, 0.0, 30.0, 0.1, 30.0, 30.0 + np.arange(1, 721) / 24, 5)
    width = band[1] - band[0]
    assert width[-1] > 3 * width[0] and abs(width[0] - 2 * 1.2816 * 0.1) < 0.03


def test_sketch_bounds_by_batches(spark, tmp):
    values = [float(v) for v in np.random.default_rng(2).normal(size=9000)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "series_id string, i int, load double")
    for b in (0, 1, 1, 2):                                               # batch 1 comes twice
        S.update_sketches(df.where(F.floor(F.col("i") / 3000) == b), b, f"{tmp}/k")
    r = S.sketch_bounds(spark, f"{tmp}/k").first()
    assert r["_n"] == 9000
    for p, q in ((0.01, r["_lo"]), (0.99, r["_hi"])):
        assert abs(np.mean(np.array(values) <= q) - p) <= S.RANK_ERROR
    assert S.sketch_bounds(spark, f"{tmp}/k", 0).first()["_n"] == 3000


def test_blocks_of_hours_change_nothing(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(s, T0 + dt.timedelta(hours=h), float(h)) for s in "ab" for h in sorted(rnd.sample(range(900), 300))]
    df = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, load double")
    for width in (10, 50, 10_000):
        got = G._gap_expand(df, "series_id", "ds", ["load"], width)
        for s in "ab":
            mine = {t: v for k, t, v in rows if k == s}
            grid = {r["ds"]: r["load"] for r in got.where(F.col("series_id") == s).collect()}
            t = min(mine)
            want = {}
            while t <= max(mine):
                want[t] = mine.get(t)
                t += dt.timedelta(hours=1)
            assert grid == want and got.where(F.col("series_id") == s).count() == len(want)
    spine = G.hourly_spine(df).cache()
    plain = None
    for width in (30, 10_000):
        monkeypatch.setattr(WI, "BLOCK_H", width)
        lags = sorted(map(str, WI.lag_features(spine, "load", (1, 5, 24)).collect()))
        seqs = sorted(map(str, WI.make_sequences(spine, ["load"], 3).collect()))
        assert plain is None or plain == (lags, seqs)
        plain = lags, seqs


@pytest.mark.parametrize("bucket", [1, 16, 1024])
def test_times_are_selected_by_counting(spark, monkeypatch, bucket):
    monkeypatch.setattr(WI, "BUCKET_H", bucket)
    rnd = random.Random(9)
    rows = {s: sorted(rnd.sample(range(3000), n)) for s, n in (("a", 400), ("b", 3), ("c", 1))}
    df = spark.createDataFrame([(s, T0 + dt.timedelta(hours=h)) for s, hs in rows.items() for h in hs], "series_id string, ds timestamp_ntz")
    got = {r["series_id"]: r for r in WI.times_at(df, {"cut": lambda n: F.floor(n * 0.8), "last": lambda n: n}).collect()}
    for s, hs in rows.items():
        k = int(len(hs) * 0.8)
        assert got[s]["cut"] == (T0 + dt.timedelta(hours=hs[k - 1]) if k else None)
        assert got[s]["last"] == T0 + dt.timedelta(hours=hs[-1])


def test_pages_of_an_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v"))
    index = G.PageIndex(df, ("k",), ranges=8)
    assert index.total == 1000 and len(index.starts) > 1
    for offset, length in ((0, 10), (333, 200), (990, 50), (1000, 5), (5000, 5), (5, 0)):
        assert [r["k"] for r in index.page(offset, length).collect()] == list(range(1000))[offset:offset + length]
    assert G.page(df.limit(0), 0, 5, ("k",)).collect() == []


def test_asof_by_series_and_shared(spark):
    rnd = random.Random(2)
    rows = [(s, T0 + dt.timedelta(hours=rnd.randrange(800))) for s in "ab" for _ in range(150)]
    df = spark.createDataFrame([*rows, ("a", None)], "series_id string, ds timestamp_ntz")
    weather = [(s, T0 + dt.timedelta(minutes=rnd.randrange(48_000)), rnd.random()) for s in "ab" for _ in range(120)]
    w = spark.createDataFrame([*weather, ("a", T0, None), ("b", None, 1.0)], "series_id string, ds timestamp_ntz, temp_c double")
    for own in (True, False):
        got = J.attach_weather_asof(df, w if own else w.drop("series_id"), 5).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            near = [(t, v) for s, t, v in weather if (s == r["series_id"] or not own) and r["ds"] is not None
                    and r["ds"] - dt.timedelta(hours=5) <= t <= r["ds"]]
            assert (r["temp_c_at"], r["temp_c"]) == (max(near) if near else (None, None))


def test_request_checks(spark):
    from gridcast.models.store import valid_request, valid_request_column

    rows = [(h, m, k) for h in (0, 1, 168, 169, None) for m in ("prophet", "lstm", "arima", None) for k in (0, 1, 100, 101)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("h", T.IntegerType()), T.StructField("m", T.StringType()), T.StructField("k", T.IntegerType())]))
    for r in df.withColumn("ok", valid_request_column(F.col("h"), F.col("m"), F.col("k"))).collect():
        try:
            valid_request(r["h"], r["m"], r["k"])
            fine = True
        except (ValueError, TypeError):
            fine = False
        assert r["ok"] == fine
    assert C.MAX_HORIZON_H == 168
