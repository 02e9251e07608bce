"""Properties from the test strategy: keyed results do not depend on the other series; adverse data."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridcast.models import additive as ADD
from gridcast.models import autoregressive as AR
from gridcast.models import store as ST
from gridcast.operators import alerts as AL
from gridcast.operators import prep as PR
from gridcast.plans import evaluation as EV

T0 = dt.datetime(2024, 1, 1)


def _series(spark, spec):
    rows = []
    for sid, n, seed in spec:
        rng = np.random.default_rng(seed)
        for i in range(n):
            rows.append((sid, T0 + dt.timedelta(hours=i), float(np.round(12 + 10 * rng.random(), 3))))
    return spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, load_mw double")


def test_scored_alone_equals_scored_among_many(spark):
    many = _series(spark, [("a", 400, 1), ("b", 300, 2), ("c", 250, 3)])
    alone = many.where(F.col("series_id") == "a")
    m_many = {r.model: r for r in EV.evaluate(many).where(F.col("series_id") == "a").collect()}
    m_alone = {r.model: r for r in EV.evaluate(alone).collect()}
    assert set(m_many) == set(m_alone) == {"seasonal_naive", "profile", "ensemble"}
    for k in m_many:
        assert m_many[k].n == m_alone[k].n
        assert abs(m_many[k].mae - m_alone[k].mae) < 1e-9 and abs(m_many[k].mape - m_alone[k].mape) < 1e-9
    r_many = {r.ds: r.load_mw for r in PR.rescale_minmax(many.withColumnRenamed("load_mw", "load"))
              .where(F.col("series_id") == "a").collect()}
    r_alone = {r.ds: r.load_mw for r in PR.rescale_minmax(alone.withColumnRenamed("load_mw", "load")).collect()}
    assert r_many == r_alone


def test_short_series_falls_back(spark):
    df = _series(spark, [("long", 24 * 8, 4), ("short", 10, 5)])
    ar_model = AR.fit_autoregressive(df, None)
    assert {r.series_id for r in ar_model.collect()} == {"long"}     # fewer than 25 rows: no AR model
    pref = AR.forecast_autoregressive(ar_model, df, 6)
    fb = ADD.forecast_additive(ADD.fit_additive(df), 6)
    got = {(r.series_id, r.model) for r in ST.fallback_model(pref, fb).collect()}
    assert got == {("long", "autoregressive"), ("short", "additive")}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=0.5, max_value=60.0, allow_nan=False), min_size=1, max_size=8),
       st.floats(min_value=5.0, max_value=40.0))
def test_schedule_covers_excess(spark, peaks, threshold):
    df = spark.createDataFrame([(f"s{i}", T0, float(p)) for i, p in enumerate(peaks)],
                               "series_id string, peak_ds timestamp_ntz, peak_mw double")
    got = {}
    for r in AL.shed_schedule(df, threshold).collect():
        got.setdefault(r.series_id, []).append(r)
    for i, p in enumerate(peaks):
        rows = sorted(got.get(f"s{i}", []), key=lambda r: r.priority)
        excess = max(0.0, p - threshold)
        assert abs(sum(r.load_mw for r in rows) - min(excess, p)) <= 0.005 * len(rows) + 1e-9
        assert all(0.5 <= r.duration_hrs <= 2.0 for r in rows)
        assert all(a.end_ts == b.start_ts for a, b in zip(rows, rows[1:]))
