"""Load-shedding schedule: known answers and a sequential reference loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridcast.operators import alerts as AL

PEAK = dt.datetime(2024, 1, 5, 18, 0)


def loop_schedule(p, t, n=5):
    """The sequential definition, written plainly."""
    excess, per = max(0.0, p - t), p / n
    start, rem, out = PEAK - dt.timedelta(hours=1), excess, []
    for k in range(1, n + 1):
        if rem <= 0:
            break
        z = min(per, rem)
        d = max(0.5, round(z / per * 2, 1))
        end = start + dt.timedelta(hours=d)
        out.append((k, start, end, d, z))
        rem -= z
        start = end
    return out


def _run(spark, values, t):
    df = spark.createDataFrame([(f"s{i}", PEAK, float(v)) for i, v in enumerate(values)],
                               "series_id string, peak_ds timestamp_ntz, peak_mw double")
    return AL.shed_schedule(df, t).withColumn("zone_load", F.col("load_mw")).collect()


def test_known_answers(spark):
    rows = _run(spark, [25.0], 20.0)
    assert len(rows) == 1
    r = rows[0]
    assert (r.zone, r.priority, r.duration_hrs, r.load_mw) == ("Houston Zone (ERCOT-H)", 1, 2.0, 5.0)
    assert (r.start, r.end) == ("17:00", "19:00")
    rows = sorted(_run(spark, [33.334], 20.0), key=lambda r: r.priority)
    assert [r.duration_hrs for r in rows] == [2.0, 2.0, 0.5]
    assert [r.load_mw for r in rows] == [6.67, 6.67, 0.0]
    assert [(r.start, r.end) for r in rows] == [("17:00", "19:00"), ("19:00", "21:00"), ("21:00", "21:30")]
    assert _run(spark, [20.0], 20.0) == []


def test_matches_loop(spark):
    rnd = random.Random(7)
    values = [rnd.uniform(10, 50) for _ in range(300)] + [20.0, 24.0, 40.0, 50.0, 13.0]
    for t in (13.0, 20.0):
        got = {}
        for r in _run(spark, values, t):
            got.setdefault(r.series_id, []).append((r.priority, r.start_ts, r.end_ts, r.duration_hrs))
        for i, v in enumerate(values):
            want = [(k, s, e, d) for k, s, e, d, _ in loop_schedule(v, t)]
            assert sorted(got.get(f"s{i}", [])) == want, (v, t)


def test_loads_sum_to_excess(spark):
    df = spark.createDataFrame([("a", PEAK, 37.5)], "series_id string, peak_ds timestamp_ntz, peak_mw double")
    rows = AL.shed_schedule(df, 13.0).collect()
    assert abs(sum(r.load_mw for r in rows) - 24.5) < 0.02


def test_zones_from_table(spark):
    zones = spark.createDataFrame([("B", 2), ("A", 1)], "zone string, priority int")
    df = spark.createDataFrame([("a", PEAK, 30.0)], "series_id string, peak_ds timestamp_ntz, peak_mw double")
    rows = sorted(AL.shed_schedule(df, 10.0, zones).collect(), key=lambda r: r.priority)
    assert [r.zone for r in rows] == ["A", "B"]
    assert [r.load_mw for r in rows] == [15.0, 5.0]


def test_alert_texts(spark):
    df = spark.createDataFrame([("a", PEAK, 40.0)], "series_id string, peak_ds timestamp_ntz, peak_mw double")
    sched = AL.shed_schedule(df, 5.0)
    msg = AL.alert_messages(sched, ["series_id"]).collect()[0]
    assert msg.sms_body == ("[TEXAS ERCOT ENERGY ALERT]\nPredicted peak: 40.0 MW at 2024-01-05T18:00\n"
                            "Load shedding: Houston Zone (ERCOT-H), North Zone (ERCOT-N), West Zone (ERCOT-W) +2 more\n"
                            "Reduce usage where possible.")
    assert msg.subject == "[ALERT] Texas ERCOT grid peak 40.0 MW forecast — 2024-01-05"
    lines = AL.schedule_lines(sched, ["series_id"]).collect()[0]
    assert lines.zones == 5 and lines.lines.splitlines()[0] == "Houston Zone (ERCOT-H) | 17:00 | 19:00 | 2.0h"
