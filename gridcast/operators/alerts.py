"""Threshold breaches, peaks, the load-shedding schedule and alert texts.

The schedule is a closed form over the index of the (priority-ordered) zone
list, evaluated per peak row inside one projection: no shuffle and no pairing
of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import config as C
from ..functions import add_hours, add_minutes, display_time, fixed_text, hhmm, not_missing, rnd, utc_now

def js_number(x: float) -> str:
    """A number as a dashboard prints it (``20`` not ``20.0``)."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


# --------------------------------------------------------------------------- P18 / A7 / A8
def breaches(df: DataFrame, threshold: float, value: str = "predicted_mw", flag: str | None = "alert") -> DataFrame:
    """Rows flagged as alerts or at/above the threshold."""
    cond = F.col(value) >= F.lit(float(threshold))
    if flag and flag in df.columns:
        cond = F.coalesce(F.col(flag), F.lit(False)) | cond
    return df.where(cond)


def forecast_peak(df: DataFrame, keys, value: str = "predicted_mw", ts: str = "ds", carry=()) -> DataFrame:
    """Row of maximum ``value`` per group; ties go to the earliest ``ts``.

    ``min_by`` over ``(-value, ts)`` is a partial (map-side) aggregate, so a
    large group never has to be sorted or gathered in one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    payload = F.struct(F.col(ts).alias("peak_ds"), F.col(value).alias("peak_mw"), *[F.col(c) for c in carry])
    order = F.struct((-F.col(value)).alias("neg"), F.col(ts).alias("ts"))
    return (
        df.where(not_missing(value))
        .groupBy(*keys)
        .agg(F.min_by(payload, order).alias("_p"))
        .select(*keys, "_p.*")
    )


def alert_hours(df: DataFrame, threshold: float, keys, value: str = "predicted_mw") -> DataFrame:
    """Hours at or above the threshold, hours in total and the peak value per group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(
        F.count_if(F.col(value) >= F.lit(float(threshold))).alias("alert_hours"),
        F.count(F.col(value)).alias("hours"),
        F.max(value).alias("peak_mw"),
    )


# --------------------------------------------------------------------------- W8
def _sorted_zones() -> Column:
    """All zones of a group as ``ARRAY<STRUCT<priority, zone>>`` in priority order."""
    return F.array_sort(F.collect_list(F.struct(F.col("priority").cast("int").alias("priority"),
                                                F.col("zone").cast("string").alias("zone"))))


def zone_list(zones: DataFrame | None = None) -> Column:
    """One zone list for all series, as an ``ARRAY<STRUCT<priority, zone>>`` in priority order.

    A zone table becomes a scalar subquery: one aggregated row that is
    computed with the query, not while it is built. Without a table the fixed zones are used.
    """
    if zones is not None:
        return zones.agg(_sorted_zones().alias("zones")).scalar()
    rows = sorted((int(p), z) for z, p in C.ZONES)
    return F.array(*[F.struct(F.lit(p).cast("int").alias("priority"), F.lit(z).alias("zone")) for p, z in rows])


def keyed_zone_lists(zones: DataFrame, key: str = "series_id") -> DataFrame:
    """Per-series zone lists ``(key, zones ARRAY<STRUCT<priority, zone>>)`` sorted by priority."""
    return zones.groupBy(key).agg(_sorted_zones().alias("_zones"))


FULL_SHARE_MIN = 120   # minutes a zone is off when it takes its whole share


def _shed_rows(peak: Column, threshold: Column, zones: Column) -> Column:
    """The zones that are shed, as an array in priority order.

    Zone ``i`` (from 0) is needed when ``i`` whole shares leave excess over;
    every zone before it then took a whole share, for two hours each.
    """
    share = F.try_divide(peak, F.size(zones).cast("double"))   # an empty zone list sheds nothing
    excess = F.greatest(F.lit(0.0), peak - threshold)

    def row(z, i):
        load = F.least(share, excess - share * i)
        hours = F.greatest(F.lit(0.5), rnd(load / share * F.lit(2.0), 1))
        return F.struct(z["zone"].alias("zone"), z["priority"].alias("priority"), load.alias("zone_load"), hours.alias("duration_hrs"),
                        (i * FULL_SHARE_MIN).cast("int").alias("offset_min"), F.round(hours * F.lit(60.0), 0).cast("int").alias("duration_min"))

    return F.filter(F.transform(zones, row), lambda r: r["zone_load"] > 0)


def shed_schedule(peaks: DataFrame, threshold: float, zones: DataFrame | None = None, keys=("series_id",),
                  ts: str = "peak_ds", value: str = "peak_mw", zones_by_key: str | None = None) -> DataFrame:
    """Load-shedding schedule for each peak row.

    ``excess = max(0, p - t)``, ``per = p / n_zones``; zones in priority
    order take ``min(per, remaining)`` until the excess is covered; duration
    ``max(0.5, round(load / per * 2, 1))`` hours; the first zone starts one
    hour before the peak and each next zone when the previous one ends.
    ``zones`` is either one list for every series (a scalar subquery) or,
    with ``zones_by_key``, a table keyed by that column (equi-joined); a
    series that the table does not list is shed by the fixed zones.
    Output: one row per shed zone with full timestamps and ``HH:MM`` text.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if zones_by_key:
        lists = keyed_zone_lists(zones, zones_by_key)
        base = peaks.join(lists, zones_by_key, "left").withColumn("_zones", F.coalesce("_zones", zone_list()))
    else:
        base = peaks.withColumn("_zones", zone_list(zones))
    start0 = add_hours(F.col(ts), -1)
    out = base.select(
        *[c for c in peaks.columns],
        F.inline(_shed_rows(F.col(value), F.lit(float(threshold)), F.col("_zones"))),
    )
    start = add_minutes(start0, F.col("offset_min"))
    end = add_minutes(start0, F.col("offset_min") + F.col("duration_min"))
    return out.select(
        *peaks.columns,
        "zone", "priority",
        start.alias("start_ts"), end.alias("end_ts"),
        hhmm(start).alias("start"), hhmm(end).alias("end"),
        "duration_hrs",
        rnd(F.col("zone_load"), 2).alias("load_mw"),
    )


def shed_array(schedule: DataFrame, keys) -> DataFrame:
    """Schedule rows gathered back into one ``ARRAY<STRUCT>`` per alert (bounded by the zone count)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    item = F.struct("priority", "zone", "start", "end", "duration_hrs", "load_mw")
    return schedule.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("shed_schedule"))


# --------------------------------------------------------------------------- P21-P25


def status_line(counts: DataFrame, threshold: float) -> DataFrame:
    """Dashboard status from :func:`alert_hours` rows: safe, or ``ALERT — n hour(s) ... above t MW``."""
    t = js_number(threshold)
    text = F.when(F.col("alert_hours") == 0, F.lit(C.STATUS_OK)).otherwise(
        F.format_string(f"ALERT — %d hour(s) forecast above {t} MW", F.col("alert_hours"))
    )
    return counts.withColumn("status", text)


def alert_messages(schedule: DataFrame, keys, ts: str = "peak_ds", value: str = "peak_mw") -> DataFrame:
    """SMS body and e-mail subject per alert from its schedule rows.

    Zones text is the first three zones (priority order) and ``+n more``.
    The time is ISO text cut to minutes (body) or to the date (subject).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    grouped = schedule.groupBy(*keys, ts, value).agg(
        F.array_sort(F.collect_list(F.struct("priority", "zone"))).alias("_z")
    )
    names = F.transform(F.slice("_z", 1, 3), lambda s: s["zone"])
    extra = F.size("_z") - 3
    zones_text = F.concat(
        F.array_join(names, ", "),
        F.when(extra > 0, F.format_string(C.MORE_ZONES_TEXT, extra)).otherwise(F.lit("")),
    )
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    p1 = fixed_text(value, 1)
    head, at, shed, tail = (F.lit(t) for t in C.SMS_TEXT)
    body = F.concat(head, p1, at, F.substring(iso, 1, 16), shed, zones_text, tail)
    title, day = (F.lit(t) for t in C.SUBJECT_TEXT)
    subject = F.concat(title, p1, day, F.substring(iso, 1, 10))
    return grouped.select(*keys, ts, value, body.alias("sms_body"), subject.alias("subject"), zones_text.alias("zones_text"))


def schedule_lines(schedule: DataFrame, keys) -> DataFrame:
    """One plain-text line per shed zone (``zone | start | end | 1.5h``) joined per alert."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    line = F.concat_ws(" | ", "zone", "start", "end", F.concat(fixed_text("duration_hrs", 1), F.lit("h")))
    return schedule.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", line.alias("l")))), lambda s: s["l"]),
                     "\n").alias("lines"),
        F.count(F.lit(1)).alias("zones"),
    )


def forecast_table(df: DataFrame, threshold: float, only_alerts: bool = False, sort_key: str = "ds",
                   ascending: bool = True, search: str | None = None, value: str = "predicted_mw") -> DataFrame:
    """Dashboard table: optional alert filter, label, display time, case-insensitive search, sort."""
    t = F.lit(float(threshold))
    out = df.withColumns({
        "time_label": display_time("ds"),
        "status": F.when(F.col(value) >= t, F.lit("Alert")).otherwise(F.lit("Normal")),
    })
    if only_alerts:
        out = out.where(F.col(value) >= t)
    if search:
        text = F.lower(F.concat_ws(" ", "time_label", fixed_text(value, 2), fixed_text("lower_mw", 2),
                                   fixed_text("upper_mw", 2), "status"))
        out = out.where(text.contains(search.lower()))
    order = F.col(sort_key).asc() if ascending else F.col(sort_key).desc()
    return out.orderBy(order)


# --------------------------------------------------------------------------- S10 / T2
def alert_payload(forecast: DataFrame, schedule: DataFrame, threshold: float, keys=("series_id",),
                  triggered_at=None, district: str = C.DISTRICT) -> DataFrame:
    """Nested alert event per series: peak, the forecast window and the shed schedule.

    The forecast window of a series is bounded by the horizon (at most 168
    rows), so gathering it into one array per series is bounded.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    fc = forecast.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ds", "predicted_mw", "lower_mw", "upper_mw", "alert", "model")))
        .alias("forecast_window")
    )
    pk = forecast_peak(breaches(forecast, threshold), keys, carry=("model",))
    sched = shed_array(schedule, keys)
    trig = F.lit(triggered_at).cast("timestamp_ntz") if triggered_at is not None else utc_now()
    return (
        pk.join(fc, keys, "inner").join(sched, keys, "left")
        .select(
            *keys,
            F.lit("peak_load_alert").alias("event"),
            F.lit(district).alias("district"),
            trig.alias("triggered_at"),
            F.lit(float(threshold)).alias("threshold_mw"),
            F.struct(F.col("peak_ds").alias("timestamp"), F.col("peak_mw").alias("predicted_mw"), "model").alias("peak"),
            "forecast_window",
            F.coalesce("shed_schedule", F.array().cast("array<struct<priority:int,zone:string,start:string,end:string,duration_hrs:double,load_mw:double>>")).alias("shed_schedule"),
        )
    )


def recent_alerts(log: DataFrame, limit: int = 20, order=("timestamp",)) -> DataFrame:
    """Newest ``limit`` alert events (1..100) with the count of the whole log on each row.

    ``order`` columns are sorted descending (later columns break ties); the
    top-k is a ``TakeOrderedAndProject`` (per-task top ``limit``), and the
    count is of the whole log, not of the page.
    """
    if not 1 <= int(limit) <= C.MAX_ALERT_LIMIT:
        raise ValueError("limit must be in 1..100")
    total = log.agg(F.count("*").alias("n")).scalar()
    top = log.orderBy(*[F.col(c).desc() for c in order]).limit(int(limit))
    return top.withColumn("total", total)


def freshness(df: DataFrame, now, within_s: int = 300, key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Age in seconds of each series' newest row at ``now`` and the "just completed" flag."""
    newest = df.groupBy(key).agg(F.max(ts).alias("newest"))
    age = F.timestamp_diff("SECOND", F.col("newest"), F.lit(now).cast("timestamp_ntz"))
    return newest.select(key, "newest", age.alias("age_s"), (age < F.lit(int(within_s))).alias("just_completed"))


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch; wall-clock (session-zone independent) for ``TIMESTAMP_NTZ``."""
    if dict(df.dtypes).get(ts) == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(F.col(ts).cast("timestamp"))


# --------------------------------------------------------------------------- R3 (batch)
BLOCK_ALERTS = 100_000   # alerts of a block where they are densest


def _exits(cool: int, length: int, keys: list[str], schema: pa.Schema):
    """For one block of a key: each alert that can be its first admitted one, with the last admitted one that follows from it."""
    def run(table: pa.Table) -> pa.Table:
        t = np.sort(table.column("_t").to_numpy())
        start = table.column("_b")[0].as_py() * length
        first = int(np.searchsorted(t, start + cool)) + 1                # those within a cooldown of the border, and the next one
        follower = np.searchsorted(t, t + cool)
        at = np.arange(min(first, len(t)))
        while True:
            moved = np.where(follower[at] < len(t), follower[at], len(t))
            if (moved == len(t)).all():
                break
            at = np.where(moved < len(t), moved, at)
        n = min(first, len(t))
        same = [pa.array([table.column(k)[0].as_py()] * n, schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*same, pa.array([table.column("_b")[0].as_py()] * n, pa.int64()), pa.array(t[:n]), pa.array(t[at]),
                                     pa.array([int(t[0])] * n, pa.int64()), pa.array([int(t[-1])] * n, pa.int64())], schema=schema)

    return run


def _walk(cool: int, schema: pa.Schema):
    """For one block of a key and its first admitted alert: all that are admitted."""
    def run(table: pa.Table) -> pa.Table:
        t = np.sort(table.column("_t").to_numpy())
        taken, at = [], int(np.searchsorted(t, table.column("_c")[0].as_py()))
        while at < len(t):
            taken.append(at)
            at = int(np.searchsorted(t, t[at] + cool))
        same = [pa.array([table.column(f.name)[0].as_py()] * len(taken), f.type) for f in schema if f.name != "_t"]
        return pa.Table.from_arrays([*same, pa.array(t[taken])], schema=schema)

    return run


def dedupe_alerts(alerts: DataFrame, cooldown_s: int = C.ALERT_COOLDOWN_S, keys=("series_id",),
                  ts: str = "timestamp", block_alerts: int = BLOCK_ALERTS) -> DataFrame:
    """Flag ``admitted``: at least ``cooldown_s`` seconds since the last *admitted* alert of the key.

    Exact, and no step needs all rows of one key in one task:

    1. Time is cut into blocks of whole cooldowns, as long as ``block_alerts``
       alerts allow where they are densest. What came before a block only
       decides which alert is its first admitted one, and that one lies
       within a cooldown of the block's start or is the next after it. Each
       block is folded to a map from these entries to the last admitted alert.
    2. From there the first alert after the cooldown is an entry of the next
       block, or the first alert of a later one: a jump table over entries.
    3. Blocks that begin a cooldown after the alert before them have a sure
       entry. The others' follow by pointer doubling over the jump table, in
       log2 of the longest run of blocks rounds. Only entries are written and
       doubled, never the alerts.
    4. Each block with an entry is walked once, and the alerts are flagged.

    Alerts at the same instant as an admitted one are not admitted (0 s);
    alerts without a key or a time never are.
    """
    from ..session import materialize

    keys = [keys] if isinstance(keys, str) else list(keys)
    cool = int(cooldown_s) * 1_000_000
    base = alerts.withColumn("_t", epoch_micros(alerts, ts))
    times = base.where(F.col("_t").isNotNull()).select(*keys, "_t").distinct()
    dense = times.groupBy(*keys, F.floor(F.col("_t") / F.lit(cool))).count().agg(F.max("count").alias("n")).first()["n"] or 1
    length = cool * max(1, min(int(block_alerts) // dense, 1 << 20))
    ev = times.withColumn("_b", F.floor(F.col("_t") / F.lit(length)))

    key_fields = [ev.schema[k] for k in keys]
    key_types = [(f.name, to_arrow_type(f.dataType)) for f in key_fields]
    longs = ["_b", "_c", "_e", "_tmin", "_tmax"]
    entry_schema = T.StructType(key_fields + [T.StructField(c, T.LongType()) for c in longs])
    entry_arrow = pa.schema([*key_types, *[(c, pa.int64()) for c in longs]])
    entries = materialize(ev.groupBy(*keys, "_b").applyInArrow(_exits(cool, length, keys, entry_arrow), entry_schema))

    # the entry of the next block that follows from an exit: the first at or after exit + cooldown
    cand = entries.select(*keys, "_b", F.col("_c").alias("_time"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_src"))
    probe = entries.select(*keys, (F.col("_b") + 1).alias("_b"), (F.col("_e") + F.lit(cool)).alias("_time"), F.lit(1).alias("_kind"),
                           F.col("_c").alias("_src"))
    w = (Window.partitionBy(*keys, "_b").orderBy(F.col("_time").desc(), F.col("_kind").asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = (cand.unionByName(probe).withColumn("_nx", F.min(F.when(F.col("_kind") == 0, F.col("_time"))).over(w))
              .where(F.col("_kind") == 1).select(*keys, "_b", F.col("_src").alias("_c"), "_nx"))
    blocks = entries.groupBy(*keys, "_b").agg(F.min("_tmin").alias("_tmin"), F.max("_tmax").alias("_tmax"))   # one row a block
    in_order = Window.partitionBy(*keys).orderBy("_b")
    near = blocks.select(*keys, "_b", "_tmin", F.lead("_b").over(in_order).alias("_b1"), F.lead("_tmin").over(in_order).alias("_after1"),
                         F.lead("_tmin", 2).over(in_order).alias("_after2"), F.lag("_tmax").over(in_order).alias("_before"))
    beyond = F.when(F.col("_b1") == F.col("_b"), F.col("_after2")).otherwise(F.col("_after1"))
    jump = (inside.join(near.select(*keys, (F.col("_b") + 1).alias("_b"), "_b1", "_after1", "_after2"), [*keys, "_b"])
            .select(*keys, "_c", F.coalesce("_nx", beyond).alias("_to")))
    jump = materialize(jump.where(F.col("_to").isNotNull()))
    sure = F.col("_before").isNull() | (F.col("_tmin") - F.col("_before") >= F.lit(cool))
    admitted = materialize(near.where(sure).select(*keys, F.col("_tmin").alias("_c")))

    size = admitted.count()
    while True:
        moved = admitted.join(jump, [*keys, "_c"]).select(*keys, F.col("_to").alias("_c"))
        grown = materialize(admitted.unionByName(moved).distinct())
        grown_size = grown.count()
        if grown_size == size:
            break
        admitted, size = grown, grown_size
        jump = materialize(jump.alias("a").join(
            jump.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a._to") == F.col("b._c")]
        ).select(*[F.col(f"a.{k}") for k in keys], F.col("a._c"), F.col("b._to")))

    starts = admitted.withColumn("_b", F.floor(F.col("_c") / F.lit(length)))
    walked_schema = T.StructType(key_fields + [T.StructField("_t", T.LongType())])
    walked = (ev.join(starts, [*keys, "_b"]).groupBy(*keys, "_b")
              .applyInArrow(_walk(cool, pa.schema([*key_types, ("_t", pa.int64())])), walked_schema))

    # Several alerts at one instant: only the first (ordered by all their columns) can be admitted.
    others = [c for c in alerts.columns if c not in keys]
    first = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(*others)) == 1
    flagged = base.withColumn("_first", first).join(walked.withColumn("_adm", F.lit(True)), [*keys, "_t"], "left")
    return flagged.withColumn("admitted", F.coalesce(F.col("_adm") & F.col("_first"), F.lit(False))).drop(
        "_t", "_first", "_adm")
