"""DuckDB SQL for each registered query (the correctness oracle).

Written independently of the Spark plans from the same definitions. Shared
CTEs build the canonical inputs; every query is one ``WITH ... SELECT``.
Rounding is ``round(x * 10^d) / 10^d`` on both sides.
"""

from __future__ import annotations

from .. import config as C

HOURLY = """hourly_load AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ds,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS load
  FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL
  GROUP BY 1, 2)"""

BOUNDS = """bounds AS (SELECT series_id, min(ds) AS first_ds, max(ds) AS last_ds FROM hourly_load GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(first_ds, last_ds, INTERVAL 1 HOUR)) AS ds FROM bounds)"""

CAP = repr(C.PEAK_MW * C.RESCALE_CAP_FACTOR)
FLOOR = repr(C.BASE_MW * C.RESCALE_FLOOR_FACTOR)

LOAD_MW = f"""qs AS (
  SELECT series_id, quantile_cont(load, 0.01) AS lo, quantile_cont(load, 0.99) AS hi
  FROM hourly_load WHERE load IS NOT NULL AND NOT isnan(load) GROUP BY 1),
load_mw AS (
  SELECT h.series_id, h.ds, h.load,
         round(least(greatest(12.0 + coalesce((least(greatest(h.load, qs.lo), qs.hi) - qs.lo)
                                               / nullif(qs.hi - qs.lo, 0.0), 0.0) * 10.0, {FLOOR}), {CAP}) * 1000.0) / 1000.0 AS load_mw
  FROM hourly_load h JOIN qs USING (series_id))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _peaks(t: float) -> str:
    return f"""peaks AS (
  SELECT series_id, day, ds AS peak_ds, load_mw AS peak_mw FROM (
    SELECT series_id, CAST(CAST(ds AS DATE) AS TIMESTAMP) AS day, ds, load_mw,
           row_number() OVER (PARTITION BY series_id, CAST(CAST(ds AS DATE) AS TIMESTAMP) ORDER BY load_mw DESC, ds) AS rn
    FROM load_mw WHERE load_mw >= {t}) WHERE rn = 1)"""


def _schedule(t: float) -> str:
    return _peaks(t) + f""",
zones AS (SELECT r_name AS zone, r_regionkey + 1 AS priority FROM region),
alloc AS (
  SELECT p.*, z.zone, z.priority,
         p.peak_mw / (SELECT count(*) FROM zones) AS per,
         greatest(0.0, p.peak_mw - {t}) AS excess,
         row_number() OVER (PARTITION BY p.series_id, p.day ORDER BY z.priority) AS k
  FROM peaks p, zones z),
kept AS (
  SELECT *, least(per, excess - per * (k - 1)) AS zl FROM alloc WHERE excess - per * (k - 1) > 0),
dur AS (
  SELECT *, greatest(0.5, round(zl / per * 2.0 * 10.0) / 10.0) AS duration_hrs FROM kept),
mins AS (
  SELECT *, CAST(round(duration_hrs * 60.0) AS INTEGER) AS dmin,
         coalesce(sum(CAST(round(duration_hrs * 60.0) AS INTEGER)) OVER (
            PARTITION BY series_id, day ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM dur),
schedule AS (
  SELECT series_id, day, peak_ds, peak_mw, zone, priority,
         peak_ds - INTERVAL 1 HOUR + off * INTERVAL 1 MINUTE AS start_ts,
         peak_ds - INTERVAL 1 HOUR + (off + dmin) * INTERVAL 1 MINUTE AS end_ts,
         duration_hrs, round(zl * 100.0) / 100.0 AS load_mw
  FROM mins)"""


SCHEDULE_COLS = """series_id, day, peak_ds, peak_mw, zone, priority, start_ts, end_ts,
       strftime(start_ts, '%H:%M') AS start, strftime(end_ts, '%H:%M') AS "end", duration_hrs, load_mw"""

SQL: dict[str, str] = {}

SQL["hourly_load"] = _with(HOURLY) + "SELECT series_id, ds, load FROM hourly_load"

SQL["hourly_spine"] = _with(HOURLY, BOUNDS) + """SELECT g.series_id, g.ds, h.load
FROM grid g LEFT JOIN hourly_load h ON g.series_id = h.series_id AND g.ds = h.ds"""

SQL["missing_hours"] = _with(HOURLY, BOUNDS) + """SELECT g.series_id, g.ds FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM hourly_load h WHERE h.series_id = g.series_id AND h.ds = g.ds)"""

SQL["load_mw"] = _with(HOURLY, LOAD_MW) + "SELECT series_id, ds, load, load_mw FROM load_mw"

SQL["daily_peaks"] = _with(HOURLY, LOAD_MW, _peaks(20.0)) + "SELECT * FROM peaks"

SQL["shed_schedule_t20"] = _with(HOURLY, LOAD_MW, _schedule(20.0)) + f"SELECT {SCHEDULE_COLS} FROM schedule"
SQL["shed_schedule_t13"] = _with(HOURLY, LOAD_MW, _schedule(13.0)) + f"SELECT {SCHEDULE_COLS} FROM schedule"

SQL["alert_status_daily"] = _with(HOURLY, LOAD_MW) + """SELECT series_id, CAST(CAST(ds AS DATE) AS TIMESTAMP) AS day,
  CAST(count_if(load_mw >= 20.0) AS BIGINT) AS alert_hours, count(load_mw) AS hours, max(load_mw) AS peak_mw,
  CASE WHEN count_if(load_mw >= 20.0) = 0 THEN 'All forecast values within safe threshold'
       ELSE printf('ALERT — %d hour(s) forecast above 20 MW', count_if(load_mw >= 20.0)) END AS status
FROM load_mw GROUP BY 1, 2"""

SQL["alert_messages_t13"] = _with(HOURLY, LOAD_MW, _schedule(13.0)) + """, g AS (
  SELECT series_id, day, peak_ds, peak_mw, list(zone ORDER BY priority) AS zl, count(*) AS nz
  FROM schedule GROUP BY 1, 2, 3, 4),
t AS (
  SELECT *, array_to_string(zl[1:3], ', ') || CASE WHEN nz > 3 THEN printf(' +%d more', nz - 3) ELSE '' END AS zones_text,
         printf('%.1f', round(peak_mw * 10.0) / 10.0) AS p1
  FROM g)
SELECT series_id, day, peak_ds, peak_mw,
  '[TEXAS ERCOT ENERGY ALERT]' || chr(10) || 'Predicted peak: ' || p1 || ' MW at ' || strftime(peak_ds, '%Y-%m-%dT%H:%M')
    || chr(10) || 'Load shedding: ' || zones_text || chr(10) || 'Reduce usage where possible.' AS sms_body,
  '[ALERT] Texas ERCOT grid peak ' || p1 || ' MW forecast — ' || strftime(peak_ds, '%Y-%m-%d') AS subject,
  zones_text
FROM t"""

SQL["schedule_lines_t13"] = _with(HOURLY, LOAD_MW, _schedule(13.0)) + """SELECT series_id, day,
  string_agg(zone || ' | ' || strftime(start_ts, '%H:%M') || ' | ' || strftime(end_ts, '%H:%M') || ' | '
             || printf('%.1f', round(duration_hrs * 10.0) / 10.0) || 'h', chr(10) ORDER BY priority) AS lines,
  count(*) AS zones
FROM schedule GROUP BY 1, 2"""


# ----------------------------------------------------------------------------- helpers for the second group
def R(expr: str, d: int) -> str:
    return f"(round(({expr}) * 1e{d}) / 1e{d} + 0e0)"


GOOD = "load_mw IS NOT NULL AND NOT isnan(load_mw)"
EXACT_MEAN = "CAST(SUM(CAST(load_mw AS DECIMAL(38,3))) AS DOUBLE) / count(load_mw)"
EPOCH_DAYS = "((CAST(ds AS DATE) - DATE '1970-01-01') + (hour(ds) * 3600 + minute(ds) * 60 + second(ds)) / 86400e0)"
SPINE = """spine AS (SELECT g.series_id, g.ds, h.load FROM grid g
  LEFT JOIN hourly_load h ON g.series_id = h.series_id AND g.ds = h.ds)"""
COV = """cov AS (SELECT date_trunc('hour', ts) AS ds,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS temp_c
  FROM events WHERE ts IS NOT NULL GROUP BY 1)"""
LM = _with(HOURLY, LOAD_MW)

SQL["load_summary"] = LM + f"""SELECT series_id, count(*) AS rows, min(ds) AS first_ds, max(ds) AS last_ds,
  {R('min(load_mw)', 2)} AS load_min_mw, {R('max(load_mw)', 2)} AS load_max_mw,
  'ready' AS status, 'hourly demand from readings' AS source
FROM load_mw WHERE {GOOD} GROUP BY 1"""

SQL["describe_load"] = LM + f"""SELECT series_id, count(load_mw) AS count, {R('avg(load_mw)', 6)} AS mean,
  {R('stddev_samp(load_mw)', 6)} AS std, {R('min(load_mw)', 6)} AS min,
  {R('quantile_cont(load_mw, 0.25)', 6)} AS p25, {R('quantile_cont(load_mw, 0.5)', 6)} AS p50,
  {R('quantile_cont(load_mw, 0.75)', 6)} AS p75, {R('max(load_mw)', 6)} AS max
FROM load_mw WHERE {GOOD} GROUP BY 1"""

_PS = "[0.01, 0.05, 0.5, 0.95, 0.99]::DOUBLE[]"
SQL["load_quantiles"] = LM + f"""SELECT series_id, p, {R('value', 6)} AS value FROM (
  SELECT series_id, unnest({_PS}) AS p, unnest(quantile_cont(load_mw, {_PS})) AS value
  FROM load_mw WHERE {GOOD} GROUP BY series_id)"""

SQL["peak_history"] = LM + f"""SELECT series_id, load_mw AS peak_mw, ds AS peak_ds FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY load_mw DESC, ds) AS rn FROM load_mw WHERE {GOOD})
WHERE rn = 1"""

_TWO_PI = repr(2 * 3.141592653589793)
SQL["calendar_features"] = LM + f"""SELECT series_id, ds, load_mw,
  {R(f'sin({_TWO_PI} * hour(ds) / 24e0)', 6)} AS hour_sin,
  {R(f'cos({_TWO_PI} * hour(ds) / 24e0)', 6)} AS hour_cos,
  {R('(isodow(ds) - 1) / 6e0', 6)} AS weekday
FROM load_mw"""


def _fourier_sql() -> str:
    import math
    cols = []
    for name, period, order in C.SEASONALITIES:
        for k in range(1, order + 1):
            f = repr(2 * math.pi * k / period)
            cols.append(f"{R(f'sin({f} * {EPOCH_DAYS})', 6)} AS {name}_sin_{k}")
            cols.append(f"{R(f'cos({f} * {EPOCH_DAYS})', 6)} AS {name}_cos_{k}")
    return LM + "SELECT series_id, ds,\n  " + ",\n  ".join(cols) + "\nFROM load_mw"


SQL["fourier_features"] = _fourier_sql()

_SHAPE = "[" + ", ".join(repr(v) for v in C.HOURLY_SHAPE) + "]::DOUBLE[]"
_SEASON = f"CASE WHEN month(ds) IN {tuple(C.SEASON_MONTHS)} THEN {C.SEASON_FACTOR!r}::DOUBLE ELSE 1e0 END"
_WEEKEND = f"CASE WHEN isodow(ds) - 1 >= 5 THEN {C.WEEKEND_FACTOR!r}::DOUBLE ELSE 1e0 END"
_TBASE = f"CASE WHEN month(ds) IN {tuple(C.SEASON_MONTHS)} THEN {C.TEMP_BASE_WARM!r}::DOUBLE ELSE {C.TEMP_BASE_COOL!r}::DOUBLE END"
SQL["expected_profile"] = _with(HOURLY, BOUNDS) + f"""SELECT series_id, ds,
  {_SEASON} AS season_factor, {_WEEKEND} AS weekend_factor,
  {R(f'greatest(6e0, 12e0 + 10e0 * ({_SHAPE})[hour(ds) + 1] * ({_SEASON}) * ({_WEEKEND}))', 6)} AS expected_mw,
  {R(f'({_TBASE}) + 5e0 * sin((hour(ds) - 6) * {repr(3.141592653589793 / 12)})', 2)} AS temp_proxy
FROM grid"""

SQL["lag_features"] = _with(HOURLY, BOUNDS, SPINE) + "SELECT series_id, ds, load,\n  " + ",\n  ".join(
    f"lag(load, {k}) OVER w AS lag_{k}" for k in range(1, 25)
) + "\nFROM spine WINDOW w AS (PARTITION BY series_id ORDER BY ds)"

SQL["sequence_windows"] = _with(HOURLY, BOUNDS, SPINE) + f""", win AS (
  SELECT series_id, ds, load AS y, count(*) OVER w AS n_rows, count(load) OVER w AS n_vals,
         first_value(load) OVER w AS x_first, last_value(load) OVER w AS x_last, sum(load) OVER w AS x_sum
  FROM spine WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT series_id, ds, y, CAST(n_rows AS INTEGER) AS n, x_first, x_last, {R('x_sum', 6)} AS x_sum
FROM win WHERE n_rows = 24 AND n_vals = 24 AND y IS NOT NULL"""

SQL["last_window"] = LM + """SELECT series_id, ds, load_mw, CAST(pos AS INTEGER) AS pos FROM (
  SELECT series_id, ds, load_mw, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS pos FROM load_mw)
WHERE pos <= 24"""

SQL["holdout_split"] = LM + """SELECT series_id, ds, load_mw,
  CASE WHEN rn <= floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS part
FROM (SELECT series_id, ds, load_mw, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS rn,
             count(*) OVER (PARTITION BY series_id) AS n FROM load_mw)"""

PARTS = f"""parts AS (
  SELECT series_id, ds, load_mw,
         CASE WHEN rn <= fe THEN 'fit' WHEN rn <= te THEN 'validation' ELSE 'test' END AS part
  FROM (SELECT series_id, ds, load_mw, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS rn,
               floor(count(*) OVER (PARTITION BY series_id) * 0.8e0) AS te,
               floor(floor(count(*) OVER (PARTITION BY series_id) * 0.8e0) * 0.9e0) AS fe
        FROM load_mw WHERE load_mw IS NOT NULL))"""

SQL["evaluation_parts"] = _with(HOURLY, LOAD_MW, PARTS) + "SELECT series_id, ds, load_mw, part FROM parts"

SQL["latest_reading"] = LM + """SELECT series_id, ds, load, load_mw FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM load_mw
  WHERE ds <= TIMESTAMP '2024-01-15 12:30:00') WHERE rn = 1"""

SQL["future_grid"] = LM + """SELECT series_id, last_ds AS origin, CAST(s AS INTEGER) AS step,
  last_ds + s * INTERVAL 1 HOUR AS ds
FROM (SELECT series_id, max(ds) AS last_ds FROM load_mw GROUP BY 1) b, range(1, 25) t(s)"""

SQL["seasonal_profile"] = LM + f"""SELECT series_id, hour, weekday, {R(EXACT_MEAN, 6)} AS mean_mw, count(*) AS n
FROM (SELECT series_id, CAST(hour(ds) AS INTEGER) AS hour, CAST(isodow(ds) - 1 AS INTEGER) AS weekday, load_mw
      FROM load_mw WHERE {GOOD})
GROUP BY ROLLUP (series_id, hour, weekday) HAVING series_id IS NOT NULL"""


def _fourier_coef_sql(order: int = 3, period: float = 1.0) -> str:
    import math
    parts = []
    for k in range(1, order + 1):
        f = repr(2 * math.pi * k / period)
        parts.append(f"""SELECT series_id, {k} AS k, count(load_mw) AS n,
    sum(load_mw * cos({f} * {EPOCH_DAYS})) AS c, sum(load_mw * sin({f} * {EPOCH_DAYS})) AS s
  FROM load_mw WHERE {GOOD} GROUP BY 1""")
    return LM + f"SELECT series_id, k, {R('2e0 * c / n', 6)} AS a_cos, {R('2e0 * s / n', 6)} AS b_sin FROM (\n  " + \
        "\n  UNION ALL\n  ".join(parts) + ")"


SQL["fourier_coefficients"] = _fourier_coef_sql()

SQL["linear_trend"] = LM + f"""SELECT series_id, {R(f'regr_slope(load_mw, {EPOCH_DAYS})', 6)} AS slope_per_day,
  {R(f'regr_intercept(load_mw, {EPOCH_DAYS})', 6)} AS intercept, count(load_mw) AS n
FROM load_mw WHERE {GOOD} GROUP BY 1"""

SQL["attach_weather"] = _with(HOURLY, LOAD_MW, COV) + f"""SELECT l.series_id, l.ds, l.load_mw,
  {R('coalesce(c.temp_c, 21.5e0)', 6)} AS temp_c
FROM load_mw l LEFT JOIN cov c ON l.ds = c.ds"""

SQL["attach_weather_asof"] = _with(HOURLY, BOUNDS, COV) + f"""SELECT g.series_id, g.ds,
  CASE WHEN c.ds >= g.ds - INTERVAL 3 HOUR THEN {R('c.temp_c', 6)} END AS temp_c,
  CASE WHEN c.ds >= g.ds - INTERVAL 3 HOUR THEN c.ds END AS temp_c_at
FROM grid g ASOF LEFT JOIN cov c ON g.ds >= c.ds"""

EVAL = PARTS + """,
prof AS (SELECT series_id, hour(ds) AS h, isodow(ds) - 1 AS wd, """ + EXACT_MEAN + """ AS profile_mw
         FROM parts WHERE part = 'fit' GROUP BY 1, 2, 3),
preds AS (
  SELECT p.series_id, p.ds, p.part, p.load_mw AS actual, 'seasonal_naive' AS model, q.load_mw AS predicted
  FROM parts p LEFT JOIN parts q ON q.series_id = p.series_id AND q.ds = p.ds - INTERVAL 24 HOUR
  WHERE p.part <> 'fit'
  UNION ALL
  SELECT p.series_id, p.ds, p.part, p.load_mw AS actual, 'profile' AS model, f.profile_mw AS predicted
  FROM parts p LEFT JOIN prof f ON f.series_id = p.series_id AND f.h = hour(p.ds) AND f.wd = isodow(p.ds) - 1
  WHERE p.part <> 'fit'),
both_ AS (SELECT series_id, ds, part FROM preds WHERE predicted IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 2),
base AS (SELECT p.* FROM preds p JOIN both_ b USING (series_id, ds, part)),
valm AS (SELECT series_id, model, avg(abs(actual - predicted)) AS mae FROM base WHERE part = 'validation' GROUP BY 1, 2),
wts AS (SELECT series_id, model, (1e0 / mae) / sum(1e0 / mae) OVER (PARTITION BY series_id) AS weight FROM valm),
test AS (SELECT * FROM base WHERE part = 'test'),
ens AS (SELECT t.series_id, t.ds, 'test' AS part, any_value(t.actual) AS actual, 'ensemble' AS model,
               sum(w.weight * t.predicted) / sum(w.weight) AS predicted
        FROM test t JOIN wts w USING (series_id, model) GROUP BY t.series_id, t.ds),
scored AS (SELECT series_id, ds, part, actual, model, predicted FROM test UNION ALL SELECT * FROM ens),
metrics AS (SELECT series_id, model, avg(abs(actual - predicted)) AS mae,
                   sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
                   avg(abs((actual - predicted) / nullif(actual, 0e0))) * 100e0 AS mape, count(*) AS n
            FROM scored GROUP BY 1, 2),
lb AS (SELECT series_id, model, CAST(row_number() OVER (PARTITION BY series_id ORDER BY mae + rmse + mape / 10e0, model) AS INTEGER) AS "rank",
              mae, rmse, mape, mae + rmse + mape / 10e0 AS score,
              CASE WHEN mape < 5 THEN 'excellent' WHEN mape < 10 THEN 'very good' WHEN mape < 20 THEN 'acceptable'
                   ELSE 'needs improvement' END AS quality
       FROM metrics)"""
EV_WITH = _with(HOURLY, LOAD_MW, EVAL)

SQL["model_predictions"] = EV_WITH + f"""SELECT series_id, ds, part, {R('actual', 6)} AS actual, model,
  {R('predicted', 6)} AS predicted FROM preds"""

SQL["ensemble_weights"] = EV_WITH + f"SELECT series_id, model, {R('weight', 6)} AS weight FROM wts"

SQL["evaluation_metrics"] = EV_WITH + f"""SELECT series_id, model, {R('mae', 6)} AS mae, {R('rmse', 6)} AS rmse,
  {R('mape', 6)} AS mape, n FROM metrics"""

SQL["best_per_metric"] = EV_WITH + """SELECT series_id, model,
  mae = min(mae) OVER (PARTITION BY series_id) AS best_mae,
  rmse = min(rmse) OVER (PARTITION BY series_id) AS best_rmse,
  mape = min(mape) OVER (PARTITION BY series_id) AS best_mape
FROM metrics"""

SQL["leaderboard"] = EV_WITH + f"""SELECT series_id, model, "rank", {R('mae', 3)} AS mae, {R('rmse', 3)} AS rmse,
  {R('mape', 2)} AS mape, {R('score', 3)} AS score, quality, "rank" = 1 AS recommended FROM lb"""

SQL["recommendation"] = EV_WITH + f"""SELECT series_id, model AS recommended_model,
  printf('%s is recommended because it has the lowest combined error score. Its MAPE is %s%%, which is %s for this use case. Lower MAE/RMSE means the model stays closer to real demand in MW, while lower MAPE means better percentage accuracy.',
         model, printf('%.2f', {R(R('mape', 2), 2)}), quality) AS explanation
FROM lb WHERE "rank" = 1"""

SQL["report_winner"] = EV_WITH + """SELECT series_id, winner,
  CASE WHEN winner_mape < 5 THEN 'excellent' WHEN winner_mape < 10 THEN 'acceptable' ELSE 'needs improvement' END AS winner_tier
FROM (SELECT series_id, model AS winner, mape AS winner_mape,
             row_number() OVER (PARTITION BY series_id ORDER BY mae + rmse,
                                CASE model WHEN 'seasonal_naive' THEN 1 WHEN 'profile' THEN 2 ELSE 3 END) AS rn
      FROM metrics) WHERE rn = 1"""


# ----------------------------------------------------------------------------- forecasts, paging, alerts
_LOW = repr(1 - C.BAND_PCT)
_HIGH = repr(1 + C.BAND_PCT)


def _band(t: float) -> str:
    return f"""prof AS (SELECT series_id, hour(ds) AS h, isodow(ds) - 1 AS wd, {EXACT_MEAN} AS yhat FROM load_mw GROUP BY 1, 2, 3),
fg AS (SELECT series_id, CAST(s AS INTEGER) AS step, last_ds + s * INTERVAL 1 HOUR AS ds
       FROM (SELECT series_id, max(ds) AS last_ds FROM load_mw GROUP BY 1) b, range(1, 25) t(s)),
fc AS (SELECT fg.series_id, fg.step, fg.ds,
              CASE WHEN p.yhat IS NOT NULL AND NOT isnan(p.yhat) THEN least(greatest(p.yhat, 0e0), 50e0) END AS p
       FROM fg LEFT JOIN prof p ON p.series_id = fg.series_id AND p.h = hour(fg.ds) AND p.wd = isodow(fg.ds) - 1),
band AS (SELECT series_id, step, ds, {R('p', 3)} AS predicted_mw, {R(f'greatest(0e0, p * {_LOW})', 3)} AS lower_mw,
                {R(f'p * {_HIGH}', 3)} AS upper_mw, coalesce(p >= {t!r}, false) AS alert FROM fc)"""


SQL["forecast_band"] = _with(HOURLY, LOAD_MW, _band(20.0)) + "SELECT * FROM band"

_TABLE_COLS = """series_id, ds, strftime(ds, '%d %b %H:%M') AS time_label, predicted_mw,
  CASE WHEN predicted_mw >= {t} THEN 'Alert' ELSE 'Normal' END AS status"""
SQL["forecast_table"] = _with(HOURLY, LOAD_MW, _band(20.0)) + "SELECT " + _TABLE_COLS.format(t="20e0") + f"""
FROM band WHERE contains(lower(concat_ws(' ', strftime(ds, '%d %b %H:%M'), printf('%.2f', {R('predicted_mw', 2)}),
  printf('%.2f', {R('lower_mw', 2)}), printf('%.2f', {R('upper_mw', 2)}),
  CASE WHEN predicted_mw >= 20e0 THEN 'Alert' ELSE 'Normal' END)), 'jan 1')"""
SQL["forecast_alert_rows"] = _with(HOURLY, LOAD_MW, _band(15.0)) + "SELECT " + _TABLE_COLS.format(t="15e0") + \
    "\nFROM band WHERE predicted_mw >= 15e0"

SQL["recursive_ar3"] = "WITH RECURSIVE " + HOURLY + ",\n" + LOAD_MW + f""",
seed AS (
  SELECT series_id, max(ds) AS last_ds, max(CASE WHEN rn = 1 THEN load_mw END) AS l1,
         max(CASE WHEN rn = 2 THEN load_mw END) AS l2, max(CASE WHEN rn = 3 THEN load_mw END) AS l3
  FROM (SELECT series_id, ds, load_mw, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM load_mw)
  WHERE rn <= 3 GROUP BY 1 HAVING count(*) = 3),
rec(series_id, step, ds, y, l1, l2, l3) AS (
  SELECT series_id, 0, last_ds, CAST(NULL AS DOUBLE), l1, l2, l3 FROM seed
  UNION ALL
  SELECT series_id, step + 1, ds + INTERVAL 1 HOUR,
         0e0 + l3 * 0.2e0 + l2 * 0.3e0 + l1 * 0.5e0,
         0e0 + l3 * 0.2e0 + l2 * 0.3e0 + l1 * 0.5e0, l1, l2
  FROM rec WHERE step < 24)
SELECT series_id, CAST(step AS INTEGER) AS step, ds, {R('y', 6)} AS predicted FROM rec WHERE step > 0"""

SQL["minmax_scaled"] = _with(HOURLY, LOAD_MW, COV) + f""", j AS (
  SELECT l.series_id, l.ds, l.load_mw, coalesce(c.temp_c, 21.5e0) AS temp_c FROM load_mw l LEFT JOIN cov c ON l.ds = c.ds),
b AS (SELECT series_id, min(load_mw) AS lmin, max(load_mw) AS lmax, min(temp_c) AS tmin, max(temp_c) AS tmax FROM j GROUP BY 1),
s AS (SELECT j.series_id, j.ds, coalesce((load_mw - lmin) / nullif(lmax - lmin, 0e0), 0e0) AS ls,
             coalesce((temp_c - tmin) / nullif(tmax - tmin, 0e0), 0e0) AS ts_, lmin, lmax
      FROM j JOIN b USING (series_id))
SELECT series_id, ds, {R('ls', 6)} AS load_mw_scaled, {R('ts_', 6)} AS temp_c_scaled,
       {R('ls * (lmax - lmin) + lmin', 6)} AS load_mw_back FROM s"""

SQL["demand_from_text"] = SQL["hourly_load"]

SQL["combine_pages"] = _with(HOURLY) + """, a AS (SELECT series_id, ds AS period, load, 1 AS page FROM hourly_load WHERE ds < TIMESTAMP '2024-01-20'),
b AS (SELECT series_id, ds AS period, load, 2 AS page FROM hourly_load WHERE ds >= TIMESTAMP '2024-01-15')
SELECT series_id, period, load, page FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY page DESC) AS rn
  FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE rn = 1"""

SQL["recent_alerts"] = _with(HOURLY, LOAD_MW, _peaks(20.0)) + """, log AS (
  SELECT series_id, peak_ds AS timestamp, peak_mw, 'history' AS model FROM peaks)
SELECT l.*, (SELECT count(*) FROM log) AS total FROM log l ORDER BY timestamp DESC, series_id DESC LIMIT 20"""

SQL["head_sample"] = LM + "SELECT series_id, ds, load_mw FROM load_mw ORDER BY ds, series_id LIMIT 5"
SQL["page_rows"] = LM + "SELECT series_id, ds, load_mw FROM load_mw ORDER BY series_id, ds LIMIT 50 OFFSET 100"

SQL["alert_dedupe"] = """WITH RECURSIVE ev AS (
  SELECT event_type AS series_id, ts AS timestamp,
         min(ts) OVER (PARTITION BY event_type ORDER BY ts
                       RANGE BETWEEN INTERVAL 300 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM events),
heads AS (SELECT series_id, min(timestamp) AS timestamp FROM ev GROUP BY 1),
chain(series_id, timestamp, nxt) AS (
  SELECT e.series_id, e.timestamp, e.nxt FROM ev e JOIN heads h USING (series_id, timestamp)
  UNION ALL
  SELECT e.series_id, e.timestamp, e.nxt FROM chain c JOIN ev e ON e.series_id = c.series_id AND e.timestamp = c.nxt)
SELECT e.series_id, e.timestamp,
       EXISTS (SELECT 1 FROM chain c WHERE c.series_id = e.series_id AND c.timestamp = e.timestamp) AS admitted
FROM ev e"""

SQL["freshness"] = _with(HOURLY) + """SELECT series_id, max(ds) AS newest,
  CAST(date_diff('second', max(ds), TIMESTAMP '2024-01-31 00:02:00') AS BIGINT) AS age_s,
  date_diff('second', max(ds), TIMESTAMP '2024-01-31 00:02:00') < 300 AS just_completed
FROM hourly_load GROUP BY 1"""

SQL["fresh_forecast"] = _with(HOURLY, LOAD_MW, _band(20.0)) + """, runs AS (
  SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS generated_at FROM band
  UNION ALL SELECT *, TIMESTAMP '2024-01-31 00:02:00' AS generated_at FROM band),
recent AS (SELECT *, 'profile' AS model, 24 AS hours FROM runs
           WHERE generated_at > TIMESTAMP '2024-01-31 00:04:00' - INTERVAL 300 SECOND
             AND generated_at <= TIMESTAMP '2024-01-31 00:04:00')
SELECT series_id, model, hours, generated_at, step, ds, predicted_mw FROM recent r
WHERE generated_at = (SELECT max(generated_at) FROM recent q WHERE q.series_id = r.series_id)"""

SQL["align_models"] = "WITH RECURSIVE " + HOURLY + ",\n" + LOAD_MW + ",\n" + _band(20.0) + f""",
seed AS (
  SELECT series_id, max(ds) AS last_ds, max(CASE WHEN rn = 1 THEN load_mw END) AS l1,
         max(CASE WHEN rn = 2 THEN load_mw END) AS l2, max(CASE WHEN rn = 3 THEN load_mw END) AS l3
  FROM (SELECT series_id, ds, load_mw, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM load_mw)
  WHERE rn <= 3 GROUP BY 1 HAVING count(*) = 3),
rec(series_id, step, ds, y, l1, l2, l3) AS (
  SELECT series_id, 0, last_ds, CAST(NULL AS DOUBLE), l1, l2, l3 FROM seed
  UNION ALL
  SELECT series_id, step + 1, ds + INTERVAL 1 HOUR,
         0e0 + l3 * 0.2e0 + l2 * 0.3e0 + l1 * 0.5e0,
         0e0 + l3 * 0.2e0 + l2 * 0.3e0 + l1 * 0.5e0, l1, l2
  FROM rec WHERE step < 24)
SELECT b.series_id, b.ds, b.predicted_mw AS profile_predicted, {R('r.y', 6)} AS ar3_predicted
FROM band b JOIN rec r ON r.series_id = b.series_id AND r.ds = b.ds AND r.step > 0"""

# The whole table arrives in one micro-batch; the global watermark is max(ts) - 1 hour and an
# hour is emitted once its window end is at or before it.
SQL["stream_hourly_load"] = _with(HOURLY) + """SELECT series_id, ds, load FROM hourly_load
WHERE ds + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""

SQL["stream_alert_cooldown"] = SQL["alert_dedupe"].replace(
    "SELECT event_type AS series_id, ts AS timestamp,", "SELECT event_type AS series_id, ts AS timestamp, value,"
).replace("""SELECT e.series_id, e.timestamp,
       EXISTS (SELECT 1 FROM chain c WHERE c.series_id = e.series_id AND c.timestamp = e.timestamp) AS admitted
FROM ev e""", """SELECT e.series_id, e.timestamp AS ds, e.value AS load_mw FROM ev e
WHERE EXISTS (SELECT 1 FROM chain c WHERE c.series_id = e.series_id AND c.timestamp = e.timestamp)""")

SQL["stream_threshold_alerts"] = _with(HOURLY, LOAD_MW) + """SELECT series_id, ds, load, load_mw FROM load_mw
WHERE load_mw >= 20e0 AND ds + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""

SQL["forecast_status"] = _with(HOURLY, LOAD_MW, _band(17.0)) + """SELECT series_id,
  CAST(count_if(predicted_mw >= 17e0) AS BIGINT) AS alert_hours, count(predicted_mw) AS hours, max(predicted_mw) AS peak_mw,
  CASE WHEN count_if(predicted_mw >= 17e0) = 0 THEN 'All forecast values within safe threshold'
       ELSE printf('ALERT — %d hour(s) forecast above 17 MW', count_if(predicted_mw >= 17e0)) END AS status
FROM band GROUP BY 1"""

# M6: a series has an autoregressive model when some hour has all 24 previous hours present;
# otherwise the additive forecast is used. Both forecast hours 1..24 after the last hour.
SQL["model_fallback"] = LM + """, ok AS (
  SELECT DISTINCT series_id FROM (
    SELECT series_id, count(*) OVER (PARTITION BY series_id ORDER BY ds
                                     RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS c
    FROM load_mw) WHERE c = 24),
last AS (SELECT series_id, max(ds) AS last_ds FROM load_mw GROUP BY 1)
SELECT l.series_id, CASE WHEN ok.series_id IS NOT NULL THEN 'autoregressive' ELSE 'additive' END AS model,
       CAST(s AS INTEGER) AS step, l.last_ds + s * INTERVAL 1 HOUR AS ds
FROM last l LEFT JOIN ok ON ok.series_id = l.series_id, range(1, 25) t(s)"""


def _payload_sql(t: float) -> str:
    zones = ", ".join(f"('{z}', {p})" for z, p in C.ZONES)
    peaks = f"""peaks AS (
  SELECT series_id, CAST(CAST(ds AS DATE) AS TIMESTAMP) AS day, ds AS peak_ds, predicted_mw AS peak_mw FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY predicted_mw DESC, ds) AS rn
    FROM band WHERE alert OR predicted_mw >= {t}) WHERE rn = 1)"""
    schedule = _schedule(t)[len(_peaks(t)):].replace("SELECT r_name AS zone, r_regionkey + 1 AS priority FROM region",
                                                     f"SELECT * FROM (VALUES {zones}) z(zone, priority)")
    return _with(HOURLY, LOAD_MW, _band(t), peaks + schedule) + f"""SELECT p.series_id, 'peak_load_alert' AS event, '{C.DISTRICT}' AS district,
  TIMESTAMP '2024-01-31 00:00:00' AS triggered_at, CAST({t} AS DOUBLE) AS threshold_mw, p.peak_ds, p.peak_mw, 'profile' AS peak_model,
  w.hours, w.first_ds, w.last_ds, w.alert_hours, coalesce(s.zones, '') AS zones, coalesce(s.shed_mw, 0e0) AS shed_mw
FROM peaks p JOIN (SELECT series_id, count(*) AS hours, min(ds) AS first_ds, max(ds) AS last_ds, CAST(count_if(alert) AS BIGINT) AS alert_hours
                   FROM band GROUP BY 1) w USING (series_id)
LEFT JOIN (SELECT series_id, string_agg(priority || '|' || zone || '|' || strftime(start_ts, '%H:%M') || '|' || strftime(end_ts, '%H:%M'), ';' ORDER BY priority) AS zones,
                  {R('sum(load_mw)', 2)} AS shed_mw FROM schedule GROUP BY 1) s USING (series_id)"""


SQL["alert_payload"] = _payload_sql(13.0)


def _fixed_daily_sql() -> str:
    import math
    c = [repr(x) for x in C.CHECK_COEFFICIENTS]
    n = C.N_CHANGEPOINTS
    terms = [c[0], f"{c[1]} * t"] + [f"{c[1 + j]} * greatest(t - {C.CHANGEPOINT_RANGE * j / n!r}, 0e0)" for j in range(1, n + 1)]
    at = 2 + n
    for _, period, order in C.SEASONALITIES:
        for k in range(1, order + 1):
            f = repr(2 * math.pi * k / period)
            terms += [f"{c[at]} * sin({f} * e)", f"{c[at + 1]} * cos({f} * e)"]
            at += 2
    return f"""WITH daily AS (
  SELECT o_orderpriority AS series_id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ds,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS load FROM orders GROUP BY 1, 2),
m AS (SELECT series_id, CAST(min(CAST(ds AS DATE) - DATE '1970-01-01') AS DOUBLE) AS t0, CAST(max(CAST(ds AS DATE) - DATE '1970-01-01') AS DOUBLE) AS t1,
             max(ds) AS last_ds, CAST(SUM(CAST(load AS DECIMAL(38,9))) AS DOUBLE) / count(load) / 10e0 AS y_scale FROM daily GROUP BY 1),
g AS (SELECT m.*, CAST(s AS INTEGER) AS step, last_ds + s * INTERVAL 1 DAY AS ds FROM m, range(1, 31) r(s)),
e AS (SELECT *, CAST(CAST(ds AS DATE) - DATE '1970-01-01' AS DOUBLE) AS e FROM g),
x AS (SELECT *, (e - t0) / (t1 - t0) AS t FROM e)
SELECT series_id, step, ds, {R('y_scale * (' + ' + '.join(terms) + ')', 1)} AS predicted,
       {R('2e0 * 1.2815515655446004e0 * 0.5e0 * y_scale', 1)} AS width, false AS alert FROM x"""


SQL["additive_fixed_daily"] = _fixed_daily_sql()


# ----------------------------------------------------------------------------- landed files
SQL["demand_pages"] = SQL["hourly_load"]
SQL["page_report"] = _with(HOURLY) + """, pages AS (
  SELECT series_id, CAST(ds AS DATE) AS day, count(*) + 3 AS n, CASE WHEN day(CAST(ds AS DATE)) % 2 = 0 THEN 2 ELSE 1 END AS copies
  FROM hourly_load GROUP BY 1, 2)
SELECT CAST(sum(copies) AS BIGINT) AS pages, CAST(sum(copies * n) AS BIGINT) AS collected, CAST(max(n) AS BIGINT) AS declared,
       sum(copies * n) >= max(n) AS complete FROM pages"""
SQL["load_csv"] = LM + f"""SELECT ds, max(load_mw) AS load_mw,
  {R(f'({_TBASE}) + 5e0 * sin((hour(ds) - 6) * {repr(3.141592653589793 / 12)})', 2)} AS temp_c FROM load_mw GROUP BY ds"""
SQL["load_store"] = LM + """SELECT series_id, ds, load_mw AS y FROM load_mw
WHERE load_mw IS NOT NULL AND ds >= TIMESTAMP '2024-01-10' AND ds < TIMESTAMP '2024-01-20'"""
SQL["weather_file"] = _with(COV) + f"SELECT ds, {R('temp_c', 6)} AS temp_c FROM cov"
SQL["eval_results_file"] = EV_WITH + f"""SELECT model, {R('mae', 6)} AS mae, {R('rmse', 6)} AS rmse, {R('mape', 6)} AS mape FROM metrics"""
SQL["alert_log_file"] = _with(HOURLY, LOAD_MW, _schedule(20.0).replace(
    "SELECT r_name AS zone, r_regionkey + 1 AS priority FROM region",
    "SELECT * FROM (VALUES " + ", ".join(f"('{z}', {p})" for z, p in C.ZONES) + ") z(zone, priority)")) + """SELECT p.series_id, p.peak_ds AS timestamp, p.peak_mw, 'history' AS model, count(*) AS zones
FROM peaks p JOIN schedule s USING (series_id, day) GROUP BY 1, 2, 3"""

SQL["additive_residual"] = LM + f"SELECT series_id, 0e0 AS residual, count(*) AS n FROM load_mw WHERE {GOOD} GROUP BY 1"
SQL["ar_residual"] = LM + """SELECT series_id, 0e0 AS residual, count(*) AS n FROM (
  SELECT series_id, count(load_mw) OVER (PARTITION BY series_id ORDER BY ds
                                         RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS c
  FROM load_mw) WHERE c = 24 GROUP BY 1"""
