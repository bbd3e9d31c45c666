"""SQL counterparts of the named queries, for an independent engine on the same tables."""

from __future__ import annotations

from ..config import RISK_BANDS

_FX = """
fx_obs as (
  select event_type as station, date_trunc('hour', ts) as h,
         cast(sum(cast(round(value*100) as bigint)) as bigint) as cents,
         count(*) as n, max(value) as no2, min(value) as o3,
         cast(sum(cast(json_extract(props,'$.k') as bigint)) as bigint) as sk
  from events group by 1, 2),
fx_cov as (
  select h as timestamp,
         case when sk%7=0 then null else cast(sk%350 as double)/10 end as temp,
         cast(40+sk%41 as double) as humidity, cast(su%120 as double)/10 as wind_speed,
         cast(su%360 as double) as wind_dir, cast(ne as double)/10 as precip,
         cast(1000+sk%40 as double) as pressure
  from (select date_trunc('hour', ts) as h,
               cast(sum(cast(json_extract(props,'$.k') as bigint)) as bigint) as sk,
               cast(sum(user_id) as bigint) as su,
               count(*) filter (where event_type='error') as ne
        from events group by 1)),
fx_readings as (
  select station, h as timestamp,
         case when sk%13=0 then null else cast(cents as double)/n/100 end as pm25,
         cast(n as double) as aqi, no2, o3 from fx_obs),
fx_panel as (
  select s.station, c.timestamp, c.temp, c.humidity, c.wind_speed, c.wind_dir, c.precip,
         c.pressure, o.pm25, o.aqi, o.no2, o.o3
  from fx_cov c cross join (select distinct station from fx_obs) s
  left join fx_readings o on o.station = s.station and o.timestamp = c.timestamp)"""

_WX = ("temp", "humidity", "wind_speed", "wind_dir", "precip", "pressure")


def _edge(c: str, part: str = "station", order: str = "timestamp", ahead: str = "true") -> str:
    w = f"over (partition by {part} order by {order} rows between"
    return (f"coalesce(last_value({c} ignore nulls) {w} unbounded preceding and current row), "
            f"first_value(case when {ahead} then {c} end ignore nulls) {w} current row and unbounded following))")


def _line(src: str, v: str, part: str = "station", order: str = "timestamp",
          limit: int = 3, ahead: str = "true") -> str:
    """Rows of ``src`` with ``filled``: positional interpolation of ``v``."""
    w = f"over (partition by {part} order by i rows between"
    return f"""(select * exclude (i, pv, pi, nv, ni),
       case when {v} is not null then {v}
            when i - pi <= {limit} then case when ni is null then pv
                 else pv + (nv - pv) / (ni - pi) * (i - pi) end end as filled
  from (select *,
          last_value({v} ignore nulls) {w} unbounded preceding and current row) as pv,
          last_value(case when {v} is not null then i end ignore nulls)
            {w} unbounded preceding and current row) as pi,
          first_value(case when {ahead} then {v} end ignore nulls) {w} current row and unbounded following) as nv,
          first_value(case when {ahead} and {v} is not null then i end ignore nulls)
            {w} current row and unbounded following) as ni
        from (select *, row_number() over (partition by {part} order by {order}) as i
              from {src})))"""


_FENCES = """
fx_fences as (
  select station, """ + ", ".join(
    f"quantile_cont({c}, 0.25) as {c}_p25, quantile_cont({c}, 0.75) as {c}_p75, "
    f"quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) "
    f"as {c}_fence" for c in ("pm25", "no2", "o3")) + """
  from (select * replace (case when pm25 < 0 then 0 else pm25 end as pm25) from fx_panel)
  group by station)"""

_CLEAN = _FENCES + """,
fx_clipped as (
  select p.* replace (""" + ", ".join(
    f"case when {c} > {c}_fence then {c}_fence else {c} end as {c}"
    for c in ("pm25", "no2", "o3")) + """)
  from (select * replace (case when pm25 < 0 then 0 else pm25 end as pm25) from fx_panel) p
  join fx_fences f using (station)),
fx_filled as (
  select * replace (""" + ", ".join(f"{_edge(c)} as {c}" for c in _WX) + """)
  from fx_clipped),
fx_clean as (
  select station, timestamp, temp, humidity, wind_speed, wind_dir, precip, pressure,
         filled as pm25, aqi, no2, o3
  from """ + _line("fx_filled", "pm25") + """ where filled is not null)"""


def _gate(stat: str, c: str, n: int, part: str, order: str) -> str:
    w = f"over (partition by {part} order by {order} rows between {n} preceding and 1 preceding)"
    return f"case when count({c}) {w} = {n} then {stat}({c}) {w} end"


def _lag(c: str, k: int, part: str = "station", order: str = "timestamp") -> str:
    return f"lag({c}, {k}) over (partition by {part} order by {order})"


_PI2 = "2*pi()"
_FEATURE_SQL = {
    "hour_sin": f"sin({_PI2}*hour(timestamp)/24)", "hour_cos": f"cos({_PI2}*hour(timestamp)/24)",
    "month_sin": f"sin({_PI2}*month(timestamp)/12)",
    "month_cos": f"cos({_PI2}*month(timestamp)/12)",
    "dow_sin": f"sin({_PI2}*(isodow(timestamp)-1)/7)",
    "dow_cos": f"cos({_PI2}*(isodow(timestamp)-1)/7)",
    "is_weekend": "cast(case when isodow(timestamp) >= 6 then 1 else 0 end as integer)",
    **{f"pm25_lag_{k}h": _lag("pm25", k) for k in (1, 3, 6, 12, 24, 48, 168)},
    **{f"pm25_rolling_{t}": _gate("avg", "pm25", n, "station", "timestamp")
       for n, t in ((3, "3h"), (6, "6h"), (24, "24h"), (168, "7d"))},
    **{f"pm25_std_{t}": _gate("stddev_samp", "pm25", n, "station", "timestamp")
       for n, t in ((24, "24h"), (168, "7d"))},
    "temp": "temp", "temp_sq": "temp*temp", "humidity": "humidity", "wind_speed": "wind_speed",
    "wind_u": "wind_speed*sin(radians(wind_dir))", "wind_v": "wind_speed*cos(radians(wind_dir))",
    "temp_x_humidity": "temp*humidity/100",
    "stagnation_idx": "humidity/case when wind_speed < 0.1 then 0.1 else wind_speed end",
    "no2_lag_1h": _lag("no2", 1), "no2_lag_24h": _lag("no2", 24),
    "precip_lag_3h": _gate("sum", "precip", 3, "station", "timestamp"),
    "pressure": "pressure",
    "pressure_change_3h": f"{_lag('pressure', 1)} - {_lag('pressure', 4)}",
}

_ALL = """
fx_all as (
  select station, timestamp, """ + ", ".join(
    f"{e} as {n}" for n, e in _FEATURE_SQL.items()) + """, pm25 from fx_clean)"""
_FEATURES = _ALL + """,
fx_features as (
  select * from fx_all where """ + " and ".join(
    f"{n} is not null" for n in [*_FEATURE_SQL, "pm25"]) + ")"

_FOLDED = """
fx_folded as (
  select f.*, cast(case when g < n - 5 * t then 0 else (g - (n - 5 * t)) // t + 1 end as integer)
         as test_fold
  from fx_features f join (
    select timestamp, row_number() over (order by timestamp) - 1 as g, count(*) over () as n,
           count(*) over () // 6 as t
    from (select distinct timestamp from fx_features)) using (timestamp)),
fx_predictions as (
  select 'persistence' as model, test_fold as fold, pm25 as y, pm25_lag_1h as yhat
  from fx_folded where test_fold > 0
  union all
  select 'daily', test_fold, pm25, pm25_lag_24h from fx_folded where test_fold > 0),
fx_metrics as (
  select model, fold, count(*) as n, avg(abs(y - yhat)) as mae,
         sqrt(avg((y - yhat) * (y - yhat))) as rmse,
         avg(case when y > 1 then abs((y - yhat) / y) end) * 100 as mape,
         1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(y)) as r2
  from fx_predictions group by 1, 2),
fx_scores as (
  select model, """ + ", ".join(
    f"round_even(avg({m}), 3) as {m}, round_even(stddev_pop({m}), 3) as {m}_std"
    for m in ("mae", "rmse", "mape", "r2")) + """
  from fx_metrics group by 1)"""


def _with(*parts: str) -> str:
    return "with " + ",".join(parts) + "\n"


def r(*names: str, digits: int = 6) -> str:
    """Rounded columns, moved off the rounding ties (see ``tidy`` of the queries)."""
    return ", ".join(f"round({n} + 3.3e-10, {digits}) as {n}" for n in names)


def _band(v: str, field: str) -> str:
    q = (lambda x: f"'{x}'") if isinstance(RISK_BANDS[0][field], str) else str
    whens = " ".join(f"when {v} >= {b['low']} and {v} < {b['high']} then {q(b[field])}"
                     for b in RISK_BANDS)
    return f"case {whens} else {q(RISK_BANDS[-1][field])} end"


BASE = _with(_FX)
CLEAN = _with(_FX, _CLEAN)
ALL = _with(_FX, _CLEAN, _ALL)
FEATURES = _with(_FX, _CLEAN, _FEATURES)
FOLDED = _with(_FX, _CLEAN, _FEATURES, _FOLDED)
_SHIFTED = ("(select event_id, case when user_id % 13 <> 0 then value - 20 end as pm25 "
            "from events)")
_CLEAN_COLUMNS = r("temp", "humidity", "wind_speed", "wind_dir", "precip", "pressure",
                   "pm25", "aqi", "no2", "o3")
_ST = "station, timestamp"
_METRICS = ("mae", "mae_std", "rmse", "rmse_std", "mape", "mape_std", "r2", "r2_std")


def _feature_sql(*names: str) -> str:
    return ALL + f"select {_ST}, {r(*names)} from fx_all"


def _profile(src: str, ts: str, v: str, by: str = "") -> str:
    return (f"select {by} hour, {r('mean', 'std')}, round(mean + std + 3.3e-10, 6) as upper, "
            f"round(mean - std + 3.3e-10, 6) as lower from (select {by} cast(hour({ts}) as integer) as hour,"
            f" avg({v}) as mean, stddev_samp({v}) as std from {src} group by all)")


def _last(src: str, n: int) -> str:
    return (f"(select * exclude (rn) from (select *, row_number() over (partition by station "
            f"order by timestamp desc) as rn from {src}) where rn <= {n})")


_LINE_ORDER = ("l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
               "l_extendedprice")


def _line_features(key: str) -> str:
    q = "l_quantity"
    ids = ", ".join(dict.fromkeys([key, "l_orderkey", "l_linenumber", "l_partkey"]))
    means = ", ".join(
        f"round({_gate('avg', q, n, key, _LINE_ORDER)} + 3.3e-10, 6) as mean_{n}"
        for n in (3, 6, 24, 168))
    stds = ", ".join(
        f"round({_gate('stddev_samp', q, n, key, _LINE_ORDER)} + 3.3e-10, 6) as std_{n}"
        for n in (24, 168))
    lags = ", ".join(f"round({_lag(q, k, key, _LINE_ORDER)} + 3.3e-10, 6) as lag_{k}"
                     for k in (1, 24, 168))
    return f"select {ids}, round({q} + 3.3e-10, 6) as {q}, {lags}, {means}, {stds} from lineitem"


def _describe(columns) -> str:
    return "\nunion all\n".join(
        f"select '{c}' as \"column\", count({c}) as count, round_even(avg({c}), 2) as mean, "
        f"round_even(stddev_samp({c}), 2) as std, round_even(min({c}), 2) as min, "
        f"round_even(quantile_cont({c}, 0.25), 2) as p25, "
        f"round_even(quantile_cont({c}, 0.5), 2) as p50, "
        f"round_even(quantile_cont({c}, 0.75), 2) as p75, round_even(max({c}), 2) as max "
        f"from fx_clean" for c in columns)


def _account(stage: str, src: str, kept: str) -> str:
    return (f"select '{stage}' as stage, count(*) as rows, min(timestamp) as first, "
            f"max(timestamp) as last, count(*) filter (where {kept}) as rows_kept, "
            f"count(*) - count(*) filter (where {kept}) as rows_lost, "
            f"round((1 - count(*) filter (where {kept}) / count(*)) * 100 + 3.3e-10, 6) as pct_lost "
            f"from {src}")


_FEATURE_OUT = ", ".join(
    n if n == "is_weekend" else f"round({n} + 3.3e-10, 6) as {n}" for n in [*_FEATURE_SQL, "pm25"])
# The last live row of each station over its hour, before cleaning.
_OVERLAID = _with(_FX.replace("fx_panel as (", "fx_bare as ("), """
fx_last as (
  select station, timestamp as h, pm25 + 100 as v from fx_readings
  qualify row_number() over (partition by station order by timestamp desc) = 1),
fx_panel as (
  select p.* replace (case when p.timestamp = l.h then l.v else pm25 end as pm25)
  from fx_bare p left join fx_last l using (station))""", _CLEAN)
# Readings as the landed texts and the stored history have them.
_INGESTED = _with(_FX.replace("fx_readings as (", "fx_stored as (").replace("fx_panel as (", """fx_live as (
  select station, h as timestamp, case when sk%5=0 then null else cast(cents as double) end as pm25,
         case when sk%3=0 then null else cast(n as double) end as aqi,
         case when sk%5=0 then null else no2 end as no2, cast(null as double) as o3
  from fx_obs where sk%11<>0),
fx_readings as (
  select s.* from fx_stored s
  left join (select station, min(timestamp) as first from fx_live group by 1) using (station)
  where timestamp < timestamp '2024-01-24' and (first is null or timestamp < first)
  union all select * from fx_live),
fx_panel as ("""), _CLEAN)
# Ridge on one standardised feature, penalty one: the weight is S_xy / (n + 1).
_FIT = ("count(*) as n, avg(pm25) as my, avg(pm25_lag_1h) as mx, stddev_pop(pm25_lag_1h) as sx, "
        "covar_pop(pm25_lag_1h, pm25) * count(*) / stddev_pop(pm25_lag_1h) / (count(*) + 1) as w")
_RIDGE = FOLDED.rstrip() + f""",
fx_fits as (
  select fold, {_FIT} from fx_folded,
         (select distinct test_fold as fold from fx_folded where test_fold > 0)
  where test_fold < fold group by fold),
fx_ridge as (
  select 'ridge' as model, fold, pm25 as y, my + w * (pm25_lag_1h - mx) / sx as yhat
  from fx_folded join fx_fits on fold = test_fold)
"""
_RIDGE_SCORES = _RIDGE.rstrip() + """,
fx_ridge_metrics as (
  select model, fold, avg(abs(y - yhat)) as mae, sqrt(avg((y - yhat) * (y - yhat))) as rmse,
         avg(case when y > 1 then abs((y - yhat) / y) end) * 100 as mape,
         1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(y)) as r2
  from fx_ridge group by 1, 2),
fx_ridge_scores as (
  select model, """ + ", ".join(
    f"round_even(avg({m}), 3) as {m}, round_even(stddev_pop({m}), 3) as {m}_std"
    for m in ("mae", "rmse", "mape", "r2")) + """
  from fx_ridge_metrics group by 1)
"""
# Copies of the rows for every fold, cleaned with what the hours before the fold's cut know.
_BY_FOLD = "station, fold"
_TRAIN_ONLY = _with(_FX, """
fx_stages as (
  select timestamp, case when g < n - 5 * t then 0 else (g - (n - 5 * t)) // t + 1 end as stage
  from (select timestamp, row_number() over (order by timestamp) - 1 as g, count(*) over () as n,
               count(*) over () // 6 as t from fx_cov)),
fx_copies as (
  select p.* replace (case when pm25 < 0 then 0 else pm25 end as pm25), fold, stage < fold as train
  from fx_panel p join fx_stages using (timestamp)
  join (select unnest([1, 2, 3, 4, 5]) as fold) on fold >= greatest(stage, 1)),
fx_fences as (
  select station, fold, """ + ", ".join(
    f"quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as {c}_fence"
    for c in ("pm25", "no2", "o3")) + """
  from fx_copies where train group by station, fold),
fx_filled as (
  select p.* replace (""" + ", ".join(
    f"case when {c} > {c}_fence then {c}_fence else {c} end as {c}" for c in ("pm25", "no2", "o3"))
    + ", " + ", ".join(f"{_edge(c, 'p.station, p.fold', 'timestamp', 'train')} as {c}" for c in _WX) + """)
  from fx_copies p left join fx_fences f on f.station = p.station and f.fold = p.fold),
fx_rows as (
  select fold, case when train then 'train' else 'test' end as part, station, timestamp, temp, humidity,
         wind_speed, wind_dir, precip, pressure, filled as pm25, aqi, no2, o3
  from """ + _line("fx_filled", "pm25", _BY_FOLD, "timestamp", 3, "train") + """ where filled is not null)""")
_TRAIN_ONLY_SCORES = _TRAIN_ONLY.rstrip() + ", " + _FEATURES.replace("fx_clean", "fx_rows").replace(
    "partition by station", f"partition by {_BY_FOLD}").replace(
    "select station, timestamp,", "select fold, part, station, timestamp,") + f""",
fx_fits as (select fold, {_FIT} from fx_features where part = 'train' group by fold),
fx_said as (
  select 'persistence' as model, fold, pm25 as y, pm25_lag_1h as yhat from fx_features
  where part = 'test' and fold in (select fold from fx_fits)
  union all
  select 'ridge', fold, pm25, my + w * (pm25_lag_1h - mx) / sx from fx_features join fx_fits using (fold)
  where part = 'test'),
fx_said_metrics as (
  select model, fold, avg(abs(y - yhat)) as mae, sqrt(avg((y - yhat) * (y - yhat))) as rmse,
         avg(case when y > 1 then abs((y - yhat) / y) end) * 100 as mape,
         1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(y)) as r2
  from fx_said group by 1, 2)
select model, """ + ", ".join(
    f"round_even(avg({m}), 3) as {m}, round_even(stddev_pop({m}), 3) as {m}_std"
    for m in ("mae", "rmse", "mape", "r2")) + " from fx_said_metrics group by 1"
_FEATURE_ROWS = FEATURES + f"select {_ST}, {_FEATURE_OUT} from fx_features"

ORACLE: dict[str, str] = {
    "station_feed_rows": BASE + """select station, h as timestamp,
        case when sk%5=0 then null else cast(cents as double) end as pm25,
        cast(null as double) as pm10, case when sk%5=0 then null else no2 end as no2,
        cast(null as double) as o3, case when sk%3=0 then null else cast(n as double) end as aqi
        from fx_obs where sk%11<>0""",
    "station_feed_rejects": BASE + "select station, 'status' as reason, count(*) as n from fx_obs where sk%11=0 group by 1",
    "weather_payload_rows": BASE + "select * from fx_cov",
    "bounded_history_load": """select event_id, ts, value from events
        where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-19'""",
    "history_splice": BASE + f"""select {_ST}, {r('pm25', 'aqi', 'no2', 'o3', 'pm10')} from (
        select *, cast(null as double) as pm10 from fx_readings
        where timestamp < (select min(timestamp) from fx_readings
                           where timestamp >= timestamp '2024-01-24')
        union all select *, pm25 * 2 from fx_readings
        where timestamp >= timestamp '2024-01-24')""",
    "dated_sink": BASE + f"select {_ST}, {r('pm25', 'aqi', 'no2', 'o3')} from fx_readings",
    "dated_csv_sink": BASE + f"select timestamp, {r(*_WX)} from fx_cov",
    "result_records": FOLDED + f"select model, {', '.join(_METRICS)} from fx_scores",
    "hour_floor": "select event_id, date_trunc('hour', ts) as ts from events",
    "column_projection": BASE + f"select timestamp, {r('pm25', 'aqi', 'no2', 'o3')} "
                                "from fx_readings",
    "negative_clip": f"select event_id, round(case when pm25 < 0 then 0 else pm25 end + 3.3e-10, 6) "
                     f"as pm25 from {_SHIFTED}",
    "fence_clip": _with(_FX, _CLEAN) + f"select {_ST}, {r('pm25', 'no2', 'o3')} from fx_clipped",
    "divisor_floor": BASE + "select timestamp, round(case when wind_speed < 0.1 then 0.1 else "
                            "wind_speed end + 3.3e-10, 6) as wind_speed from fx_cov",
    "live_overlay": BASE + f""", live as (
        select event_type as station, date_trunc('hour', ts) as hour,
               case when event_id % 2 = 0 then value end as new_value
        from (select *, row_number() over (partition by event_type order by event_id desc) as rn
              from events) where rn = 1)
        select p.station, p.timestamp, round(case when p.timestamp = hour then new_value
               else pm25 end + 3.3e-10, 6) as pm25
        from fx_panel p left join live l on l.station = p.station""",
    "history_splice_by_station": BASE + f"""select {_ST}, {r('pm25', 'aqi', 'no2', 'o3', 'pm10')} from (
        select *, cast(null as double) as pm10 from fx_readings r where timestamp < (
          select min(timestamp) from fx_readings l where l.station = r.station
          and timestamp >= timestamp '2024-01-24' + to_hours(length(station)::int))
        union all select *, pm25 * 2 from fx_readings
        where timestamp >= timestamp '2024-01-24' + to_hours(length(station)::int))""",
    "clean_with_live": _OVERLAID + f"select {_ST}, {_CLEAN_COLUMNS} from fx_clean",
    "ingest_run": _INGESTED + f"select {_ST}, {_CLEAN_COLUMNS} from fx_clean",
    "drop_missing_target": BASE + f"select {_ST}, {r('pm25', 'aqi')} from fx_panel "
                                  "where pm25 is not null",
    "drop_incomplete_rows": BASE + f"""select {_ST}, {r('pm25', 'temp', 'humidity', 'no2')}
        from fx_panel where pm25 is not null and temp is not null and humidity is not null
        and no2 is not null and timestamp is not null""",
    "feature_presence": ALL + "\nunion all\n".join(
        f"select cast({i} as integer) as position, '{n}' as feature, count({n}) as present "
        "from fx_all" for i, n in enumerate(_FEATURE_SQL)),
    "clean_without_optional": CLEAN + f"""select {_ST}, {r('pm25', 'temp', 'wind_speed')}
        from fx_clean""",
    "hour_join": BASE + f"select {_ST}, {_CLEAN_COLUMNS} from fx_panel",
    "risk_bands": f"""select event_id, round(pm25 + 3.3e-10, 6) as pm25,
        cast({_band('pm25', 'band')} as integer) as band, {_band('pm25', 'label')} as label,
        {_band('pm25', 'color')} as color, {_band('pm25', 'action')} as action
        from {_SHIFTED}""",
    "alert_rows": f"""with per_band as (select cast({_band('pm25', 'band')} as integer) as band,
        count(*) as readings from {_SHIFTED} group by 1)
        select b.band, label, value_range, audience, action, coalesce(readings, 0) as readings
        from (values """ + ", ".join(
            f"({b['band']}, '{b['label']}', '{b['low']:.0f}–"
            f"{'∞' if b['high'] >= 999 else format(b['high'], '.0f')}', '{b['audience']}', "
            f"'{b['action']}')" for b in RISK_BANDS) + """)
        b(band, label, value_range, audience, action) left join per_band using (band)""",
    "quartile_fences": CLEAN + "select station, " + r(*[
        f"{c}_{x}" for c in ("pm25", "no2", "o3") for x in ("p25", "p75", "fence")])
        + " from fx_fences",
    "clipped_counts": CLEAN + "select station, " + ", ".join(
        f"count(*) filter (where {c} > {c}_fence) as {c}_clipped" for c in ("pm25", "no2", "o3"))
        + " from fx_panel join fx_fences using (station) group by station",
    "hour_profile": CLEAN + _profile("fx_clean", "timestamp", "pm25"),
    "station_hour_profile": CLEAN + _profile("fx_clean", "timestamp", "pm25", "station,"),
    "raw_hour_profile": _profile("events", "ts", "value"),
    "trailing_statistics": CLEAN + f"""select station, round(avg(pm25) + 3.3e-10, 6) as mean,
        round(max(pm25) + 3.3e-10, 6) as max, count(*) filter (where pm25 > 55) as critical_rows,
        round(avg(case when pm25 > 12 then 1.0 else 0.0 end) * 100 + 3.3e-10, 6) as pct_over
        from {_last('fx_clean', 720)} group by station""",
    "describe_clean": CLEAN + _describe(["pm25", "temp", "humidity", "wind_speed", "no2"]),
    "stage_accounts": CLEAN + _account("panel", "fx_panel", "pm25 is not null") + " union all "
        + _account("clean", "fx_clean", "pm25 is not null and no2 is not null"),
    "error_metrics": FOLDED + f"select model, fold, n, {r('mae', 'rmse', 'mape', 'r2')} "
                              "from fx_metrics",
    "fold_scores": FOLDED + f"select model, {', '.join(_METRICS)} from fx_scores",
    "guideline_ratio": "select event_id, round(value / 5.0::double + 3.3e-10, 6) as ratio from events",
    "target_lags": _feature_sql(*[f"pm25_lag_{k}h" for k in (1, 3, 6, 12, 24, 48, 168)]),
    "trailing_means": _feature_sql(*[f"pm25_rolling_{t}" for t in ("3h", "6h", "24h", "7d")]),
    "trailing_deviations": _feature_sql("pm25_std_24h", "pm25_std_7d"),
    "trailing_precip": _feature_sql("precip_lag_3h"),
    "pressure_change": _feature_sql("pressure_change_3h"),
    "secondary_lags": _feature_sql("no2_lag_1h", "no2_lag_24h"),
    "edge_fill": BASE + f"select {_ST}, " + ", ".join(
        f"round({_edge(c)} + 3.3e-10, 6) as {c}" for c in ("temp", "no2", "o3")) + " from fx_panel",
    "line_fill": BASE + f"select {_ST}, round(filled + 3.3e-10, 6) as pm25 from "
                 + _line("(select station, timestamp, pm25 from fx_panel)", "pm25"),
    "row_position": "select event_type, event_id, row_number() over (partition by event_type "
                    "order by ts, event_id) - 1 as position from events",
    "latest_row": CLEAN + f"select {_ST}, {_CLEAN_COLUMNS} from {_last('fx_clean', 1)}",
    "last_week": CLEAN + f"select {_ST}, {r('pm25')} from {_last('fx_clean', 168)}",
    "time_order": CLEAN + f"select {_ST}, {r('pm25')}, row_number() over (partition by station "
                          "order by timestamp) - 1 as position from fx_clean",
    "tail_preview": CLEAN + f"select {_ST}, {_CLEAN_COLUMNS} from {_last('fx_clean', 5)}",
    "leaderboard": FOLDED + "select model, mae, rmse from fx_scores",
    "best_rule": FOLDED + "select model, mae from fx_scores order by mae, model limit 1",
    "widening_union": BASE + f"""select {_ST}, {r('pm25', 'pm10')} from (
        select station, timestamp, pm25, cast(null as double) as pm10 from fx_readings
        union all select null, timestamp, null, temp from fx_cov)""",
    "calendar_parts": """select event_id, cast(hour(ts) as integer) as hour,
        cast(isodow(ts) - 1 as integer) as dow, cast(month(ts) as integer) as month,
        cast(dayofyear(ts) as integer) as dayofyear,
        cast(case when isodow(ts) >= 6 then 1 else 0 end as integer) as is_weekend from events""",
    "cyclic_calendar": "select event_id, " + ", ".join(
        f"round({_FEATURE_SQL[n].replace('timestamp', 'ts')} + 3.3e-10, 6) as {n}" for n in (
            "hour_sin", "hour_cos", "month_sin", "month_cos", "dow_sin", "dow_cos"))
        + " from events",
    "wind_vector": BASE + "select timestamp, " + ", ".join(
        f"round({_FEATURE_SQL[n]} + 3.3e-10, 6) as {n}" for n in ("wind_u", "wind_v"))
        + " from fx_cov",
    "weather_interactions": BASE + "select timestamp, " + ", ".join(
        f"round({_FEATURE_SQL[n]} + 3.3e-10, 6) as {n}" for n in (
            "temp_sq", "temp_x_humidity", "stagnation_idx")) + " from fx_cov",
    "half_even_rounding": """select event_id,
        round_even(cast(cast(round(value*100) as bigint) % 1000 as double) / 8, 2) as two,
        round_even(cast(cast(round(value*100) as bigint) % 1000 as double) / 8, 1) as one
        from events""",
    "clean_rows": CLEAN + f"select {_ST}, {_CLEAN_COLUMNS} from fx_clean",
    "feature_matrix": _FEATURE_ROWS,
    "risk_now": CLEAN + f"""select {_ST}, {r('pm25')},
        cast({_band('pm25', 'band')} as integer) as band, {_band('pm25', 'label')} as label,
        {_band('pm25', 'color')} as color, {_band('pm25', 'action')} as action,
        round(pm25 / 5.0::double + 3.3e-10, 6) as guideline_ratio from {_last('fx_clean', 1)}""",
    "risk_week": CLEAN + f"""select {_ST}, {r('pm25')},
        cast({_band('pm25', 'band')} as integer) as band, {_band('pm25', 'color')} as color
        from {_last('fx_clean', 168)}""",
    "expanding_folds": CLEAN + f"""select {_ST}, cast(case when g < n - 5 * t then 0
        else (g - (n - 5 * t)) // t + 1 end as integer) as test_fold
        from fx_clean join (
          select timestamp, row_number() over (order by timestamp) - 1 as g,
                 count(*) over () as n, count(*) over () // 6 as t
          from (select distinct timestamp from fx_clean)) using (timestamp)""",
    "series_folds": CLEAN + f"""select {_ST}, cast(case when g < n - 5 * t then 0
        else (g - (n - 5 * t)) // t + 1 end as integer) as test_fold
        from (select *, row_number() over (partition by station order by timestamp) - 1 as g,
                     count(*) over (partition by station) as n,
                     count(*) over (partition by station) // 6 as t from fx_clean)""",
    "persistence_scores": FOLDED + f"select model, {', '.join(_METRICS)} from fx_scores "
                                   "where model = 'persistence'",
    "ridge_fold_rows": _RIDGE + f"select model, fold, {r('y', 'yhat')} from fx_ridge",
    "ridge_one_feature_scores": _RIDGE_SCORES + f"select model, {', '.join(_METRICS)} from fx_ridge_scores",
    "saved_ridge_forecast": FEATURES + f"""select {_ST}, round(pm25 + 3.3e-10, 6) as actual,
        round(my + w * (pm25_lag_1h - mx) / sx + 3.3e-10, 6) as prediction
        from {_last('fx_features', 48)}, (select {_FIT} from fx_features)""",
    "experiment_choice": _RIDGE.rstrip() + """,
        both_rules as (select * from fx_ridge union all select * from fx_predictions where model = 'persistence'),
        by_fold as (select model, fold, avg(abs(y - yhat)) as mae from both_rules group by 1, 2),
        by_model as (select model, round_even(avg(mae), 3) as mae from by_fold group by 1),
        best as (select model from by_model order by mae, model limit 1)
        select model, mae, model in (from best) as chosen, model in (from best) as saved from by_model""",
    "series_ridge": FEATURES + """, sums as (
          select station, count(*) as n, avg(pm25) as my, avg(pm25_lag_1h) as m1, avg(temp) as m2,
                 stddev_pop(pm25_lag_1h) as s1, stddev_pop(temp) as s2,
                 count(*) * corr(pm25_lag_1h, temp) as r, count(*) * covar_pop(pm25_lag_1h, pm25) / stddev_pop(pm25_lag_1h) as b1,
                 count(*) * covar_pop(temp, pm25) / stddev_pop(temp) as b2 from fx_features group by 1),
        weights as (select *, ((n + 1) * b1 - r * b2) / ((n + 1) * (n + 1) - r * r) / s1 as w1,
                           ((n + 1) * b2 - r * b1) / ((n + 1) * (n + 1) - r * r) / s2 as w2 from sums)
        select station, n, round(w1 + 3.3e-10, 6) as w_lag, round(w2 + 3.3e-10, 6) as w_temp,
               round(my - w1 * m1 - w2 * m2 + 3.3e-10, 6) as intercept from weights""",
    "ridge_normal_equations": FOLDED + """select cast(fold as integer) as fold, count(*) as n, true as centred, feature, true as holds
        from fx_folded join (select unnest([1, 2, 3, 4, 5]) as fold) on test_fold < fold,
             (values """ + ", ".join(f"('{n}')" for n in _FEATURE_SQL) + """) f(feature) group by fold, feature""",
    "clean_train_only": _TRAIN_ONLY + f"select cast(fold as integer) as fold, part, {_ST}, {_CLEAN_COLUMNS} from fx_rows",
    "train_only_comparison": _TRAIN_ONLY_SCORES,
    "forest_fold_checks": FOLDED + """select cast(test_fold as integer) as fold, count(*) as n,
        true as finite, true as inside from fx_folded where test_fold > 0 group by 1""",
    "boosting_rounds": FOLDED + """select cast(test_fold as integer) as fold, count(*) as n,
        true as finite, true as waited, true as kept_best
        from fx_folded where test_fold > 0 group by 1""",
    "importance_checks": "select feature, true as sound from (values "
        + ", ".join(f"('{n}')" for n in _FEATURE_SQL) + ") f(feature)",
    "supplier_series_features": _line_features("l_suppkey"),
    "flag_series_features": _line_features("l_returnflag"),
    "flag_series_quartiles": "select l_returnflag, " + ", ".join(
        f"round(quantile_cont({c}, {p}) + 3.3e-10, 6) as {c}_{t}"
        for c in ("l_quantity", "l_extendedprice")
        for p, t in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.999, "p99_9")))
        + " from lineitem group by 1",
    "flag_series_fill": "select l_returnflag, l_orderkey, l_linenumber, l_partkey, "
        "round(filled + 3.3e-10, 6) as line, round(edge + 3.3e-10, 6) as edge from "
        + _line(f"""(select l_returnflag, {_LINE_ORDER}, line,
            {_edge('edge', 'l_returnflag', _LINE_ORDER)} as edge from (
            select *, case when l_orderkey % 5 >= 3 then l_extendedprice end as line,
                   case when l_orderkey % 5 >= 3 then l_tax end as edge from lineitem))""",
                "line", "l_returnflag", _LINE_ORDER),
    "flag_row_position": "select l_returnflag, l_orderkey, l_linenumber, l_partkey, row_number() "
        f"over (partition by l_returnflag order by {_LINE_ORDER}) - 1 as position from lineitem",
    "user_series_features": "select user_id, event_id, round(value + 3.3e-10, 6) as value, round("
        + _lag("value", 1, "user_id", "ts, event_id") + " + 3.3e-10, 6) as lag_1, "
        + ", ".join(f"round({_gate('avg', 'value', n, 'user_id', 'ts, event_id')} + 3.3e-10, 6) as mean_{n}"
                    for n in (3, 6))
        + f", round({_gate('stddev_samp', 'value', 6, 'user_id', 'ts, event_id')} + 3.3e-10, 6) as std_6 "
          "from events",
    "hourly_stream": BASE + "select station as event_type, h as timestamp, n, cents from fx_obs",
    "hourly_stream_late": BASE + "select station as event_type, h as timestamp, n, cents from fx_obs",
    "hourly_repairs": BASE + """select station as event_type, h as timestamp, n, cents, cast(2 as integer) as batch
        from fx_obs where (station, h) in (
          select (event_type, date_trunc('hour', ts)) from events
          where event_id % 50 = 0 and ts < timestamp '2024-01-16')""",
    "hourly_stream_closed": BASE + "select station as event_type, h as timestamp, n, cents from fx_obs",
    "feature_stream": _FEATURE_ROWS,
    "feature_stream_late": _FEATURE_ROWS,
}
