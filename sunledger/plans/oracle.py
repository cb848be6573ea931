"""The same results as plain SQL over the given tables, for any SQL engine to check."""

from __future__ import annotations

TZ = "Europe/Berlin"

_READINGS = f"""
ev AS (
  SELECT event_id AS seq, ts AS time, user_id, event_type, value,
         concat('S', user_id % 2) AS site_id, (user_id // 2) % 5 AS dv,
         CAST(round(value * 100) AS BIGINT) AS c, CAST(value - 20 AS FLOAT) AS power
  FROM events
),
rd AS (
  SELECT *, CASE dv WHEN 0 THEN 'inv0' WHEN 1 THEN 'inv1' WHEN 2 THEN 'grid' WHEN 3 THEN 'heatpump' ELSE 'aux' END AS device_name,
         CASE WHEN dv < 2 THEN 'inverter' ELSE 'meter' END AS kind,
         CAST(timezone('{TZ}', timezone('UTC', time)) AS DATE) AS day
  FROM ev
)"""

_SAMPLES = _READINGS + """,
cn AS (
  SELECT *, CAST(SUM(c) OVER w AS DOUBLE) AS ct,
         CAST(SUM(CASE WHEN event_type IN ('click', 'view') THEN c ELSE 0 END) OVER w AS DOUBLE) AS st
  FROM rd WINDOW w AS (PARTITION BY site_id, device_name ORDER BY time, seq ROWS UNBOUNDED PRECEDING)
),
sm AS (
  SELECT *, CASE WHEN seq % 50 = 0 THEN NULL WHEN seq % 47 = 0 THEN 0e0 ELSE ct / 100000e0 END AS imp,
         CASE WHEN seq % 50 = 0 THEN NULL ELSE st / 100000e0 END AS expo
  FROM cn
)"""

_SPINE = """
roster AS (
  SELECT DISTINCT site_id, device_name, kind,
         CASE WHEN device_name = 'grid' AND site_id = 'S0' THEN 'feed-in'
              WHEN device_name IN ('grid', 'heatpump') THEN 'consumption' END AS location,
         device_name = 'grid' AS is_primary
  FROM rd
),
spans AS (SELECT site_id, min(day) AS d0, max(day) AS d1 FROM rd GROUP BY 1),
spine AS (
  SELECT site_id, device_name, kind, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day
  FROM roster JOIN spans USING (site_id)
),
site_spine AS (SELECT DISTINCT site_id, day FROM spine)"""


def _ts(c: str, name: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def _date(c: str = "day", name: str = "day") -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {name}"


def _daylight(src: str) -> str:
    """Daylight of ``src`` (site_id, day, latitude, longitude, horizon_deg) as a table of CTEs ending in ``dl``."""
    noon = "(CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR)"
    return f"""
dl1 AS (
  SELECT *, radians(latitude) AS phi, dayofyear(day) AS doy,
         (epoch({noon}) - epoch(timezone('UTC', timezone('{TZ}', {noon})))) / 3600e0 AS off_h
  FROM {src}
),
dl2 AS (
  SELECT *, radians(23.45e0) * sin(2 * pi() / 365e0 * (doy + 284)) AS decl, radians(360e0 / 364e0 * (doy - 81)) AS b FROM dl1
),
dl3 AS (
  SELECT *, 9.87e0 * sin(2 * b) - 7.53e0 * cos(b) - 1.5e0 * sin(b) AS eot,
         (sin(radians(horizon_deg)) - sin(phi) * sin(decl)) / (cos(phi) * cos(decl)) AS cw
  FROM dl2
),
dl4 AS (
  SELECT *, CASE WHEN cw > -1 AND cw < 1 THEN degrees(acos(cw)) / 15e0 END AS half_h FROM dl3
),
dl5 AS (
  SELECT *, CAST(CASE WHEN cw <= -1 THEN 86400 WHEN cw >= 1 THEN 0 ELSE round_even(2 * half_h * 3600, 0) END AS BIGINT) AS seconds,
         CAST(round_even((12 + off_h - longitude / 15e0 - eot / 60e0 - half_h) * 3600, 0) AS BIGINT) AS rise_s
  FROM dl4
),
dl AS (
  SELECT site_id, day, seconds,
         timezone('UTC', timezone('{TZ}', CAST(day AS TIMESTAMP) + to_seconds(rise_s))) AS sunrise,
         timezone('UTC', timezone('{TZ}', CAST(day AS TIMESTAMP) + to_seconds(rise_s))) + to_seconds(seconds) AS sunset
  FROM dl5
)"""


_SITES = """
site AS (
  SELECT DISTINCT site_id, CASE WHEN site_id = 'S0' THEN 49.07e0 END AS latitude,
         CASE WHEN site_id = 'S0' THEN 9.15e0 END AS longitude, -0.833e0 AS horizon_deg FROM rd
),
site_days AS (SELECT * FROM site_spine JOIN site USING (site_id))"""

_FULL = f"""CAST(epoch(timezone('{TZ}', CAST(day + 1 AS TIMESTAMP))) - epoch(timezone('{TZ}', CAST(day AS TIMESTAMP))) AS BIGINT)"""


def _span(t0: str, t1: str) -> str:
    return f"CAST(round_even((epoch_us({t1}) - epoch_us({t0})) / 1e6, 0) AS BIGINT)"


def _bucket(seconds: int, c: str = "time") -> str:
    return f"(epoch_us({c}) // {seconds * 1000000})"


def _meter_days(bucket: int, cov: str, cont: str) -> str:
    return f"""
md0 AS (
  SELECT site_id, device_name, day, count(*) AS n, min(time) AS t0, max(time) AS t1,
         count(DISTINCT {_bucket(bucket)}) AS observed,
         arg_min(imp, time) FILTER (WHERE imp IS NOT NULL) AS i0, arg_max(imp, time) FILTER (WHERE imp IS NOT NULL) AS i1,
         arg_min(expo, time) FILTER (WHERE expo IS NOT NULL) AS e0, arg_max(expo, time) FILTER (WHERE expo IS NOT NULL) AS e1
  FROM sm WHERE kind = 'meter' GROUP BY 1, 2, 3
),
md1 AS (
  SELECT s.site_id, s.device_name, s.day, coalesce(n, 0) AS sample_count, t0, t1, i0, i1, e0, e1,
         CASE WHEN i1 >= i0 THEN i1 - i0 END AS imported_kwh, CASE WHEN e1 >= e0 THEN e1 - e0 END AS exported_kwh,
         coalesce({_span('t0', 't1')}, 0) AS span_s, {_FULL} AS full_secs,
         coalesce(observed, 0) AS observed
  FROM (SELECT * FROM spine WHERE kind = 'meter') s LEFT JOIN md0 USING (site_id, device_name, day)
),
md2 AS (
  SELECT *, span_s / CAST(full_secs AS DOUBLE) AS coverage, observed * {bucket}e0 / full_secs AS continuity FROM md1
),
meter_days AS (
  SELECT *, imported_kwh IS NOT NULL AND exported_kwh IS NOT NULL AND coverage >= {cov} AS complete,
         sample_count > 0 AND continuity >= {cont} AS continuous,
         CASE WHEN sample_count = 0 THEN 'no samples for day'
              WHEN imported_kwh IS NULL OR exported_kwh IS NULL THEN 'counter unavailable or went backwards'
              WHEN coverage < {cov} THEN concat('needs review: coverage ', CAST(round_even(100 * coverage, 0) AS BIGINT), '% (', span_s, '/', full_secs, ' s)')
         END AS notes
  FROM md2
)"""


def _inverter_days(bucket: int, cov: str, cont: str) -> str:
    return f"""
id0 AS (
  SELECT site_id, device_name, day, count(imp) AS n, count(DISTINCT {_bucket(bucket)}) AS observed,
         min(time) FILTER (WHERE imp IS NOT NULL) AS t0, max(time) FILTER (WHERE imp IS NOT NULL) AS t1,
         arg_min(imp, time) FILTER (WHERE imp IS NOT NULL) AS k0, arg_max(imp, time) FILTER (WHERE imp IS NOT NULL) AS k1
  FROM sm WHERE kind = 'inverter' GROUP BY 1, 2, 3
),
id1 AS (
  SELECT s.site_id, s.device_name, s.day, coalesce(n, 0) AS sample_count, t0, t1, k0, k1, observed, dl.seconds AS daylight_s,
         CASE WHEN k1 >= k0 THEN k1 - k0 END AS produced_kwh, coalesce({_span('t0', 't1')}, 0) AS span_s,
         CASE WHEN dl.seconds > 0 THEN dl.seconds ELSE {_FULL.replace('day', 's.day')} END AS expected
  FROM (SELECT * FROM spine WHERE kind = 'inverter') s LEFT JOIN id0 USING (site_id, device_name, day)
  LEFT JOIN dl ON dl.site_id = s.site_id AND dl.day = s.day
),
id2 AS (
  SELECT *, span_s / CAST(expected AS DOUBLE) AS coverage,
         CASE WHEN sample_count = 0 THEN 0 ELSE observed * {bucket}e0 / expected END AS continuity,
         coalesce(daylight_s, 0) > 0 AS judged
  FROM id1
),
inverter_days AS (
  SELECT *, coalesce(produced_kwh > 0, FALSE) AND (NOT judged OR coverage >= {cov}) AS complete,
         sample_count > 0 AND (NOT judged OR continuity >= {cont}) AS continuous,
         CASE WHEN sample_count = 0 THEN 'no samples for day'
              WHEN produced_kwh IS NULL THEN 'counter unavailable or went backwards'
              WHEN produced_kwh = 0 THEN 'needs review: zero production'
              WHEN judged AND coverage < {cov} THEN concat('needs review: coverage ', CAST(round_even(100 * coverage, 0) AS BIGINT), '% (', span_s, '/', daylight_s, ' s)')
         END AS notes
  FROM id2
)"""


def _power(bucket: int, name: str = "pw") -> str:
    return f"""
{name} AS (
  SELECT site_id, device_name, kind, make_timestamp({_bucket(bucket)} * {bucket * 1000000}) AS bucket,
         avg(CAST(power AS DOUBLE)) AS avg_power, min(power) AS min_power, max(power) AS max_power
  FROM rd GROUP BY ALL
)"""


_CONTRIB = """
prim AS (SELECT site_id, device_name, location FROM roster WHERE kind = 'meter' AND is_primary AND location IS NOT NULL),
contrib AS (
  SELECT site_id, device_name, 'inverter' AS role, 0 AS ord FROM roster WHERE kind = 'inverter'
  UNION ALL SELECT site_id, device_name, 'primary', 1 FROM prim
)"""

_OVERLAP = f"""
side AS (
  SELECT p.*, role, CAST(timezone('{TZ}', timezone('UTC', bucket)) AS DATE) AS day, greatest(avg_power, 0) AS w
  FROM pw p JOIN contrib USING (site_id, device_name)
),
ov AS (
  SELECT coalesce(a.site_id, b.site_id) AS site_id, coalesce(a.day, b.day) AS day, coalesce(a.bucket, b.bucket) AS bucket,
         coalesce(a.w, 0) AS pw, coalesce(b.w, 0) AS cw
  FROM (SELECT site_id, day, bucket, sum(w) AS w FROM side WHERE role = 'inverter' GROUP BY ALL) a
  FULL OUTER JOIN (SELECT site_id, day, bucket, w FROM side WHERE role = 'primary') b
  ON a.site_id = b.site_id AND a.bucket = b.bucket
)"""


def _site_energy(bucket: int) -> str:
    return f"""
ovd AS (SELECT site_id, day, count(*) AS n_buckets, sum(least(pw, cw)) * {bucket}e0 / 3600e0 / 1000e0 AS overlap_kwh FROM ov GROUP BY 1, 2),
prod AS (
  SELECT site_id, day, coalesce(sum(produced_kwh), 0) AS prod FROM inverter_days
  WHERE (site_id, device_name) IN (SELECT (site_id, device_name) FROM roster WHERE kind = 'inverter') GROUP BY 1, 2
),
flags AS (
  SELECT c.site_id, s.day, bool_and(coalesce(i.complete, m.complete, FALSE)) AS complete,
         bool_and(coalesce(i.continuous, m.continuous, FALSE)) AS continuous,
         'incomplete: ' || string_agg(c.device_name, ', ' ORDER BY ord, c.device_name) FILTER (WHERE NOT coalesce(i.complete, m.complete, FALSE)) AS incomplete
  FROM contrib c JOIN site_spine s USING (site_id)
  LEFT JOIN inverter_days i ON i.site_id = c.site_id AND i.device_name = c.device_name AND i.day = s.day
  LEFT JOIN meter_days m ON m.site_id = c.site_id AND m.device_name = c.device_name AND m.day = s.day
  GROUP BY 1, 2
),
se0 AS (
  SELECT s.site_id, s.day, p.location, coalesce(prod, 0) AS prod, m.imported_kwh AS imp, m.exported_kwh AS expo,
         coalesce(n_buckets, 0) AS n_buckets, overlap_kwh, f.complete, f.continuous, f.incomplete,
         (SELECT count(*) FROM contrib c WHERE c.site_id = s.site_id AND role = 'inverter') AS n_inv
  FROM site_spine s LEFT JOIN prim p USING (site_id)
  LEFT JOIN prod USING (site_id, day)
  LEFT JOIN meter_days m ON m.site_id = s.site_id AND m.device_name = p.device_name AND m.day = s.day
  LEFT JOIN ovd ON ovd.site_id = s.site_id AND ovd.day = s.day
  LEFT JOIN flags f ON f.site_id = s.site_id AND f.day = s.day
),
se1 AS (
  SELECT *, CASE WHEN location IS NULL THEN 'no primary meter'
                 WHEN location = 'feed-in' AND (imp IS NULL OR expo IS NULL) THEN 'grid meter row missing'
                 WHEN location = 'feed-in' THEN NULL
                 WHEN imp IS NULL THEN 'consumption meter row missing'
                 WHEN n_inv = 0 THEN 'no inverters configured'
                 WHEN n_buckets = 0 THEN 'no power data for day' END AS early,
         CASE WHEN location = 'feed-in' THEN greatest(prod - expo, 0) ELSE least(coalesce(overlap_kwh, 0), prod, imp) END AS self
  FROM se0
),
site_energy AS (
  SELECT site_id, day, early IS NULL AS written, coalesce(early, incomplete) AS notes,
         CASE WHEN early IS NULL THEN prod END AS production_kwh,
         CASE WHEN early IS NULL THEN CASE WHEN location = 'feed-in' THEN self + imp ELSE imp END END AS consumption_kwh,
         CASE WHEN early IS NULL THEN self END AS self_consumption_kwh,
         CASE WHEN early IS NULL THEN CASE WHEN location = 'feed-in' THEN imp ELSE imp - self END END AS from_grid_kwh,
         CASE WHEN early IS NULL THEN CASE WHEN location = 'feed-in' THEN expo ELSE prod - self END END AS to_grid_kwh,
         CASE WHEN early IS NULL THEN complete END AS complete, CASE WHEN early IS NULL THEN continuous END AS continuous
  FROM se1
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


STRICT = {"inverter": (30, "0.9e0", "0.9e0"), "meter": (30, "0.995e0", "0.9e0"), "bucket": 30}
LOOSE = {"inverter": (3600, "0.95e0", "0.75e0"), "meter": (3600, "0.95e0", "0.75e0"), "bucket": 3600}


def _devices(p: dict) -> list[str]:
    return [_SAMPLES, _SPINE, _SITES, _daylight("site_days"), _inverter_days(*p["inverter"]), _meter_days(*p["meter"])]


def _site(p: dict) -> list[str]:
    return [*_devices(p), _power(p["bucket"]), _CONTRIB, _OVERLAP, _site_energy(p["bucket"])]


_METER_OUT = f"""SELECT site_id, device_name, {_date()}, imported_kwh, exported_kwh, coverage, complete, continuity, continuous,
  sample_count, {_ts('t0', 'first_ts')}, {_ts('t1', 'last_ts')}, i0 AS imported_kwh_first, i1 AS imported_kwh_last,
  e0 AS exported_kwh_first, e1 AS exported_kwh_last, notes FROM meter_days"""
_INVERTER_OUT = f"""SELECT site_id, device_name, {_date()}, produced_kwh, coverage, complete, continuity, continuous,
  sample_count, {_ts('t0', 'first_ts')}, {_ts('t1', 'last_ts')}, k0 AS first_kwh, k1 AS last_kwh, notes FROM inverter_days"""


def _r(cols: list[str], places: int = 9) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


_FIGURES = ["production_kwh", "consumption_kwh", "self_consumption_kwh", "from_grid_kwh", "to_grid_kwh"]
_SITE_OUT = f"""SELECT site_id, {_date()}, {_r(_FIGURES)}, complete, continuous, notes, written FROM site_energy"""

ORACLE: dict[str, str] = {
    "meter_daily": _with(*_devices(STRICT)) + _METER_OUT,
    "meter_daily_hourly": _with(*_devices(LOOSE)) + _METER_OUT,
    "inverter_daily": _with(*_devices(STRICT)) + _INVERTER_OUT,
    "inverter_daily_hourly": _with(*_devices(LOOSE)) + _INVERTER_OUT,
    "site_rollup": _with(*_site(STRICT)) + _SITE_OUT,
    "site_rollup_hourly": _with(*_site(LOOSE)) + _SITE_OUT,
}

# --- scans, sources, sinks ----------------------------------------------------

_KEY = "site_id, device_name"


def _q(x: str, places: int) -> str:
    """Round half away from zero at ``places`` decimals of the scaled double."""
    return f"(round(({x}) * 1e{places}) / 1e{places})"


# Inverter readings at output precision; w is the counter in whole Wh.
_INV = _SAMPLES + """,
ir AS (
  SELECT site_id, device_name, time, seq, user_id, value AS v, ct / 100e0 AS wh, user_id % 3 + 1 AS np, user_id % 2 + 1 AS ni,
         user_id % 4 = 0 AS hybrid, value - 20e0 AS pa, CASE WHEN seq % 13 = 0 THEN 0e0 ELSE value * 1.07e0 END AS dc
  FROM cn WHERE kind = 'inverter'
)"""
_INV_EFF = _q("CASE WHEN abs(dc) > 1e-12 THEN pa / dc * 100 ELSE 0e0 END", 2)
_MET = _SAMPLES + """,
mr AS (
  SELECT site_id, device_name, time, seq, user_id, value AS v, ct / 100e0 AS imp_wh, st / 100e0 AS exp_wh, user_id % 3 + 1 AS np
  FROM cn WHERE kind = 'meter'
)"""


def _f32(x: str, name: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE) AS {name}"


ORACLE |= {
    "sample_scan": _with(_SAMPLES) + f"""SELECT {_KEY}, {_ts('time', 'time')}, seq, imp AS energy_active_import, CAST(power AS DOUBLE) AS power_active
FROM sm WHERE kind = 'meter' AND time >= TIMESTAMP '2024-01-05 06:00:00' AND time < TIMESTAMP '2024-01-12 18:30:00'""",
    "dim_scan": _with(_READINGS, _SPINE, _SITES) + """SELECT site_id, device_name, kind, location, is_primary, latitude, longitude, horizon_deg
FROM roster JOIN site USING (site_id)""",
    "telemetry_json_scan": _with(_INV) + f"""SELECT {_KEY}, seq, bad AS malformed, CASE WHEN NOT bad THEN strftime(make_timestamp(epoch_us(time) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') END AS time,
  CASE WHEN NOT bad THEN round(wh) / 1000e0 END AS ac_energy, CASE WHEN NOT bad THEN {_q('pa', 2)} END AS ac_power_active,
  CASE WHEN NOT bad THEN {_INV_EFF} END AS efficiency, CASE WHEN NOT bad THEN np END AS n_phases,
  CASE WHEN NOT bad AND NOT hybrid THEN round(wh * 0.5e0) / 1000e0 END AS dc_energy_1
FROM (SELECT *, seq % 97 = 0 AS bad FROM ir)""",
    "telemetry_json_scan_meter": _with(_MET) + f"""SELECT {_KEY}, seq, FALSE AS malformed, strftime(make_timestamp(epoch_us(time) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') AS time,
  round(imp_wh) / 1000e0 AS energy_active_import, round(exp_wh) / 1000e0 AS energy_active_export, {_q('v - 20e0', 2)} AS power_active,
  {_q('v / 230e0', 3)} AS current, np AS n_phases, {_q('v - 20e0', 2)} AS power_active_1 FROM mr""",
    "telemetry_json_sink": _with(_INV) + f"""SELECT concat('fleet/', site_id, '/inverter/', device_name, '/values') AS topic, seq, epoch_us(time) // 1000 AS time_ms,
  round(wh) / 1000e0 AS ac_energy, {_q('v * 0.01e0 + 231e0', 1)} AS ac_voltage_1,
  CASE WHEN ni = 2 AND NOT hybrid THEN round(wh * 0.5e0 * 2) / 1000e0 END AS dc_energy_2, NOT hybrid AS has_dc_energy, 11 AS n_fields FROM ir""",
    "sample_fanout_samples": _with(_INV) + f"""SELECT {_KEY}, {_ts('time', 'time')}, seq, round(wh) / 1000e0 AS ac_energy,
  {_f32(_q('pa', 2), 'ac_power_active')}, {_f32(_q('abs(pa) * 1.02e0', 2), 'ac_power_apparent')}, {_f32(_q('v * 0.1e0', 2), 'ac_power_reactive')},
  CAST(100 - seq % 200 AS DOUBLE) AS ac_power_factor, {_f32(_q('50 + (seq % 7) * 0.013e0', 2), 'ac_frequency')},
  {_f32(_q('dc', 2), 'dc_power')}, {_f32(_INV_EFF, 'efficiency')} FROM ir""",
    "sample_fanout_phases": _with(_INV) + f"""SELECT {_KEY}, {_ts('time', 'time')}, i AS phase_id,
  {_f32(_q('v * 0.01e0 + (230 + i)', 1), 'ac_voltage')}, {_f32(_q('v / 230e0 / i', 3), 'ac_current')}
FROM ir, range(1, 4) AS r(i) WHERE i <= np""",
    "sample_fanout_inputs": _with(_INV) + f"""SELECT {_KEY}, {_ts('time', 'time')}, i AS input_id,
  {_f32(_q('v * 0.1e0 + (290 + i)', 1), 'dc_voltage')}, {_f32(_q('v / 290e0 / i', 3), 'dc_current')}, {_f32(_q('v * 0.5e0 * i', 2), 'dc_power')},
  CASE WHEN NOT hybrid THEN round(wh * 0.5e0 * i) / 1000e0 END AS dc_energy FROM ir, range(1, 3) AS r(i) WHERE i <= ni""",
    "sample_fanout_meter_samples": _with(_MET) + f"""SELECT {_KEY}, {_ts('time', 'time')}, seq,
  round(imp_wh) / 1000e0 AS energy_active_import, round(exp_wh) / 1000e0 AS energy_active_export,
  round(imp_wh * 1.1e0) / 1000e0 AS energy_apparent_import, round(exp_wh * 1.1e0) / 1000e0 AS energy_apparent_export,
  round(imp_wh * 0.3e0) / 1000e0 AS energy_reactive_import, round(exp_wh * 0.3e0) / 1000e0 AS energy_reactive_export,
  {_f32(_q('v - 20e0', 2), 'power_active')}, {_f32(_q('v * 1.02e0', 2), 'power_apparent')}, {_f32(_q('v * 0.1e0', 2), 'power_reactive')},
  {_f32('0.97e0', 'power_factor')}, 50e0 AS frequency, {_f32(_q('v * 0.01e0 + 230', 1), 'voltage_ph')},
  {_f32(_q('v * 0.02e0 + 398', 1), 'voltage_pp')}, {_f32(_q('v / 230e0', 3), 'current')} FROM mr""",
    "sample_fanout_meter_phases": _with(_MET) + f"""SELECT {_KEY}, {_ts('time', 'time')}, i AS phase_id,
  {_f32(_q('v * i - 20', 2), 'power_active')}, {_f32(_q('v * 1.02e0 * i', 2), 'power_apparent')}, {_f32(_q('v * 0.1e0 * i', 2), 'power_reactive')},
  {_f32(_q('0.25e0 * i', 2), 'power_factor')}, {_f32(_q('v * 0.01e0 + (230 + i)', 1), 'voltage_ph')},
  {_f32(_q('v * 0.02e0 + (398 + i)', 1), 'voltage_pp')}, {_f32(_q('v / 230e0 / i', 3), 'current')}
FROM mr, range(1, 4) AS r(i) WHERE i <= np""",
    "device_upsert": _with(_READINGS) + f"""SELECT {_KEY}, concat('SN', user_id % 3) AS serial_number, concat('fw', CAST(floor(arg_max(value, time)) AS BIGINT)) AS firmware_version,
  arg_max(user_id, time) AS slave_id, {_ts('min(time)', 'first_seen')}, {_ts('max(time)', 'last_seen')}
FROM rd WHERE event_type = 'signup' GROUP BY site_id, device_name, user_id % 3""",
}

_FLEET = """
fleet AS (
  SELECT concat('N', c_nationkey) AS site_id, concat('dev_', c_custkey) AS device_name, c_nationkey, c_custkey,
         CASE WHEN c_custkey % 3 = 0 THEN 'inverter' ELSE 'meter' END AS kind,
         CASE WHEN c_custkey % 3 = 1 THEN 'feed-in' WHEN c_custkey % 6 = 2 THEN 'consumption' END AS location,
         c_custkey % 3 <> 0 AND c_custkey % 31 = 0 AS is_primary
  FROM customer
),
conf AS (SELECT * FROM fleet WHERE c_custkey % 5 <> 0 AND c_nationkey % 2 = 0)"""
_SUPPLIER = """
sd AS (
  SELECT concat('N', s_nationkey) AS site_id, concat('dev_', s_suppkey % 10) AS device_name, s_name AS serial_number,
         CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 7 = 0 THEN 'other' WHEN s_suppkey % 2 = 0 THEN 'float' ELSE 'int+sf' END AS register_model,
         s_suppkey % 3 AS meter_id, s_suppkey * 3 AS slave_id, s_suppkey % 4 AS mppt_tracker, s_suppkey % 5 + 1 AS phases
  FROM supplier
)"""
_CUSTOMER_ROSTER = """
cr AS (
  SELECT concat('N', c_nationkey) AS site_id,
         CASE WHEN c_custkey % 11 = 0 THEN 'meter' WHEN c_custkey % 13 = 0 THEN 'bad name' WHEN c_custkey % 17 = 0 THEN repeat('x', 40)
              WHEN c_custkey % 19 = 0 THEN '' ELSE concat('dev_', c_custkey % 700) END AS device_name,
         CASE WHEN c_custkey % 3 = 0 THEN 'inverter' ELSE 'meter' END AS kind,
         CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'feed-in' ELSE 'consumption' END AS location,
         c_custkey % 30 = 1 OR c_custkey % 60 = 4 AS is_primary
  FROM customer
)"""
_EL = """
el AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice AS s, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q,
         CASE WHEN l_linenumber = 5 THEN l_extendedprice * 1.5e0 ELSE l_extendedprice * (1e0 - l_discount) END AS p,
         CASE WHEN l_linenumber = 7 THEN 0e0 ELSE l_discount * 100 + 230 END AS v,
         CASE WHEN l_discount = 0 THEN 0e0 ELSE l_quantity * 2 END AS dc,
         CASE WHEN l_linestatus = 'O' THEN 'proprietary' ELSE 'sunspec' END AS register_map
  FROM lineitem
)"""
_LINE = "SELECT l_orderkey, l_linenumber,"
_TG = _SAMPLES + """,
tg AS (
  SELECT *, CASE WHEN seq % 33 = 0 THEN 'incomplete telegram' WHEN seq % 20 = 0 THEN 'malformed line' END AS reject_reason
  FROM cn WHERE kind = 'meter'
)"""

ORACLE |= {
    "registry_sync": _with(_FLEET) + """SELECT site_id, device_name, 'meter' AS kind, NULL::VARCHAR AS location, FALSE AS is_primary FROM conf
UNION ALL SELECT site_id, device_name, kind, location, is_primary FROM fleet WHERE site_id NOT IN (SELECT site_id FROM conf)""",
    "registry_anti": _with(_FLEET) + """SELECT site_id, device_name FROM fleet WHERE site_id IN (SELECT site_id FROM conf)
EXCEPT ALL SELECT site_id, device_name FROM conf""",
    "site_upsert": """WITH n AS (SELECT n_nationkey AS k, concat('N', n_nationkey) AS site_id FROM nation),
c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 0 AND c_nationkey % 3 <> 0)
SELECT site_id, CASE WHEN c.k IS NULL THEN -84 + n.k * 7e0 WHEN n.k % 2 = 0 THEN n.k * 1.5e0 END AS latitude,
  CASE WHEN c.k IS NULL THEN -180 + n.k * 14.4e0 WHEN n.k % 2 = 0 THEN n.k * 2.5e0 END AS longitude,
  CASE WHEN c.k IS NOT NULL AND n.k % 4 = 0 THEN -2e0 ELSE -0.833e0 END AS horizon_deg
FROM n LEFT JOIN c ON n.k = c.k""",
    "daily_upsert": f"""WITH a AS ({_with(*_devices(STRICT)) + _METER_OUT}), b AS ({_with(*_devices(LOOSE)) + _METER_OUT})
SELECT site_id, device_name, day, imported_kwh, exported_kwh, coverage, complete, continuity, continuous, sample_count, notes
FROM a WHERE NOT (device_name = 'grid' AND day >= '2024-01-15') UNION ALL
SELECT site_id, device_name, day, imported_kwh, exported_kwh, coverage, complete, continuity, continuous, sample_count, notes
FROM b WHERE device_name = 'grid' AND day >= '2024-01-15'""",
    # --- derivations ---
    "scale_to_kilo": _with(_EL) + f"{_LINE} s / 1000e0 AS kilo FROM el",
    "quantise": _with(_EL) + f"{_LINE} round(x) AS energy, {_q('x', 1)} AS voltage, {_q('x', 3)} AS current, {_q('x', 2)} AS power FROM (SELECT *, s * q / 7e0 AS x FROM el)",
    "float_narrow": _with(_EL) + f"{_LINE} {_f32('s', 'narrowed')}, {_f32('q / 3e0', 'third')} FROM el",
    "efficiency": _with(_EL) + f"{_LINE} CASE WHEN abs(dc) > 1e-12 THEN q / dc * 100e0 ELSE 0e0 END AS efficiency FROM el",
    "hybrid_null": _with(_INV) + f"SELECT {_KEY}, seq, hybrid, CASE WHEN NOT hybrid THEN wh END AS dc_energy FROM ir",
    "energy_from_sunspec": _with(_EL) + f"""{_LINE} p * p > s * s AS not_a_number,
  CASE WHEN p * p <= s * s THEN round((CASE WHEN q >= 0 THEN 1 ELSE -1 END) * sqrt(s * s - p * p), 6) END AS reactive FROM el""",
    "energy_from_proprietary": _with(_EL) + f"{_LINE} round(sqrt(p * p + q * q), 6) AS apparent FROM el",
    "current_total": _with(_EL) + f"{_LINE} register_map, CASE register_map WHEN 'proprietary' THEN q / 3e0 + q / 5e0 + q / 7e0 ELSE q END AS current FROM el",
    "grid_assumption_derive": _with(_EL, """
pv AS (SELECT *, p / 2e0 AS p1, p / 4e0 AS p2, q AS p3, v AS v1, v + 1 AS v2, v + 2 AS v3, 0.98e0 AS pf FROM el),
pp AS (
  SELECT *, sqrt(v1 * v1 + v2 * v2 + v1 * v2) AS l1, sqrt(v2 * v2 + v3 * v3 + v2 * v3) AS l2, sqrt(v3 * v3 + v1 * v1 + v3 * v1) AS l3,
         CASE WHEN v1 <> 0 THEN abs(p1 / (v1 * pf)) END AS c1, CASE WHEN v2 <> 0 THEN abs(p2 / (v2 * pf)) END AS c2,
         CASE WHEN v3 <> 0 THEN abs(p3 / (v3 * pf)) END AS c3
  FROM pv
)""") + f"""{_LINE} round(s, 6) AS energy_active_import, 0e0 AS energy_active_export, round(abs(s / pf), 6) AS energy_apparent_import, 0e0 AS energy_apparent_export,
  round(sin(acos(pf)) * abs(s / pf), 6) AS energy_reactive_import, 0e0 AS energy_reactive_export, round(p, 6) AS power_active, round(abs(p / pf), 6) AS power_apparent,
  round(tan(acos(pf)) * p, 6) AS power_reactive, 0.98e0 AS power_factor, 50e0 AS frequency, round((v1 + v2 + v3) / 3, 6) AS voltage_ph,
  round((l1 + l2 + l3) / 3, 6) AS voltage_pp, round(c1 + c2 + c3, 6) AS current, round(c1, 6) AS current_1, round(l1, 6) AS voltage_pp_1,
  round(tan(acos(pf)) * p1, 6) AS power_reactive_1 FROM pp""",
    "telegram_ingest": _with(_TG) + f"""SELECT {_KEY}, seq, {_ts('time', 'received_at')}, concat('1M', site_id, device_name) AS serial_number, '107' AS firmware_version,
  'EasyMeter' AS manufacturer, 'DD3-BZ06-ETA-ODZ1' AS model, 3 AS phases, ct / 100000e0 * 1000 AS energy, (c - 2000) / 100e0 AS power,
  c * 2 / 100e0 AS power_2, CAST(230 + seq % 30 AS DOUBLE) AS voltage_3 FROM tg WHERE reject_reason IS NULL""",
    "telegram_rejects": _with(_TG) + f"SELECT {_KEY}, seq, reject_reason FROM tg WHERE reject_reason IS NOT NULL",
    "meter_identity_nulls": _with(_SUPPLIER) + f"""SELECT {_KEY}, serial_number, CASE WHEN register_model <> '' THEN register_model END AS register_model,
  CASE WHEN meter_id > 0 THEN meter_id END AS meter_id, CASE WHEN slave_id > 0 THEN slave_id END AS slave_id FROM sd""",
    "day_filter": _with(_READINGS) + f"""SELECT {_KEY}, {_date()}, count(*) AS n, {_ts('min(time)', 't0')}, {_ts('max(time)', 't1')}
FROM rd WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-24' GROUP BY site_id, device_name, rd.day""",
    "site_ratios": _with(*_site(LOOSE)) + f"""SELECT site_id, {_date()}, round(self_consumption_kwh / nullif(consumption_kwh, 0), 9) AS self_sufficiency,
  round(self_consumption_kwh / nullif(production_kwh, 0), 9) AS self_usage, complete, continuous FROM site_energy WHERE written""",
    "constraint_split": _with(_SUPPLIER) + f"""SELECT {_KEY}, serial_number, concat_ws(',', CASE WHEN phases > 3 THEN 'device_phases' END,
  CASE WHEN slave_id NOT BETWEEN 1 AND 247 THEN 'device_slave_id' END, CASE WHEN register_model NOT IN ('int+sf', 'float') THEN 'device_register' END,
  CASE WHEN mppt_tracker NOT BETWEEN 1 AND 2 THEN 'device_mppt' END) AS violations FROM sd""",
    "constraint_split_meter": _with(_SUPPLIER) + f"""SELECT {_KEY}, serial_number FROM sd WHERE phases BETWEEN 1 AND 3 AND slave_id <= 247 AND register_model IN ('', 'int+sf', 'float')""",
    "registry_validate": _with(_CUSTOMER_ROSTER) + f"""SELECT {_KEY}, kind, location, is_primary, concat_ws(',', CASE WHEN device_name = '' THEN 'name_empty' END,
  CASE WHEN length(device_name) > 32 THEN 'name_too_long' END, CASE WHEN device_name <> '' AND NOT regexp_full_match(device_name, '[A-Za-z0-9_-]+') THEN 'name_form' END,
  CASE WHEN device_name IN ('meter', 'inverter') THEN 'name_reserved' END, CASE WHEN count(*) OVER (PARTITION BY site_id, device_name) > 1 THEN 'name_duplicate' END,
  CASE WHEN is_primary AND count(*) FILTER (WHERE is_primary) OVER (PARTITION BY site_id) > 1 THEN 'several_primaries' END,
  CASE WHEN is_primary AND location IS NULL THEN 'primary_without_location' END) AS violations FROM cr""",
    # --- joins ---
    "overlap_full_join": _with(_READINGS, _SPINE, _power(30), _CONTRIB, _OVERLAP) + f"SELECT site_id, {_date()}, {_ts('bucket', 'bucket')}, round(pw, 9) AS pw, round(cw, 9) AS cw FROM ov",
    "registry_join": _with(_FLEET) + f"SELECT {_KEY}, location FROM fleet WHERE device_name IN (SELECT device_name FROM conf)",
    "primary_meter_lookup": _with(_FLEET) + """SELECT s.site_id, device_name AS primary_meter, location AS primary_location,
  CASE WHEN location IS NULL THEN 'no primary meter' END AS notes
FROM (SELECT DISTINCT site_id FROM fleet) s LEFT JOIN (
  SELECT site_id, device_name, location FROM fleet WHERE is_primary AND kind = 'meter'
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY device_name) = 1) p USING (site_id)""",
    "daylight_join": _with(_READINGS, _SPINE, _SITES, _daylight("site_days")) + f"""SELECT site_id, device_name, {_date('s.day')}, seconds AS daylight_s
FROM spine s LEFT JOIN dl USING (site_id, day) WHERE kind = 'inverter'""",
    "contributor_left_join": _with(*_site(LOOSE)) + f"""SELECT c.site_id, c.device_name, {_date('s.day')}, role, produced_kwh, imported_kwh, exported_kwh,
  coalesce(i.complete, m.complete, FALSE) AS complete, coalesce(i.continuous, m.continuous, FALSE) AS continuous
FROM contrib c JOIN site_spine s USING (site_id)
LEFT JOIN inverter_days i ON i.site_id = c.site_id AND i.device_name = c.device_name AND i.day = s.day
LEFT JOIN meter_days m ON m.site_id = c.site_id AND m.device_name = c.device_name AND m.day = s.day""",
    "device_asof": _with(_READINGS) + """SELECT r.site_id, r.device_name, r.seq, r.value, d.seq AS announced, concat('SN', d.user_id % 3) AS serial_number,
  concat('fw', CAST(floor(d.value) AS BIGINT)) AS firmware_version
FROM (SELECT * FROM rd WHERE event_type <> 'signup') r ASOF JOIN (SELECT * FROM rd WHERE event_type = 'signup') d
ON r.site_id = d.site_id AND r.device_name = d.device_name AND r.seq >= d.seq""",
    # --- aggregations ---
    "counter_boundary": _with(_SAMPLES) + f"""SELECT {_KEY}, {_date()}, count(imp) AS ac_energy_count,
  arg_min(imp, time) FILTER (WHERE imp IS NOT NULL) AS ac_energy_first, arg_max(imp, time) FILTER (WHERE imp IS NOT NULL) AS ac_energy_last,
  {_ts('min(time) FILTER (WHERE imp IS NOT NULL)', 'ac_energy_first_time')}, {_ts('max(time) FILTER (WHERE imp IS NOT NULL)', 'ac_energy_last_time')}
FROM sm WHERE kind = 'inverter' GROUP BY site_id, device_name, sm.day""",
    "counter_delta": _with(*_devices(STRICT)) + f"SELECT {_KEY}, {_date()}, imported_kwh, exported_kwh FROM meter_days WHERE sample_count > 0",
    "bucket_presence": _with(_READINGS) + f"SELECT {_KEY}, {_date()}, count(DISTINCT {_bucket(30)}) AS observed FROM rd GROUP BY site_id, device_name, rd.day",
    "coverage": _with(*_devices(STRICT)) + f"""SELECT {_KEY}, {_date()}, coverage FROM meter_days
UNION ALL SELECT {_KEY}, {_date()}, coverage FROM inverter_days""",
    "continuity": _with(*_devices(STRICT)) + f"""SELECT {_KEY}, {_date()}, continuity FROM meter_days
UNION ALL SELECT {_KEY}, {_date()}, continuity FROM inverter_days""",
    "site_production": _with(*_site(STRICT)) + f"SELECT site_id, {_date()}, round(prod, 9) AS production_kwh FROM prod",
    "pv_power_by_bucket": _with(_READINGS, _SPINE, _power(30), _CONTRIB, _OVERLAP) + f"""SELECT site_id, {_date()}, {_ts('bucket', 'bucket')}, round(sum(w), 9) AS pw
FROM side WHERE role = 'inverter' GROUP BY site_id, side.day, side.bucket""",
    "self_consumption_overlap": _with(*_site(LOOSE)) + f"SELECT site_id, {_date()}, n_buckets, round(overlap_kwh, 9) AS overlap_kwh FROM ovd",
    "quality_and": _with(*_site(LOOSE)) + f"SELECT site_id, {_date()}, complete, continuous FROM flags",
    "incomplete_list": _with(*_site(LOOSE)) + f"SELECT site_id, {_date()}, incomplete AS notes FROM flags",
    "site_energy": _with(*_site(LOOSE)) + f"SELECT site_id, {_date()}, {_r(_FIGURES)}, complete, continuous FROM site_energy WHERE written",
    "completeness_stats": _with(*_site(LOOSE)) + f"""SELECT site_id, count(*) AS days, {_date('min(day)', 'first_day')}, {_date('max(day)', 'last_day')},
  count(*) FILTER (WHERE complete) AS complete_days, count(*) FILTER (WHERE continuous) AS continuous_days FROM site_energy WHERE written GROUP BY 1""",
    "data_span": _with(_READINGS) + f"SELECT {_KEY}, {_date('min(day)', 'first_day')}, {_date('max(day)', 'last_day')} FROM rd GROUP BY 1, 2",
}

for _name, _seconds in (("power_30sec", 30), ("power_5min", 300)):
    ORACLE[_name] = ORACLE[f"stream_{_name}"] = _with(_READINGS, _power(_seconds)) + f"""SELECT site_id, device_name, kind, {_ts('bucket', 'bucket')},
  avg_power, CAST(min_power AS DOUBLE) AS min_power, CAST(max_power AS DOUBLE) AS max_power FROM pw"""

_MESSAGES = _READINGS + """,
msg AS (SELECT concat('fleet/', site_id, '/', kind, '/', device_name, '/availability') AS topic, event_type AS payload, seq, time AS ts FROM rd)"""
_DESCRIPTORS = _READINGS + """,
ds AS (
  SELECT site_id, device_name, seq, concat('SN', user_id % 3) AS serial_number, concat('fw', CAST(floor(value) AS BIGINT)) AS firmware_version
  FROM rd WHERE event_type = 'signup'
)"""

ORACLE |= {
    "suppress_repeats": _with(_MESSAGES) + """SELECT topic, payload, seq FROM msg
QUALIFY payload IS DISTINCT FROM lag(payload) OVER (PARTITION BY topic ORDER BY seq)""",
    "change_gate": _with(_DESCRIPTORS) + """SELECT * FROM ds
QUALIFY concat(serial_number, '|', firmware_version) IS DISTINCT FROM lag(concat(serial_number, '|', firmware_version)) OVER (PARTITION BY site_id, device_name ORDER BY seq)""",
    "first_wins_dedup": _with(_SAMPLES) + f"""SELECT {_KEY}, {_ts('time', 'time')}, seq, CAST(power AS DOUBLE) AS ac_power_active FROM sm WHERE kind = 'inverter'""",
    "site_report": _with(*_site(STRICT)) + f"""SELECT site_id, {_date()}, round(self_consumption_kwh / nullif(consumption_kwh, 0), 9) AS self_sufficiency,
  round(self_consumption_kwh / nullif(production_kwh, 0), 9) AS self_usage, complete, continuous FROM site_energy WHERE written ORDER BY site_id, site_energy.day""",
    "latest_per_topic": _with(_MESSAGES) + f"""SELECT topic, payload, seq, {_ts('ts', 'ts')} FROM msg QUALIFY row_number() OVER (PARTITION BY topic ORDER BY seq DESC) = 1""",
    "latest_sample": _with(_SAMPLES) + f"""SELECT {_KEY}, {_ts('time', 'time')}, seq, imp AS energy_active_import, expo AS energy_active_export, CAST(power AS DOUBLE) AS power_active
FROM (SELECT * FROM sm WHERE kind = 'meter' QUALIFY row_number() OVER (PARTITION BY site_id, device_name ORDER BY time DESC) = 1)""",
    "inverter_union": _with(_READINGS, _power(30)) + f"SELECT site_id, {_ts('bucket', 'bucket')}, greatest(avg_power, 0) AS p FROM pw WHERE kind = 'inverter'",
    "contributors": _with(_FLEET) + """SELECT site_id, device_name, 'inverter' AS role FROM fleet WHERE kind = 'inverter'
UNION ALL SELECT site_id, device_name, 'primary' FROM (
  SELECT * FROM fleet WHERE is_primary AND kind = 'meter'
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY device_name) = 1) WHERE location IS NOT NULL""",
    # --- calendar ---
    "day_spine": _with(_READINGS, _SPINE) + f"SELECT site_id, device_name, kind, {_date()} FROM spine",
    "day_bounds": f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT {_date()}, {_ts("timezone('UTC', timezone('" + TZ + "', CAST(day AS TIMESTAMP)))", 'day_start')},
  {_ts("timezone('UTC', timezone('" + TZ + "', CAST(day + 1 AS TIMESTAMP)))", 'day_end')}, {_FULL.replace('day', 'd.day')} AS full_secs FROM d""",
    "time_bucket": f"""SELECT event_id AS seq, {_ts("time_bucket(INTERVAL '30 seconds', ts)", 'bucket_30s')},
  {_ts("time_bucket(INTERVAL '5 minutes', ts)", 'bucket_5min')} FROM events""",
    "daylight_calendar": f"""WITH sp AS (
  SELECT DISTINCT concat('N', c_nationkey) AS site_id, CAST(o_orderdate AS DATE) AS day, -84 + c_nationkey * 7e0 AS latitude,
         -180 + c_nationkey * 14.4e0 AS longitude, -0.833e0 AS horizon_deg
  FROM orders JOIN customer ON o_custkey = c_custkey
), {_daylight('sp')} SELECT site_id, {_date()}, seconds, seconds AS daylight_s, {_ts('sunrise', 'sunrise')}, {_ts('sunset', 'sunset')} FROM dl""",
    # --- streams and lifecycle ---
    "refresh_range": _with(_READINGS, _power(300)) + f"""SELECT site_id, device_name, kind, {_ts('bucket', 'bucket')}, avg_power,
  CAST(min_power AS DOUBLE) AS min_power, CAST(max_power AS DOUBLE) AS max_power FROM pw
WHERE pw.bucket >= TIMESTAMP '2024-01-03 10:03:20' AND pw.bucket + INTERVAL 5 MINUTE <= TIMESTAMP '2024-01-28 11:53:20'""",
    "stream_dedup": _with(_READINGS) + f"SELECT {_KEY}, {_ts('time', 'time')}, seq, CAST(power AS DOUBLE) AS power FROM rd",
    "live_day_rollup": _with(*_site(STRICT)) + f"SELECT site_id, {_date()}, {_r(_FIGURES)}, complete, continuous FROM site_energy WHERE written",
    "stream_json_ingest": _with(_INV) + f"""SELECT {_KEY}, strftime(make_timestamp(epoch_us(time) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') AS time, seq, round(wh) / 1000e0 AS ac_energy,
  {_f32(_q('pa', 2), 'ac_power_active')}, {_f32(_INV_EFF, 'efficiency')}, np AS n_phases, {_f32(_q('v * 0.01e0 + (230 + np)', 1), 'max_voltage')},
  ni AS n_inputs, CASE WHEN NOT hybrid THEN round(wh * 0.5e0 * ni) / 1000e0 END AS max_dc_energy FROM ir""",
    "stream_json_phases": _with(_INV) + f"""SELECT {_KEY}, strftime(make_timestamp(epoch_us(time) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') AS time, i AS phase_id,
  {_f32(_q('v * 0.01e0 + (230 + i)', 1), 'ac_voltage')}, {_f32(_q('v / 230e0 / i', 3), 'ac_current')}
FROM ir, range(1, 4) AS r(i) WHERE i <= np""",
    "stream_json_ingest_meter": _with(_MET) + f"""SELECT {_KEY}, strftime(make_timestamp(epoch_us(time) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') AS time, seq,
  round(imp_wh) / 1000e0 AS energy_active_import, {_f32(_q('v - 20e0', 2), 'power_active')}, i AS phase_id,
  {_f32(_q('v * i - 20', 2), 'phase_power')} FROM mr, range(1, 4) AS r(i) WHERE i <= np""",
    "stream_json_rejects": _with(_INV) + """SELECT 'unknown topic' AS reason, seq, 1 AS n FROM ir WHERE seq % 101 = 0
UNION ALL SELECT 'malformed payload', seq, 1 FROM ir WHERE seq % 97 = 0 AND seq % 101 <> 0
UNION ALL SELECT 'constraint id', -1, CAST(sum(np + ni) AS BIGINT) FROM ir WHERE seq % 103 = 0 AND seq % 97 <> 0 AND seq % 101 <> 0
  HAVING count(*) > 0""",
    "retention": _with(_SAMPLES) + f"SELECT {_KEY}, {_ts('time', 'time')}, seq, imp AS ac_energy FROM sm WHERE kind = 'inverter' AND time >= TIMESTAMP '2024-01-11'",
    "compaction": _with(_SAMPLES) + f"SELECT {_KEY}, {_ts('time', 'time')}, seq, imp AS ac_energy FROM sm WHERE kind = 'inverter'",
}
ORACLE["solar_daylight"] = ORACLE["daylight_calendar"].replace(" seconds AS daylight_s,", "")
ORACLE["stream_device_state"] = ORACLE["device_asof"].replace(" d.seq AS announced,", "")
