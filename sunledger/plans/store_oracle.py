"""SQL of the queries over filled stores."""

from __future__ import annotations

from sunledger.plans.oracle import _FLEET, _INV, _KEY, _MET, _READINGS, _SAMPLES, _TG, ORACLE, _date, _f32, _q, _ts, _with

_DEVICE = _READINGS + """,
dv AS (
  SELECT site_id, device_name, kind, seq, time, seq % 41 = 0 AS bad, concat('SN', user_id % 3) AS serial_number,
         concat('fw', CAST(floor(value) AS BIGINT)) AS firmware_version, user_id % 300 AS slave, user_id % 5 AS phases
  FROM rd WHERE event_type = 'signup'
),
ok AS (
  SELECT *, CASE WHEN kind = 'inverter' OR slave > 0 THEN slave END AS slave_id FROM dv
  WHERE NOT bad AND phases BETWEEN 1 AND 3 AND slave <= 247 AND (kind = 'meter' OR slave >= 1)
)"""
_EVENT = _READINGS + """,
ie AS (
  SELECT site_id, device_name, seq, seq % 43 = 0 AS bad, CAST(floor(value) AS BIGINT) % 3 AS code FROM rd
  WHERE kind = 'inverter' AND event_type <> 'signup'
)"""
_STATE = """
st AS (
  SELECT site_id, device_name, kind, seq, time, concat('fleet/', site_id, '/', kind, '/', device_name, '/availability') AS topic,
         CASE event_type WHEN 'click' THEN 'connected' WHEN 'view' THEN 'disconnected' END AS state
  FROM rd
)"""
_MILLIS = "strftime(make_timestamp(epoch_us(time) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') AS time"


def _telegram(pf: str, leading: bool) -> str:
    """Sample and phase columns derived from telegrams with an assumed power factor."""
    sign = "-1" if leading else "1"
    return f"""
te AS (
  SELECT site_id, device_name, time, seq, ct / 100000e0 * 1000 AS e, (c - 2000) / 100e0 AS p, c / 100e0 AS pp,
         230e0 + seq % 10 AS v1, 230e0 + seq % 20 AS v2, 230e0 + seq % 30 AS v3, tan(acos({pf})) AS tg, sin(acos({pf})) AS sn
  FROM tg WHERE reject_reason IS NULL
),
tr AS (
  SELECT *, abs(e / {pf}) AS ap, sn * abs(e / {pf}) AS re, abs(pp / (v1 * {pf})) AS c1, abs(2 * pp / (v2 * {pf})) AS c2, abs(3 * pp / (v3 * {pf})) AS c3
  FROM te
),
ts AS (
  SELECT {_KEY}, time, seq, round(e) / 1000e0 AS energy_active_import,
    {"0e0" if leading else "round(ap) / 1000e0"} AS energy_apparent_import, {"round(ap) / 1000e0" if leading else "0e0"} AS energy_apparent_export,
    {"0e0" if leading else "round(re) / 1000e0"} AS energy_reactive_import, {"round(re) / 1000e0" if leading else "0e0"} AS energy_reactive_export,
    {_f32(_q('p', 2), 'power_active')}, {_f32(_q(f'abs(p / {pf})', 2), 'power_apparent')}, {_f32(_q(f'{sign} * tg * p', 2), 'power_reactive')},
    {_f32(_q('(v1 + v2 + v3) / 3e0', 1), 'voltage_ph')}, {_f32(_q('c1 + c2 + c3', 3), 'current')}, i AS phase_id,
    {_f32(_q(f'{sign} * tg * (pp * i)', 2), 'phase_reactive')}, {_f32(_q('CASE i WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END', 3), 'phase_current')}
  FROM tr, range(1, 4) AS r(i)
)"""


_METER_OUT = """energy_active_import, energy_apparent_import, energy_apparent_export, energy_reactive_import, energy_reactive_export,
  power_active, power_apparent, power_reactive, voltage_ph, current, phase_id, phase_reactive, phase_current"""

ORACLE |= {
    "json_scan_device": _with(_DEVICE) + f"""SELECT {_KEY}, seq, bad AS malformed, CASE WHEN NOT bad THEN serial_number END AS serial_number,
  CASE WHEN NOT bad THEN firmware_version END AS firmware_version, CASE WHEN NOT bad THEN slave END AS slave_id, CASE WHEN NOT bad THEN phases END AS phases
FROM dv WHERE kind = 'meter'""",
    "json_scan_events": _with(_EVENT) + f"""SELECT {_KEY}, seq, bad AS malformed, CASE WHEN NOT bad THEN code END AS active_code,
  CASE WHEN code = 0 THEN 'running' ELSE 'fault' END AS state, CASE WHEN code = 0 THEN 0 ELSE 1 END AS n_events FROM ie""",
    "json_scan_availability": _with(_READINGS, _STATE) + "SELECT topic, seq, state, CASE WHEN state IS NULL THEN 'unknown state' END AS reason FROM st",
    "stream_device_ingest": _with(_DEVICE) + f"""SELECT {_KEY}, serial_number, arg_max(firmware_version, struct_pack(t := time, s := seq)) AS firmware_version,
  arg_max(struct_pack(x := slave_id), struct_pack(t := time, s := seq)).x AS slave_id, arg_max(phases, struct_pack(t := time, s := seq)) AS phases,
  {_ts('min(time)', 'first_seen')}, {_ts('max(time)', 'last_seen')} FROM ok GROUP BY site_id, device_name, kind, serial_number""",
    "stream_device_events": _with(_DEVICE, _EVENT.removeprefix(_READINGS + ",\n"), _STATE) + f"""SELECT {_KEY}, seq, code AS active_code,
  CASE WHEN code = 0 THEN 'running' ELSE 'fault' END AS state, CASE WHEN code = 0 THEN '' ELSE concat('E', code) END AS events, NULL AS reason
FROM (SELECT * FROM ie WHERE NOT bad QUALIFY code IS DISTINCT FROM lag(code) OVER (PARTITION BY site_id, device_name ORDER BY seq))
UNION ALL SELECT NULL, NULL, count(*), NULL, NULL, NULL, reason FROM (
  SELECT 'wrong type active_code' AS reason FROM ie WHERE bad
  UNION ALL SELECT 'wrong type phases' FROM dv WHERE bad
  UNION ALL SELECT 'unknown state' FROM st WHERE state IS NULL
  UNION ALL SELECT concat('constraint ', concat_ws(', ', CASE WHEN phases NOT BETWEEN 1 AND 3 THEN 'device_phases' END,
    CASE WHEN slave > 247 OR (kind = 'inverter' AND slave < 1) THEN 'device_slave_id' END)) FROM dv
  WHERE NOT bad AND (phases NOT BETWEEN 1 AND 3 OR slave > 247 OR (kind = 'inverter' AND slave < 1))) GROUP BY reason""",
    "stream_availability": _with(_READINGS, _STATE) + f"""SELECT {_KEY}, kind, seq, {_ts('time', 'ts')}, state FROM (
  SELECT * FROM st WHERE state IS NOT NULL QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY site_id, device_name, kind ORDER BY seq))""",
    "stream_json_rejects_fields": _with(_INV) + """SELECT CASE WHEN seq % 89 = 0 THEN 'wrong type ac_energy' WHEN seq % 83 = 0 THEN 'wrong type phases'
  WHEN seq % 79 = 0 THEN 'no values' ELSE 'stored' END AS reason, seq FROM ir""",
    "telegram_to_meter_samples": _with(_TG, _telegram("0.98e0", False)) + f"SELECT {_KEY}, {_ts('time', 'time')}, seq, {_METER_OUT} FROM ts",
    "telegram_to_meter_samples_leading": _with(_TG, _telegram("0.9e0", True)) + f"""SELECT {_KEY}, {_ts('time', 'time')}, seq, {_METER_OUT}, 'sample' AS told
FROM ts WHERE phase_id = 2
UNION ALL BY NAME SELECT {_KEY}, {_ts('min(time)', 'time')}, concat('device 1M', site_id, device_name, ' 107 3') AS told FROM tg WHERE reject_reason IS NULL GROUP BY 1, 2
UNION ALL BY NAME SELECT seq, concat('reject ', reject_reason) AS told FROM tg WHERE reject_reason IS NOT NULL""",
    "meter_reading_pipeline": _with(_MET, """
mp AS (
  SELECT *, seq % 2 = 1 AS sun, CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END AS sg, v / 230e0 * CASE np WHEN 1 THEN 1e0 WHEN 2 THEN 1.5e0 ELSE 0e0 END AS part,
         imp_wh * 1.1e0 AS ia, exp_wh * 1.1e0 AS ea, imp_wh * 0.3e0 AS ir_, exp_wh * 0.3e0 AS er_
  FROM mr
),
mq AS (
  SELECT *, CASE WHEN np = 3 THEN v / 230e0 + v / 230e0 / 2 + v / 230e0 / 3 WHEN np = 2 THEN v / 230e0 + v / 230e0 / 2 ELSE v / 230e0 END AS summed FROM mp
)""") + f"""SELECT {_KEY}, {_ts('time', 'time')}, seq, round(imp_wh) / 1000e0 AS energy_active_import,
  round(CASE WHEN sun THEN ia ELSE sqrt(imp_wh * imp_wh + ir_ * ir_) END) / 1000e0 AS energy_apparent_import,
  round(CASE WHEN sun THEN ea ELSE sqrt(exp_wh * exp_wh + er_ * er_) END) / 1000e0 AS energy_apparent_export,
  round(CASE WHEN sun THEN (CASE WHEN sg * (v * 0.1e0) >= 0 THEN 1 ELSE -1 END) * sqrt(ia * ia - imp_wh * imp_wh) ELSE ir_ END) / 1000e0 AS energy_reactive_import,
  round(CASE WHEN sun THEN (CASE WHEN sg * (v * 0.1e0) >= 0 THEN 1 ELSE -1 END) * sqrt(ea * ea - exp_wh * exp_wh) ELSE er_ END) / 1000e0 AS energy_reactive_export,
  {_f32(_q('v - 20e0', 2), 'power_active')}, {_f32(_q('v * 1.02e0', 2), 'power_apparent')}, {_f32(_q('sg * (v * 0.1e0)', 2), 'power_reactive')},
  {_f32(_q('v * 0.01e0 + 230e0', 1), 'voltage_ph')}, {_f32(_q('CASE WHEN sun THEN v / 230e0 ELSE summed END', 3), 'current')}, i AS phase_id,
  {_f32(_q('v * 0.1e0 * i', 2), 'phase_reactive')}, {_f32(_q('v / 230e0 / i', 3), 'phase_current')}
FROM mq, range(1, 4) AS r(i) WHERE i <= np""",
    "registry_store_sync": _with(_FLEET, """
sound AS (SELECT site_id FROM fleet GROUP BY 1 HAVING count(*) FILTER (WHERE is_primary) <= 1 AND count(*) FILTER (WHERE is_primary AND location IS NULL) = 0),
first AS (SELECT * FROM fleet WHERE site_id IN (SELECT site_id FROM sound)),
faulty AS (SELECT DISTINCT site_id FROM conf WHERE device_name LIKE '%77'),
touched AS (SELECT site_id FROM conf UNION SELECT site_id FROM fleet WHERE c_nationkey % 7 = 1 EXCEPT SELECT site_id FROM faulty)""") + f"""
SELECT {_KEY}, kind, location, is_primary, '2024-03-01 06:00:00.000000' AS updated_at FROM first WHERE site_id NOT IN (SELECT site_id FROM touched)
UNION ALL SELECT {_KEY}, 'meter', NULL, FALSE, '2024-03-02 06:30:00.000000' FROM conf WHERE site_id IN (SELECT site_id FROM touched)""",
    "site_store_sync": """WITH n AS (
  SELECT n_nationkey AS k, concat('N', n_nationkey) AS site_id, n_nationkey % 3 <> 0 AND (n_nationkey % 4 = 0 OR n_nationkey % 5 <> 4) AS again FROM nation)
SELECT site_id, CASE WHEN NOT again THEN -84 + k * 7e0 WHEN k % 2 = 0 THEN k * 1.5e0 END AS latitude,
  CASE WHEN NOT again THEN -180 + k * 14.4e0 WHEN k % 2 = 0 THEN k * 2.5e0 END AS longitude,
  CASE WHEN again AND k % 4 = 0 THEN -2e0 ELSE -0.833e0 END AS horizon_deg,
  CASE WHEN again THEN '2024-03-02 06:30:00.000000' ELSE '2024-03-01 06:00:00.000000' END AS updated_at FROM n""",
    "compaction_store": _with(_SAMPLES, _INV.removeprefix(_SAMPLES + ",\n"), _MET.removeprefix(_SAMPLES + ",\n"), """
dy AS (SELECT *, CAST(time AS DATE) AS d FROM sm), di AS (SELECT *, CAST(time AS DATE) AS d FROM ir), dm AS (SELECT *, CAST(time AS DATE) AS d FROM mr)""") + f"""
SELECT concat(kind, '_samples') AS name, {_date('d', 'day')}, count(*) AS n, CAST(sum(seq) AS BIGINT) AS total FROM dy GROUP BY kind, d
UNION ALL SELECT 'inverter_phase_samples', {_date('d', 'day')}, CAST(sum(np) AS BIGINT), CAST(sum(np * (np + 1) // 2) AS BIGINT) FROM di GROUP BY d
UNION ALL SELECT 'inverter_input_samples', {_date('d', 'day')}, CAST(sum(ni) AS BIGINT), CAST(sum(ni * (ni + 1) // 2) AS BIGINT) FROM di GROUP BY d
UNION ALL SELECT 'meter_phase_samples', {_date('d', 'day')}, CAST(sum(np) AS BIGINT), CAST(sum(np * (np + 1) // 2) AS BIGINT) FROM dm GROUP BY d""",
}

ORACLE["stream_device_waiting"] = _with(_READINGS) + """SELECT r.site_id, r.device_name, r.seq, r.value,
  CASE WHEN d.seq IS NULL THEN 'waits' ELSE concat('SN', d.user_id % 3) END AS serial_number
FROM (SELECT * FROM rd WHERE event_type <> 'signup') r ASOF LEFT JOIN (SELECT * FROM rd WHERE event_type = 'signup') d
ON r.site_id = d.site_id AND r.device_name = d.device_name AND r.seq >= d.seq"""
ORACLE["live_rollup_from_buckets"] = ORACLE["live_day_rollup"]
ORACLE["power_realtime"] = ORACLE["power_5min"]
ORACLE["power_refresh_late"] = ORACLE["power_30sec"]
