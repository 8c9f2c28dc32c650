"""The registered queries as DuckDB SQL, in layers of common table expressions."""

from __future__ import annotations

RAW = """raw AS (
  SELECT event_id, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::INTEGER AS cell, ts,
         date_trunc('hour', ts)::TIMESTAMP AS slot, strftime(ts, '%Y%m%d%H%M%S') AS evt_dtm, value, json_extract_string(props, '$.k')::DOUBLE AS k
  FROM events WHERE list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) > 0
)"""
SPINE = """spine AS (
  SELECT c.i::INTEGER AS cell, s.t AS ts FROM range(5) c(i), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR) s(t)
  WHERE hour(s.t) >= 8 AND hour(s.t) < 21
)"""
MEANS = f"""{RAW}, means AS (
  SELECT cell, slot AS ts, avg(value) AS value, avg(k) AS k FROM raw WHERE hour(slot) >= 8 AND hour(slot) < 21 AND ts >= '2024-01-01' AND ts < '2024-01-31' GROUP BY ALL
)"""
GRID = f"{MEANS}, {SPINE}, grid AS (SELECT s.cell, s.ts, m.value, m.k FROM spine s LEFT JOIN means m USING (cell, ts))"


def _two_level(c: str) -> str:
    return f"coalesce({c}, last_value({c} IGNORE NULLS) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"


FILLED = f"""{GRID}, in_day AS (
  SELECT cell, ts, {_two_level('value')}, {_two_level('k')} FROM grid WINDOW d AS (PARTITION BY cell, ts::DATE ORDER BY ts)
), across AS (
  SELECT cell, ts, {_two_level('value')}, {_two_level('k')} FROM in_day WINDOW d AS (PARTITION BY cell ORDER BY ts)
), filled AS (SELECT cell, ts, coalesce(value, 0.0) AS value, coalesce(k, 0.0) AS k FROM across)"""
RANGES = f"{FILLED}, ranges AS (SELECT min(value) AS v0, max(value) AS v1, min(k) AS k0, max(k) AS k1 FROM filled)"
SCALED = f"""{RANGES}, scaled AS (
  SELECT cell, ts, coalesce((value - v0) * 2.0::DOUBLE / nullif(v1 - v0, 0), 0.0) - 1.0::DOUBLE AS value, coalesce((k - k0) * 2.0::DOUBLE / nullif(k1 - k0, 0), 0.0) - 1.0::DOUBLE AS k FROM filled, ranges
)"""
#: Every row with its place in the series (seq), its day's place among days (nth) and its place in the day (slot).
PLACED = f"""{SCALED}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts) AS seq, dense_rank() OVER (PARTITION BY cell ORDER BY ts::DATE) AS nth,
         row_number() OVER (PARTITION BY cell, ts::DATE ORDER BY ts) AS slot, count(*) OVER (PARTITION BY cell) AS n, count(*) OVER (PARTITION BY cell, ts::DATE) AS in_day
  FROM scaled
)"""
#: The same as one row per feature.
LONG = f"{PLACED}, long AS (SELECT cell, ts, seq, nth, slot, 0 AS feature, value AS v FROM placed UNION ALL SELECT cell, ts, seq, nth, slot, 1, k FROM placed)"
#: Samples by position: s is the place of the first input row, of the 5 of x; the target is row s + 5.
BY_POSITION = f"{LONG}, samples AS (SELECT a.cell, a.seq AS s, b.ts AS dt FROM placed a JOIN placed b ON a.cell = b.cell AND b.seq = a.seq + 5 WHERE a.seq > 91)"
#: Windows in a day, and those with 7 days before them.
BY_DAY = f"""{LONG}, windows AS (
  SELECT a.cell, a.nth, a.slot, b.ts AS dt FROM placed a JOIN placed b ON a.cell = b.cell AND b.nth = a.nth AND b.slot = a.slot + 5
), samples AS (SELECT * FROM windows WHERE nth > 8)"""
X_BY_DAY = "SELECT s.cell, s.dt, (l.slot - s.slot)::INTEGER AS step, l.feature, l.v FROM samples s JOIN long l ON l.cell = s.cell AND l.nth = s.nth AND l.slot BETWEEN s.slot AND s.slot + 4"
M_BY_DAY = "SELECT s.cell, s.dt, (l.nth - s.nth + 7)::INTEGER AS day, (l.slot - s.slot)::INTEGER AS step, l.feature, l.v FROM samples s JOIN long l ON l.cell = s.cell AND l.nth BETWEEN s.nth - 7 AND s.nth - 1 AND l.slot BETWEEN s.slot AND s.slot + 5"


def _w(tensor: int, i: str, j: str = "0") -> str:
    """The fixed weight at (i, j)."""
    return f"(((7 * ({i}) + 13 * ({j}) + 5 * {tensor}) % 23 - 11) / 20.0::DOUBLE)"


FORECAST = f"""{BY_DAY}, x AS ({X_BY_DAY}), m AS ({M_BY_DAY}),
a AS (SELECT cell, dt, feature, sum(v * {_w(0, 'step', 'feature')}) + {_w(1, 'feature')} AS a FROM x GROUP BY cell, dt, feature),
r AS (SELECT cell, dt, day, feature, sum(v * {_w(2, 'step', 'feature')}) + {_w(3, 'feature')} AS r FROM m GROUP BY cell, dt, day, feature),
h AS (SELECT i AS h FROM range(4) t(i)),
q AS (SELECT cell, dt, h, sum(a * {_w(4, 'feature', 'h')}) AS q FROM a, h GROUP BY ALL),
key AS (SELECT cell, dt, day, h, sum(r * {_w(5, 'feature', 'h')}) AS k FROM r, h GROUP BY ALL),
score AS (SELECT key.cell, key.dt, day, sum(tanh(q + k + {_w(6, 'q.h')}) * {_w(7, 'q.h')}) + {_w(8, '0')} AS s FROM key JOIN q ON key.cell = q.cell AND key.dt = q.dt AND key.h = q.h GROUP BY key.cell, key.dt, day),
soft AS (SELECT cell, dt, day, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS alpha FROM score WINDOW w AS (PARTITION BY cell, dt)),
context AS (SELECT key.cell, key.dt, h, sum(alpha * k) AS c FROM key JOIN soft ON key.cell = soft.cell AND key.dt = soft.dt AND key.day = soft.day GROUP BY key.cell, key.dt, h),
joined AS (SELECT cell, dt, feature AS i, a AS v FROM a UNION ALL SELECT cell, dt, h + 2, c FROM context),
pred AS (SELECT cell, dt, o::INTEGER AS feature, tanh(sum(v * {_w(9, 'i', 'o')})) AS pred FROM joined, range(2) t(o) GROUP BY cell, dt, o)"""

_MIXED = "((((((0 * 31 + cell) % 1048576 * 2654435761 + 40503) % 4294967296) * 31 + dayofyear(dt)) % 1048576 * 2654435761 + 40503) % 4294967296 * 31 + hour(dt)) % 1048576 * 2654435761 + 40503"
_PREDICT = f"WITH {FORECAST} SELECT cell, dt, feature, CASE WHEN abs(pred) < 5e-7 THEN 0.0::DOUBLE ELSE round(pred, 6) END AS value FROM pred"
_FILLED_LONG = f"{FILLED}, fl AS (SELECT cell, ts, 0 AS feature, value AS v FROM filled UNION ALL SELECT cell, ts, 1, k FROM filled)"
_INPUTS = f"WITH {_FILLED_LONG} SELECT cell, (hour(ts) - 10)::INTEGER AS step, feature, round(v, 6) AS value FROM fl WHERE ts BETWEEN '2024-01-20 10:00:00' AND '2024-01-20 14:00:00'"
_MEMORY = f"WITH {_FILLED_LONG} SELECT cell, (ts::DATE - DATE '2024-01-13')::INTEGER AS day, (hour(ts) - 10)::INTEGER AS step, feature, round(v, 6) AS value FROM fl WHERE ts::DATE BETWEEN '2024-01-13' AND '2024-01-19' AND hour(ts) BETWEEN 10 AND 15"

SQL: dict[str, str] = {
    "time_filter_days": f"WITH {RAW} SELECT event_id, evt_dtm, cell FROM raw WHERE " + " OR ".join(f"ts BETWEEN '2024-01-{d} 11:15:00' AND '2024-01-{d} 12:00:00'" for d in (20, 19, 18)),
    "time_filter_exact": f"WITH {RAW}, t AS (SELECT event_id, strftime(slot, '%Y%m%d%H%M%S') AS slot_dtm, cell FROM raw) SELECT * FROM t WHERE slot_dtm IN (" + ", ".join(f"'202401{d}120000'" for d in range(14, 21)) + ")",
    "text_times": f"WITH {RAW} SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS parsed, strftime(ts + INTERVAL 7 MINUTE, '%Y%m%d%H%M%S') AS later, strftime(ts - INTERVAL 90 MINUTE, '%Y%m%d%H%M%S') AS earlier, strftime(ts - INTERVAL 30 DAY, '%Y%m%d%H%M%S') AS days_before FROM raw",
    "cell_in_filter": f"WITH {RAW} SELECT event_id, cell, value FROM raw WHERE cell IN (1, 3)",
    "cell_ordinal": f"WITH {RAW} SELECT cell, count(*) AS n, min(event_id) AS first_id FROM raw GROUP BY cell",
    "dedup_last": f"WITH {RAW} SELECT event_id, cell, slot AS ts, value, k FROM raw QUALIFY row_number() OVER (PARTITION BY cell, slot ORDER BY event_id DESC) = 1",
    "union_rows": f"WITH {RAW}, u AS (SELECT cell FROM raw WHERE cell < 2 UNION ALL SELECT cell FROM raw WHERE cell >= 2 UNION ALL SELECT cell FROM raw WHERE value > 50) SELECT cell, count(*) AS n FROM u GROUP BY cell",
    "spine_hours": f"WITH {SPINE} SELECT * FROM spine",
    "spine_fine": "SELECT c.i::INTEGER AS cell, t AS ts FROM range(5) c(i), generate_series(TIMESTAMP '2024-01-01 08:00:00', TIMESTAMP '2024-01-30 20:59:50', INTERVAL 10 SECOND) s(t) WHERE hour(t) >= 8 AND hour(t) < 21",
    "spine_left_join": f"WITH {RAW}, {SPINE} SELECT s.cell, s.ts, coalesce(event_id, -1) AS event_id, value FROM spine s LEFT JOIN raw r ON r.cell = s.cell AND r.slot = s.ts",
    "resample_mean": f"WITH {GRID} SELECT cell, ts, round(value, 6) AS value, round(k, 6) AS k FROM grid",
    "gap_fill": f"WITH {FILLED} SELECT cell, ts, round(value, 6) AS value, round(k, 6) AS k FROM filled",
    "min_max_range": f"WITH {RANGES} SELECT 'value' AS feature, round(v0, 6) AS min, round(v1, 6) AS max FROM ranges UNION ALL SELECT 'k', round(k0, 6), round(k1, 6) FROM ranges",
    "scale_global": f"WITH {SCALED} SELECT cell, ts, round(value, 6) AS value, round(k, 6) AS k FROM scaled",
    "scale_const": f"WITH {RAW} SELECT event_id, round((value + 121.0::DOUBLE) * 2.0::DOUBLE / 121.0::DOUBLE - 1.0::DOUBLE, 6) AS value, round((k - 1.0::DOUBLE) * 2.0::DOUBLE / (99.57666778564453::DOUBLE - 1.0::DOUBLE) - 1.0::DOUBLE, 6) AS k FROM raw",
    "unscale": f"WITH {FILLED} SELECT cell, ts, round(value, 6) AS value, round(k, 6) AS k FROM filled",
    "unscale_vectors": f"WITH {SCALED} SELECT cell, ts, round((value + 1.0::DOUBLE) * 20.0::DOUBLE / 2.0::DOUBLE + 10.0::DOUBLE, 6) AS value, round((k + 1.0::DOUBLE) * 10.0::DOUBLE / 2.0::DOUBLE - 5.0::DOUBLE, 6) AS k FROM scaled",
    "windows_positional": f"WITH {BY_POSITION} SELECT s.cell, s.dt, (l.seq - s.s)::INTEGER AS step, l.feature, round(l.v, 6) AS value FROM samples s JOIN long l ON l.cell = s.cell AND l.seq BETWEEN s.s AND s.s + 4",
    "targets_positional": f"WITH {BY_POSITION} SELECT s.cell, s.dt, 0 AS step, l.feature, round(l.v, 6) AS value FROM samples s JOIN long l ON l.cell = s.cell AND l.seq = s.s + 5",
    "memory_positional": f"WITH {BY_POSITION} SELECT s.cell, s.dt, j::INTEGER AS day, (l.seq - (s.s - 91 + 13 * j))::INTEGER AS step, l.feature, round(l.v, 6) AS value FROM samples s, range(7) t(j), long l WHERE l.cell = s.cell AND l.seq BETWEEN s.s - 91 + 13 * j AND s.s - 91 + 13 * j + 5",
    "windows_per_day": f"WITH {BY_DAY} SELECT w.cell, w.slot::INTEGER AS slot, w.dt, (l.slot - w.slot)::INTEGER AS step, l.feature, round(l.v, 6) AS value FROM windows w JOIN long l ON l.cell = w.cell AND l.nth = w.nth AND l.slot BETWEEN w.slot AND w.slot + 4",
    "targets_per_day": f"WITH {BY_DAY} SELECT w.cell, w.slot::INTEGER AS slot, w.dt, 0 AS step, l.feature, round(l.v, 6) AS value FROM windows w JOIN long l ON l.cell = w.cell AND l.nth = w.nth AND l.slot = w.slot + 5",
    "windows_foresight": f"WITH {LONG} SELECT l.cell, (l.slot - 7)::INTEGER AS slot, l.ts AS dt, 0 AS step, l.feature, round(l.v, 6) AS value FROM long l WHERE l.slot > 7",
    "memory_per_day": f"WITH {BY_DAY}, m AS ({M_BY_DAY}) SELECT cell, dt, day, step, feature, round(v, 6) AS value FROM m",
    "memory_by_time": f"""WITH {MEANS}, blocks AS (
  SELECT a.cell, a.ts FROM means a JOIN means b ON a.cell = b.cell AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 5 HOUR GROUP BY a.cell, a.ts HAVING count(*) = 6
), samples AS (
  SELECT b.cell, b.ts FROM blocks b JOIN blocks o ON o.cell = b.cell AND o.ts IN (b.ts - INTERVAL 1 DAY, b.ts - INTERVAL 2 DAY, b.ts - INTERVAL 3 DAY, b.ts - INTERVAL 4 DAY, b.ts - INTERVAL 5 DAY, b.ts - INTERVAL 6 DAY, b.ts - INTERVAL 7 DAY)
  GROUP BY b.cell, b.ts HAVING count(*) = 7
), long AS (SELECT cell, ts, 0 AS feature, value AS v FROM means UNION ALL SELECT cell, ts, 1, k FROM means)
SELECT s.cell, s.ts + INTERVAL 5 HOUR AS dt, j::INTEGER AS day, i::INTEGER AS step, l.feature, round(l.v, 6) AS value
FROM samples s, range(7) t(j), range(6) u(i), long l WHERE l.cell = s.cell AND l.ts = s.ts + to_hours(CAST(i AS INTEGER)) - to_days(CAST(7 - j AS INTEGER))""",
    "last_days_tensor": f"WITH {LONG} SELECT cell, (row_number() OVER (PARTITION BY cell, feature ORDER BY ts) - 1)::INTEGER AS step, feature, round(v, 6) AS value FROM long WHERE ts::DATE > (SELECT max(ts)::DATE FROM long) - 7",
    "split_time": f"WITH {BY_DAY}, parts AS (SELECT cell, dt, CASE WHEN dt > (SELECT max(dt) FROM samples) - INTERVAL 7 DAY THEN 'test' ELSE 'train' END AS part FROM samples) SELECT cell, part, count(*) AS n, min(dt) AS first, max(dt) AS last FROM parts GROUP BY ALL",
    "split_tail": f"WITH {BY_POSITION}, parts AS (SELECT cell, dt, CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY dt DESC) <= 86 THEN 'test' ELSE 'train' END AS part FROM samples) SELECT cell, part, count(*) AS n, min(dt) AS first, max(dt) AS last FROM parts GROUP BY ALL",
    "split_dev_exact": f"""WITH {BY_DAY}, parts AS (
  SELECT cell, dt, CASE WHEN dt > (SELECT max(dt) FROM samples) - INTERVAL 7 DAY THEN 'test' ELSE 'train' END AS part, ({_MIXED}) % 4294967296 AS h FROM samples
) SELECT cell, dt, CASE WHEN part = 'train' AND row_number() OVER (PARTITION BY part ORDER BY h, cell, dt) <= floor((SELECT count(*) FROM parts WHERE part = 'train') * 0.1::DOUBLE) THEN 'dev' ELSE part END AS part FROM parts""",
    "ar_head": f"WITH {FORECAST} SELECT cell, dt, feature, CASE WHEN abs(a) < 5e-7 THEN 0.0::DOUBLE ELSE round(a, 6) END AS value FROM a",
    "predict": _PREDICT,
    "predict_native": _PREDICT,
    "forecast_errors": f"""WITH {FORECAST}, e AS (
  SELECT l.v AS y, p.pred AS f FROM pred p JOIN long l ON l.cell = p.cell AND l.ts = p.dt AND l.feature = p.feature
) SELECT count(*) AS n, round(avg((y - f) * (y - f)), 6) AS mse, round(avg(abs(y - f)), 6) AS mae, round(sqrt(sum((y - f) * (y - f))) / sqrt(sum((y - m) * (y - m))), 6) AS rse,
  round(avg(abs(y - f) / nullif(abs(y), 0)), 6) AS mape, count(nullif(abs(y), 0)) AS n_mape, round(avg(2 * abs(y - f) / nullif(abs(y) + abs(f), 0)), 6) AS smape, count(nullif(abs(y) + abs(f), 0)) AS n_smape
FROM e, (SELECT avg(y) AS m FROM e)""",
    "amplify": f"WITH {RAW} SELECT event_id, c::INTEGER AS copy FROM raw, range(3) t(c)",
    "table_round_trip": f"WITH {SCALED} SELECT cell, ts, round(value::FLOAT::DOUBLE, 4) AS value, round(k::FLOAT::DOUBLE, 4) AS k FROM scaled",
    "ranges_round_trip": f"WITH {RANGES} SELECT 'value' AS feature, round(v0, 6) AS min, round(v1, 6) AS max FROM ranges UNION ALL SELECT 'k', round(k0, 6), round(k1, 6) FROM ranges",
    "weights_round_trip": _PREDICT,
    "predictions_round_trip": _PREDICT,
    "logs_by_name": f"""WITH {RAW} SELECT '7' AS station, cell::VARCHAR AS cell_no, date_trunc('second', ts)::TIMESTAMP AS ts, value, k FROM raw
QUALIFY row_number() OVER (PARTITION BY cell, evt_dtm ORDER BY event_id % 2 DESC, event_id DESC) = 1""",
    "indexed_table": f"WITH {SCALED} SELECT cell, ts, round(value::FLOAT::DOUBLE, 4) AS value, round(k::FLOAT::DOUBLE, 4) AS k FROM scaled",
    "kv_scan": f"WITH {RAW} SELECT strftime(slot, '%Y%m%d%H%M%S') AS evt_dtm, event_id::INTEGER AS uniq_id, round(value::FLOAT::DOUBLE, 3) AS rsrp, round(k::FLOAT::DOUBLE, 3) AS cqi FROM raw",
    "npy_round_trip": f"WITH {PLACED} SELECT cell, (seq - 1)::BIGINT AS \"at\", round(value::FLOAT::DOUBLE, 4) AS value, round(k::FLOAT::DOUBLE, 4) AS k FROM placed",
    "samples_replicated": f"WITH {BY_DAY}, x AS ({X_BY_DAY}) SELECT cell, dt, c::INTEGER AS copy, step, feature, CASE WHEN abs(v) < 5e-7 THEN 0.0::DOUBLE ELSE round(v, 6) END AS value FROM x, range(2) t(c)",
    "text_predictions": _PREDICT,
    "latest_run_folder": f"""WITH {RAW}, days AS (SELECT cell, max(ts)::DATE AS day FROM raw GROUP BY cell)
SELECT strftime(day, '%Y%m%d') || '-' || lpad((count(*) - 1)::VARCHAR, 2, '0') AS run FROM days WHERE day = (SELECT max(day) FROM days) GROUP BY day""",
    "stream_features": f"""WITH {_FILLED_LONG}, steps AS (
  SELECT cell, ts FROM filled WHERE hour(ts) BETWEEN 12 AND 19 AND ts::DATE >= DATE '2024-01-08'
), elements AS (
  SELECT a.cell, a.ts, -1 AS day, hour(fl.ts) - hour(a.ts) + 4 AS step, feature, v FROM steps a JOIN fl ON fl.cell = a.cell AND fl.ts BETWEEN a.ts - INTERVAL 4 HOUR AND a.ts
  UNION ALL SELECT a.cell, a.ts, (fl.ts::DATE - a.ts::DATE) + 7, hour(fl.ts) - hour(a.ts) + 4, feature, v
  FROM steps a JOIN fl ON fl.cell = a.cell AND fl.ts::DATE BETWEEN a.ts::DATE - 7 AND a.ts::DATE - 1 AND hour(fl.ts) BETWEEN hour(a.ts) - 4 AND hour(a.ts) + 1
) SELECT cell, epoch(ts)::BIGINT AS "at", day::INTEGER AS day, step::INTEGER AS step, feature, round(v, 6) AS value FROM elements""",
    "stream_means": f"WITH {RAW} SELECT cell, slot AS ts, round(avg(value), 6) AS value, round(avg(k), 6) AS k FROM raw WHERE hour(slot) >= 8 AND hour(slot) < 21 AND ts >= '2024-01-01' AND ts < '2024-01-31' GROUP BY cell, slot HAVING slot + INTERVAL 1 HOUR <= (SELECT max(ts) FROM raw) - INTERVAL 10 MINUTE",
    "asof_inputs": _INPUTS,
    "queue_advance": _INPUTS,
    "asof_memory": _MEMORY,
    "memory_advance": _MEMORY,
    "asof_pairs": f"""WITH {_FILLED_LONG}, x AS (SELECT cell, -1 AS day, (hour(ts) - 10)::INTEGER AS step, feature, v FROM fl WHERE ts BETWEEN '2024-01-20 10:00:00' AND '2024-01-20 14:00:00'),
m AS (SELECT cell, (ts::DATE - DATE '2024-01-13')::INTEGER AS day, (hour(ts) - 10)::INTEGER AS step, feature, v FROM fl WHERE ts::DATE BETWEEN '2024-01-13' AND '2024-01-19' AND hour(ts) BETWEEN 10 AND 15),
whole AS (SELECT cell FROM x GROUP BY cell HAVING count(*) = 10 INTERSECT SELECT cell FROM m GROUP BY cell HAVING count(*) = 84)
SELECT cell, day::INTEGER AS day, step, feature, round(v, 6) AS value FROM (SELECT * FROM x UNION ALL SELECT * FROM m) JOIN whole USING (cell)""",
}
