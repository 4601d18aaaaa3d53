"""SQL that gives the same rows as each query in :mod:`checks.queries`."""

from __future__ import annotations


ORACLE: dict[str, str] = {}

FMT = "'%Y-%m-%d %H:%M:%S'"
RAW = f"""raw AS (
  SELECT 'events' AS source_dataset, event_id AS ordinal,
    CASE WHEN event_id % 97 = 13 THEN 'not-a-time'
         WHEN event_id % 101 = 7 THEN strftime(date_trunc('minute', ts) - INTERVAL 1 HOUR, {FMT})
         ELSE strftime(date_trunc('minute', ts), {FMT}) END AS time_raw,
    date_trunc('second', ts) AS second_ts,
    CASE WHEN event_id % 89 = 5 THEN 'n/a' WHEN event_id % 83 = 3 THEN ''
         ELSE CAST(value AS VARCHAR) END AS flow_raw,
    CASE WHEN event_id % 5 = 0 THEN 'True' WHEN event_id % 5 = 1 THEN ' FALSE ' WHEN event_id % 5 = 2 THEN 'true'
         WHEN event_id % 5 = 3 THEN 'False' WHEN event_id % 45 = 4 THEN 'open' ELSE 'false' END AS valve_raw,
    CASE WHEN event_id % 61 = 9 THEN 'standby' WHEN event_id % 4 = 0 THEN 'On' WHEN event_id % 4 = 1 THEN 'off'
         WHEN event_id % 4 = 2 THEN ' OFF ' ELSE 'on' END AS pump_raw,
    CAST(user_id AS VARCHAR) AS ec_raw,
    CAST(CASE WHEN event_id % 113 = 2 THEN 3 WHEN event_id % 127 = 4 THEN 6 ELSE 5 END AS INTEGER) AS n_cells
  FROM events)"""
PARSED = f"{RAW}, parsed AS (SELECT *, try_strptime(time_raw, {FMT}) AS ts FROM raw)"


def sequence_flags(source: str, cadence: str, name: str = "flagged") -> str:
    """Flags by one window over the whole series."""
    return f"""looked AS (
  SELECT *, last_value(ts IGNORE NULLS) OVER (PARTITION BY source_dataset ORDER BY ordinal
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_valid_time FROM {source}),
{name} AS (
  SELECT *, ts IS NULL AS flag_bad_timestamp_format,
    coalesce(ts < prev_valid_time, false) AS flag_non_monotonic_time,
    coalesce(ts = prev_valid_time, false) AS flag_duplicate_timestamp,
    coalesce(date_diff('second', prev_valid_time, ts) > {cadence}, false) AS flag_time_gap_gt_expected
  FROM looked)"""


FLAGGED = f"""{PARSED}, checked AS (
  SELECT *, n_cells <> 5 AS flag_row_length_mismatch,
    flow_raw <> '' AND try_cast(flow_raw AS DOUBLE) IS NULL AS flag_non_numeric_in_numeric_field FROM parsed),
{sequence_flags('checked', '600')}"""
ISO = "coalesce(strftime({}, '%Y-%m-%dT%H:%M:%S'), '')"
SEQUENCE_FLAGS = "flag_bad_timestamp_format, flag_non_monotonic_time, flag_duplicate_timestamp, flag_time_gap_gt_expected"
CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def per_column(select: str, columns: list[str] = CHANNELS) -> str:
    """UNION ALL of one SELECT per column; ``{c}`` is the column, ``{i}`` its position."""
    return " UNION ALL ".join(select.format(c=c, i=i) for i, c in enumerate(columns))


# Sources ---------------------------------------------------------------------------------

ORACLE["multi_dataset_union"] = f"""WITH {PARSED}, stacked AS (
  SELECT source_dataset, ordinal, ts, 600 AS cadence, flow_raw FROM parsed
  UNION ALL SELECT 'orders', o_orderkey, CAST(o_orderdate AS TIMESTAMP), 86400, NULL FROM orders),
{sequence_flags('stacked', 'cadence')}
SELECT source_dataset, ordinal, ts, flow_raw, {SEQUENCE_FLAGS} FROM flagged"""

ORACLE["sample_first_n"] = f"WITH {RAW} SELECT ordinal, time_raw, flow_raw FROM raw ORDER BY ordinal LIMIT 1000"

ORACLE["typed_load"] = f"""WITH {RAW} SELECT ordinal,
  CASE WHEN flow_raw IN ('', 'n/a') THEN NULL ELSE CAST(flow_raw AS DOUBLE) END AS flow_raw, valve_raw,
  CAST(ec_raw AS BIGINT) AS ec_raw FROM raw"""

# Headers ---------------------------------------------------------------------------------

CATALOG = """catalog AS (
  SELECT p_partkey // 32 AS file_id, CAST(p_partkey % 32 AS INTEGER) AS position,
    CASE WHEN p_partkey // 32 % 7 = 0 AND p_partkey % 32 IN (1, 2) THEN 'x'
         WHEN p_partkey // 32 % 7 = 0 AND p_partkey % 32 = 3 THEN 'x_2' WHEN p_partkey // 32 % 7 = 0 AND p_partkey % 32 = 4 THEN 'x_2_2'
         WHEN p_partkey % 37 = 0 OR p_partkey % 64 = 0 THEN '' WHEN p_partkey % 13 = 5 THEN '%%%'
         WHEN p_partkey % 11 = 3 THEN p_name || ' (True/False)'
         WHEN p_partkey % 7 = 2 THEN '  ' || upper(p_name) || ' Pressure '
         WHEN p_partkey % 17 = 4 THEN p_type || '-TEC-' || p_size
         WHEN p_partkey % 19 = 6 THEN 'PT ' || p_size
         WHEN p_partkey % 23 = 1 THEN p_name || ' Flow (L/min)'
         WHEN p_partkey % 29 = 8 THEN 'Injection EC' WHEN p_partkey % 31 = 9 THEN 'Time'
         ELSE p_name END AS source
  FROM part)"""
CLEANED = f"""{CATALOG}, worded AS (
  SELECT *, trim(regexp_replace(lower(replace(source, '(True/False)', '')), '[^a-z0-9]+', '_', 'g'), '_') AS words,
    CASE WHEN position = 0 AND trim(source) = '' THEN 'raw_row_index'
         ELSE 'column_' || (position + 1) END AS fallback FROM catalog),
cleaned AS (SELECT file_id, position, source, CASE WHEN words = '' THEN fallback ELSE words END AS clean FROM worded)"""


ROUNDS = 4


def number_repeats(source: str, name: str) -> str:
    """Rounds of numbering repeated names within a file; one more than the test names need."""
    rounds = ""
    for k in range(1, ROUNDS + 1):
        rounds += f""", counted{k} AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, {name} ORDER BY position) AS k FROM {source}),
round{k} AS (SELECT * EXCLUDE (k, {name}), CASE WHEN k = 1 THEN {name} ELSE {name} || '_' || k END AS {name} FROM counted{k})"""
        source = f"round{k}"
    return rounds


ORACLE["header_normalize"] = f"WITH {CLEANED} SELECT * FROM cleaned"
ORACLE["header_dedupe"] = f"WITH {CLEANED}{number_repeats('cleaned', 'clean')} SELECT * FROM round{ROUNDS}"
ORACLE["header_roles"] = f"""WITH {CLEANED} SELECT *, CASE WHEN source = 'Time' THEN 'time'
  WHEN clean = 'raw_row_index' THEN 'index' WHEN contains(source, '(True/False)') THEN 'boolean'
  ELSE 'numeric' END AS role FROM cleaned"""
ORACLE["ml_name"] = f"""WITH {CATALOG}, named AS (SELECT *, lower(replace(replace(replace(replace(replace(source,
  ' ', '_'), '-', '_'), '/', '_per_'), '(', ''), ')', '')) AS ml_name FROM catalog)
{number_repeats('named', 'ml_name')} SELECT * FROM round{ROUNDS}"""

# Of the known terms, those that the test headers hold.
KNOWN = "('Time', 'Date/time of the observation.'), ('Injection EC', 'Electrical conductivity associated with injected water.')"


def name_rules(source: str, flow: str, pressure: str, tec: str, depth: str, ec: str, other: str) -> str:
    return f"""CASE WHEN contains(lower({source}), 'flow') THEN {flow}
  WHEN contains(lower({source}), 'pressure') OR regexp_matches(lower({source}), '^pt\\s*\\d+') THEN {pressure}
  WHEN contains(lower({source}), 'tec') THEN {tec} WHEN contains(lower({source}), 'depth') THEN {depth}
  WHEN regexp_matches(lower({source}), '(^|[^a-z0-9])ec([^a-z0-9]|$)') THEN {ec} ELSE {other} END"""


def definition(source: str) -> str:
    starts = ("Flow measurement for ", "Pressure measurement for ", "Thermocouple temperature measurement for ",
              "Depth measurement for ", "Electrical conductivity measurement for ", "Field representing ")
    rules = name_rules(source, *[f"'{s}' || {source} || '.'" for s in starts])
    return f"CASE WHEN lower({source}) = 'time' THEN 'Date/time of the observation.' ELSE {rules} END"


def unit(source: str) -> str:
    rules = name_rules(source, "'L/min'", "'psi'", "'C'", "'Feet'", "'EC units not explicitly stated'", "''")
    return f"CASE WHEN lower({source}) = 'time' THEN 'datetime' ELSE {rules} END"


ORACLE["column_definition"] = f"""WITH {CATALOG}, known(term, text) AS (VALUES {KNOWN})
SELECT file_id, position, source, coalesce(text, {definition('source')}) AS definition
FROM catalog LEFT JOIN known ON term = source"""
ORACLE["column_unit"] = f"WITH {CATALOG} SELECT *, {unit('source')} AS unit FROM catalog"

# Cells -----------------------------------------------------------------------------------

ORACLE["row_shape_repair"] = f"""WITH {RAW} SELECT ordinal, n_cells, n_cells <> 5 AS flag_row_length_mismatch,
  time_raw AS cell_1, flow_raw AS cell_2, valve_raw AS cell_3,
  CASE WHEN n_cells = 3 THEN '' ELSE pump_raw END AS cell_4,
  CASE WHEN n_cells = 3 THEN '' ELSE ec_raw END AS cell_5 FROM raw"""
ORACLE["safe_parse_time"] = f"WITH {PARSED} SELECT ordinal, ts, second_ts AS short_ts FROM parsed"
ORACLE["canonical_time"] = f"WITH {PARSED} SELECT ordinal, {ISO.format('ts')} AS time FROM parsed"
ORACLE["boolean_normalize"] = f"WITH {RAW} SELECT ordinal, lower(trim(valve_raw)) AS valve FROM raw"
ORACLE["boolean_encode"] = f"""WITH {RAW} SELECT ordinal, CAST(CASE lower(trim(valve_raw)) WHEN 'true' THEN 1
  WHEN 'false' THEN 0 END AS INTEGER) AS valve FROM raw"""
ORACLE["state_encode"] = f"""WITH {RAW} SELECT ordinal, lower(trim(pump_raw)) AS pump,
  CAST(CASE lower(trim(pump_raw)) WHEN 'on' THEN 1 WHEN 'off' THEN 0 END AS INTEGER) AS pump_on FROM raw"""
ORACLE["numeric_check"] = f"""WITH {RAW} SELECT ordinal,
  flow_raw <> '' AND try_cast(flow_raw AS DOUBLE) IS NULL AS flag_non_numeric_in_numeric_field FROM raw"""
ORACLE["numeric_coerce"] = f"WITH {RAW} SELECT ordinal, try_cast(flow_raw AS DOUBLE) AS flow FROM raw"
ORACLE["datetime_detect"] = f"""WITH {PARSED} SELECT ordinal, ts AS time_raw,
  CASE WHEN ordinal % 3 = 0 THEN 'pending' ELSE time_raw END AS sparse_time, flow_raw FROM parsed"""

# Order-dependent flags -------------------------------------------------------------------

ORACLE["prev_valid_time"] = f"WITH {FLAGGED} SELECT ordinal, ts, prev_valid_time FROM flagged"
for _key, _flag in (
    ("flag_bad_timestamp", "flag_bad_timestamp_format"), ("flag_non_monotonic", "flag_non_monotonic_time"),
    ("flag_duplicate", "flag_duplicate_timestamp"), ("flag_gap", "flag_time_gap_gt_expected"),
    ("flag_row_length", "flag_row_length_mismatch"),
):
    ORACLE[_key] = f"WITH {FLAGGED} SELECT ordinal, {_flag} FROM flagged"

RUNS = f"""{FLAGGED}, islands AS (
  SELECT source_dataset, flag_duplicate_timestamp AS dup, last_value(CASE WHEN NOT flag_duplicate_timestamp THEN ordinal END
    IGNORE NULLS) OVER (PARTITION BY source_dataset ORDER BY ordinal) AS island FROM flagged),
runs AS (SELECT source_dataset, island, count(*) + 1 AS run_length FROM islands WHERE dup GROUP BY ALL)"""
ORACLE["duplicate_runs"] = f"""WITH {RUNS}
SELECT source_dataset, run_length, count(*) AS runs FROM runs GROUP BY ALL"""
ORACLE["row_index"] = f"""WITH {PARSED} SELECT row_number() OVER (ORDER BY ts NULLS FIRST, ordinal) - 1 AS row_index,
  ordinal, ts AS time FROM parsed"""
ORACLE["row_index_per_series"] = """SELECT row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_index,
  event_type, event_id AS ordinal, ts AS time FROM events"""
ORACLE["row_index_null_series"] = """WITH e AS (SELECT CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type, event_id, ts FROM events)
SELECT row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_index, event_type, event_id AS ordinal, ts AS time FROM e"""
RATIO = """CASE WHEN q = lag(q) OVER w THEN 0.0
    ELSE coalesce((p - lag(p) OVER w) / (q - lag(q) OVER w), 0.0) END"""
ORACLE["delta_ratio"] = f"""WITH s AS (SELECT event_id AS ordinal, value AS p, CAST(user_id AS DOUBLE) AS q FROM events)
SELECT ordinal, p AS pressure, q AS flow, round_even({RATIO}, 9) + 0.0 AS "delta_P_delta_Q"
FROM s WINDOW w AS (ORDER BY ordinal)"""
ORACLE["state_flags"] = """SELECT event_id AS ordinal, CAST(user_id > 10 AND value > 40 AS INTEGER) AS tc_injecting,
  CAST(user_id > 10 AND NOT value > 40 AS INTEGER) AS tc_producing FROM events"""

# QA --------------------------------------------------------------------------------------

COUNTS = f"""SELECT source_dataset, count(*) AS rows_processed,
  count(*) FILTER (flag_row_length_mismatch) AS row_length_mismatches,
  count(*) FILTER (flag_bad_timestamp_format) AS timestamp_parse_failures,
  count(*) FILTER (flag_non_monotonic_time) AS non_monotonic_time_rows,
  count(*) FILTER (flag_duplicate_timestamp) AS duplicate_timestamp_rows,
  count(*) FILTER (flag_time_gap_gt_expected) AS time_gap_gt_expected_rows,
  count(*) FILTER (flag_non_numeric_in_numeric_field) AS rows_with_non_numeric_fields,
  {ISO.format('min(ts)')} AS time_min, {ISO.format('max(ts)')} AS time_max FROM flagged GROUP BY source_dataset"""
KEYS = f"SELECT source_dataset, {ISO.format('ts')} AS time, count(*) AS count FROM {{}} WHERE ts IS NOT NULL GROUP BY source_dataset, ts HAVING count(*) > 1"
ORACLE["qa_counts"] = f"WITH {FLAGGED} {COUNTS}"
ORACLE["duplicate_keys"] = f"WITH {PARSED} {KEYS.format('parsed')}"
ORACLE["duplicate_examples"] = f"WITH {PARSED} {KEYS.format('parsed')} ORDER BY time LIMIT 10"
ORACLE["offending_columns"] = f"""WITH {RAW}, bad AS (
  {per_column("SELECT source_dataset, '{c}' AS \"column\", count(*) AS bad_cells FROM raw WHERE trim({c}) <> '' AND try_cast({c} AS DOUBLE) IS NULL GROUP BY source_dataset", ["flow_raw", "ec_raw", "valve_raw"])})
SELECT * FROM bad"""
ORACLE["qa_summary"] = f"""WITH {RUNS}, counts AS ({COUNTS}), keys AS ({KEYS.format('flagged')}),
shown AS (SELECT time || '=' || count AS entry FROM keys ORDER BY time LIMIT 10),
lengths AS (SELECT run_length || '=' || count(*) AS entry FROM runs GROUP BY run_length)
SELECT counts.*, (SELECT count(*) FROM keys) AS duplicate_timestamp_keys,
  (SELECT string_agg(entry, ', ' ORDER BY entry) FROM shown) AS duplicate_timestamp_examples,
  (SELECT string_agg(entry, ', ' ORDER BY entry) FROM lengths) AS consecutive_duplicate_run_lengths,
  (SELECT 'flow_raw=' || count(*) FROM flagged WHERE flag_non_numeric_in_numeric_field) AS offending_numeric_columns
FROM counts"""

ORACLE["qa_summary_null_series"] = f"""WITH {PARSED}, checked AS (
  SELECT p.* REPLACE (CASE WHEN e.event_id % 3 <> 0 THEN e.event_type END AS source_dataset), n_cells <> 5 AS flag_row_length_mismatch,
    flow_raw <> '' AND try_cast(flow_raw AS DOUBLE) IS NULL AS flag_non_numeric_in_numeric_field
  FROM parsed p JOIN events e ON e.event_id = p.ordinal),
{sequence_flags('checked', '600')}, {RUNS[len(FLAGGED) + 2:]}, counts AS ({COUNTS}), keys AS ({KEYS.format('flagged')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY time) AS place FROM keys),
lengths AS (SELECT source_dataset, run_length || '=' || count(*) AS entry FROM runs GROUP BY source_dataset, run_length)
SELECT c.*, (SELECT count(*) FROM keys k WHERE k.source_dataset IS NOT DISTINCT FROM c.source_dataset) AS duplicate_timestamp_keys,
  coalesce((SELECT string_agg(time || '=' || count, ', ' ORDER BY time || '=' || count) FROM ranked k
    WHERE place <= 10 AND k.source_dataset IS NOT DISTINCT FROM c.source_dataset), '') AS duplicate_timestamp_examples,
  coalesce((SELECT string_agg(entry, ', ' ORDER BY entry) FROM lengths l WHERE l.source_dataset IS NOT DISTINCT FROM c.source_dataset), '') AS consecutive_duplicate_run_lengths,
  (SELECT CASE WHEN count(*) > 0 THEN 'flow_raw=' || count(*) ELSE '' END FROM flagged f
    WHERE flag_non_numeric_in_numeric_field AND f.source_dataset IS NOT DISTINCT FROM c.source_dataset) AS offending_numeric_columns
FROM counts c"""

SHAPED = """, shaped AS (SELECT * REPLACE (
    CASE WHEN n_cells = 3 THEN '' ELSE pump_raw END AS pump_raw,
    CASE WHEN n_cells = 3 THEN '' ELSE ec_raw END AS ec_raw) FROM flagged)"""


def all_flags(shape: str) -> str:
    flags = [*SEQUENCE_FLAGS.split(", "), "flag_row_length_mismatch", "flag_non_numeric_in_numeric_field"]
    return ", ".join(f"{shape.format(f)} AS {f}" for f in flags)


ORACLE["audit_table"] = f"""WITH {FLAGGED}{SHAPED}
SELECT source_dataset, ordinal AS row_order, time_raw, {ISO.format('ts')} AS time, flow_raw AS net_flow, lower(trim(valve_raw)) AS valve_a,
  lower(trim(pump_raw)) AS triplex_on_off, ec_raw AS injection_ec,
  {all_flags("CASE WHEN {} THEN 'true' ELSE 'false' END")} FROM shaped"""
# The file's row order counts from 0.
ORACLE["delimited_scan"] = ORACLE["audit_table"].replace("ordinal AS row_order", "row_number() OVER (ORDER BY ordinal) - 1 AS row_order")
ORACLE["ml_ready_table"] = f"""WITH {FLAGGED}{SHAPED}
SELECT source_dataset, ordinal AS row_order, {ISO.format('ts')} AS time, try_cast(flow_raw AS DOUBLE) AS net_flow,
  CAST(CASE lower(trim(valve_raw)) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS INTEGER) AS valve_a,
  CAST(CASE lower(trim(pump_raw)) WHEN 'on' THEN 1 WHEN 'off' THEN 0 END AS INTEGER) AS triplex_on_off,
  try_cast(ec_raw AS DOUBLE) AS injection_ec, {all_flags("CAST({} AS INTEGER)")} FROM shaped"""
ORACLE["qc_filter"] = f"""WITH {FLAGGED} SELECT ordinal, time_raw, flow_raw FROM flagged
WHERE NOT flag_duplicate_timestamp AND NOT flag_time_gap_gt_expected"""
ORACLE["blank_counts"] = f"""WITH {RAW} {per_column("SELECT '{c}' AS \"column\", count(*) FILTER (trim({c}) = '') AS blanks FROM raw", ["time_raw", "flow_raw", "valve_raw"])}"""

# Outliers and scaling --------------------------------------------------------------------

DATA = """data AS (SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(177.8 AS DOUBLE) ELSE CAST(177.8 AS DOUBLE) + CAST(3e-14 AS DOUBLE) END AS depth FROM lineitem)"""


def percentiles(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


BOUNDS = f"""{DATA}, bounds AS (SELECT {', '.join(f"{percentiles(c, 0.01)} AS {c}_lo, {percentiles(c, 0.99)} AS {c}_hi" for c in CHANNELS)} FROM data)"""
CLIPPED = f"""{BOUNDS}, clipped AS (SELECT l_orderkey, {', '.join(f"round_even(greatest({c}_lo, least({c}_hi, {c})), 6) AS {c}" for c in CHANNELS)}
  FROM data, bounds)"""

ORACLE["reduced_projection"] = "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem"
ORACLE["round_columns"] = f"SELECT l_orderkey, {', '.join(f'round_even({c} / 7, 6) AS {c}' for c in CHANNELS)} FROM lineitem"
ORACLE["zero_variance_report"] = f"""WITH {DATA} {per_column("SELECT '{c}' AS \"column\", round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(max({c}) - min({c}), 6) AS range, max({c}) - min({c}) < 1e-9 AS is_constant FROM data", [*CHANNELS, "depth"])}"""
ORACLE["percentile_bounds"] = f"""WITH {DATA} {per_column("SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.01), 6) AS lower, round(quantile_cont({c}, 0.99), 6) AS upper FROM data")}"""
ORACLE["percentile_bounds_narrowed"] = ORACLE["percentile_bounds"]
ORACLE["winsorize"] = f"WITH {CLIPPED} SELECT * FROM clipped"
ORACLE["clip_counts"] = f"""WITH {BOUNDS}, n AS ({per_column("SELECT '{c}' AS \"column\", count(*) FILTER ({c} < {c}_lo OR {c} > {c}_hi) AS clipped FROM data, bounds")})
SELECT * FROM n WHERE clipped > 0"""
ORACLE["minmax_params"] = f"""WITH {CLIPPED} {per_column("SELECT '{c}' AS \"column\", min({c}) AS min, max({c}) AS max FROM clipped")}"""
ORACLE["minmax_scale"] = f"""WITH {CLIPPED}, ends AS (SELECT {', '.join(f'min({c}) AS {c}_min, max({c}) AS {c}_max' for c in CHANNELS)} FROM clipped)
SELECT l_orderkey, {', '.join(f'round_even(({c} - {c}_min) / ({c}_max - {c}_min), 6) AS {c}' for c in CHANNELS)}, CAST(0.0 AS DOUBLE) AS depth
FROM clipped, ends"""
ORACLE["minmax_inverse"] = f"WITH {CLIPPED} SELECT l_orderkey, {', '.join(f'round({c}, 6) AS {c}' for c in CHANNELS)} FROM clipped"
ORACLE["standard_params"] = f"""WITH {DATA} {per_column("SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS std, round(CASE WHEN max({c}) - min({c}) < 1e-9 THEN 1.0 ELSE stddev_pop({c}) END, 9) AS scale FROM data", [*CHANNELS, "depth"])}"""
ORACLE["standard_scale"] = f"""WITH {DATA}, fitted AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1,
  avg(l_quantity) AS m2, stddev_pop(l_quantity) AS s2 FROM data)
SELECT l_orderkey, round((l_extendedprice - m1) / s1, 6) + 0.0 AS l_extendedprice, CAST(0.0 AS DOUBLE) AS depth,
  round((l_quantity - m2) / s2, 6) + 0.0 AS l_quantity FROM data, fitted"""
ORACLE["robust_params"] = f"""WITH {DATA} {per_column("SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.1), 6) AS low, round(quantile_cont({c}, 0.9), 6) AS high, round(quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1), 6) AS scale FROM data")}"""
ORACLE["robust_scale"] = f"""WITH {DATA}, fitted AS (SELECT {', '.join(f"quantile_cont({c}, 0.5) AS {c}_mid, quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) AS {c}_width" for c in ("l_extendedprice", "l_tax"))} FROM data)
SELECT l_orderkey, {', '.join(f'round(({c} - {c}_mid) / {c}_width, 6) + 0.0 AS {c}' for c in ("l_extendedprice", "l_tax"))} FROM data, fitted"""
ORACLE["ratio_zero_impute"] = f"""WITH {DATA}, fitted AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM data)
SELECT l_orderkey, round((l_extendedprice - m) / s, 6) + 0.0 AS l_extendedprice, CAST(0.0 AS DOUBLE) AS l_tax,
  CAST(0.0 AS DOUBLE) AS absent_ratio FROM data, fitted"""

# Features and time -----------------------------------------------------------------------

CALENDAR = """CAST(hour({t}) AS INTEGER) AS hour_of_day, CAST(isodow({t}) - 1 AS INTEGER) AS day_of_week,
  CAST(month({t}) AS INTEGER) AS month, CAST(isodow({t}) >= 6 AS INTEGER) AS is_weekend"""
CYCLIC = """round_even(sin(2 * pi() * hour({t}) / 24), 6) + 0.0 AS hour_sin, round_even(cos(2 * pi() * hour({t}) / 24), 6) + 0.0 AS hour_cos,
  round_even(sin(2 * pi() * (isodow({t}) - 1) / 7), 6) + 0.0 AS day_of_week_sin, round_even(cos(2 * pi() * (isodow({t}) - 1) / 7), 6) + 0.0 AS day_of_week_cos"""
ORACLE["time_features"] = f"SELECT event_id, {CALENDAR.format(t='ts')} FROM events"
ORACLE["cyclic_features"] = f"SELECT event_id, {CYCLIC.format(t='ts')} FROM events"
ORACLE["hourly_average"] = """SELECT 'events' AS source_dataset, date_trunc('hour', ts) AS window_start, count(*) AS rows,
  round(avg(value), 6) AS pressure, round(avg(CAST(user_id AS DOUBLE)), 6) AS flow FROM events GROUP BY date_trunc('hour', ts)"""
ORACLE["chronological_split"] = """WITH cut AS (SELECT CAST(floor(quantile_cont(epoch_us(ts), 0.8)) AS BIGINT) AS c FROM events)
SELECT event_id AS ordinal, epoch_us(ts) <= c AS is_train FROM events, cut"""

# Profiles --------------------------------------------------------------------------------

NUMBERS = """SELECT '{c}' AS "column", CAST({i} AS INTEGER) AS position, round(min({c}), 9) AS minimum, round(max({c}), 9) AS maximum,
  round(avg({c}), 9) AS mean, round(median({c}), 9) AS median, round(max({c}) - min({c}), 9) AS range,
  round(stddev_samp({c}), 9) AS std_dev, count({c}) AS count, count(*) - count({c}) AS missing_count,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent, count(DISTINCT {c}) AS unique_count FROM """
ORACLE["numeric_profile"] = f"""WITH {DATA}, gappy AS (SELECT * REPLACE (CASE WHEN l_tax > 0.01 THEN l_tax END AS l_tax),
  CAST(NULL AS DOUBLE) AS nothing FROM data) {per_column(NUMBERS + 'gappy', [*CHANNELS, "depth", "nothing"])}"""
ORACLE["datetime_profile"] = f"""WITH {PARSED} SELECT 'ts' AS "column", min(ts) AS minimum, max(ts) AS maximum,
  date_trunc('second', make_timestamp(CAST(floor(avg(epoch_us(ts))) AS BIGINT))) AS mean,
  make_timestamp(CAST(floor(median(epoch_us(ts))) AS BIGINT)) AS median, date_diff('second', min(ts), max(ts)) AS range_seconds,
  count(ts) AS count, count(*) - count(ts) AS missing_count,
  round((count(*) - count(ts)) * 100.0::DOUBLE / count(*), 2) AS missing_percent, count(DISTINCT ts) AS unique_count FROM parsed"""


def text_stats(c: str, source: str, order: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing_count,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent, count(DISTINCT {c}) AS unique_count,
  coalesce((SELECT string_agg(v, ', ' ORDER BY first) FROM (SELECT {c} AS v, min({order}) AS first FROM {source}
    WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY first LIMIT 5)), '') AS example_values FROM {source}"""


ORACLE["text_profile"] = f"""WITH {RAW}, filled AS (SELECT * REPLACE (nullif(flow_raw, '') AS flow_raw) FROM raw)
{' UNION ALL '.join(text_stats(c, 'filled', 'ordinal') for c in ('valve_raw', 'flow_raw', 'pump_raw'))}"""


def text6(value: str) -> str:
    return f"CAST(CAST(round({value}, 6) AS DECIMAL(38, 6)) AS VARCHAR)"


def dictionary_number(c: str, kind: str) -> str:
    return f"""SELECT '{c}' AS "Term", '{kind}' AS "Type", {text6(f'min({c})')} AS "Minimum", {text6(f'max({c})')} AS "Maximum",
  {text6(f'avg({c})')} AS "Mean", {text6(f'median({c})')} AS "Median", {text6(f'max({c}) - min({c})')} AS "Range",
  {text6(f'stddev_samp({c})')} AS "Std Dev", count({c}) AS "Count", count(*) - count({c}) AS "Missing Count",
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS "Missing Percent", count(DISTINCT {c}) AS "Unique Count",
  '' AS "Example Values" FROM orders"""


def dictionary_time(c: str) -> str:
    def shown(value: str) -> str:
        return f"strftime({value}, {FMT})"

    return f"""SELECT '{c}', 'datetime', {shown(f'min({c})')}, {shown(f'max({c})')},
  {shown(f'make_timestamp(CAST(floor(avg(epoch_us({c}))) AS BIGINT))')},
  {shown(f'make_timestamp(CAST(floor(median(epoch_us({c}))) AS BIGINT))')},
  date_diff('second', min({c}), max({c})) || ' s', NULL, count({c}), count(*) - count({c}),
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2), count(DISTINCT {c}), '' FROM orders"""


def dictionary_text(c: str) -> str:
    return f"""SELECT "column", 'string', NULL, NULL, NULL, NULL, NULL, NULL, count, missing_count, missing_percent,
  unique_count, example_values FROM ({text_stats(c, 'orders', 'o_orderkey')})"""


DICTIONARY = " UNION ALL ".join([
    dictionary_number("o_orderkey", "integer"), dictionary_number("o_custkey", "integer"),
    dictionary_text("o_orderstatus"), dictionary_number("o_totalprice", "float"),
    dictionary_time("o_orderdate"), dictionary_text("o_orderpriority")])
TERM = '"Term"'
ORACLE["column_profile"] = f"""WITH d AS ({DICTIONARY})
SELECT *, {definition(TERM)} AS "Definition", {unit(TERM)} AS "Unit" FROM d"""
ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
ORACLE["dictionary_fields"] = f"""WITH d AS ({DICTIONARY})
SELECT 'orders' AS dataset, 'Orders table' AS description, CAST(list_position({ORDER_COLUMNS}, "Term") - 1 AS INTEGER) AS at,
  "Term" AS term, {definition(TERM)} AS definition, "Type" AS type, "Count" AS count, "Unique Count" AS unique_count,
  CASE WHEN "Type" = 'string' THEN "Example Values" END AS example_values,
  try_cast("Minimum" AS DOUBLE) AS minimum, try_cast("Maximum" AS DOUBLE) AS maximum, try_cast("Mean" AS DOUBLE) AS mean,
  try_cast("Median" AS DOUBLE) AS median, try_cast("Std Dev" AS DOUBLE) AS std_dev FROM d"""
ORACLE["dataset_summary"] = """SELECT 'orders.parquet' AS "Dataset File", count(*) AS "Rows", CAST(6 AS INTEGER) AS "Columns" FROM orders"""
ORACLE["value_frequency"] = """SELECT round_even(value, 0) AS value, count(*) AS count FROM events GROUP BY 1
ORDER BY count DESC, value LIMIT 10"""
ORACLE["sign_counts"] = """SELECT 'value' AS "column", count(*) FILTER (value - 50 > 0) AS positive,
  count(*) FILTER (value - 50 <= 0) AS non_positive FROM events UNION ALL
SELECT 'user_id', count(*) FILTER (user_id > 0), count(*) FILTER (user_id <= 0) FROM events"""
ORACLE["distinct_sample"] = """SELECT DISTINCT round_even(l_extendedprice, 4) AS value FROM lineitem ORDER BY value LIMIT 10"""

# Flows -----------------------------------------------------------------------------------

BASIC = f"""basic AS (SELECT row_number() OVER (ORDER BY date_trunc('second', ts), event_id) - 1 AS row_index,
  strftime(ts, {FMT}) AS time, round_even(value / 7, 6) AS tl_interval_pressure,
  CAST(user_id AS DOUBLE) AS net_flow_l_per_min, date_trunc('second', ts) AS t FROM events)"""
ORACLE["variant_basic"] = f"WITH {BASIC} SELECT * EXCLUDE (t) FROM basic"
ORACLE["variant_features"] = f"WITH {BASIC} SELECT * EXCLUDE (t), {CALENDAR.format(t='t')}, {CYCLIC.format(t='t')} FROM basic"
VARIANT = ("tl_interval_pressure", "net_flow_l_per_min")
ORACLE["variant_normalized"] = f"""WITH {BASIC}, b AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi' for c in VARIANT)} FROM basic),
clipped AS (SELECT row_index, time, {', '.join(f'round_even(greatest({c}_lo, least({c}_hi, {c})), 6) AS {c}' for c in VARIANT)} FROM basic, b),
ends AS (SELECT {', '.join(f'min({c}) AS {c}_min, max({c}) AS {c}_max' for c in VARIANT)} FROM clipped)
SELECT row_index, time, {', '.join(f'round_even(({c} - {c}_min) / ({c}_max - {c}_min), 6) AS {c}' for c in VARIANT)} FROM clipped, ends"""
ORACLE["scaled_for_model"] = f"""WITH {FLAGGED}, kept AS (
  SELECT ordinal, CAST(ec_raw AS DOUBLE) AS q, coalesce(try_cast(flow_raw AS DOUBLE), 0.0) AS p,
    CAST(ordinal % 1000 AS DOUBLE) AS level FROM flagged WHERE NOT flag_duplicate_timestamp AND NOT flag_time_gap_gt_expected),
engineered AS (SELECT *, round_even({RATIO}, 9) + 0.0 AS r, CAST(q > 10 AND p > 40 AS INTEGER) AS injecting,
  CAST(q > 10 AND NOT p > 40 AS INTEGER) AS producing FROM kept WINDOW w AS (ORDER BY ordinal)),
fitted AS (SELECT avg(p) AS pm, stddev_pop(p) AS ps, avg(level) AS lm, stddev_pop(level) AS ls, avg(q) AS qm, stddev_pop(q) AS qs,
  median(r) AS rm, quantile_cont(r, 0.9) - quantile_cont(r, 0.1) AS rs FROM engineered)
SELECT ordinal, round((p - pm) / ps, 6) + 0.0 AS pressure, round((level - lm) / ls, 6) + 0.0 AS level, round((q - qm) / qs, 6) + 0.0 AS flow,
  round((r - rm) / rs, 6) + 0.0 AS "delta_P_delta_Q", injecting, producing FROM engineered, fitted"""

# Streams ---------------------------------------------------------------------------------

# A window closes once the newest time, less ten minutes, has passed its end.
ORACLE["stream_hourly_average"] = """WITH newest AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT 'events' AS source_dataset, date_trunc('hour', ts) AS window_start, count(*) AS rows, round(avg(value), 6) AS pressure
FROM events, newest GROUP BY date_trunc('hour', ts), mark HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark"""
ORACLE["stream_flags"] = f"WITH {FLAGGED} SELECT ordinal, {SEQUENCE_FLAGS} FROM flagged"

ORACLE["stream_duplicate_runs"] = ORACLE["duplicate_runs"]

# Files and wide tables -------------------------------------------------------------------

_WIDE = {f"channel_{k}": f"CASE WHEN ordinal % {97 + k} = {k} THEN 'n/a' WHEN ordinal % {89 + k} = 3 THEN '' ELSE CAST(ordinal * {k + 1} % 1000 AS VARCHAR) END"
         for k in range(67)}
_WIDE_FLAGS = [*SEQUENCE_FLAGS.split(", "), "flag_row_length_mismatch", "flag_non_numeric_in_numeric_field"]
ORACLE["wide_clean"] = f"""WITH {PARSED}, texts AS (SELECT source_dataset, ordinal, time_raw, ts, {', '.join(f'{text} AS {c}' for c, text in _WIDE.items())} FROM parsed),
checked AS (SELECT *, FALSE AS flag_row_length_mismatch, {' OR '.join(f"{c} = 'n/a'" for c in _WIDE)} AS flag_non_numeric_in_numeric_field FROM texts),
{sequence_flags('checked', '600')}
SELECT 'wide' AS source_dataset, row_number() OVER (ORDER BY ordinal) - 1 AS row_order, {ISO.format('ts')} AS time,
  {', '.join(f'try_cast({c} AS DOUBLE) AS {c}' for c in _WIDE)}, {', '.join(f'CAST({f} AS INTEGER) AS {f}' for f in _WIDE_FLAGS)},
  md5(concat_ws('|', 'wide', time_raw, {ISO.format('ts')}, {', '.join(_WIDE)}, {', '.join(f"CASE WHEN {f} THEN 'true' ELSE 'false' END" for f in _WIDE_FLAGS)})) AS audit
FROM flagged"""
ORACLE["delimited_scan_multiline"] = f"""WITH {RAW}, rows AS (SELECT row_number() OVER (ORDER BY ordinal) - 1 AS row_order, *,
    CASE WHEN ordinal % 70 = 1 THEN 0 WHEN ordinal % 90 = 2 THEN 1 WHEN ordinal % 110 = 3 THEN 4 ELSE 3 END AS n FROM raw)
SELECT row_order, CASE WHEN n > 0 THEN time_raw ELSE '' END AS time_raw,
  CASE WHEN n < 2 THEN '' WHEN ordinal % 50 = 0 THEN 'first ' || ordinal || chr(10) || chr(10) || ', "second"' ELSE 'note ' || ordinal END AS note,
  CASE WHEN n < 2 THEN '' ELSE flow_raw END AS flow, n <> 3 AS flag_row_length_mismatch FROM rows"""
ORACLE["clean_to_model"] = f"""WITH {FLAGGED}{SHAPED}, placed AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS row_order FROM shaped),
kept AS (SELECT row_order, CAST(CASE lower(trim(valve_raw)) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS INTEGER) AS valve_a,
  try_cast(ec_raw AS DOUBLE) AS p, try_cast(flow_raw AS DOUBLE) AS q FROM placed WHERE NOT flag_duplicate_timestamp AND NOT flag_time_gap_gt_expected),
fitted AS (SELECT avg(p) AS pm, stddev_pop(p) AS ps, avg(q) AS qm, stddev_pop(q) AS qs FROM kept)
SELECT row_order, valve_a, round((p - pm) / ps, 6) + 0.0 AS injection_ec, round((q - qm) / qs, 6) + 0.0 AS net_flow FROM kept, fitted"""
ORACLE["big_integer_profile"] = """WITH data AS (SELECT l_orderkey + 9007199254740992 AS large, l_partkey FROM lineitem) """ + per_column(
    "SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS minimum, CAST(max({c}) AS VARCHAR) AS maximum, "
    "CAST(max({c}) - min({c}) AS VARCHAR) AS range, count({c}) AS count, count(DISTINCT {c}) AS unique_count FROM data", ["large", "l_partkey"])
ORACLE["subsecond_duplicate_keys"] = f"""SELECT 'events' AS source_dataset, {ISO.format("date_trunc('minute', ts)")} AS time, count(*) AS count
FROM events GROUP BY date_trunc('minute', ts) HAVING count(*) > 1"""
ORACLE["datetime_detect_short"] = f"WITH {RAW} SELECT ordinal, second_ts AS short_raw, valve_raw FROM raw"
ORACLE["variants_from_file"] = ORACLE["variant_normalized"]
ORACLE["total_clipped"] = f"""WITH {BOUNDS} SELECT CAST({' + '.join(f'count(*) FILTER ({c} < {c}_lo OR {c} > {c}_hi)' for c in CHANNELS)} AS BIGINT) AS clipped_cells
FROM data, bounds"""
