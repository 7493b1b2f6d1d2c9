"""Projections, filters and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import names, numeric
from cohortloom.operators import streams

from .inputs import PREDICTIONS, SAMPLES, VECTORS, predictions, r, samples, table, vectors
from .registry import query


def _kw_sql(rules: dict, text: str) -> str:
    cases = []
    for label, words in rules.items():
        hit = " OR ".join(f"contains({text}, '{w.replace('-', '_')}')" for w in words)
        cases.append(f"CASE WHEN {hit} THEN '{label}' END")
    return "list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL)"


# Column names of the study's stream files, used to derive column sets from event payloads.
STREAM_COLUMNS = [
    "time_dn", "gaze_direction_l_x", "gaze_origin_r_x_mm", "pupil_diameter_l_mm", "eye_openness_l", "ecg_projection_la_ra_mV",
    "eda_hand_l_kOhms", "ppg_finger_mV", "emg_wrist_flexor_mV", "respiration_chest_mV", "accelerometry_torso_z_mps2",
    "pilot_head_position_h_m", "pilot_head_pitch_deg", "aircraft_ils_deflection_h", "aircraft_latitude_deg",
    "glideslope_error_deg", "total_error",
]
_N = len(STREAM_COLUMNS)
_COLS_SQL = "[" + ", ".join(f"'{c}'" for c in STREAM_COLUMNS) + "]"

FILES = """files AS (
  SELECT o_orderkey,
    'task-ils/sub-cp' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '/ses-' || strftime(o_orderdate, '%Y%m%d') ||
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '/level-0' || CAST(o_orderkey % 5 AS VARCHAR) || 'B' END ||
    '_run-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 3, '0') AS dir,
    CASE o_orderkey % 7 WHEN 0 THEN 'PerfMetrics.csv' WHEN 1 THEN 'sub_task-ils_ocuevts_run.csv'
      WHEN 2 THEN 'x_feat-perfmetric_run.csv' WHEN 3 THEN 'sub_stream-lslhtcviveeye_run_dat.csv'
      WHEN 4 THEN 'sub_stream-lslxp11_position_hea.csv' WHEN 5 THEN 'README-' || o_orderpriority || '.md'
      ELSE 'Bitalino ' || o_orderstatus || '.v2.mat' END AS file_name
  FROM orders)"""


def files(spark, sf):
    """File paths in the study's naming scheme, derived from the orders table."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    level = F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("/level-0"), (key % 5).cast("string"), F.lit("B")))
    name = (
        F.when(key % 7 == 0, "PerfMetrics.csv").when(key % 7 == 1, "sub_task-ils_ocuevts_run.csv")
        .when(key % 7 == 2, "x_feat-perfmetric_run.csv").when(key % 7 == 3, "sub_stream-lslhtcviveeye_run_dat.csv")
        .when(key % 7 == 4, "sub_stream-lslxp11_position_hea.csv")
        .when(key % 7 == 5, F.concat(F.lit("README-"), "o_orderpriority", F.lit(".md")))
        .otherwise(F.concat(F.lit("Bitalino "), "o_orderstatus", F.lit(".v2.mat")))
    )
    return o.select(
        "o_orderkey",
        F.concat(
            F.lit("task-ils/sub-cp"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("/ses-"),
            F.date_format("o_orderdate", "yyyyMMdd"), level, F.lit("_run-"),
            F.lpad((key % 12 + 1).cast("string"), 3, "0"),
        ).alias("dir"),
        name.alias("file_name"),
    )


@query("f01_to_number", """
WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN o_orderpriority
  ELSE CAST(o_totalprice AS VARCHAR) END AS txt FROM orders)
SELECT o_orderkey, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS value
FROM (SELECT o_orderkey, TRY_CAST(txt AS DOUBLE) AS v FROM raw)""")
def f01(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    txt = F.when(k == 0, "NaN").when(k == 1, "Infinity").when(k == 2, F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    return o.select("o_orderkey", numeric.to_number(txt).alias("value"))


_CLEAN = "regexp_replace(lower(trim({0})), '[^0-9a-z]+', '_', 'g')"


def _clean_sql(c: str) -> str:
    t = f"trim({_CLEAN.format(c)}, '_')"
    v = f"CASE WHEN {t} = '' THEN 'value' ELSE {t} END"
    return f"CASE WHEN regexp_matches({t}, '^[0-9]') THEN 'c_' || {t} ELSE {v} END"


@query("f02_clean_name", f"""
WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) || ' ' || p_brand || '/' || p_name || '!'
  WHEN 1 THEN '  ' || p_type || '--' || p_name ELSE '#' END AS raw FROM part)
SELECT p_partkey, {_clean_sql('raw')} AS clean FROM n""")
def f02(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 3
    raw = (
        F.when(k == 0, F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_brand", F.lit("/"), "p_name", F.lit("!")))
        .when(k == 1, F.concat(F.lit("  "), "p_type", F.lit("--"), "p_name")).otherwise("#")
    )
    return p.select("p_partkey", names.clean_name(raw).alias("clean"))


@query("f03_dedup_names", f"""
WITH n AS (SELECT p_brand, p_partkey, {_clean_sql('p_name')} AS clean FROM part),
m AS (SELECT *, row_number() OVER (PARTITION BY p_brand, clean ORDER BY p_partkey) AS nth FROM n)
SELECT p_brand, p_partkey, clean, CASE WHEN nth > 1 THEN clean || '__dup' || nth ELSE clean END AS out_name FROM m""")
def f03(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", names.clean_name(F.col("p_name")).alias("clean"))
    return streams.dedup_names(p, ["p_brand"], "clean", "p_partkey")


@query("f04_extract_ids", f"""
WITH {FILES}, ids AS (SELECT o_orderkey, regexp_extract(dir, 'sub-[A-Za-z0-9]+') AS subject_id,
  regexp_extract(dir, 'ses-[A-Za-z0-9]+') AS session_id, regexp_extract(dir, 'level-[A-Za-z0-9]+') AS difficulty_level,
  regexp_extract(dir, 'run-[0-9]+') AS run_id FROM files)
SELECT *, CASE WHEN subject_id <> '' AND session_id <> '' AND difficulty_level <> '' AND run_id <> ''
  THEN subject_id || '_' || session_id || '_' || difficulty_level || '_' || run_id ELSE '' END AS run_key FROM ids""")
def f04(spark, sf):
    f = files(spark, sf)
    return f.select("o_orderkey", *[c.alias(n) for n, c in names.extract_ids(F.col("dir")).items()])


URL_PATTERNS = {"host": r"https?://[^/]+", "lang": r"/(?:de|en|es|fr)/", "page": r"page=\d+"}


@query("f04_extract_url_ids", """
WITH ids AS (SELECT page_id, regexp_extract(url, 'https?://[^/]+') AS host, regexp_extract(url, '/(?:de|en|es|fr)/') AS lang,
  regexp_extract(url, 'page=\\d+') AS page FROM pages)
SELECT *, CASE WHEN host <> '' AND lang <> '' AND page <> '' THEN host || '_' || lang || '_' || page ELSE '' END AS run_key FROM ids""")
def f04_url(spark, sf):
    ids = names.extract_ids(F.col("url"), URL_PATTERNS)
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in ids.items()])


@query("f05_parse_level", f"""
WITH {FILES}, l AS (SELECT o_orderkey, TRY_CAST(regexp_extract(dir, 'level-(\\d{{2,3}})', 1) AS INTEGER) AS difficulty_level FROM files)
SELECT o_orderkey, difficulty_level, difficulty_level - 1 AS target_class, CAST(difficulty_level AS DOUBLE) AS target_score FROM l""")
def f05(spark, sf):
    lv = files(spark, sf).select("o_orderkey", names.level_number(F.col("dir")).alias("difficulty_level"))
    return lv.select("*", (F.col("difficulty_level") - 1).alias("target_class"), F.col("difficulty_level").cast("double").alias("target_score"))


_TAG_SQL = f"""CASE WHEN lower(file_name) = 'perfmetrics.csv' THEN 'cumulative' WHEN contains(lower(file_name), 'ocuevts') THEN 'ocuevts'
  WHEN contains(lower(file_name), 'feat-perfmetric') THEN 'perfmetric'
  WHEN regexp_extract(lower(file_name), 'stream-([^_]+)', 1) <> '' THEN {_clean_sql("regexp_extract(lower(file_name), 'stream-([^_]+)', 1)")}
  ELSE {_clean_sql("regexp_replace(file_name, '[.][^.]*$', '')")} END"""


@query("f06_source_tag", f"WITH {FILES} SELECT o_orderkey, {_TAG_SQL} AS tag FROM files")
def f06(spark, sf):
    return files(spark, sf).select("o_orderkey", names.source_tag(F.col("file_name")).alias("tag"))


def _name_class_sql(text: str) -> str:
    return f"""SELECT *, CASE WHEN list_contains(hits, 'license_or_metadata') THEN 'license_or_metadata'
      WHEN list_contains(hits, 'performance') THEN 'performance' WHEN len(hits) = 1 THEN hits[1] ELSE 'unknown' END AS modality
    FROM (SELECT *, {_kw_sql(names.FILENAME_KEYWORDS, 'hay')} AS hits
      FROM (SELECT *, replace(replace(replace(lower({text}), '-', '_'), 'task_ils', ''), 'task_rest', '') AS hay FROM src))"""


_NAME_METHOD = """CASE WHEN len(hits) = 0 THEN 'unclassified_filename' WHEN modality <> 'unknown' THEN 'filename_keyword'
  ELSE 'ambiguous_filename_keywords:' || array_to_string(hits, ';') END"""


@query("f07_classify_by_keywords", f"""
WITH src AS (SELECT doc_id, text FROM documents), c AS ({_name_class_sql('text')})
SELECT doc_id, modality, {_NAME_METHOD} AS method FROM c""")
def f07(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.inline(F.array(names.classify_name(F.col("text")))))


COLUMN_SETS = f"""sets AS (SELECT run_key, list_sort(list_distinct(list({_COLS_SQL}[k % {_N} + 1]))) AS cols
  FROM samples WHERE k % 3 = 0 GROUP BY run_key)"""


def column_sets(spark, sf):
    """The set of column names per run, derived from the event payloads (at most 17 names)."""
    s = samples(spark, sf).where("k % 3 = 0")
    name = F.element_at(F.array(*[F.lit(c) for c in STREAM_COLUMNS]), (F.col("k") % _N + 1).cast("int"))
    return s.groupBy("run_key").agg(F.array_sort(F.collect_set(name)).alias("cols"))


def _col_class_sql() -> str:
    return f"""SELECT *, CASE WHEN len(hits) = 1 THEN hits[1] WHEN list_contains(hits, 'performance') THEN 'performance'
      WHEN list_contains(hits, 'head_movement') AND len(list_filter(cols, lambda x: starts_with(x, 'pilot_head'))) > 0 THEN 'head_movement'
      ELSE 'unknown' END AS modality
    FROM (SELECT *, {_kw_sql(names.COLUMN_KEYWORDS, "replace(lower(array_to_string(cols, ' ')), '-', '_')")} AS hits FROM sets)"""


_COL_METHOD = """CASE WHEN len(hits) = 0 THEN 'unclassified_csv_columns' WHEN len(hits) = 1 THEN 'csv_column_keyword'
  WHEN modality <> 'unknown' THEN 'csv_column_keyword_priority' ELSE 'ambiguous_csv_column_keywords:' || array_to_string(hits, ';') END"""


@query("f08_classify_columns", f"""
WITH {SAMPLES}, {COLUMN_SETS}, c AS ({_col_class_sql()})
SELECT run_key, modality, {_COL_METHOD} AS method FROM c""")
def f08(spark, sf):
    return column_sets(spark, sf).select("run_key", F.inline(F.array(names.classify_columns(F.col("cols")))))


EVIDENCE_NAMES = [
    "gaze_x", " Pupil_L", "fixationseq", "SaccadeSeq", "fixationseq_id", "ecg_mv", "gsr_us", "emg_mv", "respiration_mv", "respiration", "trim",
    "pilot_head_roll_deg", "aircraft_pitch", "Total_Error", "total_error_x", "accelerometry_torso_x", "left_throttle", "aileron_command", "time",
]


@query("f08_column_evidence", f"""
WITH {SAMPLES}, sets AS (SELECT run_key, list(DISTINCT lower(trim({EVIDENCE_NAMES}[k % {len(EVIDENCE_NAMES)} + 1]))) AS cols FROM samples GROUP BY run_key),
kinds AS (SELECT * FROM (VALUES ('ecg', '^ecg_'), ('emg', '^emg_'), ('eda', '^(eda|gsr)_'), ('respiration', '^respiration_'), ('head_movement', '^pilot_head_'),
  ('xplane', '^aircraft_'), ('torso_body_accelerometer', '^accelerometry_torso_'),
  ('eye_tracking', '^(gaze_|pupil_|eye_openness|validity_|convergence_)|^(fixation|saccade)seq$'),
  ('performance', '^((glideslope|localizer)_error_deg|airspeed_error_kts|total_error)$'),
  ('control_input', 'joystick|yoke|throttle|rudder|control_input|flight_control|(stick|pedal)_position|(aileron|elevator)_command')) v(kind, pattern)),
names AS (SELECT run_key, unnest(cols) AS c FROM sets),
hits AS (SELECT run_key, string_agg(DISTINCT kind, ';' ORDER BY kind) AS evidence FROM names JOIN kinds ON regexp_matches(c, pattern) GROUP BY run_key)
SELECT run_key, coalesce(evidence, '') AS evidence FROM sets LEFT JOIN hits USING (run_key)""")
def f08_evidence(spark, sf):
    name = F.element_at(F.array(*[F.lit(c) for c in EVIDENCE_NAMES]), (F.col("k") % len(EVIDENCE_NAMES) + 1).cast("int"))
    sets = samples(spark, sf).groupBy("run_key").agg(F.collect_set(name).alias("cols"))
    return sets.select("run_key", F.concat_ws(";", names.modality_evidence(F.col("cols"))).alias("evidence"))


_FNAME_SQL = "['sub_lslxp11_dat.csv', 'sub_ecg_dat.csv', 'sub_bitalino_emg.csv', 'notes.csv', 'LICENSE.txt'][hash_k + 1]"


@query("f09_resolve_modality", f"""
WITH {SAMPLES}, {COLUMN_SETS}, c0 AS ({_col_class_sql()}),
c AS (SELECT run_key, cols, modality AS cm, {_COL_METHOD} AS cmeth FROM c0),
src AS (SELECT *, ['sub_lslxp11_dat.csv', 'sub_ecg_dat.csv', 'sub_bitalino_emg.csv', 'notes.csv', 'LICENSE.txt'][len(run_key) % 5 + 1] AS fn FROM c),
n0 AS ({_name_class_sql('fn')}), n AS (SELECT *, {_NAME_METHOD} AS method FROM n0)
SELECT run_key,
  CASE WHEN modality = 'license_or_metadata' THEN modality WHEN modality = 'unknown' THEN cm
    WHEN modality = 'xplane' AND cm IN ('head_movement', 'performance') THEN cm ELSE modality END AS modality,
  CASE WHEN modality = 'license_or_metadata' THEN method WHEN modality = 'unknown' AND cm <> 'unknown' THEN cmeth
    WHEN cm = 'unknown' OR cm = modality THEN method
    WHEN modality = 'xplane' AND cm IN ('head_movement', 'performance') THEN 'csv_columns_overrode_broad_filename_keyword'
    ELSE method || ';csv_column_support=' || cm END AS method
FROM n""")
def f09(spark, sf):
    fn = F.element_at(
        F.array(*[F.lit(x) for x in ("sub_lslxp11_dat.csv", "sub_ecg_dat.csv", "sub_bitalino_emg.csv", "notes.csv", "LICENSE.txt")]),
        F.length("run_key") % 5 + 1,
    )
    c = column_sets(spark, sf).select(
        "run_key", names.classify_name(fn).alias("by_name"), names.classify_columns(F.col("cols")).alias("by_cols")
    )
    return c.select("run_key", F.inline(F.array(names.resolve_modality(F.col("by_name"), F.col("by_cols")))))


@query("f10_skip_reason", f"""
WITH {FILES} SELECT o_orderkey, CASE WHEN lower(file_name) LIKE '%\\_hea.csv' ESCAPE '\\' THEN 'header_metadata_file'
  WHEN lower(file_name) = 'perfmetrics.csv' THEN NULL
  WHEN NOT (lower(file_name) LIKE '%.csv' OR lower(file_name) LIKE '%.mat') THEN 'unsupported_or_documentation_file'
  WHEN o_orderkey % 11 = 0 THEN 'missing_run_identifier' END AS reason FROM files""")
def f10(spark, sf):
    f = files(spark, sf)
    key = names.extract_ids(F.col("dir"))["run_key"]
    return f.select("o_orderkey", names.skip_reason(F.col("file_name"), key).alias("reason"))


_RAW_TIME = """raw AS (SELECT run_key, stream, event_id, CASE stream WHEN 'click' THEN t / 86400 + 719529
  WHEN 'error' THEN floor(t * 1000) - 1704067200000 ELSE floor(t) - 1704067200 END AS tm FROM samples)"""


def _raw_time(spark, sf):
    s = samples(spark, sf)
    tm = (
        F.when(F.col("stream") == "click", F.col("t") / 86400 + 719529)
        .when(F.col("stream") == "error", (F.floor(F.col("t") * 1000) - 1704067200000).cast("double"))
        .otherwise((F.floor("t") - 1704067200).cast("double"))
    )
    return s.select("run_key", "stream", "event_id", tm.alias("tm"))


_TIME_BASE = """tb AS (
  SELECT run_key, min(tm) AS t0, max(tm) AS t1, count(tm) AS n, bool_or(stream = 'click') AS dn,
         quantile_cont(d, 0.5) AS med
  FROM (SELECT *, tm - lag(tm) OVER (PARTITION BY run_key ORDER BY tm, event_id) AS d FROM raw) GROUP BY run_key),
scaled AS (SELECT *, CASE WHEN dn OR t0 > 100000 THEN 86400.0::DOUBLE WHEN med > 1000 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM tb)"""


@query("f11_elapsed_seconds", f"""
WITH {SAMPLES}, {_RAW_TIME}, {_TIME_BASE}
SELECT raw.event_id, raw.run_key, round((tm - t0) * scale, 3) + 0.0 AS elapsed FROM raw JOIN scaled ON raw.run_key = scaled.run_key""")
def f11(spark, sf):
    e = streams.elapsed_seconds(_raw_time(spark, sf), ["run_key"], "tm", "event_id", F.col("stream") == "click")
    return e.select("event_id", "run_key", r("elapsed", 3).alias("elapsed"))


@query("f12_datenum", """
SELECT event_id, CAST(floor((epoch_us(ts) / 86400e6 + 719529) * 86400) AS BIGINT) AS datenum_sec,
  CAST(round((epoch_us(ts) / 86400e6 + 719529 - 719529) * 86400e6) AS BIGINT) // 1000 AS restored_ms FROM events""")
def f12(spark, sf):
    e = table(spark, sf, "events")
    dn = numeric.ts_to_datenum(F.col("ts").cast("timestamp"))
    back = F.unix_micros(numeric.datenum_to_ts(dn))
    return e.select("event_id", F.floor(dn * 86400).alias("datenum_sec"), F.floor(back / 1000).cast("long").alias("restored_ms"))


@query("f13_gaze_projection", f"""
WITH {VECTORS}, a AS (SELECT vec_id, degrees(atan(vec[2] / vec[1])) AS th, degrees(atan(vec[2] / vec[3])) AS ph FROM vectors),
b AS (SELECT vec_id, CASE WHEN th < 0 THEN th + 180 ELSE th END AS th, CASE WHEN ph < 0 THEN ph + 180 ELSE ph END AS ph FROM a)
SELECT vec_id, round(1440 * ((th - 90) / 90), 6) + 0.0 AS gaze_x,
  round(1600 * (CASE WHEN ph > 90 THEN ph - 180 ELSE ph END) / 90, 6) + 0.0 AS gaze_y FROM b""")
def f13(spark, sf):
    v = vectors(spark, sf)
    x, y, z = (F.get("vec", F.lit(i)) for i in range(3))
    g = v.select("vec_id", numeric.gaze_2d(x, y, z).alias("g"))
    return g.select("vec_id", r("g.gaze_x", 6).alias("gaze_x"), r("g.gaze_y", 6).alias("gaze_y"))


@query("f14_clean_stream", f"""
WITH {SAMPLES}, a AS (SELECT subject, event_id, CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE ELSE value END AS pupil,
  CASE WHEN event_id % 17 <> 0 THEN k END AS k FROM samples),
b AS (SELECT * FROM a WHERE k IS NOT NULL)
SELECT event_id, subject, pupil, k FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM b) WHERE n >= 50""")
def f14(spark, sf):
    s = samples(spark, sf).select(
        "subject", "event_id", F.when(F.col("event_id") % 13 == 0, -1.0).otherwise(F.col("value")).alias("pupil"),
        F.when(F.col("event_id") % 17 != 0, F.col("k")).alias("k"),
    )
    return streams.clean_stream(s, ["subject"], ["pupil", "k"], {"pupil": (-1.0, 0.0)}).select("event_id", "subject", "pupil", "k")


LAYOUT = {"Recording timestamp": "t", "PupilDiam_l": "value", "FixationSeq": "k", "run": "run_key"}


@query("f15_standard_layout", f"""
WITH {SAMPLES} SELECT t AS "Recording timestamp", value AS "PupilDiam_l", k AS "FixationSeq", run_key AS run FROM samples""")
def f15(spark, sf):
    return streams.to_layout(samples(spark, sf), LAYOUT)


FLIGHT = """flight AS (SELECT event_id, run_key, subject, stream, t, -71.6::DOUBLE + k / 100.0::DOUBLE * 0.4::DOUBLE AS lon,
  42.40::DOUBLE + value / 490.0::DOUBLE * 0.1::DOUBLE AS lat, 37.4::DOUBLE + event_id % 1300 AS alt,
  CAST(event_id % 7 - 3 AS DOUBLE) AS loc, 90 + CAST(k AS DOUBLE) AS kias FROM samples)"""


def flight(spark, sf):
    s = samples(spark, sf)
    return s.select(
        "event_id", "run_key", "subject", "stream", "t",
        (F.lit(-71.6) + F.col("k") / F.lit(100.0) * 0.4).alias("lon"),
        (F.lit(42.40) + F.col("value") / F.lit(490.0) * 0.1).alias("lat"),
        (F.lit(37.4) + F.col("event_id") % 1300).alias("alt"),
        (F.col("event_id") % 7 - 3).cast("double").alias("loc"),
        (90 + F.col("k").cast("double")).alias("kias"),
    )


def _ecef_sql(lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    a, f = "6378137.0::DOUBLE", "(1 / 298.257223563::DOUBLE)"
    e2 = f"({f} * (2 - {f}))"
    n = f"({a} / sqrt(1 - {e2} * sin(radians({lat})) * sin(radians({lat}))))"
    return (
        f"(({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})))",
        f"(({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({n} * (1 - {e2}) + {alt}) * sin(radians({lat})))",
    )


def _ned_sql(lat: str, lon: str, alt: str, origin) -> tuple[str, str, str]:
    lon0, lat0, alt0 = (f"({v}::DOUBLE)" for v in origin)
    x, y, z = _ecef_sql(lat, lon, alt)
    x0, y0, z0 = _ecef_sql(lat0, lon0, alt0)
    dx, dy, dz = f"({x} - {x0})", f"({y} - {y0})", f"({z} - {z0})"
    sl, cl, so, co = (f"{fn}(radians({v}))" for fn, v in (("sin", lat0), ("cos", lat0), ("sin", lon0), ("cos", lon0)))
    return (
        f"(-{sl} * {co} * {dx} - {sl} * {so} * {dy} + {cl} * {dz})",
        f"(-{so} * {dx} + {co} * {dy})",
        f"(-({cl} * {co} * {dx} + {cl} * {so} * {dy} + {sl} * {dz}))",
    )


_G = _ned_sql("lat", "lon", "alt", numeric.GLIDESLOPE_ORIGIN)
_L = _ned_sql("lat", "lon", "alt", numeric.LOCALIZER_ORIGIN)
_S = _ned_sql("(42.4976::DOUBLE)", "(-71.5843::DOUBLE)", "(37.4::DOUBLE)", numeric.LOCALIZER_ORIGIN)
NED = f"""ned AS (SELECT *, {_G[0]} AS gn, {_G[1]} AS ge, {_G[2]} AS gd, {_L[0]} AS ln, {_L[1]} AS le, {_S[0]} AS sn, {_S[1]} AS se FROM flight)"""
ERRORS = f"""{NED}, errs AS (SELECT *,
  CASE WHEN lon > -71.26841::DOUBLE THEN 3.0 ELSE greatest(-3.0::DOUBLE, least(3.0::DOUBLE, -3 * (degrees(asin(gd / sqrt(gn * gn + ge * ge + gd * gd))) + 3))) END AS glideslope_error,
  CASE WHEN lon > -71.26841::DOUBLE THEN 3.0 ELSE greatest(-3.0::DOUBLE, least(3.0::DOUBLE, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
    (ln * sn + le * se) / (sqrt(ln * ln + le * le) * sqrt(sn * sn + se * se)))))) * sign(loc))) END AS localizer_error,
  greatest(-3.0::DOUBLE, least(3.0::DOUBLE, (kias - 115) / 10)) AS airspeed_error FROM ned)"""


@query("f16_geodetic_ned", f"""
WITH {SAMPLES}, {FLIGHT}, {NED} SELECT event_id, round(gn, 4) + 0.0 AS north, round(ge, 4) + 0.0 AS east, round(gd, 4) + 0.0 AS down FROM ned""")
def f16(spark, sf):
    n = flight(spark, sf).select(
        "event_id", numeric.geodetic_ned(F.col("lat"), F.col("lon"), F.col("alt"), numeric.GLIDESLOPE_ORIGIN).alias("n")
    )
    return n.select("event_id", *[r(f"n.{c}", 4).alias(c) for c in ("north", "east", "down")])


def flight_errors(spark, sf):
    f = flight(spark, sf)
    e = numeric.approach_errors(F.col("lat"), F.col("lon"), F.col("alt"), F.col("loc"), F.col("kias"))
    return f.withColumn("_e", e).select("*", "_e.*").drop("_e")


@query("f17_approach_errors", f"""
WITH {SAMPLES}, {FLIGHT}, {ERRORS} SELECT event_id, round(glideslope_error, 5) + 0.0 AS glideslope_error,
  round(localizer_error, 5) + 0.0 AS localizer_error, round(airspeed_error, 5) + 0.0 AS airspeed_error FROM errs""")
def f17(spark, sf):
    e = flight_errors(spark, sf)
    return e.select("event_id", *[r(c, 5).alias(c) for c in ("glideslope_error", "localizer_error", "airspeed_error")])


INTERVAL = """nx AS (SELECT *, lead(kias) OVER (PARTITION BY run_key ORDER BY t, event_id) AS nk FROM errs),
span AS (SELECT run_key, min(CASE WHEN nk <> kias THEN t END) AS t_from, max(CASE WHEN alt - 37.4::DOUBLE > 85 THEN t END) AS t_to FROM nx GROUP BY run_key),
scored AS (SELECT nx.* FROM nx JOIN span ON nx.run_key = span.run_key WHERE t >= t_from AND t <= t_to)"""


def scored(spark, sf):
    e = flight_errors(spark, sf)
    return streams.scored_interval(e, ["run_key"], ["t", "event_id"], "kias", F.col("alt") - 37.4 > 85)


@query("f18_scored_interval", f"WITH {SAMPLES}, {FLIGHT}, {ERRORS}, {INTERVAL} SELECT event_id, run_key FROM scored")
def f18(spark, sf):
    return scored(spark, sf).select("event_id", "run_key")


@query("f19_row_mean", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS y,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_tax END AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((x + coalesce(y, 0) + coalesce(z, 0)) / (1 + CAST(y IS NOT NULL AS INTEGER) + CAST(z IS NOT NULL AS INTEGER)), 8) AS row_mean FROM a""")
def f19(spark, sf):
    li = table(spark, sf, "lineitem")
    y = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount"))
    z = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(numeric.row_mean([F.col("l_quantity"), y, z])).alias("row_mean"))


@query("f20_bound_and_round", f"""
WITH {PREDICTIONS}
SELECT model, seed, count(*) AS n, sum(CAST(abs(y_pred_raw - y_pred_bounded) > 1e-12 AS BIGINT))::BIGINT AS clip_count,
  round(avg(CAST(abs(y_pred_raw - y_pred_bounded) > 1e-12 AS DOUBLE)), 8) AS clip_rate,
  sum(greatest(0, least(3, CAST(round_even(y_pred_bounded, 0) AS INTEGER) - 1)))::BIGINT AS rounded_sum FROM predictions GROUP BY model, seed""")
def f20(spark, sf):
    p = predictions(spark, sf)
    clipped = (F.abs(F.col("y_pred_raw") - F.col("y_pred_bounded")) > 1e-12)
    return p.groupBy("model", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.sum(clipped.cast("long")).alias("clip_count"),
        r(F.avg(clipped.cast("double"))).alias("clip_rate"),
        F.sum(numeric.rounded_class(F.col("y_pred_bounded")).cast("long")).alias("rounded_sum"),
    )


SOFTMAX_SQL = "list_sum(list_transform(scores, lambda s, i: exp((s - list_max(scores)) / {t}) * i)) / list_sum(list_transform(scores, lambda s: exp((s - list_max(scores)) / {t})))"


@query("f21_softmax_expectation", f"""
WITH {PREDICTIONS}
SELECT event_id, seed, model, round({SOFTMAX_SQL.format(t='0.25::DOUBLE')}, 8) AS expected_level FROM predictions""")
def f21(spark, sf):
    return predictions(spark, sf).select(
        "event_id", "seed", "model", r(numeric.softmax_expectation(F.col("scores"), 0.25)).alias("expected_level")
    )


@query("f22_argmax_margin", f"""
WITH {PREDICTIONS}
SELECT event_id, seed, model, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS top, round(list_max(scores), 8) + 0.0 AS confidence,
  round(list_reverse_sort(scores)[1] - list_reverse_sort(scores)[2], 8) + 0.0 AS margin FROM predictions""")
def f22(spark, sf):
    s = F.col("scores")
    return predictions(spark, sf).select(
        "event_id", "seed", "model", numeric.argmax_low(s).alias("top"), r(F.array_max(s)).alias("confidence"), r(numeric.margin(s)).alias("margin")
    )


@query("f23_canonical_json", """
SELECT p_partkey, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}' AS doc, p_size AS parsed_size, p_brand AS parsed_brand FROM part""")
def f23(spark, sf):
    p = table(spark, sf, "part").withColumn("doc", names.canonical_json(["p_size", "p_brand", "p_name"]))
    back = F.from_json("doc", "p_brand string, p_size int")
    return p.select("p_partkey", "doc", back["p_size"].alias("parsed_size"), back["p_brand"].alias("parsed_brand"))


@query("f24_set_digest", """
SELECT p_brand, count(DISTINCT p_name) AS members, sha256(string_agg(DISTINCT p_name, chr(10) ORDER BY p_name) || chr(10)) AS digest FROM part GROUP BY p_brand""")
def f24(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("s"))
    return p.select("p_brand", F.size("s").cast("long").alias("members"), names.set_digest(F.col("s")).alias("digest"))


_SUF = sorted(names.STATISTIC_SUFFIXES, key=len, reverse=True)
_SUF_SQL = "^(.*?)_(" + "|".join(_SUF) + ")$"


@query("f25_split_statistic", f"""
WITH n AS (SELECT p_partkey, {_clean_sql('p_name')} || '_' || {names.STATISTIC_SUFFIXES!r}[p_partkey % {len(_SUF)} + 1] AS feature FROM part)
SELECT p_partkey, regexp_extract(feature, '{_SUF_SQL}', 1) AS base_variable, regexp_extract(feature, '{_SUF_SQL}', 2) AS statistic FROM n""")
def f25(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(s) for s in names.STATISTIC_SUFFIXES]), (F.col("p_partkey") % len(_SUF) + 1).cast("int"))
    feature = F.concat(names.clean_name(F.col("p_name")), F.lit("_"), suffix)
    p = table(spark, sf, "part").select("p_partkey", names.split_statistic(feature).alias("s"))
    return p.select("p_partkey", "s.base_variable", "s.statistic")


@query("f26_anonymize", """
SELECT printf('DEMO-%04d', row_number() OVER (ORDER BY o_custkey, o_orderkey)) AS demo_id, o_orderstatus, o_totalprice FROM orders""")
def f26(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return streams.anonymize(o, ["o_custkey", "o_orderkey"], ["o_custkey", "o_orderkey"])
