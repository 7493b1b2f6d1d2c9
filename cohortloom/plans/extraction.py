"""From files of unlike layouts to the long feature table."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortloom import session
from cohortloom.operators import extraction
from cohortloom.sources import raw

from .inputs import SAMPLES, r, samples
from .registry import query
from .signals import _stats_sql

#: Device in the file name, time column and unit, and the other columns of each event type's files.
LAYOUTS = {
    "view": ("lslhtcviveeye", "Time", 100.0, ["Gaze X", "gaze_x", "fixationseq", "note"]),
    "click": ("resp", "time_s", 1.0, ["resp_mv", "level"]),
    "purchase": ("emg", None, 1.0, ["emg_a", "emg_b"]),
    "signup": ("headpose", "elapsed_time", 100.0, ["head_roll", "grip"]),
    "error": ("lslxp11", "timestamp", None, ["aircraft_airspeed", "aircraft_pitch", "yaw"]),
}
START = 1704067200.0  # 2024-01-01, first day of the events


def _stream_files(spark, sf) -> str:
    """The events as CSV files, one folder per run, with a layout per event type; some cells hold text."""
    root = f"{session.checkpoint_dir(spark)}/raw-{uuid.uuid4().hex}"
    value, k, e = F.col("value"), F.col("k"), F.col("event_id")
    made = {
        "Gaze X": value * 0.5, "gaze_x": k, "fixationseq": k % 12 - 1, "note": F.lit("a, \"b\""), "resp_mv": value, "level": k,
        "emg_a": value, "emg_b": F.when(e % 5 != 0, k), "head_roll": value, "grip": k, "aircraft_airspeed": value, "aircraft_pitch": k, "yaw": value - k,
    }
    s = samples(spark, sf)
    for stream, (device, time, unit, columns) in LAYOUTS.items():
        name = F.format_string(f"sub-cp%03d_ses-20240101_level-01B_run-001_stream-{device}_dat", F.col("subject") % 6)
        t = F.col("t") if unit is None else (F.col("t") - START) / unit
        if stream == "click":
            t = F.when(e % 23 != 0, t)
        cells = [made[c].cast("string").alias(c) for c in columns]
        bad = F.when(e % 19 == 0, "n/a")
        cells[0] = F.coalesce(bad, made[columns[0]].cast("string")).alias(columns[0])
        rows = s.where(F.col("stream") == stream).select(name.alias("run"), F.col("t").alias("_t"), "event_id", *([t.alias(time)] if time else []), *cells)
        dealt = rows.repartition("run").sortWithinPartitions("run", "_t", "event_id").drop("_t", "event_id")
        dealt.write.partitionBy("run").option("header", "true").csv(f"{root}/{stream}")
    return root


def _name():
    return F.concat(F.regexp_extract("path", "run=([^/]+)", 1), F.lit(".csv"))


FILES = """base AS (SELECT stream, event_id, value, k, t, 'sub-cp' || lpad(CAST(subject % 6 AS VARCHAR), 3, '0') AS subject_id FROM samples),
placed AS (SELECT *, row_number() OVER (PARTITION BY stream, subject_id ORDER BY t, event_id) - 1 AS i,
  CASE stream WHEN 'view' THEN (t - 1704067200) / 100 WHEN 'click' THEN CASE WHEN event_id % 23 <> 0 THEN t - 1704067200 END
    WHEN 'signup' THEN (t - 1704067200) / 100 WHEN 'error' THEN t END AS raw FROM base),
steps AS (SELECT stream, subject_id, raw, raw - lag(raw) OVER (PARTITION BY stream, subject_id ORDER BY raw, i) AS d FROM placed WHERE raw IS NOT NULL),
clock AS (SELECT stream, subject_id, count(*) AS n, min(raw) AS t0, max(raw) - min(raw) AS span,
  CASE WHEN min(raw) > 100000 THEN 86400.0::DOUBLE WHEN median(d) > 1000 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM steps GROUP BY ALL),
bases AS (SELECT stream, subject_id, n, scale, CASE WHEN n >= 2 AND span > 0 THEN span * scale END AS dur,
  CASE WHEN n >= 2 AND span > 0 THEN (n - 1) / (span * scale) END AS fs FROM clock),
ok AS (SELECT *, CASE WHEN event_id % 19 <> 0 THEN 1 END AS one FROM placed),
long AS (
  SELECT stream, subject_id, i AS t, raw, 'eye_lslhtcviveeye_gaze_x' AS stem, 'Gaze X' AS src, value * 0.5::DOUBLE * one AS v FROM ok WHERE stream = 'view'
  UNION ALL SELECT stream, subject_id, i, raw, 'eye_lslhtcviveeye_gaze_x', 'gaze_x', k FROM ok WHERE stream = 'view'
  UNION ALL SELECT stream, subject_id, i, raw, 'eye_lslhtcviveeye_fixationseq', 'fixationseq', k % 12 - 1 FROM ok WHERE stream = 'view'
  UNION ALL SELECT stream, subject_id, i, raw, 'eye_gaze', 'derived', CASE WHEN one = 1 THEN (value * 0.5::DOUBLE + k) / 2 ELSE k END FROM ok WHERE stream = 'view'
  UNION ALL SELECT stream, subject_id, i, raw, 'resp_resp_resp_mv', 'resp_mv', value * one FROM ok WHERE stream = 'click'
  UNION ALL SELECT stream, subject_id, i, raw, 'resp_resp_level', 'level', k FROM ok WHERE stream = 'click'
  UNION ALL SELECT stream, subject_id, i, raw, 'resp_signal', 'derived', value * one FROM ok WHERE stream = 'click'
  UNION ALL SELECT stream, subject_id, i, raw, 'emg_emg_emg_a', 'emg_a', value * one FROM ok WHERE stream = 'purchase'
  UNION ALL SELECT stream, subject_id, i, raw, 'emg_emg_emg_b', 'emg_b', CASE WHEN event_id % 5 <> 0 THEN k END FROM ok WHERE stream = 'purchase'
  UNION ALL SELECT stream, subject_id, i, raw, 'emg_signal', 'derived', CASE WHEN one = 1 AND event_id % 5 <> 0 THEN (value + k) / 2
    WHEN one = 1 THEN value WHEN event_id % 5 <> 0 THEN k END FROM ok WHERE stream = 'purchase'
  UNION ALL SELECT stream, subject_id, i, raw, 'head_headpose_head_roll', 'head_roll', value * one FROM ok WHERE stream = 'signup'
  UNION ALL SELECT stream, subject_id, i, raw, 'head_headpose_grip', 'grip', k FROM ok WHERE stream = 'signup'
  UNION ALL SELECT stream, subject_id, i, NULL, 'head_headpose_head_roll_first_difference', 'derived',
    value * one - lag(value * one) OVER (PARTITION BY subject_id ORDER BY i) FROM ok WHERE stream = 'signup'
  UNION ALL SELECT stream, subject_id, i, raw, 'xplane_lslxp11_aircraft_airspeed', 'aircraft_airspeed', value * one FROM ok WHERE stream = 'error'
  UNION ALL SELECT stream, subject_id, i, raw, 'xplane_lslxp11_aircraft_pitch', 'aircraft_pitch', k FROM ok WHERE stream = 'error'
  UNION ALL SELECT stream, subject_id, i, raw, 'xplane_lslxp11_yaw', 'yaw', value - k FROM ok WHERE stream = 'error'
  UNION ALL SELECT stream, subject_id, i, raw, 'xplane_airspeed', 'derived', value * one FROM ok WHERE stream = 'error'
  UNION ALL SELECT stream, subject_id, i, raw, 'xplane_heading', 'derived', value - k FROM ok WHERE stream = 'error'
  UNION ALL SELECT stream, subject_id, i, raw, 'xplane_attitude', 'derived', (CAST(k AS DOUBLE) + (value - k)) / 2 FROM ok WHERE stream = 'error')"""

_PARTS = "stream, subject_id, stem, src"

FEATURES = f"""ends AS (SELECT {_PARTS}, max_by(v, t) FILTER (WHERE v IS NOT NULL) - min_by(v, t) FILTER (WHERE v IS NOT NULL) AS dv,
  max_by(raw, t) FILTER (WHERE v IS NOT NULL) - min_by(raw, t) FILTER (WHERE v IS NOT NULL) AS dt,
  max(CASE WHEN v IS NOT NULL THEN t END) - min(CASE WHEN v IS NOT NULL THEN t END) AS di, bool_and(raw IS NOT NULL) AS timed FROM long GROUP BY {_PARTS}),
slopes AS (SELECT e.*, CASE WHEN timed AND dur IS NOT NULL THEN dt * scale ELSE coalesce(dur, CAST(di AS DOUBLE)) END AS dx FROM ends e LEFT JOIN bases b USING (stream, subject_id)),
stats AS ({_stats_sql("long", _PARTS, "v")}),
fixed AS (SELECT * REPLACE (CASE WHEN di > 0 AND dx > 0 THEN round(dv / dx, 10) + 0.0 END AS slope) FROM stats JOIN slopes USING ({_PARTS})),
peaked AS (SELECT subject_id, t AS i, v, lag(v) OVER (PARTITION BY subject_id ORDER BY t) AS p FROM long WHERE stem = 'resp_signal' AND v IS NOT NULL),
turns AS (SELECT *, lead(v) OVER (PARTITION BY subject_id ORDER BY i) AS q FROM peaked WHERE p IS NULL OR p <> v),
tops AS (SELECT subject_id, i, v FROM turns WHERE v > p AND v > q),
walls AS (SELECT a.subject_id, a.i, a.v, max(CASE WHEN b.i < a.i AND b.v > a.v THEN b.i END) AS lw, min(CASE WHEN b.i > a.i AND b.v > a.v THEN b.i END) AS rw
  FROM tops a JOIN peaked b USING (subject_id) GROUP BY a.subject_id, a.i, a.v),
prom AS (SELECT w.subject_id, w.i, w.v - greatest(min(CASE WHEN b.i <= w.i THEN b.v END), min(CASE WHEN b.i >= w.i THEN b.v END)) AS prominence
  FROM walls w JOIN peaked b ON w.subject_id = b.subject_id AND b.i > coalesce(w.lw, -1) AND b.i < coalesce(w.rw, 1000000000) GROUP BY w.subject_id, w.i, w.v),
spread AS (SELECT subject_id, greatest(0.25 * stddev_pop(v), 1e-12) AS thr FROM peaked GROUP BY subject_id),
peaks AS (SELECT s.subject_id, CAST(count(CASE WHEN prominence >= thr THEN 1 END) AS DOUBLE) AS n FROM spread s LEFT JOIN prom USING (subject_id) GROUP BY s.subject_id),
breath AS (SELECT subject_id, peaks.n, peaks.n / dur AS rate FROM peaks JOIN bases USING (subject_id) WHERE stream = 'click'),
muscle AS (SELECT subject_id, t, v, v < avg(v) OVER (PARTITION BY subject_id) AS neg FROM long WHERE stem = 'emg_signal' AND v IS NOT NULL),
crossed AS (SELECT *, lag(neg) OVER (PARTITION BY subject_id ORDER BY t) AS was FROM muscle),
emg AS (SELECT subject_id, avg(abs(v)) AS mav, var_samp(v) AS variance, avg(CAST(neg <> was AS DOUBLE)) AS zcr FROM crossed GROUP BY subject_id),
seen AS (SELECT subject_id, CAST(count(DISTINCT k % 12 - 1) FILTER (WHERE k % 12 >= 1) AS DOUBLE) AS n FROM placed WHERE stream = 'view' GROUP BY subject_id),
flat AS (SELECT * FROM (SELECT stream, subject_id, stem, src, mean, std, min, max, median, iqr, skew, kurtosis, range, rms, slope, num_missing, missing_ratio FROM fixed WHERE mean IS NOT NULL)
  UNPIVOT INCLUDE NULLS (feature_value FOR stat IN (mean, std, min, max, median, iqr, skew, kurtosis, range, rms, slope, num_missing, missing_ratio))),
out AS (
  SELECT stream, subject_id, stem || '_' || stat || CASE WHEN src = 'gaze_x' THEN '__dup2' ELSE '' END AS feature_name, feature_value, src AS source_column,
    CASE WHEN src = 'derived' THEN src ELSE stat END AS statistic FROM flat
  UNION ALL SELECT 'click', subject_id, 'resp_signal_peak_count', n, 'derived', 'derived' FROM breath
  UNION ALL SELECT 'click', subject_id, 'resp_signal_peak_rate', round(rate, 8), 'derived', 'derived' FROM breath
  UNION ALL SELECT 'click', subject_id, 'resp_approximate_respiration_rate', round(rate, 8), 'derived', 'derived' FROM breath
  UNION ALL SELECT 'purchase', subject_id, 'emg_signal_mav', round(mav, 8), 'derived', 'derived' FROM emg
  UNION ALL SELECT 'purchase', subject_id, 'emg_signal_variance', round(variance, 8), 'derived', 'derived' FROM emg
  UNION ALL SELECT 'purchase', subject_id, 'emg_signal_zero_crossing_rate', round(zcr, 8), 'derived', 'derived' FROM emg
  UNION ALL SELECT 'view', subject_id, 'eye_lslhtcviveeye_fixation_event_count', n, 'derived', 'derived' FROM seen
  UNION ALL SELECT 'view', subject_id, 'eye_lslhtcviveeye_fixation_event_rate', round(s.n / dur, 8), 'derived', 'derived' FROM seen s JOIN bases USING (subject_id) WHERE stream = 'view'
  UNION ALL SELECT b.stream, subject_id, prefix || '_duration', round(dur, 3), col, 'duration' FROM bases b JOIN clocks c USING (stream)
  UNION ALL SELECT b.stream, subject_id, prefix || '_sampling_rate_estimate', round(fs, 8), col, 'sampling_rate_estimate' FROM bases b JOIN clocks c USING (stream)
  UNION ALL SELECT p.stream, subject_id, any_value(prefix) || '_sample_count', CAST(count(*) AS DOUBLE), any_value(col), 'sample_count' FROM placed p JOIN clocks c USING (stream) GROUP BY p.stream, subject_id)"""

CLOCKS = """clocks AS (SELECT * FROM (VALUES ('view', 'eye_lslhtcviveeye', 'Time'), ('click', 'resp_resp', 'time_s'),
  ('signup', 'head_headpose', 'elapsed_time'), ('error', 'xplane_lslxp11', 'timestamp')) c(stream, prefix, col))"""
KINDS = """kinds AS (SELECT * FROM (VALUES ('view', 'eye_tracking', 'eye_tracking_features', 4), ('click', 'respiration', 'physiological_features', 2),
  ('purchase', 'emg', 'physiological_features', 2), ('signup', 'head_movement', 'head_movement_features', 2), ('error', 'xplane', 'flight_parameter_features', 3)) k(stream, modality, feature_group, columns))"""


@query("g04_files_to_features", f"""
WITH {SAMPLES}, {FILES}, {CLOCKS}, {KINDS}, {FEATURES}
SELECT subject_id || '_ses-20240101_level-01B_run-001' AS run_key, modality, feature_group, feature_name, feature_value + 0.0 AS feature_value, source_column, statistic
FROM out JOIN kinds USING (stream)""")
def g04_files(spark, sf):
    _, found = extraction.features(spark, _stream_files(spark, sf), name=_name())
    digits = {"skew": 6, "kurtosis": 6, "slope": 10, "duration": 3}
    stat = F.regexp_replace("feature_name", "__dup[0-9]+$", "")
    value = r("feature_value")
    for name, n in digits.items():
        value = F.when(stat.endswith(f"_{name}"), r("feature_value", n)).otherwise(value)
    return found.select("run_key", "modality", "feature_group", "feature_name", value.alias("feature_value"), "source_column", "statistic")


@query("a01_discovered_files", f"""
WITH {SAMPLES}, {KINDS}, placed AS (SELECT stream, 'sub-cp' || lpad(CAST(subject % 6 AS VARCHAR), 3, '0') AS subject_id FROM samples)
SELECT subject_id, 'ses-20240101' AS session_id, 'run-001' AS run_id, 'level-01B' AS difficulty_level, modality, count(*) AS row_count,
  CAST(any_value(columns) AS INTEGER) AS columns, CASE stream WHEN 'view' THEN 'Time' WHEN 'click' THEN 'time_s' WHEN 'signup' THEN 'elapsed_time' WHEN 'error' THEN 'timestamp' END AS time_column
FROM placed JOIN kinds USING (stream) GROUP BY stream, subject_id, modality""")
def a01_files(spark, sf):
    lines = raw.lines(spark, _stream_files(spark, sf))
    files = extraction.describe(raw.layouts(lines), _name()).where("before = 0 AND reason IS NULL")
    timed = F.get("names", F.col("time_at"))
    columns = F.size("names") - F.when(F.col("time_at").isNotNull(), 1).otherwise(0)
    return files.select("subject_id", "session_id", "run_id", "difficulty_level", "modality", F.col("rows").alias("row_count"), columns.alias("columns"), timed.alias("time_column"))


@query("a01_cells_by_name", f"""
WITH {SAMPLES} SELECT 'sub-cp' || lpad(CAST(subject % 6 AS VARCHAR), 3, '0') AS subject_id, c AS "column", count(*) AS rows,
  count(CASE c WHEN 'yaw' THEN value - k WHEN 'note' THEN NULL WHEN 'emg_b' THEN CASE WHEN event_id % 5 <> 0 THEN k END
    WHEN 'gaze_x' THEN k WHEN 'fixationseq' THEN k WHEN 'level' THEN k WHEN 'grip' THEN k WHEN 'aircraft_pitch' THEN k ELSE CASE WHEN event_id % 19 <> 0 THEN value END END) AS numbers,
  round(sum(CASE c WHEN 'yaw' THEN value - k WHEN 'note' THEN NULL WHEN 'emg_b' THEN CASE WHEN event_id % 5 <> 0 THEN k END
    WHEN 'fixationseq' THEN k % 12 - 1 WHEN 'gaze_x' THEN k WHEN 'level' THEN k WHEN 'grip' THEN k WHEN 'aircraft_pitch' THEN k
    WHEN 'Gaze X' THEN CASE WHEN event_id % 19 <> 0 THEN value * 0.5::DOUBLE END ELSE CASE WHEN event_id % 19 <> 0 THEN value END END), 4) + 0.0 AS total
FROM samples JOIN (SELECT 'view' AS stream, unnest(['Gaze X', 'gaze_x', 'fixationseq', 'note']) AS c UNION ALL SELECT 'click', unnest(['resp_mv', 'level'])
  UNION ALL SELECT 'purchase', unnest(['emg_a', 'emg_b']) UNION ALL SELECT 'signup', unnest(['head_roll', 'grip'])
  UNION ALL SELECT 'error', unnest(['aircraft_airspeed', 'aircraft_pitch', 'yaw'])) l USING (stream) GROUP BY 1, c""")
def a01_cells(spark, sf):
    lines = raw.lines(spark, _stream_files(spark, sf))
    files = extraction.describe(raw.layouts(lines), _name())
    cells = raw.numbers(lines, files).select("subject_id", "names", "time_at", F.posexplode("cells").alias("place", "value"))
    signals = cells.where("time_at IS NULL OR place <> time_at").select("subject_id", F.get("names", F.col("place")).alias("column"), "value")
    return signals.groupBy("subject_id", "column").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("numbers"), r(F.sum("value"), 4).alias("total"))
