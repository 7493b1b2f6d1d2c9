"""Signal features over ordered samples."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.special import t_quantile
from cohortloom.operators import ordered, signal

from .inputs import SAMPLES, r, samples
from .registry import query
from .scalars import ERRORS, FLIGHT, INTERVAL, scored

RUN = ["subject", "stream"]


def _stats_sql(src: str, keys: str, v: str, span: str = "finite") -> str:
    dt = f"(max(CASE WHEN {v} IS NOT NULL THEN t END) - min(CASE WHEN {v} IS NOT NULL THEN t END))" if span == "finite" else "(max(t) - min(t))"
    diff = f"(max_by({v}, t) FILTER (WHERE {v} IS NOT NULL) - min_by({v}, t) FILTER (WHERE {v} IS NOT NULL))"
    return f"""SELECT {keys}, round(avg({v}), 8) + 0.0 AS mean,
  round(CASE WHEN count({v}) = 1 THEN 0 ELSE stddev_samp({v}) END, 8) + 0.0 AS std, round(min({v}), 8) + 0.0 AS min, round(max({v}), 8) + 0.0 AS max,
  round(quantile_cont({v}, 0.5), 8) + 0.0 AS median, round(quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25), 8) + 0.0 AS iqr,
  CASE WHEN count({v}) >= 3 AND stddev_samp({v}) > 0 THEN round(skewness({v}), 6) + 0.0 END AS skew,
  CASE WHEN count({v}) >= 4 AND stddev_samp({v}) > 0 THEN round(kurtosis({v}), 6) + 0.0 END AS kurtosis,
  round(max({v}) - min({v}), 8) + 0.0 AS range, round(sqrt(avg({v} * {v})), 8) + 0.0 AS rms,
  CASE WHEN count({v}) >= 2 AND {dt} > 0 THEN round({diff} / {dt}, 10) + 0.0 END AS slope,
  CAST(count(*) - count({v}) AS DOUBLE) AS num_missing, round((count(*) - count({v})) / count(*), 8) AS missing_ratio
FROM {src} GROUP BY {keys}"""


def _rounded(df, keys):
    digits = {"skew": 6, "kurtosis": 6, "slope": 10}
    return df.select(*keys, *[r(c, digits.get(c, 8)).alias(c) for c in signal.STATISTICS])


GAPPY = "gaps AS (SELECT *, CASE WHEN event_id % 17 <> 0 THEN value END AS x FROM samples)"


def gaps(spark, sf):
    return samples(spark, sf).withColumn("x", F.when(F.col("event_id") % 17 != 0, F.col("value")))


@query("g01_signal_summary", f"WITH {SAMPLES}, {GAPPY} {_stats_sql('gaps', 'subject, stream', 'x')}")
def g01(spark, sf):
    return _rounded(signal.summarize(gaps(spark, sf), RUN, "x", "t", "event_id"), RUN)


@query("g02_endpoint_slope", f"""
WITH {SAMPLES}, {GAPPY} SELECT subject, stream,
  CASE WHEN max(CASE WHEN x IS NOT NULL THEN t END) > min(CASE WHEN x IS NOT NULL THEN t END) THEN
  round((max_by(x, t) FILTER (WHERE x IS NOT NULL) - min_by(x, t) FILTER (WHERE x IS NOT NULL)) /
        (max(CASE WHEN x IS NOT NULL THEN t END) - min(CASE WHEN x IS NOT NULL THEN t END)), 10) + 0.0 END AS slope
FROM gaps GROUP BY subject, stream""")
def g02(spark, sf):
    return signal.endpoint_slope(gaps(spark, sf), RUN, "x", "t", "event_id").withColumn("slope", r("slope", 10))


@query("g03_stream_meta", f"""
WITH {SAMPLES} SELECT subject, stream, round(max(t) - min(t), 4) AS duration, round((count(*) - 1) / (max(t) - min(t)), 10) AS sampling_rate_estimate,
  count(*) AS sample_count FROM samples GROUP BY subject, stream""")
def g03(spark, sf):
    m = signal.stream_meta(samples(spark, sf), RUN, "t")
    return m.select(*RUN, r("duration", 4).alias("duration"), r("sampling_rate_estimate", 10).alias("sampling_rate_estimate"), "sample_count")


_STAT_COLS = ", ".join(signal.STATISTICS)


@query("g04_extract_features", f"""
WITH {SAMPLES}, long AS (SELECT subject, stream, t, event_id, 'value' AS source_column, value AS v FROM samples
  UNION ALL SELECT subject, stream, t, event_id, 'k', CAST(k AS DOUBLE) FROM samples),
s AS ({_stats_sql('long', 'subject, stream, source_column', 'v')})
SELECT subject, stream, source_column, statistic, feature_value, stream || '_' || source_column || '_' || statistic AS feature_name
FROM s UNPIVOT INCLUDE NULLS (feature_value FOR statistic IN ({_STAT_COLS}))""")
def g04(spark, sf):
    f = signal.extract_features(samples(spark, sf), RUN, ["value", "k"], "t", "event_id", F.col("stream"))
    digits = F.when(F.col("statistic") == "slope", r("feature_value", 10)).when(
        F.col("statistic").isin("skew", "kurtosis"), r("feature_value", 6)
    ).otherwise(r("feature_value"))
    return f.select(*RUN, "source_column", "statistic", digits.alias("feature_value"), "feature_name")


@query("g05_composite_signals", f"""
WITH {SAMPLES}, long AS (
  SELECT subject, t, event_id, 'gaze' AS signal, (value * 0.5::DOUBLE + k) / 2 AS v FROM samples UNION ALL
  SELECT subject, t, event_id, 'pupil', CASE WHEN event_id % 5 = 0 THEN value / 100 ELSE (value / 100 + k / 100.0::DOUBLE) / 2 END FROM samples UNION ALL
  SELECT subject, t, event_id, 'airspeed', CASE WHEN event_id % 5 <> 0 THEN k / 100.0::DOUBLE END FROM samples)
{_stats_sql('long', 'subject, signal', 'v')}""")
def g05(spark, sf):
    part = F.when(F.col("event_id") % 5 != 0, F.col("k") / 100.0)
    s = samples(spark, sf).select(
        "subject", "t", "event_id", (F.col("value") * 0.5).alias("gaze_direction_l_x"), F.col("k").alias("gaze_direction_r_x"),
        (F.col("value") / 100).alias("pupil_diameter_l_mm"), part.alias("pupil_diameter_r_mm"), part.alias("aircraft_indicated_airspeed_kias"),
    )
    ids = ["subject", "t", "event_id"]
    long = signal.composite_signals(s, ids, [c for c in s.columns if c not in ids])
    return _rounded(signal.summarize(long, ["subject", "signal"], "value", "t", "event_id"), ["subject", "signal"])


@query("g06_strict_maxima", f"""
WITH {SAMPLES}, n AS (SELECT subject, value, lag(value) OVER w AS p, lead(value) OVER w AS q FROM samples WINDOW w AS (PARTITION BY subject ORDER BY t, event_id))
SELECT subject, sum(CAST(p IS NOT NULL AND q IS NOT NULL AND value > p AND value > q AS BIGINT))::BIGINT AS maxima FROM n GROUP BY subject""")
def g06_strict(spark, sf):
    s = samples(spark, sf)
    b = ordered.with_neighbors(s, ["subject"], ["t", "event_id"], {"p": "value"}, {"q": "value"})
    top = F.coalesce((F.col("value") > F.col("p")) & (F.col("value") > F.col("q")), F.lit(False))
    return b.groupBy("subject").agg(F.sum(top.cast("long")).alias("maxima"))


PEAKS = """rows0 AS (SELECT subject, value, row_number() OVER (PARTITION BY subject ORDER BY t, event_id) AS i,
    lag(value) OVER (PARTITION BY subject ORDER BY t, event_id) AS p FROM samples),
turns AS (SELECT *, lead(value) OVER (PARTITION BY subject ORDER BY i) AS q FROM rows0 WHERE p IS NULL OR p <> value),
tops AS (SELECT subject, i, value FROM turns WHERE value > p AND value > q),
walls AS (SELECT a.subject, a.i, a.value, max(CASE WHEN b.i < a.i AND b.value > a.value THEN b.i END) AS lw,
    min(CASE WHEN b.i > a.i AND b.value > a.value THEN b.i END) AS rw
  FROM tops a JOIN rows0 b ON a.subject = b.subject GROUP BY a.subject, a.i, a.value),
prom AS (SELECT w.subject, w.i, w.value - greatest(min(CASE WHEN b.i <= w.i THEN b.value END), min(CASE WHEN b.i >= w.i THEN b.value END)) AS prominence
  FROM walls w JOIN rows0 b ON w.subject = b.subject AND b.i > coalesce(w.lw, 0) AND b.i < coalesce(w.rw, 1000000000) GROUP BY w.subject, w.i, w.value),
spread AS (SELECT subject, greatest(0.25 * stddev_pop(value), 1e-12) AS thr, max(t) - min(t) AS dur FROM samples GROUP BY subject),
peaks AS (SELECT s.subject, count(CASE WHEN prominence >= thr THEN 1 END) AS peak_count, any_value(dur) AS dur
  FROM spread s LEFT JOIN prom ON s.subject = prom.subject GROUP BY s.subject)"""


@query("g06_peak_count", f"WITH {SAMPLES}, {PEAKS} SELECT subject, peak_count FROM peaks")
def g06(spark, sf):
    return signal.peak_counts(samples(spark, sf), ["subject"], ["t", "event_id"], "value")


@query("g11_respiration_rate", f"WITH {SAMPLES}, {PEAKS} SELECT subject, round(peak_count / dur, 10) AS respiration_rate FROM peaks")
def g11(spark, sf):
    s = samples(spark, sf)
    peaks = signal.peak_counts(s, ["subject"], ["t", "event_id"], "value")
    j = ordered.key_join(peaks, signal.stream_meta(s, ["subject"], "t"), ["subject"])
    return j.select("subject", r(F.try_divide("peak_count", "duration"), 10).alias("respiration_rate"))


@query("g07_zero_crossing_rate", f"""
WITH {SAMPLES}, m AS (SELECT subject, t, event_id, value < avg(value) OVER (PARTITION BY subject) AS neg FROM samples),
d AS (SELECT subject, neg, lag(neg) OVER (PARTITION BY subject ORDER BY t, event_id) AS p FROM m)
SELECT subject, round(avg(CAST(neg <> p AS DOUBLE)), 8) AS zero_crossing_rate FROM d GROUP BY subject""")
def g07(spark, sf):
    z = signal.zero_crossing_rate(samples(spark, sf), ["subject"], ["t", "event_id"], "value")
    return z.select("subject", r("zero_crossing_rate").alias("zero_crossing_rate"))


@query("g08_abs_mean_variance", f"""
WITH {SAMPLES} SELECT subject, stream, round(avg(abs(value - 50)), 8) AS mav, round(var_samp(value - 50), 6) AS variance FROM samples GROUP BY subject, stream""")
def g08(spark, sf):
    s = samples(spark, sf).withColumn("c", F.col("value") - 50)
    return signal.abs_mean_and_variance(s, RUN, "c").select(*RUN, r("mav").alias("mav"), r("variance", 6).alias("variance"))


@query("g09_event_rate", f"""
WITH {SAMPLES}, e AS (SELECT subject, t, CASE WHEN k % 9 = 0 THEN -1 ELSE k // 10 END AS ev FROM samples)
SELECT subject, count(DISTINCT CASE WHEN ev >= 0 THEN ev END) AS event_count,
  round(count(DISTINCT CASE WHEN ev >= 0 THEN ev END) / (max(t) - min(t)), 10) AS event_rate FROM e GROUP BY subject""")
def g09(spark, sf):
    ev = F.when(F.col("k") % 9 == 0, -1).otherwise(F.floor(F.col("k") / 10))
    e = signal.event_rate(samples(spark, sf).withColumn("ev", ev), ["subject"], "t", "ev")
    return e.select("subject", "event_count", r("event_rate", 10).alias("event_rate"))


@query("g10_first_difference", f"""
WITH {SAMPLES}, d AS (SELECT subject, stream, t, value - lag(value) OVER (PARTITION BY subject, stream ORDER BY t, event_id) AS x FROM samples)
{_stats_sql('d', 'subject, stream', 'x', 'run')}""")
def g10(spark, sf):
    d = signal.first_difference(samples(spark, sf), RUN, ["t", "event_id"], "value")
    return _rounded(signal.summarize(d, RUN, "value", "t", "event_id", span="run"), RUN)


@query("g12_fraction_below", f"WITH {SAMPLES} SELECT subject, round(avg(CAST(value / 100 <= 0.5 AS DOUBLE)), 8) AS fraction FROM samples GROUP BY subject")
def g12(spark, sf):
    s = samples(spark, sf).withColumn("open", F.col("value") / 100)
    return signal.fraction_below(s, ["subject"], "open", 0.5).select("subject", r("fraction").alias("fraction"))


def _pop_sql(v: str, prefix: str = "") -> str:
    g1 = f"skewness({v}) * (count({v}) - 2) / sqrt(count({v}) * (count({v}) - 1.0::DOUBLE))"
    return f"""round(avg({v}), 6) + 0.0 AS {prefix}mean, round(stddev_pop({v}), 6) + 0.0 AS {prefix}std,
  CASE WHEN stddev_pop({v}) > 0 AND count({v}) > 2 THEN round({g1}, 5) + 0.0 END AS {prefix}skew,
  CASE WHEN stddev_pop({v}) > 0 AND count({v}) > 2 THEN round(kurtosis_pop({v}), 5) + 0.0 END AS {prefix}kurtosis"""


def _pop(value: str, prefix: str = ""):
    m = signal.population_moments(value, prefix)
    enough = F.count(value) > 2
    return [
        r(m[0], 6).alias(f"{prefix}mean"), r(m[1], 6).alias(f"{prefix}std"),
        F.when(enough, r(m[2], 5)).alias(f"{prefix}skew"), F.when(enough, r(m[3], 5)).alias(f"{prefix}kurtosis"),
    ]


@query("g13_population_moments", f"WITH {SAMPLES} SELECT subject, {_pop_sql('value')} FROM samples GROUP BY subject")
def g13(spark, sf):
    return samples(spark, sf).groupBy("subject").agg(*_pop("value"))


WELCH = """num AS (SELECT stream, value, row_number() OVER (PARTITION BY stream ORDER BY t, event_id) - 1 AS i FROM samples),
shape AS (SELECT stream, count(*) AS n, least(256, count(*)) AS len, (count(*) - 1) / (max(t) - min(t)) AS fs FROM samples GROUP BY stream),
segs AS (SELECT stream, fs, len, len - len // 2 AS step, unnest(range((n - len) // (len - len // 2) + 1)) AS seg FROM shape),
parts AS (SELECT s.stream, s.seg, s.fs, s.len, i - s.seg * s.step AS j, value - avg(value) OVER (PARTITION BY s.stream, s.seg) AS x
  FROM segs s JOIN num ON num.stream = s.stream AND i >= s.seg * s.step AND i < s.seg * s.step + s.len),
wins AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * j / len)) AS xw, sum((0.5 - 0.5 * cos(2 * pi() * j / len)) ** 2) OVER (PARTITION BY stream, seg) AS sw FROM parts),
bins AS (SELECT stream, unnest(range(len // 2 + 1)) AS bin FROM shape),
power AS (SELECT w.stream, seg, bin, any_value(fs) AS fs, any_value(len) AS len,
  (sum(xw * cos(2 * pi() * ((bin * j) % len) / len)) ** 2 + sum(xw * sin(2 * pi() * ((bin * j) % len) / len)) ** 2) / (any_value(fs) * any_value(sw))
    * CASE WHEN bin = 0 OR bin * 2 = any_value(len) THEN 1 ELSE 2 END AS p
  FROM wins w JOIN bins b ON w.stream = b.stream GROUP BY w.stream, seg, bin),
psd AS (SELECT stream, bin, any_value(bin * fs / len) AS freq, avg(p) AS psd FROM power GROUP BY stream, bin),
spec AS (SELECT stream, max(psd) AS max_power, max_by(freq, psd) AS freq_of_max, sum(psd) AS total FROM psd GROUP BY stream)"""


def _psd(spark, sf):
    s = samples(spark, sf)
    fs = signal.stream_meta(s, ["stream"], "t").select("stream", F.col("sampling_rate_estimate").alias("fs"))
    return signal.welch_psd(s, ["stream"], ["t", "event_id"], "value", fs)


@query("g14_welch_features", f"""
WITH {SAMPLES}, {WELCH} SELECT stream, round(max_power / 1e6, 4) + 0.0 AS max_power_m, round(freq_of_max, 10) AS freq_of_max FROM spec""")
def g14(spark, sf):
    f = signal.spectral_features(_psd(spark, sf), ["stream"])
    return f.select("stream", r(F.col("max_power") / 1e6, 4).alias("max_power_m"), r("freq_of_max", 10).alias("freq_of_max"))


@query("w08_welch_segments", f"WITH {SAMPLES}, {WELCH} SELECT stream, bin, round(psd / 1e6, 4) + 0.0 AS psd_m FROM psd")
def w08(spark, sf):
    return _psd(spark, sf).select("stream", F.col("bin").cast("long").alias("bin"), r(F.col("psd") / 1e6, 4).alias("psd_m"))


@query("g15_spectral_entropy", f"""
WITH {SAMPLES}, {WELCH}
SELECT p.stream, round(-sum(psd / total * log2(psd)), 5) AS entropy, round(-sum(psd / total * log2(psd / total)), 5) AS entropy_normalized
FROM psd p JOIN spec s ON p.stream = s.stream GROUP BY p.stream""")
def g15(spark, sf):
    psd = _psd(spark, sf)
    raw = signal.spectral_features(psd, ["stream"]).select("stream", r("entropy", 5).alias("entropy"))
    norm = signal.spectral_features(psd, ["stream"], normalized=True).select("stream", r("entropy", 5).alias("entropy_normalized"))
    return ordered.key_join(raw, norm, ["stream"])


OCULO = """open0 AS (SELECT subject, t, event_id, CASE WHEN k % 11 = 0 THEN -1 ELSE k // 10 END AS ev, value AS x, CAST(k AS DOUBLE) AS y, sqrt(value) AS z,
    row_number() OVER (PARTITION BY subject ORDER BY t, event_id) AS rn, count(*) OVER (PARTITION BY subject) AS n FROM samples WHERE value / 10 > 0.5),
eye AS (SELECT * FROM open0 WHERE rn <= n - 2)"""


def _eye(spark, sf):
    s = samples(spark, sf).select(
        "subject", "t", "event_id", F.when(F.col("k") % 11 == 0, -1).otherwise(F.floor(F.col("k") / 10)).alias("ev"),
        F.col("value").alias("x"), F.col("k").cast("double").alias("y"), F.sqrt("value").alias("z"), (F.col("value") / 10).alias("openness"),
    )
    return signal.open_eye_samples(s, ["subject"], ["t", "event_id"], "openness")


@query("g16_fixation_durations", f"""
WITH {SAMPLES}, {OCULO}, d AS (SELECT subject, ev, max(t) - min(t) AS duration FROM eye WHERE ev >= 0 GROUP BY subject, ev)
SELECT subject, count(*) AS fixations, round(avg(duration), 3) AS mean, round(stddev_pop(duration), 3) AS std FROM d GROUP BY subject""")
def g16(spark, sf):
    d = signal.event_durations(_eye(spark, sf), ["subject"], "ev", "t")
    m = signal.population_moments("duration")
    return d.groupBy("subject").agg(F.count(F.lit(1)).alias("fixations"), r(m[0], 3).alias("mean"), r(m[1], 3).alias("std"))


@query("g17_fixation_dispersion", f"""
WITH {SAMPLES}, {OCULO}, d AS (SELECT subject, ev, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS dispersion FROM eye WHERE ev >= 0 GROUP BY subject, ev)
SELECT subject, {_pop_sql('dispersion')} FROM d GROUP BY subject""")
def g17(spark, sf):
    d = signal.event_dispersion(_eye(spark, sf), ["subject"], "ev", ["x", "y", "z"])
    return d.groupBy("subject").agg(*_pop("dispersion"))


SACCADES = """st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM eye WHERE ev >= 0
  WINDOW w AS (PARTITION BY subject, ev ORDER BY t, event_id)),
sac AS (SELECT subject, ev, max(t) - min(t) AS duration,
  sqrt((max_by(x, t) - min_by(x, t)) ** 2 + (max_by(y, t) - min_by(y, t)) ** 2 + (max_by(z, t) - min_by(z, t)) ** 2) AS amplitude,
  quantile_cont(sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2), 0.99) AS peak_velocity
  FROM st GROUP BY subject, ev HAVING count(*) >= 2)"""


def _saccades(spark, sf):
    return signal.saccade_metrics(_eye(spark, sf), ["subject"], "ev", ["t", "event_id"], "t", ["x", "y", "z"])


@query("g18_saccade_metrics", f"""
WITH {SAMPLES}, {OCULO}, {SACCADES} SELECT subject, ev, round(duration, 3) AS duration, round(amplitude, 6) AS amplitude, round(peak_velocity, 6) AS peak_velocity FROM sac""")
def g18(spark, sf):
    s = _saccades(spark, sf)
    return s.select("subject", "ev", r("duration", 3).alias("duration"), r("amplitude", 6).alias("amplitude"), r("peak_velocity", 6).alias("peak_velocity"))


@query("g19_main_sequence_fit", f"""
WITH {SAMPLES}, {OCULO}, {SACCADES}, y AS (SELECT subject, amplitude AS x, peak_velocity * duration AS y FROM sac),
f AS (SELECT subject, count(*) AS events, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM y GROUP BY subject)
SELECT subject, events, CASE WHEN events > 2 AND sxx > 0 THEN round(b / 1e6, 6) + 0.0 END AS slope_m,
  CASE WHEN events > 2 AND sxx > 0 THEN round(sqrt(greatest(0, syy - b * sxy) / (events - 2) / sxx) / 1e6, 6) END AS slope_se_m FROM f""")
def g19(spark, sf):
    f = signal.main_sequence_fit(_saccades(spark, sf), ["subject"])
    return f.select("subject", "events", r(F.col("slope") / 1e6, 6).alias("slope_m"), r(F.col("slope_se") / 1e6, 6).alias("slope_se_m"))


@query("g19_main_sequence_interval")
def g19_ci(spark, sf):
    f = signal.main_sequence_fit(_saccades(spark, sf), ["subject"])
    width = 2 * F.col("slope_se") * t_quantile(F.lit(0.95), (F.col("events") - 2).cast("double"))
    return f.select("subject", "slope", width.alias("slope_ci_width"), "peak_velocity_mean", "peak_velocity_std")


@query("g20_mean_inverse_step", f"""
WITH {SAMPLES}, d AS (SELECT subject, t - lag(t) OVER (PARTITION BY subject ORDER BY t, event_id) AS s FROM samples)
SELECT subject, round(avg(CASE WHEN s > 0 THEN 1 / s END), 6) AS fs FROM d GROUP BY subject""")
def g20(spark, sf):
    return signal.mean_inverse_step(samples(spark, sf), ["subject"], "t", "event_id").select("subject", r("fs", 6).alias("fs"))


@query("g21_cumulative_error", f"""
WITH {SAMPLES}, {FLIGHT}, {ERRORS}, {INTERVAL}
SELECT run_key, round(sum(abs(glideslope_error)), 4) AS glideslope, round(sum(abs(localizer_error)), 4) AS localizer, round(sum(abs(airspeed_error)), 4) AS airspeed,
  round(sum(abs(glideslope_error)) + sum(abs(localizer_error)) + sum(abs(airspeed_error)), 4) AS total FROM scored GROUP BY run_key""")
def g21(spark, sf):
    g, l, a = (F.sum(F.abs(f"{c}_error")) for c in ("glideslope", "localizer", "airspeed"))
    return scored(spark, sf).groupBy("run_key").agg(
        r(g, 4).alias("glideslope"), r(l, 4).alias("localizer"), r(a, 4).alias("airspeed"), r(g + l + a, 4).alias("total")
    )


@query("g22_min_length", f"WITH {SAMPLES} SELECT subject, stream, count(*) AS n FROM samples GROUP BY subject, stream HAVING count(*) >= 10")
def g22(spark, sf):
    return signal.min_length(samples(spark, sf), RUN, 10)
