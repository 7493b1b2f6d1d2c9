"""Per-run signal features over long sample tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.numeric import finite, row_mean

from . import ordered

# The statistics of one signal summary, in output order.
STATISTICS = ["mean", "std", "min", "max", "median", "iqr", "skew", "kurtosis", "range", "rms", "slope", "num_missing", "missing_ratio"]

# Composite signals and the column-name terms that feed them.
SIGNAL_TERMS = {
    "ecg": ["ecg"], "eda": ["eda", "gsr"], "emg": ["emg"], "respiration": ["resp"], "gaze": ["gaze"], "pupil": ["pupil_diameter"],
    "openness": ["eye_openness"], "eye_position": ["eye_position", "pupil_position", "gaze_origin"], "airspeed": ["airspeed"],
    "altitude": ["altitude", "elevation"], "heading": ["heading", "yaw"], "ils": ["ils"], "latitude": ["latitude"],
    "longitude": ["longitude"], "position": ["position"], "attitude": ["pitch", "roll", "yaw"],
    "control": ["joystick", "yoke", "throttle", "rudder", "control", "input"],
}


def duration(t: str) -> Column:
    return F.max(t) - F.min(t)


def summarize(
    df: DataFrame, keys: Sequence[str], value: str, t: str, tie: str, span: str = "finite", rows_per_chunk: int | None = None
) -> DataFrame:
    """The 13 statistics per key. ``span`` 'finite' divides the slope by the time between the first
    and last finite sample, 'run' by the whole run's duration."""
    x = F.col(value)
    d = df.withColumn("_x", finite(x.cast("double")))
    ok = F.col("_x").isNotNull()
    place = F.when(ok, ordered.order_key(t, tie))
    agg = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count("_x").alias("_m"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("_sd"),
        F.min("_x").alias("min"), F.max("_x").alias("max"), F.skewness("_x").alias("_g1"), F.kurtosis("_x").alias("_g2"),
        F.sqrt(F.avg(F.col("_x") * F.col("_x"))).alias("rms"),
        F.min_by("_x", place).alias("_first"), F.max_by("_x", place).alias("_last"),
        F.min(F.when(ok, F.col(t))).alias("_f0"), F.max(F.when(ok, F.col(t))).alias("_f1"), duration(t).alias("_dur"),
    )
    q = ordered.exact_quantiles(d, keys, "_x", [0.25, 0.5, 0.75], "_q", rows_per_chunk)
    j = ordered.key_join(agg, q, keys, "left")
    n = F.col("_m").cast("double")
    sd = F.when(F.col("_m") == 1, 0.0).otherwise(F.col("_sd"))
    dt = F.col("_f1") - F.col("_f0") if span == "finite" else F.col("_dur")
    varied = F.col("_sd") > 0
    return j.select(
        *keys, "mean", F.when(F.col("_m") > 0, sd).alias("std"), "min", "max", F.get("_q", F.lit(1)).alias("median"),
        (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))).alias("iqr"),
        F.when((n >= 3) & varied, F.sqrt(n * (n - 1)) / (n - 2) * F.col("_g1")).alias("skew"),
        F.when((n >= 4) & varied, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).alias("kurtosis"),
        (F.col("max") - F.col("min")).alias("range"), "rms",
        F.when((n >= 2) & (dt > 0), (F.col("_last") - F.col("_first")) / dt).alias("slope"),
        (F.col("_n") - F.col("_m")).cast("double").alias("num_missing"),
        ((F.col("_n") - F.col("_m")) / F.col("_n")).alias("missing_ratio"),
    )


def endpoint_slope(df: DataFrame, keys: Sequence[str], value: str, t: str, tie: str) -> DataFrame:
    ok = F.col(value).isNotNull()
    place = F.when(ok, ordered.order_key(t, tie))
    g = df.groupBy(*keys).agg(
        F.min_by(value, place).alias("_a"), F.max_by(value, place).alias("_b"),
        (F.max(F.when(ok, F.col(t))) - F.min(F.when(ok, F.col(t)))).alias("_dt"),
    )
    return g.select(*keys, F.when(F.col("_dt") > 0, (F.col("_b") - F.col("_a")) / F.col("_dt")).alias("slope"))


def stream_meta(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    g = df.groupBy(*keys).agg(duration(t).alias("duration"), F.count(F.lit(1)).alias("sample_count"))
    return g.select(
        *keys, F.when(F.col("duration") > 0, F.col("duration")).alias("duration"),
        F.when(F.col("duration") > 0, (F.col("sample_count") - 1) / F.col("duration")).alias("sampling_rate_estimate"), "sample_count",
    )


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), name, value)


def extract_features(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], t: str, tie: str, prefix: Column
) -> DataFrame:
    """Every numeric column to 13 named features per run, long, with its source column and statistic."""
    long = melt(df, [*keys, t, tie], columns, "source_column", "_v")
    stats = summarize(long, [*keys, "source_column"], "_v", t, tie)
    out = stats.unpivot([*keys, "source_column"], STATISTICS, "statistic", "feature_value")
    return out.withColumn("feature_name", F.concat_ws("_", prefix, F.lower("source_column"), "statistic"))


def composite_signals(df: DataFrame, ids: Sequence[str], columns: Sequence[str], terms: Mapping[str, Sequence[str]] = SIGNAL_TERMS) -> DataFrame:
    """Row means of the columns matching each signal's terms, as long rows (ids, signal, value)."""
    made = {}
    for signal, words in terms.items():
        hit = [c for c in columns if any(w in c.lower() for w in words)]
        if hit:
            made[signal] = row_mean([F.col(c).cast("double") for c in hit])
    wide = df.select(*ids, *[c.alias(s) for s, c in made.items()])
    return wide.unpivot(list(ids), list(made), "signal", "value")


def zero_crossing_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Share of steps where the sign of (value - mean) changes."""
    present = df.where(F.col(value).isNotNull())
    mean = present.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    signed = ordered.key_join(present, mean, keys).withColumn("_neg", F.col(value) - F.col("_mean") < 0)
    near = ordered.with_neighbor(signed, keys, order, {"_prev": "_neg"})
    return near.groupBy(*keys).agg(
        F.avg((F.col("_neg") != F.col("_prev")).cast("double")).alias("zero_crossing_rate")
    )


def abs_mean_and_variance(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs(value)).alias("mav"), F.var_samp(value).alias("variance"))


def first_difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    near = ordered.with_neighbor(df, keys, order, {"_prev": value})
    return ordered.settle(near.withColumn(value, F.col(value) - F.col("_prev")).drop("_prev"))


def event_rate(df: DataFrame, keys: Sequence[str], t: str, event: str) -> DataFrame:
    """Distinct non-negative event ids per key and per second; ids are counted before the final grouping."""
    ids = df.groupBy(*keys, event).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    g = ids.groupBy(*keys).agg(
        F.count(F.when(F.col(event) >= 0, 1)).alias("event_count"), (F.max("_b") - F.min("_a")).alias("_dur")
    )
    return g.select(*keys, "event_count", F.when(F.col("_dur") > 0, F.col("event_count") / F.col("_dur")).alias("event_rate"))


def fraction_below(df: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(value) <= threshold).cast("double")).alias("fraction"))


def population_moments(value: str, prefix: str = "") -> list[Column]:
    varied = F.stddev_pop(value) > 0
    return [
        F.avg(value).alias(f"{prefix}mean"), F.stddev_pop(value).alias(f"{prefix}std"),
        F.when(varied, F.skewness(value)).alias(f"{prefix}skew"), F.when(varied, F.kurtosis(value)).alias(f"{prefix}kurtosis"),
    ]


def mean_inverse_step(df: DataFrame, keys: Sequence[str], t: str, tie: str) -> DataFrame:
    near = ordered.with_neighbor(df.select(*keys, t, tie), keys, [t, tie], {"_prev": t})
    step = F.col(t) - F.col("_prev")
    return near.groupBy(*keys).agg(F.avg(F.when(step > 0, 1 / step)).alias("fs"))


def min_length(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Keys with at least ``min_rows`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)


# --- peaks -----------------------------------------------------------------------------------
# A sample of height h has prominence >= T exactly when, on both sides, the signal falls to h - T
# before it rises above h.  Reading left to right, the smallest height that satisfies the left
# side is one number L, and a new sample x turns it into clamp(L, x, x + T).  Clamps compose into
# clamps, so a chunk is summed up by two numbers and the state crosses chunks like a running sum.


def _clamp_scan(x: np.ndarray, t: float, start: float) -> np.ndarray:
    """State before each sample, given the state before the first one (log-step scan)."""
    lo, hi = x.copy(), x + t
    step = 1
    while step < len(x):
        a, b = lo[:-step].copy(), hi[:-step].copy()
        lo_now, hi_now = lo[step:].copy(), hi[step:].copy()
        lo[step:] = np.minimum(np.maximum(a, lo_now), hi_now)
        hi[step:] = np.minimum(np.maximum(b, lo_now), hi_now)
        step *= 2
    after = np.minimum(np.maximum(start, lo), hi)
    return np.concatenate([[start], after[:-1]])


def _chunk_clamp(values: np.ndarray, t: float) -> tuple[float, float]:
    lo, hi = -np.inf, np.inf
    ends = _clamp_scan(values, t, lo), _clamp_scan(values, t, hi)
    last = values[-1]
    return tuple(float(min(max(e[-1], last), last + t)) for e in ends)


def _carry(pdf: pd.DataFrame) -> pd.DataFrame:
    """Compose chunk clamps along one key: one row per chunk in, the entering states out."""
    pdf = pdf.sort_values("_chunk").reset_index(drop=True)
    n = len(pdf)
    left, right = np.full(n, np.inf), np.full(n, np.inf)
    for i in range(1, n):
        left[i] = min(max(left[i - 1], pdf.flo[i - 1]), pdf.fhi[i - 1])
        j = n - 1 - i
        right[j] = min(max(right[j + 1], pdf.blo[j + 1]), pdf.bhi[j + 1])
    return pdf.assign(left_in=left, right_in=right)


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("flo", "fhi", "blo", "bhi")]))
def _chunk_clamps(samples: pd.Series, limits: pd.Series) -> pd.DataFrame:
    rows = [(*_chunk_clamp(np.asarray(x), t), *_chunk_clamp(np.asarray(x)[::-1], t)) for x, t in zip(samples, limits)]
    return pd.DataFrame(rows, columns=["flo", "fhi", "blo", "bhi"])


@F.pandas_udf(T.LongType())
def _count_peaks(samples: pd.Series, tops: pd.Series, limits: pd.Series, left_in: pd.Series, right_in: pd.Series) -> pd.Series:
    out = []
    for x, top, t, a, b in zip(samples, tops, limits, left_in, right_in):
        x = np.asarray(x)
        left, right = _clamp_scan(x, t, a), _clamp_scan(x[::-1], t, b)[::-1]
        out.append(int((np.asarray(top, dtype=bool) & (x >= left) & (x >= right)).sum()))
    return pd.Series(out, dtype="int64")


def peak_counts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, factor: float = 0.25, rows_per_chunk: int | None = None
) -> DataFrame:
    """Local maxima with prominence >= max(factor * population sd, 1e-12); plateaus count once."""
    keys = list(keys)
    types = {f.name: f.dataType for f in df.schema.fields}
    present = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("_x"))
    spread = present.groupBy(*keys).agg(
        F.stddev_pop("_x").alias("_sd"), F.count(F.lit(1)).alias("_n"), F.greatest(factor * F.stddev_pop("_x"), F.lit(1e-12)).alias("_t")
    )
    before = ordered.with_neighbor(present, keys, order, {"_prev": "_x"}, -1, rows_per_chunk)
    turns = ordered.settle(before.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("_x"))))
    both = ordered.with_neighbor(turns, keys, order, {"_next": "_x"}, 1, rows_per_chunk)
    peaked = both.withColumn("_peak", F.coalesce((F.col("_x") > F.col("_prev")) & (F.col("_x") > F.col("_next")), F.lit(False)))
    chunks = ordered.range_chunks(ordered.settle(peaked), keys, order, rows_per_chunk)
    work = ordered.key_join(chunks, spread.select(*keys, "_t"), keys)
    # One row per (key, chunk): its samples in order. A chunk is bounded, whatever the key's length.
    packed = F.array_sort(F.collect_list(F.struct(*order, "_x", "_peak")))
    parts = work.groupBy(*keys, "_chunk", "_t").agg(packed.alias("_s")).select(
        *keys, "_chunk", "_t", F.transform("_s", lambda v: v["_x"]).alias("_xs"), F.transform("_s", lambda v: v["_peak"]).alias("_tops")
    )
    key_fields = [T.StructField(k, types[k]) for k in keys] + [T.StructField("_chunk", T.IntegerType())]
    clamp_fields = [T.StructField(c, T.DoubleType()) for c in ("flo", "fhi", "blo", "bhi")]
    state_fields = [T.StructField(c, T.DoubleType()) for c in ("left_in", "right_in")]
    hot = parts.where(F.col("_chunk").isNotNull())
    clamps = hot.select(*keys, "_chunk", _chunk_clamps("_xs", "_t").alias("_c")).select(*keys, "_chunk", "_c.*")
    states = clamps.groupBy(*keys).applyInPandas(_carry, T.StructType(key_fields + clamp_fields + state_fields))
    ready = parts.join(states.select(*keys, "_chunk", "left_in", "right_in"), [*keys, "_chunk"], "left").fillna(
        {"left_in": float("inf"), "right_in": float("inf")}
    )
    counted = ready.select(*keys, _count_peaks("_xs", "_tops", "_t", "left_in", "right_in").alias("_hits"))
    hits = counted.groupBy(*keys).agg(F.sum("_hits").alias("_hits"))
    joined = ordered.key_join(spread, hits, keys, "left")
    found = F.when(F.col("_sd") > 0, F.coalesce("_hits", F.lit(0))).otherwise(F.lit(0).cast("long"))
    return joined.select(*keys, F.when(F.col("_n") >= 3, found).alias("peak_count"))


# --- spectra ---------------------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _periodogram(segments: pd.Series, fs: pd.Series) -> pd.Series:
    """One-sided Hann-window power density of each segment, mean removed."""
    out = []
    for x, rate in zip(segments, fs):
        x = np.asarray(x, dtype=float)
        n = len(x)
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        p = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (rate * (w * w).sum())
        p[1 : -1 if n % 2 == 0 else None] *= 2
        out.append(p)
    return pd.Series(out)


def welch_psd(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, fs: DataFrame, nperseg: int = 256, rows_per_chunk: int | None = None
) -> DataFrame:
    """Mean power density per (key, frequency): half-overlapping segments of at most ``nperseg`` samples.

    ``fs`` holds the sampling rate per key in column ``fs``.  A sample goes to the one or two
    segments that cover it, so the work per task is one segment and never a whole signal.
    """
    numbered = ordered.row_numbers(df.select(*keys, *order, F.col(value).cast("double").alias("_x")), keys, order, "_i", rows_per_chunk)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    shape = ordered.key_join(sizes, fs, keys).withColumn("_len", F.least(F.lit(nperseg), F.col("_n")).cast("int"))
    shape = shape.withColumn("_step", (F.col("_len") - F.floor(F.col("_len") / 2)).cast("int"))
    shape = shape.withColumn("_segs", F.floor((F.col("_n") - F.col("_len")) / F.col("_step")) + 1)
    rows = ordered.key_join(numbered, shape, keys).withColumn("_i", F.col("_i") - 1)
    last = F.least(F.floor(F.col("_i") / F.col("_step")), F.col("_segs") - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - F.col("_len") + 1) / F.col("_step")))
    rows = rows.where(first <= last).withColumn("_seg", F.explode(F.sequence(first, last)))
    segments = rows.groupBy(*keys, "_seg", "fs", "_len").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_samples")
    )
    power = segments.select(*keys, "fs", "_len", F.posexplode(_periodogram("_samples", "fs")).alias("bin", "_p"))
    mean = power.groupBy(*keys, "fs", "_len", "bin").agg(F.avg("_p").alias("psd"))
    return mean.select(*keys, "bin", (F.col("bin") * F.col("fs") / F.col("_len")).alias("freq"), "psd")


def spectral_features(psd: DataFrame, keys: Sequence[str], normalized: bool = False) -> DataFrame:
    """Maximum power, its frequency (lowest on ties) and entropy.

    The entropy keeps the un-normalised density inside the logarithm unless ``normalized``.
    """
    total = psd.groupBy(*keys).agg(F.sum("psd").alias("_total"))
    j = ordered.key_join(psd, total, keys)
    share = F.try_divide("psd", "_total")
    inside = share if normalized else F.col("psd")
    return j.groupBy(*keys).agg(
        F.max("psd").alias("max_power"), F.max_by("freq", F.struct("psd", -F.col("bin"))).alias("freq_of_max"),
        (-F.sum(share * F.log2(inside))).alias("entropy"),
    )


# --- oculomotor events ------------------------------------------------------------------------


def drop_last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    numbered = ordered.row_numbers(df, keys, order, "_rn")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return ordered.settle(ordered.key_join(numbered, sizes, keys).where(F.col("_rn") <= F.col("_n") - n).drop("_rn", "_n"))


def open_eye_samples(df: DataFrame, keys: Sequence[str], order: Sequence[str], openness: str, threshold: float = 0.5) -> DataFrame:
    """Samples with the eye open; the last two of a run are left out, as in the source study."""
    return drop_last_rows(df.where(F.col(openness) > threshold), keys, order, 2)


def event_durations(df: DataFrame, keys: Sequence[str], event: str, t: str) -> DataFrame:
    return df.where(F.col(event) >= 0).groupBy(*keys, event).agg(duration(t).alias("duration"))


def event_dispersion(df: DataFrame, keys: Sequence[str], event: str, xyz: Sequence[str]) -> DataFrame:
    total = sum((F.var_pop(c) for c in xyz[1:]), F.var_pop(xyz[0]))
    return df.where(F.col(event) >= 0).groupBy(*keys, event).agg(F.sqrt(total).alias("dispersion"))


def saccade_metrics(df: DataFrame, keys: Sequence[str], event: str, order: Sequence[str], t: str, xyz: Sequence[str]) -> DataFrame:
    """Amplitude, duration and 99th percentile step length per event of at least two samples."""
    by = [*keys, event]
    near = ordered.with_neighbor(df.where(F.col(event) >= 0), by, order, {f"_p_{c}": c for c in xyz})
    step = sum(((F.col(c) - F.col(f"_p_{c}")) ** 2 for c in xyz[1:]), (F.col(xyz[0]) - F.col(f"_p_{xyz[0]}")) ** 2)
    near = ordered.settle(near.withColumn("_step", F.sqrt(step)))
    place = ordered.order_key(*order)
    ends = near.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), duration(t).alias("duration"),
        *[f(c, place).alias(f"_{n}_{c}") for c in xyz for n, f in (("a", F.min_by), ("b", F.max_by))],
    ).where(F.col("samples") >= 2)
    amp = sum(((F.col(f"_b_{c}") - F.col(f"_a_{c}")) ** 2 for c in xyz[1:]), (F.col(f"_b_{xyz[0]}") - F.col(f"_a_{xyz[0]}")) ** 2)
    peak = ordered.exact_quantiles(near, by, "_step", [0.99], "_q")
    j = ordered.key_join(ends, peak, by)
    return j.select(*by, "duration", F.sqrt(amp).alias("amplitude"), F.get("_q", F.lit(0)).alias("peak_velocity"))


def main_sequence_fit(saccades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares slope of (peak velocity x duration) on amplitude and the slope's standard error."""
    y, x = F.col("peak_velocity") * F.col("duration"), F.col("amplitude")
    g = saccades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
        F.avg("peak_velocity").alias("peak_velocity_mean"), F.stddev_pop("peak_velocity").alias("peak_velocity_std"),
    )
    sse = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("_sxy"))
    dof = F.col("events") - 2
    usable = (dof > 0) & (F.col("_sxx") > 0)
    return g.select(
        *keys, "events", F.when(usable, F.col("slope")).alias("slope"),
        F.when(usable, F.sqrt(sse / dof / F.col("_sxx"))).alias("slope_se"), "peak_velocity_mean", "peak_velocity_std",
    )
