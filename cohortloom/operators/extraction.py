"""From raw stream files to a long table of run features with their provenance.

Every number column of a file, and the composite signals of its modality, become one value per row in a single pass; the
statistics of all files are then one grouped step. Peaks, crossings, differences and events are worked out for the
modalities that have them.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import names
from cohortloom.sources import raw

from . import ordered, signal, streams

# Feature prefix and feature group of a modality.
PREFIXES = {
    "eye_tracking": "eye", "ecg": "ecg", "eda": "eda", "emg": "emg", "respiration": "resp", "head_movement": "head", "xplane": "xplane",
    "control_input": "control", "performance": "performance", "unknown": "unknown",
}
GROUPS = {
    "eye_tracking": "eye_tracking_features", "ecg": "physiological_features", "eda": "physiological_features",
    "emg": "physiological_features", "respiration": "physiological_features", "head_movement": "head_movement_features",
    "xplane": "flight_parameter_features", "control_input": "control_input_features", "performance": "performance_features",
    "unknown": "unknown_features",
}

# Composite signals of a modality, and the parts of cleaned column names that feed them.
SIGNALS = {
    "ecg": {"signal": ["ecg"]},
    "eda": {"signal": ["eda", "gsr"]},
    "emg": {"signal": ["emg"]},
    "respiration": {"signal": ["resp"]},
    "eye_tracking": {
        "gaze": ["gaze"], "pupil": ["pupil_diameter"], "openness": ["eye_openness"],
        "position": ["eye_position", "pupil_position", "gaze_origin"],
    },
    "xplane": {
        "airspeed": ["airspeed"], "altitude": ["altitude", "elevation"], "heading": ["heading", "yaw"], "ils": ["ils"],
        "latitude": ["latitude"], "longitude": ["longitude"], "position": ["position"], "attitude": ["pitch", "roll", "yaw"],
    },
    "control_input": {"signal": ["joystick", "yoke", "throttle", "rudder", "control", "input"]},
}
# Event sequences of eye tracking; head columns that are differenced, unless the file has rates of its own.
EVENTS = {"fixation": ["fixation"], "saccade": ["saccade"]}
HEAD_TERMS, HEAD_RATES = ["position", "roll", "pitch", "yaw", "orientation", "rotation"], ["velocity", "speed"]
PEAKED = ["ecg", "eda", "respiration"]

_SERIES = "array<struct<kind:string,source:string,stem:string,places:array<int>>>"


def describe(files: DataFrame, name: Column | None = None) -> DataFrame:
    """``raw.layouts`` with file_name, run ids, modality, source_tag, prefix, reason (why a file is skipped) and time_at.

    ``name`` is the expression over ``path`` that names a file, its last part by default.
    """
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1) if name is None else name)
    ids = names.extract_ids(F.col("file_name"))
    label = names.resolve_modality(names.classify_name(F.col("file_name")), names.classify_columns(F.col("names")))["modality"]
    known = named.select("*", *[c.alias(n) for n, c in ids.items()], label.alias("_label")).withColumn(
        "modality", F.when(F.col("_label").isin(list(PREFIXES)), F.col("_label")).otherwise("unknown")
    )
    prefix = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    return raw.with_time_column(known.drop("_label").withColumns({
        "source_tag": names.source_tag(F.col("file_name")), "prefix": prefix[F.col("modality")],
        "reason": F.coalesce(
            names.skip_reason(F.col("file_name"), F.col("run_key")),
            F.when(F.lower("file_name") == "perfmetrics.csv", "summary_file"), F.when(F.col("modality") == "license_or_metadata", "documentation"),
        ),
    }))


def _has(column: Column, terms: list[str]) -> Column:
    return names.clean_name(column).rlike("|".join(terms))


def _with_series(files: DataFrame) -> DataFrame:
    """Adds series: what each row of a file gives, as the places of the cells whose mean it is."""
    def places(terms: list[str], timed: bool = False) -> Column:
        hit = F.transform("names", lambda c, i: F.when(_has(c, terms) & (F.lit(timed) | ~i.eqNullSafe(F.col("time_at"))), i))
        return F.filter(hit, lambda i: i.isNotNull())

    def series(kind: str, source: Column, stem: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), source.alias("source"), stem.alias("stem"), at.alias("places"))

    tagged = F.concat_ws("_", "prefix", "source_tag")
    columns = F.transform("names", lambda c, i: F.when(~i.eqNullSafe(F.col("time_at")), series("column", c, F.concat_ws("_", tagged, c), F.array(i))))
    parts = [F.array_compact(columns)]
    for modality, signals in SIGNALS.items():
        made = F.array(*[series("signal", F.lit("derived"), F.concat_ws("_", "prefix", F.lit(s)), places(terms)) for s, terms in signals.items()])
        parts.append(F.filter(made, lambda _: F.col("modality") == modality))
    events = F.array(*[series("event", F.lit("derived"), F.concat_ws("_", tagged, F.lit(e)), F.slice(places(terms, True), 1, 1)) for e, terms in EVENTS.items()])
    parts.append(F.filter(events, lambda _: F.col("modality") == "eye_tracking"))
    steps = F.transform("names", lambda c, i: F.when(
        _has(c, HEAD_TERMS) & ~i.eqNullSafe(F.col("time_at")),
        series("difference", F.lit("derived"), F.concat_ws("_", tagged, c, F.lit("first_difference")), F.array(i)),
    ))
    moves = (F.col("modality") == "head_movement") & (F.size(places(HEAD_RATES)) == 0)
    parts.append(F.filter(F.array_compact(steps), lambda _: moves))
    return files.withColumn("series", F.filter(F.concat(*[p.cast(_SERIES) for p in parts]), lambda s: F.size(s["places"]) > 0))


_KEYS = ["path", "nth"]


def _long(rows: DataFrame) -> DataFrame:
    """(path, nth, kind, modality, row, x, value): the values of every series; x is the elapsed time."""
    cells = F.filter(F.transform("s.places", lambda p: F.get("cells", p)), lambda v: v.isNotNull())
    mean = F.aggregate(F.col("_v"), F.lit(0.0), lambda a, v: a + v) / F.size("_v")
    out = rows.select("path", "modality", "row", "t", "cells", F.posexplode("series").alias("nth", "s")).withColumn("_v", cells)
    return out.select("path", "nth", F.col("s.kind").alias("kind"), "modality", "row", "t", F.when(F.size("_v") > 0, mean).alias("value"))


def time_bases(rows: DataFrame) -> DataFrame:
    """(path, t0, scale, duration, sampling_rate, timed) for files with a time column; timed: every row has a time."""
    timed = rows.where("time_at IS NOT NULL").select("path", "row", "t", F.get("names", F.col("time_at")).alias("_name"))
    base = streams.time_base(timed.where("t IS NOT NULL"), ["path"], "t", "row", names.clean_name(F.col("_name")) == "time_dn")
    every = timed.groupBy("path").agg(F.bool_and(F.col("t").isNotNull()).alias("timed"))
    return ordered.key_join(every, base, ["path"], "left")


def _slopes(long: DataFrame, bases: DataFrame) -> DataFrame:
    """Last minus first value in file order, by the time between the two; by the file's duration where some row has no
    time, and by the number of rows where none has. Differences go by the duration (by rows without one)."""
    ok = F.col("value").isNotNull()
    place = F.when(ok, F.col("row"))
    ends = long.groupBy(*_KEYS, "kind").agg(
        F.min_by("value", place).alias("_a"), F.max_by("value", place).alias("_b"), F.min_by("t", place).alias("_ta"), F.max_by("t", place).alias("_tb"),
        F.min(place).alias("_ra"), F.max(place).alias("_rb"),
    )
    j = ordered.key_join(ends, bases, ["path"], "left")
    apart = F.col("_rb") - F.col("_ra")
    exact = F.coalesce("timed", F.lit(False)) & F.col("duration").isNotNull() & (F.col("kind") != "difference")
    dx = F.when(exact, (F.col("_tb") - F.col("_ta")) * F.col("scale")).otherwise(F.coalesce("duration", apart.cast("double")))
    return j.select(*_KEYS, F.when((apart > 0) & (dx > 0), (F.col("_b") - F.col("_a")) / dx).alias("_slope"))


def _statistics(long: DataFrame, bases: DataFrame) -> DataFrame:
    """The 13 statistics of every series that has a number, as (path, nth, statistic, feature_value)."""
    timed = long.withColumn("_place", F.col("row").cast("double"))
    stats = signal.summarize(timed, _KEYS, "value", "_place", "row").where("mean IS NOT NULL")
    both = ordered.key_join(stats.drop("slope"), _slopes(long, bases), _KEYS).withColumnRenamed("_slope", "slope")
    return both.unpivot(_KEYS, signal.STATISTICS, "statistic", "feature_value")


def _derived(long: DataFrame, bases: DataFrame) -> DataFrame:
    """Peaks, absolute mean and variance, crossings, events: (path, nth, statistic, feature_value)."""
    duration = bases.select("path", "duration")

    def rated(counts: DataFrame, count: str, rates: Mapping[str, str]) -> DataFrame:
        j = ordered.key_join(counts, duration, ["path"], "left")
        per_second = F.when(F.col("duration") > 0, F.col(count) / F.col("duration"))
        wide = j.select(*_KEYS, F.col(count).cast("double").alias(count), *[per_second.alias(n) for n in rates])
        return wide.unpivot(_KEYS, [count, *rates], "statistic", "feature_value")

    of = long.where("kind = 'signal'")
    peaked = signal.peak_counts(of.where(F.col("modality").isin(PEAKED)), [*_KEYS, "modality"], ["row"], "value")
    breath = rated(peaked.where("modality = 'respiration'"), "peak_count", {"approximate_respiration_rate": ""}).where("statistic <> 'peak_count'")
    muscle = of.where("modality = 'emg' AND value IS NOT NULL")
    size = signal.abs_mean_and_variance(muscle, _KEYS, "value").unpivot(_KEYS, ["mav", "variance"], "statistic", "feature_value")
    turns = signal.zero_crossing_rate(muscle, _KEYS, ["row"], "value").unpivot(_KEYS, ["zero_crossing_rate"], "statistic", "feature_value")
    ids = long.where("kind = 'event'").groupBy(*_KEYS, "value").agg(F.count(F.lit(1)).alias("_n"))
    seen = ids.groupBy(*_KEYS).agg(F.count(F.when(F.col("value") >= 0, 1)).alias("event_count"))
    out = rated(peaked.drop("modality"), "peak_count", {"peak_rate": ""}).unionByName(breath)
    return out.unionByName(size).unionByName(turns).unionByName(rated(seen, "event_count", {"event_rate": ""}))


def features(spark: SparkSession, root: str, glob: str = "*.csv", name: Column | None = None, guess_time: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, features) of all stream files below ``root``.

    ``files``: one row per file with its ids, modality, time column, row_count and the reason why it was skipped, if it was.
    ``features``: path, run ids, modality, feature_group, feature_name, feature_value, source_column, statistic, one row per
    feature. Names are prefix_source_column_statistic, cleaned; a name that a file has already used gets __dup2, __dup3 ...
    Files with a time column also give duration, sampling_rate_estimate and sample_count. Columns without a number give
    nothing. With ``guess_time``, files whose header names no time use the leftmost column that rises in that share of its steps.
    """
    lines = raw.lines(spark, root, glob)
    files = ordered.settle(describe(raw.layouts(lines), name))
    used = files.where("reason IS NULL")
    if guess_time is not None:
        used = ordered.settle(raw.with_guessed_time(used, raw.numbers(lines, used), guess_time))
    parsed = raw.numbers(lines, _with_series(used).select("path", "block", "first_id", "before", "names", "modality", "time_at", "series"))
    rows = ordered.settle(parsed.withColumn("t", F.get("cells", F.col("time_at"))))
    bases = ordered.settle(time_bases(rows))
    long = _long(rows)
    moved = long.where("kind = 'difference'")
    moved = ordered.with_neighbor(moved, _KEYS, ["row"], {"_prev": "value"}).withColumn("value", F.col("value") - F.col("_prev")).drop("_prev")
    valued = ordered.settle(long.where("kind IN ('column', 'signal')").unionByName(moved))
    found = _statistics(valued, bases).unionByName(_derived(long.where("kind IN ('signal', 'event')"), bases))

    per_file = _with_series(used).where("before = 0")
    ids = ["path", *names.RUN_ID_PATTERNS, "run_key", "modality"]
    named = per_file.select(*ids, "prefix", "source_tag", F.posexplode("series").alias("nth", "s"))
    sort = {s: i for i, s in enumerate([*signal.STATISTICS, "mav", "variance", "zero_crossing_rate", "peak_count", "peak_rate", "event_count", "event_rate", "approximate_respiration_rate"])}
    order = F.create_map(*[F.lit(x) for pair in sort.items() for x in pair])
    whole = F.col("statistic") == "approximate_respiration_rate"
    plain = ordered.key_join(found, named, _KEYS).select(
        *ids, names.clean_name(F.when(whole, F.concat_ws("_", "prefix", "statistic")).otherwise(F.concat_ws("_", "s.stem", "statistic"))).alias("_name"),
        "feature_value", F.col("s.source").alias("source_column"),
        F.when(F.col("s.kind") == "column", F.col("statistic")).otherwise("derived").alias("statistic"),
        (F.when(F.col("s.kind") == "column", 0).otherwise(1 << 40).cast("long") + F.col("nth") * 64 + order[F.col("statistic")]).alias("_order"),
    )
    meta = per_file.where("time_at IS NOT NULL").join(bases, "path", "left").select(
        *ids, "prefix", "source_tag", F.get("names", F.col("time_at")).alias("source_column"), "duration",
        F.col("sampling_rate").alias("sampling_rate_estimate"), F.col("rows").cast("double").alias("sample_count"),
    ).unpivot([*ids, "prefix", "source_tag", "source_column"], ["duration", "sampling_rate_estimate", "sample_count"], "statistic", "feature_value")
    meta = meta.select(
        *ids, names.clean_name(F.concat_ws("_", "prefix", "source_tag", "statistic")).alias("_name"), "feature_value", "source_column", "statistic",
        (F.lit(1 << 39) + F.ascii("statistic")).alias("_order"),
    )
    group = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    out = streams.dedup_names(plain.unionByName(meta), ["path"], "_name", "_order", "feature_name")
    out = out.select(*ids, group[F.col("modality")].alias("feature_group"), "feature_name", "feature_value", "source_column", "statistic")
    summary = files.where("before = 0").select(
        "path", "file_name", *names.RUN_ID_PATTERNS, "run_key", "modality", "source_tag", F.col("rows").alias("row_count"), "names", "time_at", "reason"
    )
    return summary, out
