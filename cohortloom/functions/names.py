"""Column expressions for names, identifiers and modality rules."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modality keywords looked for in a file name.
FILENAME_KEYWORDS = {
    "license_or_metadata": ["license", "readme", "metadata", "description"],
    "performance": ["perfmetric", "perfmetrics", "total_error", "glideslope", "localizer", "airspeed_error", "cumulative_total_error"],
    "eye_tracking": ["lslhtcviveeye", "eye", "gaze", "pupil", "eyetrk", "ocuevts"],
    "ecg": ["ecg", "heart", "cardiac", "bitalino"],
    "eda": ["eda", "gsr", "electrodermal"],
    "emg": ["emg"],
    "respiration": ["resp", "respiration", "breath", "breathing"],
    "head_movement": ["head", "hmd", "pose", "position", "rotation"],
    "control_input": ["joystick", "yoke", "throttle", "rudder", "control"],
    "xplane": ["lslxp11", "xplane", "xpc", "aircraft", "altitude", "airspeed", "ils"],
}

# Modality keywords looked for in the joined column names.
COLUMN_KEYWORDS = {
    "performance": ["total_error", "glideslope", "localizer", "airspeed_error", "cumulative_total_error"],
    "eye_tracking": ["gaze", "pupil", "eye_openness", "convergence", "validity_l", "validity_r"],
    "ecg": ["ecg"],
    "eda": ["eda", "gsr", "electrodermal"],
    "emg": ["emg"],
    "respiration": ["respiration", "resp", "breathing", "breath"],
    "head_movement": ["pilot_head", "head_position", "head_roll", "head_pitch", "head_yaw", "hmd", "pose", "rotation"],
    "control_input": ["joystick", "yoke", "throttle", "rudder", "control"],
    "xplane": ["aircraft", "airspeed", "altitude", "agl_altitude", "ils", "landing_gear", "climb_rate"],
}

# Column-name prefixes that prove a modality is present.
COLUMN_PREFIXES = {
    "eye_tracking": ["gaze_", "pupil_", "eye_openness", "validity_", "convergence_"],
    "ecg": ["ecg_"],
    "eda": ["eda_", "gsr_"],
    "emg": ["emg_"],
    "respiration": ["respiration_"],
    "head_movement": ["pilot_head_"],
    "xplane": ["aircraft_"],
    "torso_body_accelerometer": ["accelerometry_torso_"],
}

# Whole column names, and parts of column names, that prove a modality is present.
COLUMN_NAMES = {
    "eye_tracking": ["fixationseq", "saccadeseq"],
    "performance": ["glideslope_error_deg", "localizer_error_deg", "airspeed_error_kts", "total_error"],
}
COLUMN_PARTS = {
    "control_input": [
        "joystick", "yoke", "throttle", "rudder", "control_input", "flight_control", "stick_position", "pedal_position",
        "aileron_command", "elevator_command",
    ],
}

# Statistic suffixes of feature names.
STATISTIC_SUFFIXES = [
    "sampling_rate_estimate", "missing_ratio", "num_missing", "sample_count", "kurtosis", "median", "range", "slope",
    "mean", "std", "min", "max", "iqr", "skew", "rms", "duration",
]

RUN_ID_PATTERNS = {
    "subject_id": r"(?i)sub-[A-Za-z0-9]+",
    "session_id": r"(?i)ses-[A-Za-z0-9]+",
    "difficulty_level": r"(?i)level-[A-Za-z0-9]+",
    "run_id": r"(?i)run-[0-9]+",
}


def clean_name(c: Column) -> Column:
    """Lower-case name with every other character run as one underscore."""
    s = F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^0-9a-zA-Z]+", "_"), F.lit("_"))
    s = F.when(s == "", "value").otherwise(s)
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("c_"), s)).otherwise(s)


def extract_ids(text: Column, patterns: Mapping[str, str] = RUN_ID_PATTERNS) -> dict[str, Column]:
    """One column per pattern, plus the composite key, empty when any part is missing."""
    ids = {name: F.regexp_extract(text, p, 0) for name, p in patterns.items()}
    whole = F.lit(True)
    for part in ids.values():
        whole = whole & (part != "")
    key = F.when(whole, F.concat_ws("_", *ids.values())).otherwise("")
    return {**ids, "run_key": key}


def level_number(c: Column) -> Column:
    return F.regexp_extract(c, r"level-(\d{2,3})", 1).try_cast("int")


def source_tag(file_name: Column) -> Column:
    low = F.lower(file_name)
    stream = F.regexp_extract(low, r"stream-([^_]+)", 1)
    stem = F.regexp_replace(file_name, r"(.)\.[^.]*$", "$1")
    return (
        F.when(low == "perfmetrics.csv", "cumulative")
        .when(low.contains("ocuevts"), "ocuevts")
        .when(low.contains("feat-perfmetric"), "perfmetric")
        .when(stream != "", clean_name(stream))
        .otherwise(clean_name(stem))
    )


def _hits(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    found = []
    for label, words in rules.items():
        any_word = F.lit(False)
        for w in words:
            if any(o != w and o in w for o in words):
                continue  # a shorter word of the same label already covers it
            any_word = any_word | text.contains(w)
        found.append(F.when(any_word, label))
    return F.array_compact(F.array(*found))


def _bind(c: Column, body) -> Column:
    """Evaluate ``c`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _norm(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("-"), F.lit("_"))


def classify_name(file_name: Column) -> Column:
    """struct(modality, method) from keywords in a file name or free text."""
    text = F.replace(F.replace(_norm(file_name), F.lit("task_ils"), F.lit("")), F.lit("task_rest"), F.lit(""))

    def decide(hits: Column) -> Column:
        modality = (
            F.when(F.array_contains(hits, "license_or_metadata"), "license_or_metadata")
            .when(F.array_contains(hits, "performance"), "performance")
            .when(F.size(hits) == 1, F.get(hits, F.lit(0)))
            .otherwise("unknown")
        )
        method = (
            F.when(F.size(hits) == 0, "unclassified_filename")
            .when(modality != "unknown", "filename_keyword")
            .otherwise(F.concat(F.lit("ambiguous_filename_keywords:"), F.concat_ws(";", hits)))
        )
        return F.struct(modality.alias("modality"), method.alias("method"))

    return _bind(_bind(text, lambda t: _hits(t, FILENAME_KEYWORDS)), decide)


def classify_columns(columns: Column) -> Column:
    """struct(modality, method) from the set of column names of one file."""
    def decide(hits: Column) -> Column:
        head = F.array_contains(hits, "head_movement") & F.exists(columns, lambda c: _norm(c).startswith("pilot_head"))
        modality = (
            F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))
            .when((F.size(hits) > 1) & F.array_contains(hits, "performance"), "performance")
            .when((F.size(hits) > 1) & head, "head_movement")
            .otherwise("unknown")
        )
        method = (
            F.when(F.coalesce(F.size(columns), F.lit(0)) == 0, "no_columns_available")
            .when(F.size(hits) == 0, "unclassified_csv_columns")
            .when(F.size(hits) == 1, "csv_column_keyword")
            .when(modality != "unknown", "csv_column_keyword_priority")
            .otherwise(F.concat(F.lit("ambiguous_csv_column_keywords:"), F.concat_ws(";", hits)))
        )
        return F.struct(modality.alias("modality"), method.alias("method"))

    return _bind(_bind(_norm(F.concat_ws(" ", columns)), lambda t: _hits(t, COLUMN_KEYWORDS)), decide)


def _named(pattern: str):
    return lambda c: F.lower(F.trim(c)).rlike(pattern)


def modality_evidence(columns: Column) -> Column:
    """Sorted modalities proved by prefixes, whole names or parts of column names. Aircraft state proves no control input."""
    found = []
    for label in {**COLUMN_PREFIXES, **COLUMN_NAMES, **COLUMN_PARTS}:
        patterns = [f"^{p}" for p in COLUMN_PREFIXES.get(label, [])] + [f"^{n}$" for n in COLUMN_NAMES.get(label, [])] + COLUMN_PARTS.get(label, [])
        found.append(F.when(F.exists(columns, _named("|".join(patterns))), label))
    return F.array_sort(F.array_compact(F.array(*found)))


def resolve_modality(by_name: Column, by_columns: Column) -> Column:
    """Name evidence first; diagnostic columns fill a gap or correct the broad simulator tag."""
    n, nm, c, cm = by_name["modality"], by_name["method"], by_columns["modality"], by_columns["method"]
    corrects = (n == "xplane") & c.isin("head_movement", "performance")
    return F.struct(
        F.when(n == "license_or_metadata", n).when(n == "unknown", c).when(corrects, c).otherwise(n).alias("modality"),
        F.when(n == "license_or_metadata", nm)
        .when((n == "unknown") & (c != "unknown"), cm)
        .when((c == "unknown") | (n == c), nm)
        .when(corrects, "csv_columns_overrode_broad_filename_keyword")
        .otherwise(F.concat(nm, F.lit(";csv_column_support="), c))
        .alias("method"),
    )


def skip_reason(file_name: Column, run_key: Column) -> Column:
    low = F.lower(file_name)
    return (
        F.when(low.endswith("_hea.csv"), "header_metadata_file")
        .when(low == "perfmetrics.csv", F.lit(None).cast("string"))
        .when(~low.rlike(r"\.(csv|mat)$"), "unsupported_or_documentation_file")
        .when(run_key.isNull() | (F.trim(run_key) == ""), "missing_run_identifier")
    )


def split_statistic(feature: Column) -> Column:
    """struct(base_variable, statistic), longest suffix first."""
    ordered = sorted(STATISTIC_SUFFIXES, key=len, reverse=True)
    pattern = "^(.*?)_(" + "|".join(ordered) + ")$"
    return F.struct(
        F.regexp_extract(feature, pattern, 1).alias("base_variable"), F.regexp_extract(feature, pattern, 2).alias("statistic")
    )


def set_digest(names: Column) -> Column:
    """SHA-256 of a name set: sorted names, one per line."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.array_distinct(names)), "\n"), F.lit("\n")), 256)


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON text with keys in sorted order."""
    return F.to_json(F.struct(*sorted(columns)))
