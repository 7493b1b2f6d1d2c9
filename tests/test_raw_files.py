"""Files of unlike layouts: headers, time columns, cells by name, features against plain pandas."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import extraction
from cohortloom.sources import raw

RUN = "sub-cp001_ses-20240101_level-01B_run-001_stream-{}_dat.csv"


def put(folder, name, text):
    (folder / name).write_bytes(text.encode())


def cells(spark, folder, **where):
    lines = raw.lines(spark, str(folder))
    files = raw.with_time_column(raw.layouts(lines))
    rows = raw.numbers(lines, files).select(F.element_at(F.split("path", "/"), -1).alias("file"), "row", "names", "time_at", "cells").collect()
    return {(r.file, r.row): (r.names, r.time_at, r.cells) for r in rows}


def test_headers_of_all_kinds(spark, tmp_path):
    put(tmp_path, "a.csv", "Time,x\n1,2\n2,oops\n\n3\n4,5,6\n")
    put(tmp_path, "b.csv", "﻿\"x, y\",,t_end_time\r\n\"1\",2,3\r\n")
    put(tmp_path, "only_header.csv", "p,q\n")
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "blank.csv", "\n  \n")
    got = cells(spark, tmp_path)
    assert got == {
        ("a.csv", 0): (["Time", "x"], 0, [1.0, 2.0]), ("a.csv", 1): (["Time", "x"], 0, [2.0, None]),
        ("a.csv", 2): (["Time", "x"], 0, [3.0, None]), ("a.csv", 3): (["Time", "x"], 0, [4.0, 5.0]),
        ("b.csv", 0): (["x, y", "Unnamed: 1", "t_end_time"], 2, [1.0, 2.0, 3.0]),
    }
    files = {r.path.split("/")[-1]: r for r in raw.layouts(raw.lines(spark, str(tmp_path))).collect()}
    assert sorted(files) == ["a.csv", "b.csv", "only_header.csv"] and files["only_header.csv"].rows == 0


def test_rows_are_numbered_across_blocks(spark, tmp_path):
    n = 4000
    put(tmp_path, "long.csv", "t,v\n" + "".join(f"{i},{i * 0.5}\n" for i in range(n)))
    put(tmp_path, "short.csv", "v\n7\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = raw.lines(spark, str(tmp_path))
        files = raw.layouts(lines)
        assert files.where(F.col("path").endswith("long.csv")).count() > 5
        rows = raw.numbers(lines, files).where(F.size("names") == 2).select("row", "cells").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.row, r.cells[0], r.cells[1]) for r in rows) == [(i, float(i), i * 0.5) for i in range(n)]


def test_a_rising_column_is_taken_for_the_time(spark, tmp_path):
    rng = np.random.default_rng(1)
    put(tmp_path, "a.csv", "x,clock\n" + "".join(f"{v},{i}\n" for i, v in enumerate(rng.random(200))))
    put(tmp_path, "b.csv", "x,y\n" + "".join(f"{v},{v}\n" for v in rng.random(200)))
    put(tmp_path, "c.csv", "up,time\n" + "".join(f"{i},{i}\n" for i in range(50)))
    lines = raw.lines(spark, str(tmp_path))
    files = raw.with_time_column(raw.layouts(lines))
    got = raw.with_guessed_time(files, raw.numbers(lines, files)).collect()
    assert {r.path.split("/")[-1]: r.time_at for r in got} == {"a.csv": 1, "b.csv": None, "c.csv": 1}


def test_features_of_mixed_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 60
    ecg = pd.DataFrame({"time": np.cumsum(rng.random(n) + 0.1), "ecg_mV": rng.normal(size=n), "ecg_mv": rng.normal(size=n), "flat": 3.0, "text": "x"})
    eye = pd.DataFrame({"gaze_x": rng.normal(size=n), "pupil_diameter_l": rng.normal(size=n), "saccadeseq": rng.integers(-1, 5, n)})
    ecg.loc[5:9, "ecg_mV"] = np.nan
    ecg.to_csv(tmp_path / RUN.format("ecg"), index=False)
    eye.to_csv(tmp_path / RUN.format("lslhtcviveeye"), index=False)
    put(tmp_path, "README.csv", "license\ntext\n")
    put(tmp_path, RUN.format("ecg").replace("_dat", "_hea"), "a\n1\n")
    files, found = extraction.features(spark, str(tmp_path))
    why = {r.file_name: (r.modality, r.reason, r.row_count) for r in files.collect()}
    assert why == {
        RUN.format("ecg"): ("ecg", None, n), RUN.format("lslhtcviveeye"): ("eye_tracking", None, n),
        "README.csv": ("unknown", "missing_run_identifier", 1), RUN.format("ecg").replace("_dat", "_hea"): ("ecg", "header_metadata_file", 1),
    }
    rows = found.collect()
    got = {r.feature_name: r.feature_value for r in rows}
    assert len(got) == len(rows) and {r.run_key for r in rows} == {"sub-cp001_ses-20240101_level-01B_run-001"}
    x, t = ecg["ecg_mV"].dropna(), ecg["time"]
    duration = t.iloc[-1] - t.iloc[0]
    signal = ecg[["ecg_mV", "ecg_mv"]].mean(axis=1)
    want = {
        "ecg_ecg_ecg_mv_mean": x.mean(), "ecg_ecg_ecg_mv_mean__dup2": ecg["ecg_mv"].mean(), "ecg_ecg_ecg_mv_num_missing": 5.0,
        "ecg_ecg_ecg_mv_slope": (x.iloc[-1] - x.iloc[0]) / duration, "ecg_ecg_flat_std": 0.0, "ecg_ecg_flat_skew": None,
        "ecg_ecg_duration": duration, "ecg_ecg_sampling_rate_estimate": (n - 1) / duration, "ecg_ecg_sample_count": float(n),
        "ecg_signal_median": signal.median(), "eye_lslhtcviveeye_gaze_x_slope": (eye.gaze_x.iloc[-1] - eye.gaze_x.iloc[0]) / (n - 1),
        "eye_pupil_mean": eye.pupil_diameter_l.mean(), "eye_lslhtcviveeye_saccade_event_count": float(eye.saccadeseq[eye.saccadeseq >= 0].nunique()),
        "eye_lslhtcviveeye_saccade_event_rate": None,
    }
    for name, value in want.items():
        assert (got[name] is None) if value is None else got[name] == pytest.approx(value, rel=1e-9, abs=1e-12), name
    assert "ecg_ecg_text_mean" not in got and "eye_lslhtcviveeye_duration" not in got and "ecg_signal_peak_rate" in got


def test_no_files_give_no_rows(spark, tmp_path):
    put(tmp_path, "empty.csv", "")
    files, found = extraction.features(spark, str(tmp_path))
    assert files.count() == 0 and found.count() == 0
