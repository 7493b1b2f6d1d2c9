"""Truth tables of scalar and vector functions."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import names, numeric, special
from cohortloom.functions import vectors as hv


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_clean_name(spark):
    raw = ["Total Error (deg)", "  9-axis__ACC ", "###", "Éa b"]
    got = one(spark, *[names.clean_name(F.lit(x)) for x in raw])
    assert list(got) == ["total_error_deg", "c_9_axis_acc", "value", "a_b"]


def test_to_number(spark):
    got = one(spark, *[numeric.to_number(F.lit(x)) for x in ("1.5", "NaN", "-Infinity", "abc", " 2 ")])
    assert list(got) == [1.5, None, None, None, 2.0]


def test_ids_need_every_part(spark):
    full = "task-ils/sub-cp001/ses-20200101/level-03B_run-004"
    ids = names.extract_ids(F.lit(full))
    assert one(spark, ids["run_key"])[0] == "sub-cp001_ses-20200101_level-03B_run-004"
    assert one(spark, names.extract_ids(F.lit(full.replace("ses-", "x")))["run_key"])[0] == ""
    assert one(spark, names.level_number(F.lit("level-03B")))[0] == 3


@pytest.mark.parametrize(
    "name, modality",
    [("x_feat-perfmetric.csv", "performance"), ("sub_ecg_dat.csv", "ecg"), ("README.md", "license_or_metadata"), ("eye_head.csv", "unknown"), ("q.csv", "unknown"), ("task-ils_q.csv", "unknown")],
)
def test_name_classifier(spark, name, modality):
    assert one(spark, names.classify_name(F.lit(name))["modality"])[0] == modality


def test_columns_correct_the_broad_simulator_tag(spark):
    by_name = names.classify_name(F.lit("sub_lslxp11_dat.csv"))
    by_cols = names.classify_columns(F.array(F.lit("pilot_head_pitch_deg")))
    got = one(spark, names.resolve_modality(by_name, by_cols))[0]
    assert got.modality == "head_movement" and got.method == "csv_columns_overrode_broad_filename_keyword"


def test_longest_suffix_wins(spark):
    got = one(spark, names.split_statistic(F.lit("eye_x_sampling_rate_estimate")), names.split_statistic(F.lit("ecg_num_missing")))
    assert tuple(got[0]) == ("eye_x", "sampling_rate_estimate") and tuple(got[1]) == ("ecg", "num_missing")


def test_datenum(spark):
    got = one(spark, F.unix_micros(numeric.datenum_to_ts(F.lit(719530.5))))
    assert got[0] == 129600 * 1_000_000


def test_argmax_margin_runner_up(spark):
    tie = F.array(*[F.lit(x) for x in (0.5, 0.5, 0.2, -0.1)])
    other = F.array(*[F.lit(x) for x in (0.7, 0.2, 0.4, 0.1)])
    got = one(spark, numeric.argmax_low(tie), numeric.margin_and_runner_up(other, F.lit(0)), numeric.margin_and_runner_up(tie, F.lit(1)))
    assert got[0] == 0
    assert got[1].margin == pytest.approx(0.3) and got[1].runner_up == 2
    assert got[2].margin == 0 and got[2].runner_up == 0


def test_softmax_expectation(spark):
    s = np.array([0.1, 0.4, 0.3, -0.2])
    p = np.exp(s / 0.2) / np.exp(s / 0.2).sum()
    got = one(spark, numeric.softmax_expectation(F.array(*[F.lit(float(x)) for x in s]), 0.2))
    assert got[0] == pytest.approx(float(p @ [1, 2, 3, 4]))


def test_rounded_class_is_half_even(spark):
    got = one(spark, *[numeric.rounded_class(F.lit(x)) for x in (0.2, 1.5, 2.5, 3.5, 9.0)])
    assert list(got) == [0, 1, 1, 3, 3]


def test_gaze_on_an_axis(spark):
    d = lambda *v: numeric.gaze_2d(*[F.lit(float(x)) for x in v])
    got = one(spark, d(0, 1, 1), d(1, 1, 0), d(0, 0, 1))
    assert got[0].gaze_x == 0 and got[0].gaze_y == pytest.approx(800)
    assert got[1].gaze_x == pytest.approx(-720) and got[1].gaze_y == pytest.approx(1600)
    assert got[2].gaze_x is None


def test_ned_at_origin_and_one_degree_north(spark):
    lon, lat, alt = numeric.GLIDESLOPE_ORIGIN
    at = one(spark, numeric.geodetic_ned(F.lit(lat), F.lit(lon), F.lit(alt), numeric.GLIDESLOPE_ORIGIN))[0]
    assert abs(at.north) < 1e-6 and abs(at.east) < 1e-6 and abs(at.down) < 1e-6
    up = one(spark, numeric.geodetic_ned(F.lit(lat), F.lit(lon), F.lit(alt + 100), numeric.GLIDESLOPE_ORIGIN))[0]
    assert up.down == pytest.approx(-100, abs=1e-6)


def test_bind_and_bundle(spark):
    arr = lambda *v: F.array(*[F.lit(x).cast("tinyint") for x in v])
    got = one(
        spark, hv.bind(arr(1, -1, 1, -1), arr(-1, -1, 1, 1)),
        hv.sign_with_tie(F.zip_with(arr(1, 1, -1, -1), arr(1, -1, -1, 1), lambda a, b: (a + b).cast("int")), arr(-1, 1, -1, 1)),
    )
    assert got[0] == [-1, 1, 1, -1] and got[1] == [1, 1, -1, 1]


def test_sql_and_numpy_codebooks_agree_and_shorter_is_prefix(spark):
    long = hv.bipolar(42, "feature_identity", "x", 300)
    assert one(spark, hv.bipolar_column(F.lit(42), "feature_identity", F.lit("x"), 300))[0] == long.tolist()
    assert np.array_equal(hv.bipolar(42, "feature_identity", "x", 130), long[:130])
    assert abs(hv.bipolar(1, "a", "b", 10_000).mean()) < 0.05
    a = hv.published_bipolar(42, "feature_identity", "x", 500, "v1")
    assert np.array_equal(a[:100], hv.published_bipolar(42, "feature_identity", "x", 100, "v1")) and set(a) == {-1, 1}


def test_codebook_column_of_any_length_takes_one_step_a_digit(spark, capsys):
    rows = spark.createDataFrame([("a",), ("b|c",), (None,)], "id string")
    for dim in (1, 3, 5, 128, 131):
        df = rows.select("id", hv.bipolar_column(F.lit(7), "row", F.col("id"), dim).alias("hv"))
        for r in df.collect():
            assert r.hv == (hv.bipolar(7, "row", r.id, dim).tolist() if r.id else [-1] * dim)
        df.explain()
        assert "POWER" not in capsys.readouterr().out.upper()  # before, powers and divisions for every coordinate


def test_level_codebook_flips_in_steps():
    book = hv.level_codebook(42, 5, 40)
    changed = [int((book[i] != book[i + 1]).sum()) for i in range(4)]
    assert changed == [5, 5, 5, 5]
    assert int((book[0] != book[-1]).sum()) == 20


def test_tail_functions():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)
    assert special.t_quantile_value(0.95, 10) == pytest.approx(1.8124611228, abs=1e-6)
    assert special.t_quantile_value(0.95, 1) == pytest.approx(6.313751515, abs=1e-5)


def test_signed_rank_p_matches_enumeration():
    n, w = 8, 5
    sums = [sum((i + 1) * ((m >> i) & 1) for i in range(n)) for m in range(2**n)]
    want = min(1.0, 2 * np.mean([s <= w for s in sums]))
    assert special.signed_rank_p(w, n, 0, 0) == pytest.approx(want)
    rough = math.erfc(abs(200 - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24) / math.sqrt(2))
    assert special.signed_rank_p(200, 60, 0, 0) == pytest.approx(rough)
