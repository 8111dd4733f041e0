import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindlewatch.functions import names, parse
from spindlewatch.functions.scalars import fixed_sql, parse_day, round_half_even, safe_double, to_bool


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("digits", [1, 2, 3, 4])
def test_rounding_is_exact(spark, digits):
    values = [0.125, 0.835, 2.675, 1.005, 0.5, 1.5, 2.5, -0.125, -0.04, 12.345, 99.995, 0.0, 1 / 3, 1e-9, 123456.785, 0.00005]
    assert column(spark, values, "double", round_half_even(F.col("x"), digits)) == [round(v, digits) for v in values]
    assert column(spark, values, "double", F.expr(fixed_sql("x", digits))) == [f"{v:.{digits}f}" for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=20, max_size=200))
def test_rounding_property(spark, values):
    values = [v + 0.0 for v in values] + [k / 8 for k in range(-20, 20)] + [k / 1000 for k in range(0, 2000, 5)]
    assert column(spark, values, "double", F.expr(fixed_sql("x", 2, True))) == [f"{v:+.2f}" for v in values]


def test_canonical_names(spark):
    cases = {"r_5": "smart_5_raw", "raw_5": "smart_5_raw", "smart5raw": "smart_5_raw", "SMART_5_RAW": "smart_5_raw", "n_199": "smart_199_normalized",
             "norm-7": "smart_7_normalized", "smart 9": "smart_9_raw", "smart_05_n": "smart_5_normalized", "other Name": "other_name", "": ""}
    assert column(spark, list(cases), "string", names.canonical_feature(F.col("x"))) == list(cases.values())
    assert [names.canonical_name(c) for c in cases] == list(cases.values())
    assert names.resolve_columns(["r_5", "smart_5", "smart_5_raw", "raw_5"])["smart_5_raw"] == "smart_5_raw"
    assert names.resolve_columns(["raw_5", "r_5"])["smart_5_raw"] == "r_5"


def test_vocabularies(spark):
    assert column(spark, ["Media", "media|power", "media, media", None, "x"], "string", names.normalize_cause_list(F.col("x"))) == [
        "media", "unknown", "media", "unknown", "unknown"]
    assert column(spark, ["going UP", "burst", "slow down", "upspike", "?", None], "string", names.event_type(F.col("x"))) == [
        "monotonic_increase", "spike", "drop", "monotonic_increase", "", ""]
    assert column(spark, ["smart-5 raw", "media", "temp", "SMART 199"], "string", names.event_feature(F.col("x"), ["SMART_197"])) == [
        "SMART_5", "SMART_197", "TEMP", "SMART_199"]
    assert column(spark, ["AB-12 x", "", "12345678901234567890"], "string", names.mask_disk_id(F.col("x"))) == ["AA_NN_A", "none", "N" * 16]
    assert column(spark, ["ST4000", "WDC x", "mc1", "HGST"], "string", names.infer_vendor(F.col("x"))) == ["seagate", "wd", "alibaba", "hitachi"]


def test_scalars(spark):
    assert column(spark, ["1.5", "x", None, "NaN"], "string", safe_double(F.col("x"), 0.0)) == [1.5, 0.0, 0.0, 0.0]
    assert column(spark, ["yes", "Off", "?", None], "string", to_bool(F.col("x"), True)) == [True, False, True, True]
    assert [str(d) for d in column(spark, ["2024-01-02", "20240102", "nope"], "string", parse_day(F.col("x")))] == ["2024-01-02", "2024-01-02", "None"]


def test_table_parsing(spark):
    text = "A: 1\nANOMALY_TABLE:\n- feat=SMART_5|persistence=0.72|slope14=+0.012|burst_ratio=1.25|severity=0.90\n- feat=media|severity=2\nCAUSE: x\n- feat=SMART_9"
    row = column(spark, [text], "string", parse.anomaly_table(parse.lines_of(F.col("x"))))[0]
    assert [(r.feature, r.persistence, r.trend_delta, r.severity) for r in row] == [("SMART_5", 0.72, 0.012, 0.9), ("SMART_5", 0.0, 0.0, 1.0)]
    assert column(spark, [text], "string", parse.allowed_features(parse.lines_of(F.col("x"))))[0] == ["SMART_5", "SMART_9"]
    assert column(spark, ["ALLOWED_EVENT_FEATURES: none"], "string", parse.allowed_features(parse.lines_of(F.col("x"))))[0] == []


def test_fixed_text_of_a_decimal_equals_printf(spark):
    values = [0.0, -0.0, 0.005, -0.005, 0.125, -0.125, 2.675, -1e-9, 99.995, 123456789012.345, 999999999999.995, 1e12, -1e300]
    df = spark.createDataFrame([(v,) for v in [*values, float("inf"), None]], "x double")
    for digits in (1, 2, 3):
        got = [r[0] for r in df.selectExpr(f"{fixed_sql('x', digits)} AS t").collect()]
        assert got == [*[f"{v:.{digits}f}" if v != -1e300 else df.selectExpr(f"format_string('%.{digits}f', -1e300D)").first()[0] for v in values], "Infinity", "null"]
    assert "decimal" in fixed_sql("x", 2) and "decimal" in fixed_sql("x", 3, True)
