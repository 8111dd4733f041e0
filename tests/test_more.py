"""Budgets, measures per window, day files, sketches and reports against plain Python."""
import datetime
import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlewatch.operators import answers, budgets, metrics, models, policygrid, quality, sketches, window_measures
from spindlewatch.plans import answers_plan, more_plan, quality_plan
from spindlewatch.sources import days, writers


def chunked(rows, chunk_rows, parts, budget, step, moves, initial, value):
    """One row after the other; the threshold stands still within a chunk."""
    state = {p: {"t": 1.0, "spent": 0, "counted": 0, "turn": 0} for p in range(parts)}
    queried = {}
    for c in range(0, len(rows), chunk_rows):
        for p in range(parts):
            own, s = [r for r in rows[c : c + chunk_rows] if r[0] % parts == p], state[p]
            if not own:
                continue
            asked = set()
            if s["turn"] < initial:
                asked = {r[0] for r in own}
            else:
                allowed = s["counted"] == 0 or s["spent"] / s["counted"] < budget
                asked = {r[0] for r in own if allowed and value(r) < s["t"]}
                s["spent"] += len(asked)
                s["counted"] += len(own)
                if moves and allowed:
                    s["t"] = min(10.0, max(1e-6, s["t"] * (1 - step) ** len(asked) * (1 + step) ** (len(own) - len(asked))))
            s["turn"] += 1
            queried.update({r[0]: r[0] in asked for r in own})
    return queried


@pytest.mark.parametrize("strategy, initial", [("fixed", 0), ("variable", 0), ("variable", 2), ("randomised", 0), ("selective", 1)])
def test_budget_feeds_back(spark, strategy, initial):
    rng = random.Random(4)
    rows = [(i, rng.choice([0.5, 0.61, 0.7, 0.85, 0.9, 0.99, 1.0])) for i in range(1_200)]
    df = spark.createDataFrame([(i, p, 7, 8) for i, p in rows] + [(5_000, None, 7, 8)], "id long, posterior double, part long, chunk long").drop("part", "chunk")
    values, moves = budgets.strategies(F.coalesce(F.col("posterior"), F.lit(0.0)), 2, ["id"], 0.3, 0.8, 1)[strategy]
    seen = {r["id"]: r["v"] for r in df.select("id", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.round(values * 1_000) / 1_000)).alias("v")).collect()}
    got, chunks = budgets.with_budget(df, "id", F.col("posterior"), F.col("id") % 3, 90, strategy, 0.3, 0.8, 0.005, 2, initial)
    want = chunked([*rows, (5_000, None)], 90, 3, 0.3, 0.005, moves, initial, lambda r: seen[r[0]])
    found = {r["id"]: r["queried"] for r in got.collect()}
    assert found == want and 0.1 < sum(found.values()) / len(found) < 0.6
    last = chunks.groupBy("part").agg(F.max("asked").alias("asked"), F.max("seen").alias("seen")).collect()
    assert sum(r["seen"] for r in last) == 1_201 and sum(r["asked"] for r in last) == sum(want.values())


def test_measures_per_window(spark):
    rows = [(0, "a", 1), (0, "a", 1), (0, "a", 2), (0, "b", 2), (0, "b", 2), (1, "a", 5), (1, "b", 6), (2, "a", 7), (2, None, 7)]
    df = spark.createDataFrame([(w, {"a": 1, "b": 2}.get(k), c, [float(c), 1.0]) for w, k, c in rows], "window long, cluster long, class long, vector array<double>").withColumn("d2", F.lit(0.5))
    got = {r["window"]: r for r in window_measures.count_measures(df, "window").collect()}
    assert (got[0]["n"], got[1]["n"], got[2]["n"]) == (5, 2, 1)
    assert np.isclose(got[0]["purity"], (2 / 3 + 1) / 2) and np.isclose(got[0]["f1_p"], (0.8 + 0.8) / 2) and np.isclose(got[0]["rand"], 6 / 10) and np.isclose(got[0]["van_dongen"], 8 / 10)
    h_c = -(0.4 * math.log(0.4) + 0.6 * math.log(0.6))
    h_ck = -(2 / 5 * math.log(2 / 3) + 1 / 5 * math.log(1 / 3))
    assert np.isclose(got[0]["homogeneity"], 1 - h_ck / h_c) and got[1]["v_measure"] == got[1]["purity"] == got[2]["rand"] == got[2]["homogeneity"] == 1.0
    space = {r["window"]: r for r in window_measures.space_measures(df.where("cluster IS NOT NULL"), "window", "vector", 2).collect()}
    assert np.isclose(space[0]["bss"], 3 * (4 / 3 - 1.6) ** 2 + 2 * 0.4**2) and np.isclose(space[0]["bss_gt"], 2 * 0.6**2 + 3 * 0.4**2) and space[2]["bss_ratio"] is None and space[0]["ssq"] == 2.5


def write(folder, name, text):
    (folder / name).write_text(text)


def test_day_source(spark, tmp_path):
    write(tmp_path, "2014-08-01.csv", "date,serial_number,model,failure,smart_5_raw,smart_9_raw\n2014-08-01,A,m1,0,1,2.5\n2014-08-01,B,m2,1,,nan\n")
    write(tmp_path, "2014-08-02.csv", 'r_9,model,serial_number,date,failure,extra\n7,"m1",A,2014-08-02,x,"q, ""z"""\n')
    write(tmp_path, "2014-08-03.csv", "date,serial_number,model,failure,smart_5_raw,smart_9_raw\n")
    read = lambda n=3, **more: days.read_days(spark, str(tmp_path), "2014-08-01", n, ["smart_5_raw", "smart_9_raw"], **more)
    day = datetime.date(2014, 8, 1)
    want = [("A", day, "m1", 0, 1.0, 2.5), ("A", day + datetime.timedelta(1), "m1", 0, None, 7.0), ("B", day, "m2", 1, None, None)]
    assert sorted(map(tuple, read().collect()), key=str) == sorted(want, key=str)
    assert [tuple(r) for r in read(models=["m2"]).collect()] == [want[2]]
    with pytest.raises(Exception, match="no file of 2014-08-04"):
        read(4).count()
    assert [tuple(r) for r in read(4).where("day = date'2014-08-02'").collect()] == [want[1]]  # the missing day is not opened
    assert read(9).where("day < date'2014-08-03' AND day >= date'2014-08-02' AND model = 'm1'").count() == 1


def test_planning_starts_no_job(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    days.read_days(spark, str(tmp_path / "absent"), "2000-01-01", 4_000, ["smart_5_raw"]).where("day > date'2010-01-01'").schema
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setJobGroup("others", "")


def test_ssd_files(spark, tmp_path):
    write(tmp_path, "20180103.csv", "disk_id,ds,model,n_5,r_5\n1,20180103,MC1,3,4\n2,20180103,MC1,\\N,4\n3,20180103,MA1,1,2\n")
    got = days.read_days(spark, str(tmp_path), "2018-01-03", 1, ["smart_5_normalized", "smart_5_raw"], "ssd", ["MC1"]).collect()
    assert [tuple(r) for r in got] == [("s1", datetime.date(2018, 1, 3), "MC1", 0, 3.0, 4.0)]


def test_day_files_are_written_by_day(spark, tmp_path):
    rows = spark.range(600).select(F.date_add(F.lit("2020-02-27").cast("date"), (F.col("id") % 4).cast("int")).alias("date"), F.concat(F.lit('d, "'), "id").alias("serial_number"), F.lit("m").alias("model"), F.lit(0).alias("failure"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("smart_5_raw"))
    told = writers.write_day_files(rows, str(tmp_path / "out")).collect()
    assert sorted((str(r["day"]), r["rows"]) for r in told) == [(f"2020-0{d}", 150) for d in ("2-27", "2-28", "2-29", "3-01")]
    back = days.read_days(spark, str(tmp_path / "out"), "2020-02-27", 4, ["smart_5_raw"])
    assert back.count() == 600 and back.agg(F.sum("smart_5_raw")).first()[0] == sum(i / 2 for i in range(600) if i % 3) and back.where("disk = 'd, \"17'").count() == 1


def test_sketches_merge(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(int(d), float(x)) for d in range(20) for x in rng.lognormal(d / 5, 1, 400)]
    df = spark.createDataFrame(data + [(3, None), (3, float("nan"))], "day long, x double")
    stored = sketches.daily_sketches(df, "day", ["x"])
    stored.write.parquet(str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    for lo, hi in ((0, 19), (5, 11), (3, 3)):
        values = np.array([x for d, x in data if lo <= d <= hi])
        for r in sketches.quantiles(sketches.merged(back.where(F.col("day").between(lo, hi)), ["feature"]), [0.01, 0.25, 0.5, 0.99]).collect():
            assert r["n"] == len(values) and abs((values <= r["quantile"]).mean() - r["prob"]) <= sketches.RANK_ERROR + 1 / len(values)


def test_regression_run_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", None), ("c", 2.0)], "run string, avg_err_days double")
    got = {r["run"]: tuple(r)[1:] for r in metrics.regression_run_summary(df, by=["run"]).collect()}
    assert got == {"a": (2, 2.0, math.sqrt(2), 3.0, 1.0), "b": (0, None, None, None, None), "c": (1, 2.0, None, 2.0, 2.0)}


def test_backfill(spark):
    weights = spark.createDataFrame([("SMART_9", 0.5), ("SMART_5", 1.2), ("SMART_199", 1.2), ("SMART_1", None)], "sensor string, weight double")
    ranked = spark.createDataFrame([("a", "SMART_7", 1), ("a", "SMART_9", 2), ("b", "SMART_5", 1)], "model string, sensor string, rank int")
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")

    def run(least, most, seeds=("SMART_194", "SMART_5")):
        out = {}
        for r in quality.backfill_event_features(ranked, models, weights, list(seeds), least, most).orderBy("model", "rank").collect():
            out.setdefault(r["model"], []).append(int(r["sensor"][6:]))
        return out

    assert run(0, 0) == {"a": [7, 9], "b": [5], "c": [5, 199, 9]}
    assert run(4, 0) == {"a": [7, 9, 5, 199], "b": [5, 199, 9, 194], "c": [5, 199, 9, 194]}
    assert run(4, 2) == {"a": [7, 9], "b": [5, 199], "c": [5, 199]}


def test_day_files_of_some_models_in_a_fresh_worker(tmp_path):
    (tmp_path / "20240101.csv").write_text("ds,model,disk_id,r_5\n20240101,mc1,1,2.5\n20240101,other,2,3.5\n")
    code = f"""
import datetime
from pyspark.sql.datasource import EqualTo
from pyspark.sql.types import StringType, StructField, StructType
from spindlewatch.sources.days import DayReader
schema = StructType([StructField(c, StringType()) for c in ("day", "disk", "model", "failure", "smart_5_raw")])
reader = DayReader({{"kind": "ssd", "path": {str(tmp_path)!r}, "start": "2024-01-01", "days": "1"}}, schema)
list(reader.pushFilters([EqualTo(("model",), "mc1")]))
print([r for p in reader.partitions() for b in reader.read(p) for r in b.column(1).to_pylist()])
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "['1']", done.stderr


def test_few_groups_do_not_deal_the_rows(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("x"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = models.odds_ratio_anomaly(rows, ["x"], by=["g"])
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out.count() == 1000


def test_texts_are_read_once_for_rules_that_differ_in_gates(spark, sf):
    parsed = answers_plan.parsed(spark, sf)
    strict, loose = answers_plan.RULES, answers.AnswerRules(rule_gate=0.9, rule_soft_gate=0.3, quality_gate=0.2, strict_types=True)
    ready = answers.prepare(parsed, answers_plan.MAPPING, strict)
    for rules in (strict, loose):
        want, got = answers.normalize(parsed, answers_plan.MAPPING, rules), answers.blend(ready, rules)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for query in (more_plan.q_gate_sweep, quality_plan.q_transitions):
        assert "regexp_extract" not in query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_failed_summaries_split_a_text_once(spark, sf):
    plan = more_plan.q_failed_summaries(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # the lines of a text, and the cells of a row


def test_references_are_written_once(spark, sf):
    rows = spark.createDataFrame([("ALLOWED_EVENT_FEATURES: SMART_5",), ("",), (None,)], "text string")
    refs = F.array(*[F.struct(F.lit(t).alias("summary_text"), F.lit(j).alias("target_json")) for t, j in (("ALLOWED_EVENT_FEATURES: SMART_9", "{}"), ("", "{}"), ("x", None))])
    template = "{summary} {allowed_features}"
    each = answers.prompt_messages(F.col("text"), refs, "s", template)
    once = answers.prompt_messages(F.col("text"), answers.reference_messages(refs, template), "s", template, written=True)
    got = rows.select(each.alias("a"), once.alias("b")).collect()
    assert all(r.a == r.b and len(r.a) == 4 for r in got) and got[0].a[1].content == "ALLOWED_EVENT_FEATURES: SMART_9 SMART_9"
    assert answers_plan.q_messages(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("assistant") == 1


def test_window_measures_are_stored_apart(spark, sf):
    plan = more_plan.q_window_clusters(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_words_of_any_frequency_are_scored_alike(spark, monkeypatch):
    rows = [(1, "a a b", "x"), (2, "a c c c", "y"), (3, "b b a rare", "x"), (4, "c", "y"), (4, "a", "y"), (None, "c b", None), (5, "", "x"), (6, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = []
    for share in (1, 3, 100_000):  # all words shuffled, some, none
        monkeypatch.setattr(models, "COMMON_WORDS", share)
        got.append(sorted(map(tuple, models.multinomial_bayes(docs, "doc_id", "text", "lang").collect()), key=str))
    assert got[0] == got[1] == got[2] and [r[0] for r in got[0]] == [1, 2, 3, 4, None]


def test_policies_meet_a_spread_cube(spark):
    rows = [(i % 5, i % 2, i % 3 == 0, 0.1 * (i % 10), 1.0, True, 0.5, "media") for i in range(50)]
    trace = spark.createDataFrame(rows, "eval_day int, true_class int, p boolean, llm_q_score double, llm_mapped_event_ratio double, llm_rule_match boolean, risk_hint double, root_cause string")
    trace = trace.withColumn("pred_class", F.col("p").cast("int"))
    grid = policygrid.policy_grid(trace, policygrid.ROUND_POLICIES)
    assert "RepartitionByExpression" in grid._jdf.queryExecution().optimizedPlan().toString()
    assert {r["rows"] for r in grid.collect()} == {50}


def test_caches_read_window_texts_that_are_not_stored(spark, sf, monkeypatch):
    """Variant and confusion store one table, the cache without texts; the rules' cause comes from it."""
    from spindlewatch.plans import answers_plan, quality_plan, windows_plan

    stored = []
    for plan in (answers_plan, windows_plan):
        monkeypatch.setattr(plan, "cut_lineage", lambda df: stored.append(df.columns) or df)
    answers_plan.q_variant(spark, sf)
    quality_plan.q_confusion(spark, sf)
    assert [("z" in c, "target" in c) for c in stored] == [(True, False), (True, True)]


def test_inactive_sensors_get_no_text_but_severity(spark, sf):
    from spindlewatch.operators import summary
    from spindlewatch.plans import windows_plan

    rows = summary.with_text(windows_plan.stats_of(spark, sf).where("n > 0")).groupBy("active").agg(
        F.count(F.lit(1)).alias("n"), F.count("t_sev").alias("sev"), *[F.count(c).alias(c) for c in ("t_line", "t_table", "t_trend", "t_delta", "t_burst")]
    ).collect()
    assert {r["active"] for r in rows} == {True, False}
    for r in rows:
        assert r["sev"] == r["n"] and all(r[c] == (r["n"] if r["active"] else 0) for c in ("t_line", "t_table", "t_trend", "t_delta", "t_burst"))


def test_safe_double_names_its_input_once(spark):
    from spindlewatch.functions.scalars import safe_double

    df = spark.createDataFrame([("1.5",), ("NaN",), (None,), ("x",), ("Infinity",)], "a string")
    out = df.select(safe_double(F.upper("a"), 0.0).alias("v"), safe_double(F.col("a")).alias("w"), safe_double(F.col("a"), finite=True).alias("f"))
    assert [tuple(r) for r in out.collect()] == [(1.5, 1.5, 1.5), (0.0, None, None), (0.0, None, None), (0.0, None, None), (float("inf"), float("inf"), None)]
    assert df.select(safe_double(F.upper("a"), 0.0).alias("v"))._jdf.queryExecution().analyzed().toString().count("upper(a") == 1


def test_lines_end_as_before(spark):
    from spindlewatch.functions import parse

    df = spark.createDataFrame([(" a \r\nb\n\r\n c\r\r\n",), ("",), (None,), ("\n",)], "t string")
    assert [r["l"] for r in df.select(parse.lines_of(F.col("t")).alias("l")).collect()] == [["a", "b", "", "c\r", ""], [""], [""], ["", ""]]


def test_pairs_are_not_joined(spark, sf):
    """A window's truth and answer are in one row of the stored cache."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    pairs = quality_plan.pairs(spark, sf)
    assert "Join" not in plan(pairs) and pairs.count() > 0


def test_a_cache_read_once_is_not_stored(spark, sf, monkeypatch):
    from spindlewatch.plans import policy_plan

    stored = []
    monkeypatch.setattr(answers_plan, "cut_lineage", lambda df: stored.append(df) or df)
    policy_plan.judged(spark, sf)
    assert stored == []
