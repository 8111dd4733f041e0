"""Reference examples against the plain greedy choice over all records, the gate's three modes, and policy grids row by row."""
import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from spindlewatch.functions.names import ROOT_CAUSES
from spindlewatch.operators import gate, policygrid, references

EXAMPLES = "disk string, day date, n_rows int, root_cause string, confidence double, risk_hint double, events array<string>"
DAY = datetime.date(2014, 8, 1)


def score(r):
    return round(0.55 * r[4] + 0.35 * r[5] + 0.10 * (min(3, len(r[6])) / 3.0), 9)


def plain(rows, per_cause, min_known):
    """All records, one pick after the other."""
    pool = sorted(rows, key=lambda r: (-score(r), r[0], r[1]))
    disks, days, out = set(), set(), []

    def pick(items, n):
        items, got = list(items), []
        for _ in range(n):
            if not items:
                break
            best = max(items, key=lambda r: (score(r) + ((0.05 if r[0] not in disks else 0.0) + (0.03 if r[1] not in days else 0.0)), -items.index(r)))
            items.remove(best)
            disks.add(best[0])
            days.add(best[1])
            got.append(best)
        return got

    for cause in ROOT_CAUSES:
        out += pick([r for r in pool if r[3] == cause and r[2] >= 3], per_cause)
    if not out:
        out += pick(pool, per_cause)
    known = sum(r[3] != "unknown" for r in out)
    for r in pick([r for r in pool if r[3] != "unknown"], max(0, min_known - known)):
        if r not in out:
            out.append(r)
    return [(r[0], r[1], r[3]) for r in out]


@pytest.mark.parametrize("seed, disks, days, per_cause, min_known", [(1, 3, 40, 1, 3), (2, 60, 2, 2, 14), (3, 12, 12, 3, 0), (4, 4, 4, 1, 30)])
def test_greedy_choice_needs_few_candidates(spark, seed, disks, days, per_cause, min_known):
    rng = random.Random(seed)
    keys = rng.sample(list(itertools.product(range(disks), range(days))), min(disks * days, 110))
    rows = [(f"d{d}", DAY + datetime.timedelta(t), rng.choice([1, 3, 30]), rng.choice(ROOT_CAUSES[:4] + ["unknown"] * 2), rng.choice([0.9, 0.88, 0.5]), rng.choice([0.8, 0.7]), ["e"] * rng.randint(0, 4)) for d, t in keys]
    found = references.diverse_references(spark.createDataFrame(rows, EXAMPLES).repartition(4), per_cause, 1, min_known).orderBy("pick").collect()
    assert [(r["disk"], r["day"], r["root_cause"]) for r in found] == plain(rows, per_cause, min_known)


def test_candidates_are_bounded(spark):
    """Very many records of one disk, one day and one score leave at most 4P² + 4P of a pool."""
    rows = spark.range(3_000).select(F.concat(F.lit("d"), F.col("id") % 50).alias("disk"), F.date_add(F.lit(DAY), (F.col("id") / 50).cast("int")).alias("day"), F.lit(30).alias("n_rows"), F.lit("media").alias("root_cause"), F.lit(0.9).alias("confidence"), F.lit(0.5).alias("risk_hint"), F.array(F.lit("e")).alias("events"))
    few = references.candidates(references.distinct_examples(rows), 4)
    assert few.groupBy("pool").count().agg(F.max("count")).first()[0] <= 4 * 16 + 16
    assert few.groupBy("pool", "disk").count().agg(F.max("count")).first()[0] <= 4


def test_quality_of_references(spark):
    """One window per cause, two disks, two known causes asked for."""
    rows = [(f"d{i % 2}", DAY + datetime.timedelta(9 + i), 30, cause, 0.9, 0.8, ["e"]) for i, cause in enumerate(["media", "interface", "temperature", "power", "unknown"])]
    examples = spark.createDataFrame(rows, EXAMPLES)
    quality = {r["cause"]: r for r in references.reference_quality(examples, references.diverse_references(examples, 1, 1, 2)).collect()}
    assert quality["media"]["selected"] >= 1 and quality["unknown"]["selected"] >= 1 and quality["media"]["selected_examples"] >= 2
    assert quality["media"]["known_ratio"] == 0.8 and quality["workload"]["missing"] and not quality["unknown"]["missing"]


def test_odd_records(spark):
    """Repeated keys count once, unknown spellings are unknown but count as known when filling up; short windows serve only if no others do."""
    rows = [("a", DAY, 30, "Media ", 0.9, 0.9, ["e"]), ("a", DAY, 30, "media", 0.1, 0.1, []), ("b", DAY, 30, "strange", 0.5, 0.5, []), (None, None, 30, "power", None, 0.4, None)]
    found = references.diverse_references(spark.createDataFrame(rows, EXAMPLES), 1, 1, 4).orderBy("pick").collect()
    assert [(r["disk"], r["root_cause"], r["phase"]) for r in found] == [("a", "media", "cause"), (None, "power", "cause"), ("b", "unknown", "cause")]
    short = spark.createDataFrame([("a", DAY, 1, "media", 0.9, 0.9, []), ("b", DAY, 2, "power", 0.9, 0.1, [])], EXAMPLES)
    assert [(r["disk"], r["phase"]) for r in references.diverse_references(short, 1, 1, 0).collect()] == [("a", "any")]
    assert references.diverse_references(short.where("false")).count() == 0


def test_gate_modes(spark):
    given = spark.createDataFrame([("unknown",), (None,)], "root_cause string")
    got = {(r["profile"], r["mode"]): (r["missing"], r["used"]) for r in references.gate_decisions(given, {"x": ["media", "unknown", "media"], "y": ["unknown"]}).collect()}
    assert got == {("x", "auto"): ("media", 0), ("x", "off"): ("media", 0), ("x", "force"): ("media", 2), ("y", "auto"): ("", 2), ("y", "off"): ("", 0), ("y", "force"): ("", 2)}
    with pytest.raises(ValueError):
        references.gate_decisions(given, {"x": ["weather"]})


def test_policy_grid_row_by_row(spark):
    rng = random.Random(5)
    rows = [(DAY + datetime.timedelta(rng.randint(0, 3)), rng.randint(0, 1), rng.randint(0, 1), *[rng.choice([None, 0.0, 0.3, 0.5, 0.55, 0.6, 0.7, 0.9, 1.0]) for _ in range(3)], rng.choice([None, True, False]), rng.choice([*ROOT_CAUSES, None])) for _ in range(400)]
    trace = spark.createDataFrame(rows, "eval_day date, true_class int, pred_class int, llm_q_score double, llm_mapped_event_ratio double, risk_hint double, llm_rule_match boolean, root_cause string")
    got = {r["tag"]: r for r in policygrid.policy_grid(trace, policygrid.ROUND_POLICIES, 0.5).collect()}
    for p in policygrid.ROUND_POLICIES:
        failed, days = {}, {}
        dims = gate.keep_dims(p["keep"], 1 << 30)
        for day, true, pred, q, ratio, risk, match, root in rows:
            root = root or "unknown"
            why = (
                "root_unknown" if p["drop_unknown"] and root == "unknown" else "root_cause" if p["allowed"] and root not in p["allowed"] else "q" if (q or 0) < p["q"]
                else "rule" if p["rule"] and not match else "map" if (ratio or 0) < p["map"] else "none"
            )
            failed[why] = failed.get(why, 0) + 1
            warned = pred == 1 or (why == "none" and (dims is None or 6 in dims) and p["alpha"] * (risk or 0) >= 0.5)
            days.setdefault(day, []).append((true, warned))
        mean = lambda f: 100 * sum(map(f, days.values())) / len(days)
        recall = mean(lambda d: sum(t and w for t, w in d) / max(1, sum(t for t, _ in d)))
        acc = mean(lambda d: sum(bool(t) == w for t, w in d) / len(d))
        r = got[p["tag"]]
        assert (r["rows"], r["kept"], *[r[f"failed_{g}"] for g in policygrid.GATES]) == (400, failed.get("none", 0), *[failed.get(g, 0) for g in policygrid.GATES])
        assert abs(r["recall"] - recall) < 1e-9 and abs(r["acc"] - acc) < 1e-9
    best = policygrid.best_policy(policygrid.policy_grid(trace, policygrid.ROUND_POLICIES, 0.5)).first()
    assert best["recall"] == max(r["recall"] for r in got.values() if r["pass_acc_guard"] or not any(x["pass_acc_guard"] for x in got.values()))


def test_cube_does_not_grow_with_the_grid(spark):
    rows = spark.range(5_000).select(F.lit(DAY).alias("eval_day"), (F.col("id") % 2).cast("int").alias("true_class"), F.lit(0).alias("pred_class"), *[(F.col("id") % 97 / 97).alias(c) for c in ("llm_q_score", "llm_mapped_event_ratio", "risk_hint")], F.lit(True).alias("llm_rule_match"), F.lit("media").alias("root_cause"))
    many = [{**policygrid.ROUND_POLICIES[1], "tag": f"p{i}"} for i in range(50)]
    cube, _ = policygrid.policy_cube(rows, many, 0.5, [], "eval_day")
    assert cube.count() <= 2 * 2 * 2 * 2 and policygrid.policy_grid(rows, many).count() == 50


def test_ratio_statistics_are_nested(spark):
    rows = spark.range(4_000).select((F.col("id") % 40 == 0).cast("int").alias("label"), (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 1_000 / 1_000).alias("u"))
    got = {(r["ratio"], r["label"]): (r["rows"], r["s0"]) for r in policygrid.ratio_statistics(rows, "label", ["x"], [10, 8, 12], F.col("u")).collect()}
    odds = 100 / 3_900
    for d in (8, 10, 12):
        drawn = [i for i in range(4_000) if i % 40 and i % 1_000 / 1_000 < odds * d]
        assert got[d, 0] == (len(drawn), sum(i % 13 for i in drawn)) and got[d, 1][0] == 100
