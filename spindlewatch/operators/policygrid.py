"""Grids of gate policies and of sampling ratios with vote thresholds.

A row needs to be seen once, however large the grid: policies differ in thresholds, so a row is reduced to the largest threshold it reaches
of each kind and counted. A policy then names the first gate that a whole cell of this cube fails, and the cube, a few rows per day, fans
out over the policies. Sampling ratios are nested (a row drawn for a small ratio is drawn for a larger one), so the statistics of all
ratios are running sums over one pass.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.names import normalize_cause_list
from spindlewatch.functions.scalars import clip01, safe_double, to_bool
from spindlewatch.operators.gate import keep_dims
from spindlewatch.operators.guards import best_rows
from spindlewatch.operators.metrics import COUNTS, simple_metrics
from spindlewatch.operators.models import log_density
from spindlewatch.operators.windows import stage

# The policies that a round tries (tag, q, rule, map, alpha, keep, drop_unknown, allowed) and its pairs of ratio and threshold.
ROUND_POLICIES = [
    {"tag": "strict_070_r1_m60_a08_top8", "q": 0.70, "rule": True, "map": 0.60, "alpha": 0.8, "keep": "event_top8_plus_meta", "drop_unknown": True, "allowed": ["power", "temperature", "media"]},
    {"tag": "mid_050_r1_m30_a08_top8", "q": 0.50, "rule": True, "map": 0.30, "alpha": 0.8, "keep": "event_top8_plus_meta", "drop_unknown": True, "allowed": ["power", "temperature", "media"]},
    {"tag": "open_000_r0_m00_a10_all", "q": 0.00, "rule": False, "map": 0.00, "alpha": 1.0, "keep": "all", "drop_unknown": False, "allowed": []},
    {"tag": "open_000_r0_m00_a10_top8", "q": 0.00, "rule": False, "map": 0.00, "alpha": 1.0, "keep": "event_top8_plus_meta", "drop_unknown": False, "allowed": []},
    {"tag": "open_000_r0_m00_a10_top3", "q": 0.00, "rule": False, "map": 0.00, "alpha": 1.0, "keep": "event_top3_plus_meta", "drop_unknown": False, "allowed": []},
    {"tag": "open_000_r0_m00_a10_evt8", "q": 0.00, "rule": False, "map": 0.00, "alpha": 1.0, "keep": "16,34,46,25,31,55,28,37", "drop_unknown": False, "allowed": []},
]
ROUND_RATIOS = [(10, 0.5), (12, 0.5), (8, 0.5), (10, 0.5002), (10, 0.4998), (12, 0.5002), (12, 0.4998)]
GATES = ["root_unknown", "root_cause", "q", "rule", "map"]
RISK_DIM = 6


def _reached(value: str, thresholds: list[float]) -> str:
    """How many of the rising thresholds a value reaches."""
    return " + ".join([f"if({value} >= {t!r}D, 1, 0)" for t in thresholds]) or "0"


def _policy_rows(policies: list[dict], qs: list[float], maps: list[float], alphas: list[float]) -> str:
    """Policies as a literal array of structs; a threshold is its place among those of its kind."""
    rows = []
    for i, p in enumerate(policies):
        dims = keep_dims(p["keep"], 1 << 30)
        causes = ", ".join(f"'{c}'" for c in p["allowed"])
        rows.append(
            f"named_struct('policy', {i}, 'tag', '{p['tag']}', 'need_q', {sum(q <= p['q'] for q in qs) if p['q'] > 0 else 0}, 'need_map', {sum(m <= p['map'] for m in maps) if p['map'] > 0 else 0}, "
            f"'need_rule', {str(bool(p['rule'])).lower()}, 'no_unknown', {str(bool(p['drop_unknown'])).lower()}, 'allowed', cast(array({causes}) AS array<string>), "
            f"'strong', {alphas.index(p['alpha'])}, 'sees_risk', {str(dims is None or RISK_DIM in dims).lower()})"
        )
    return "array(" + ", ".join(rows) + ")"


def policy_cube(trace: DataFrame, policies: list[dict], trigger: float, by: list[str], day: str) -> tuple[DataFrame, str]:
    """The counts of the cube and the policies as SQL text. trace has true_class, pred_class and the signals; nulls count as zero, no match, unknown."""
    qs, maps = (sorted({p[k] for p in policies if p[k] > 0}) for k in ("q", "map"))
    alphas = sorted({p["alpha"] for p in policies})
    num = lambda c: clip01(safe_double(F.col(c), 0.0))
    signals = {"_q": num("llm_q_score"), "_map": num("llm_mapped_event_ratio"), "_risk": num("risk_hint"), "_match": F.coalesce(to_bool(F.col("llm_rule_match")), F.lit(False)), "_root": normalize_cause_list(F.coalesce("root_cause", F.lit("unknown")))}
    rows = trace.withColumns(signals)
    strong = "array(" + ", ".join(f"{a!r}D * _risk >= {trigger!r}D" for a in alphas) + ")"
    rows = stage(rows, {"at_q": _reached("_q", qs), "at_map": _reached("_map", maps), "strong_at": strong})
    keys = [*by, day, "true_class", "pred_class", F.col("_root").alias("root"), F.col("_match").alias("match"), "at_q", "at_map", "strong_at"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), _policy_rows(policies, qs, maps, alphas)


def policy_grid(trace: DataFrame, policies: list[dict], trigger: float = 0.5, acc_drop: float = 1.0, by: list[str] = (), day: str = "eval_day") -> DataFrame:
    """One row per policy (and ``by``): rows, kept, failed_<first failing gate>, mean daily recall and acc in percent, their change, pass_acc_guard.

    A kept row whose scaled risk reaches the trigger, in a policy that keeps the risk dimension, warns in addition to the model.
    """
    cube, grid = policy_cube(trace, policies, trigger, list(by), day)
    # the cube is small in bytes, but each of its rows meets every policy: it is spread over a stated number of tasks rather than coalesced by size
    cube = cube.repartition(int(cube.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cube.columns)
    wide = cube.selectExpr("*", f"inline({grid})")
    failed = (
        "CASE WHEN no_unknown AND root = 'unknown' THEN 'root_unknown' WHEN size(allowed) > 0 AND NOT array_contains(allowed, root) THEN 'root_cause' "
        "WHEN at_q < need_q THEN 'q' WHEN need_rule AND NOT match THEN 'rule' WHEN at_map < need_map THEN 'map' ELSE 'none' END"
    )
    wide = stage(wide, {"failed": failed})
    wide = stage(wide, {"warned": "pred_class = 1 OR (failed = 'none' AND sees_risk AND get(strong_at, strong))"})
    n = lambda cond: F.sum(F.when(F.expr(cond), F.col("rows")).otherwise(0))
    keys = [*by, "policy", "tag"]
    counts = {"tp": "true_class = 1 AND {}", "fp": "true_class = 0 AND {}", "tn": "true_class = 0 AND NOT {}", "fn": "true_class = 1 AND NOT {}"}
    cells = wide.groupBy(*keys, day).agg(
        F.sum("rows").alias("rows"), n("failed = 'none'").alias("kept"), *[n(f"failed = '{g}'").alias(f"failed_{g}") for g in GATES],
        *[n(c.format("warned")).alias(k) for k, c in counts.items()], *[n(c.format("pred_class = 1")).alias(f"b{k}") for k, c in counts.items()],
    )
    cells = stage(simple_metrics(cells), {"_br": "coalesce(try_divide(btp, btp + bfn), 0.0D)", "_ba": "try_divide(btp + btn, btp + bfp + btn + bfn)"})
    sums = ["rows", "kept", *[f"failed_{g}" for g in GATES]]
    out = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[(F.avg(m) * 100.0).alias(m) for m in ("recall", "acc")], (F.avg("_br") * 100.0).alias("_br"), (F.avg("_ba") * 100.0).alias("_ba"))
    return stage(out, {"d_recall": "recall - _br", "d_acc": "acc - _ba", "pass_acc_guard": f"acc >= _ba - {acc_drop!r}D"}).drop("_br", "_ba")


def best_policy(grid: DataFrame, by: list[str] = ()) -> DataFrame:
    """The policy with the best recall among those that hold accuracy, else among all; the earlier one on ties."""
    order = [F.col("pass_acc_guard").desc(), F.round("recall", 9).desc(), F.col("policy")]
    return best_rows(grid, list(by), order).drop("rank")


# ---- sampling ratios and vote thresholds -------------------------------------------------------------------------------------


def ratio_statistics(train: DataFrame, klass: str, features: list[str], ratios: list[int], draw: Column) -> DataFrame:
    """Per ratio and class the rows, and count, sum and square sum of every feature, when a class 0 row is drawn with ratio times the odds of class 1.

    ``draw`` is a number in [0, 1) a row. Every row goes to the smallest ratio that draws it; larger ratios add what smaller ones have.
    """
    ratios = sorted(set(ratios))
    odds = train.agg(F.try_divide(F.count_if(F.col(klass) == 1), F.count_if(F.col(klass) == 0))).scalar()
    rows = train.withColumn("_odds", F.coalesce(odds, F.lit(0.0))).withColumn("_u", draw)
    first = F.coalesce(*[F.when((F.col(klass) == 1) | (F.col("_u") < F.col("_odds") * d), d) for d in ratios])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(features):
        aggs += [F.count(f).alias(f"n{i}"), F.sum(F.col(f)).alias(f"s{i}"), F.sum(F.col(f) * F.col(f)).alias(f"q{i}")]
    own = rows.withColumn("ratio", first).where("ratio IS NOT NULL").groupBy("ratio", klass).agg(*aggs)
    sums = [c for c in own.columns if c not in ("ratio", klass)]
    spark = train.sparkSession
    frame = spark.createDataFrame([(d, k) for d in ratios for k in (0, 1)], f"ratio int, {klass} int")
    filled = frame.join(own, ["ratio", klass], "left").fillna(0, sums)
    w = Window.partitionBy(klass).orderBy("ratio").rowsBetween(Window.unboundedPreceding, 0)  # one row per ratio
    return filled.select("ratio", klass, *[F.sum(c).over(w).alias(c) for c in sums])


def ratio_votes(rows: DataFrame, statistics: DataFrame, klass: str, features: list[str]) -> DataFrame:
    """Adds votes: per ratio, in rising order, the share of class 1 by Gaussian naive Bayes; features without a value are left out.

    With one class only the vote is that class; the models are one literal array of a row per ratio.
    """
    k = range(len(features))
    table = stage(statistics, {x: sql for i in k for x, sql in ((f"m{i}", f"coalesce(try_divide(s{i}, n{i}), 0.0D)"), (f"v{i}", f"if(n{i} > 1, greatest(0.0D, (q{i} - s{i} * s{i} / n{i}) / (n{i} - 1)), 0.0D)"))})
    item = F.struct("rows", F.array(*[F.struct(F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"), F.col(f"n{i}").alias("n")) for i in k]).alias("f"))
    side = lambda c: F.max(F.when(F.col(klass) == c, item))
    pairs = table.groupBy("ratio").agg(side(0).alias("c0"), side(1).alias("c1"))
    models = pairs.agg(F.array_sort(F.collect_list(F.struct("ratio", "c0", "c1")))).scalar()
    x = F.array(*[F.col(f).cast("double") for f in features])

    def score(m, total):
        terms = F.zip_with(x, m["f"], lambda v, s: F.when(v.isNull() | (s["n"] == 0), 0.0).otherwise(log_density(v, s["m"], s["v"])))
        return F.log(m["rows"] / total) + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)

    def share(m):
        total = m["c0"]["rows"] + m["c1"]["rows"]
        both = 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), score(m["c0"], total) - score(m["c1"], total))))
        return F.when(m["c1"]["rows"] == 0, 0.0).when(m["c0"]["rows"] == 0, 1.0).otherwise(both)

    return rows.withColumn("_models", models).withColumn("votes", F.transform("_models", share)).drop("_models")


def ratio_grid(voted: DataFrame, klass: str, pairs: list[tuple[int, float]], baseline: str, day: str, acc_drop: float = 1.0) -> DataFrame:
    """Per (ratio, threshold): mean daily recall and acc in percent, their change against the baseline column, and whether both goals hold."""
    ratios = sorted({d for d, _ in pairs})
    hit = lambda d, h: f"get(votes, {ratios.index(d)}) >= {h!r}D"
    n = lambda cond: f"count_if({cond})"
    four = lambda p: f"'tp', {n(f'{klass} = 1 AND {p}')}, 'fp', {n(f'{klass} = 0 AND {p}')}, 'tn', {n(f'{klass} = 0 AND NOT ({p})')}, 'fn', {n(f'{klass} = 1 AND NOT ({p})')}"
    struct = lambda d, h, p: f"named_struct('ratio', {d}, 'h', {h!r}D, {four(p)})"
    items = [struct(d, h, hit(d, h)) for d, h in pairs] + [struct(0, 0.0, f"{baseline} = 1")]
    counted = voted.groupBy(day).agg(F.expr("array(" + ", ".join(items) + ")").alias("cells")).selectExpr(day, "inline(cells)")
    means = simple_metrics(counted.select(day, "ratio", "h", *COUNTS)).groupBy("ratio", "h").agg(*[(F.avg(m) * 100.0).alias(m) for m in ("recall", "acc")])
    base = means.where("ratio = 0").select(F.struct("recall", "acc")).scalar()
    out = means.where("ratio > 0").withColumn("_base", base)
    out = stage(out, {"d_recall": "recall - _base.recall", "d_acc": "acc - _base.acc"})
    return stage(out, {"pass_acc_guard": f"d_acc >= -{acc_drop!r}D", "pass_recall_goal": "d_recall >= 0"}).drop("_base")


def best_ratio(grid: DataFrame) -> DataFrame:
    """The best recall among pairs that hold both goals, else that hold accuracy, else of all; ties to the smaller ratio and threshold."""
    both = F.col("pass_acc_guard") & F.col("pass_recall_goal")
    tier = F.when(both, "feasible").when(F.col("pass_acc_guard"), "acc_guard").otherwise("best_effort")
    order = [both.desc(), F.col("pass_acc_guard").desc(), F.round("recall", 9).desc(), F.col("ratio"), F.col("h")]
    return best_rows(grid.withColumn("tier", tier), [], order).drop("rank")
