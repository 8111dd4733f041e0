"""Comparing runs: fusion and threshold grids, guards, statuses and policy suggestions."""
from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.operators.metrics import COUNTS, mean_metrics, simple_metrics
from spindlewatch.operators.windows import stage

# The default fusion grid.
FUSION_GRID = {
    "q": [0.35, 0.45, 0.55, 0.65], "risk": [0.45, 0.55, 0.65], "map_thr": [0.3, 0.5, 0.7], "rule": [0.35, 0.45, 0.55], "noise_max": [0.6, 0.4],
}


def grid_rows(grid: dict[str, list[float]]) -> str:
    """All combinations as a literal array of structs (SQL text): rows fan out by ``inline``, without a join."""
    combos = itertools.product(*grid.values())
    return "array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {v!r}D" for k, v in zip(grid, c)) + ")" for c in combos) + ")"


def _level(value: str, thresholds: list[float]) -> str:
    """Largest threshold that ``value`` reaches; -1 below all of them."""
    reached = ", ".join(f"if({value} >= {t!r}D, {t!r}D, -1.0D)" for t in thresholds)
    return f"greatest(-1.0D, {reached})"


def fuse_trace(trace: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Trace rows with the signals of their source day; rows without a cache entry get zeros and an unknown cause."""
    signals = ["llm_q_score", "risk_hint", "confidence", "llm_mapped_event_ratio", "label_noise_risk", "llm_rule_top_score"]
    joined = trace.join(cache.select(*keys, *signals, F.lower("root_cause").alias("root_cause")), keys, "left")
    return joined.withColumns({**{s: F.coalesce(s, F.lit(0.0)) for s in signals}, "root_cause": F.coalesce("root_cause", F.lit("unknown"))})


def fusion_grid(fused: DataFrame, grid: dict[str, list[float]] = FUSION_GRID, acc_drop: float = 1.0, day: str = "eval_day") -> DataFrame:
    """Daily metrics of ``prediction OR trigger`` for every threshold combination, averaged over days.

    Signals are reduced to the thresholds they reach and counted first; the grid then fans out over these few count rows per day
    rather than over predictions, and gives the same counts.
    """
    levels = {
        "_q": _level("llm_q_score", grid["q"]),
        "_risk": _level("risk_hint", grid["risk"]),
        "_conf": _level("confidence", grid["risk"]),
        "_map": _level("llm_mapped_event_ratio", grid["map_thr"]),
        "_rule": _level("llm_rule_top_score", grid["rule"]),
        "_noise": "least(9.0D, " + ", ".join(f"if(label_noise_risk <= {t!r}D, {t!r}D, 9.0D)" for t in grid["noise_max"]) + ")",
        "_known": "root_cause != 'unknown'",
    }
    small = stage(fused, levels).groupBy(day, "true_class", "pred_class", *levels).agg(F.count(F.lit(1)).alias("_n"))
    wide = small.selectExpr("*", f"inline({grid_rows(grid)})")
    trigger = "_q >= q AND _risk >= risk AND _map >= map_thr AND _noise <= noise_max AND _known AND (_rule >= rule OR _conf >= risk)"
    wide = stage(wide, {"_p": f"pred_class = 1 OR ({trigger})", "_m": "pred_class = 1", "_t": "true_class = 1"})
    n = lambda cond: F.sum(F.when(F.expr(cond), F.col("_n")).otherwise(0))
    params = list(grid)
    cells = wide.groupBy(*params, day).agg(
        n("_t AND _p").alias("tp"), n("NOT _t AND _p").alias("fp"), n("NOT _t AND NOT _p").alias("tn"), n("_t AND NOT _p").alias("fn"),
        n("_t AND _m").alias("btp"), n("NOT _t AND _m").alias("bfp"), n("NOT _t AND NOT _m").alias("btn"), n("_t AND NOT _m").alias("bfn"),
    )
    cells = simple_metrics(cells)
    cells = stage(cells, {"_brecall": "coalesce(try_divide(btp, btp + bfn), 0.0D)", "_bacc": "try_divide(btp + btn, btp + bfp + btn + bfn)"})
    out = cells.groupBy(*params).agg(
        *[(F.avg(m) * 100.0).alias(m) for m in ("recall", "precision", "f1", "acc", "fpr")],
        (F.avg("_brecall") * 100.0).alias("_br"), (F.avg("_bacc") * 100.0).alias("_ba"),
    )
    return stage(out, {"d_recall": "recall - _br", "d_acc": "acc - _ba", "pass_acc_guard": f"acc >= _ba - {acc_drop!r}D"}).drop("_br", "_ba")


def reachability(run: DataFrame, zero: DataFrame, metrics: list[str], eps: float = 1e-9, day: str = "eval_day") -> DataFrame:
    """Whether a run differs from its zeroed twin at all: largest difference of means, and days whose summed difference exceeds eps."""
    a = run.agg(*[F.avg(m).alias(f"run_{m}") for m in metrics])
    joined = run.select(day, *[F.col(m).alias(f"a_{m}") for m in metrics]).join(zero.select(day, *[F.col(m).alias(f"b_{m}") for m in metrics]), day)
    gap = sum(F.coalesce(F.abs(F.col(f"a_{m}") - F.col(f"b_{m}")), F.lit(0.0)) for m in metrics)
    days = joined.agg(F.count_if(gap > eps).alias("changed_days"))
    z = zero.agg(*[F.avg(m).alias(f"zero_{m}") for m in metrics])
    one = lambda df: df.select(F.struct(*df.columns)).scalar()
    out = a.withColumns({"_z": one(z), "changed_days": days.scalar()}).select("*", "_z.*").drop("_z")
    diffs = [F.abs(F.col(f"run_{m}") - F.col(f"zero_{m}")) for m in metrics]
    out = out.withColumn("max_abs_diff", F.greatest(*diffs) if len(diffs) > 1 else diffs[0])
    return out.withColumn("reachable", (F.col("max_abs_diff") > eps) | (F.col("changed_days") > 0))


def model_status(run: DataFrame, base: DataFrame, acc_drop: float = 1.0, by: str = "model", recall: str = "recall", acc: str = "acc") -> DataFrame:
    """PASS when a model's mean recall holds and accuracy drops by at most ``acc_drop`` points, else FALLBACK; N/A without metrics."""
    part = lambda df, p: df.groupBy(by).agg(F.avg(recall).alias(f"{p}_recall_mean"), F.avg(acc).alias(f"{p}_acc_mean"))
    out = part(run, "llm").join(part(base, "nollm"), by, "full")
    missing = lambda p: F.col(f"{p}_recall_mean").isNull() | F.col(f"{p}_acc_mean").isNull()
    good = (F.col("llm_recall_mean") >= F.col("nollm_recall_mean")) & (F.col("llm_acc_mean") >= F.col("nollm_acc_mean") - acc_drop)
    status = F.when(missing("llm") | missing("nollm"), "N/A").when(good, "PASS").otherwise("FALLBACK")
    action = (
        F.when(missing("llm"), "llm_invalid").when(missing("nollm"), "nollm_invalid").when(good, "llm_enabled").otherwise("nollm")
    )
    return out.withColumns(
        {
            "status": status, "action": action, "delta_recall": F.col("llm_recall_mean") - F.col("nollm_recall_mean"),
            "delta_acc": F.col("llm_acc_mean") - F.col("nollm_acc_mean"),
        }
    )


def baseline_lock(status: DataFrame) -> DataFrame:
    return status.withColumns({"acc_guard_floor": F.col("nollm_acc_mean") - 1.0, "recall_target_floor": F.col("nollm_recall_mean")})


def grid_summary(grid: DataFrame, baseline: DataFrame, by: list[str], acc_drop: float = 1.0) -> DataFrame:
    """Grid rows (recall, acc, kept per combination) against the model's baseline means; rows that kept nothing are degenerate."""
    base = baseline.select(*by, F.col("recall").alias("base_recall"), F.col("acc").alias("base_acc"))
    out = grid.join(base, by, "left")
    return stage(
        out,
        {
            "delta_recall": "recall - base_recall",
            "delta_acc": "acc - base_acc",
            "pass_acc_guard": f"acc >= base_acc - {acc_drop!r}D",
            "degenerate": "kept = 0",
        },
    )


def best_rows(grid: DataFrame, by: list[str], order: list[Column], top: int = 1) -> DataFrame:
    """The ``top`` rows per group; the rank limit is pushed below the shuffle as a window group limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return grid.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def best_combination(grid: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    order = [F.col("pass_acc_guard").desc(), F.col("delta_recall").desc(), F.col("delta_acc").desc(), *[F.col(t) for t in tie]]
    return best_rows(grid, by, order).drop("rank")


def suggest_policy(best: DataFrame) -> DataFrame:
    """A policy row per model from its best combination; models that miss the guard or lose recall fall back."""
    good = F.col("pass_acc_guard") & (F.col("delta_recall") >= 0)
    return best.withColumns(
        {"enabled": good, "fallback": F.when(good, "zero").otherwise("nollm"), "min_q_score": F.when(good, F.col("q_gate")).otherwise(F.lit(0.0))}
    )


def threshold_grid(counts_by_day: DataFrame, by: list[str], day: str = "eval_day") -> DataFrame:
    """Mean recall and accuracy (percent) per combination from daily counts."""
    return mean_metrics(simple_metrics(counts_by_day), by, ["recall", "acc"])


def pick_feasible(grid: DataFrame, by: list[str], recall_floor: Column, acc_floor: Column, tie: list[str]) -> DataFrame:
    """Best feasible combination; if none, the best that holds accuracy; if none, the best of all."""
    ok_acc, ok_rec = F.col("acc") >= acc_floor, F.col("recall") >= recall_floor
    tier = F.when(ok_acc & ok_rec, "feasible").when(ok_acc, "acc_guard").otherwise("best_effort")
    rank = F.when(ok_acc & ok_rec, 0).when(ok_acc, 1).otherwise(2)
    picked = best_rows(grid.withColumns({"tier": tier, "_t": rank}), by, [F.col("_t"), F.col("recall").desc(), F.col("acc").desc(), *[F.col(t) for t in tie]])
    return picked.drop("_t", "rank")


def top_two(grid: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """Two best configurations per group with a risk flag when accuracy is below the guard."""
    order = [F.col("pass_acc_guard").desc(), F.col("recall").desc(), F.col("acc").desc(), *[F.col(t) for t in tie]]
    return best_rows(grid, by, order, 2).withColumn("risk", F.when(F.col("pass_acc_guard"), "ok").otherwise("acc_below_guard"))


def seed_stability(runs: DataFrame, by: list[str], recall_floor: float, acc_floor: float) -> DataFrame:
    out = runs.groupBy(*by).agg(F.avg("recall").alias("recall_mean"), F.avg("acc").alias("acc_mean"), F.count(F.lit(1)).alias("seeds"))
    return out.withColumn("stable", (F.col("recall_mean") >= recall_floor) & (F.col("acc_mean") >= acc_floor))


def comparison_summary(status: DataFrame, by: list[str] = ()) -> DataFrame:
    """Enabled models, mean recall delta, best and worst model."""
    key = lambda sign: F.struct(F.col("delta_recall") * sign, F.col("model"))
    return status.groupBy(*by).agg(
        F.count(F.lit(1)).alias("models"), F.count_if(F.col("status") == "PASS").alias("enabled"),
        F.avg(F.when(F.col("status") != "N/A", F.col("delta_recall"))).alias("mean_delta_recall"),
        F.min_by("model", key(-1)).alias("best_model"), F.min_by("model", key(1)).alias("worst_model"),
    )
