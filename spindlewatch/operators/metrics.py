"""Evaluators: metric aggregates over prediction tables.

Counts are taken first (one map-side combined aggregation), ratios are expressions on the counts. Undefined ratios are null unless a
function says that it reports 0. Order-dependent measures use the two-level order of ``functions.ordered``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.ordered import overlap_tiles, previous, row_numbers, running
from spindlewatch.functions.scalars import mean_of
from spindlewatch.operators.windows import stage
from spindlewatch.session import cut_lineage

COUNTS = ["tp", "fp", "tn", "fn"]


def confusion(df: DataFrame, by: list[str] = (), truth: str = "true_class", pred: str = "pred_class", extra: list[Column] = ()) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"), *extra
    )


def simple_metrics(counts: DataFrame) -> DataFrame:
    """recall, precision, accuracy, false positive rate and F1 with 0 on empty denominators."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    df = counts.withColumns(
        {"recall": mean_of(tp, tp + fn), "precision": mean_of(tp, tp + fp), "acc": mean_of(tp + tn, tp + fp + tn + fn), "fpr": mean_of(fp, fp + tn)}
    )
    return df.withColumn("f1", mean_of(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def full_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, kappa, per-class and macro precision/recall/F1, false alarm rate (percent); undefined values are null."""
    df = stage(
        counts,
        {
            "instances": "tp + fp + tn + fn",
            "accuracy": "try_divide(100.0D * (tp + tn), tp + fp + tn + fn)",
            "false_alarm_rate": "try_divide(100.0D * fp, fp + tn)",
            "precision_c0": "try_divide(100.0D * tn, tn + fn)",
            "precision_c1": "try_divide(100.0D * tp, tp + fp)",
            "recall_c0": "try_divide(100.0D * tn, tn + fp)",
            "recall_c1": "try_divide(100.0D * tp, tp + fn)",
            "_pc": "try_divide(cast(tp + fp AS double) * (tp + fn) + cast(tn + fn AS double) * (tn + fp), cast(tp + fp + tn + fn AS double) * (tp + fp + tn + fn))",
        },
    )
    df = stage(
        df,
        {
            "kappa": "try_divide(accuracy - 100.0D * _pc, 1.0D - _pc)",
            "precision": "(precision_c0 + precision_c1) / 2.0D",
            "recall": "(recall_c0 + recall_c1) / 2.0D",
            **{f"f1_c{i}": f"try_divide(2.0D * precision_c{i} * recall_c{i}, precision_c{i} + recall_c{i})" for i in (0, 1)},
        },
    )
    return stage(df, {"f1": "try_divide(2.0D * precision * recall, precision + recall)"}).drop("_pc")


def undefined_reason() -> Column:
    return F.when(F.col("tp") + F.col("fp") == 0, "UNDEFINED: TP+FP=0").when(F.col("tp") + F.col("fn") == 0, "UNDEFINED: TP+FN=0")


def cumulative(daily_counts: DataFrame, day: str = "eval_day", columns: list[str] = COUNTS, by: list[str] = ()) -> DataFrame:
    """Counts of all days up to and including each day (one row per day in, so the window is small)."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return daily_counts.withColumns({c: F.sum(c).over(w) for c in columns})


def mean_metrics(daily: DataFrame, by: list[str] = (), names: list[str] = ("recall", "precision", "f1", "acc", "fpr"), scale: float = 100.0) -> DataFrame:
    return daily.groupBy(*by).agg(*[F.coalesce(F.avg(n) * scale, F.lit(0.0)).alias(n) for n in names])


def run_summary(daily: DataFrame, by: list[str] = ()) -> DataFrame:
    """Means over the days that have a recall, and F1 of the mean precision and recall."""
    seen = F.col("recall_c1").isNotNull()
    out = daily.where(seen).groupBy(*by).agg(
        F.avg("days_before").alias("days_before"), F.avg("fp").alias("fp"), F.avg("false_alarm_rate").alias("fpr"),
        F.avg("precision_c1").alias("precision"), F.avg("recall_c1").alias("recall"), F.count(F.lit(1)).alias("days"),
    )
    return stage(out, {"f1": "try_divide(2.0D * precision * recall, precision + recall)"})


def regression_run_summary(daily: DataFrame, value: str = "avg_err_days", by: list[str] = ()) -> DataFrame:
    """Mean, sample deviation, largest and smallest daily error in days, and over how many days; days without one don't count."""
    x = F.when(~F.isnan(value), F.col(value))
    return daily.groupBy(*by).agg(F.count(x).alias("days"), F.avg(x).alias("days_mean"), F.stddev_samp(x).alias("days_std"), F.max(x).alias("days_max"), F.min(x).alias("days_min"))


def ordered_kappas(df: DataFrame, key: str, truth: str = "true_class", pred: str = "pred_class", ranges: int | None = None) -> DataFrame:
    """Kappa against the last class seen and against the running majority class, over the whole-table order ``key``."""
    ones = (F.col(truth) == 1).cast("bigint")
    df = previous(df.select(key, truth, pred), key, truth, "_last", 0, ranges=ranges)
    df = running(df, key, {"_c1": ones, "_c0": 1 - ones}, ranges=ranges)
    major = F.when(F.col("_c1") > F.col("_c0"), 1).otherwise(0)
    right = lambda c: F.avg((c == F.col(truth)).cast("double"))
    out = df.agg(F.count(F.lit(1)).alias("instances"), right(F.col(pred)).alias("p0"), right(F.col("_last")).alias("pt"), right(major).alias("pm"))
    return stage(out, {"kappa_temporal": "try_divide(p0 - pt, 1.0D - pt)", "kappa_m": "try_divide(p0 - pm, 1.0D - pm)"})


def sliding(df: DataFrame, key: str, values: dict[str, Column], width: int, ranges: int | None = None) -> DataFrame:
    """Means over the last ``width`` rows of the whole-table order, per row (``n`` is the row's position).

    Running sums of a tile minus those ``width`` rows earlier: the cost of a row does not depend on the width.
    """
    numbered = row_numbers(df, key, "n", ranges)
    tiled = overlap_tiles(numbered, F.col("n"), max(4 * width, 10_000), width)
    w = Window.partitionBy("_tile").orderBy("n")
    total = w.rowsBetween(Window.unboundedPreceding, 0)
    tiled = tiled.withColumns({f"_r_{k}": F.sum(v).over(total) for k, v in values.items()})
    tiled = tiled.withColumns({f"_b_{k}": F.coalesce(F.lag(f"_r_{k}", width).over(w), F.lit(0)) for k in values})
    rows = F.least(F.col("n"), F.lit(width))
    out = tiled.where("_own").withColumns({k: (F.col(f"_r_{k}") - F.col(f"_b_{k}")) / rows for k in values})
    return out.drop("_tile", "_own", *[f"_{x}_{k}" for x in "rb" for k in values])


def learning_curve(df: DataFrame, key: str, values: dict[str, Column], every: int, ranges: int | None = None) -> DataFrame:
    """Mean of everything so far at every ``every``-th row: rows are summed per checkpoint first, then accumulated."""
    numbered = row_numbers(df, key, "n", ranges).withColumn("checkpoint", (F.ceil(F.col("n") / F.lit(every)) * every).cast("bigint"))
    parts = numbered.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s_{k}") for k, v in values.items()])
    sums = running(parts, "checkpoint", {"seen": F.col("_n"), **{f"_r_{k}": F.col(f"_s_{k}") for k in values}}, ranges=ranges)
    full = sums.where("seen = checkpoint")  # a last, incomplete checkpoint is not reported
    return full.select("checkpoint", *[(F.col(f"_r_{k}") / F.col("seen")).alias(k) for k in values])


def decayed(df: DataFrame, key: str, values: dict[str, Column], decay: float, every: int, ranges: int | None = None) -> DataFrame:
    """Exponentially decayed sums at every ``every``-th row: per value ``k`` Σ v·decay^(n-i), and their total weight.

    Each tile of ``every`` rows is folded on its own; a checkpoint adds the last tiles, as many as a double can still tell apart.
    """
    numbered = row_numbers(df, key, "n", ranges).withColumn("tile", F.ceil(F.col("n") / F.lit(every)).cast("bigint"))
    weight = F.pow(F.lit(decay), F.col("tile") * every - F.col("n"))
    sums = {**values, "weight": F.lit(1.0)}
    parts = numbered.groupBy("tile").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v * weight).alias(k) for k, v in sums.items()])
    reach = max(1, math.ceil(math.log(1e-18) / (every * math.log(decay)))) if 0 < decay < 1 else 1
    tiled = overlap_tiles(parts.where(F.col("_n") == every), F.col("tile"), max(4 * reach, 10_000), reach)
    frame = Window.partitionBy("_tile").orderBy("tile").rangeBetween(-reach, 0)
    folded = tiled
    for k in sums:
        pairs = F.collect_list(F.struct("tile", F.col(k).alias("v"))).over(frame)
        folded = folded.withColumn(f"_p_{k}", pairs)
    folded = folded.where("_own")
    total = lambda k: f"aggregate(_p_{k}, 0.0D, (a, x) -> a + x.v * pow({decay!r}D, (tile - x.tile) * {every}))"
    return stage(folded.select("tile", *[f"_p_{k}" for k in sums]), {k: total(k) for k in sums}).select((F.col("tile") * every).alias("checkpoint"), *sums)


def fading(df: DataFrame, key: str, values: dict[str, Column], alpha: float = 0.999, every: int = 1000, ranges: int | None = None) -> DataFrame:
    """Fading-factor means: e = alpha·e + v, b = alpha·b + 1, value e/b."""
    out = decayed(df, key, values, alpha, every, ranges)
    return out.select("checkpoint", *[(F.col(k) / F.col("weight")).alias(k) for k in values])


def ewma(df: DataFrame, key: str, values: dict[str, Column], alpha: float = 0.01, every: int = 1000, ranges: int | None = None) -> DataFrame:
    """Exponentially weighted means: e += alpha·(v - e), from 0."""
    out = decayed(df, key, values, 1.0 - alpha, every, ranges)
    return out.select("checkpoint", *[(F.col(k) * alpha).alias(k) for k in values])


def auc(df: DataFrame, score: str, truth: str, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """AUC, scored AUC, G-mean, recall and class ratio; 1 for both areas when a class is empty.

    Rows are first combined per distinct score, so a score shared by many rows is one row of the ordered pass.
    """
    pos = F.col(truth) == 1
    s = F.col(score)
    per = df.groupBy(*by, score).agg(F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_n"))
    per = per.withColumn("_key", -s)
    above = running(per, "_key", {"_pa": F.col("_p"), "_psa": F.col("_p") * s, "_nsa": F.col("_n") * s}, within=list(by), exclusive=True, ranges=ranges)
    out = above.groupBy(*by).agg(
        F.sum("_p").alias("positives"),
        F.sum("_n").alias("negatives"),
        F.sum(F.col("_n") * (F.col("_pa") + F.col("_p") / 2.0)).alias("_a"),
        F.sum(F.col("_n") * (F.col("_psa") + F.col("_p") * s / 2.0)).alias("_plus"),
        F.sum(F.col("_p") * F.col("_nsa")).alias("_over"),
        F.sum(F.col("_n") * s).alias("_r"),
    )
    pairs = "cast(positives AS double) * negatives"
    return stage(
        out,
        {
            "auc": f"if(positives = 0 OR negatives = 0, 1.0D, try_divide(_a, {pairs}))",
            "scored_auc": f"if(positives = 0 OR negatives = 0, 1.0D, try_divide(_plus - (positives * _r - _over), {pairs}))",
            "class_ratio": "try_divide(positives, negatives)",
        },
    ).drop("_a", "_plus", "_over", "_r")


def imbalance_metrics(counts: DataFrame) -> DataFrame:
    """G-mean and recall from confusion counts (null when a class is empty)."""
    return stage(counts, {"gmean": "sqrt(try_divide(tp, tp + fn) * try_divide(tn, tn + fp))", "recall": "try_divide(tp, tp + fn)"})


def regression(df: DataFrame, truth: str, pred: str, key: str, label_window: int = 20, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Absolute, squared and relative errors; the relative ones compare with the running mean of the targets seen before."""
    y, p = F.col(truth), F.col(pred)
    df = running(df, key, {"_sum": y, "_seen": F.lit(1).cast("bigint")}, within=list(by), exclusive=True, ranges=ranges)
    mean = F.coalesce(F.try_divide(F.col("_sum"), F.col("_seen")), F.lit(0.0))
    err, base, failed = F.abs(y - p), F.abs(y - mean), y > 0
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("instances"), F.count_if(failed).alias("failures"), F.sum(err).alias("_e"), F.sum(err * err).alias("_s"),
        F.sum(base).alias("_be"), F.sum(base * base).alias("_bs"), F.sum(F.when(failed, err)).alias("_fe"),
        F.sum(F.when(failed, err * err)).alias("_fs"), F.sum(F.when(failed, p - y)).alias("_fd"),
    )
    out = stage(
        out,
        {
            "mae": "try_divide(_e, instances)",
            "rmse": "sqrt(try_divide(_s, instances))",
            "relative_mae": "if(_be > 0, try_divide(_e, _be), 0.0D)",
            "relative_rmse": "if(_bs > 0, sqrt(try_divide(_s, _bs)), 0.0D)",
            "mae_failures": "try_divide(_fe, failures)",
            "mse_failures": "try_divide(_fs, failures)",
            "error_days": f"try_divide(_fd, failures) * {label_window + 1.0}D",
        },
    )
    return out.drop("_e", "_s", "_be", "_bs", "_fe", "_fs", "_fd")


def multi_label(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """Exact match, Jaccard accuracy, Hamming score, precision, recall and F-measure averaged over rows of 0/1 arrays."""
    df = stage(
        df,
        {
            "_i": f"cast(aggregate(zip_with({truth}, {pred}, (t, p) -> t * p), 0, (a, x) -> a + x) AS double)",
            "_t": f"aggregate({truth}, 0, (a, x) -> a + x)",
            "_p": f"aggregate({pred}, 0, (a, x) -> a + x)",
            "_same": f"size(filter(zip_with({truth}, {pred}, (t, p) -> t = p), x -> x))",
            "_l": f"size({truth})",
        },
    )
    return df.groupBy(*by).agg(
        F.avg(F.expr("if(_same = _l, 1.0D, 0.0D)")).alias("exact_match"),
        F.avg(F.expr("coalesce(try_divide(_i, _t + _p - _i), 0.0D)")).alias("accuracy"),
        F.avg(F.expr("_same / cast(_l AS double)")).alias("hamming"),
        F.avg(F.expr("coalesce(try_divide(_i, _p), 0.0D)")).alias("precision"),
        F.avg(F.expr("coalesce(try_divide(_i, _t), 0.0D)")).alias("recall"),
        F.avg(F.expr("coalesce(try_divide(2.0D * _i, _t + _p), 0.0D)")).alias("f_measure"),
    )


def multi_target(df: DataFrame, targets: list[str], preds: list[str], by: list[str] = (), relative: bool = False) -> DataFrame:
    """Mean over targets of MAE and RMSE; ``relative`` divides by the errors of the target's mean."""
    err = {}
    for i, (t, p) in enumerate(zip(targets, preds)):
        e = F.col(t) - F.col(p)
        err[f"_e{i}"], err[f"_s{i}"] = F.avg(F.abs(e)), F.avg(e * e)
        if relative:
            err[f"_v{i}"] = F.var_pop(F.col(t).cast("double"))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("instances"), *[v.alias(k) for k, v in err.items()])
    k = float(len(targets))
    rmse = [f"sqrt(_s{i})" + (f" / sqrt(_v{i})" if relative else "") for i in range(len(targets))]
    cols = {"rmse": f"({' + '.join(rmse)}) / {k}D"}
    if not relative:
        cols["mae"] = f"({' + '.join(f'_e{i}' for i in range(len(targets)))}) / {k}D"
    return stage(out, cols).drop(*err)


def multi_target_relative(
    df: DataFrame, targets: list[str], preds: list[str], key: str, by: list[str] = (), ranges: int | None = None, tie: list[str] = ()
) -> DataFrame:
    """Mean over targets of relative MAE and RMSE: errors against those of the mean of the rows seen so far, the row included.

    ``key``, then ``tie``, is the unique order of the rows. Null when a target never left its running mean.
    """
    sums = {f"_y{i}": F.col(t).cast("double") for i, t in enumerate(targets)}
    df = running(df, key, {"_seen": F.lit(1).cast("bigint"), **sums}, within=list(by), ranges=ranges, tie=tie)
    aggs = []
    for i, (t, p) in enumerate(zip(targets, preds)):
        e, m = F.abs(F.col(t) - F.col(p)), F.abs(F.col(t) - F.col(f"_y{i}") / F.col("_seen"))
        aggs += [F.sum(e).alias(f"_e{i}"), F.sum(m).alias(f"_m{i}"), F.sum(e * e).alias(f"_s{i}"), F.sum(m * m).alias(f"_q{i}")]
    return _relative(df.groupBy(*by).agg(F.count(F.lit(1)).alias("instances"), *aggs), len(targets))


def _relative(df: DataFrame, k: int) -> DataFrame:
    mae, rmse = ([f"{o}try_divide({a}{i}, {b}{i}))" for i in range(k)] for o, a, b in (("(", "_e", "_m"), ("sqrt(", "_s", "_q")))
    out = stage(df, {"relative_mae": f"({' + '.join(mae)}) / {k}.0D", "relative_rmse": f"({' + '.join(rmse)}) / {k}.0D"})
    return out.drop(*[f"{x}{i}" for x in ("_e", "_m", "_s", "_q") for i in range(k)])


def multi_target_windowed(df: DataFrame, targets: list[str], preds: list[str], key: str, width: int, ranges: int | None = None) -> DataFrame:
    """Per row the plain and relative errors over the last ``width`` rows of the order ``key`` (``n`` is the row's position).

    The mean that a row is compared with is that of the window ending at the row.
    """
    k = len(targets)
    means = sliding(df, key, {f"_y{i}": F.col(t).cast("double") for i, t in enumerate(targets)}, width, ranges)
    values = {}
    for i, (t, p) in enumerate(zip(targets, preds)):
        e, m = F.abs(F.col(t) - F.col(p)), F.abs(F.col(t) - F.col(f"_y{i}"))
        values |= {f"_e{i}": e, f"_m{i}": m, f"_s{i}": e * e, f"_q{i}": m * m}
    # sliding() numbers the rows again
    out = sliding(means.drop("n"), key, values, width, ranges).drop(*[f"_y{i}" for i in range(k)])
    mean = lambda c: " + ".join(f"{c}{i}" for i in range(k))
    return _relative(stage(out, {"mae": f"({mean('_e')}) / {k}.0D", "rmse": f"sqrt(({mean('_s')}) / {k}.0D)"}), k)


def fold_summary(curves: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation of every metric over folds or runs."""
    aggs = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return curves.groupBy(*by).agg(*aggs)


def drift_evaluation(detections: DataFrame, key: str = "n", by: list[str] = ()) -> DataFrame:
    """Detections, warnings, true changes, how many of them were found, and the mean delay.

    ``detections`` has per row ``change``, ``warning`` and ``true_change``. A true change counts as found by the first detection after
    it and before the next one; segments between true changes are numbered by a running sum, then aggregated.
    """
    flag = lambda c: F.col(c).cast("bigint")
    df = running(cut_lineage(detections), key, {"_seg": flag("true_change")}, within=list(by), exclusive=True)
    seg = df.groupBy(*by, "_seg").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(flag("change")).alias("_det"), F.min(key).alias("_first"),
        F.min(F.when(F.col("change"), F.col(key))).alias("_hit"), F.count_if("true_change").alias("_true"),
        F.min(F.when(F.col("warning"), F.col(key))).alias("_warn"),
    )
    found = (F.col("_seg") > 0) & F.col("_hit").isNotNull()
    warned = (F.col("_seg") > 0) & F.col("_warn").isNotNull() & (F.col("_hit").isNull() | (F.col("_warn") <= F.col("_hit")))
    out = seg.groupBy(*by).agg(
        F.sum("_rows").alias("instances"), F.sum("_det").alias("detected"), F.count_if(warned).alias("warned_changes"),
        F.sum("_true").alias("true_changes"), F.count_if(found).alias("found_changes"),
        F.coalesce(F.sum(F.when(found, F.col("_hit") - F.col("_first") + 1)), F.lit(0)).alias("_delay"),
    )
    return stage(out, {"mean_delay": "coalesce(try_divide(cast(_delay AS double), true_changes), 0.0D)"}).drop("_delay")
