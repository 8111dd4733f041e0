"""Evaluation with delayed labels: a prediction waits in its disk's queue until its label can be trusted."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.operators.windows import stage


def predicted_class(vote_0: Column, vote_1: Column, threshold: float = 0.5) -> Column:
    """At 0.5 the larger vote (class 0 on ties), otherwise class 1 from the threshold on."""
    hit = vote_1 > vote_0 if threshold == 0.5 else vote_1 >= threshold
    return F.when(hit, 1).otherwise(0)


def _in_queue(preds: DataFrame, wait_days: int, start, end, exact: bool, disk: str, day: str) -> DataFrame:
    """One row per prediction and evaluation day it is queued on (at most ``wait_days`` of them by day).

    ``exact`` empties one element per evaluation, so gaps make rows stay longer: the removal day of the i-th row is
    i + max over j <= i of (first evaluation of row j - j), a running maximum instead of a simulated queue.
    """
    w = Window.partitionBy(disk).orderBy(day)
    df = preds.withColumn("_enter", F.greatest(F.date_add(day, 1), F.lit(start).cast("date")))
    if exact:
        df = df.withColumn("_i", F.row_number().over(w))
        lead = F.max(F.unix_date("_enter") - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_leave", F.date_from_unix_date(F.col("_i") + lead))
    else:
        df = df.withColumn("_leave", F.date_add(day, wait_days))
    df = df.withColumn("_leave", F.least(F.col("_leave"), F.lit(end).cast("date")))
    return df.where("_enter <= _leave").withColumn("_at", F.explode(F.sequence("_enter", "_leave"))).drop("_enter", "_leave", "_i")


def delay_trace(
    preds: DataFrame, wait_days: int, start, end, threshold: float = 0.5, exact: bool = False, disk: str = "disk", day: str = "day"
) -> DataFrame:
    """One judged prediction per disk and evaluation day (D19).

    ``preds`` has ``vote_0``, ``vote_1`` and the day's own ``failure``. A failure turns everything queued before it positive, visible
    from the next evaluation on. The judged row is the first correct one; a disk that failed and came back is judged by its last
    failed row; otherwise the newest. ``credit`` is the number of days a true positive came early.
    """
    later = Window.partitionBy(disk).orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    df = preds.withColumn("_fail", F.min(F.when(F.col("failure") == 1, F.col(day))).over(later))
    df = df.withColumn("pred_class", predicted_class(F.col("vote_0"), F.col("vote_1"), threshold))
    df = _in_queue(df, wait_days, start, end, exact, disk, day)
    df = df.withColumn("true_class", F.coalesce((F.col("_fail") < F.col("_at")).cast("int"), F.lit(0)))
    same = [c for c in ("model",) if c in df.columns]
    item = F.struct(F.col(day).alias("source_day"), "true_class", "pred_class", "vote_0", "vote_1")
    # the windows above already partition by disk, so this grouping needs no shuffle
    df = df.groupBy(disk, "_at").agg(*[F.first(c).alias(c) for c in same], F.array_sort(F.collect_list(item)).alias("_q"))
    df = stage(
        df,
        {
            "queue_size": "size(_q)",
            "_right": "cast(array_position(transform(_q, x -> x.true_class = x.pred_class), true) AS int)",
            "_failed": "cast(array_position(_q.true_class, 1) AS int)",
        },
    )
    df = stage(df, {"_back": "if(_failed = 0, 0, cast(array_position(slice(_q.true_class, _failed + 1, queue_size), 0) AS int))"})
    df = stage(df, {"_back": "if(_back = 0, 0, _back + _failed)"})
    df = stage(
        df,
        {
            "_pick": "CASE WHEN _back > 0 AND (_right = 0 OR _right >= _back) THEN _back - 1 WHEN _right > 0 THEN _right ELSE queue_size END",
            "_early": "_right > 0 AND (_back = 0 OR _right < _back)",
        },
    )
    df = stage(df, {"_row": "_q[_pick - 1]", "eval_day": "date_sub(_at, 1)"})
    df = stage(df, {"credit": "if(_early AND _row.true_class = 1, queue_size - _pick + 1, 0)"})
    return df.select("eval_day", "_row.source_day", F.col(disk), *same, "_row.true_class", "_row.pred_class", "_row.vote_0", "_row.vote_1",
                     "queue_size", F.lit(threshold).alias("threshold"), "credit")


def delay_trace_regression(preds: DataFrame, wait_days: int, label_window: int, start, end, disk: str = "disk", day: str = "day") -> DataFrame:
    """Regression form: the oldest queued row is judged.

    A failure gives the newest ``label_window`` queued rows falling targets, the failure day itself has 1; the latest failure counts.
    """
    w = Window.partitionBy(disk).orderBy(day)
    df = preds.withColumn("_i", F.row_number().over(w))
    ahead = w.rowsBetween(0, label_window)
    df = df.withColumn("_f", F.collect_list(F.when(F.col("failure") == 1, F.struct(F.col(day).alias("d"), F.col("_i").alias("i")))).over(ahead))
    df = df.withColumn("_rank", F.col("_i"))
    df = _in_queue(df, wait_days, start, end, False, disk, day)
    df = stage(df, {"_seen": "array_max(filter(_f, x -> x.d < _at).i)"})
    df = stage(df, {"truth": f"coalesce(1.0D - (_seen - _rank) / {label_window + 1.0}D, 0.0D)"})
    same = [c for c in ("model",) if c in df.columns]
    oldest = F.min_by(F.struct(F.col(day).alias("source_day"), "truth", "prediction"), F.col(day)).alias("_o")
    df = df.groupBy(disk, "_at").agg(*[F.first(c).alias(c) for c in same], oldest, F.count(F.lit(1)).alias("queue_size"))
    return df.select(F.date_sub("_at", 1).alias("eval_day"), F.col(disk), *same, "_o.source_day", "_o.truth", "_o.prediction", "queue_size")
