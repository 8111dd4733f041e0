"""Sliding windows per disk and the statistics of every sensor inside a window.

One shuffle by (disk, tile) serves everything downstream: the frame collects at most W daily rows, sensors fan out by a
literal array of rules, and statistics are array expressions on those at most W points. Tiles cut a long disk history, so no
partition of the window grows with it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.names import smart_name
from spindlewatch.functions.ordered import overlap_tiles
from spindlewatch.functions.scalars import safe_double
from spindlewatch.operators.rulebook import Rule, Scoring, rules_sql

TILE_DAYS = 120


def stage(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Adds several SQL expressions at once; a stage can use the columns of the stages before it."""
    return df.withColumns({name: F.expr(sql) for name, sql in exprs.items()})


def window_rows(daily: DataFrame, features: list[str], window_days: int = 30, disk: str = "disk", day: str = "day") -> DataFrame:
    """One row per input row with ``points``: the disk's rows of the last ``window_days`` days as (day number, values)."""
    keep = [c for c in daily.columns if c not in features]
    base = daily.select(*keep, F.array(*[safe_double(F.col(f), finite=True) for f in features]).alias("_vals"))
    base = base.withColumn("_d", F.unix_date(day))
    tiled = overlap_tiles(base, F.col("_d"), TILE_DAYS, window_days - 1)
    # work per row is large for its bytes, so the number of partitions is stated rather than coalesced by size
    tiled = tiled.repartition(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), disk, "_tile")
    frame = Window.partitionBy(disk, "_tile").orderBy("_d").rangeBetween(-(window_days - 1), 0)
    out = tiled.withColumn("points", F.collect_list(F.struct(F.col("_d").alias("d"), F.col("_vals").alias("x"))).over(frame))
    out = out.where("_own").select(*keep, "_tile", "points")
    return stage(out, {"n_rows": "size(points)", "start_day": "date_from_unix_date(points[0].d)"})


def median_sql(values: str) -> str:
    """Median of an array: the mean of the middle two; null when it is empty."""
    s = f"array_sort({values})"
    return f"((get({s}, (size({values}) - 1) div 2) + get({s}, size({values}) div 2)) / 2.0D)"


def _head_size(n: str) -> str:
    return f"greatest(1, least({n}, cast(ceil({n} * 0.4D) AS int)))"


def _tail_ratio(width: int) -> str:
    k = f"greatest(1, least(m, {width}))"
    return f"size(filter(slice(_flags, -{k}, {k}), f -> f)) / cast({k} AS double)"


def _tail_slope(width: int) -> str:
    k = f"least(m, {width})"
    return f"CASE WHEN {k} < 2 THEN 0.0D ELSE (get(_sig, m - 1) - get(_sig, m - {k})) / greatest({k} - 1, 1) END"


def feature_stats(
    windows: DataFrame, features: list[str], rules: dict[str, Rule] | None = None, scoring: Scoring = Scoring()
) -> DataFrame:
    """Fans windows out to one row per (window, sensor) with its statistics; sensors without a point have ``n`` = 0."""
    keep = [c for c in windows.columns if c != "points"]
    df = windows.selectExpr(*keep, "points", f"inline({rules_sql(features, rules)})")
    df = stage(df, {"_s": "filter(transform(points, p -> named_struct('d', p.d, 'v', p.x[pos])), p -> p.v IS NOT NULL)"})
    df = stage(df.drop("points"), {"_v": "_s.v", "_days": "_s.d", "n": "size(_s)"}).drop("_s")
    later, earlier = "slice({0}, 2, greatest(n - 1, 0))", "slice({0}, 1, greatest(n - 1, 0))"
    df = stage(df, {"signal_kind": "CASE WHEN mode = 'delta' AND n >= 2 THEN 'delta' ELSE 'level' END"})
    df = stage(
        df,
        {
            "_sig": f"CASE WHEN signal_kind = 'delta' THEN zip_with({later.format('_v')}, {earlier.format('_v')}, (b, a) -> b - a) ELSE _v END",
            "_sd": f"CASE WHEN signal_kind = 'delta' THEN {later.format('_days')} ELSE _days END",
        },
    )
    df = stage(df, {"m": "size(_sig)", "_head": f"slice(_sig, 1, {_head_size('size(_sig)')})"})
    df = stage(df, {"signal_baseline": median_sql("_head")})
    # the abnormal test uses the plain threshold, the severity also the robust floor
    df = stage(
        df,
        {
            "_gap": "transform(_head, v -> abs(v - signal_baseline))",
            "_thr": "greatest(min_abs_delta, abs(signal_baseline) * min_pct_delta)",
            "_side": "CASE WHEN direction IN ('high_bad', 'high_warn') THEN 1.0D ELSE -1.0D END",
        },
    )
    df = stage(
        df,
        {
            "threshold_abs": f"greatest(_thr, {1.5 * 1.4826!r}D * {median_sql('_gap')})",
            "_flags": "transform(_sig, v -> _side * (v - signal_baseline) >= _thr)",
        },
    )
    longest = (
        "aggregate(_flags, named_struct('run', 0, 'best', 0), (a, f) -> named_struct('run', if(f, a.run + 1, 0), "
        "'best', greatest(a.best, if(f, a.run + 1, 0))), a -> a.best)"
    )
    df = stage(
        df,
        {
            "_hits": "filter(zip_with(_sd, _flags, (d, f) -> if(f, d, NULL)), d -> d IS NOT NULL)",
            "signal_current": "get(_sig, m - 1)",
            "abnormal_ratio_3d": _tail_ratio(3),
            "abnormal_ratio_7d": _tail_ratio(7),
            "abnormal_ratio_14d": _tail_ratio(14),
            "streak_tail": "cast(if(array_position(reverse(_flags), false) = 0, m, array_position(reverse(_flags), false) - 1) AS int)",
            "streak_max": longest,
            "slope_3": _tail_slope(3),
            "slope_14": _tail_slope(14),
            "mean": "try_divide(aggregate(_v, 0.0D, (a, v) -> a + v), n)",
            "min": "array_min(_v)",
            "max": "array_max(_v)",
            "current": "get(_v, n - 1)",
            "delta": "coalesce(get(_v, n - 1) - get(_v, n - 2), 0.0D)",
            "baseline": median_sql(f"slice(_v, 1, {_head_size('n')})"),
            "last_day": "get(_days, n - 1)",
            "enough": "m >= greatest(min_points, 1)",
        },
    )
    df = stage(
        df,
        {
            "first_abnormal_day": "get(_hits, 0)",
            "last_abnormal_day": "get(_hits, size(_hits) - 1)",
            "abnormal_ratio": "if(enough, size(_hits) / cast(greatest(m, 1) AS double), 0.0D)",
            "deviation_abs": "_side * (signal_current - signal_baseline) + 0.0D",
            "burst_ratio": "least(abs(slope_3) / (abs(slope_14) + 1e-9D), 999.0D)",
            "reliability": "least(1.0D, m / cast(greatest(min_points, 1) AS double))",
            # a cooldown asks for that many more abnormal points in a row
            "current_abnormal": "enough AND streak_tail > 0 AND streak_tail >= least(m, cooldown_days + 1)",
            "std": "sqrt(try_divide(aggregate(_v, 0.0D, (a, v) -> a + (v - mean) * (v - mean)), n))",
        },
    )
    df = stage(
        df,
        {
            "_sev": "least(least(1.0D, abs(deviation_abs) / (threshold_abs * 2.0D + 1e-9D)), greatest(0.0D, cap))",
            "deviation_pct": "deviation_abs / (abs(signal_baseline) + 1.0D)",
            "z_like": "least(abs(deviation_abs) / (std + 1e-9D), 99.0D)",
        },
    )
    df = stage(df, {"severity": "if(enough, _sev, least(_sev, 0.25D))"})
    bar = f"abnormal_ratio >= {scoring.watch_ratio_threshold!r}D"
    df = stage(df, {"watch_flag": f"enough AND NOT current_abnormal AND ({bar} OR severity >= {scoring.watch_severity_threshold!r}D)"})
    df = stage(
        df,
        {
            "status": "CASE WHEN NOT enough THEN 'insufficient' WHEN current_abnormal THEN 'abnormal' WHEN watch_flag THEN 'watch' "
            "WHEN first_abnormal_day IS NOT NULL THEN 'was_abnormal' ELSE 'normal' END",
            "active": f"current_abnormal OR watch_flag OR {bar}",
        },
    )
    df = df.withColumn("smart", smart_name(F.col("feature")))
    return df.drop("_v", "_days", "_sig", "_sd", "_head", "_gap", "_thr", "_side", "_flags", "_hits", "_sev", "enough")


def contribution_sql(scoring: Scoring = Scoring()) -> str:
    """What one sensor adds to the score of its group."""
    recency = f"coalesce(greatest(0.35D, 1.0D - (last_day - last_abnormal_day) / {float(scoring.recency_horizon_days)!r}D), 0.35D)"
    state = (
        f"CASE WHEN current_abnormal THEN {scoring.abnormal_multiplier!r}D "
        f"WHEN active THEN {scoring.watch_multiplier!r}D * {recency} ELSE 0.0D END"
    )
    return f"CASE WHEN group != 'unknown' THEN weight * severity * reliability * {state} ELSE 0.0D END"


STAT_FIELDS = [
    "pos", "feature", "smart", "src", "group", "direction", "mode", "n", "severity", "deviation_abs", "deviation_pct",
    "current_abnormal", "watch_flag", "active", "abnormal_ratio", "contrib",
]


def disk_windows(stats: DataFrame, disk: str = "disk", day: str = "day", extra: list[str] = ()) -> DataFrame:
    """Gathers the sensor rows of a window into one row with ``stats`` in sensor order.

    Grouping by (disk, tile, day) keeps the partitioning of the window, so there is no second shuffle. A group holds at most one
    struct per sensor column.
    """
    df = stage(stats, {"contrib": contribution_sql()})
    item = f"if(n > 0, struct({', '.join([*STAT_FIELDS, *extra])}), NULL)"
    same = [c for c in ("model", "failure", "n_rows", "start_day") if c in df.columns]
    grouped = df.groupBy(disk, "_tile", day).agg(
        *[F.first(c).alias(c) for c in same], F.expr(f"array_sort(collect_list({item}))").alias("stats")
    )
    return grouped.drop("_tile")
