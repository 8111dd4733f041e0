"""Text summary of a window. Every line is a SQL expression on the ``stats`` array.

Number formatting happens once per sensor row (``with_text``), so line building only sorts, filters and joins strings.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.functions.names import SCORED_CAUSES, mask_disk_id
from spindlewatch.functions.scalars import fixed_sql
from spindlewatch.operators.windows import stage


def _formatted(values: list[str], digits: int, plus: bool = False) -> str:
    """Several numbers formatted alike in one array (one lambda instead of one expression tree per number)."""
    return f"transform(array({', '.join(values)}), x -> {fixed_sql('x', digits, plus)})"


def with_text(stats: DataFrame) -> DataFrame:
    """Adds the formatted pieces of a sensor row (``t_*``), before rows are gathered per window.

    A sensor that is not active is written in no line but the evidence, so it has no piece but ``t_sev``.
    """
    df = stage(
        stats,
        {
            "_b": "if(mode = 'delta', signal_baseline, baseline)",
            "_c": "if(mode = 'delta', signal_current, current)",
            "_p": "if(abnormal_ratio_14d = 0, abnormal_ratio, abnormal_ratio_14d)",
            "_sign": "if(deviation_pct >= 0, '+', '')",
            "_state": "CASE WHEN current_abnormal THEN 'abnormal' WHEN active THEN 'watch' ELSE 'history' END",
        },
    )
    two = ["_b", "_c", "_p", "z_like", "abnormal_ratio", "burst_ratio", "abnormal_ratio_3d", "abnormal_ratio_7d", "abnormal_ratio_14d"]
    df = stage(
        df,
        {
            "_sev2": f"{_formatted(['severity'], 2)}[0]",
            "_f": f"if(active, {_formatted(two, 2)}, NULL)",
            "_s": f"if(active, {_formatted(['slope_3', 'slope_14'], 3, True)}, NULL)",
            "_d": f"if(active, concat(_sign, {_formatted(['deviation_pct * 100.0D'], 1)}[0]), NULL)",
            "_t": f"if(active, concat(_sign, {_formatted(['deviation_pct'], 3)}[0]), NULL)",
        },
    )
    b, c, p, z, ratio, burst, r3, r7, r14 = (f"_f[{i}]" for i in range(9))
    sev = "_sev2"
    df = stage(
        df,
        {
            "t_line": f"concat('- ', smart, ' ', src, ' ', mode, ' baseline=', {b}, ' current=', {c}, ' delta_pct=', _d, ' z=', {z}, "
            f"' severity=', {sev}, ' state=', _state)",
            "t_table": f"concat('- feat=', smart, '|src=', src, '|mode=', mode, '|dir=', direction, '|baseline=', {b}, '|current=', {c}, "
            f"'|delta_pct=', _d, '|abnormal_ratio=', {ratio}, '|persistence=', {p}, '|slope3=', _s[0], '|slope14=', _s[1], "
            f"'|burst_ratio=', {burst}, '|severity=', {sev}, '|group=', group)",
            "t_ratio": f"concat(smart, '=', {ratio})",
            "t_trend": "concat(smart, '=', _t)",
            "t_delta": f"concat(smart, '=', _d, '%|z', {z}, '|sev', {sev})",
            "t_profile": f"concat(smart, '=p3:', {r3}, ',p7:', {r7}, ',p14:', {r14}, ',streak:', streak_tail)",
            "t_burst": f"concat(smart, '=s3:', _s[0], ',s14:', _s[1], ',burst:', {burst})",
            "t_sev": f"concat(smart, '(', {sev}, ')')",
        },
    )
    return df.drop("_b", "_c", "_p", "_sign", "_state", "_sev2", "_f", "_s", "_d", "_t")


TEXT_FIELDS = ["t_line", "t_table", "t_ratio", "t_trend", "t_delta", "t_profile", "t_burst", "t_sev"]


def _by_severity(items: str, ascending: bool = False) -> str:
    sign = "" if ascending else "-"
    key = f"struct({sign}s.severity AS a, {sign}abs(s.deviation_abs) AS b, i AS i, s AS s)"
    return f"array_sort(transform({items}, (s, i) -> {key})).s"


def _first_per_sensor(column: str) -> str:
    return f"filter({column}, (s, i) -> array_position({column}.smart, s.smart) = i + 1)"


def _line(head: str, tokens: str) -> str:
    return f"concat('{head}', if(size({tokens}) = 0, 'none', array_join({tokens}, ' ')))"


def _best_token(token: str, weight: str) -> str:
    """One token per sensor in selection order: the one of largest ``weight``, the first on ties."""
    tagged = f"transform(_sel, (s, i) -> struct({weight} AS w, -i AS i, s.{token} AS t, s.smart AS n))"
    return f"transform(array_distinct(_sel.smart), n -> array_max(filter({tagged}, t -> t.n = n)).t)"


def _or_none(lines: str) -> str:
    return f"if(size({lines}) = 0, '- none', array_join({lines}, '\\n'))"


def with_lines(df: DataFrame, top_k: int = 8, anomaly_top_k: int = 8) -> DataFrame:
    """Adds one column per summary line (``l_*``); needs scores and root cause."""
    # abnormal before watched, known groups before unknown ones, most severe first
    rank = "if(s.group = 'unknown', 2, 0) + if(s.current_abnormal, 0, 1)"
    key = f"struct({rank} AS r, -s.severity AS a, -abs(s.deviation_abs) AS b, s.pos AS i, s AS s)"
    cols = {
        "_sel": f"slice(array_sort(transform(filter(stats, s -> s.active), s -> {key})), 1, {max(1, top_k)}).s",
        "_cov": "aggregate(stats, 0.0D, (a, s) -> a + least(1.0D, s.n / cast(n_rows AS double)))",
    }
    for g in SCORED_CAUSES:
        cols[f"_in_{g}"] = f"filter(stats, s -> s.group = '{g}')"
    df = stage(df, cols)
    cols = {
        "_ranked": _by_severity("_sel"),
        "_missing": "coalesce(greatest(0.0D, least(1.0D, 1.0D - try_divide(_cov, size(stats)))), 1.0D)",
        "_margin": "ranked[0].score - ranked[1].score",
        "_first": "ranked[0].score",
        "_second": "ranked[1].score",
    }
    for g in SCORED_CAUSES:
        cols[f"_hot_{g}"] = _by_severity(f"filter(_in_{g}, s -> s.active)")
        cols[f"_worst_{g}"] = f"coalesce(array_max(filter(_in_{g}, s -> s.active).severity), 0.0D)"
    df = stage(df, cols)
    cols = {"_top": f"slice({_first_per_sensor('_ranked')}, 1, 5)"}
    for g in SCORED_CAUSES:
        cols[f"_pos_{g}"] = _first_per_sensor(f"_hot_{g}")
    df = stage(df, cols)
    # what is not kept as positive evidence counts against the cause, the mildest first
    df = stage(
        df,
        {
            f"_neg_{g}": f"slice({_by_severity(f'filter(_in_{g}, s -> NOT array_contains(_pos_{g}.pos, s.pos))', ascending=True)}, 1, 1)"
            for g in SCORED_CAUSES
        },
    )
    evidence, groups = [], []
    for g in SCORED_CAUSES:
        tokens = (
            f"concat(transform(slice(_pos_{g}, 1, 2), s -> concat('+', s.t_sev)), if(size(_pos_{g}) = 0 AND size(_neg_{g}) = 0, "
            f"array('-none'), transform(_neg_{g}, s -> concat('-', s.t_sev))))"
        )
        evidence.append(f"concat('{g}=', if(size(_in_{g}) = 0, 'none', array_join({tokens}, ',')))")
        i = SCORED_CAUSES.index(g)
        groups.append(f"concat('{g}=', size(_hot_{g}), '/', size(_in_{g}), ':', _f2[{i}])")
    scores = ", ".join(f"concat('{g}=', _f3[{i}])" for i, g in enumerate(SCORED_CAUSES))
    df = df.withColumn("_mask", mask_disk_id(F.col("disk")))
    df = stage(
        df,
        {
            "_f2": _formatted([*[f"_worst_{g}" for g in SCORED_CAUSES], "_missing"], 2),
            "_f3": _formatted([*[f"score_{g}" for g in SCORED_CAUSES], "_first", "_second", "_margin"], 3),
        },
    )
    return stage(
        df,
        {
            "l_window": "concat('WINDOW: ', date_format(start_day, 'yyyy-MM-dd'), '~', date_format(day, 'yyyy-MM-dd'), ' (', n_rows, 'd) disk=', _mask)",
            "l_quality": f"concat('DATA_QUALITY: valid_days=', n_rows, ' missing_ratio=', _f2[5], ' active_features=', "
            "size(filter(stats, s -> s.active)), '/', size(stats), ' known_features=', size(filter(stats, s -> s.group != 'unknown')))",
            "l_scores": f"concat('RULE_SCORE: ', concat_ws(' ', {scores}))",
            "l_top2": f"concat('RULE_TOP2: ', ranked[0].cause, '=', _f3[5], ' ', ranked[1].cause, '=', _f3[6], "
            f"' margin=', _f3[7])",
            "l_allowed": _line("ALLOWED_EVENT_FEATURES: ", "array_distinct(_sel.smart)"),
            "l_table": f"concat('ANOMALY_TABLE:\\n', {_or_none(f'slice(_ranked, 1, {max(1, anomaly_top_k)}).t_table')})",
            "l_anomalies": f"concat('ANOMALIES:\\n', {_or_none('_sel.t_line')})",
            "l_persistence": _line("ANOMALY_PERSISTENCE: ", _best_token("t_ratio", "s.abnormal_ratio")),
            "l_trend": _line("TREND_DELTA: ", _best_token("t_trend", "abs(s.deviation_pct)")),
            "l_delta": _line("FEATURE_DELTA_TOPK: ", "_top.t_delta"),
            "l_profile": _line("PERSISTENCE_PROFILE: ", "_top.t_profile"),
            "l_burst": _line("BURST_VS_DRIFT: ", "_top.t_burst"),
            "l_evidence": f"concat('CAUSE_EVIDENCE: ', if(size(stats) = 0, 'none', concat_ws(' ', {', '.join(evidence)})))",
            "l_groups": f"concat('GROUP_SIGNAL: ', if(size(stats) = 0, 'none', concat_ws(' ', {', '.join(groups)})))",
            "l_pred": "concat('RULE_PRED: ', root_cause)",
        },
    )


# Line order of the two layouts.
LAYOUTS = {
    "structured_v2": ["window", "quality", "scores", "top2", "allowed", "table", "evidence", "pred"],
    "structured_v2_with_legacy": [
        "window", "quality", "scores", "top2", "allowed", "table", "evidence", "pred",
        "persistence", "trend", "delta", "profile", "burst", "groups",
    ],
    "legacy": [
        "window", "anomalies", "allowed", "persistence", "trend", "delta", "profile", "burst", "evidence", "quality", "groups",
        "top2", "scores", "pred",
    ],
}


def summary_text(layout: str = "legacy") -> Column:
    return F.concat_ws("\n", *[F.col(f"l_{name}") for name in LAYOUTS[layout]])
