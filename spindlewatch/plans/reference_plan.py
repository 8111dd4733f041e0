"""Queries over the choice of reference examples."""
from __future__ import annotations

from pyspark.sql import functions as F

from spindlewatch.functions.names import ROOT_CAUSES
from spindlewatch.functions.scalars import r4
from spindlewatch.operators import references
from spindlewatch.plans.windows_plan import root_sql, stored_summaries

PER_CAUSE, MIN_KNOWN = 2, 9


def examples(spark, sf):
    """Windows as examples; confidence and risk are those that a text states, with six decimals."""
    df = stored_summaries(spark, sf).select("disk", "day", "n_rows", "root_cause", "confidence", "risk_hint", "events")
    return df.withColumns({c: F.round(c, 6) for c in ("confidence", "risk_hint")})


def chosen(spark, sf):
    return references.diverse_references(examples(spark, sf), PER_CAUSE, 1, MIN_KNOWN)


def q_references(spark, sf):
    return chosen(spark, sf).select(F.col("pick").cast("bigint").alias("pick"), "phase", "disk", "day", "root_cause", r4(F.col("score")).alias("score"))


def q_quality(spark, sf):
    rows = examples(spark, sf)
    out = references.reference_quality(rows, references.diverse_references(rows, PER_CAUSE, 1, MIN_KNOWN))
    return out.select("cause", "pool_records", "selected", "missing", "selected_examples", "known_ratio")


def q_gate(spark, sf):
    return references.gate_decisions(chosen(spark, sf))


# ---- SQL twins ---------------------------------------------------------------------------------------------------------------
_STEPS = ", ".join(f"({i + 1}, '{c}', 0)" for i, c in enumerate(c for c in ROOT_CAUSES for _ in range(PER_CAUSE)))
_KNOWN_STEPS = ", ".join(f"({len(ROOT_CAUSES) * PER_CAUSE + j}, 'known', {j})" for j in range(1, MIN_KNOWN + 1))
_BONUS = "((CASE WHEN list_contains(g.disks, p.disk) THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END)+(CASE WHEN list_contains(g.days, p.day) THEN 0.0::DOUBLE ELSE 0.03::DOUBLE END))"
_KEY = "p.pool||'|'||p.disk||'|'||p.day"
_CHOSEN = f"""WITH RECURSIVE {root_sql()},
ex AS (SELECT disk, day, n_rows, root_cause AS cause, round(0.55::DOUBLE*round(confidence,6)+0.35::DOUBLE*round(risk_hint,6)+0.10::DOUBLE*(least(len(ev),3)/3.0::DOUBLE),9) AS score FROM tg),
po AS (SELECT cause AS pool, * FROM ex WHERE n_rows>=3 UNION ALL SELECT 'known', * FROM ex WHERE cause<>'unknown'),
steps(step, pool, turn) AS (VALUES {_STEPS}, {_KNOWN_STEPS}),
g AS (SELECT 0 AS step, []::VARCHAR[] AS disks, []::DATE[] AS days, []::VARCHAR[] AS gone, 0 AS known, NULL::VARCHAR AS pool, NULL::VARCHAR AS disk, NULL::DATE AS day, NULL::VARCHAR AS cause, NULL::DOUBLE AS score
  UNION ALL
  SELECT s.step, CASE WHEN p.disk IS NULL THEN g.disks ELSE list_append(g.disks, p.disk) END, CASE WHEN p.day IS NULL THEN g.days ELSE list_append(g.days, p.day) END,
    CASE WHEN p.disk IS NULL THEN g.gone ELSE list_append(g.gone, {_KEY}) END, g.known + CASE WHEN s.turn=0 AND p.cause<>'unknown' THEN 1 ELSE 0 END, s.pool, p.disk, p.day, p.cause, p.score
  FROM g JOIN steps s ON s.step=g.step+1 AND s.turn<=greatest(0, {MIN_KNOWN}-g.known) LEFT JOIN po p ON p.pool=s.pool AND NOT list_contains(g.gone, {_KEY})
  QUALIFY row_number() OVER (ORDER BY p.score+{_BONUS} DESC NULLS LAST, p.score DESC NULLS LAST, p.disk, p.day)=1),
ch AS (SELECT * FROM g WHERE disk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY disk, day ORDER BY step)=1)"""
_COVER = f"""{_CHOSEN}, c AS (SELECT unnest([{','.join(repr(c) for c in ROOT_CAUSES)}]) AS cause),
q AS (SELECT cause, (SELECT count(*) FROM ex WHERE ex.cause=c.cause) AS pool_records, (SELECT count(*) FROM ch WHERE ch.cause=c.cause) AS selected FROM c)"""
_LISTS = " UNION ALL ".join(f"SELECT '{p}' AS profile, [{','.join(repr(c) for c in cs)}] AS required" for p, cs in references.REQUIRED_CAUSES.items())

QUERIES = {"reference_examples": q_references, "reference_examples_quality": q_quality, "fewshot_gate": q_gate}
ORACLE = {
    "reference_examples": f"{_CHOSEN} SELECT row_number() OVER (ORDER BY step) AS pick, CASE WHEN pool='known' THEN 'known' ELSE 'cause' END AS phase, disk, day, cause AS root_cause, round(score,4)+0.0::DOUBLE AS score FROM ch",
    "reference_examples_quality": f"""{_COVER} SELECT cause, pool_records, selected, selected=0 AND cause<>'unknown' AS missing, (sum(selected) OVER ())::BIGINT AS selected_examples,
      round(coalesce((sum(CASE WHEN cause<>'unknown' THEN selected ELSE 0 END) OVER ())/nullif((sum(selected) OVER ())::DOUBLE,0),0.0::DOUBLE),6) AS known_ratio FROM q""",
    "fewshot_gate": f"""{_COVER}, r AS ({_LISTS}), a AS (SELECT profile, unnest(required) AS cause, unnest(range(len(required))) AS i FROM r),
      m AS (SELECT profile, coalesce(string_agg(a.cause, ',' ORDER BY i) FILTER (q.selected<1), '') AS missing FROM a JOIN q ON q.cause=a.cause GROUP BY profile),
      n AS (SELECT sum(selected)::BIGINT AS n FROM q) SELECT profile, mode, missing,
      CASE WHEN mode='off' OR (mode='auto' AND missing<>'') THEN 0 ELSE n END AS used FROM m, n, (SELECT unnest(['auto','off','force']) AS mode)""",
}
