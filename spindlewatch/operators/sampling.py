"""Seeded sampling. Random numbers are functions of (seed, row key), so they do not depend on partitioning or retries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.names import ROOT_CAUSES
from spindlewatch.functions.ordered import running
from spindlewatch.operators.windows import stage


def uniform(keys: list[str], seed: int = 1, salt: str = "") -> Column:
    """A number in [0, 1) per row key."""
    text = F.concat_ws("|", F.lit(f"{seed}{salt}"), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def normal(keys: list[str], seed: int = 1) -> Column:
    """A standard normal number per row key (Box-Muller on two uniforms)."""
    u1, u2 = uniform(keys, seed, "a"), uniform(keys, seed, "b")
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(F.lit(6.283185307179586) * u2)


def poisson_counts(df: DataFrame, u: str, lam: float | str, out: str) -> DataFrame:
    """Poisson count for a uniform column ``u`` by the inverse distribution; ``lam`` is a number or a column.

    A count k needs the sum of lam^i/i! up to k-1 to stay at or below u·e^lam. For a number these sums are literals; for a column they
    are added up, only where the count is not 0 and only as far as a 52-bit uniform can reach.
    """
    if isinstance(lam, float):
        sums, term, i = [1.0], 1.0, 1
        while term > 1e-18 * sums[-1]:
            term *= lam / i
            sums.append(sums[-1] + term)
            i += 1
        # the one-element transform binds the target, which would otherwise be inlined and computed per comparison
        literal = ", ".join(f"{x!r}D" for x in sums)
        return stage(df, {out: f"transform(array({u} * exp({lam!r}D)), t -> size(filter(array({literal}), x -> x <= t)))[0]"})
    df = stage(df, {"_t": f"{u} * exp({lam})", "_steps": f"cast(ceil({lam} + 9.0D * sqrt({lam}) + 12.0D) AS int)"})
    step = f"(a, i) -> if(a.s > _t, a, named_struct('p', a.p * {lam} / i, 's', a.s + a.p * {lam} / i, 'k', a.k + 1))"
    fold = f"aggregate(sequence(1, _steps), named_struct('p', 1.0D, 's', 1.0D, 'k', 0), {step}, a -> a.k)"
    return stage(df, {out: f"if(_t < 1.0D, 0, {fold})"}).drop("_t", "_steps")


def poisson_weights(df: DataFrame, keys: list[str], label: str, down_ratio: Column, lam: float = 6.0, seed: int = 1) -> DataFrame:
    """Training weight per row: negatives Poisson(lam / down_ratio), positives Poisson(lam)."""
    df = df.withColumns({"_u": uniform(keys, seed), "_lam": F.when(F.col(label) > 0, F.lit(lam)).otherwise(F.lit(lam) / down_ratio)})
    return poisson_counts(df, "_u", "_lam", "weight").drop("_u", "_lam")


def bootstrap(df: DataFrame, keys: list[str], lam: float = 1.0, seed: int = 1) -> DataFrame:
    """Each row repeated Poisson(lam) times (``copy`` counts from 1)."""
    df = poisson_counts(df.withColumn("_u", uniform(keys, seed)), "_u", float(lam), "_k").where("_k > 0")
    return stage(df, {"copy": "explode(sequence(1, _k))"}).drop("_u", "_k")


def resample(df: DataFrame, keys: list[str], label: str, fractions: dict, seed: int = 1) -> DataFrame:
    """Keeps a fraction of every class."""
    keep = F.lit(False)
    u = uniform(keys, seed)
    for value, share in fractions.items():
        keep = keep | ((F.col(label) == value) & (u < share))
    return df.where(keep)


def partition(df: DataFrame, keys: list[str], parts: int, seed: int = 1) -> DataFrame:
    """Adds ``part`` in 0 .. parts-1."""
    return df.withColumn("part", F.floor(uniform(keys, seed) * parts).cast("int"))


def add_noise(df: DataFrame, key: str, value: str, fraction: float, seed: int = 1, ranges: int | None = None) -> DataFrame:
    """Gaussian noise of ``fraction`` times the standard deviation of the values seen so far in the order ``key``."""
    x = F.col(value)
    df = running(df, key, {"_s": x, "_q": x * x, "_c": F.lit(1).cast("bigint")}, ranges=ranges)
    var = F.greatest(F.lit(0.0), F.col("_q") / F.col("_c") - F.pow(F.col("_s") / F.col("_c"), 2))
    return df.withColumn(value, x + normal([key], seed) * F.sqrt(var) * fraction).drop("_s", "_q", "_c")


def flip_class(df: DataFrame, keys: list[str], label: str, classes: int, fraction: float, seed: int = 1) -> DataFrame:
    """Replaces a share of the labels by a different class."""
    jump = 1 + F.floor(uniform(keys, seed, "c") * (classes - 1)).cast("int")
    return df.withColumn(label, F.when(uniform(keys, seed) < fraction, (F.col(label) + jump) % classes).otherwise(F.col(label)))


def irrelevant_features(df: DataFrame, keys: list[str], numeric: int, categorical: int, values: int = 5, seed: int = 1) -> DataFrame:
    nums = {f"irrelevant_num_{i}": uniform(keys, seed, f"n{i}") for i in range(numeric)}
    cats = {f"irrelevant_cat_{i}": F.floor(uniform(keys, seed, f"k{i}") * values).cast("int") for i in range(categorical)}
    return df.withColumns({**nums, **cats})


def day_quotas(counts: DataFrame, total: int, day: str = "day", seed: int = 1) -> DataFrame:
    """How many windows each day contributes to ``total``: one each, the rest by volume with largest remainders.

    ``counts`` has one row per day, so the two windows over all of it stay small. With more days than ``total``, days are drawn.
    """
    everything = Window.partitionBy()
    df = counts.withColumns({"_days": F.count(F.lit(1)).over(everything), "_all": F.sum("n").over(everything)})
    exact = F.greatest(F.lit(total) - F.col("_days"), F.lit(0)) * F.col("n") / F.col("_all")
    df = df.withColumn("_exact", exact).withColumn("_extra", F.floor("_exact"))
    df = df.withColumns(
        {
            "_left": F.greatest(F.lit(total) - F.col("_days"), F.lit(0)) - F.sum("_extra").over(everything),
            "_frac": F.row_number().over(Window.partitionBy().orderBy(F.round(F.col("_exact") - F.col("_extra"), 9).desc(), day)),
            "_draw": F.row_number().over(Window.partitionBy().orderBy(uniform([day], seed), day)),
        }
    )
    few = F.when(F.col("_draw") <= total, 1).otherwise(0)
    many = 1 + F.col("_extra") + F.when(F.col("_frac") <= F.col("_left"), 1).otherwise(0)
    return df.select(day, F.when(F.col("_days") >= total, few).otherwise(many).cast("bigint").alias("quota"))


def stratified_windows(keys: DataFrame, total: int, disk: str = "disk", day: str = "day", seed: int = 1) -> DataFrame:
    """Draws window keys per day up to the day's quota; the literal rank limit prunes rows before the shuffle."""
    quotas = day_quotas(keys.groupBy(day).agg(F.count(F.lit(1)).alias("n")), total, day, seed)
    drawn = keys.withColumn("_u", uniform([disk, day], seed))
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy(day).orderBy("_u", disk))).where(F.col("_r") <= total)
    return ranked.join(quotas, day).where("_r <= quota").select(*keys.columns)


def reference_score() -> Column:
    events = F.least(F.size("events"), F.lit(3)) / 3.0
    return 0.55 * F.col("confidence") + 0.35 * F.col("risk_hint") + 0.10 * events


def select_references(examples: DataFrame, limit: int, per_cause: int = 2, cause: str = "root_cause", tie: list[str] = ("disk", "day")) -> DataFrame:
    """Round robin over causes for ``per_cause`` rounds, then the best of the rest, ``limit`` rows in all.

    No cause can supply more than per_cause + limit rows, so that many candidates per cause are enough and the choice is exact.
    """
    df = examples.withColumn("score", F.round(reference_score(), 9))
    w = Window.partitionBy(cause).orderBy(F.col("score").desc(), *tie)
    df = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_cause + limit)
    order = F.array_position(F.array(*[F.lit(c) for c in ROOT_CAUSES]), F.col(cause))
    first = F.col("_r") <= per_cause
    keys = [F.when(first, 0).otherwise(1), F.when(first, F.col("_r")).otherwise(0), F.when(first, order).otherwise(0), F.col("score").desc(), *[F.col(t) for t in tie]]
    ranked = df.orderBy(*keys).limit(limit)
    return ranked.withColumn("pick", F.row_number().over(Window.partitionBy().orderBy(*keys))).drop("_r")


def coverage(references: DataFrame, cause: str = "root_cause") -> DataFrame:
    """Examples per cause, with a row for causes that have none: one conditional count per cause, then turned into rows."""
    totals = references.agg(*[F.count_if(F.col(cause) == c).alias(c) for c in ROOT_CAUSES])
    return totals.unpivot([], ROOT_CAUSES, "cause", "n")


def reference_gate(references: DataFrame, required: list[str], minimum: int = 1, mode: str = "auto") -> tuple[bool, list[str]]:
    """(use the references, missing causes): a planning decision on the six coverage counts."""
    counts = {r["cause"]: r["n"] for r in coverage(references).collect()}  # six rows
    missing = [c for c in required if counts.get(c, 0) < minimum]
    return (mode == "force" or (mode == "auto" and not missing)), missing


def random_budget(df: DataFrame, keys: list[str], budget: float, seed: int = 1) -> DataFrame:
    """Active selection at random: asks for the label of a ``budget`` share of the rows."""
    return df.withColumn("queried", uniform(keys, seed) < budget)


def uncertain(df: DataFrame, posterior: str, threshold: float) -> DataFrame:
    """Active selection by uncertainty: asks where the largest class probability stays below the threshold."""
    share = "aggregate({0}, 0.0D, (a, v) -> a + v)".format(posterior)
    return stage(df, {"queried": f"coalesce(try_divide(array_max({posterior}), {share}), 0.0D) < {threshold!r}D"})


def budget_spent(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Share of queried rows up to and including each row."""
    df = running(df, key, {"_q": F.col("queried").cast("bigint"), "_n": F.lit(1).cast("bigint")}, ranges=ranges)
    return df.withColumn("spent", F.col("_q") / F.col("_n")).drop("_q", "_n")
