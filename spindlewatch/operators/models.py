"""Models as Spark jobs: relational estimators, MLlib learners per chunk, and ways to combine predictions."""
from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.ordered import overlap_tiles, row_numbers, running
from spindlewatch.operators.windows import stage
from spindlewatch.session import checked_broadcast
from spindlewatch.session import cut_lineage

FITS = 4
#: A word that is more than this part of all words is joined by broadcast.
COMMON_WORDS = 100_000

# ---- estimators ---------------------------------------------------------------------------------------------------------------


def gaussian(df: DataFrame, value: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Weighted mean and sample variance."""
    w, x = (F.col(weight) if weight else F.lit(1.0)), F.col(value)
    out = df.groupBy(*by).agg(F.sum(w).alias("weight"), F.sum(w * x).alias("_s"), F.sum(w * x * x).alias("_q"))
    return stage(
        out, {"mean": "try_divide(_s, weight)", "variance": "if(weight > 1, greatest(0.0D, (_q - _s * _s / weight) / (weight - 1)), 0.0D)"}
    ).drop("_s", "_q")


def log_density(x: Column, mean: Column, variance: Column) -> Column:
    """Log of the normal density; a zero variance gives weight only to its mean."""
    point = F.when(x == mean, 0.0).otherwise(-700.0)
    return F.when(variance > 0, -0.5 * F.log(2.0 * math.pi * variance) - (x - mean) * (x - mean) / (2.0 * variance)).otherwise(point)


def quantile_summary(df: DataFrame, value: str, probs: list[float], by: list[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles from a mergeable summary."""
    return df.groupBy(*by).agg(F.percentile_approx(value, probs, accuracy).alias("quantiles"))


def split_merit(df: DataFrame, branch: str, klass: str, by: list[str] = ()) -> DataFrame:
    """Information gain and Gini gain of a split, from class counts per branch."""
    cell = df.groupBy(*by, branch, klass).agg(F.count(F.lit(1)).alias("n"))
    plogp = lambda a, b: -F.col(a) / F.col(b) * F.log2(F.col(a) / F.col(b))
    inner = cell.withColumn("b", F.sum("n").over(Window.partitionBy(*by, branch)))  # few rows: branches × classes
    inside = inner.groupBy(*by, branch).agg(F.first("b").alias("b"), F.sum(plogp("n", "b")).alias("h"), F.sum(F.pow(F.col("n") / F.col("b"), 2)).alias("s"))
    post = inside.groupBy(*by).agg(F.sum("b").alias("total"), F.sum(F.col("b") * F.col("h")).alias("_h"), F.sum(F.col("b") * (1.0 - F.col("s"))).alias("_g"))
    tops = cell.groupBy(*by, klass).agg(F.sum("n").alias("n")).withColumn("b", F.sum("n").over(Window.partitionBy(*by)))
    pre = tops.groupBy(*by).agg(F.sum(plogp("n", "b")).alias("_ph"), (1.0 - F.sum(F.pow(F.col("n") / F.col("b"), 2))).alias("_pg"))
    out = post.join(pre, by) if by else post.withColumns({c: pre.select(c).scalar() for c in ("_ph", "_pg")})
    return out.select(*by, (F.col("_ph") - F.col("_h") / F.col("total")).alias("info_gain"), (F.col("_pg") - F.col("_g") / F.col("total")).alias("gini_gain"))


def variance_reduction(df: DataFrame, branch: str, target: str, by: list[str] = ()) -> DataFrame:
    """Reduction of variance and of standard deviation of a numeric target by a split."""
    y = F.col(target)
    part = df.groupBy(*by, branch).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    var = lambda n, s, q: F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))
    part = part.withColumn("v", var(F.col("n"), F.col("s"), F.col("q")))
    out = part.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("v")).alias("iv"),
                                F.sum(F.col("n") * F.sqrt("v")).alias("isd"))
    whole = var(F.col("n"), F.col("s"), F.col("q"))
    return out.select(*by, (whole - F.col("iv") / F.col("n")).alias("variance_reduction"), (F.sqrt(whole) - F.col("isd") / F.col("n")).alias("sd_reduction"))


def majority(df: DataFrame, klass: str, by: list[str] = ()) -> DataFrame:
    """Most frequent class or label set per group; the smallest on ties. Counted per value first, so groups may be hot."""
    counted = df.groupBy(*by, klass).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*by).agg(F.min_by(klass, F.struct(-F.col("_n"), F.col(klass))).alias("majority"), F.sum("_n").alias("n"))


def naive_bayes_fit(df: DataFrame, klass: str, features: list[str], by: list[str] = ()) -> DataFrame:
    """Sufficient statistics per class: rows, and count, sum and square sum of every feature."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(features):
        x = F.col(f)
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    return df.groupBy(*by, klass).agg(*aggs)


def _nb_models(stats: DataFrame, klass: str, features: list[str], by: list[str]) -> DataFrame:
    """One row per model with an array over its classes (class, prior, means, variances)."""
    for i in range(len(features)):
        stats = stage(stats, {f"m{i}": f"coalesce(try_divide(s{i}, n{i}), 0.0D)", f"v{i}": f"if(n{i} > 1, greatest(0.0D, (q{i} - s{i} * s{i} / n{i}) / (n{i} - 1)), 0.0D)"})
    k = range(len(features))
    item = F.struct(F.col(klass).alias("k"), F.col("rows").alias("rows"), F.array(*[F.struct(F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"), F.col(f"n{i}").alias("n")) for i in k]).alias("f"))
    return stats.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_model"))


def naive_bayes_predict(df: DataFrame, stats: DataFrame, klass: str, features: list[str], by: list[str] = (), name: str = "prediction") -> DataFrame:
    """Class of the largest log prior plus log densities; rows without a model get null. Models are one small row per ``by``."""
    models = _nb_models(stats, klass, features, list(by))
    if by:
        df = df.join(models, list(by), "left")
    else:
        df = df.withColumn("_model", models.select("_model").scalar())
    total = F.aggregate("_model", F.lit(0).cast("bigint"), lambda a, m: a + m.rows)
    x = F.array(*[F.col(f).cast("double") for f in features])

    def score(m):
        terms = F.zip_with(x, m.f, lambda v, s: F.when(v.isNull() | (s["n"] == 0), 0.0).otherwise(log_density(v, s["m"], s["v"])))
        return F.log(m.rows / total) + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)

    best = F.array_max(F.transform("_model", lambda m, i: F.struct(score(m).alias("s"), (-i).alias("i"), m.k.alias("k"))))
    return df.withColumns({name: best.k, f"{name}_score": best.s}).drop("_model")


def _models_before(per_chunk: DataFrame, klass: str, sums: list[str], by: list[str], delay_chunks: int) -> DataFrame:
    """Model of every chunk from statistics per (chunk, class, by): running sums over the chunks before it.

    The table has one row per chunk, class and ``by``; combinations without rows are filled with zeros.
    """
    classes = per_chunk.agg(F.collect_set(klass)).scalar()
    keys = per_chunk.select("chunk", *by).distinct().withColumn("_k", classes).select("chunk", *by, F.explode("_k").alias(klass))
    filled = keys.join(per_chunk, ["chunk", *by, klass], "left").fillna(0, sums)
    w = Window.partitionBy(*by, klass).orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1 - delay_chunks)
    return filled.select("chunk", *by, klass, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums]).where("rows > 0")


def _chunked(df: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    return row_numbers(df, key, "n").withColumn("chunk", F.floor((F.col("n") - 1) / F.lit(chunk_rows)).cast("bigint"))


def prequential_naive_bayes(df: DataFrame, key: str, klass: str, features: list[str], chunk_rows: int, delay_chunks: int = 0) -> DataFrame:
    """Test-then-train by chunks without a loop: chunk t is scored by the statistics of the chunks before t - delay.

    Statistics are additive, so the model of every chunk is a running sum over the small table of chunk statistics.
    """
    numbered = _chunked(df, key, chunk_rows)
    per_chunk = naive_bayes_fit(numbered, klass, features, ["chunk"])
    sums = [c for c in per_chunk.columns if c not in ("chunk", klass)]
    return naive_bayes_predict(numbered, _models_before(per_chunk, klass, sums, [], delay_chunks), klass, features, ["chunk"])


def prequential_folds(
    df: DataFrame, key: str, klass: str, features: list[str], chunk_rows: int, folds: int, mode: str = "cv", delay_chunks: int = 0, seed: int = 1
) -> DataFrame:
    """Prequential validation with ``folds`` models; adds ``fold`` and its prediction.

    ``cv``: a row tests the model of its fold and trains all others. ``split``: it tests all others and trains its own. ``bootstrap``: it
    tests every model and trains each Poisson(1) times.
    """
    from spindlewatch.operators.sampling import poisson_counts, uniform

    numbered = cut_lineage(_chunked(df, key, chunk_rows))  # read by training and testing
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    mine = numbered.withColumn("_f", F.floor(uniform([key], seed) * folds).cast("int"))
    if mode == "bootstrap":
        trains = mine.withColumn("fold", every).withColumn("_u", uniform([key, "fold"], seed))
        trains = poisson_counts(trains, "_u", 1.0, "_c").where("_c > 0")
        trains, tests = stage(trains, {"_x": "explode(sequence(1, _c))"}), mine.withColumn("fold", every)
    else:
        own, others = F.col("fold") == F.col("_f"), F.col("fold") != F.col("_f")
        spread = mine.withColumn("fold", every)
        trains, tests = spread.where(others if mode == "cv" else own), spread.where(own if mode == "cv" else others)
    per_chunk = naive_bayes_fit(trains, klass, features, ["chunk", "fold"])
    sums = [c for c in per_chunk.columns if c not in ("chunk", "fold", klass)]
    models = _models_before(per_chunk, klass, sums, ["fold"], delay_chunks)
    return naive_bayes_predict(tests.drop("_f"), models, klass, features, ["chunk", "fold"])


def periodic_holdout(df: DataFrame, key: str, klass: str, features: list[str], test_rows: int, chunk_rows: int) -> DataFrame:
    """The first ``test_rows`` rows are held out; after every chunk of the rest the model so far scores them (``chunk`` = chunks trained)."""
    numbered = row_numbers(df, key, "n")
    rest = numbered.where(F.col("n") > test_rows).withColumn("chunk", F.floor((F.col("n") - test_rows - 1) / F.lit(chunk_rows)).cast("bigint"))
    per_chunk = naive_bayes_fit(rest, klass, features, ["chunk"])
    sums = [c for c in per_chunk.columns if c not in ("chunk", klass)]
    upto = _models_before(per_chunk.withColumn("chunk", F.col("chunk") + 1), klass, sums, [], -1)
    last = rest.agg(F.max("chunk")).scalar()
    tests = numbered.where(F.col("n") <= test_rows).withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("bigint"), last + 1)))
    return naive_bayes_predict(tests, upto, klass, features, ["chunk"])


def multinomial_bayes(docs: DataFrame, doc: str, text: str, klass: str, max_classes: int = 1000) -> DataFrame:
    """Multinomial naive Bayes on word counts with Laplace smoothing: predicted class per document.

    Scores are linear in counts, so no word is counted per document. The word table, a stored stage, holds one log probability per class
    and word. Fewer than ``COMMON_WORDS`` words can each be more than that part of all text: they are broadcast and scored where the text
    is read. Only the others meet the table in a shuffle by word, and none of them is frequent enough to be a hot key.
    """
    classes = [r[0] for r in docs.select(klass).distinct().orderBy(klass).limit(max_classes + 1).collect()]
    if len(classes) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    k = range(len(classes))
    words = docs.select(doc, klass, F.explode(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+")).alias("word")).where("word != ''")
    counts = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(klass) == c).alias(f"c{i}") for i, c in enumerate(classes)]))
    sizes = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"t{i}") for i in k])
    table = counts.withColumn("_t", sizes.select(F.struct(*sizes.columns)).scalar())
    common = F.col("n") * COMMON_WORDS > F.col("_t.n")
    table = table.select("word", common.alias("common"), *[F.log((F.col(f"c{i}") + 1.0) / (F.col(f"_t.t{i}") + F.col("_t.v"))).alias(f"lp{i}") for i in k])
    prior = docs.agg(*[F.log(F.count_if(F.col(klass) == c).cast("double")).alias(f"p{i}") for i, c in enumerate(classes)])
    often, rest = F.broadcast(table.where("common")), table.where("NOT common")
    sums = lambda df: df.groupBy(doc, klass).agg(*[F.sum(f"lp{i}").alias(f"lp{i}") for i in k])
    parts = sums(words.join(often, "word")).unionByName(sums(words.join(often, "word", "left_anti").join(rest, "word")))
    scored = parts.groupBy(doc, klass).agg(*[F.sum(f"lp{i}").alias(f"g{i}") for i in k])
    scored = scored.withColumn("_p", prior.select(F.struct(*prior.columns)).scalar())
    best = F.array_max(F.array(*[F.struct((F.col(f"g{i}") + F.col(f"_p.p{i}")).alias("g"), F.lit(c).alias("k")) for i, c in enumerate(classes)]))
    return scored.select(doc, klass, best.k.alias("prediction"))


# ---- MLlib learners -----------------------------------------------------------------------------------------------------------


def learner(kind: str, label: str, weight: str | None = None, **params):
    """An MLlib estimator by name; single-row learners of the stream world become learners per day or chunk."""
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r

    makers: dict[str, Callable] = {
        "forest": c.RandomForestClassifier, "tree": c.DecisionTreeClassifier, "boosting": c.GBTClassifier, "logistic": c.LogisticRegression,
        "svm": c.LinearSVC, "mlp": c.MultilayerPerceptronClassifier, "linear": r.LinearRegression, "regression_tree": r.DecisionTreeRegressor,
    }
    if kind == "stump":
        kind, params = "tree", {**params, "maxDepth": 1}
    if weight and kind != "mlp":
        params["weightCol"] = weight
    return makers[kind](featuresCol="features", labelCol=label, **params)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df.fillna(0.0, features))


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, kind: str = "forest", weight: str | None = None, **params) -> DataFrame:
    """Fits on one set and adds ``prediction`` (and ``votes`` of a classifier) to another."""
    model = learner(kind, label, weight, **params).fit(assemble(train, features))
    out = model.transform(assemble(test, features))
    if "probability" in out.columns:
        out = out.withColumn("votes", vector_to_array("probability"))
    return out.drop("features", "rawPrediction", "probability")


def train_per_day(
    sets: DataFrame, features: list[str], label: str, days: list | None = None, kind: str = "forest", weight: str | None = None, **params
) -> DataFrame:
    """A model per as-of day from its train rows, scoring its test rows; without ``days`` for every as-of day with test rows.

    Each fit is a distributed job, and FITS of them run at a time. A day without train rows has no model: its rows get no prediction.
    """
    sets = cut_lineage(sets)
    trains = F.count_if((F.col("split") == "train") & (F.col(weight) > 0 if weight else F.lit(True)))
    counts = sets.groupBy("asof_day").agg(trains.alias("train"), F.count_if(F.col("split") == "test").alias("test")).collect()  # one row per day
    if days is None:
        days = sorted(r.asof_day for r in counts if r.test)
    taught = {str(r.asof_day) for r in counts if r.train}

    def scored(day):
        today = sets.where(F.col("asof_day") == F.lit(day))
        train, test = today.where("split = 'train'"), today.where("split = 'test'")
        return fit_predict(train, test, features, label, kind, weight, **params) if str(day) in taught else test

    with ThreadPool(FITS) as pool:
        parts = pool.map(inheritable_thread_target(scored), days)
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def test_then_train(df: DataFrame, chunk: str, chunks: list[int], features: list[str], label: str, kind: str = "tree", delay: int = 0, **params) -> DataFrame:
    """Scores chunk t with a model of all chunks before t - delay."""
    out = None
    for t in chunks:
        scored = fit_predict(df.where(F.col(chunk) < t - delay), df.where(F.col(chunk) == t), features, label, kind, **params)
        out = scored if out is None else out.unionByName(scored)
    return out


# ---- combining ----------------------------------------------------------------------------------------------------------------


def member_weights(scores: DataFrame, member: str, rule: str, beta: float = 0.5, eps: float = 1e-9) -> DataFrame:
    """Weight per ensemble member from ``error2`` (squared error), ``mser`` (that of guessing) and ``wrong`` on a judging chunk."""
    out = scores.groupBy(member).agg(F.avg("error2").alias("mse"), F.avg("mser").alias("mser"), F.sum(F.col("wrong").cast("bigint")).alias("errors"))
    weight = {
        "accuracy_weighted": F.greatest(F.col("mser") - F.col("mse"), F.lit(0.0)),
        "accuracy_updated": 1.0 / (F.col("mser") + F.col("mse") + eps),
        "majority": F.pow(F.lit(beta), F.col("errors")),
    }[rule]
    return out.withColumn("weight", weight)


def weighted_vote(votes: DataFrame, weights: DataFrame, row: list[str], member: str, klass: str = "class", vote: str = "vote") -> DataFrame:
    """Class with the largest weighted sum of normalised votes; members are few, rows keep their partitioning by key."""
    total = votes.groupBy(*row, member).agg(F.sum(vote).alias("_t"))
    df = votes.join(total, [*row, member]).join(checked_broadcast(weights.select(member, "weight")), member)
    mass = df.groupBy(*row, klass).agg(F.sum(F.coalesce(F.try_divide(F.col(vote), F.col("_t")), F.lit(0.0)) * F.col("weight")).alias("mass"))
    return mass.groupBy(*row).agg(F.min_by(klass, F.struct(-F.round("mass", 9), F.col(klass))).alias("prediction"), F.max("mass").alias("mass"))


def transfer_votes(df: DataFrame, key: str, truth: str, old_votes: str, new_votes: str, w: float = 0.99) -> DataFrame:
    """Votes θ·old + new, where θ shrinks with every error of the old model before the row."""
    wrong = F.when(F.get(old_votes, F.lit(1)) > F.get(old_votes, F.lit(0)), 1).otherwise(0) != F.col(truth)
    df = running(df, key, {"_e": wrong.cast("bigint")}, exclusive=True)
    theta = F.pow(F.lit(w), F.col("_e"))
    return df.withColumns({"theta": theta, "votes": F.zip_with(old_votes, new_votes, lambda a, b: theta * a + b)}).drop("_e")


def baseline_ratings(ratings: DataFrame, user: str = "user", item: str = "item", rating: str = "rating", low: float = 1.0, high: float = 5.0) -> DataFrame:
    """Predicts user mean - overall mean + item mean, clamped to the scale."""
    u = ratings.groupBy(user).agg(F.avg(rating).alias("_u"))
    i = ratings.groupBy(item).agg(F.avg(rating).alias("_i"))
    df = ratings.join(u, user).join(i, item).withColumn("_g", ratings.agg(F.avg(rating)).scalar())
    return df.withColumn("prediction", F.least(F.lit(high), F.greatest(F.lit(low), F.col("_u") - F.col("_g") + F.col("_i")))).drop("_u", "_i", "_g")


def factor_ratings(ratings: DataFrame, rank: int = 10, iterations: int = 5, seed: int = 1) -> DataFrame:
    """Matrix factorisation by alternating least squares."""
    from pyspark.ml.recommendation import ALS

    model = ALS(userCol="user", itemCol="item", ratingCol="rating", rank=rank, maxIter=iterations, seed=seed, coldStartStrategy="drop").fit(ratings)
    return model.transform(ratings)


def running_rmse(df: DataFrame, key: str, truth: str, pred: str, ranges: int | None = None) -> DataFrame:
    e = F.col(truth) - F.col(pred)
    df = running(df, key, {"_s": e * e, "_n": F.lit(1).cast("bigint")}, ranges=ranges)
    return df.withColumn("rmse", F.sqrt(F.col("_s") / F.col("_n"))).drop("_s", "_n")


def knn_recent(df: DataFrame, key: str, vector: str, klass: str, k: int = 10, limit: int = 1000) -> DataFrame:
    """Majority class of the k nearest among the ``limit`` rows before each row (smallest class on ties; null without rows before).

    Tiles of the stream carry the ``limit`` rows before them, and a task computes the distances of one tile with numpy; no pair leaves
    the task, and no tile is larger than 5·limit rows.
    """
    numbered = row_numbers(df.select(key, vector, klass), key, "_n")
    tiled = overlap_tiles(numbered, F.col("_n"), 4 * limit, limit)

    def score(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("_n")
        x, y = np.stack(tile[vector].to_numpy()).astype(float), tile[klass].to_numpy()
        own, out = np.flatnonzero(tile["_own"].to_numpy()), []
        for i in own:
            lo = max(0, i - limit)
            if lo == i:
                out.append(None)
                continue
            d = ((x[lo:i] - x[i]) ** 2).sum(axis=1)
            near = np.argsort(d, kind="stable")[:k]
            values, counts = np.unique(y[lo:i][near], return_counts=True)
            out.append(int(values[np.argmax(counts)]))
        return pd.DataFrame({key: tile[key].to_numpy()[own], klass: y[own], "prediction": pd.array(out, dtype="Int32")})

    kt = dict(numbered.dtypes)
    return tiled.groupBy("_tile").applyInPandas(score, f"{key} {kt[key]}, {klass} {kt[klass]}, prediction int")


def deviation_bound(gap: Column, sd: Column, bound: str) -> Column:
    """Bound on the probability of a deviation of at least ``gap``; null where it is undefined."""
    var = sd * sd
    # The inequalities' forms
    return {
        "cantelli": F.try_divide(2.0 * var, var + gap * gap),
        "chebyshev": F.when(gap > sd, F.try_divide(var, gap * gap)).otherwise(1.0),
        "gauss": F.when(gap * gap > 4.0 * var / 3.0, F.try_divide(4.0 * var, 9.0 * gap * gap)).otherwise(1.0 - F.try_divide(gap, F.sqrt(3.0 * var))),
    }[bound]


def _with_spread(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Adds mean and deviation of every feature (``_m0``, ``_d0`` and so on), of the table or of the row's group."""
    aggs = [a for i, f in enumerate(features) for a in (F.avg(f).alias(f"_m{i}"), F.stddev_pop(f).alias(f"_d{i}"))]
    stats = df.groupBy(*by).agg(*aggs)
    if by:
        # a few groups as keys of a shuffle would send most rows to a few tasks
        return df.join(checked_broadcast(cut_lineage(stats)), list(by))
    one = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumn("_s", one).select("*", "_s.*").drop("_s")


def odds_ratio_anomaly(df: DataFrame, features: list[str], bound: str = "cantelli", by: list[str] = ()) -> DataFrame:
    """Anomaly score of a row: mean over features of ln(p) - ln(1 - p), p the bound on the probability of so large a deviation."""
    df = _with_spread(df, features, list(by))
    terms = []
    for i, f in enumerate(features):
        p = deviation_bound(F.abs(F.col(f) - F.col(f"_m{i}")), F.col(f"_d{i}"), bound)
        p = F.least(F.lit(1.0 - 1e-6), F.greatest(F.lit(1e-6), F.coalesce(p, F.lit(1.0))))
        terms.append(F.log(p) - F.log(1.0 - p))
    score = sum(terms[1:], terms[0]) / float(len(terms))
    return df.withColumn("anomaly_score", score).drop(*[f"_{x}{i}" for x in "md" for i in range(len(features))])


def anomaliness_ratio(df: DataFrame, features: list[str], bound: str = "gauss", univariate: float = 0.9, share: float = 0.5, least_sd: float = 0.01, by: list[str] = ()) -> DataFrame:
    """Adds anomalous_features, judged_features, anomaly: whether more than ``share`` of the features that vary deviate with 1 - p > ``univariate``.

    Features with a deviation of at most ``least_sd`` and values that are null are not judged; without a judged feature there is no anomaly.
    """
    df = _with_spread(df, features, list(by))
    judged = [F.coalesce((F.col(f"_d{i}") > least_sd) & F.col(f).isNotNull(), F.lit(False)) for i, f in enumerate(features)]
    odd = [j & F.coalesce(1.0 - deviation_bound(F.abs(F.col(f) - F.col(f"_m{i}")), F.col(f"_d{i}"), bound) > univariate, F.lit(False)) for i, (f, j) in enumerate(zip(features, judged))]
    count = lambda flags: sum((x.cast("bigint") for x in flags[1:]), flags[0].cast("bigint"))
    df = df.withColumns({"anomalous_features": count(odd), "judged_features": count(judged)})
    df = df.withColumn("anomaly", F.coalesce(F.try_divide("anomalous_features", "judged_features") > share, F.lit(False)))
    return df.drop(*[f"_{x}{i}" for x in "md" for i in range(len(features))])
