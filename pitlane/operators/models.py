"""Learners by window, on Spark ML, and the values of their losses and weights."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import day_index
from ..sources.scratch import stored
from . import metrics, pit, windows
from .boosting import OBJECTIVES, Boosted
from .diagnostics import pairs

Schedule = list[tuple[int, int, int]]


def side_by_side(f: Callable, jobs) -> list:
    """f of each of a few jobs, which Spark runs side by side; their stages share the cores."""
    jobs = list(jobs)
    with ThreadPoolExecutor(max(1, min(len(jobs), 8))) as pool:
        return list(pool.map(inheritable_thread_target(f), jobs))


def predict(model: PipelineModel, rows: DataFrame, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Columns ``keep`` and score."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].cast("double").alias("score"))


#: learner(budget, seed): an unfitted pipeline whose probability column scores.
Learner = Callable[[int, int], Pipeline]


def gbt_learner(features: list[str], label: str = "long_view", depth: int = 4, **params) -> Learner:
    return lambda budget, seed: Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol=label, maxIter=budget, maxDepth=depth, seed=seed, **params)])


#: The key families of each expert.
EXPERTS = {
    "context": {"tab": ["tab"]},
    "item": {"item": ["video_id"], "author": ["author_id"], "item_tab": ["video_id", "tab"]},
    "user": {"user_tab": ["user_id", "tab"], "user_dur": ["user_id", "dur_bucket"], "user": ["user_id"]},
}


def expert_matrix(df: DataFrame, subspace: str, prior: float, label: str = "long_view", horizon: str = "hz") -> tuple[DataFrame, list[str]]:
    """Rows of ``df`` with the columns of one family of features and their deviations within (user, horizon); and their names.

    context: nothing of item or user; item: nothing of the user; user: nothing of the item.
    """
    if subspace not in EXPERTS:
        raise ValueError(f"{subspace} is none of {', '.join(EXPERTS)}")
    families = EXPERTS[subspace]
    rows = pit.frozen_prefixes(df, families, label, horizon)
    base = ["row_id", "user_id", "date", "split", label, horizon]
    extra = [F.log1p("duration_ms").alias("log_duration"), F.col("hour").cast("double").alias("hour"), (day_index(F.col("date")) - day_index(F.col(horizon))).cast("double").alias("staleness")] if subspace == "context" else []
    rows = rows.select(*base, *pit.rate_columns(families, prior), *extra)
    names = [c for c in rows.columns if c not in base]
    return rows.withColumns({f"{c}_dev": windows.deviation(["user_id", horizon], c) for c in names}), [*names, *(f"{c}_dev" for c in names)]


def decomposition(rows: DataFrame, sources: dict[str, list[str]], label: str = "long_view", group: list[str] | None = None, budget: int = 10) -> DataFrame:
    """source, place, standalone, cumulative, marginal: of sources of columns in their order, by primary on the validation rows.

    standalone: the first column of the source as a score. cumulative: trees on the columns of this
    source and those before it, with their deviations within the group (user and horizon), fitted on
    the training rows. marginal: what the source adds to the cumulative primary, null for the first.
    """
    columns = [c for own in sources.values() for c in own]
    wide = rows.select("row_id", "user_id", "split", label, *columns, *[windows.deviation(group or ["user_id", "hz"], c).alias(f"{c}_dev") for c in columns])
    matrix = stored(wide, "deviations", ["split"])
    valid, starts = matrix.where("split = 'valid'"), [own[0] for own in sources.values()]
    scores = valid.select("row_id", "user_id", label, F.posexplode(F.array(*[F.col(c).cast("double") for c in starts])).alias("place", "score"))
    alone = {r.place: r.primary for r in metrics.evaluate(scores, label, "score", by=["place"]).collect()}

    def upto(i: int) -> float:
        some = [c for own in list(sources.values())[: i + 1] for c in own]
        model = expert(matrix, [*some, *(f"{c}_dev" for c in some)], label, budget)
        scores = stored(predict(model, valid, ("row_id", "user_id", label)), "scores")
        return metrics.evaluate(scores, label, "score").first().primary

    both = side_by_side(upto, range(len(sources)))
    out = [(source, i, alone.get(i), both[i], both[i] - both[i - 1] if i else None) for i, source in enumerate(sources)]
    return rows.sparkSession.createDataFrame(out, "source string, place int, standalone double, cumulative double, marginal double")


def expert(rows: DataFrame, names: list[str], label: str = "long_view", budget: int = 10, seed: int = 0) -> PipelineModel:
    """Trees fitted on the training rows of an expert's matrix."""
    return gbt_learner(names, label)(budget, seed).fit(rows.where("split = 'train'").withColumn(label, F.col(label).cast("double")))


def expert_scores(rows: DataFrame, names: list[str], label: str = "long_view", budget: int = 10, seed: int = 0) -> DataFrame:
    """row_id, score of all rows by expert()."""
    return predict(expert(rows, names, label, budget, seed), rows)


def gbt_scores(features: list[str], label: str = "long_view", iterations: int = 10, depth: int = 4, seed: int = 0, keep: tuple[str, ...] = ("row_id",), **params) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Boosted trees over numeric columns: ``keep`` and score of rows."""
    return _fitted(gbt_learner(features, label, depth, **params), label, iterations, seed, keep)


def _fitted(learner: Learner, label: str, iterations: int, seed: int, keep: tuple[str, ...]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda past, rows: predict(learner(iterations, seed).fit(past.withColumn(label, F.col(label).cast("double"))), rows, keep)


def importances(past: DataFrame, features: list[str], label: str = "long_view", top: int = 10, iterations: int = 10, seed: int = 0) -> DataFrame:
    """feature, importance of boosted trees: the ``top`` ones."""
    gbt = GBTClassifier(labelCol=label, maxIter=iterations, maxDepth=4, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(past.withColumn(label, F.col(label).cast("double")))
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, values, strict=True), key=lambda x: (-x[1], x[0]))[:top]
    return past.sparkSession.createDataFrame(rows, "feature string, importance double")


def als_scores(df: DataFrame, schedule: Schedule, label: str = "long_view", rank: int = 16, reg: float = 0.05, alpha: float = 40.0, iterations: int = 6, least: int = 500, seed: int = 0) -> DataFrame:
    """row_id, score: dot products of implicit factors of the positives up to each window's horizon; 0 for what they don't know."""
    user = F.col("user_id").cast("int").alias("user_id")
    # an edge is known from its first day on, so the edges of a window are a filter on one table
    first = stored(df.where(F.col(label) == 1).groupBy(user, "video_id").agg(F.min("date").alias("date"), F.lit(1.0).alias("one")), "edges")
    sizes = first.agg(*[F.count_if(F.col("date") <= h).alias(f"n{i}") for i, (_, _, h) in enumerate(schedule)]).first()

    def window(i: int) -> DataFrame:
        lo, hi, horizon = schedule[i]
        rows = df.where(F.col("date").between(lo, hi)).select("row_id", user, "video_id")
        if sizes[i] < least:
            return rows.select("row_id", F.lit(0.0).alias("score"))
        als = ALS(userCol="user_id", itemCol="video_id", ratingCol="one", implicitPrefs=True, rank=rank, regParam=reg, alpha=alpha, maxIter=iterations, seed=seed, coldStartStrategy="nan")
        scored = als.fit(first.where(F.col("date") <= horizon)).transform(rows)
        return scored.select("row_id", F.coalesce(F.nanvl(F.col("prediction").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score"))

    return reduce(DataFrame.unionByName, side_by_side(window, range(len(schedule))))


def fm_logit(bias: Column, weights: list[Column], vectors: list[Column], k: int) -> Column:
    """bias + sum of weights + half of (square of the summed vectors - sum of their squares)."""
    pairs_ = F.lit(0.0)
    for f in range(k):
        column = [v[f] for v in vectors]
        total = sum(column, F.lit(0.0))
        pairs_ = pairs_ + total * total - sum((x * x for x in column), F.lit(0.0))
    return bias + sum(weights, F.lit(0.0)) + 0.5 * pairs_


def recency_weight(date_age: Column, tau: float, mean: Column) -> Column:
    """exp(-age / tau) over its mean."""
    return F.exp(-date_age / tau) / mean


def loss_values(df: DataFrame, group: list[str], label: str, score: str, tie: str = "row_id", k: int = 5) -> DataFrame:
    """loss, value of a fixed score; all but bce over lists with both labels.

    bce: mean over rows. bpr: the mean pair loss of a list, averaged over lists. bpr_gauc: pairs
    weighted by 1 / negatives of the list, over all positives. listnet: cross entropy of the softmax,
    by positive. lambda_ndcg: pairs weighted by what swapping them changes in nDCG at ``k``. primary:
    half of bpr_gauc and half of lambda_ndcg. Pair losses have no closed form, so these make the
    pairs of each list: lists are those of a user's day or week, not of all time.
    """
    s, y = F.col(score), F.col(label)
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    bce = df.agg(F.avg(softplus(s) - y * s).alias("bce"))
    by = W.partitionBy(*group)
    place = F.row_number().over(by.orderBy(F.desc(score), tie))
    shifted = s - F.max(score).over(by)
    rows = df.select(*group, label, score, F.when(place <= k, 1 / F.log2(place + 1)).otherwise(0.0).alias("_gain"), shifted.alias("_s"), F.sum(label).over(by).alias("_p"), F.sum(1 - y).over(by).alias("_n")).where("_p > 0 and _n > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_p"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    net = rows.groupBy(*group, "_p", "_n").agg(((F.sum("_p") / F.count("*") * F.log(F.sum(F.exp("_s"))) - F.sum(y * F.col("_s"))) / F.first("_p")).alias("_net"))
    met = pairs(rows, group, label, [score, "_gain"])
    loss = softplus(F.col(f"n_{score}") - F.col(f"p_{score}"))
    per = met.groupBy(*group).agg(F.sum(loss).alias("_l"), F.sum(loss * F.abs(F.col("p__gain") - F.col("n__gain"))).alias("_g"))
    lists = net.join(per, group)
    means = lists.agg(
        F.avg(F.col("_l") / (F.col("_p") * F.col("_n"))).alias("bpr"),
        (F.sum(F.col("_l") / F.col("_n")) / F.sum("_p")).alias("bpr_gauc"),
        F.avg("_net").alias("listnet"),
        F.avg(F.col("_g") / ideal / (F.col("_p") * F.col("_n"))).alias("lambda_ndcg"),
    )
    one = bce.crossJoin(means).withColumn("primary", (F.col("bpr_gauc") + F.col("lambda_ndcg")) / 2)  # one row each
    return one.unpivot([], ["bce", "bpr", "bpr_gauc", "listnet", "lambda_ndcg", "primary"], "loss", "value")


#: Hyper-parameters that a candidate may set, and their bounds.
ALLOWED = {
    "learning_rate": (0.005, 0.3),
    "num_leaves": (7, 255),
    "min_data_in_leaf": (20, 2000),
    "feature_fraction": (0.3, 1.0),
    "bagging_fraction": (0.3, 1.0),
    "bagging_freq": (0, 10),
    "lambda_l1": (0.0, 10.0),
    "lambda_l2": (0.0, 10.0),
    "max_depth": (-1, 16),
    "min_gain_to_split": (0.0, 1.0),
}


def clipped_params(given: dict) -> dict:
    """The parameters clipped to their bounds; whole bounds stay whole numbers. An unknown name, or a value that is no number, is an error."""
    for k, v in given.items():
        if k not in ALLOWED:
            raise ValueError(f"{k} can't be set; it must be one of {', '.join(ALLOWED)}")
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v:
            raise ValueError(f"{k} must be a number, not {v!r}")
    return {k: type(ALLOWED[k][0])(min(max(v, ALLOWED[k][0]), ALLOWED[k][1])) for k, v in given.items()}


def clipped_table(given: DataFrame) -> DataFrame:
    """name, value, finding of proposed parameters (name, value): clipped, or null and UNKNOWN."""
    rows = given.sparkSession.createDataFrame([(k, float(lo), float(hi), isinstance(lo, int)) for k, (lo, hi) in ALLOWED.items()], "name string, lo double, hi double, whole boolean")
    both = given.join(F.broadcast(rows), "name", "left")
    value = F.when(F.col("lo").isNotNull() & ~F.isnan("value"), F.least(F.greatest("value", "lo"), F.col("hi")))
    value = F.when(F.col("whole"), F.floor(value + F.when(value < 0, 1).otherwise(0)).cast("double")).otherwise(value)
    return both.select("name", value.alias("value"), F.when(value.isNull(), "UNKNOWN").when(value != F.col("value"), "CLIPPED").otherwise("OK").alias("finding"))


def tree_params(given: dict) -> dict:
    """Arguments of Spark's boosted trees for clipped_params(); those that they have no counterpart of are left out."""
    p, out = clipped_params(given), {}
    names = {"learning_rate": "stepSize", "min_data_in_leaf": "minInstancesPerNode", "bagging_fraction": "subsamplingRate", "min_gain_to_split": "minInfoGain"}
    out = {names[k]: v for k, v in p.items() if k in names}
    if p.get("max_depth", -1) > 0:
        out["depth"] = min(p["max_depth"], 12)
    elif "num_leaves" in p:
        out["depth"] = max(1, math.ceil(math.log2(p["num_leaves"])))
    if "feature_fraction" in p:
        out["featureSubsetStrategy"] = str(p["feature_fraction"])
    return out


#: What a list is, by the name that a candidate gives.
GROUPS = {"user_day": ["user_id", "date"], "user": ["user_id"]}


def booster_params(given: dict) -> tuple[str, list[str], dict]:
    """Objective, list keys and arguments of boosting.Boosted for parameters that may name an objective and a group; the others are clipped. Rows are never left out of a tree, so bagging has no effect."""
    rest = {k: v for k, v in given.items() if k not in ("objective", "group")}
    objective, group = given.get("objective", "binary"), given.get("group", "user_day")
    if objective not in OBJECTIVES or group not in GROUPS:
        raise ValueError(f"objective must be one of {', '.join(OBJECTIVES)} and group one of {', '.join(GROUPS)}")
    p = clipped_params(rest)
    out = {k: v for k, v in p.items() if k in ("learning_rate", "min_data_in_leaf", "lambda_l1", "lambda_l2", "min_gain_to_split", "feature_fraction")}
    if p.get("max_depth", -1) > 0:
        out["depth"] = min(p["max_depth"], 10)
    elif "num_leaves" in p:
        out["depth"] = max(1, math.ceil(math.log2(p["num_leaves"])))
    return objective, GROUPS[group], out


def boosted_scores(rows: DataFrame, names: list[str], objective: str, group: list[str], label: str = "long_view", **params) -> DataFrame:
    """row_id, score of all rows by trees of this objective, fitted on the rows of split train; as many of them as have the best primary on those of split valid."""
    booster = Boosted(names, objective, **params)
    train = rows.where("split = 'train'")
    booster.start(train)
    booster.fit(stored(booster.records(train, label, group), "records")).shortened(rows.where("split = 'valid'"), label)
    return booster.scores(rows, ["row_id"])


def late_only(history: Column, least: int = 10) -> Column:
    """Weight 1 for rows whose history has at least ``least`` items, else 0."""
    return (F.coalesce(history, F.lit(0)) >= least).cast("double")


def history_match(train: DataFrame, evaluated: DataFrame, bucket: str, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """bucket, weight: share of the bucket among evaluated rows over that among training rows, clipped, with mean 1 over training rows."""
    t = train.groupBy(bucket).agg(F.count("*").alias("_t"))
    e = evaluated.groupBy(bucket).agg(F.count("*").alias("_e"))
    whole = W.partitionBy()  # over buckets, of which there are few
    total = e.agg(F.coalesce(F.sum("_e"), F.lit(0)).alias("_all"))
    both = t.join(e, bucket, "left").withColumn("_e", F.coalesce("_e", F.lit(0))).crossJoin(F.broadcast(total))  # one row
    ratio = (F.col("_e") / F.greatest("_all", F.lit(1))) / (F.col("_t") / F.sum("_t").over(whole))
    both = both.withColumn("_r", F.least(F.greatest(ratio, F.lit(low)), F.lit(high)))
    mean = F.sum(F.col("_r") * F.col("_t")).over(whole) / F.sum("_t").over(whole)
    return both.select(bucket, (F.col("_r") / F.greatest(mean, F.lit(1e-6))).alias("weight"))  # all 0 where no bucket is in both
