"""What a candidate may use: a context of lazy columns and point-in-time operators, without outcomes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import smoothed_rate
from ..operators import cf, keys, learners, models, pit, windows
from ..operators.lineage import Lineage
from ..operators.metrics import evaluate
from ..sources.impressions import OUTCOMES, Fold
from ..sources.scratch import stored


def point_in_time(method: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Marks an operator that looks at outcomes up to each row's horizon alone: what it returns may be used."""

    @wraps(method)
    def approved(self: Context, *args, **kwargs) -> DataFrame:
        return self.lineage.approve(method(self, *args, **kwargs))

    return approved


@dataclass(frozen=True)
class Context:
    """``rows`` has no outcome column; outcomes are reached through the methods alone, which know each row's horizon.

    ``_log`` is the context's own. check() follows a matrix's columns back to their sources, so one that
    an outcome flows into is refused however it was made, unless by a point-in-time operator.
    """

    _log: DataFrame
    fold: Fold
    video: DataFrame
    user: DataFrame
    label: str = "long_view"
    schedule: list = field(default_factory=list)
    lineage: Lineage | None = None

    @classmethod
    def of(cls, log: DataFrame, fold: Fold, video: DataFrame, user: DataFrame, label: str = "long_view") -> Context:
        schedule = fold.schedule()
        rows = fold.with_part(log).withColumn("hz", keys.window_horizon(F.col("date"), schedule))
        return cls(rows, fold, video, user, label, schedule, Lineage(rows, {*OUTCOMES, label}, (video, user)))

    @property
    def rows(self) -> DataFrame:
        return self._log.drop(*OUTCOMES, self.label)

    @property
    def fit_end(self) -> int:
        return self.fold.days("train")[1]

    def part(self, name: str) -> DataFrame:
        """rows of train, valid or test."""
        return self.fold.rows(self.rows, name)

    def video_attr(self, name: str) -> DataFrame:
        return self.rows.select("row_id", "video_id").join(self.video.select("video_id", name), "video_id", "left").select("row_id", name)

    def user_attr(self, name: str) -> DataFrame:
        return self.rows.select("row_id", "user_id").join(self.user.select("user_id", name), "user_id", "left").select("row_id", name)

    def labels_visible(self) -> DataFrame:
        """row_id, label: -1 after the fold's horizon. For a look at the log; a matrix can't be made of it."""
        return self._log.select("row_id", keys.visible_label(F.col(self.label), F.col("date"), self.fold.horizon).alias("label"))

    def _with(self, columns: list[str]) -> DataFrame:
        """The log with attributes of items and users that it lacks."""
        log = self._log
        for c in columns:
            for side, key in ((self.video, "video_id"), (self.user, "user_id")):
                if c not in log.columns and c in side.columns:
                    log = log.join(side.select(key, c), key, "left")
        return log

    @point_in_time
    def frozen_prefix(self, by: list[str]) -> DataFrame:
        """row_id, lab, pos."""
        return pit.frozen_prefix(self._with(by), by, self.label).select("row_id", "lab", "pos")

    def rate(self, by: list[str], name: str, prior: float = 0.4) -> DataFrame:
        return self.frozen_prefix(by).select("row_id", smoothed_rate(F.col("pos"), F.col("lab"), prior).alias(name))

    @point_in_time
    def baseline_score(self, columns: tuple[str, ...] = ("user_id", "video_id", "author_id", "tab")) -> DataFrame:
        """row_id, score of factorisation machines, each window's fitted before it."""
        return learners.windowed_fm(self._with(list(columns)), self.schedule, list(columns), [self.label], self.fit_end).withColumnRenamed(self.label, "score")

    @point_in_time
    def auxiliary_signal(self, name: str, columns: tuple[str, ...] = ("user_id", "video_id", "author_id", "tab")) -> DataFrame:
        """row_id, score: the propensity of another feedback, as baseline_score() is that of the label. The feedback itself is an outcome."""
        if name not in OUTCOMES:
            raise ValueError(f"{name} is no feedback of the log")
        return learners.windowed_fm(self._with(list(columns)), self.schedule, list(columns), [name], self.fit_end, epochs=6).withColumnRenamed(name, "score")

    @point_in_time
    def refit_score(self, columns: tuple[str, ...] = ("user_id", "video_id", "author_id", "tab"), strict: bool = True, seeds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
        scores = learners.refit_scores(self._with(list(columns)), list(columns), self.label, seeds, permissive=not strict)
        return scores.select("row_id", F.col("strict" if strict else "permissive").alias("score"))

    @point_in_time
    def din_score(self, columns: tuple[str, ...] = ("user_id", "video_id", "tab"), mode: str = "plain") -> DataFrame:
        """row_id, score: learned attention of the row's item over its user's last positives."""
        return learners.attention_scores(self._with(list(columns)), self.schedule, list(columns), self.label, (mode,)).withColumnRenamed(mode, "score")

    @point_in_time
    def expert_score(self, subspace: str, prior: float = 0.4) -> DataFrame:
        log = self._with(["author_id"]).withColumn("dur_bucket", F.floor(F.col("duration_ms") / 25).cast("int"))
        rows, names = models.expert_matrix(log, subspace, prior, self.label)
        return models.expert_scores(rows, names, self.label)

    @point_in_time
    def cf_score(self) -> DataFrame:
        return cf.frozen_scores(self._log, self.schedule, self.label, similarity=cf.idf_cosine)

    @point_in_time
    def mf_score(self) -> DataFrame:
        return models.als_scores(self._log, self.schedule, self.label)

    def within_user_deviation(self, matrix: DataFrame, columns: list[str]) -> DataFrame:
        joined = matrix.join(self.rows.select("row_id", "user_id", "split"), "row_id")
        return joined.select("row_id", *columns, *[windows.deviation(["split", "user_id"], c).alias(f"{c}_dev") for c in columns])

    def check(self, matrix: DataFrame) -> list[str]:
        """Names of the columns of a valid matrix: row_id and numbers, none of them named as an outcome or made of one, a row for each row of the log."""
        self.check_sources(matrix)
        return self.check_values(matrix)

    def check_sources(self, matrix: DataFrame) -> None:
        """An error if a column is named as an outcome or made of one."""
        keys.guard_outcomes(matrix)
        self.lineage.check(matrix)

    def check_values(self, matrix: DataFrame) -> list[str]:
        """Names of the columns of a matrix of numbers with a row for each row of the log."""
        names = [c for c in matrix.columns if c != "row_id"]
        bad = keys.matrix_violations(matrix, names, self._log.count()).where("n <> 0").collect()
        if bad:
            raise ValueError("; ".join(f"{r.rule}: {r.n}" for r in bad))
        return names


@dataclass(frozen=True)
class Candidate:
    """build(context) gives row_id and columns, or these and a dict of tree parameters (models.ALLOWED).

    Mode "scores" takes the first column as the score, "features" fits trees on all of them; an objective
    (binary or lambdarank) and a group (user_day or user) among the parameters choose trees with an
    objective over lists.
    """

    name: str
    family: str
    build: Callable[[Context], DataFrame | tuple[DataFrame, dict]]
    mode: str = "scores"


#: What a lost machine says, which is no candidate's error.
LOST = ("ExecutorLost", "FetchFailed", "Could not find shuffle", "SparkContext was shut down", "OutOfMemory")


ERRORS = (ValueError, TypeError, KeyError, AttributeError, ArithmeticError, PySparkException)
#: The best primary that honest candidates reach on a backtest's parts, and what may come on top.
CEILINGS, OTHER_CEILING, SLACK, GAP = {"backtest_a": 0.60}, 0.62, 0.05, 0.035


def scored_candidate(context: Context, candidate: Candidate) -> DataFrame:
    """row_id, user_id, date, the label and the candidate's score. The matrix is made once and stored: its check, fits and metrics read it many times."""
    built = candidate.build(context)
    matrix, given = built if isinstance(built, tuple) else (built, {})
    boosted = models.booster_params(given) if "objective" in given else None
    params = {} if boosted else models.tree_params(given)
    context.check_sources(matrix)
    matrix = stored(matrix, "matrix")
    names = context.check_values(matrix)
    keep = ("row_id", "user_id", "date", context.label)
    log = context._log.select(*keep, "split")
    if candidate.mode != "features":
        return log.join(matrix.select("row_id", F.col(names[0]).cast("double").alias("score")), "row_id").select(*keep, "score")
    rows = stored(log.join(matrix, "row_id"), "features")
    if boosted:
        scores = models.boosted_scores(rows, names, boosted[0], boosted[1], context.label, **boosted[2])
    else:
        return models.gbt_scores(names, context.label, keep=keep, **params)(context.fold.rows(rows, "train"), rows)
    return rows.select(*keep).join(scores, "row_id")


def _detail(e: Exception) -> str:
    """What a candidate's error says; a lost machine is raised again."""
    if any(x in str(e) for x in LOST):
        raise e
    return f"{type(e).__name__}: {e}"[:800]


def run_candidate(context: Context, candidate: Candidate, part: str = "valid") -> dict:
    """A ledger entry: the candidate's primary on a part of the fold, or its error as data. A lost machine is no error of the candidate's and is raised."""
    began = time.time()
    entry = {"candidate": candidate.name, "family": candidate.family, "valid": None, "detail": ""}
    try:
        rows = scored_candidate(context, candidate)
        entry["valid"] = evaluate(context.fold.rows(rows, part), context.label, "score").first().primary
    except ERRORS as e:
        entry["detail"] = _detail(e)
    return entry | {"seconds": time.time() - began}


def confirm(context: Context, candidate: Candidate, ceiling: float | None = None) -> dict:
    """valid, test, confirmed, detail: the candidate fitted and scored on the context's fold, a backtest whose test days may be seen.

    A leak of the window's own labels shows as a valid primary above the test one by GAP or more, one that
    knows no folds as either above the fold's ceiling by SLACK or more. confirmed is None if the candidate
    can't run on the fold.
    """
    out = {"valid": None, "test": None, "confirmed": None, "detail": ""}
    try:
        rows = stored(scored_candidate(context, candidate).select("row_id", "user_id", "date", context.label, "score"), "backtest")
        out |= {part: evaluate(context.fold.rows(rows, part), context.label, "score").first().primary for part in ("valid", "test")}
    except ERRORS as e:
        return out | {"detail": f"could not run on {context.fold.name}: {_detail(e)}"}
    most = (CEILINGS.get(context.fold.name, OTHER_CEILING) if ceiling is None else ceiling) + SLACK
    gap = out["valid"] - out["test"]
    return out | {"confirmed": gap < GAP and max(out["valid"], out["test"]) < most, "detail": f"{context.fold.name}: gap {gap:+.4f} of {GAP}, best {max(out['valid'], out['test']):.4f} of {most:.2f}"}


def scripted_loop(context: Context, proposals: list[Candidate], baseline: float, patience: int = 3, epsilon: float = 0.002, backtest: Context | None = None) -> list[dict]:
    """Runs proposals in turn until ``patience`` in a row bring no gain over the best; crashes neither count nor reset.

    With a ``backtest`` a candidate with a gain is accepted only if it is confirmed there; one that isn't,
    or can't be, is rejected with the reason and is no new best.
    """
    best, stall, ledger = baseline, 0, []
    for i, c in enumerate(proposals):
        entry = run_candidate(context, c) | {"iteration": i}
        if entry["valid"] is not None:
            gain = entry["valid"] - best
            checked = confirm(backtest, c) if backtest and gain > 0 else {"confirmed": gain > 0, "detail": entry["detail"]}
            accepted = checked["confirmed"] is True
            stall = 0 if accepted and gain > epsilon else stall + 1
            best = entry["valid"] if accepted else best
            entry |= {"decision": "accept" if accepted else "reject", "detail": checked["detail"]}
        else:
            entry["decision"] = "error"
        ledger.append(entry)
        if stall >= patience:
            break
    return ledger


def popularity(context: Context) -> DataFrame:
    return context.rate(["video_id"], "item_rate")


def by_tab(context: Context) -> DataFrame:
    return context.rate(["video_id", "tab"], "item_tab_rate")


def by_author(context: Context) -> DataFrame:
    return context.rate(["author_id"], "author_rate")


def trees(context: Context) -> tuple[DataFrame, dict]:
    """Features, and parameters of the trees on them."""
    matrix = context.rate(["video_id"], "item_rate").join(context.rate(["video_id", "tab"], "item_tab_rate"), "row_id")
    return matrix, {"learning_rate": 0.2, "num_leaves": 8, "min_data_in_leaf": 50}
