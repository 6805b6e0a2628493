"""Fusion of ranked members, and the search for its weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .windows import percentile_rank


def seed_average(df: DataFrame, group: list[str], seeds: list[str], tie: str = "row_id", out: str = "fused") -> DataFrame:
    """Each seed ranked in its list first, then averaged."""
    ranked = df.withColumns({f"_{s}": percentile_rank(group, s, tie) for s in seeds})
    return ranked.withColumn(out, sum((F.col(f"_{s}") for s in seeds), F.lit(0.0)) / len(seeds)).drop(*[f"_{s}" for s in seeds])


def linear(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())


def power(weights: dict[str, float], gamma: float) -> Column:
    return sum((w * F.pow(F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1.0)), F.lit(gamma)) for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())


def scored_by(df: DataFrame, candidates: list[dict[str, float]], label: str, group: list[str], fuse: Callable[[dict[str, float]], Column] = linear) -> DataFrame:
    """candidate, gauc, ndcg5, primary ...: all weightings in one job, each row exploded to its score under each."""
    scores = F.array(*[F.struct(F.lit(i).alias("candidate"), fuse(w).alias("score")) for i, w in enumerate(candidates)])
    rows = df.withColumn("_x", F.explode(scores)).select(*group, label, "row_id", "_x.candidate", "_x.score")
    return metrics.evaluate(rows, label, "score", group, by=["candidate"])


def grid(df: DataFrame, a: str, b: str, label: str, group: list[str], points: int = 51) -> DataFrame:
    """weight, primary: for weights of ``a`` from 0 to 1 against ``b``."""
    ws = [i / (points - 1) for i in range(points)]
    out = scored_by(df, [{a: w, b: 1 - w} for w in ws], label, group)
    return out.select((F.col("candidate") / (points - 1)).alias("weight"), "primary")


def better_members(df: DataFrame, slack: dict[str, float], base: str, label: str, group: list[str]) -> list[str]:
    """Of the members named in ``slack`` those whose primary exceeds that of ``base`` less their slack; all are scored in one job."""
    names = [base, *slack]
    primary = {names[r.candidate]: r.primary for r in scored_by(df, [{m: 1.0} for m in names], label, group).collect()}
    return [m for m, s in slack.items() if primary[m] > primary[base] - s]


def _best(df: DataFrame, candidates: list[dict[str, float]], label: str, group: list[str]) -> tuple[float, int]:
    r = scored_by(df, candidates, label, group).orderBy(F.desc(F.round("primary", 12)), "candidate").first()
    return r.primary, r.candidate


def coordinate_ascent(df: DataFrame, members: list[str], label: str, group: list[str], steps: tuple[float, ...] = (0.4, 0.2, 0.1, -0.1, -0.2), rounds: int = 3, least: float = 1e-6) -> tuple[dict[str, float], list[float]]:
    """Weights from equal ones, changed one at a time by the best step while that gains; and the value after each change. Each coordinate's steps are one job."""
    weights = dict.fromkeys(members, 1.0)
    trace = [_best(df, [weights], label, group)[0]]
    for _ in range(rounds):
        start = trace[-1]
        for m in members:
            tries = [w for s in steps if sum((w := {**weights, m: max(0.0, weights[m] + s)}).values()) > 0]
            value, at = _best(df, tries, label, group)
            if value > trace[-1] + least:
                weights = tries[at]
                trace.append(value)
        if trace[-1] <= start + least:
            break
    return weights, trace


def greedy_forward(df: DataFrame, members: list[str], label: str, group: list[str], rounds: int = 12, steps: tuple[float, ...] = (0.05, 0.1, 0.2)) -> tuple[dict[str, float], list[float]]:
    """From the best member alone, the best (member, step) added while that gains; each round is one job."""
    value, at = _best(df, [{m: 1.0} for m in members], label, group)
    weights, trace = {members[at]: 1.0}, [value]
    for _ in range(rounds):
        tries = [{**weights, m: weights.get(m, 0.0) + s} for m in members for s in steps]
        value, at = _best(df, tries, label, group)
        if value <= trace[-1]:
            break
        weights = tries[at]
        trace.append(value)
    return weights, trace
