import pytest
from pyspark.sql import functions as F

from pitlane.plans import catalog

from .compare import connect, same
from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", ["win13_random_sample", "met06_random_baseline", "dia03_digest", "cf03_frozen_scores", "aud04_label_shuffle", "mf01_als", "snk01_submission"])
def test_query_without_sql_is_stable(spark, name):
    a, b = (sorted(map(str, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a and a == b


def test_searches_never_lose(spark):
    from pitlane.operators import fusion
    from pitlane.plans.catalog_ranking import members

    for search in (fusion.coordinate_ascent, fusion.greedy_forward):
        _, trace = search(members(spark, SF), ["a", "b"], "long_view", ["user_id"], rounds=1)
        assert trace == sorted(trace)


def test_loop_keeps_outcomes_out(spark):
    ledger = {r.candidate: r for r in catalog.QUERIES["ctx01_candidate_loop"](spark, SF).collect()}
    for name, column in (("leak", "watched_seconds"), ("noisy leak", "watched_share")):
        assert ledger[name].decision == "error" and f"LineageError: outcomes of the row's own flow into {column}" in ledger[name].detail
    assert ledger["item"].valid > 0 and ledger["trees"].valid > 0


@pytest.mark.parametrize("name", ["mf01_als", "mod09_gbt", "mod10_experts"])
def test_learners_score_every_row(spark, monkeypatch, name):
    """All rows get a score, the training rows too; trees run for their default iterations, and are stubs here."""
    from pitlane.operators import models

    asked = []

    class Stub:
        def __init__(self, budget, seed):
            asked.append(budget)

        def fit(self, past):
            return self

        def transform(self, rows):
            return rows

    monkeypatch.setattr(models, "gbt_learner", lambda *args, **kwargs: Stub)
    monkeypatch.setattr(models, "predict", lambda model, rows: rows.select("row_id", F.col("row_id").cast("double").alias("score")))
    sizes = {r.split: r["count"] for r in catalog.log(spark, SF).where("split is not null").groupBy("split").count().collect()}
    got = [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]
    assert set(sizes) == {"train", "valid", "test"} and (max(asked, default=10) == 10)
    for part in {(r.get("expert"), r.get("strict")) for r in got}:
        assert {r["split"]: r["rows_n"] for r in got if (r.get("expert"), r.get("strict")) == part} == sizes


@pytest.mark.parametrize("name", ["mod01_fm_early_stopping", "mod02_windowed_fm", "mod03_propensity", "mod04_refit", "mod05_trained_losses", "mod07_target_attention", "mod08_weighted_attention", "mod09_lambdarank"])
def test_trained_learners_score_every_row(spark, name):
    """Every row of every split gets a score from each model of the query, the training rows too."""
    sizes = {r.split: r["count"] for r in catalog.log(spark, SF).where("split is not null").groupBy("split").count().collect()}
    got = [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]
    of = {tuple(r.get(k) for k in ("target", "reading", "loss", "mode")) for r in got}
    assert len(of) == {"mod03_propensity": 5, "mod04_refit": 2, "mod05_trained_losses": 6, "mod08_weighted_attention": 3}.get(name, 1)
    for one in of:
        assert {r["split"]: r["rows_n"] for r in got if tuple(r.get(k) for k in ("target", "reading", "loss", "mode")) == one} == sizes
    assert all(0 <= r["primary_score"] <= 1 for r in got)
    if name == "mod01_fm_early_stopping":
        assert all(r["best_pass"] + 4 == r["passes"] or r["passes"] == 40 for r in got)


def test_history_weights(spark):
    """The weights of each mode by hand: none outside of the training rows."""
    from pitlane.operators import learners

    lengths = [0, 0, 2, 10, 32, 5]
    rows = [(i, "train" if i < 4 else "valid", n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "row_id int, split string, history_n int")
    got = {r.row_id: r for r in learners.history_weights(df, F.col("split") == "train", F.col("split") == "valid").collect()}
    assert [got[i].plain for i in range(6)] == [1, 1, 1, 1, 0, 0] and [got[i].late_only for i in range(6)] == [0, 0, 0, 1, 0, 0]
    assert [got[i].recency for i in range(4)] == pytest.approx([0.2 + 1.8 * p for p in (0.5 / 3, 0.5 / 3, 2 / 3, 1.0)]) and got[4].recency == 0
    assert [got[i].hist_match for i in range(6)] == [0, 0, 0, 0, 0, 0]  # no training row has a length that validation rows have


def test_windows_see_their_past_alone(spark):
    """A window's machines are fitted on rows up to its horizon; too few rows score 0, labels of one kind their mean."""
    from pitlane.operators import learners

    rows = [(i, i % 5, 20240101 + i // 100, int(i % 5 < 2), 1) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id int, item int, date int, y int, one int")
    schedule = [(20240101, 20240102, 20231231), (20240103, 20240104, 20240102), (20240105, 20240106, 20240104)]
    before = learners.windowed_fm(df, schedule, ["item"], ["y", "one"], 20240106, least=100, k=4, epochs=2)
    a = {r.row_id: (r.y, r.one) for r in before.collect()}
    assert len(a) == 600 and all(a[i] == (0.0, 0.0) for i in range(200)) and all(a[i][1] == 1.0 for i in range(200, 600))
    assert min(a[i][0] for i in range(200, 600) if i % 5 < 2) > max(a[i][0] for i in range(200, 600) if i % 5 >= 2)
    later = df.withColumn("y", F.when(F.col("date") > 20240102, 1 - F.col("y")).otherwise(F.col("y")))
    b = {r.row_id: r.y for r in learners.windowed_fm(later, schedule, ["item"], ["y", "one"], 20240106, least=100, k=4, epochs=2).collect()}
    assert all(b[i] == pytest.approx(a[i][0], abs=1e-9) for i in range(200, 400)) and any(abs(b[i] - a[i][0]) > 1e-3 for i in range(400, 600))
