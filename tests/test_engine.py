"""Hand-worked cases of the session engine."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketflow import schemas as S
from basketflow.functions import experiment as E
from basketflow.functions import interleave
from basketflow.operators import candidates as C
from basketflow.operators import covisit, drift, nightly, split

T0 = datetime(2024, 1, 20)


def events(spark, rows):
    """rows: (session, minute, product, type)."""
    data = [(s, T0 + timedelta(minutes=m), i, p, t, s, p // 10, None if p % 7 == 0 else f"brand{p % 4}", 10.0 + p) for i, (s, m, p, t) in enumerate(rows)]
    return spark.createDataFrame(data, "session long, event_time timestamp, seq long, product_id long, event_type int, user_id long, category_id long, brand string, price double")


def test_runs_never_cross_sessions(spark):
    ev = events(spark, [(1, 0, 10, 0), (1, 1, 10, 0), (1, 2, 20, 0), (1, 3, 20, 0), (1, 4, 30, 0), (2, 5, 40, 0)])
    got = [r["target"] for r in split.runs(ev).orderBy("seq").collect()]
    assert got == [20, 20, 30, 30, None, None]


def test_covisitation_gap_and_weights(spark):
    m = covisit.build(events(spark, [(1, 0, 10, 0), (1, 30, 20, 0), (1, 1500, 30, 0)]))
    assert {(r.product_id, r.neighbour) for r in m.where("kind = 'type'").collect()} == {(10, 20), (20, 10)}
    m = covisit.build(events(spark, [(1, 0, 10, 0), (1, 1, 20, 1), (2, 0, 10, 0), (2, 1, 20, 2)]))
    assert m.where("kind = 'type' and product_id = 10").first()["weight"] == 9.0


def test_cut_at_thirty(spark):
    m = covisit.build(events(spark, [(1, i, 1000 + i, 0) for i in range(40)]))
    assert m.where("product_id < 1010").count() == 0 and m.where("product_id >= 1010").count() > 0


def test_top_k_pads(spark):
    scores = spark.createDataFrame([(1, 10, 9.0), (1, 20, 5.0), (1, 21, 7.0)], "session long, product_id long, score double")
    cases = spark.createDataFrame([(1, 10), (2, 30)], "session long, last_product long")
    pop = spark.createDataFrame([(30, 9), (20, 8), (40, 7), (50, 6)], "product_id long, pop long")
    got = {r.session: r.run for r in C.top_k(scores, cases, pop, 4).collect()}
    assert got == {1: [21, 20, 30, 40], 2: [20, 40, 50, -1]}


def test_metrics(spark):
    runs = spark.createDataFrame([(1, [5, 6, 7]), (2, [8, 9, 10]), (3, [11, 12, 13])], "session long, run array<long>")
    cases = spark.createDataFrame([(1, 5), (2, 10), (3, 99)], "session long, target long")
    r = C.evaluate(runs, cases).first()
    assert (r.recall_20, r.mrr_20, r.ndcg_10) == (0.6667, round((1 + 1 / 3) / 3, 4), 0.5)


def test_recency_is_by_position(spark):
    h = spark.createDataFrame([(1, 10, 0, T0, 0), (1, 20, 1, T0, 0), (1, 10, 2, T0, 0)], "session long, product_id long, pos int, event_time timestamp, event_type int")
    assert {r.product_id: r.h_rank for r in C.history_items(h).collect()} == {10: 0, 20: 1}


def test_buckets_and_arms(spark):
    ids = spark.createDataFrame([(i,) for i in [512475445, *range(1, 13)]], "u long")
    got = {r.u: (r.b, r.a) for r in ids.select("u", E.bucket(F.col("u"), S.SALT).alias("b"), E.assign(F.col("u"), S.SALT).cast("int").alias("a")).collect()}
    assert got[512475445][0] == 0.12737002305763723 and got[1][0] == 0.07605689034847207
    assert [got[i][1] for i in range(1, 13)] == [1, 1, 0, 1, 0, 1, 1, 0, 1, 1, 0, 0]


def test_team_draft():
    a, b = [1, 2, 3, 4], [2, 5, 1, 6]
    assert interleave.team_draft_one(a, b, [True, True, False, True], 4) == ([1, 2, 5, 3], [1, -1, -1, 1])
    assert interleave.team_draft_one(a, b, [False, True, True, True], 4) == ([2, 1, 3, 5], [-1, 1, 1, -1])


def test_auc_counts_ties_as_halves(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)]
    got = drift.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auc"]
    assert got == pytest.approx((1 + 1 + 0.5 + 1) / 4)


@pytest.mark.parametrize("n,last,status", [(100, 23, "ok"), (0, 23, "no events"), (100, 10, "not complete"), (400, 23, "volume"), (20, 23, "volume")])
def test_gate(spark, n, last, status):
    days = [(datetime(2024, 1, d), 100, datetime(2024, 1, d, 23, 30)) for d in range(13, 20)]
    days += [(datetime(2024, 1, 20), n, datetime(2024, 1, 20, last, 30))] if n else []
    got = nightly.gate(spark.createDataFrame(days, "d timestamp, n long, last timestamp"), "2024-01-20").first()
    assert got["status"] == status


def test_panel(spark):
    rows = spark.createDataFrame([(0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 2, 1)], "user_id long, day int, hit int")
    got = {(r.user_id, r.day): (r.sessions, r.active) for r in E.panel(rows, 3, ("hit",)).collect()}
    assert [got[0, d][0] for d in range(3)] == [0, 1, 2] and [got[1, d][0] for d in range(3)] == [1, 1, 2]
    assert [got[0, d][1] + got[1, d][1] for d in range(3)] == [1, 2, 2]
