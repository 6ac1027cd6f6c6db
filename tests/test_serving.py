"""The ranker, the serving path, streams' tables, nightly versions and the replay, against small independent versions."""

import json
import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketflow import schemas as S
from basketflow.functions import bootstrap, replay
from basketflow.functions import experiment as E
from basketflow.functions.boost import Trees
from basketflow.operators import candidates as C
from basketflow.operators import covisit, drift, features, nightly, ranker, split
from basketflow.plans import registry
from basketflow.sources import topics, versions
from basketflow.streaming import online, sessions

T0 = datetime(2024, 1, 20)


def world(spark, n=60, seed=1):
    """Sessions that walk among products of one category, some with equal seconds, null brands and a free product."""
    rng, rows = np.random.default_rng(seed), []
    for s in range(n):
        at, p = T0 + timedelta(hours=s % 40), int(rng.integers(0, 40))
        for _ in range(int(rng.integers(2, 9))):
            rows.append((s, at, len(rows), p, int(rng.choice([0, 0, 0, 1, 2])), s // 3, p // 10, None if p % 7 == 0 else f"brand{p % 4}", 0.0 if p == 5 else 10.0 + p))
            at += timedelta(seconds=int(rng.choice([0, 60])))
            p = int((p // 10) * 10 + rng.integers(0, 10)) if rng.random() < 0.8 else int(rng.integers(0, 40))
    return spark.createDataFrame(rows, "session long, event_time timestamp, seq long, product_id long, event_type int, user_id long, category_id long, brand string, price double")


@pytest.fixture(scope="module")
def built(spark):
    ev = world(spark).cache()
    history = ev.withColumn("pos", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("session").orderBy("event_time", "seq")) - 1)
    last = history.groupBy("session").agg(F.max_by(F.struct("event_time", "product_id"), "pos").alias("l"))
    cases = last.select("session", F.col("l.event_time").alias("cut_time"), F.col("l.product_id").alias("last_product"), ((F.col("l.product_id") + 1) % 40).alias("target"))
    matrix = covisit.build(ev).cache()
    end = T0 + timedelta(days=3)
    stats, pop = features.product_stats(ev, end), C.popular(ev, end)
    return history.cache(), cases.cache(), matrix, stats, pop, features.build(history, cases, matrix, stats).cache()


def test_serving_features_are_the_batch_features(built):
    history, _, matrix, stats, pop, batch = built
    got = online.online_features(history, online.export(matrix, stats, pop)).cache()
    row = online.parity(batch, got).first()
    assert (row.candidate_set_mismatches, row.missing_value_mismatches, row.max_relative_feature_diff) == (0, 0, 0.0)
    assert row.sessions == row.identical_top_lists == 60 and row.feature_rows == batch.count()
    off = online.parity(batch.where("session <> 3"), got.withColumn("h_events", F.when(F.col("session") == 4, F.lit(None)).otherwise(F.col("h_events")))).first()
    assert off.candidate_set_mismatches == 1 and off.missing_value_mismatches > 0


def test_price_ratio_has_the_limits_of_division(spark):
    odd = [-2.5, -0.0, 0.0, 4.0, float("nan"), float("inf")]
    rows = spark.createDataFrame([(a, b) for a in odd for b in odd] + [(None, 0.0), (1.0, None)], "p double, l double")
    got = rows.select("p", "l", features.price_ratio(F.col("p"), F.col("l")).alias("r")).collect()
    with np.errstate(all="ignore"):
        assert all(r.r is None if r.p is None or r.l is None else np.array_equal(np.float64(r.p) / np.float64(r.l), r.r, equal_nan=True) for r in got)


def test_serving_features_of_sessions_cut_by_batches_and_of_unknown_products(spark, built):
    history, cases, matrix, stats, pop, _ = built
    holes = history.withColumn("product_id", F.when(F.col("seq") % 11 != 0, F.col("product_id")))
    last = holes.groupBy("session").agg(F.max_by(F.struct("product_id"), "pos").alias("l")).select("session", F.col("l.product_id").alias("last_product"))
    batch = features.build(holes, cases.drop("last_product").join(last, "session"), matrix, stats)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        row = online.parity(batch, online.online_features(holes, online.export(matrix, stats, pop))).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (row.candidate_set_mismatches, row.missing_value_mismatches, row.max_relative_feature_diff) == (0, 0, 0.0)
    assert row.feature_rows == batch.count() > 0 and row.sessions == row.identical_top_lists


def test_serving_features_of_events_whose_numbers_repeat_or_are_missing(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    at = f"{tmp_path}/events.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CASE WHEN event_id % 4 > 0 THEN 7 END::BIGINT AS event_id, ts + to_seconds(i) AS ts, user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', (SELECT range::BIGINT AS i FROM range(2))) TO '{at}'")
    assert con.execute(f"SELECT count(*) = count(DISTINCT ts) FROM '{at}'").fetchone() == (True,)  # the order by time and seq leaves nothing open
    con.execute(f"CREATE VIEW events AS FROM '{at}'")
    sql = con.execute(registry.ORACLE_SQL["online_features"])
    names, want = [c[0] for c in sql.description], sql.fetchall()
    got = registry.QUERIES["online_features"](spark, str(tmp_path))
    by = lambda r: tuple(dict(zip(names, r, strict=True))[c] for c in ("session", "product_id"))
    assert got.columns == names and sorted(map(tuple, got.collect()), key=by) == sorted(want, key=by) and len(want) > 100


def test_recommend_works_its_features_out_once(spark, monkeypatch):
    calls, own = [], registry._online
    monkeypatch.setattr(registry, "_online", lambda s, d: calls.append(d) or own(s, d))
    registry.QUERIES["recommend"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


class _PlainTrees(Trees):
    """The same trees with every bin of every node counted from all rows at once."""

    def fit(self, x, y):
        d, width = x.shape[1], self.bins + 1
        self.edges = [np.unique(np.quantile(k, np.linspace(0, 1, self.bins)[1:-1])) if len(k := c[~np.isnan(c)]) else np.zeros(0) for c in x.T]
        codes = self._codes(x)
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        f, self.trees, self.gain = np.full(len(y), self.start), [], np.zeros(d)
        for _ in range(self.rounds):
            p, node, splits = 1 / (1 + np.exp(-f)), np.zeros(len(y), np.int64), []
            up, slope = y - p, p * (1 - p)
            for level in range(self.depth):
                k = 1 << level
                place = (node[:, None] * (d * width) + codes + np.arange(d) * width).ravel()
                g, h = (np.bincount(place, np.repeat(w, d), k * d * width).reshape(k, d, width).cumsum(2) for w in (up, slope))
                best = lambda a, b: a * a / (b + self.ridge)
                rise = best(g, h) + best(g[..., -1:] - g, h[..., -1:] - h) - best(g[..., -1:], h[..., -1:])
                rise[(h < self.least) | (h[..., -1:] - h < self.least)] = 0
                at = rise.reshape(k, -1).argmax(1)
                won = rise.reshape(k, -1)[np.arange(k), at]
                column, cut = at // width, np.where(won > 1e-9, at % width, width)
                np.add.at(self.gain, column, np.where(won > 1e-9, won, 0))
                splits.append((column, cut))
                node = 2 * node + (codes[np.arange(len(y)), column[node]] > cut[node])
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, up, k) / (np.bincount(node, slope, k) + self.ridge)
            self.trees.append((splits, leaf))
            f += leaf[node]
        return self


def test_trees_are_the_plain_ones_in_much_less_time():
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(60000, 20)), rng.integers(0, 3, (60000, 3)), np.zeros(60000)]
    x[rng.random(x.shape) < 0.05] = np.nan
    y = (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 21]) + rng.normal(size=60000) > 0.5).astype(float)
    took, got = [], []
    for kind in (_PlainTrees, Trees):
        began = time.process_time()
        m = kind(8).fit(x, y)
        took.append(time.process_time() - began)
        got.append((m.score(x), m.gain))
    assert np.allclose(got[0][0], got[1][0], atol=1e-9) and np.allclose(got[0][1], got[1][1], rtol=1e-9)
    assert took[1] < 0.7 * took[0]


def test_candidates_weigh_by_the_reciprocal_of_the_rank(spark):
    items = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2)], "session long, product_id long, h_rank int")
    matrix = spark.createDataFrame([("time", 3, 8, 3.0, 1), ("time", 3, 9, 1.0, 2)], "kind string, product_id long, neighbour long, weight float, rank int")
    last = spark.createDataFrame([(1, 1)], "session long, last_product long")
    got = {r.product_id: r.c_time_all for r in features.candidates(items, matrix, last).collect()}
    third = float(np.float32(1 / 3))
    assert got[9] == 1.0 / 3 * third != third / 3  # as covis_scores and the SQL have it


def test_serving_order_takes_halves_of_the_ninth_digit_up():
    assert online._nine(np.array([0.0009765625, 0.0029296875, 0.5])).tolist() == [976563, 2929688, 500000000]
    assert (np.array([0.0009765625]).round(9) * 1e9).round()[0] == 976562  # numpy's own rounding, used before


def test_recommend_fills_with_popular_products(spark):
    scores = spark.createDataFrame([(1, 10, 9.0), (1, 20, 5.0), (1, 21, 7.0)], "session long, product_id long, score double")
    last = spark.createDataFrame([(1, 10), (2, 30)], "session long, last_product long")
    pop = spark.createDataFrame([(30, 9), (20, 8), (40, 7), (50, 6)], "product_id long, pop long")
    got = {r.session: (r["items"], r.scores) for r in online.recommend(scores, last, pop, 4).collect()}
    assert got == {1: ([21, 20, 30, 40], [7.0, 5.0, 0.0, 0.0]), 2: ([20, 40, 50], [0.0, 0.0, 0.0])}


def test_ranker_learns_and_scores_alike(spark, built):
    rows = features.train_sample(built[5].withColumn("label", (F.col("h_rank") == 1).cast("int")).fillna(0, ["label"]))
    model = ranker.train(rows, trees=6, depth=3)
    assert 0 < len(model.trees) <= 6 and max(model.ndcg) > 0.6
    top = ranker.importance(spark, model).orderBy("place").first()
    assert top.feature in ("h_rank", "in_history", "h_seconds") and top.importance > 0.2
    scored = ranker.score(model, rows).join(rows.select("session", "product_id", "label"), ["session", "product_id"])
    assert scored.groupBy("session").agg(F.max_by("label", "score").alias("hit")).agg(F.avg("hit")).first()[0] > 0.5


def test_gradients_are_pairwise(spark):
    rows = [(1, 10, 0, 0.3), (1, 11, 1, 0.1), (1, 12, 0, -0.2), (2, 1, 0, 0.0)]
    got = {(r.session, r.product_id): (r.up, r.slope) for r in ranker.gradients(spark.createDataFrame(rows, "session long, product_id long, label int, s double")).collect()}
    gain = lambda p: 1 / math.log2(1 + p)
    want = {}
    for p, place, s in ((10, 1, 0.3), (12, 3, -0.2)):
        wrong = 1 / (1 + math.exp(0.1 - s))
        want[p] = (abs(gain(place) - gain(2)) * wrong, abs(gain(place) - gain(2)) * wrong * (1 - wrong))
    assert got[1, 10] == pytest.approx((-want[10][0], want[10][1])) and got[1, 12] == pytest.approx((-want[12][0], want[12][1]))
    assert got[1, 11] == pytest.approx((want[10][0] + want[12][0], want[10][1] + want[12][1])) and got[2, 1] == (0, 0)


def users(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    sessions = 1 + rng.poisson(2, n)
    hits = rng.binomial(sessions, np.clip(0.4 + 0.2 * x[:, 0], 0.02, 0.98))
    arm = rng.integers(0, 2, n)
    return spark.createDataFrame([(i, int(arm[i]), int(sessions[i]), int(hits[i]), float(x[i, 0]), float(x[i, 1]), 1.0) for i in range(n)], "user_id long, arm int, n int, y int, x0 double, x1 double, one double").cache()


def test_adjusted_difference_is_least_squares(spark):
    rows = users(spark)
    pdf = rows.toPandas()
    psi, r = np.zeros(len(pdf)), {}
    for k in (0, 1):
        m = (pdf["arm"] == k).to_numpy()
        r[k] = pdf["y"][m].sum() / pdf["n"][m].sum()
        psi[m] = (pdf["y"][m] - r[k] * pdf["n"][m]) / pdf["n"][m].mean()
    x = pdf[["x0", "x1"]].to_numpy()
    slope = np.linalg.lstsq(x - x.mean(0), psi, rcond=None)[0]
    left, means, var = psi - x @ slope, {}, 0.0
    for k in (0, 1):
        m = (pdf["arm"] == k).to_numpy()
        means[k] = x[m].mean(0)
        var += left[m].var(ddof=1) / m.sum()
    got = E.cuped(rows, "arm", "y", "n", ("x0", "x1", "one")).first()
    assert got.effect == pytest.approx(r[1] - r[0] - slope @ (means[1] - means[0])) and got.se == pytest.approx(math.sqrt(var))
    plain = E.difference(E.sums(rows, "arm", "y", "n"), "arm").first()
    assert got.se < plain.se
    reduced = E.reduction(rows.where("arm = 0"), "y", "n", ("x0", "x1")).first().reduction
    assert 0.05 < reduced < 0.9 and E.reduction(rows.where("arm = 0"), "y", "n", ("one",)).first().reduction == pytest.approx(0)
    # the bootstrap's matrices give the same with weights of one
    test = bootstrap.Test(("t0",), ("i0",), ("x0", "x1", "one"))
    both = rows.select("user_id", "arm", F.col("n").alias("sessions"), F.col("y").alias("c"), F.col("y").alias("t0"), (F.col("user_id") % 3 - 1).alias("i0"), F.lit(0).alias("a"), "x0", "x1", "one")
    m = replay.matrices(both, test, "arm")
    same = test.difference(m[1,], m[0,], "t0")
    assert [same[k] for k in ("", "_se", "cuped", "cuped_se")] == pytest.approx([plain.effect, plain.se, got.effect, got.se])


def test_bootstrap_has_the_spread_of_the_delta_method(spark):
    test = bootstrap.Test(("t0",), ("i0",), ("x0", "x1"))
    rows = users(spark).select("user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("day"), F.col("n").alias("sessions"), F.col("y").alias("c"), F.least(F.col("y") + F.col("user_id") % 2, F.col("n")).alias("t0"), (F.col("user_id") % 3 - 1).alias("i0"), F.lit(0).alias("a"), "x0", "x1")
    got = bootstrap.simulate(rows, test, 200).toPandas()
    assert len(got) == 400 and got[got["day"] == 0][["ab", "il"]].to_numpy() == pytest.approx(got[got["day"] == 1][["ab", "il"]].to_numpy())
    one = got[got["day"] == 0]
    assert one["ab"].std() == pytest.approx(one["ab_se"].mean(), rel=0.2) and one["aa"].mean() == pytest.approx(0, abs=0.02) and one["cuped_se"].mean() < one["ab_se"].mean()
    again = bootstrap.simulate(rows.repartition(7), test, 3).orderBy("replicate", "day").toPandas()
    first = bootstrap.simulate(rows.coalesce(1), test, 3).orderBy("replicate", "day").toPandas()
    assert again["ab"].to_numpy() == pytest.approx(first["ab"].to_numpy())
    w = bootstrap.weights(np.arange(20000), 0, 1)
    assert w.mean() == pytest.approx(0.5, abs=0.02) and w.var() == pytest.approx(0.5, abs=0.03)


def test_replay_figures():
    assert replay.first_day([0.2, 0.79, 0.81, 0.9]) == 3 and replay.first_day([0.1]) is None
    got = replay.tested(0.02, 0.01)
    assert got["lo"] == pytest.approx(0.02 - 0.0195996, abs=1e-6) and got["p"] == pytest.approx(0.0455, abs=1e-4) and replay.tested(0.1, 0.0)["p"] is None
    week = [{"day": d, "share": 1.0, "users": 100 * (d + 1), "effect": 0.05, "se": 0.1 / (d + 1), "cuped_se": 0.05 / (d + 1), "preference": 0.2, "preference_se": 0.1 / (d + 1)} for d in range(7)]
    row = replay.sensitivity(week)[0]
    assert row["days_ab"] == 6 and row["days_ab_cuped"] == 3 and row["days_interleaving"] == 2
    assert row["ab_over_interleaving"] == pytest.approx(16) and row["ab_over_cuped"] == pytest.approx(4)


def test_trees_find_what_moves():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 2], nan=2.0) + rng.normal(size=4000) * 0.5 > 0.5).astype(float)
    trees = Trees().fit(x[:3000], y[:3000])
    assert trees.gain.argmax() == 2 and drift._told_apart(y[3000:], trees.score(x[3000:])) > 0.9
    assert np.isfinite(Trees(rounds=3).fit(np.full((10, 2), np.nan), np.arange(10) % 2).score(np.zeros((2, 2)))).all()


def sample(spark, n, shift=0.0, seed=0, start=0):
    rng = np.random.default_rng(seed)
    rows = [(f"r{start + i}", start + i, float(rng.normal() + shift), float(rng.normal())) for i in range(n) for _ in range(5)]
    return spark.createDataFrame(rows, "request string, seq long, a double, b double")


def test_checks_name_what_moved(spark):
    got = drift.adversarial(sample(spark, 150), sample(spark, 150, 1.5, 1, 1000), ("a", "b")).first()
    assert got.auc > 0.75 and got.top == got.psi_top == "a" and (got.n_ref, got.n_cur, got.rows_ref) == (150, 150, 750)
    assert drift.adversarial(sample(spark, 150), sample(spark, 150, 0.0, 1, 1000), ("a", "b")).first().auc < 0.6
    assert drift.adversarial(sample(spark, 150), sample(spark, 150, 0.0, 1, 1000), ("a", "b"), most=20).first().n_cur == 20


def test_a_grid_compares_all_requests(spark):
    ev = world(spark)
    assert drift.requests(ev, T0, T0 + timedelta(days=9)).select("request").distinct().count() == ev.count()
    side = lambda name, *how: sample(spark, *how).select(F.lit(name).alias("side"), "request", "a", "b")
    rows = side("x", 150).unionByName(side("y", 100, 0.0, 1, 1000)).unionByName(side("z", 100, 1.5, 2, 2000)).withColumn("b", F.when(F.col("request") != "r3", F.col("b")).otherwise(F.lit(float("inf"))))
    keep = lambda df: df.cache()
    got = {r.check: r for r in drift.grid(rows, [("same", ("x",), ("y",)), ("moved", ("x", "y"), ("z",))], keep, ("a", "b")).collect()}
    assert (got["same"].n_ref, got["same"].n_cur, got["moved"].n_ref, got["moved"].n_cur) == (150, 100, 250, 100)
    assert got["moved"].rows_ref == rows.where("side <> 'z'").count() and got["moved"].auc > 0.8 and got["same"].auc < 0.6
    by_hand = drift.psi(rows.where("side <> 'z'"), rows.where("side = 'z'"), ["a", "b"]).collect()
    assert {r.feature: r.psi for r in got["moved"].psis} == pytest.approx({r.column: r.psi for r in by_hand}, abs=1e-6)
    drawn = drift.windows(rows, [("w", "x", "z")], keep, most=20)
    assert drawn.groupBy("label").agg(F.count_distinct("request")).orderBy("label").collect() == [(0, 20), (1, 20)]
    x, y = np.random.default_rng(0).integers(0, 9, (400, 3)), np.arange(400) % 2
    n = np.random.default_rng(1).integers(1, 5, 400)
    a, b = Trees(5).grow(x, y.astype(float), n).apply(x), Trees(5).grow(np.repeat(x, n, 0), np.repeat(y, n).astype(float)).apply(x)
    assert np.allclose(a, b)


def test_monitor_goes_from_version_to_alert(spark):
    m = drift.Monitor(lambda df: df.cache(), columns=("a", "b"), window=60, least=30)
    a = sample(spark, 200)
    upto = lambda k: a.where(F.col("seq") < k)
    states = [m.step("v1", upto(10))["state"], m.step("v1", upto(40))["state"], m.step("v1", upto(80))["state"], m.step("v1", upto(90))["state"], m.step("v1", upto(160))["state"]]
    assert states == ["new_version", "collecting", "baseline", "collecting", "ok"]
    broken = a.unionByName(sample(spark, 60, 3.0, 4, 1000))
    assert m.step("v1", broken)["state"] == "alert" and m.step("v2", broken)["state"] == "new_version" and m.baseline is None


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 2.0, 9.0], list(range(1000)), [5.0], [0.5, None, 0.25, 0.75]])
def test_quantiles_are_linear(spark, values):
    cuts = [0.1, 0.25, 0.5, 0.9]
    rows = spark.createDataFrame([("c", None if v is None else float(v)) for v in values], "column string, v double")
    known = [v for v in values if v is not None]
    got = drift.quantiles(rows, cuts, parts=16).first()
    assert got.edges == pytest.approx(np.quantile(known, cuts).tolist()) and got.total == len(known)


def test_staleness_is_in_milliseconds(spark):
    rows = spark.range(101).select(F.lit(5.0).alias("sent"), (5 + F.col("id") / 1000).alias("done"))
    assert tuple(sessions.staleness(rows, "sent", "done").first()) == pytest.approx((101, 50, 95, 99))
    assert sessions.staleness(rows.limit(0), "sent", "done").count() == 0


def test_session_store_keeps_the_newest_and_each_batch_once(spark, tmp_path):
    store = sessions.SessionStore(spark, f"file://{tmp_path}/store", cap=3, ttl=600)
    ev = lambda rows: spark.createDataFrame([(s, q, p, T0 + timedelta(seconds=t)) for s, q, p, t in rows], "session long, seq long, product_id long, event_time timestamp")
    first = ev([(1, 0, 10, 0), (1, 1, 11, 1), (2, 2, 20, 2)])
    for _ in range(2):
        store.append(first, 0)
    store.append(ev([(1, 3, 12, 500), (1, 4, 13, 603)]), 1)
    assert {r.session: (r.n_kept, r.products) for r in store.sessions().collect()} == {1: (3, "11,12,13")}


def test_lag_and_offsets(spark, tmp_path):
    at = f"file://{tmp_path}/topic"
    rows = spark.range(100).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").alias("seq"), F.lit("{}").alias("value"))
    topics.write_folder(rows.where("seq < 60"), at, 3)
    high = spark.read.parquet(at).groupBy("partition").agg((F.max("offset") + 1).alias("high"))
    high = spark.createDataFrame(high.collect(), high.schema)  # appending to a path makes what was read from it anew
    topics.write_folder(rows.where("seq >= 60"), at, 3, high)
    log = spark.read.parquet(at)
    assert log.select("partition", "offset").distinct().count() == 100 and log.groupBy("key").agg(F.count_distinct("partition").alias("n")).where("n > 1").count() == 0
    assert sessions.lag(log, high.withColumnRenamed("high", "position")).first().lag == 40
    progress = {"sources": [{"endOffset": {"t": {"0": 5, "1": 7}}, "latestOffset": {"t": {"0": 9, "1": 7}}}, {"endOffset": None, "latestOffset": json.dumps({"u": {"0": 3}})}]}
    assert sessions.progress_lag(progress) == 7
    if not topics.has_kafka(spark):
        with pytest.raises(RuntimeError, match="spark-sql-kafka"):
            topics.read_kafka(spark, "nowhere:9092", "t")


def test_replay_publishes_by_speed(spark, tmp_path):
    ev = world(spark, 6)
    n = sessions.replay(ev, f"file://{tmp_path}/out", speed=3_600_000, step=0.005)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert n >= 1 and out.count() == ev.count() and sessions.decode(out).agg(F.sum("product_id")).first()[0] == ev.agg(F.sum("product_id")).first()[0]


def test_sampler_drops_what_it_cannot_write(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("request"), F.col("id").alias("seq"))
    sampler = sessions.Sampler(f"file://{tmp_path}/s", 0.5, 100)
    sampler.record(rows.where("seq < 500"), 0)
    sampler.record(rows.where("seq >= 500"), 1)
    got = [r.seq for r in sampler.rows(spark).collect()]
    assert len(got) == 100 and min(got) > 700 and got == sorted(got, reverse=True)
    (tmp_path / "file").write_text("x")
    broken = sessions.Sampler(f"file://{tmp_path}/file", 1.0, 10)
    broken.record(rows, 0)
    assert broken.dropped == 1


def test_versions_never_take_away_what_is_served(spark, tmp_path):
    v = versions.Versions(spark, f"file://{tmp_path}/v")
    one, two = spark.range(1), spark.range(2)
    assert v.current() is None and v.publish(v.build("n", {"t": one}, {})) == "n"
    served = v.table("t")
    again = v.build("n", {"t": two}, {})
    assert again == "n.1" and served.count() == 1 and v.current() == "n"
    v.publish(again)
    assert v.table("t").count() == 2
    with pytest.raises(ValueError, match="incomplete"):
        v.publish("missing")


def test_validate_asks_for_full_lists(spark):
    matrix = spark.createDataFrame([("time", p, q) for p in range(8) for q in range(8) if p != q], "kind string, product_id long, neighbour long")
    pop = spark.createDataFrame([(p, 10 - p) for p in range(8)], "product_id long, pop long")
    lists = lambda *rows: spark.createDataFrame([(list(range(n)), [x] * n) for n, x in rows], "items array<long>, scores array<double>")
    status = lambda probes, new=matrix: nightly.validate(new, matrix, pop, probes).first().status
    assert status(lists((20, 0.0), (20, 1.0))) == "ok" and status(lists((20, 0.0), (19, 1.0))) == "probes" and status(lists((20, float("nan")))) == "probes"
    assert status(lists((20, 0.0)), matrix.where("product_id < 5")) == "size"
    assert status(lists((20, 0.0)), matrix.withColumn("neighbour", F.col("neighbour") + 100)) == "overlap"


def test_cases_take_all_sessions(spark):
    ev = world(spark, 40)
    history, cases = split.cases(ev, "B")
    assert cases.count() > 20 and split.cases(ev, "B", n=5)[1].count() == 5
    assert history.join(cases, "session").where("event_time > cut_time").count() == 0


def test_no_query_is_another_name_of_one():
    assert len({id(f) for f in registry.QUERIES.values()}) == len(registry.QUERIES)
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and S.TOP_POPULAR == 200
