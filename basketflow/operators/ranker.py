"""The ranker: boosted trees on list-wise gradients, the session's positive against each of its other rows.

Every round orders a session's rows by score. A row that is not the target pushes it with the
chance that the pair is the wrong way round, times what their exchange would change of NDCG; Spark's
regression tree is fitted to these gradients, and each leaf moves scores by the sum of its gradients
over the sum of their slopes. A tenth of the sessions is held out: rounds stop when their NDCG@10 has not
risen for `patience` of them, and the trees up to the best round are the model.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketflow import schemas as S
from basketflow.operators.split import order_hash

MISSING = -1e9


@dataclass
class Ranker:
    """Trees with the moves of their leaves; ndcg: of the held-out sessions after each round."""

    trees: list
    moves: list[dict[float, float]]
    ndcg: list[float]
    rows: int = 0
    sessions: int = 0


def vectors(rows: DataFrame, *keep: str) -> DataFrame:
    """Adds x; a missing or non-finite feature becomes one far-off value, so trees can split on it."""
    fixed = {c: F.when(F.abs(F.col(c).cast("double")) < 1e30, F.col(c).cast("double")).otherwise(F.lit(MISSING)) for c in S.FEATURES}
    return VectorAssembler(inputCols=list(S.FEATURES), outputCol="x").transform(rows.select("session", "product_id", *keep, *(v.alias(k) for k, v in fixed.items()))).select("session", "product_id", *keep, "x")


def gradients(rows: DataFrame) -> DataFrame:
    """Adds place, up and slope to rows (session, product_id, label, s): the list-wise gradient and its slope."""
    own = Window.partitionBy("session")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy(F.desc("s"), "product_id")))
    at = lambda c: F.max(F.when(F.col("label") == 1, F.col(c))).over(own)
    rows = rows.withColumns({"best_s": at("s"), "best_place": at("place")})
    gain = lambda p: 1 / F.log2(1 + F.col(p))
    wrong = 1 / (1 + F.exp(F.col("best_s") - F.col("s")))
    pair = F.when((F.col("label") == 0) & F.col("best_s").isNotNull(), F.abs(gain("place") - gain("best_place")))
    rows = rows.withColumns({"push": F.coalesce(pair * wrong, F.lit(0.0)), "turn": F.coalesce(pair * wrong * (1 - wrong), F.lit(0.0))})
    total = lambda c: F.sum(c).over(own)
    up = F.when(F.col("label") == 1, total("push")).otherwise(-F.col("push"))
    return rows.withColumns({"up": up, "slope": F.when(F.col("label") == 1, total("turn")).otherwise(F.col("turn"))}).drop("best_s", "best_place", "push", "turn")


def _moved(leaf: Column, moves: dict[float, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for v in chain(*moves.items()))), leaf), F.lit(0.0)) if moves else F.lit(0.0)


def train(rows: DataFrame, seed: int = 0, trees: int = 100, depth: int = 4, rate: float = 0.3, holdout: float = 0.1, patience: int = 5) -> Ranker:
    """rows: features of sessions (session, product_id, label, FEATURES)."""
    share = F.conv(F.substring(order_hash(seed, F.col("session")), 1, 6), 16, 10).cast("long") / F.lit(float(1 << 24))
    now = vectors(rows.withColumn("held", share < holdout), "label", "held").withColumn("s", F.lit(0.0)).persist(StorageLevel.MEMORY_AND_DISK)
    size = now.where("not held").agg(F.count("*"), F.count_distinct("session")).first()
    out = Ranker([], [], [], *size)
    best, since = -1.0, 0
    for _ in range(trees):
        graded = gradients(now)
        fitted = DecisionTreeRegressor(featuresCol="x", labelCol="up", maxDepth=depth, seed=seed, leafCol="leaf", predictionCol="p").fit(graded.where("not held").select("x", "up"))
        told = fitted.transform(graded.where("not held").select("x", "up", "slope")).groupBy("leaf").agg(F.sum("up").alias("up"), F.sum("slope").alias("slope")).collect()  # 2 ** depth rows at most
        moves = {r["leaf"]: rate * r["up"] / (r["slope"] + 1e-3) for r in told}
        new = fitted.transform(now).withColumn("s", F.round(F.col("s") + _moved(F.col("leaf"), moves), 9)).drop("leaf", "p").persist(StorageLevel.MEMORY_AND_DISK)
        place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("s"), "product_id"))
        row = new.withColumn("place", place).where("label = 1").groupBy("held").agg(F.avg(F.when(F.col("place") <= 10, 1 / F.log2(1 + F.col("place"))).otherwise(0.0)).alias("n")).collect()
        ndcg = {r["held"]: r["n"] for r in row}
        now.unpersist()
        now = new
        out.trees.append(fitted)
        out.moves.append(moves)
        out.ndcg.append(float(ndcg.get(True, ndcg.get(False, 0.0)) or 0.0))  # without held-out sessions those trained on
        if out.ndcg[-1] > best:
            best, since = out.ndcg[-1], 0
        else:
            since += 1
            if since >= patience:
                break
    now.unpersist()
    keep = out.ndcg.index(max(out.ndcg)) + 1 if out.ndcg else 0
    return Ranker(out.trees[:keep], out.moves[:keep], out.ndcg, out.rows, out.sessions)


def score(model: Ranker, rows: DataFrame) -> DataFrame:
    """(session, product_id, score) to nine digits."""
    rows = vectors(rows)
    total = F.lit(0.0)
    for i, (tree, moves) in enumerate(zip(model.trees, model.moves, strict=True)):
        rows = tree.copy({tree.leafCol: f"leaf{i}", tree.predictionCol: f"p{i}"}).transform(rows)
        total = total + _moved(F.col(f"leaf{i}"), moves)
    return rows.select("session", "product_id", F.round(total, 9).alias("score"))


def importance(spark, model: Ranker) -> DataFrame:
    """(feature, importance, place): each feature's share of what the splits of all trees gain."""
    sums = dict.fromkeys(S.FEATURES, 0.0)
    for tree in model.trees:
        for f, v in zip(S.FEATURES, tree.featureImportances.toArray(), strict=True):
            sums[f] += float(v)
    total = sum(sums.values()) or 1.0
    order = sorted(sums, key=lambda f: (-sums[f], f))
    return spark.createDataFrame([(f, sums[f] / total, i + 1) for i, f in enumerate(order)], "feature string, importance double, place int")


def candidate_recall(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """The share of cases whose target is among the candidates."""
    hit = rows.where("label = 1").select("session").distinct().withColumn("hit", F.lit(1))
    return cases.select("session").join(hit, "session", "left").agg(F.count("*").alias("n_cases"), F.count("hit").alias("n_hit"), F.round(F.count("hit") / F.count("*"), 6).alias("candidate_recall"))
