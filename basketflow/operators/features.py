"""Product statistics, candidate rows and the 24 features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketflow import schemas as S
from basketflow.operators.candidates import covis_scores, history_items


def product_stats(stats: DataFrame, end) -> DataFrame:
    """Latest price, category and brand (nulls kept) and recent counts (null without events in 7 days); one pass."""
    latest = F.max_by(F.struct("price", "category_id", "brand"), F.struct("event_time", "seq"))
    week, day = (F.col("event_time") >= F.lit(end) - F.expr(f"INTERVAL {n} DAYS") for n in (7, 1))
    rows = stats.groupBy("product_id").agg(
        latest.alias("l"), F.count_if(week).alias("p_events_7d"), F.count_if(day).alias("p_events_1d"), F.count_if(week & (F.col("event_type") == 1)).alias("p_carts_7d"), F.count_if(week & (F.col("event_type") == 2)).alias("p_purchases_7d")
    )
    seen = F.col("p_events_7d") > 0
    return rows.select(
        "product_id", F.col("l.price").alias("p_price"), F.col("l.category_id").alias("p_category"), F.col("l.brand").alias("p_brand"),
        *(F.when(seen, F.col(c)).alias(c) for c in ("p_events_1d", "p_events_7d", "p_carts_7d", "p_purchases_7d")),
    )


def candidates(items: DataFrame, matrix: DataFrame, last: DataFrame) -> DataFrame:
    """Six scores and their sum for the best 40 co-visited products and the session's own.

    One join with the matrix and one aggregation give all six: a score over the last product is
    a part of that over the whole history.
    """
    m = matrix.select("kind", "product_id", "neighbour", (F.col("weight") / F.max("weight").over(Window.partitionBy("kind", "product_id"))).cast("float").alias("w"))
    got = items.select("session", "product_id", "h_rank").join(m, "product_id")
    part = F.lit(1.0) / (1 + F.col("h_rank")) * F.col("w")  # in the order of covis_scores and the SQL: w / (1 + h_rank) can be another double
    sums = []
    for k in S.KINDS:
        own = F.col("kind") == k
        sums += [F.sum(F.when(own, part)).alias(f"c_{k}_all"), F.sum(F.when(own & (F.col("h_rank") == 0), part)).alias(f"c_{k}_last")]
    scores = got.groupBy("session", F.col("neighbour").alias("product_id")).agg(*sums).fillna(0.0, list(S.SCORES))
    scores = scores.withColumn("c_sum", F.col("c_time_all") + F.col("c_type_all") + F.col("c_buy2buy_all"))
    w = Window.partitionBy("session").orderBy(F.desc(F.round("c_sum", 9)), "product_id")
    fresh = scores.join(last.select("session", "last_product"), "session").where("product_id <> last_product")
    top = fresh.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= S.N_COVIS).select("session", "product_id")
    own = items.join(last.select("session", "last_product"), "session").where("product_id <> last_product").select("session", "product_id")
    return top.union(own).distinct().join(scores, ["session", "product_id"], "left").fillna(0.0, [*S.SCORES, "c_sum"])


def price_ratio(price, last):
    """price / last with the limits of division by zero, so that the engine's ANSI mode does not fail; a zero's sign counts, as in the SQL."""
    return F.when(last == 0, price * F.when(last.cast("string").startswith("-"), float("-inf")).otherwise(float("inf"))).otherwise(price / last)


def build(history: DataFrame, cases: DataFrame, matrix: DataFrame, products: DataFrame) -> DataFrame:
    """(session, product_id, label, 24 features); a missing feature is null."""
    items = history_items(history)
    cands = candidates(items, matrix, cases)
    session = history.groupBy("session").agg(
        F.count("*").alias("s_events"), F.count_distinct("product_id").alias("s_products"), F.min("event_time").alias("s_start"),
        F.max_by(F.struct(F.col("price").alias("l_price"), F.col("category_id").alias("l_category"), F.col("brand").alias("l_brand"), F.col("event_type").alias("l_type")), "pos").alias("l"),
    ).select("session", "s_events", "s_products", "s_start", "l.*")
    seconds = lambda a, b: F.unix_seconds(a) - F.unix_seconds(b)
    ratio = price_ratio(F.col("p_price"), F.col("l_price"))
    df = cands.join(items.drop("h_pos"), ["session", "product_id"], "left").join(products, "product_id", "left").join(cases, "session").join(session, "session")
    df = df.select(
        "session", "product_id", (F.col("product_id") == F.col("target")).cast("int").alias("label"), *S.SCORES, "c_sum", F.col("h_events").isNotNull().cast("int").alias("in_history"), "h_events", "h_rank",
        seconds(F.col("cut_time"), F.col("h_last")).alias("h_seconds"), "h_max_type", "p_events_1d", "p_events_7d", "p_carts_7d", "p_purchases_7d", "p_price", ratio.cast("float").alias("price_ratio"),
        (F.col("p_category") == F.col("l_category")).cast("int").alias("same_category"), (F.col("p_brand") == F.col("l_brand")).cast("int").alias("same_brand"), "s_events", "s_products",
        seconds(F.col("cut_time"), F.col("s_start")).alias("s_seconds"), "l_type",
    )
    return df.select("session", "product_id", "label", *S.FEATURES)


def train_sample(rows: DataFrame, negatives: int = S.NEGATIVES, seed: int = 0) -> DataFrame:
    """Sessions with a positive: all positives, and the rows among the first so many of a seeded order."""
    from basketflow.operators.split import order_hash

    keep = rows.where("label = 1").select("session").distinct()
    r = F.row_number().over(Window.partitionBy("session").orderBy(order_hash(seed, F.col("session"), F.col("product_id")), "product_id"))
    return rows.join(keep, "session", "left_semi").withColumn("r", r).where((F.col("label") == 1) | (F.col("r") <= negatives)).drop("r")
