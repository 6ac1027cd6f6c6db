"""Fixed values of the engine: constants, declared schemas and the feature contract."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

KINDS = ("time", "type", "buy2buy")
TOP, PER_SESSION, DAY = 20, 30, 86_400
TYPE_WEIGHTS = {0: 1, 1: 6, 2: 3}
GAP, BUY_GAP = DAY, 14 * DAY
N_COVIS, K, FILLER, TOP_POPULAR = 40, 20, 64, 200
NEGATIVES, CAP = 30, 200
SALT = "ranker-vs-item2item"
SHARES = (1.0, 0.5, 0.2, 0.1, 0.05)
WINDOWS = {"A": ("2024-01-01", "2024-01-17"), "B": ("2024-01-17", "2024-01-24"), "C": ("2024-01-24", "2024-02-01")}
SCORES = tuple(f"c_{k}_{t}" for k in KINDS for t in ("all", "last"))
FEATURES = (
    *SCORES, "c_sum", "in_history", "h_events", "h_rank", "h_seconds", "h_max_type", "p_events_1d", "p_events_7d", "p_carts_7d", "p_purchases_7d", "p_price",
    "price_ratio", "same_category", "same_brand", "s_events", "s_products", "s_seconds", "l_type",
)
RAW_CSV = T.StructType([
    T.StructField("event_time", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("product_id", T.IntegerType()), T.StructField("category_id", T.LongType()),
    T.StructField("category_code", T.StringType()), T.StructField("brand", T.StringType()), T.StructField("price", T.FloatType()), T.StructField("user_id", T.IntegerType()), T.StructField("user_session", T.StringType()),
])


def window(name: str) -> tuple[datetime, datetime]:
    a, b = WINDOWS[name]
    return datetime.fromisoformat(a), datetime.fromisoformat(b)
