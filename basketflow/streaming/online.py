"""The serving path: exported tables, features worked out session by session, lists that are always full.

The features come from each session's own events and the neighbours of its products alone, in
numpy, as a request would have them, for a batch of whole sessions at once; batch features come from joins over all sessions. parity()
holds one to the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from basketflow import schemas as S
from basketflow.operators import features

_ITEM = ("h_events", "h_rank", "h_seconds", "h_max_type")
_SESSION = ("s_events", "s_products", "s_seconds", "l_type")
_LAST = ("l_price", "l_category", "l_brand")


def export(matrix: DataFrame, stats: DataFrame, popular: DataFrame) -> dict[str, DataFrame]:
    """Serving tables: neighbours (arrays by product, best first), stats (with brand codes), brands, popular."""
    w = (F.col("weight") / F.max("weight").over(Window.partitionBy("kind", "product_id"))).cast("float")
    one = matrix.select("kind", "product_id", F.struct("rank", "neighbour", w.alias("w")).alias("x"))
    arrays = one.groupBy("product_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("x")))).alias(k) for k in S.KINDS))
    field = lambda k, f: F.transform(k, lambda x: x[f]).alias(f"{k}_{'n' if f == 'neighbour' else f}")
    neighbours = arrays.select("product_id", *(field(k, f) for k in S.KINDS for f in ("neighbour", "w")))
    names = stats.where(F.col("p_brand").isNotNull()).select(F.col("p_brand").alias("brand")).distinct()
    brands = names.withColumn("code", F.row_number().over(Window.orderBy("brand")) - 1)  # a row a brand
    coded = stats.join(brands.select(F.col("brand").alias("p_brand"), "code"), "p_brand", "left")
    known = F.col("p_price").isNotNull() | F.col("p_events_7d").isNotNull()
    table = coded.select("product_id", known.alias("known"), "p_events_1d", "p_events_7d", "p_carts_7d", "p_purchases_7d", "p_price", "p_category", "p_brand", F.coalesce("code", F.lit(-1)).alias("brand_code"))
    first = popular.orderBy(F.desc("pop"), "product_id").limit(S.TOP_POPULAR)
    return {"neighbours": neighbours, "stats": table, "brands": brands, "popular": first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pop"), "product_id")))}  # 200 rows


def _first(keys: np.ndarray) -> np.ndarray:
    """Where another key begins in sorted keys."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _places(keys: np.ndarray) -> np.ndarray:
    """The place, from 0, of each row among those with its key; keys are sorted."""
    at = _first(keys)
    return np.arange(len(keys)) - np.repeat(at, np.diff(np.r_[at, len(keys)]))


def _nine(x: np.ndarray) -> np.ndarray:
    """Nine digits as an integer, halves up: numpy's own rounding takes halves to the even digit."""
    y = x * 1e9
    return np.floor(y) + (y - np.floor(y) >= 0.5)


def _sessions(events: pa.Table, types: pa.Schema) -> pa.RecordBatch:
    """The candidates of whole sessions with all features that need no product statistics; events in order of session and pos, with time and their products' neighbours.

    A product that is null takes a place in the history, as it does in the batch, and is no candidate.
    """
    floats = lambda c: events[c].cast(pa.float64()).fill_null(np.nan).to_numpy()
    session = events["session"].to_numpy()
    at = _first(session)
    s, ends = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(session)])), np.r_[at[1:], len(session)] - 1
    known, product, time, kind = ~events["product_id"].is_null().to_numpy(), events["product_id"].fill_null(0).to_numpy(), floats("time"), floats("event_type")
    # items: one for each session and product, the latest first
    by = np.lexsort((np.arange(len(s)), product, known, s))
    heads = np.flatnonzero(np.r_[True, (s[by][1:] != s[by][:-1]) | (known[by][1:] != known[by][:-1]) | (product[by][1:] != product[by][:-1])])
    tails = np.r_[heads[1:], len(by)] - 1
    row, count = by[tails], np.diff(np.r_[heads, len(by)])
    last_time, most = (np.fmax.reduceat(v[by], heads) for v in (time, kind))
    order = np.lexsort((-row, s[row]))
    row, count, last_time, most = (v[order] for v in (row, count, last_time, most))
    rank = _places(s[row])
    # the neighbours of the items, kind after kind
    found = []
    for i, k in enumerate(S.KINDS):
        lists, weights = (events[f"{k}_{x}"].take(pa.array(row)).combine_chunks() for x in ("n", "w"))
        n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        item = np.repeat(np.arange(len(row)), n)
        found.append((np.full(len(item), i), item, lists.flatten().to_numpy(zero_copy_only=False), weights.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)))
    which, item, near, w = (np.concatenate(x) for x in zip(*found, strict=True))
    part = 1.0 / (1 + rank[item]) * w
    names, code = np.unique(np.concatenate([near.astype(np.int64), product[row], product[ends]]), return_inverse=True)
    near, own, last = np.split(code, [len(near), len(near) + len(row)])
    pool, of = np.unique(s[row][item] * len(names) + near, return_inverse=True)
    sums = {}
    for i, k in enumerate(S.KINDS):
        for name, mine in ((f"c_{k}_all", which == i), (f"c_{k}_last", (which == i) & (rank[item] == 0))):
            sums[name] = np.bincount(of[mine], part[mine], len(pool))
    sums["c_sum"] = sums["c_time_all"] + sums["c_type_all"] + sums["c_buy2buy_all"]
    # the best 40 and the session's own, without the last product
    ps, pp = pool // len(names), pool % len(names)
    other = lambda ses, pro: known[ends][ses] & (pro != last[ses])
    fresh = np.flatnonzero(other(ps, pp))
    fresh = fresh[np.lexsort((pp[fresh], -_nine(sums["c_sum"][fresh]), ps[fresh]))]
    best = fresh[_places(ps[fresh]) < S.N_COVIS]
    mine = np.flatnonzero(known[row] & other(s[row], own))
    keys = s[row][mine] * len(names) + own[mine]
    chosen = np.unique(np.concatenate([pool[best], keys]))
    sorted_keys = np.argsort(keys)

    def places(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chosen rows are in sorted keys, and whether they are."""
        i = np.minimum(np.searchsorted(where, chosen), max(len(where) - 1, 0))
        return i, where[i] == chosen if len(where) else np.zeros(len(chosen), bool)

    cs = chosen // len(names)
    i, there = places(pool)
    out = {c: np.where(there, v[i], 0.0) if len(pool) else np.zeros(len(chosen)) for c, v in sums.items()}
    j, seen = places(keys[sorted_keys])
    j = mine[sorted_keys[j]] if len(keys) else np.zeros(len(chosen), np.int64)
    whole = lambda v, ok: pa.array(np.where(ok & ~np.isnan(v), v, 0).astype(np.int64), mask=~ok | np.isnan(v))
    seconds = time[ends][s[row]] - last_time
    for c, v in zip(_ITEM, (count, rank, seconds, most), strict=True):
        out[c] = whole(v[j].astype(float), seen)
    out["in_history"] = seen.astype(np.int32)
    products = np.bincount(s[row][known[row]], minlength=len(at))
    lasting = time[ends] - np.fmin.reduceat(time, at) if len(at) else time
    for c, v in zip(_SESSION, (ends - at + 1, products, lasting, kind[ends]), strict=True):
        out[c] = whole(v[cs].astype(float), np.ones(len(cs), bool))
    end = pa.array(ends[cs])
    out |= {"session": events["session"].take(end), "product_id": names[chosen % len(names)] if len(names) else chosen}
    out |= {f"l_{c}": events[x].take(end) for c, x in (("price", "price"), ("category", "category_id"), ("brand", "brand"))}
    made = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v if isinstance(v, pa.Array) else pa.array(v) for v in (out[f.name] for f in types)]
    return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(made, types, strict=True)], schema=types)


def online_features(history: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(session, product_id, 24 features) from histories (session, pos, event columns) and exported tables."""
    events = history.where(F.col("session").isNotNull()).select("session", "pos", F.unix_seconds("event_time").alias("time"), "event_type", F.col("product_id").cast("long").alias("product_id"), "category_id", "brand", "price")
    given = events.schema
    events = events.join(tables["neighbours"], "product_id", "left").repartition("session").sortWithinPartitions("session", "pos")
    fields = [("session", given["session"].dataType), ("product_id", T.LongType()), *((c, T.DoubleType()) for c in (*S.SCORES, "c_sum")), *((c, T.LongType()) for c in _ITEM), ("in_history", T.IntegerType()), *((c, T.LongType()) for c in _SESSION)]
    fields += [(c, given[x].dataType) for c, x in zip(_LAST, ("price", "category_id", "brand"), strict=True)]
    schema = T.StructType([T.StructField(c, t) for c, t in fields])
    types = to_arrow_schema(schema)

    def run(batches):
        """Whole sessions: what may go on in the next batch waits for it."""
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("session").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut or (held and held[-1].column("session")[-1].as_py() != ids[0]):
                yield _sessions(pa.Table.from_batches([*held, batch.slice(0, cut)]), types)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _sessions(pa.Table.from_batches(held), types)

    rows = events.mapInArrow(run, schema).join(tables["stats"], "product_id", "left")
    same = lambda a, b: (F.col(a) == F.col(b)).cast("int")
    more = {"price_ratio": features.price_ratio(F.col("p_price"), F.col("l_price")).cast("float"), "same_category": same("p_category", "l_category"), "same_brand": same("p_brand", "l_brand")}
    return rows.withColumns(more).select("session", "product_id", *S.FEATURES)


def recommend(scores: DataFrame, last: DataFrame, popular: DataFrame, k: int = S.K) -> DataFrame:
    """(session, items, scores): the k best of each session, then the most popular (TOP_POPULAR at most) that are not there, with score 0.

    last: (session, last_product) of all sessions; the last product is in no list, and one without candidates gets popular ones.
    """
    w = Window.partitionBy("session").orderBy(F.desc("score"), "product_id")
    best = scores.join(last, "session").where("product_id <> last_product").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    own = best.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rk", "product_id", "score"))).alias("own"))
    first = popular.orderBy(F.desc("pop"), "product_id").limit(S.TOP_POPULAR)
    filler = first.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pop")).alias("p"), "product_id"))), lambda x: x["product_id"]).alias("filler"))
    got = last.join(own, "session", "left").crossJoin(F.broadcast(filler))  # one row
    items = F.coalesce(F.transform("own", lambda x: x["product_id"]), F.expr("cast(array() as array<bigint>)"))
    got = got.withColumn("ranked", items).withColumn("marks", F.coalesce(F.transform("own", lambda x: x["score"]), F.expr("cast(array() as array<double>)")))
    more = F.slice(F.filter("filler", lambda p: (p != F.col("last_product")) & ~F.array_contains("ranked", p)), F.lit(1), F.greatest(k - F.size("ranked"), F.lit(0)))
    return got.withColumn("more", more).select("session", F.concat("ranked", "more").alias("items"), F.concat("marks", F.transform("more", lambda x: F.lit(0.0))).alias("scores"))


def parity(batch: DataFrame, online: DataFrame, score: str = "c_sum", k: int = S.K) -> DataFrame:
    """One row: sessions, those whose candidates differ, rows, missing values on one side, largest relative difference, equal top lists."""
    a, b = (df.select("session", "product_id", F.lit(1).alias(f"there_{x}"), *(F.col(c).cast("double").alias(f"{c}_{x}") for c in S.FEATURES)) for df, x in ((batch, "a"), (online, "b")))
    j = a.join(b, ["session", "product_id"], "full")
    both = F.col("there_a").isNotNull() & F.col("there_b").isNotNull()
    gone = lambda c, x: F.col(f"{c}_{x}").isNull() | F.isnan(f"{c}_{x}")
    diff = lambda c: F.when(both & ~gone(c, "a") & ~gone(c, "b"), F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), 0.0).otherwise(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) / F.greatest(F.lit(1.0), F.abs(f"{c}_a"))))
    missing = sum(((gone(c, "a") != gone(c, "b")) & both).cast("int") for c in S.FEATURES)
    w = lambda x: Window.partitionBy("session").orderBy(F.round(f"{score}_{x}", 9).desc_nulls_last(), "product_id")
    j = j.withColumns({"missing": missing, "diff": F.greatest(*(F.coalesce(diff(c), F.lit(0.0)) for c in S.FEATURES)), "ra": F.row_number().over(w("a")), "rb": F.row_number().over(w("b"))})
    top = lambda x: (F.col(f"r{x}") <= k) & F.col(f"there_{x}").isNotNull()
    per = j.groupBy("session").agg(
        F.max((~both).cast("int")).alias("differ"), F.count_if(both).alias("rows"), F.sum("missing").alias("missing"), F.max("diff").alias("diff"),
        F.max((top("a").cast("int") != top("b").cast("int")) | (top("a") & (F.col("ra") != F.col("rb")))).cast("int").alias("moved"),
    )
    return per.agg(
        F.count("*").alias("sessions"), F.sum("differ").alias("candidate_set_mismatches"), F.sum("rows").alias("feature_rows"), F.sum("missing").alias("missing_value_mismatches"),
        F.round(F.max("diff"), 5).alias("max_relative_feature_diff"), F.count_if(F.col("moved") == 0).alias("identical_top_lists"),
    )
