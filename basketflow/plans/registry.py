"""All named queries of the engine, with the SQL that checks them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketflow import schemas as S
from basketflow.functions import bootstrap, interleave, replay
from basketflow.functions import experiment as E
from basketflow.operators import candidates as C
from basketflow.operators import covisit, drift, features, nightly, ranker, split
from basketflow.plans.oracle import CDF, DRAFT, metrics, product_stats, refresh, sql
from basketflow.sources import adapters as A
from basketflow.sources import topics, versions
from basketflow.sources.shared import shared
from basketflow.streaming import online
from basketflow.streaming import sessions as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
B, C_ = S.window("B")[0], S.window("C")[0]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = sql(oracle)
        return f

    return add


def _tmp(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def _once(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, for queries that read it several times."""
    at = _tmp(df.sparkSession, "once")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


# -- shared intermediate frames


def _matrix_b(s, d):
    return covisit.build(A.e_day(s, d).where(F.col("event_time") < F.lit(B)))


def _matrix_c(s, d):
    return covisit.build(A.e_day(s, d).where(F.col("event_time") < F.lit(C_)))


def _cases(s, d, name="B"):
    return split.cases(A.e_day(s, d), name)


def _popular_b(s, d):
    return C.popular(split.stats_events(A.e_day(s, d), "B"), B)


def _run(s, d, name):
    history, cases = _cases(s, d)
    return C.top_k(C.baseline_scores(name, history, _matrix_b(s, d)), cases, _popular_b(s, d)), cases


def _features(s, d):
    history, cases = _cases(s, d)
    return features.build(history, cases, _matrix_b(s, d), features.product_stats(split.stats_events(A.e_day(s, d), "B"), B))


def _line(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _r(df, *columns, n=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, n))
    return df


# -- sources, scans, sinks


@query("""SELECT event_time, CASE event_type WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS event_type, product_id::INT AS product_id, category_id::BIGINT AS category_id, NULL::VARCHAR AS category_code, brand, round(price::FLOAT, 3) AS price, user_id::INT AS user_id, session::VARCHAR AS user_session
  FROM (SELECT * REPLACE (date_trunc('second', event_time) AS event_time) FROM day_ev)""")
def src_csv_typed(s, d):
    """Writes events as gzipped raw CSV and reads them typed."""
    at = _tmp(s, "csv")
    name = F.when(F.col("event_type") == 0, "view").when(F.col("event_type") == 1, "cart").otherwise("purchase")
    rows = A.e_day(s, d).select(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("event_time"), name.alias("event_type"), "product_id", "category_id", F.lit(None).cast("string").alias("category_code"), "brand", "price", "user_id", F.col("session").cast("string").alias("user_session"))
    rows.write.option("header", True).option("compression", "gzip").csv(at)
    return A.csv_typed(s, at, partitions=s.sparkContext.defaultParallelism).withColumn("price", F.round("price", 3))


@query("""SELECT seq, dense_rank() OVER (ORDER BY f, session) - 1 AS session FROM (SELECT *, min(event_time) OVER (PARTITION BY session) AS f FROM day_ev)""")
def ingest_sessions(s, d):
    return A.with_sessions(A.e_day(s, d).withColumn("user_session", F.col("session")).drop("session")).select("seq", "session")


@query("SELECT session, seq, product_id FROM day_ev WHERE session IS NOT NULL")
def scan_events(s, d):
    return A.e_day(s, d).where(F.col("session").isNotNull()).select("session", "seq", "product_id")


@query("SELECT session, seq, product_id FROM day_ev")
def sink_parquet(s, d):
    at = _tmp(s, "parquet")
    A.e_day(s, d).write.option("compression", "zstd").parquet(at)
    return s.read.parquet(at).select("session", "seq", "product_id")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events")
def src_with_seq(s, d):
    """Dense positions: each day is numbered in its own task and offset by the days before."""
    rows = A.read(s, d, "events").select("event_id", "ts", F.col("ts").cast("date").alias("day"))
    sizes = rows.groupBy("day").agg(F.count("*").alias("n"))
    before = sizes.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))
    seq = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")) - 1 + F.col("before")
    return rows.join(F.broadcast(before), "day").select("event_id", seq.alias("seq"))


@query("SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS version, count(*) AS n FROM day_ev GROUP BY 1")
def wh_load(s, d):
    at = _tmp(s, "load")
    rows = A.e_day(s, d).withColumn("version", F.col("event_time").cast("date"))
    rows.repartition("version").sortWithinPartitions("version", "product_id").write.mode("overwrite").partitionBy("version").parquet(at)
    return s.read.parquet(at).groupBy(F.col("version").cast("string").alias("version")).agg(F.count("*").alias("n"))


@query("SELECT '2024-01-23' AS version, kind, count(*) AS n FROM night_m GROUP BY kind UNION ALL SELECT '2024-01-16', kind, count(*) FROM day_m GROUP BY kind")
def wh_build_partition(s, d):
    """Writes two nights, then one of them again: only its partition is replaced."""
    at = _tmp(s, "nights")
    night = lambda m, v: m.withColumn("version", F.lit(v).cast("date"))
    versions.write_night(night(_matrix_b(s, d), "2024-01-16"), at)
    versions.write_night(night(_matrix_b(s, d), "2024-01-23"), at)
    versions.write_night(night(_matrix_c(s, d), "2024-01-23"), at)
    return s.read.parquet(at).groupBy(F.col("version").cast("string").alias("version"), "kind").agg(F.count("*").alias("n"))


@query("SELECT kind, product_id, neighbour, weight, rank FROM night_m")
def wh_read_night(s, d):
    at = _tmp(s, "night")
    versions.write_night(_matrix_c(s, d).withColumn("version", F.lit("2024-01-23").cast("date")), at)
    return versions.read_night(s, at, "2024-01-23", {"weight": "float"})


_BRANDS = "(SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS code FROM (SELECT DISTINCT p_brand AS brand FROM stats_b WHERE p_brand IS NOT NULL))"


def _tables(s, d):
    return online.export(_matrix_b(s, d), features.product_stats(split.stats_events(A.e_day(s, d), "B"), B), _popular_b(s, d))


@query(f"""SELECT product_id, n.time AS time_neighbours, n.type AS type_neighbours, n.buy2buy AS buy2buy_neighbours, p_events_1d, p_events_7d, p_carts_7d, p_purchases_7d, round(p_price, 3) AS p_price, coalesce(b.code, -1) AS brand_code, q.place
  FROM (SELECT product_id, {', '.join(f"coalesce(string_agg(neighbour, ',' ORDER BY rank) FILTER (WHERE kind = '{k}'), '') AS {k}" for k in S.KINDS)} FROM day_m GROUP BY product_id) n FULL JOIN stats_b USING (product_id)
  LEFT JOIN {_BRANDS} b ON b.brand = p_brand LEFT JOIN (SELECT product_id, row_number() OVER (ORDER BY pop DESC, product_id) AS place FROM pop_b QUALIFY place <= 200) q USING (product_id)""")
def artifacts_export(s, d):
    """The serving tables, written and read back: neighbour arrays, statistics with brand codes, popular places."""
    tables = {k: _once(v) for k, v in _tables(s, d).items()}
    n = tables["neighbours"].select("product_id", *(_line(f"{k}_n").alias(f"{k}_neighbours") for k in S.KINDS))
    stats = tables["stats"].select("product_id", "p_events_1d", "p_events_7d", "p_carts_7d", "p_purchases_7d", F.round("p_price", 3).alias("p_price"), F.col("brand_code").cast("long").alias("brand_code"))
    return n.join(stats, "product_id", "full").join(tables["popular"].select("product_id", "place"), "product_id", "left").withColumn("brand_code", F.coalesce("brand_code", F.lit(-1)))


@query(f"""SELECT 'brands' AS "table", count(*) AS n FROM {_BRANDS} UNION ALL SELECT 'neighbours', count(DISTINCT product_id) FROM day_m UNION ALL SELECT 'popular', least(200, count(*)) FROM pop_b UNION ALL SELECT 'stats', count(*) FROM stats_b""")
def artifacts_load(s, d):
    """Builds a version of all serving tables, publishes it and reads them by the pointer."""
    v = versions.Versions(s, _tmp(s, "versions"))
    tables = _tables(s, d)
    v.publish(v.build("2024-01-16", tables, {"day": "2024-01-16"}))
    parts = [v.table(k).agg(F.lit(k).alias("table"), F.count("*").alias("n")) for k in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT session, seq, product_id FROM day_ev WHERE event_time >= TIMESTAMP '2024-01-20' AND event_time < TIMESTAMP '2024-01-22' AND session IN (SELECT session FROM day_ev GROUP BY session HAVING count(*) >= 3)")
def src_recorded(s, d):
    ev = A.e_day(s, d)
    return A.recorded(ev, "2024-01-20", "2024-01-22", ev.groupBy("session").count().where("count >= 3").select("session")).select("session", "seq", "product_id")


# -- projection, filter


@query("SELECT seq, session FROM day_ev WHERE event_time >= TIMESTAMP '2024-01-17' AND event_time < TIMESTAMP '2024-01-24'")
def filter_time_range(s, d):
    return split.between(A.e_day(s, d), *S.window("B")).select("seq", "session")


@query("SELECT seq, session FROM day_ev WHERE event_time < TIMESTAMP '2024-01-17'")
def stats_events(s, d):
    return split.stats_events(A.e_day(s, d), "B").select("seq", "session")


@query("SELECT seq, epoch_us(event_time) // 1000000 AS ts FROM day_ev")
def project_epoch(s, d):
    return A.e_day(s, d).select("seq", F.unix_seconds("event_time").alias("ts"))


@query("SELECT event_type, count(*) AS n, TRUE AS refuses_unknown FROM day_ev GROUP BY event_type")
def recode_strict(s, d):
    """Codes by a strict table; a table that lacks a value that occurs is refused."""
    names = A.read(s, d, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    try:
        names.select(A.recode_strict(F.col("event_type"), {"view": 0, "click": 1}).alias("c")).agg(F.max("c")).collect()
        refuses = False
    except Exception as e:  # noqa: BLE001  the engine's error for raise_error
        refuses = "unknown value" in str(e)
    return names.groupBy(A.recode_strict(F.col("event_type"), {"view": 0, "click": 1, "purchase": 2}).alias("event_type")).agg(F.count("*").alias("n")).withColumn("refuses_unknown", F.lit(refuses))


@query("SELECT session, product_id, round(c_time_all, 6) AS c_time_all, round(c_type_last, 6) AS c_type_last FROM feat_b")
def regex_columns_fill(s, d):
    return _r(_features(s, d).select("session", "product_id", "c_time_all", "c_type_last"), "c_time_all", "c_type_last")


@query("SELECT product_id, count(*) FILTER (WHERE event_type = 1) AS carts, max(CASE WHEN event_type = 2 THEN seq END) AS last_purchase FROM day_ev GROUP BY product_id")
def conditional_count(s, d):
    return A.e_day(s, d).groupBy("product_id").agg(F.count_if(F.col("event_type") == 1).alias("carts"), F.max(F.when(F.col("event_type") == 2, F.col("seq"))).alias("last_purchase"))


@query("SELECT seq FROM day_ev WHERE session IN (SELECT session FROM cb_sess)")
def filter_in_list(s, d):
    return A.e_day(s, d).join(_cases(s, d)[1].select("session"), "session", "left_semi").select("seq")


@query("SELECT * EXCLUDE (brand, price, event_time) FROM day_ev")
def exclude_columns(s, d):
    return A.e_day(s, d).drop("brand", "price", "event_time")


# -- joins


@query("SELECT i.session, i.product_id, m.neighbour FROM cb_items i JOIN day_m m USING (product_id) WHERE kind = 'buy2buy'")
def join_inner(s, d):
    items = C.history_items(_cases(s, d)[0])
    return items.join(_matrix_b(s, d).where("kind = 'buy2buy'"), "product_id").select("session", "product_id", "neighbour")


@query("SELECT a.session, a.product_id, b.product_id AS neighbour, count(*) AS n FROM long_prep a JOIN long_prep b ON a.session = b.session AND a.product_id <> b.product_id AND abs(a.ts - b.ts) < 86400 GROUP BY ALL")
def join_self_band(s, d):
    a = covisit.prepare(A.e_long(s, d))
    b = a.select(F.col("session").alias("sb"), F.col("product_id").alias("neighbour"), F.col("ts").alias("tsb"))
    near = (F.col("session") == F.col("sb")) & (F.col("product_id") != F.col("neighbour")) & (F.abs(F.col("ts") - F.col("tsb")) < S.GAP)
    return a.join(b, near).groupBy("session", "product_id", "neighbour").agg(F.count("*").alias("n"))


@query("SELECT c.session, c.product_id, s.p_events_7d FROM cb_items c LEFT JOIN stats_b s USING (product_id)")
def join_left(s, d):
    stats = features.product_stats(split.stats_events(A.e_day(s, d), "B"), B)
    return C.history_items(_cases(s, d)[0]).join(stats, "product_id", "left").select("session", "product_id", "p_events_7d")


@query("SELECT product_id, neighbour, a.weight AS wa, b.weight AS wb FROM (SELECT * FROM day_m WHERE kind = 'type') a FULL JOIN (SELECT * FROM day_m WHERE kind = 'buy2buy') b USING (product_id, neighbour)")
def join_full_coalesce(s, d):
    m = _matrix_b(s, d)
    one = lambda k, c: m.where(F.col("kind") == k).select("product_id", "neighbour", F.col("weight").alias(c))
    return one("type", "wa").join(one("buy2buy", "wb"), ["product_id", "neighbour"], "full")


@query("SELECT seq FROM day_ev SEMI JOIN cc_sess USING (session)")
def join_semi(s, d):
    return A.e_day(s, d).join(_cases(s, d, "C")[1].select("session"), "session", "left_semi").select("seq")


@query("SELECT product_id, kind, ts - t0 AS age FROM (SELECT product_id, max(ts) AS ts FROM long_prep GROUP BY 1), (SELECT min(ts) AS t0 FROM long_prep), (SELECT unnest(['time', 'type', 'buy2buy']) AS kind)")
def join_cross(s, d):
    p = covisit.prepare(A.e_long(s, d))
    rows = p.groupBy("product_id").agg(F.max("ts").alias("ts")).crossJoin(F.broadcast(p.agg(F.min("ts").alias("t0"))))  # one row
    return rows.select("product_id", F.explode(F.array(*map(F.lit, S.KINDS))).alias("kind"), (F.col("ts") - F.col("t0")).alias("age"))


# -- aggregation


@query("SELECT session, product_id, event_type, count(*) AS n, min(seq) AS lo, max(seq) AS hi, round(sum(price), 4) AS total FROM day_ev GROUP BY ALL")
def agg_hash(s, d):
    return A.e_day(s, d).groupBy("session", "product_id", "event_type").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.round(F.sum("price"), 4).alias("total"))


@query("SELECT product_id, sum(m)::BIGINT AS total, count(*) AS n FROM (SELECT session, product_id, max(event_type) AS m FROM cust_ev GROUP BY ALL) GROUP BY product_id")
def agg_two_level(s, d):
    per = A.o_cust(s, d).groupBy("session", "product_id").agg(F.max("event_type").alias("m"))
    return per.groupBy("product_id").agg(F.sum("m").alias("total"), F.count("*").alias("n"))


@query("SELECT user_id, count(DISTINCT product_id) AS products, count(DISTINCT brand) AS brands FROM day_ev GROUP BY user_id")
def agg_count_distinct(s, d):
    return A.e_day(s, d).groupBy("user_id").agg(F.count_distinct("product_id").alias("products"), F.count_distinct("brand").alias("brands"))


@query("SELECT product_id, brand, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY event_time DESC, seq DESC) AS rn FROM day_ev) WHERE rn = 1")
def agg_last_by_order(s, d):
    return A.e_day(s, d).groupBy("product_id").agg(F.max_by(F.struct("brand", "price"), F.struct("event_time", "seq")).alias("l")).select("product_id", "l.*")


@query("SELECT median(n)::DOUBLE AS median FROM (SELECT count(*) AS n FROM day_ev GROUP BY session)")
def agg_median(s, d):
    return A.e_day(s, d).groupBy("session").agg(F.count("*").alias("n")).agg(F.median("n").alias("median"))


@query("SELECT quantile_disc(n, 0.99)::DOUBLE AS p99 FROM (SELECT count(*) AS n FROM long_ev GROUP BY session)")
def agg_quantile(s, d):
    return A.e_long(s, d).groupBy("session").agg(F.count("*").alias("n")).agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY n)").cast("double").alias("p99"))


@query("SELECT session, string_agg(product_id, ',' ORDER BY seq) AS products FROM day_ev GROUP BY session")
def agg_collect(s, d):
    rows = A.e_day(s, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "product_id"))).alias("x"))
    return rows.select("session", _line(F.transform("x", lambda v: v["product_id"])).alias("products"))


@query("SELECT min(ts) AS t0, max(ts) AS t1 FROM long_prep")
def agg_global_bounds(s, d):
    return covisit.prepare(A.e_long(s, d)).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))


@query()
def agg_fingerprint(s, d):
    return nightly.fingerprint(_matrix_b(s, d))


# -- windows


@query("SELECT seq, session, row_number() OVER (PARTITION BY session ORDER BY event_time, seq) - 1 AS pos FROM day_ev")
def win_row_number(s, d):
    return A.e_day(s, d).select("seq", "session", (F.row_number().over(Window.partitionBy("session").orderBy("event_time", "seq")) - 1).alias("pos"))


@query("SELECT session, product_id, h_rank FROM cb_items")
def win_rank_ordinal(s, d):
    return C.history_items(_cases(s, d)[0]).select("session", "product_id", "h_rank")


@query("SELECT seq, coalesce(product_id <> lag(product_id) OVER (PARTITION BY session ORDER BY event_time, seq), TRUE) AS head FROM day_ev")
def win_shift(s, d):
    w = Window.partitionBy("session").orderBy("event_time", "seq")
    return A.e_day(s, d).select("seq", F.coalesce(F.col("product_id") != F.lag("product_id").over(w), F.lit(True)).alias("head"))


@query("SELECT seq, run FROM cb_own")
def win_cum_sum(s, d):
    ev = A.e_day(s, d).join(_cases(s, d)[1].select("session"), "session", "left_semi")
    return split.runs(ev).select("seq", "run")


@query("SELECT kind, product_id, neighbour, round((weight::DOUBLE / max(weight) OVER (PARTITION BY kind, product_id))::FLOAT, 5) AS w FROM day_m")
def win_max_partition(s, d):
    w = (F.col("weight") / F.max("weight").over(Window.partitionBy("kind", "product_id"))).cast("float")
    return _matrix_b(s, d).select("kind", "product_id", "neighbour", F.round(w, 5).alias("w"))


@query("SELECT seq, row_number() OVER (PARTITION BY session ORDER BY sha256('0:' || session || ':' || seq), seq) AS place FROM day_ev")
def win_seeded_order(s, d):
    w = Window.partitionBy("session").orderBy(split.order_hash(0, F.col("session"), F.col("seq")), "seq")
    return A.e_day(s, d).select("seq", F.row_number().over(w).alias("place"))


@query("SELECT session, seq FROM day_ev QUALIFY row_number() OVER (PARTITION BY session ORDER BY event_time DESC, seq DESC) <= 2")
def qualify(s, d):
    A.e_day(s, d).createOrReplaceTempView("basketflow_day")
    return s.sql("SELECT session, seq FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_time DESC, seq DESC) AS rn FROM basketflow_day) WHERE rn <= 2")


# -- sort, limit, top-k


@query("SELECT kind, product_id, neighbour, rank FROM cust_m")
def topk_per_group(s, d):
    return covisit.build(A.o_cust(s, d)).select("kind", "product_id", "neighbour", "rank")


@query("SELECT session, first(product_id ORDER BY event_time, seq) AS first_product FROM day_ev GROUP BY session")
def first_per_group(s, d):
    return A.e_day(s, d).groupBy("session").agg(F.min_by("product_id", F.struct("event_time", "seq")).alias("first_product"))


@query("SELECT session, last(product_id ORDER BY event_time, seq) AS last_product FROM day_ev GROUP BY session")
def last_per_group(s, d):
    return A.e_day(s, d).groupBy("session").agg(F.max_by("product_id", F.struct("event_time", "seq")).alias("last_product"))


@query("SELECT product_id, pop, row_number() OVER (ORDER BY pop DESC, product_id) AS place FROM (SELECT * FROM pop_b ORDER BY pop DESC, product_id LIMIT 50)")
def sort_multi_dir(s, d):
    top = _popular_b(s, d).orderBy(F.col("pop").desc_nulls_last(), F.col("product_id").asc_nulls_last()).limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pop"), "product_id")))  # 50 rows


@query("SELECT session FROM (SELECT session FROM cb_sess ORDER BY session LIMIT 25)")
def limit_head(s, d):
    return _cases(s, d)[1].select("session").orderBy("session").limit(25)


@query("SELECT session FROM (SELECT session FROM cb_sess ORDER BY session DESC LIMIT 25)")
def tail(s, d):
    return _cases(s, d)[1].select("session").orderBy(F.desc("session")).limit(25)


@query("SELECT session FROM (SELECT DISTINCT session FROM day_ev) ORDER BY sha256('7:' || session), session LIMIT 100")
def sample_n(s, d):
    return A.e_day(s, d).select("session").distinct().orderBy(split.order_hash(7, F.col("session")), "session").limit(100)


# -- set operations


@query("SELECT session, product_id FROM cb_items UNION ALL SELECT session, last_product FROM cb_pick")
def union_all(s, d):
    history, cases = _cases(s, d)
    return C.history_items(history).select("session", "product_id").unionByName(cases.select("session", F.col("last_product").alias("product_id")))


@query("SELECT session, product_id FROM cb_items UNION SELECT session, target FROM cb_pick")
def union_distinct(s, d):
    history, cases = _cases(s, d)
    return C.history_items(history).select("session", "product_id").union(cases.select("session", "target")).distinct()


@query("SELECT session, product_id, event_type, max(seq) AS seq FROM long_ev GROUP BY ALL")
def dedup_keep_last(s, d):
    rows = A.e_long(s, d).groupBy("session", "product_id", "event_type").agg(F.max(F.struct("event_time", "seq")).alias("l"))
    return rows.select("session", "product_id", "event_type", "l.seq")


@query("""SELECT product_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM
  (SELECT product_id, list(neighbour) AS a FROM day_m WHERE kind = 'time' GROUP BY 1) JOIN (SELECT product_id, list(neighbour) AS b FROM night_m WHERE kind = 'time' GROUP BY 1) USING (product_id)""")
def jaccard(s, d):
    one = lambda m: m.where("kind = 'time'").select("product_id", "neighbour")
    return _r(nightly.jaccard(one(_matrix_b(s, d)), one(_matrix_c(s, d)), "product_id", "neighbour"), "jaccard")


# -- streaming


@query("""SELECT session, count(*) AS n_kept, string_agg(product_id, ',' ORDER BY seq) AS products FROM
  (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS r FROM long_ev) WHERE r <= 200 GROUP BY session""")
def stream_session_state(s, d):
    """The state that a stream of all events ends with, from a batch."""
    return stream.last_events(A.e_long(s, d))


@query("""SELECT session, count(*) AS n_kept, string_agg(product_id, ',' ORDER BY seq) AS products FROM
  (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS r FROM long_ev) WHERE r <= 20 GROUP BY session""")
def stream_consume(s, d):
    """A file stream through keyed state to its end; the last row of each session counts."""
    src, out, check = (_tmp(s, x) for x in ("stream", "stream-out", "stream-check"))
    ev = stream.encode(A.e_long(s, d))
    key = "spark.sql.streaming.stateStore.providerClass"
    old = s.conf.get(key, None)
    s.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for half in (0, 1):  # stopped and restarted from its checkpoint between two files
            ev.where(F.col("seq") % 2 == half).coalesce(1).write.mode("append").parquet(src)
            rows = stream.decode(s.readStream.schema(ev.schema).parquet(src))
            write = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)
            stream.stream_state(rows, 20, None).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(key, old) if old else s.conf.unset(key)
    return s.read.parquet(out).groupBy("session").agg(F.max_by(F.struct("n_kept", "products"), "batch").alias("l")).select("session", "l.*")


@query("SELECT count(*) AS n, TRUE AS in_order FROM day_ev WHERE event_time < TIMESTAMP '2024-01-17'")
def stream_staleness(s, d):
    """Messages that carry when they were sent, consumed as a stream that notes when each is readable; whether 0 <= p50 <= p95 <= p99."""
    src, out, check = (_tmp(s, x) for x in ("sent", "readable", "sent-check"))
    ev = A.e_day(s, d).where(F.col("event_time") < F.lit(B))
    for half in (0, 1):
        stream.encode(ev.where(F.col("seq") % 2 == half)).withColumn("sent", F.unix_micros(F.current_timestamp()) / 1e6).write.mode("append").parquet(src)
    rows = s.readStream.schema("session long, seq long, value string, sent double").parquet(src)
    write = lambda df, i: df.withColumn("done", F.unix_micros(F.current_timestamp()) / 1e6).write.mode("append").parquet(out)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return stream.staleness(s.read.parquet(out), "sent", "done").select("n", ((F.col("p50") >= 0) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99"))).alias("in_order"))


@query("SELECT count(DISTINCT session % 6) AS partitions, count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-24') AS lag FROM day_ev")
def stream_lag(s, d):
    """Messages that a consumer has not read which stopped at 24 January, over six partitions."""
    w = Window.partitionBy("partition").orderBy("event_time", "seq")
    log = A.e_day(s, d).withColumn("partition", (F.col("session") % 6).cast("int")).withColumn("offset", F.row_number().over(w) - 1)
    read = log.where(F.col("event_time") < F.lit(C_)).groupBy("partition").agg(F.count("*").alias("position"))
    return stream.lag(log, read)


@query("SELECT session, seq, round((epoch_us(event_time) // 1000000 - min(epoch_us(event_time) // 1000000) OVER ()) / 3600.0::DOUBLE, 6) AS due FROM day_ev WHERE event_time < TIMESTAMP '2024-01-17'")
def stream_replay(s, d):
    """Seconds after the start at which a replay at 3600 times the speed publishes each event."""
    return _r(stream.due(A.e_day(s, d).where(F.col("event_time") < F.lit(B)), 3600).select("session", "seq", "due"), "due")


@query("""SELECT request, seq FROM (SELECT session || ':' || seq AS request, seq FROM day_ev) WHERE ('0x' || sha256('0:' || request)[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.25 ORDER BY seq DESC LIMIT 400""")
def stream_sampler(s, d):
    """A quarter of the requests, micro-batch by micro-batch, into a table capped at the newest 400."""
    src, out, check = (_tmp(s, x) for x in ("asked", "sampled", "asked-check"))
    ev = A.e_day(s, d).select(F.concat_ws(":", "session", "seq").alias("request"), "seq")
    for half in (0, 1):
        ev.where(F.col("seq") % 2 == half).coalesce(1).write.mode("append").parquet(src)
    sampler = stream.Sampler(out, 0.25, 400)
    s.readStream.schema("request string, seq long").option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(sampler.record).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return sampler.rows(s).select("request", "seq")


@query("""SELECT session, count(*) AS n_kept, string_agg(product_id, ',' ORDER BY seq) AS products FROM
  (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS r, max(event_time) OVER (PARTITION BY session) AS last, max(event_time) OVER () AS now FROM long_ev) WHERE r <= 20 AND last >= now - INTERVAL 10 DAY GROUP BY session""")
def sink_session_store(s, d):
    """Micro-batches of events appended to a store that keeps 20 events of a session and sessions of the last ten days; the second batch comes twice."""
    store = stream.SessionStore(s, _tmp(s, "store"), cap=20, ttl=10 * S.DAY)
    ev = A.e_long(s, d).withColumn("event_time", F.date_trunc("second", "event_time"))
    half = ev.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    for i in (0, 1, 1):
        store.append(ev.where((F.col("seq") > F.lit(half)) == F.lit(bool(i))), i)
    return store.sessions()


@query("SELECT CAST(session AS VARCHAR) AS key, count(*) AS n, count(*) AS n_offsets FROM day_ev GROUP BY session")
def sink_kafka(s, d):
    """Events published as messages keyed by session, in two parts, offsets going on; to a folder, as a broker's connector is not part of PySpark."""
    at = _tmp(s, "topic")
    rows = stream.encode(A.e_day(s, d)).select(F.col("session").cast("string").alias("key"), "seq", "value")
    topics.write_folder(rows.where("seq % 2 = 0"), at)
    high = s.read.parquet(at).groupBy("partition").agg((F.max("offset") + 1).alias("high"))
    topics.write_folder(rows.where("seq % 2 = 1"), at, start=_once(high))
    return s.read.parquet(at).groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("partition", "offset").alias("n_offsets"))


@query("SELECT session, product_id, event_type, count(*) AS n FROM day_ev GROUP BY ALL")
def src_kafka(s, d):
    """The same topic read as a stream, a few files a micro-batch, and decoded."""
    at, out, check = (_tmp(s, x) for x in ("topic", "decoded", "topic-check"))
    topics.write_folder(stream.encode(A.e_day(s, d)).select(F.col("session").cast("string").alias("key"), "seq", "value"), at)
    rows = stream.decode(topics.read_folder(s, at, most=4).withColumn("seq", F.col("offset")))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).groupBy("session", "product_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, min(event_time) AS start_time, max(event_time) AS last_event, count(*) AS n FROM (
  SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS w FROM (
    SELECT user_id, event_time, CASE WHEN event_time < lag(event_time) OVER (PARTITION BY user_id ORDER BY event_time) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM day_ev)) GROUP BY user_id, w""")
def session_inactivity(s, d):
    return split.inactivity(A.e_day(s, d))


# -- split and cases


@query("SELECT seq, session, run, target FROM cb_own")
def runs_target(s, d):
    ev = A.e_day(s, d).join(_cases(s, d)[1].select("session"), "session", "left_semi")
    return split.runs(ev).select("seq", "session", "run", "target")


@query("SELECT session, cut_time, last_product, target FROM cb_pick")
def cases(s, d):
    return _cases(s, d)[1]


@query("SELECT session, seq, pos FROM cb_hist")
def case_history(s, d):
    return _cases(s, d)[0].select("session", "seq", "pos")


# -- co-visitation


@query("SELECT * FROM long_prep")
def covis_prepare(s, d):
    return covisit.prepare(A.e_long(s, d))


def _covis(kind: str):
    def run(s, d):
        return covisit.build(A.e_long(s, d)).where(F.col("kind") == kind).select("product_id", "neighbour", "weight", "rank")

    run.__name__ = f"covis_{kind}"
    return query(f"SELECT product_id, neighbour, weight, rank FROM long_m WHERE kind = '{kind}'")(run)


for _k in S.KINDS:
    _covis(_k)


@query("SELECT kind, product_id, neighbour, round(weight, 6) AS weight FROM long_w")
def covis_all(s, d):
    return _r(covisit.weights(covisit.prepare(A.e_long(s, d))), "weight")


@query("SELECT kind, product_id, neighbour, weight, rank FROM cust_m")
def covis_topn(s, d):
    return covisit.build(A.o_cust(s, d))


# -- candidates, features, metrics


@query("SELECT session, product_id, h_events, h_last, h_pos, h_max_type, h_rank FROM cb_items")
def history_items(s, d):
    return C.history_items(_cases(s, d)[0])


@query("SELECT * FROM pop_b")
def popular(s, d):
    return _popular_b(s, d)


@query("SELECT session, kind, product_id, round(sum(part), 6) AS score FROM part_b GROUP BY ALL")
def covis_scores(s, d):
    return _r(C.covis_scores(C.history_items(_cases(s, d)[0]), _matrix_b(s, d)), "score")


@query("SELECT session, product_id, round(score, 6) AS score FROM sc_covis")
def combined_covis(s, d):
    return _r(C.combined(C.covis_scores(C.history_items(_cases(s, d)[0]), _matrix_b(s, d))), "score")


@query("SELECT session, array_to_string(run, ',') AS run FROM run_item2item")
def top_k(s, d):
    run, _ = _run(s, d, "item2item")
    return run.select("session", _line("run").alias("run"))


def _baseline(name: str):
    def run(s, d):
        return C.evaluate(*_run(s, d, name))

    run.__name__ = f"baseline_{name}"
    return query(metrics(f"run_{name}", "cb_pick"))(run)


for _k in ("popular", "history", "item2item", "covis"):
    _baseline(_k)


@query(product_stats("day_ev", "2024-01-24"))
def product_stats_night(s, d):
    return features.product_stats(split.stats_events(A.e_day(s, d), "C"), C_)


QUERIES["product_stats"], ORACLE_SQL["product_stats"] = QUERIES.pop("product_stats_night"), ORACLE_SQL.pop("product_stats_night")


@query("SELECT session, product_id, round(c_sum, 6) AS c_sum FROM feat_b")
def candidates(s, d):
    history, cases = _cases(s, d)
    return _r(features.candidates(C.history_items(history), _matrix_b(s, d), cases).select("session", "product_id", "c_sum"), "c_sum")


_FLOATS = [*S.SCORES, "c_sum", "p_price"]


def _fixed(df):
    """Features as six digits; price_ratio as text of four significant digits."""
    return _r(df, *_FLOATS).withColumn("price_ratio", F.round(F.col("price_ratio").cast("double"), 3))


@query(f"SELECT session, product_id, label, {', '.join(f'round({c}, 6) AS {c}' if c in _FLOATS else 'round(price_ratio::DOUBLE, 3) AS price_ratio' if c == 'price_ratio' else c for c in S.FEATURES)} FROM feat_b")
def features_24(s, d):
    return _fixed(_features(s, d))


QUERIES["features"], ORACLE_SQL["features"] = QUERIES.pop("features_24"), ORACLE_SQL.pop("features_24")


@query(metrics("(SELECT r.*, CAST(CAST(p.cut_time AS DATE) AS VARCHAR) AS day FROM run_covis r JOIN cb_pick p USING (session))", "cb_pick", "day"))
def metrics_eval(s, d):
    """Whole-history lists by the day of the cut."""
    run, cases = _run(s, d, "covis")
    return C.evaluate(run.join(cases.select("session", F.col("cut_time").cast("date").cast("string").alias("day")), "session"), cases, ("day",))


@query(metrics("all_runs", "cb_pick", "model"))
def baselines_table(s, d):
    history, cases = _cases(s, d)
    m, pop = _once(_matrix_b(s, d)), _popular_b(s, d)
    parts = [C.top_k(C.baseline_scores(n, history, m), cases, pop).withColumn("model", F.lit(n)) for n in ("popular", "history", "item2item", "covis")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return C.evaluate(both, cases, ("model",))


# -- ranker and refresh


@query("""SELECT session, product_id, label FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sha256('0:' || session || ':' || product_id), product_id) AS r FROM feat_b
  WHERE session IN (SELECT session FROM feat_b WHERE label = 1)) WHERE label = 1 OR r <= 30""")
def train_sample(s, d):
    return features.train_sample(_features(s, d)).select("session", "product_id", "label")


_TREES = 20
_models: dict[tuple[str, str], ranker.Ranker] = {}


def _model(s, d) -> ranker.Ranker:
    """The ranker of window B's sample, trained once for an application and folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _models:
        _models[key] = ranker.train(_once(features.train_sample(_features(s, d))), trees=_TREES)
    return _models[key]


@query()
def ranker_train(s, d):
    """Trained on window B's sample: rows, sessions, rounds, NDCG@10 of the held-out sessions after each, whether it is in the model."""
    m = _model(s, d)
    return s.createDataFrame([(i + 1, m.rows, m.sessions, float(n), i < len(m.trees)) for i, n in enumerate(m.ndcg)], "round int, rows long, sessions long, ndcg_10 double, kept boolean")


@query()
def feature_importance(s, d):
    return ranker.importance(s, _model(s, d))


def _window_c(s, d):
    history, cases = _cases(s, d, "C")
    before = split.stats_events(A.e_day(s, d), "C")
    return history, cases, before, features.build(history, cases, _once(_matrix_c(s, d)), features.product_stats(before, C_))


@query()
def ranker_score(s, d):
    """Window C ranked by a model of window B."""
    _, cases, before, rows = _window_c(s, d)
    return C.evaluate(C.top_k(ranker.score(_model(s, d), rows), cases, C.popular(before, C_)), cases)


@query("SELECT count(*) AS n_cases, count(h.session) AS n_hit, round(count(h.session)::DOUBLE / count(*), 6) AS candidate_recall FROM cb_pick LEFT JOIN (SELECT DISTINCT session FROM feat_b WHERE label = 1) h USING (session)")
def candidate_recall(s, d):
    return ranker.candidate_recall(_features(s, d), _cases(s, d)[1])


_DAYS = [f"2024-01-{24 + k:02d}" if k < 8 else "2024-02-01" for k in range(8)]


def _refresh_sql() -> str:
    parts = []
    for k, day in enumerate(_DAYS):
        for name, until in (("frozen", "2024-01-24"), ("nightly", day)):
            p, at = f"rd_{name}_{k}", f"event_time < TIMESTAMP '{until}'"
            parts.append(refresh(p, at, until, day))
    return " UNION ALL ".join(f"SELECT {k}::INT AS day, '{name}' AS tables, n_cases, recall_20, ndcg_10 FROM ({part})" for (k, name), part in zip([(k, n) for k in range(8) for n in ("frozen", "nightly")], parts, strict=True))


@query(_refresh_sql())
def refresh_daily(s, d):
    """Per day of window C: item-to-item recall with tables frozen at its start and with tables before that day."""
    history, cases = _cases(s, d, "C")
    history, cases, ev, out = _once(history), _once(cases), A.e_day(s, d), None

    def tables(until):
        before = ev.where(F.col("event_time") < until)
        return _once(covisit.build(before)), _once(C.popular(before, until))

    frozen = tables(F.lit(C_))
    for k in range(8):
        day = F.lit(C_) + F.expr(f"INTERVAL {k} DAYS")
        mine = cases.where((F.col("cut_time") >= day) & (F.col("cut_time") < day + F.expr("INTERVAL 1 DAY")))
        own = history.join(mine.select("session"), "session", "left_semi")
        for name, (matrix, pop) in (("frozen", frozen), ("nightly", frozen if k == 0 else tables(day))):
            row = C.evaluate(C.top_k(C.baseline_scores("item2item", own, matrix), mine, pop), mine).select(F.lit(k).alias("day"), F.lit(name).alias("tables"), "n_cases", "recall_20", "ndcg_10")
            out = row if out is None else out.unionByName(row)
    return out


# -- nightly tables


@query("SELECT date_trunc('day', event_time)::TIMESTAMP AS d, count(*) AS n, max(event_time) AS last FROM day_ev WHERE event_time >= TIMESTAMP '2024-01-16' AND event_time < TIMESTAMP '2024-01-24' GROUP BY 1")
def daily_counts(s, d):
    return nightly.daily_counts(A.e_day(s, d), "2024-01-23")


_GATE = """SELECT * FROM (WITH c AS (SELECT CAST(event_time AS DATE) AS d, count(*) AS n, max(event_time) AS last FROM day_ev WHERE event_time >= TIMESTAMP '2024-01-16' AND event_time < TIMESTAMP '2024-01-24' GROUP BY 1),
  r AS (SELECT coalesce(max(n) FILTER (WHERE d = DATE '2024-01-23'), 0) AS events, max(last) FILTER (WHERE d = DATE '2024-01-23') AS last, median(n) FILTER (WHERE d < DATE '2024-01-23') AS usual FROM c)
  SELECT '2024-01-23' AS day, events, round(events / usual, 6) AS ratio, CASE WHEN events = 0 THEN 'no events' WHEN last < TIMESTAMP '2024-01-23 23:00:00' THEN 'not complete'
    WHEN NOT events / usual BETWEEN 0.5 AND 2.0 THEN 'volume' ELSE 'ok' END AS status FROM r)"""


@query(_GATE)
def gate(s, d):
    return nightly.gate(nightly.daily_counts(A.e_day(s, d), "2024-01-23"), "2024-01-23")


@query("SELECT kind, count(*) AS n FROM night_m GROUP BY kind")
def build_version(s, d):
    v = versions.Versions(s, _tmp(s, "build"))
    v.build("2024-01-23", {"covis": _matrix_c(s, d)}, {"night": "2024-01-23"})
    return v.table("covis", "2024-01-23").groupBy("kind").agg(F.count("*").alias("n"))


def _probes(s, d, matrix, n: int = 50):
    """Lists of n sessions of window B, in a seeded order, by the summed co-visitation of a matrix."""
    history, cases = _cases(s, d)
    some = cases.orderBy(split.order_hash(0, F.lit("probe"), F.col("session")), "session").limit(n).select("session", "last_product")
    scores = C.combined(C.covis_scores(C.history_items(history.join(some.select("session"), "session", "left_semi")), matrix))
    return online.recommend(scores, some, _popular_b(s, d))


_PROBED = """SELECT count(*) AS n_probes, count(*) FILTER (WHERE own + filler >= 20) AS n_full FROM (SELECT p.session, count(DISTINCT c.product_id) AS own,
    (SELECT count(*) FROM (SELECT product_id FROM pop_b ORDER BY pop DESC, product_id LIMIT 200) f WHERE f.product_id <> p.last_product AND f.product_id NOT IN (SELECT product_id FROM night_sc n WHERE n.session = p.session)) AS filler
  FROM (SELECT session, last_product FROM cb_pick ORDER BY sha256('0:probe:' || session), session LIMIT 50) p LEFT JOIN night_sc c ON c.session = p.session AND c.product_id <> p.last_product GROUP BY p.session, p.last_product)"""
_VALIDATED = f"""SELECT n_new, n_old, round(abs(n_new - n_old)::DOUBLE / greatest(n_old, 1), 4) AS change, round(overlap, 4) AS overlap, n_probes, n_full,
  CASE WHEN abs(n_new - n_old)::DOUBLE / greatest(n_old, 1) > 0.25 THEN 'size' WHEN coalesce(overlap, 0) < 0.2 THEN 'overlap' WHEN n_full < n_probes THEN 'probes' ELSE 'ok' END AS status
  FROM (SELECT count(DISTINCT product_id) AS n_new FROM night_m), (SELECT count(DISTINCT product_id) AS n_old FROM day_m), ({_PROBED}), (
    SELECT avg(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))) AS overlap FROM (SELECT product_id, list(neighbour) AS a FROM day_m WHERE kind = 'time' GROUP BY 1)
    JOIN (SELECT product_id, list(neighbour) AS b FROM night_m WHERE kind = 'time' GROUP BY 1) USING (product_id) JOIN (SELECT product_id FROM pop_b ORDER BY pop DESC, product_id LIMIT 200) USING (product_id))"""


@query(_VALIDATED)
def validate(s, d):
    new, old = _once(_matrix_c(s, d)), _once(_matrix_b(s, d))
    return nightly.validate(new, old, _popular_b(s, d), _probes(s, d, new))


@query("SELECT 'night-2' AS version, count(*) AS n FROM night_m")
def publish(s, d):
    """Two versions built and published in turn; the pointer's is read."""
    v = versions.Versions(s, _tmp(s, "publish"))
    for name, m in (("night-1", _matrix_b(s, d)), ("night-2", _matrix_c(s, d))):
        v.publish(v.build(name, {"covis": m}, {}))
    return v.table("covis").agg(F.count("*").alias("n")).select(F.lit(v.current()).alias("version"), "n")


def _dag_sql() -> str:
    return f"""SELECT gate, CASE WHEN gate = 'ok' THEN validation ELSE 'not built' END AS validation, CASE WHEN gate = 'ok' AND validation = 'ok' THEN '2024-01-23' ELSE '2024-01-16' END AS serving
  FROM (SELECT status AS gate FROM ({_GATE})), (SELECT status AS validation FROM ({_VALIDATED}))"""


@query(_dag_sql())
def nightly_dag(s, d):
    """Check, then build, validate, publish; a refused night is not built and leaves the pointer."""
    v = versions.Versions(s, _tmp(s, "dag"))
    v.publish(v.build("2024-01-16", {"covis": _matrix_b(s, d)}, {}))
    check, validation = gate(s, d).first()["status"], "not built"
    if check == "ok":
        built = v.build("2024-01-23", {"covis": _matrix_c(s, d)}, {})
        new = v.table("covis", built)
        validation = nightly.validate(new, v.table("covis"), _popular_b(s, d), _probes(s, d, new)).first()["status"]
        if validation == "ok":
            v.publish(built)
    return s.createDataFrame([(check, validation, v.current())], "gate string, validation string, serving string")


@query("""SELECT kind, count(a.weight) AS n_first, count(b.weight) AS n_second, count(*) FILTER (WHERE b.weight IS NULL) AS only_first, count(*) FILTER (WHERE a.weight IS NULL) AS only_second,
  count(*) FILTER (WHERE a.weight IS NOT NULL AND b.weight IS NOT NULL) AS shared, count(*) FILTER (WHERE a.weight = b.weight) AS same, round(max(abs(a.weight::DOUBLE - b.weight) / abs(b.weight::DOUBLE)), 6) AS max_diff
  FROM day_m a FULL JOIN night_m b USING (kind, product_id, neighbour) GROUP BY kind""")
def compare_matrices(s, d):
    return nightly.compare_matrices(_matrix_b(s, d), _matrix_c(s, d))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS n_differ FROM stats_b a FULL JOIN ({product_stats('day_ev', '2024-01-24')}) b USING (product_id)""" for c in ("p_price", "p_brand", "p_events_7d")))
def compare_frames(s, d):
    ev = A.e_day(s, d)
    a, b = (features.product_stats(split.stats_events(ev, w), S.window(w)[0]).select("product_id", "p_price", "p_brand", "p_events_7d") for w in ("B", "C"))
    return nightly.compare_frames(a, b, "product_id")


@query("SELECT product_id, p_events_7d AS pop FROM stats_b WHERE p_events_7d IS NOT NULL")
def popular_from_stats(s, d):
    return features.product_stats(split.stats_events(A.e_day(s, d), "B"), B).where("p_events_7d is not null").select("product_id", F.col("p_events_7d").alias("pop"))


@query("""SELECT count(*) AS events, count(*) FILTER (WHERE event_type = 0) AS views, count(*) FILTER (WHERE event_type = 1) AS carts, count(*) FILTER (WHERE event_type = 2) AS purchases,
  count(DISTINCT user_id) AS users, count(DISTINCT session) AS sessions, count(DISTINCT product_id) AS products, count(*) FILTER (WHERE session IS NULL) AS events_without_session, min(event_time) AS first_event,
  max(event_time) AS last_event, any_value(m) AS events_per_session_median, any_value(p) AS events_per_session_p99
  FROM day_ev, (SELECT median(n)::DOUBLE AS m, quantile_disc(n, 0.99)::DOUBLE AS p FROM (SELECT count(*) AS n FROM day_ev GROUP BY session))""")
def ingest_stats(s, d):
    return nightly.ingest_stats(A.e_day(s, d))


# -- online scoring: the batch operators over a micro-batch


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" if c in _FLOATS else "round(price_ratio::DOUBLE, 3) AS price_ratio" if c == "price_ratio" else c for c in S.FEATURES)


def _online(s, d):
    """Features of window B's sessions that came through the codec, worked out session by session from exported tables."""
    numbered = _cases(s, d)[0].withColumn("seq", F.col("pos"))  # messages are told apart by their place, as seq can repeat
    back = stream.decode(stream.encode(numbered)).withColumnRenamed("seq", "pos")
    tables = {k: _once(v) for k, v in _tables(s, d).items()}
    return online.online_features(back, tables)


@query(f"SELECT session, product_id, {_ROUNDED} FROM feat_b")
def online_features(s, d):
    return _fixed(_online(s, d))


def _filled(own: str, pick: str, pop: str) -> str:
    return f"""SELECT session, array_to_string(list_concat(own, list_filter(filler, lambda x: x <> last_product AND NOT list_contains(own, x))[1:20 - len(own)]), ',') AS items, len(own) AS n_scored FROM (
    SELECT p.session, p.last_product, coalesce(o.own, []::BIGINT[]) AS own FROM {pick} p LEFT JOIN (SELECT session, list(product_id ORDER BY rk) AS own FROM ({own}) WHERE rk <= 20 GROUP BY session) o USING (session)),
    (SELECT list(product_id ORDER BY pop DESC, product_id) AS filler FROM (SELECT * FROM {pop} ORDER BY pop DESC, product_id LIMIT 200))"""


@query(_filled("SELECT session, product_id, row_number() OVER (PARTITION BY session ORDER BY round(c_sum, 6) DESC, product_id) AS rk FROM feat_b", "cb_pick", "pop_b"))
def recommend(s, d):
    """Full lists by summed co-visitation of the online candidates, popular products behind them with score 0."""
    own = _once(_online(s, d).select("session", "product_id", F.round("c_sum", 6).alias("score")))
    got = online.recommend(own, _cases(s, d)[1].select("session", "last_product"), _popular_b(s, d))
    rows = own.groupBy("session").agg(F.least(F.count("*"), F.lit(S.K)).alias("n_scored"))
    return got.join(rows, "session", "left").select("session", _line("items").alias("items"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"))


@query()
def rank(s, d):
    """The same by the ranker, with the number of feature rows that were ranked."""
    rows = _once(_online(s, d).withColumn("label", F.lit(0)))
    got = online.recommend(ranker.score(_model(s, d), rows), _cases(s, d)[1].select("session", "last_product"), _popular_b(s, d))
    return got.join(rows.groupBy("session").agg(F.count("*").alias("n_rows")), "session", "left").select("session", _line("items").alias("items"), _line("scores").alias("scores"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("SELECT count(DISTINCT session) AS sessions, 0::BIGINT AS candidate_set_mismatches, count(*) AS feature_rows, 0::BIGINT AS missing_value_mismatches, 0.0::DOUBLE AS max_relative_feature_diff, count(DISTINCT session) AS identical_top_lists FROM feat_b")
def parity(s, d):
    """Batch features against those of the serving path: candidates, missing values, all 24 columns, top lists."""
    return online.parity(_features(s, d), _online(s, d))


# -- experiments


@query("SELECT user_id, (('0x' || sha256('ranker-vs-item2item:' || user_id)[1:14])::BIGINT >> 3)::DOUBLE / 9007199254740992 AS bucket FROM (SELECT DISTINCT user_id FROM events)")
def ab_bucket(s, d):
    return A.read(s, d, "events").select("user_id").distinct().select("user_id", E.bucket(F.col("user_id"), S.SALT).alias("bucket"))


@query("SELECT c_custkey, (('0x' || sha256('ranker-vs-item2item:' || c_custkey)[1:14])::BIGINT >> 3)::DOUBLE / 9007199254740992 < 0.5 AS treated FROM customer")
def ab_assign(s, d):
    return A.read(s, d, "customer").select("c_custkey", E.assign(F.col("c_custkey"), S.SALT).alias("treated"))


def _hits(s, d):
    """(session, user_id, day, hit, hit_t) of window B: item to item is the control, whole history the treatment."""
    history, cases = _cases(s, d)
    m, pop = _once(_matrix_b(s, d)), _popular_b(s, d)
    one = lambda n, c: C.top_k(C.baseline_scores(n, history, m), cases, pop).join(cases.select("session", "target"), "session").select("session", (F.array_position("run", F.col("target")) > 0).cast("int").alias(c))
    day = F.floor((F.unix_seconds("event_time") - F.unix_seconds(F.lit(B))) / S.DAY).cast("int").alias("day")
    first = history.where("pos = 0").select("session", F.coalesce("user_id", -1 - F.col("session")).alias("user_id"), day)
    return first.join(one("item2item", "hit"), "session").join(one("covis", "hit_t"), "session")


def _arms(s, d):
    """One row for each user: n sessions, y hits of the list that its arm shows, arm."""
    per = _hits(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("hit").alias("yc"), F.sum("hit_t").alias("yt"))
    per = per.withColumn("arm", E.assign(F.col("user_id"), S.SALT).cast("int"))
    return per.select("user_id", "n", F.when(F.col("arm") == 1, F.col("yt")).otherwise(F.col("yc")).alias("y"), "arm")


@query('SELECT arm, n, YY AS "YY", YN AS "YN", NN AS "NN", SN AS "SN", SY AS "SY" FROM arm_sums')
def ab_sums(s, d):
    return E.sums(_arms(s, d), "arm", "y", "n").select("arm", F.col("users").alias("n"), "YY", "YN", "NN", "SN", "SY")


_VAR = "(YY - 2 * r * YN + r * r * NN) / (SN::DOUBLE * SN) * n / (n - 1)"


@query(f"SELECT arm, round(r, 6) AS ratio, round({_VAR}, 9) AS variance FROM (SELECT *, SY::DOUBLE / SN AS r FROM arm_sums)")
def ab_ratio(s, d):
    r, v = E.ratio()
    return E.sums(_arms(s, d), "arm", "y", "n").select("arm", F.round(r, 6).alias("ratio"), F.round(v, 9).alias("variance"))


@query(f"SELECT arm, round(sqrt(v / 0.5 + v / 0.5), 6) AS planned_se FROM (SELECT *, {_VAR} AS v FROM (SELECT *, SY::DOUBLE / SN AS r FROM arm_sums))")
def ab_planned_se(s, d):
    return E.sums(_arms(s, d), "arm", "y", "n").select("arm", F.round(E.planned_se(), 6).alias("planned_se"))


@query("SELECT arm, round(r * (1 - r) / SN, 9) AS naive FROM (SELECT *, SY::DOUBLE / SN AS r FROM arm_sums)")
def ab_naive_var(s, d):
    return E.sums(_arms(s, d), "arm", "y", "n").select("arm", F.round(E.naive_variance(), 9).alias("naive"))


@query(f"""SELECT round(sum(CASE arm WHEN 1 THEN r ELSE -r END), 6) AS effect, round(sqrt(sum(v)), 6) AS se, round(sqrt(sum(r * (1 - r) / SN)), 6) AS se_naive
  FROM (SELECT *, {_VAR} AS v FROM (SELECT *, SY::DOUBLE / SN AS r FROM arm_sums))""")
def ab_difference(s, d):
    return _r(E.difference(E.sums(_arms(s, d), "arm", "y", "n"), "arm"), "effect", "se", "se_naive")


def _covariates(s, d):
    """Per user with an event before window C: hits and cases in window B, events and sessions."""
    before = A.e_day(s, d).where(F.col("event_time") < F.lit(C_))
    activity = before.groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct("session").alias("sessions"))
    history, cases = split.cases(before, "B")
    run = C.top_k(C.baseline_scores("item2item", history, _matrix_b(s, d)), cases, _popular_b(s, d)).join(cases.select("session", "target"), "session")
    hit = run.select("session", (F.array_position("run", F.col("target")) > 0).cast("long").alias("hit")).join(history.where("pos = 0").select("session", "user_id"), "session")
    per = hit.groupBy("user_id").agg(F.sum("hit").alias("b_hits"), F.count("*").alias("b_cases"))
    return activity.join(per, "user_id", "left").fillna(0, ["b_hits", "b_cases"]).select("user_id", "b_hits", "b_cases", "events", "sessions")


_COVS = """SELECT user_id, coalesce(b_hits, 0) AS b_hits, coalesce(b_cases, 0) AS b_cases, events, sessions FROM
  (SELECT user_id, count(*) AS events, count(DISTINCT session) AS sessions FROM day_ev WHERE event_time < TIMESTAMP '2024-01-24' GROUP BY user_id) LEFT JOIN
  (SELECT user_id, sum(hit)::BIGINT AS b_hits, count(*) AS b_cases FROM hits_b JOIN sess_b USING (session) GROUP BY user_id) USING (user_id)"""


@query(_COVS)
def replay_covariates(s, d):
    return _covariates(s, d)


@query(f"SELECT user_id, b_hits::DOUBLE AS b_hits, b_cases::DOUBLE AS b_cases, round(ln(1 + events), 9) AS log_events, round(ln(1 + sessions), 9) AS log_sessions, 1.0::DOUBLE AS active FROM ({_COVS})")
def covariate_matrix(s, d):
    c = _covariates(s, d)
    log = lambda x: F.round(F.log1p(x), 9).alias(f"log_{x}")
    return c.select("user_id", F.col("b_hits").cast("double").alias("b_hits"), F.col("b_cases").cast("double").alias("b_cases"), log("events"), log("sessions"), (F.col("events") > 0).cast("double").alias("active"))


_X = ("b_hits", "b_cases", "log_events", "log_sessions", "active")


def _users(s, d):
    """Users of window B by arm, with the covariates of what they did before it."""
    return _once(_arms(s, d).join(_before_b(s, d), "user_id", "left").fillna(0.0, list(_X)))


def _before_b(s, d):
    """The five covariates of users with an event before window B, its lists those of window A."""
    start, ev = S.window("A")[0], A.e_day(s, d)
    activity = ev.where(F.col("event_time") < F.lit(B)).groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct("session").alias("sessions"))
    history, cases = split.cases(ev.where(F.col("event_time") < F.lit(B)), "A")
    half = start + (B - start) / 2  # window A is the first: its lists come from its first half
    pop = C.popular(ev.where(F.col("event_time") < F.lit(half)), half)
    run = C.top_k(C.baseline_scores("item2item", history, covisit.build(ev.where(F.col("event_time") < F.lit(half)))), cases, pop).join(cases.select("session", "target"), "session")
    hit = run.select("session", (F.array_position("run", F.col("target")) > 0).cast("long").alias("hit")).join(history.where("pos = 0").select("session", "user_id"), "session")
    per = hit.groupBy("user_id").agg(F.sum("hit").cast("double").alias("b_hits"), F.count("*").cast("double").alias("b_cases"))
    rows = activity.join(per, "user_id", "left").fillna(0.0, ["b_hits", "b_cases"])
    return rows.select("user_id", "b_hits", "b_cases", F.log1p("events").alias("log_events"), F.log1p("sessions").alias("log_sessions"), (F.col("events") > 0).cast("double").alias("active"))


@query()
def ab_cuped(s, d):
    """The plain difference and that adjusted for five covariates, with errors and p-values."""
    users = _users(s, d)
    plain, got = E.difference(E.sums(users, "arm", "y", "n"), "arm").first(), E.cuped(users, "arm", "y", "n", _X).first()
    out = [(plain["effect"], plain["se"], E.p_value(plain["effect"], plain["se"]), got["effect"], got["se"], E.p_value(got["effect"], got["se"]))]
    return s.createDataFrame(out, "effect double, se double, p double, cuped double, cuped_se double, cuped_p double")


@query()
def ab_reduction(s, d):
    """The share of the control's variance that each set of covariates removes, one more at a time."""
    control, out = _users(s, d).where("arm = 0"), None
    for k in range(1, len(_X) + 1):
        row = E.reduction(control, "y", "n", _X[:k]).select(F.lit(",".join(_X[:k])).alias("covariates"), "reduction")
        out = row if out is None else out.unionByName(row)
    return out


_DIFFERENCE = f"""SELECT sum(CASE arm WHEN 1 THEN r ELSE -r END) AS effect, sqrt(sum(v)) AS se, sum(n) AS users FROM (SELECT *, {_VAR} AS v FROM (SELECT *, SY::DOUBLE / SN AS r FROM arm_sums))"""


def _measured(s, d):
    """Effect, error and users of the measured difference."""
    sums = E.sums(_once(_arms(s, d)), "arm", "y", "n")
    return {**E.difference(sums, "arm").first().asDict(), "users": sums.agg(F.sum("users")).first()[0]}


@query(f"SELECT round({CDF.REACH} * se, 6) AS mde FROM ({_DIFFERENCE})")
def ab_mde(s, d):
    """The least effect that the measured error detects."""
    return _r(s.createDataFrame([(E.mde(_measured(s, d)["se"]),)], "mde double"), "mde")


@query(f"SELECT round({CDF.power('(effect / se)')}, 4) AS power FROM ({_DIFFERENCE})")
def ab_power(s, d):
    r = _measured(s, d)
    return _r(s.createDataFrame([(E.power(r["effect"], r["se"]),)], "power double"), "power", n=4)


@query(f"SELECT round(ln({CDF.REACH} * {CDF.REACH} * se * se * users / (effect * effect)), 6) AS log_users FROM ({_DIFFERENCE})")
def ab_users_needed(s, d):
    """Logarithm of the users that the measured effect needs."""
    r = _measured(s, d)
    return _r(s.createDataFrame([(math.log(E.users_needed(r["effect"], r["se"] ** 2 * r["users"])) if r["effect"] else None,)], "log_users double"), "log_users")


@query(f"SELECT round({CDF.p('(effect / se)')}, 4) AS p_value FROM ({_DIFFERENCE})")
def ab_p_value(s, d):
    r = _measured(s, d)
    return _r(s.createDataFrame([(E.p_value(r["effect"], r["se"]),)], "p_value double"), "p_value", n=4)


def _drafted(s, d, treatment: str = "covis"):
    history, cases = _cases(s, d)
    m, pop = _once(_matrix_b(s, d)), _popular_b(s, d)
    lists = [C.top_k(C.baseline_scores(n, history, m), cases, pop).withColumnRenamed("run", c) for n, c in ((treatment, "treatment"), ("item2item", "control"))]
    return interleave.team_draft(lists[0].join(lists[1], "session").join(cases.select("session", "target"), "session"), "treatment", "control")


@query("""SELECT session, array_to_string(list_concat(items, list_transform(range(20 - len(items)), lambda x: -1)), ',') AS items, array_to_string(list_concat(team, list_transform(range(20 - len(items)), lambda x: 0)), ',') AS team FROM draft_b""")
def ab_team_draft(s, d):
    return _drafted(s, d).select("session", _line("items").alias("items"), _line("team").alias("team"))


@query("SELECT session, len(list_filter(team, lambda x: x = 1)) AS n_treatment, len(list_filter(team, lambda x: x = -1)) AS n_control FROM draft_b")
def ab_team_draft_one(s, d):
    """Picks of each team, by the version for one session."""
    rows = _drafted(s, d).select("session", "treatment", "control", F.sha2(F.concat_ws(":", F.lit("0"), F.col("session").cast("string")), 256).alias("h"))

    def run(batches):
        for pdf in batches:
            teams = [interleave.team_draft_one(a, b, [(int(h, 16) >> i) & 1 for i in range(S.K)], S.K)[1] for a, b, h in zip(pdf["treatment"], pdf["control"], pdf["h"], strict=True)]
            yield pdf[["session"]].assign(n_treatment=[t.count(1) for t in teams], n_control=[t.count(-1) for t in teams])

    return rows.mapInPandas(run, "session long, n_treatment long, n_control long")


@query(f"SELECT credit, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hits FROM (SELECT {DRAFT} AS credit, list_contains(items, target) AS hit FROM draft_b) GROUP BY credit")
def replay_interleave(s, d):
    """Credits and hits of the merged lists."""
    c = E.credit(F.col("items"), F.col("team"), F.col("target"))
    return _drafted(s, d).select(c.alias("credit"), F.array_contains("items", F.col("target")).alias("hit")).groupBy("credit").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hits"))


@query("SELECT session, CASE WHEN p = 0 THEN 0 WHEN p % 2 = 1 THEN 1 ELSE -1 END AS credit FROM (SELECT session, coalesce(list_position(run, target), 0) AS p FROM run_covis JOIN cb_pick USING (session))")
def ab_credit(s, d):
    run, cases = _run(s, d, "covis")
    team = F.transform(F.sequence(F.lit(1), F.lit(S.K)), lambda i: F.when(i % 2 == 1, 1).otherwise(-1))
    return run.join(cases.select("session", "target"), "session").select("session", E.credit(F.col("run"), team, F.col("target")).alias("credit"))


@query("""SELECT user_id, day, count(n)::BIGINT AS sessions, coalesce(sum(hit), 0)::BIGINT AS hit, coalesce(sum(hit_t), 0)::BIGINT AS hit_t, CAST(count(n) > 0 AS INT) AS active FROM
  (SELECT DISTINCT user_id FROM sess_b), (SELECT unnest(range(7))::INT AS day) LEFT JOIN (SELECT user_id AS u, day AS dd, hit, hit_t, 1 AS n FROM sess_b JOIN hits_b USING (session)) ON u = user_id AND dd <= day GROUP BY user_id, day""")
def ab_panel(s, d):
    return E.panel(_hits(s, d), 7, ("hit", "hit_t"))


@query("""SELECT user_id, day, sum(coalesce(n, 0)) OVER w AS events, sum(coalesce(carts, 0)) OVER w AS carts FROM (SELECT DISTINCT user_id FROM day_ev), (SELECT unnest(range(31))::INT AS day)
  LEFT JOIN (SELECT user_id AS u, CAST(date_diff('day', DATE '2024-01-01', CAST(event_time AS DATE)) AS INT) AS dd, count(*) AS n, count(*) FILTER (WHERE event_type = 1) AS carts FROM day_ev GROUP BY ALL) ON u = user_id AND dd = day
  WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def win_cum_panel(s, d):
    """Running sums by day on the dense grid of users and days."""
    ev = A.e_day(s, d).select("user_id", F.date_diff(F.col("event_time").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"), (F.col("event_type") == 1).cast("int").alias("carts"))
    return E.panel(ev, 31, ("carts",)).select("user_id", "day", F.col("sessions").alias("events"), "carts")


def _replayed(s, d):
    """(test, panel) of window B: cumulated hits and credits of each user and day, by share of treated sessions."""
    test = replay.test_of(S.SHARES, _X)
    credit = E.credit(F.col("items"), F.col("team"), F.col("target"))
    one = lambda t, c: _drafted(s, d, t).select("session", credit.alias(c))
    sessions = _hits(s, d).join(one("covis", "credit"), "session").join(one("item2item", "credit_aa"), "session")
    shown = E.dilution(_cases(s, d)[1], S.SHARES)
    return test, _once(replay.panel(sessions, shown, _before_b(s, d), S.SHARES, 7, _X))


_REPLICATES = 1000


@query()
def ab_simulate(s, d):
    """Every estimate of every day and share in bootstrap replicates with Poisson weights in both arms."""
    test, rows = _replayed(s, d)
    return bootstrap.simulate(rows, test, _REPLICATES)


@query("""SELECT a.share, a.day, a.users, round(a.ab, 6) AS ab, round(a.ab_se, 6) AS ab_se, round(q.pref, 6) AS il, round(q.pref_se, 6) AS il_se FROM (
  SELECT share, day, sum(n) AS users, sum(CASE arm WHEN 1 THEN r ELSE -r END) AS ab, sqrt(sum(v)) AS ab_se FROM arm_q GROUP BY share, day) a JOIN all_q q USING (share, day)""")
def ab_estimates(s, d):
    """The estimates of each day and share with the arms that users really have."""
    test, rows = _replayed(s, d)
    arms, out = replay.matrices(rows.withColumn("arm", E.assign(F.col("user_id"), S.SALT).cast("int")), test, "day", "arm"), []
    for day in sorted({k[0] for k in arms}):
        t, c = arms[day, 1], arms[day, 0]
        for q, got in zip(S.SHARES, test.estimates(t, c), strict=True):
            out.append((q, day, int(t[0, 0] + c[0, 0]), *(float(got[k]) for k in ("ab", "ab_se", "il", "il_se"))))
    return _r(s.createDataFrame(out, "share double, day int, users long, ab double, ab_se double, il double, il_se double"), "ab", "ab_se", "il", "il_se")


@query()
def ab_replicate_weights(s, d):
    """Weights of window B's users in both arms of the first ten replicates."""

    def run(batches):
        for pdf in batches:
            users = pdf["user_id"].to_numpy()
            for r in range(10):
                yield pdf[["user_id"]].assign(replicate=r, treatment=bootstrap.weights(users, r, 1), control=bootstrap.weights(users, r, 0))

    return _arms(s, d).select("user_id").mapInPandas(run, "user_id long, replicate int, treatment int, control int")


@query("SELECT session, user_id, day FROM sess_b")
def replay_sessions_of(s, d):
    return _hits(s, d).select("session", "user_id", "day")


@query("SELECT session, array_to_string(r.run, ',') AS control, array_to_string(t.run, ',') AS treatment FROM run_item2item r JOIN run_covis t USING (session)")
def replay_lists(s, d):
    one = lambda n, c: _run(s, d, n)[0].select("session", _line("run").alias(c))
    return one("item2item", "control").join(one("covis", "treatment"), "session")


@query("""SELECT session, q AS share FROM (SELECT session, row_number() OVER (ORDER BY sha256('0:' || session), session) - 1 AS place, count(*) OVER () AS n FROM cb_sess),
  (SELECT unnest([1.0, 0.5, 0.2, 0.1, 0.05]::DOUBLE[]) AS q) WHERE place < round(q * n)""")
def replay_dilution(s, d):
    return E.dilution(_cases(s, d)[1], S.SHARES)


@query("SELECT day, count(*) AS n, round(avg(hit_t) - avg(hit), 6) AS lift FROM sess_b JOIN hits_b USING (session) GROUP BY day")
def replay_truths(s, d):
    return _hits(s, d).groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg("hit_t") - F.avg("hit"), 6).alias("lift"))


_POINTS = (("after_first_day", 0), ("after_week", 6))
_AT = "CASE day WHEN 0 THEN 'after_first_day' ELSE 'after_week' END"


def _realised(s, d):
    test, rows = _replayed(s, d)
    return test, replay.matrices(rows.withColumn("arm", E.assign(F.col("user_id"), S.SALT).cast("int")), test, "day", "arm")


@query(f"SELECT {_AT} AS point, arm, n AS users, sn AS sessions, round(r, 4) AS recall FROM arm_q WHERE share = 1 AND day IN (0, 6)")
def realised(s, d):
    """The whole treatment as production would test it, by hashed arms: users, sessions and recall of both arms after the first day and the week."""
    test, arms = _realised(s, d)
    out = []
    for name, day in _POINTS:
        for arm, y in ((1, "t0"), (0, "c")):
            m = arms[day, arm]
            out.append((name, arm, int(m[0, 0]), int(m[0, 1]), float(test.ratio(m, y)[0])))
    return _r(s.createDataFrame(out, "point string, arm int, users long, sessions long, recall double"), "recall", n=4)


@query(f"""SELECT point, round(effect, 6) AS effect, round(se, 6) AS se, round(effect - {CDF.Z} * se, 6) AS lo, round(effect + {CDF.Z} * se, 6) AS hi, round({CDF.p('(effect / se)')}, 4) AS p FROM (
  SELECT {_AT} AS point, sum(CASE arm WHEN 1 THEN r ELSE -r END) AS effect, sqrt(sum(v)) AS se FROM arm_q WHERE share = 1 AND day IN (0, 6) GROUP BY day)""")
def tested(s, d):
    """The same as estimates with 95 % intervals and p-values, by the delta method."""
    test, arms = _realised(s, d)
    out = []
    for name, day in _POINTS:
        got = test.difference(arms[day, 1], arms[day, 0], "t0")
        row = replay.tested(float(got[""]), float(got["_se"]))
        out.append((name, *row.values()))
    return _r(_r(s.createDataFrame(out, "point string, effect double, se double, lo double, hi double, p double"), "effect", "se", "lo", "hi"), "p", n=4)


def _truths(s, d):
    test, rows = _replayed(s, d)
    return test, rows, replay.truths(replay.matrices(rows, test, "day"), test, S.SHARES)


@query(f"SELECT share, min(day + 1) FILTER (WHERE power >= 0.8) AS days_ab FROM (SELECT share, day, {CDF.power('(effect / se)')} AS power FROM all_q) GROUP BY share")
def first_day(s, d):
    """Days until an A/B test of each share would have 80 % power."""
    week = _truths(s, d)[2]
    out = [(q, replay.first_day([replay.powers(r)["ab"] for r in week if r["share"] == q])) for q in S.SHARES]
    return s.createDataFrame(out, "share double, days_ab int")


@query()
def cuped_summary(s, d):
    """By day: the variance that covariates remove, analytic on the control and measured over A/A replicates, and users saved."""
    test, rows, week = _truths(s, d)
    told = s.createDataFrame([(r["day"], r["reduction"], r["reduction"] * r["users"]) for r in week if r["share"] == 1.0], "day int, reduction_analytic double, users_saved double")
    measured = replay.simulated(bootstrap.simulate(rows, test, 200)).where("treatment = 't0'").select("day", "reduction_measured", "mean_ab", "mean_cuped")
    return told.join(measured, "day")


@query(f"""SELECT round(avg((credit = 1)::INT), 4) AS treatment_wins, round(avg((credit = -1)::INT), 4) AS control_wins, round(avg((credit = 0)::INT), 4) AS no_click, round(avg(hit::INT), 4) AS hit_rate,
  round(avg((aa = 1)::INT), 4) AS aa_first_wins, round(avg((aa = -1)::INT), 4) AS aa_second_wins FROM (SELECT session, {DRAFT} AS credit, list_contains(items, target) AS hit FROM draft_b) JOIN (SELECT session, {DRAFT} AS aa FROM draft_aa) USING (session)""")
def interleaving_summary(s, d):
    """Shares of sessions that each team wins, the merged lists' hit rate, and the control interleaved with itself."""
    c = E.credit(F.col("items"), F.col("team"), F.col("target"))
    a = _drafted(s, d).select("session", c.alias("credit"), F.array_contains("items", F.col("target")).alias("hit"))
    j = a.join(_drafted(s, d, "item2item").select("session", c.alias("aa")), "session")
    share = lambda x, n: F.round(F.avg(x.cast("int")), 4).alias(n)
    return j.agg(share(F.col("credit") == 1, "treatment_wins"), share(F.col("credit") == -1, "control_wins"), share(F.col("credit") == 0, "no_click"), share(F.col("hit"), "hit_rate"), share(F.col("aa") == 1, "aa_first_wins"), share(F.col("aa") == -1, "aa_second_wins"))


@query()
def sensitivity(s, d):
    """By share: days to 80 % power and users that each design needs, and how many times as many an A/B test does."""
    rows = replay.sensitivity(_truths(s, d)[2])
    return s.createDataFrame([tuple(r.values()) for r in rows], "share double, days_ab int, days_ab_cuped int, days_interleaving int, users_ab double, users_ab_cuped double, users_interleaving double, ab_over_interleaving double, ab_over_cuped double")


@query(f"SELECT 'covis' AS model, recall_20 AS published, recall_20 AS replayed, TRUE AS same FROM ({metrics('run_covis', 'cb_pick')}) UNION ALL SELECT 'item2item', recall_20, recall_20, TRUE FROM ({metrics('run_item2item', 'cb_pick')})")
def sample_check(s, d):
    """Recall of both lists in the replay against that of the baselines' table."""
    hits = _hits(s, d).agg(F.round(F.avg("hit_t"), 4).alias("covis"), F.round(F.avg("hit"), 4).alias("item2item"))
    replayed = hits.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("replayed")) for m in ("covis", "item2item")))).alias("r")).select("r.*")
    return baselines_table(s, d).select("model", F.col("recall_20").alias("published")).join(replayed, "model").withColumn("same", F.col("published") == F.col("replayed"))


@query()
def analyse(s, d):
    """By day and share: truths, analytic and simulated power of the three designs, and their error where both arms are the control."""
    test, rows, week = _truths(s, d)
    keys = [*week[0], *replay.powers(week[0])]
    kind = {"day": "int", "users": "long", "sessions": "long"}
    told = s.createDataFrame([(*r.values(), *replay.powers(r).values()) for r in week], ", ".join(f"{k if k in week[0] else 'power_' + k} {kind.get(k, 'double')}" for k in keys))
    share = F.element_at(F.array(*map(F.lit, S.SHARES)), F.substring("treatment", 2, 2).cast("int") + 1)
    rejects = replay.simulated(bootstrap.simulate(rows, test, _REPLICATES)).withColumn("share", share).drop("treatment")
    return told.join(rejects.select("day", "share", *(F.col(c).alias(f"simulated_{c}") for c in rejects.columns if c not in ("day", "share"))), ["day", "share"])


# -- drift


@query("""SELECT sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, round(sum(p * (2 * below + q))::DOUBLE / (2.0 * sum(p) * sum(q)), 6) AS auc FROM
  (SELECT p, q, sum(q) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) - q AS below FROM (SELECT round(price, 0) AS s, count(*) FILTER (WHERE event_type = 2) AS p, count(*) FILTER (WHERE event_type <> 2) AS q FROM day_ev GROUP BY 1))""")
def drift_auc(s, d):
    rows = A.e_day(s, d).select((F.col("event_type") == 2).cast("int").alias("y"), F.round("price", 0).alias("v"))
    return _r(drift.auc(rows, "y", "v"), "auc")


def _psi_sql(column: str) -> str:
    """Shares by bin of one column, before and from 2024-01-17."""
    return f"""SELECT '{column}' AS "column", round(sum((pb - pa) * ln(pb / pa)), 6) AS psi FROM (SELECT greatest(a / sum(a) OVER (), 1e-4) AS pa, greatest(b / sum(b) OVER (), 1e-4) AS pb FROM (
    SELECT len(list_filter(edges, lambda e: e <= {column})) AS bin, count(*) FILTER (WHERE event_time < TIMESTAMP '2024-01-17')::DOUBLE AS a, count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-17')::DOUBLE AS b
    FROM day_ev, (SELECT list_distinct(quantile_cont({column}::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM day_ev WHERE event_time < TIMESTAMP '2024-01-17') GROUP BY 1))"""


@query(f"{_psi_sql('price')} UNION ALL {_psi_sql('product_id')}")
def drift_psi(s, d):
    ev = A.e_day(s, d)
    return _r(drift.psi(ev.where(F.col("event_time") < F.lit(B)), ev.where(F.col("event_time") >= F.lit(B)), ["price", "product_id"]), "psi")


@query("SELECT seq FROM day_ev WHERE session IN (SELECT session FROM (SELECT DISTINCT session FROM day_ev) ORDER BY sha256('0:' || session), session LIMIT 300)")
def drift_cap(s, d):
    return drift.cap(A.e_day(s, d), "session", 300).select("seq")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_time, seq) - 1 AS pos FROM day_ev WHERE session IN (
    SELECT session FROM day_ev GROUP BY session HAVING min(event_time) >= TIMESTAMP '2024-01-24' AND min(event_time) < TIMESTAMP '2024-02-01')),
  p AS (SELECT session, pos AS cut, CAST((epoch_us(event_time) // 1000000 - epoch_us(TIMESTAMP '2024-01-24') // 1000000) // 86400 AS INT) AS day FROM o ORDER BY sha256('0:' || session || ':' || pos), session, pos LIMIT 500)
  SELECT session || ':' || cut AS request, day, o.seq, o.pos FROM o JOIN p USING (session) WHERE pos <= cut""")
def drift_requests(s, d):
    return drift.requests(A.e_day(s, d), *S.window("C"), 500).select("request", "day", "seq", "pos")


ORACLE_SQL["drift_requests"] = ORACLE_SQL["drift_requests"].replace("\nWITH o AS", ",\no AS")


_BROKEN = "('0x' || sha256('0:' || session)[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.25"


@query(f"""SELECT fault, seq, round(CASE WHEN broken AND fault = 'price_in_cents' THEN price * 100 ELSE price END, 4) AS price, CASE WHEN broken AND fault = 'time_in_ms' THEN 1000 ELSE 1 END * (epoch_us(event_time) // 1000000) AS ts,
  CASE WHEN broken AND fault = 'brand_missing' THEN NULL ELSE brand END AS brand, CASE WHEN broken AND fault = 'category_missing' THEN NULL ELSE category_id END AS category_id, CASE WHEN broken AND fault = 'views_only' THEN 0 ELSE event_type END AS event_type
  FROM (SELECT *, {_BROKEN} AS broken FROM day_ev), (SELECT unnest(['{"','".join(drift.FAULTS)}']) AS fault)""")
def drift_faults(s, d):
    """Each fault in a quarter of the sessions."""
    ev, out = A.e_day(s, d), None
    for f in drift.FAULTS:
        rows = drift.faults(ev, f, 0.25).select(F.lit(f).alias("fault"), "seq", F.round("price", 4).alias("price"), F.unix_seconds("event_time").alias("ts"), "brand", "category_id", "event_type")
        out = rows if out is None else out.unionByName(rows)
    return out


def _requests(s, d, window: str, n: int | None = None, faults: bool = False):
    """Features of all requests of a window, or of n, scored with the tables before it: (request, day, variant, FEATURES); faults: also with each fault in each share of the sessions of day 1."""
    start, end = S.window(window)
    before = split.stats_events(A.e_day(s, d), window)
    rows = drift.requests(A.e_day(s, d), start, end, n).withColumn("variant", F.lit("clean"))
    if faults:
        rows = _once(rows)
        day = rows.where("day = 1")
        for f in drift.FAULTS:
            for share in drift.FAULT_SHARES:
                rows = rows.unionByName(drift.faults(day, f, share).withColumn("variant", F.lit(f"{f}:{share}")))
    rows = _once(rows.withColumn("origin", F.col("request")).withColumn("session", F.concat_ws("|", "variant", "request")))
    last = rows.groupBy("session", "origin", "variant").agg(F.max_by(F.struct("day", "event_time", "product_id"), "pos").alias("l"))
    cases = last.select("session", F.col("l.event_time").alias("cut_time"), F.col("l.product_id").alias("last_product"), F.lit(None).cast("long").alias("target"))
    got = features.build(rows.drop("request", "day", "variant", "origin"), cases, _once(covisit.build(before)), features.product_stats(before, start))
    return _once(got.join(last.select("session", F.col("origin").alias("request"), "variant", F.col("l.day").alias("day")), "session").select("request", "day", "variant", *S.FEATURES))


@query()
def drift_adversarial(s, d):
    """Day 1 with prices in cents in all sessions against day 0: AUC out of five folds by request, over the 24 features, with shares of gain and stability indexes."""
    rows = _requests(s, d, "C", 2000, faults=True)
    return drift.adversarial(rows.where("variant = 'clean' and day = 0"), rows.where("variant = 'price_in_cents:1.0'"))


@query()
def drift_evaluate(s, d):
    """Each day against the training week and against the first day, halves of the training week, each fault at each share, and windows that calibrate the threshold.

    The requests are all events of both windows' sessions, and the grid compares all of them; a window of the calibration is as many as the live check sees.
    """
    ref, rows = _requests(s, d, "B"), _requests(s, d, "C", faults=True)
    side = F.when(F.col("variant") == "clean", F.concat(F.lit("day"), F.col("day"))).otherwise(F.col("variant"))
    sided = _once(ref.select(F.concat(F.lit("half"), drift.halves(ref)).alias("side"), "request", *S.FEATURES).unionByName(rows.select(side.alias("side"), "request", *S.FEATURES)))
    train = ("half0", "half1")
    pairs = [("training_halves", ("half0",), ("half1",))]
    pairs += [(f"against_training:{k}", train, (f"day{k}",)) for k in range(8)] + [(f"against_first_day:{k}", ("day0",), (f"day{k}",)) for k in range(1, 8)]
    variants = [f"{f}:{x}" for f in drift.FAULTS for x in drift.FAULT_SHARES]
    pairs += [(f"fault:{v}", ("day0",), (v,)) for v in variants]
    current = [("clean", "day1"), *((v, v) for v in variants if v.endswith((":0.25", ":0.1")))]
    live = drift.windows(sided, [(f"window:{name}:{i}", "day0", cur) for name, cur in current for i in range(_REPEATS)], _once)
    return drift.grid(sided, pairs, _once).unionByName(drift.checks(live, most=drift.WINDOW)).drop("gains", "psis").withColumn("above", F.col("auc") > drift.THRESHOLD)


_REPEATS = 3  # windows of the calibration; each draws other requests


@query()
def drift_monitor(s, d):
    """A version goes live, its sample gives a baseline, days follow; then a version whose client sends prices in cents, half way."""
    rows = _requests(s, d, "C", 2000, faults=True)
    order = rows.where("variant = 'clean'").select("request", "day").distinct().withColumn("seq", F.row_number().over(Window.orderBy("day", "request")))  # 2000 rows
    clean = _once(rows.where("variant = 'clean'").join(order.select("request", "seq"), "request"))
    n = order.count()
    window = max(10, n // 6)
    monitor, out = drift.Monitor(_once, window=window, least=max(5, window // 2)), []
    upto = lambda k: clean.where(F.col("seq") <= k)
    broken = rows.where("variant = 'price_in_cents:1.0'")
    late = broken.join(broken.select("request").distinct().withColumn("seq", F.row_number().over(Window.orderBy("request")) + n), "request")  # 2000 rows at most
    steps = [("v1", upto(0)), ("v1", upto(window // 2)), ("v1", upto(window)), ("v1", upto(window + 3)), ("v1", upto(2 * window)), ("v1", clean.unionByName(late)), ("v2", clean.unionByName(late))]
    for i, (version, sampled) in enumerate(steps):
        got = monitor.step(version, sampled)
        out.append((i, version, got["state"], got.get("waiting"), got.get("auc"), got.get("top"), got.get("psi_top")))
    return s.createDataFrame(out, "step int, version string, state string, waiting long, auc double, top string, psi_top string")
