"""Keyed, bounded session state: the last events of each session, and how many there are.

The state of a key is one list of encoded events, cut to the newest CAP, with a time to live.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basketflow import schemas as S
from basketflow.operators.drift import quantiles
from basketflow.operators.split import order_hash
from basketflow.sources.versions import Versions

TTL_MS = 1_800_000
CODE = "struct<s:long,e:string,sent:double>"


def encode(df: DataFrame) -> DataFrame:
    """(session, value): the JSON message {s, e: [time, type, product, category, brand, price]}."""
    e = F.array(F.unix_seconds("event_time").cast("string"), F.col("event_type").cast("string"), F.col("product_id").cast("string"), F.col("category_id").cast("string"), F.col("brand"), F.col("price").cast("string"))
    return df.select("session", "seq", F.to_json(F.struct(F.col("session").alias("s"), e.alias("e")), {"ignoreNullFields": "false"}).alias("value"))


def decode(df: DataFrame) -> DataFrame:
    m = df.select("seq", F.from_json("value", "s long, e array<string>").alias("m"))
    at = lambda i, t: F.element_at("m.e", i).cast(t)
    return m.select(F.col("m.s").alias("session"), "seq", F.timestamp_seconds(at(1, "long")).alias("event_time"), at(2, "int").alias("event_type"), at(3, "long").alias("product_id"), at(4, "long").alias("category_id"), at(5, "string").alias("brand"), at(6, "double").alias("price"))


def last_events(events: DataFrame, cap: int = S.CAP) -> DataFrame:
    """The same state from a batch: (session, n_kept, products) of the newest events by seq, oldest first."""
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    rows = events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap)
    got = rows.groupBy("session").agg(F.count("*").alias("n_kept"), F.array_sort(F.collect_list(F.struct("seq", "product_id"))).alias("x"))
    return got.select("session", "n_kept", F.array_join(F.transform("x", lambda v: v["product_id"].cast("string")), ",").alias("products"))


class KeepLast(StatefulProcessor):
    def __init__(self, cap: int = S.CAP, ttl_ms: int | None = TTL_MS):
        self.cap, self.ttl = cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "seq long, product_id long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.events.get()] if self.events.exists() else []
        for pdf in rows:
            held += list(zip(pdf["seq"].tolist(), pdf["product_id"].tolist(), strict=True))
        held = sorted(held)[-self.cap :]
        self.events.put(held)
        yield pd.DataFrame({"session": [key[0]], "n_kept": [len(held)], "products": [",".join(str(p) for _, p in held)]})

    def close(self) -> None:
        pass


def stream_state(events: DataFrame, cap: int = S.CAP, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """Streaming (session, n_kept, products) after each micro-batch; needs the RocksDB state store."""
    return events.select("session", "seq", "product_id").groupBy("session").transformWithStateInPandas(
        statefulProcessor=KeepLast(cap, ttl_ms), outputStructType="session long, n_kept long, products string", outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime"
    )


def staleness(rows: DataFrame, sent: str, done: str) -> DataFrame:
    """(n, p50, p95, p99): milliseconds from sent to readable, both in seconds; no row without any."""
    ms = (F.col(done).cast("double") - F.col(sent).cast("double")) * 1000
    got = quantiles(rows.select(F.lit("ms").alias("column"), ms.alias("v")), [0.5, 0.95, 0.99])
    return got.select(F.col("total").alias("n"), *(F.element_at("edges", i + 1).alias(c) for i, c in enumerate(("p50", "p95", "p99"))))


def partition(session, partitions: int = 6):
    """The partition of a topic that a session's messages go to."""
    return (F.crc32(session.cast("string").cast("binary")) % partitions).cast("int")


def lag(published: DataFrame, positions: DataFrame) -> DataFrame:
    """(partitions, lag): messages (partition, offset) that lie behind a consumer's positions (partition, position); one without is at 0."""
    high = published.groupBy("partition").agg((F.max("offset") + 1).alias("high"))
    behind = F.greatest(F.col("high") - F.coalesce("position", F.lit(0)), F.lit(0))
    return high.join(positions, "partition", "left").agg(F.count("*").alias("partitions"), F.sum(behind).alias("lag"))


def progress_lag(progress: dict) -> int:
    """The same of a running query's progress whose source reports offsets by topic and partition."""
    total = 0
    for source in progress["sources"]:
        end, latest = (json.loads(x) if isinstance(x, str) else x for x in (source.get("endOffset") or {}, source.get("latestOffset") or {}))
        total += sum(max(0, n - end.get(topic, {}).get(p, 0)) for topic, parts in latest.items() for p, n in parts.items())
    return total


def due(events: DataFrame, speed: float) -> DataFrame:
    """Adds due, the seconds after the start at which a replay at this speed publishes an event."""
    first = events.agg(F.min(F.unix_seconds("event_time")).alias("t0"))
    return events.crossJoin(F.broadcast(first)).withColumn("due", (F.unix_seconds("event_time") - F.col("t0")) / F.lit(float(speed))).drop("t0")  # one row


def replay(events: DataFrame, path: str, speed: float, step: float = 1.0) -> int:
    """Publishes recorded events to a folder as messages (session, seq, value, sent), a file a step, each when it is due; gives the number of steps."""
    rows = due(events, speed)
    last = rows.agg(F.max("due")).first()[0]
    began, n = time.time(), 0
    while last is not None and n * step <= last:
        time.sleep(max(0.0, began + n * step - time.time()))
        part = rows.where((F.col("due") >= n * step) & (F.col("due") < (n + 1) * step))
        encode(part).withColumn("sent", F.lit(time.time())).write.mode("append").parquet(path)
        n += 1
    return n


def sample(requests: DataFrame, share: float, most: int, seed: int = 0) -> DataFrame:
    """A share of requests (request, seq, ...), drawn by their hash, of which the newest `most` stay."""
    h = F.conv(F.substring(order_hash(seed, F.col("request")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return requests.where(h < share).orderBy(F.desc("seq"), "request").limit(most)


class Sampler:
    """Appends a share of each micro-batch's requests to a capped table; a batch that cannot be written is dropped and counted."""

    def __init__(self, path: str, share: float, most: int, seed: int = 0):
        self.path, self.share, self.most, self.seed, self.dropped = path, share, most, seed, 0

    def record(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        try:
            sample(batch, self.share, self.most, self.seed).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        except Exception:  # noqa: BLE001  monitoring never fails a request
            self.dropped += 1

    def rows(self, spark) -> DataFrame:
        return spark.read.parquet(self.path).drop("batch").orderBy(F.desc("seq"), "request").limit(self.most)


class SessionStore:
    """Sessions' last events as a versioned table: each batch appends, keeps the newest CAP of a session and drops sessions that have been still for the time to live."""

    def __init__(self, spark, path: str, cap: int = S.CAP, ttl: int = TTL_MS // 1000):
        self.spark, self.versions, self.cap, self.ttl = spark, Versions(spark, path), cap, ttl

    def append(self, batch: DataFrame, number: int) -> None:
        """batch: events; a batch of a number that is there already adds nothing. For foreachBatch."""
        name = f"{number:012d}"
        if (self.versions.current() or "") >= name:
            return
        new = batch.select("session", "seq", "product_id", F.unix_seconds("event_time").alias("time"))
        both = new if self.versions.current() is None else self.versions.table("events").unionByName(new)
        w = Window.partitionBy("session").orderBy(F.desc("seq"))
        last = F.max("time").over(Window.partitionBy("session"))
        now = new.agg(F.max("time").alias("now"))
        kept = both.withColumns({"r": F.row_number().over(w), "last": last}).where(F.col("r") <= self.cap).crossJoin(F.broadcast(now))  # one row
        kept = kept.where(F.col("last") >= F.coalesce(F.col("now"), F.col("last")) - self.ttl).select("session", "seq", "product_id", "time")
        self.versions.publish(self.versions.build(name, {"events": kept}, {"batch": number}))

    def sessions(self) -> DataFrame:
        """(session, n_kept, products), oldest first."""
        rows = self.versions.table("events").groupBy("session").agg(F.count("*").alias("n_kept"), F.array_sort(F.collect_list(F.struct("seq", "product_id"))).alias("x"))
        return rows.select("session", "n_kept", F.array_join(F.transform("x", lambda v: v["product_id"].cast("string")), ",").alias("products"))
