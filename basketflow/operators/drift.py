"""Feature drift: rank AUC, population stability, planted faults, the adversarial check and its monitor.

A live check compares two samples of requests of a bounded size, so one task holds it; a grid of checks is as
many groups of one job. grid() compares all requests of its sides: rows are binned and counted where they lie, and a
task holds the distinct binned rows of one check.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketflow.functions.boost import Trees
from basketflow.operators.split import order_hash
from basketflow.schemas import FEATURES

FAULTS = ("price_in_cents", "time_in_ms", "brand_missing", "category_missing", "views_only")
FAULT_SHARES = (1.0, 0.25, 0.1, 0.05)
WINDOW, LEAST, THRESHOLD = 1500, 300, 0.6
REPORT = "auc double, n_ref int, n_cur int, rows_ref int, rows_cur int, top string, top_share double, psi_top string, psi double, gains array<struct<feature:string,share:double>>, psis array<struct<feature:string,psi:double>>"


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties averaged. Scores are summed to distinct values first; their
    running counts come from 256 ranges of the value, each in its own task."""
    v = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    lo, hi = v.agg(F.min("s"), F.max("s")).first()
    part = F.floor((F.col("s") - F.lit(lo)) / F.lit(max((hi - lo) / 255, 1e-300))).cast("int") if lo is not None else F.lit(0)
    v = v.withColumn("part", part)
    sizes = v.groupBy("part").agg(F.sum("q").alias("nq"))
    before = sizes.select("part", (F.sum("nq").over(Window.orderBy("part")) - F.col("nq")).alias("before"))
    own = F.sum("q").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q")
    u = v.join(F.broadcast(before), "part").withColumn("below", own + F.col("before"))
    return u.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), (F.sum(F.col("p") * (2 * F.col("below") + F.col("q"))) / (2.0 * F.sum("p") * F.sum("q"))).alias("auc"))


def quantiles(long: DataFrame, cuts: list[float], parts: int = 256) -> DataFrame:
    """(column, total, edges): of rows (column, v) the values at these shares, linear between two, as numpy has them; nulls do not count.

    Values are counted once each; their running counts come from ranges of approximate quantiles, each
    numbered in its own task and offset by those before, so that no task holds a column.
    """
    v = long.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count("*").alias("n"))
    bounds = v.groupBy("column").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("bounds"), F.sum("n").alias("total"))
    v = v.join(F.broadcast(bounds), "column")  # a row a column
    v = v.withColumn("part", F.size(F.filter("bounds", lambda b: b < F.col("v"))))
    sizes = v.groupBy("column", "part").agg(F.sum("n").alias("m"))
    before = sizes.select("column", "part", (F.sum("m").over(Window.partitionBy("column").orderBy("part")) - F.col("m")).alias("before"))
    w = Window.partitionBy("column", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    v = v.join(F.broadcast(before), ["column", "part"]).withColumn("upto", F.col("before") + F.sum("n").over(w))
    rank = lambda q: F.lit(q) * (F.col("total") - 1)
    there = lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto"))
    found = [F.max(F.when(there(f(rank(q))), F.col("v"))).alias(f"q{i}{x}") for i, q in enumerate(cuts) for x, f in (("a", F.floor), ("b", F.ceil))]
    one = v.groupBy("column").agg(F.first("total").alias("total"), *found)
    part = [(F.col(f"q{i}b") - F.col(f"q{i}a")) * (rank(q) - F.floor(rank(q))) + F.col(f"q{i}a") for i, q in enumerate(cuts)]
    return one.select("column", "total", F.array(*part).alias("edges"))


def psi(ref: DataFrame, cur: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(column, psi): the reference's quantile bins and one for missing or non-finite values, floored at 1e-4."""
    finite = lambda c: F.abs(c) < F.lit(float("inf"))
    kind = lambda df, side: df.select(F.lit(side).alias("side"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("r")).select("side", "r.*")
    long = kind(ref, 0).unionByName(kind(cur, 1)).withColumn("v", F.when(finite(F.col("v")) & ~F.isnan("v"), F.col("v")))
    edges = quantiles(long.where("side = 0"), [i / bins for i in range(1, bins)]).select("column", F.array_sort(F.array_distinct("edges")).alias("edges"))
    bin_ = F.when(F.col("v").isNotNull(), F.size(F.filter("edges", lambda e: e <= F.col("v")))).otherwise(-1)
    counts = long.join(F.broadcast(edges), "column").groupBy("column", "edges", bin_.alias("bin")).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    total = Window.partitionBy("column")
    pa, pb = (F.greatest(F.col(c) / F.greatest(F.sum(c).over(total), F.lit(1)), F.lit(1e-4)) for c in ("a", "b"))
    return counts.select("column", ((pb - pa) * F.log(pb / pa)).alias("d")).groupBy("column").agg(F.sum("d").alias("psi"))


def cap(rows: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """At most n groups in a seeded order, with all their rows."""
    keep = rows.select(group).distinct().orderBy(order_hash(seed, F.col(group)), group).limit(n)
    return rows.join(keep, group, "left_semi")


def requests(events: DataFrame, start, end, n: int | None = None, seed: int = 0) -> DataFrame:
    """Prefix rows (request, session, day, pos, ...) of all events of the sessions that start in a range; n draws so many of them."""
    first = events.groupBy("session").agg(F.min("event_time").alias("first")).where((F.col("first") >= F.lit(start)) & (F.col("first") < F.lit(end))).select("session")
    w = Window.partitionBy("session").orderBy("event_time", "seq")
    own = events.join(first, "session", "left_semi").withColumn("pos", F.row_number().over(w) - 1)
    day = F.floor((F.unix_seconds("event_time") - F.unix_seconds(F.lit(start))) / 86400).cast("int")
    pick = own if n is None else own.orderBy(order_hash(seed, F.col("session"), F.col("pos")), "session", "pos").limit(n)
    pick = pick.select(F.concat_ws(":", "session", "pos").alias("request"), "session", F.col("pos").alias("cut"), day.alias("day"))
    return own.join(pick, "session").where("pos <= cut").drop("cut")


def faults(rows: DataFrame, fault: str, share: float, seed: int = 0) -> DataFrame:
    """One planted fault in a share of whole sessions."""
    h = F.conv(F.substring(order_hash(seed, F.col("session")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    change = {
        "price_in_cents": ("price", F.col("price") * 100), "time_in_ms": ("event_time", F.timestamp_seconds(F.unix_seconds("event_time") * 1000)), "brand_missing": ("brand", F.lit(None)),
        "category_missing": ("category_id", F.lit(None)), "views_only": ("event_type", F.lit(0)),
    }
    column, new = change[fault]
    return rows.withColumn(column, F.when(h < share, new.cast(rows.schema[column].dataType)).otherwise(F.col(column)))


def _index(ref: np.ndarray, cur: np.ndarray, bins: int = 10) -> float:
    """The stability index of one column of a sample."""
    known = ref[np.isfinite(ref)]
    edges = np.unique(np.quantile(known, np.arange(1, bins) / bins)) if len(known) else np.zeros(0)
    share = [np.maximum(np.bincount(np.where(np.isfinite(v), np.searchsorted(edges, v, "right") + 1, 0), minlength=len(edges) + 2) / max(1, len(v)), 1e-4) for v in (ref, cur)]
    return float(((share[1] - share[0]) * np.log(share[1] / share[0])).sum())


def _told_apart(y: np.ndarray, score: np.ndarray) -> float:
    """AUC of a sample, ties as halves."""
    s, n = pd.Series(score).rank().to_numpy(), y.sum()
    return float((s[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))) if 0 < n < len(y) else float("nan")


def checks(rows: DataFrame, columns: tuple[str, ...] = FEATURES, folds: int = 5, rounds: int = 30, most: int = 3000, seed: int = 0) -> DataFrame:
    """(check, REPORT) of rows (check, label 0 or 1, request, columns): how well trees tell the two sides apart, out of fold.

    All rows of a request are in one fold. At most `most` requests of each side of a check are drawn, by a
    seeded order; top and gains: shares of what splits gain; psi_top and psis: stability indexes, largest first.
    """
    w = Window.partitionBy("check", "label").orderBy(order_hash(seed, F.col("check"), F.col("request")), "request")
    drawn = rows.select("check", "label", "request").distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    kept = rows.select("check", "label", "request", *(F.col(c).cast("double").alias(c) for c in columns)).join(drawn, ["check", "label", "request"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "place", *columns])
        x = pdf[list(columns)].to_numpy(float)
        x = np.where(np.isinf(x), np.sign(x) * 1e30, x)
        y, fold = pdf["label"].to_numpy(float), pdf["place"].to_numpy() % folds
        score, gain = np.zeros(len(y)), np.zeros(len(columns))
        for k in range(folds):
            train = fold != k
            if train.any() and not train.all():
                trees = Trees(rounds).fit(x[train], y[train])
                score[~train] = trees.score(x[~train])
                gain += trees.gain
        n = [int(pdf.loc[pdf["label"] == k, "request"].nunique()) for k in (0, 1)]
        return _report(pdf["check"].iloc[0], _told_apart(y, score), [*n, int((y == 0).sum()), int((y == 1).sum())], gain, [_index(x[y == 0, i], x[y == 1, i]) for i in range(len(columns))], columns)

    return kept.groupBy("check").applyInPandas(one, f"check string, {REPORT}")


def _report(check: str, score_auc: float, n: list[int], gain: np.ndarray, psi_: list[float], columns: tuple[str, ...]) -> pd.DataFrame:
    """One row of REPORT; n: requests, then rows of both sides."""
    gain = gain / gain.sum() if gain.sum() else gain
    gains = sorted(((c, round(float(g), 6)) for c, g in zip(columns, gain, strict=True)), key=lambda v: (-v[1], v[0]))
    psis = sorted(((c, round(float(v), 6)) for c, v in zip(columns, psi_, strict=True)), key=lambda v: (-v[1], v[0]))
    out = (check, round(score_auc, 4), *n, *gains[0], *psis[0], [{"feature": c, "share": v} for c, v in gains], [{"feature": c, "psi": v} for c, v in psis])
    return pd.DataFrame([out], columns=["check", *(x.split()[0] for x in REPORT.split(", ")[:9]), "gains", "psis"])


def grid(rows: DataFrame, pairs: list[tuple[str, tuple[str, ...], tuple[str, ...]]], keep, columns: tuple[str, ...] = FEATURES, folds: int = 5, rounds: int = 30, bins: int = 64, seed: int = 0) -> DataFrame:
    """(check, REPORT) of pairs (check, reference sides, current sides) over all rows (side, request, columns); no request is left out.

    Columns have one set of quantile bins for all checks. Rows of a side and fold that are in the same bins are one row with its
    count, so that a task holds the distinct binned rows of a check, a byte a column. All rows of a request are in
    one fold, by its hash. `keep` writes a table and reads it back.
    """
    spark, d = rows.sparkSession, len(columns)
    fold = (F.conv(F.substring(order_hash(seed, F.lit("fold"), F.col("request")), 1, 6), 16, 10).cast("long") % folds).cast("int")
    bounded = lambda c: F.when(~F.isnan(c), F.greatest(F.least(F.col(c).cast("double"), F.lit(1e30)), F.lit(-1e30)))
    rows = rows.select("side", "request", fold.alias("fold"), *(bounded(c).alias(c) for c in columns))
    per = {r.side: (r.requests, r.n) for r in rows.groupBy("side").agg(F.count_distinct("request").alias("requests"), F.count("*").alias("n")).collect()}  # a row a side
    refs = sorted({ref for _, ref, _ in pairs})
    # quantile edges: "" of all sides for the trees, one set of deciles for each reference
    owners = F.array(F.lit(""), *(F.when(F.col("side").isin(*ref), F.lit(str(i))) for i, ref in enumerate(refs)))
    values = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))
    counted = keep(rows.select("side", F.explode(values).alias("x")).groupBy("side", "x.c", "x.v").agg(F.count("*").alias("n")))
    long = counted.where("v is not null").select(F.explode(F.filter(owners, lambda o: o.isNotNull())).alias("o"), "c", "v", "n")
    finite = long.where("o = '' or abs(v) < 1e30")
    cut = {(r.o, r.c): np.array(r.edges) for r in finite.groupBy("o", "c").applyInPandas(lambda pdf: _edges(pdf, 10 if pdf["o"].iloc[0] else bins), "o string, c string, edges array<double>").collect()}  # a row a column and reference
    edges, deciles = [cut.get(("", c), np.zeros(0)) for c in columns], [{c: cut.get((str(i), c), np.zeros(0)) for c in columns} for i in range(len(refs))]
    binned = counted.mapInPandas(lambda batches: _binned(batches, deciles), "side string, c string, ref int, bin int, n long").groupBy("side", "c", "ref", "bin").agg(F.sum("n").alias("n"))
    bin_counts = {(r.side, r.c, r.ref, r.bin): r.n for r in binned.collect()}  # sides x columns x references x 11

    def code(batches):
        for pdf in batches:
            codes = np.stack([np.where(np.isnan(v), 0, np.searchsorted(e, v, "right") + 1) for e, v in zip(edges, (pdf[c].to_numpy(float) for c in columns), strict=True)], 1).astype(np.uint8)
            yield pd.DataFrame({"side": pdf["side"], "fold": pdf["fold"], "codes": [r.tobytes() for r in codes]})

    coded = keep(rows.mapInPandas(code, "side string, fold int, codes binary").groupBy("side", "fold", "codes").agg(F.count("*").alias("n")))
    member = spark.createDataFrame([(i, label, side) for i, (_, *both) in enumerate(pairs) for label, sides in enumerate(both) for side in sides], "check int, label int, side string")
    each = coded.join(F.broadcast(member), "side").drop("side").withColumn("k", F.explode(F.array(*map(F.lit, range(folds)))))  # member: a row a check and side

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        check, k = int(pdf["check"].iloc[0]), int(pdf["k"].iloc[0])
        codes = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(-1, d)
        order = np.lexsort((codes.view(f"S{d}").ravel(), pdf["fold"].to_numpy(), pdf["label"].to_numpy()))
        y, n, train = pdf["label"].to_numpy(float)[order], pdf["n"].to_numpy()[order], pdf["fold"].to_numpy()[order] != k
        codes = codes[order]
        gain, score = np.zeros(d), np.zeros(int((~train).sum()))
        if train.any() and not train.all():
            trees = Trees(rounds, bins=bins).grow(codes[train], y[train], n[train])
            score, gain = trees.apply(codes[~train]), trees.gain
        s, at = np.unique(score, return_inverse=True)
        p, q = (np.bincount(at, n[~train] * (y[~train] == x), len(s)).astype(np.int64) for x in (1, 0))
        return pd.DataFrame([(check, k, gain, s, p, q)], columns=["check", "k", "gain", "s", "p", "q"])

    fitted = keep(each.groupBy("check", "k").applyInPandas(fit, "check int, k int, gain array<double>, s array<double>, p array<long>, q array<long>"))

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        name, ref, cur = pairs[int(pdf["check"].iloc[0])]
        s, p, q = (np.concatenate(list(pdf[c])) for c in ("s", "p", "q"))
        s, at = np.unique(s, return_inverse=True)
        p, q = np.bincount(at, p, len(s)), np.bincount(at, q, len(s))
        total = p.sum() * q.sum()
        score = float((p * (2 * (q.cumsum() - q) + q)).sum() / (2 * total)) if total else float("nan")
        i = refs.index(ref)
        counts = [[np.array([sum(bin_counts.get((side, c, i, x), 0) for side in sides) for x in range(len(deciles[i].get(c, ())) + 2)]) for c in columns] for sides in (ref, cur)]
        shares = [[np.maximum(v / max(1, v.sum()), 1e-4) for v in of] for of in counts]
        moved = [float(((b - a) * np.log(b / a)).sum()) for a, b in zip(*shares, strict=True)]
        n = [sum(per.get(side, (0, 0))[j] for side in sides) for j in (0, 1) for sides in (ref, cur)]
        return _report(name, score, n, np.sum(list(pdf["gain"]), 0), moved, columns)

    return fitted.groupBy("check").applyInPandas(report, f"check string, {REPORT}")


def windows(rows: DataFrame, pairs: list[tuple[str, str, str]], keep, most: int = WINDOW, seed: int = 0) -> DataFrame:
    """Rows (check, label, ...) of pairs (check, reference side, current side) as checks() draws them: `most` requests of each side, drawn before rows are joined."""
    member = rows.sparkSession.createDataFrame([(name, label, side) for name, *both in pairs for label, side in enumerate(both)], "check string, label int, side string")
    w = Window.partitionBy("check", "label").orderBy(order_hash(seed, F.col("check"), F.col("request")), "request")
    drawn = rows.select("side", "request").distinct().join(F.broadcast(member), "side").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return keep(rows.join(drawn.drop("place"), ["side", "request"]).drop("side"))


def _edges(pdf: pd.DataFrame, bins: int) -> pd.DataFrame:
    """Distinct quantile edges of one column's counted values, linear between two values."""
    v, at = np.unique(pdf["v"].to_numpy(float), return_inverse=True)
    upto = np.bincount(at, pdf["n"]).cumsum()
    rank = np.arange(1, bins) / bins * (upto[-1] - 1)
    low, high = (v[np.searchsorted(upto, f(rank), "right")] for f in (np.floor, np.ceil))
    return pd.DataFrame([(pdf["o"].iloc[0], pdf["c"].iloc[0], np.unique(low + (high - low) * (rank - np.floor(rank))))], columns=["o", "c", "edges"])


def _binned(batches, deciles: list[dict[str, np.ndarray]]):
    """(side, c, ref, bin, n) of counted values under each reference's deciles; bin 0 is of missing and infinite values."""
    for batch in batches:
        for (side, c), pdf in batch.groupby(["side", "c"]):
            v, n = pdf["v"].to_numpy(float), pdf["n"].to_numpy()
            v = np.where(np.abs(v) < 1e30, v, np.nan)
            for i, d in enumerate(deciles):
                counts = np.bincount(np.where(np.isnan(v), 0, np.searchsorted(d.get(c, np.zeros(0)), v, "right") + 1), n).astype(np.int64)
                yield pd.DataFrame({"side": side, "c": c, "ref": i, "bin": np.flatnonzero(counts), "n": counts[counts > 0]})


def adversarial(ref: DataFrame, cur: DataFrame, columns: tuple[str, ...] = FEATURES, **how) -> DataFrame:
    """One check of rows (request, columns) on two sides."""
    both = ref.select(F.lit(0).alias("label"), "request", *columns).unionByName(cur.select(F.lit(1).alias("label"), "request", *columns))
    return checks(both.withColumn("check", F.lit("check")), columns, **how).drop("check")


def halves(rows: DataFrame, seed: int = 0):
    """0 or 1 of a row's request, drawn by its hash."""
    return F.conv(F.substring(order_hash(seed, F.lit("half"), F.col("request")), 1, 6), 16, 10).cast("long") % 2


@dataclass
class Monitor:
    """The live check over sampled requests (request, seq, columns), seq rising with time.

    A new version drops what was sampled before it; the first `window` requests after that are its baseline; from then on
    the latest `window`, once there are `least`, are checked against it. The baseline is a table that
    `keep` writes and reads back.
    """

    keep: object
    columns: tuple[str, ...] = FEATURES
    window: int = WINDOW
    least: int = LEAST
    threshold: float = THRESHOLD
    version: str | None = None
    since: int = -1
    baseline: DataFrame | None = None

    def _latest(self, sampled: DataFrame) -> DataFrame:
        """The newest requests, by the last seq of each."""
        newest = sampled.groupBy("request").agg(F.max("seq").alias("last")).orderBy(F.desc("last"), "request").limit(self.window)
        return sampled.join(newest, "request")

    def step(self, version: str, sampled: DataFrame) -> dict:
        """state: new_version, collecting, baseline, ok or alert; with auc, top and psi_top after a check."""
        if version != self.version:
            self.version, self.baseline = version, None
            self.since = sampled.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
            return {"state": "new_version"}
        fresh = sampled.where(F.col("seq") > self.since)
        waiting = fresh.select("request").distinct().count()
        if self.baseline is None:
            if waiting < self.window:
                return {"state": "collecting", "waiting": waiting}
            self.baseline = self.keep(self._latest(fresh).drop("last"))
            self.since = fresh.agg(F.max("seq")).first()[0]
            return {"state": "baseline", "waiting": waiting}
        if waiting < self.least:
            return {"state": "collecting", "waiting": waiting}
        got = adversarial(self.baseline, self._latest(fresh), self.columns, most=self.window).first()
        return {"state": "alert" if got["auc"] > self.threshold else "ok", "waiting": waiting, **{k: got[k] for k in ("auc", "top", "psi_top", "psi")}}
