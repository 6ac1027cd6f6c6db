"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents of one shingle set are one class. Every class orders its shingles alike: those of
few documents first by hash, then the frequent ones by document frequency. A pair that is
similar enough shares a shingle in its first n - need + 1, and at least l in its first
n - need + l. Each class picks l by its estimated cost: the frequencies in that prefix (list
entries to read) and their sum over l (at most so many candidates reach l matches and are
verified). A pair with l1 and l2 must share min(l1, l2) shingles of that level.

Candidates come in two rounds, so that copies which their leader links make no pairs. In the
first each class meets only the leader of a shingle's list: of those of about its own size the
one with the largest share of frequent shingles, in a group of copies the least edited.
Verified links make components. In the second, pairs that are still in different components meet in
the lists that hold several, in the shortest they share and only where enough more are to come
for both; verified again. Every link is thus found or is inside a component.
Frequencies come from all documents; the broadcast part of them is the most frequent
MOST_FREQUENT shingles at most, which bounds it at any size. The order affects cost only,
never the result.

Defined results: a text without words has no shingles and is its own component; a null doc_id
never names a component unless it is alone; repeated rows come back as often as they are there,
and rows of one doc_id with different texts are judged each; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketflow.llm import shingles
from basketflow.llm.components import components
from basketflow.llm.store import forget, held, written

NEED = 75
MOST_FREQUENT = 1 << 20
LEAST_FREQUENT = 8
LEVELS = 8
#: Cost of verifying a candidate's shingle against that of reading one list entry.
VERIFY = 0.05
#: Shingles of a range of hashes that one task holds, and the most bits that name a range (for some 3e13 shingles).
RANGE = 1 << 21
MOST_BITS = 24
_FLUSH = 1 << 20
#: Classes of a list that meet those of another block of it in one task.
BLOCK = 1 << 12


def _need(n, percent: int):
    return -(-percent * n // 100)


def _classes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(len(s), shingles.set_key(s) if len(s) else 0) for _, s in shingles.sets(b.column(1))]
            n, k = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), b.column(2)], ["doc_id", "n_shingles", "k", "h"])

    return run


def _cut(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted tokens: the ranges of 2**bits that have any, where each starts (and the end), and the next 32 bits of each token."""
    r = (tokens >> np.uint64(64 - bits)).astype(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    return r[starts], np.append(starts, len(tokens)), ((tokens << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, high bytes together: sorted values then compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _counted(bits: int):
    """Rows (r, blob) with the distinct shingle tokens of each run of documents and their counts."""

    def rows(tokens: list[np.ndarray]):
        u, c = np.unique(np.concatenate(tokens) >> np.uint64(32 - bits) << np.uint64(32 - bits), return_counts=True)
        r, starts, low = _cut(u, bits)
        c = c.astype(np.uint32)
        blobs = [struct.pack("<I", b - a) + _planes(low[a:b]) + _planes(c[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(blobs, pa.binary())], ["r", "blob"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, s in shingles.sets(b.column(0)):
                held.append(s)
                size += len(s)
                if size >= max(4 * _FLUSH, 1 << bits):
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return run


def _frequent(bits: int, least: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r, low, count = key[0].as_py(), [], []
        for blob in table.column("blob").to_pylist():
            n = struct.unpack_from("<I", blob)[0]
            low.append(_unplanes(blob[4 : 4 + 4 * n], np.uint32))
            count.append(_unplanes(blob[4 + 4 * n :], np.uint32))
        u, at = np.unique(np.concatenate(low), return_inverse=True)
        df = np.bincount(at, weights=np.concatenate(count)).astype(np.int64)
        keep = df >= least
        token = (np.uint64(r) << np.uint64(64 - bits)) | (u[keep].astype(np.uint64) << np.uint64(32 - bits))
        return pa.table([pa.array(token.view(np.int64), pa.int64()), pa.array(df[keep], pa.int64())], names=["token", "df"])

    return run


def _frequencies(docs: DataFrame, total: int, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, at most so many, and their document frequencies."""
    blobs = docs.select("text").mapInArrow(_counted(bits), "r int, blob binary")
    found = held(blobs.groupBy("r").applyInArrow(_frequent(bits, LEAST_FREQUENT), "token long, df long"))
    sizes = {x["b"]: x["n"] for x in found.groupBy(F.floor(F.log2("df")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    least, n = 64, 0
    while least - 1 in range(64) and n + sizes.get(least - 1, 0) <= most:
        least -= 1
        n += sizes.get(least, 0)
    got = found.where(F.col("df") >= (1 << least)).toArrow() if n else None
    found.unpersist()
    if got is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    token, df = got.column("token").to_numpy().view(np.uint64), got.column("df").to_numpy()
    order = np.argsort(token)
    return token[order], df[order]


def prefix(s: np.ndarray, df: np.ndarray, percent: int = NEED, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of a class's prefix, the level of each, and its number of matches to require; df is 1 for rare tokens."""
    n = len(s)
    need = _need(n, percent)
    order = np.lexsort((s, df))
    first = n - need + 1
    cost = np.cumsum(df[order])
    ls = np.arange(1, min(levels, need, n - first + 1) + 1)
    entries = cost[first + ls - 2]
    level = int(ls[np.argmin(entries + VERIFY * n * entries / ls)]) if entries[0] > 4 * first else 1
    take = order[: first + level - 1]
    return s[take], np.maximum(1, np.arange(len(take)) - first + 2).astype(np.uint8), level


def _prefixes(bits: int, frequent, percent: int):
    def rows(held):
        keys, ns, ls, cs, tokens, levels = zip(*held, strict=True)
        at = np.repeat(np.arange(len(held), dtype=np.uint32), [len(t) for t in tokens])
        t, lev = np.concatenate(tokens), np.concatenate(levels)
        order = np.argsort(t, kind="stable")
        r, starts, low = _cut(t[order], bits)
        at, lev = at[order], lev[order]
        k, n, lv, cen = np.array(keys, np.int64), np.array(ns, np.uint32), np.array(ls, np.uint8), np.array(cs, np.uint8)
        blobs = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            u, own = np.unique(at[a:b], return_inverse=True)
            blobs.append(struct.pack("<II", b - a, len(u)) + k[u].tobytes() + n[u].tobytes() + lv[u].tobytes() + cen[u].tobytes() + _planes(low[a:b]) + _planes(own.astype(np.uint32)) + lev[a:b].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(blobs, pa.binary())], ["r", "blob"])

    def run(batches):
        token, counts = frequent.value
        held, seen, size = [], set(), 0
        for b in batches:
            for _, s in shingles.sets(b.column(0)):
                if not len(s) or (key := shingles.set_key(s)) in seen:
                    continue
                seen.add(key)
                df = np.ones(len(s), np.int64)
                if len(token):
                    cut = s >> np.uint64(32 - bits) << np.uint64(32 - bits)
                    i = np.minimum(np.searchsorted(token, cut), len(token) - 1)
                    df = np.where(token[i] == cut, counts[i], df)
                t, lev, level = prefix(s, df, percent)
                held.append((key, len(s), level, int(255 * (df > 1).mean()), t, lev))
                size += len(t)
                if size >= _FLUSH:
                    yield rows(held)
                    held, seen, size = [], set(), 0
        if held:
            yield rows(held)

    return run


_LISTS = "b long, k long, n int, l int, lev int, lk long, ln int, ll int, llev int"


def _lists(percent: int):
    """Of one range's blobs: the lists of two classes or more, each row with the leader of its list and size band."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cols = [[] for _ in range(6)]
        for blob in table.column("blob").to_pylist():
            c, d = struct.unpack_from("<II", blob)
            at = 8
            k = np.frombuffer(blob, np.int64, d, at)
            n = np.frombuffer(blob, np.uint32, d, at + 8 * d)
            lv = np.frombuffer(blob, np.uint8, d, at + 12 * d)
            cen = np.frombuffer(blob, np.uint8, d, at + 13 * d)
            at += 14 * d
            own = _unplanes(blob[at + 4 * c : at + 8 * c], np.uint32)
            for x, v in zip(cols, (_unplanes(blob[at : at + 4 * c], np.uint32), k[own], n[own], lv[own], np.frombuffer(blob, np.uint8, c, at + 8 * c), cen[own]), strict=True):
                x.append(v)
        t, k, n, lv, lev, cen = map(np.concatenate, cols)

        def only(keep):
            return t[keep], k[keep], n[keep], lv[keep], lev[keep], cen[keep]

        t, k, n, lv, lev, cen = only(np.lexsort((k, t)))
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        t, k, n, lv, lev, cen = only(new)
        edge = np.ones(len(t) + 1, bool)
        edge[1:-1] = t[1:] != t[:-1]
        t, k, n, lv, lev, cen = only(~(edge[:-1] & edge[1:]))
        band = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int64) if percent < 100 else n.astype(np.int64)
        order = np.lexsort((k, 255 - cen.astype(np.int64), band, t))
        t, k, n, lv, lev, cen = only(order)
        band = band[order]
        head = np.ones(len(t), bool)
        head[1:] = (t[1:] != t[:-1]) | (band[1:] != band[:-1])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))
        b = (np.int64(key[0].as_py()) << np.int64(32)) | t.astype(np.int64)
        out = [b, k, n, lv, lev, k[lead], n[lead], lv[lead], lev[lead]]
        return pa.table([pa.array(x, pa.int64() if i in (0, 1, 5) else pa.int32()) for i, x in enumerate(out)], names=[x.split()[0] for x in _LISTS.split(", ")])

    return run


def _similar(percent: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                both, linked = [], []
                for (_, x), (_, y) in zip(shingles.sets(b.column(2)), shingles.sets(b.column(3)), strict=True):
                    both.append(len(np.intersect1d(x, y, assume_unique=True)))
                    linked.append(100 * both[-1] >= percent * (len(x) + len(y) - both[-1]))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"])

    return run


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with the size of their intersection and whether they link, from whole texts."""
    pairs = written(pairs.select("a", "b"), "pairs", narrow=True)
    used = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
    texts = written(docs.join(reps.join(used, "k"), ["doc_id", "h"]).groupBy("k").agg(F.min("text").alias("text")), "texts")
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b")
    out = written(both.select("a", "b", "ta", "tb").mapInArrow(_similar(percent), "a long, b long, both long, linked boolean"), "links", narrow=True)
    forget(texts)
    forget(pairs)
    return out


def _near(percent: int):
    return 100 * F.least("na", "nb").cast("long") >= percent * F.greatest("na", "nb").cast("long")


def _matched(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from list rows (a, na, la, leva, b, nb, lb, levb) that share as many tokens as they must."""
    m = F.least("la", "lb")
    pairs = rows.where(_near(percent)).groupBy("a", "b", "la", "lb").agg(F.count_if(F.greatest("leva", "levb") <= m).alias("cm"))
    return pairs.where(F.col("cm") >= m).select("a", "b")


def _crossing(own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that may link, from own (t, k, n, l, c, p, i, size): every list that holds several components.

    Beyond the shorter reach of two prefixes at most need - l tokens are left, so of the least
    intersection so many must be among the lists that both are in. Each class orders its lists
    alike, the shortest first; a pair that shares r lists shares its first one where both have
    r - 1 or more to come, and the pair is made there only: the long lists, which come last,
    make pairs for classes that share many others. Where both were compared with one
    pivot (pa = pb, ia and ib in common with it), they share at most the smaller of what they
    have in the pivot and the smaller of what they have beside it. All this is in the
    condition of the join. A list of many classes is dealt out in blocks, each of which meets each.
    """
    mine = Window.partitionBy("k")
    own = own.withColumn("rest", F.count("*").over(mine) - F.row_number().over(mine.orderBy("size", "t")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine, all_ = F.pmod(F.hash("k"), blocks), F.explode(F.sequence(F.lit(0), blocks - 1))
    sides = zip("ab", ((mine, all_), (all_, mine)), strict=True)
    left, right = (own.select("t", i.alias("u"), j.alias("v"), F.col("k").alias(x), *(F.col(y).alias(y + x) for y in ("n", "l", "c", "p", "i", "rest"))) for x, (i, j) in sides)
    beyond = F.greatest(*(F.expr(f"(n{x} * {percent}L + 99) div 100 - l{x}") for x in "ab"))
    least = F.expr(f"((na + nb) * {percent}L + {99 + percent}) div {100 + percent}")
    most = F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    pivoted = F.coalesce((F.col("pa") == F.col("pb")) & (most < least), F.lit(False))
    must = F.greatest(F.least("la", "lb"), least - beyond)
    met = (left.t == right.t) & (left.u == right.u) & (left.v == right.v) & (F.col("ca") < F.col("cb")) & _near(percent) & (F.least("resta", "restb") + 1 >= must) & ~pivoted
    return left.join(right, met).select("a", "b").distinct()


def _pivots(star: DataFrame, classes: DataFrame) -> DataFrame:
    """(k, p, i): of each class that was compared, the leader p with the most members among those it met, itself included, and the size i of what they share."""
    size = star.groupBy("a").agg(F.count("*").alias("m"))
    itself = size.join(classes.where("n_shingles > 0").select(F.col("k").alias("a"), F.col("n_shingles").alias("both")).distinct(), "a").select(F.col("a").alias("k"), "a", "both", "m")
    met = star.join(size, "a").select(F.col("b").alias("k"), "a", "both", "m").unionByName(itself)
    return met.groupBy("k").agg(F.max_by(F.struct("a", "both"), F.struct("m", "a")).alias("x")).select("k", F.col("x.a").alias("p"), F.col("x.both").alias("i"))


def join(docs: DataFrame, percent: int = NEED, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """documents (doc_id, text) to (doc_id, n_shingles, component_id): one row per row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    spark = docs.sparkSession
    one = written(docs.mapInArrow(_classes(percent), "doc_id long, n_shingles long, k long, h long"), "classes", narrow=True)
    total = one.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(MOST_BITS, max(4, int(total // RANGE).bit_length()))
    reps = one.where("n_shingles > 0 and doc_id is not null").groupBy("k").agg(F.min(F.struct("doc_id", "h")).alias("d")).select("k", "d.*")  # rows of one id may differ
    frequent = spark.sparkContext.broadcast(_frequencies(docs, total, bits, most_frequent))
    blobs = docs.select("text").mapInArrow(_prefixes(bits, frequent, percent), "r int, blob binary")
    lists = written(blobs.groupBy("r").applyInArrow(_lists(percent), _LISTS), "lists", narrow=True)
    frequent.destroy()
    star = lists.where("k <> lk").select(F.col("lk").alias("a"), F.col("ln").alias("na"), F.col("ll").alias("la"), F.col("llev").alias("leva"), F.col("k").alias("b"), F.col("n").alias("nb"), F.col("l").alias("lb"), F.col("lev").alias("levb"))
    links = _verified(_matched(star, percent), reps, docs, percent)
    labels = components(links.where("linked"))
    pivots = _pivots(links, one)
    own = lists.select(F.col("b").alias("t"), "k", "n", "l").join(labels, "k", "left").withColumn("c", F.coalesce("c", "k"))
    mixed = own.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("t", "size")
    own = written(own.join(mixed, "t").join(pivots, "k", "left"), "mixed", narrow=True)
    more = _verified(_crossing(own, percent), reps, docs, percent)
    joined = more.where("linked").join(labels.select(F.col("k").alias("a"), F.col("c").alias("ca")), "a", "left").join(labels.select(F.col("k").alias("b"), F.col("c").alias("cb")), "b", "left")
    higher = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    labels = labels.unionByName(higher.join(labels, "k", "left_anti").select("k", F.col("k").alias("c")))
    labels = labels.join(higher.select(F.col("k").alias("c"), F.col("c").alias("top")), "c", "left").select("k", F.coalesce("top", "c").alias("c"))
    members = held(reps.join(labels, "k", "left").select("k", "doc_id", F.coalesce("c", "k").alias("c")))
    least = written(members.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least", narrow=True)  # a table without partitioning, so that the join can split a large component
    named = written(members.join(least, "c").select("k", "component_id"), "names", narrow=True)
    members.unpersist()
    for x in (lists, links, own, more, least):
        forget(x)
    return one.join(named, "k", "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"))
