"""Language identification by rank-order profiles of character n-grams.

Words are runs of letters, lower-cased and padded with one space; a text's profile is its
TOP most frequent 1- to 3-grams in order of count (ties by code points). A language's profile
comes from the summed counts of all its labelled texts. The out-of-place distance adds, over a
text's n-grams, how far the rank is from that in the language, or TOP where it is not there;
the nearest language wins (ties: the first by name). score is 1 - distance / the largest one.

Defined results: a null text and one without letters give `und` and score 0, and so do all
texts where there are no labelled ones; rows with a null language are not learned from; very
long texts are counted in segments, whole; repeated rows get the same result each; a column that has the name
of an added one is replaced by it.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
SEGMENT = 1 << 20
UNKNOWN = "und"
_tables: list[np.ndarray] = []


def _letters() -> list[np.ndarray]:
    """By code point: the lower-case letter, 0 for what is no letter."""
    if not _tables:
        low = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                x = c.lower()
                low[i] = ord(x) if len(x) == 1 else i
        _tables.append(low)
    return _tables


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as 62-bit numbers, and their counts."""
    keys, counts = [], []
    low = _letters()[0]
    text, at = text or "", 0
    while at < len(text):
        to = at + SEGMENT
        while to < len(text) and text[to].isalpha():  # a segment ends between words
            to += 1
        cp = low[np.frombuffer(text[at:to].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        at = to
        if not cp.any():
            continue
        pad = np.zeros(len(cp) + 2, np.uint64)
        pad[1:-1] = cp
        x = pad[(pad > 0) | np.concatenate([[True], pad[:-1] > 0])] & np.uint64(0xFFFFF)
        one = x[x > 0]
        two = x[:-1] << np.uint64(20) | x[1:] | np.uint64(1 << 60)
        three = (x[:-2] << np.uint64(40) | x[1:-1] << np.uint64(20) | x[2:] | np.uint64(2 << 60))[x[1:-1] > 0]
        k, c = np.unique(np.concatenate([one, two, three]), return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (keys[0], counts[0]) if len(keys) == 1 else summed(keys, counts)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    if len(keys) > 4 * top:
        some = counts >= np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))][:top]


def _count(batches):
    held: dict[str, list] = defaultdict(lambda: [[], [], 0])
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            k, c = grams(text)
            own = held[lang]
            own[0].append(k)
            own[1].append(c)
            own[2] += len(k)
            if own[2] > 1 << 21:
                k, c = summed(own[0], own[1])
                own[:] = [[k], [c], 0]
    for lang, (k, c, _) in held.items():
        k, c = summed(k, c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])


def profiles(labelled: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """Language profiles from all rows (text, lang); `top` numbers for each language."""
    counts = labelled.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("lang", "gram", "rank").collect()
    out = defaultdict(lambda: {})
    for r in rows:
        out[r["lang"]][r["rank"]] = r["gram"]
    return {lang: np.array([v[i] for i in sorted(v)], np.int64).view(np.uint64) for lang, v in sorted(out.items())}


class Judge:
    """Distances of texts to profiles."""

    def __init__(self, by: dict[str, np.ndarray], top: int = TOP):
        self.names, self.top = list(by), top
        self.sorted = [(p[o := np.argsort(p)], o) for p in by.values()]

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(text)
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(keys, counts, self.top)
        at = np.arange(len(own))
        best = None
        for name, (p, rank) in zip(self.names, self.sorted, strict=True):
            i = np.minimum(np.searchsorted(p, own), len(p) - 1)
            d = int(np.where(p[i] == own, np.abs(rank[i] - at), self.top).sum())
            if best is None or d < best[0]:
                best = (d, name)
        return best[1], 1.0 - best[0] / (self.top * len(own))


def identified(docs: DataFrame, by: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds lang_pred and score to docs; other columns stay, but for ones of these names."""
    docs = docs.drop("lang_pred", "score")
    at, names = docs.columns.index(text), [*docs.columns, "lang_pred", "score"]

    def run(batches):
        judge = Judge(by)
        for b in batches:
            got = [judge(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names)

    schema = docs.select("*", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
