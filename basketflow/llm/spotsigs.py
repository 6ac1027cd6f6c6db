"""Document fingerprints: SpotSigs.

A text is lower-cased and cut into runs of letters and digits. Each run of anchors (common words)
starts a chain: it and the next CHAIN content words after it, anchors between left out. The
fingerprint is the sorted set of the chains' 32-bit hashes; a text with words but no chain has
one signature of all its words, one without words of the raw text, an empty one none.

Defined results: a null text is empty; two empty sets are alike (1), an empty one and another
are not (0); equal doc_ids follow in order of their text's hash, null ids last; repeated rows
are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish.
ANCHORS = ("the", "a", "is", "was", "it", "that", "der", "die", "das", "und", "ist", "le", "la", "les", "des", "et", "el", "los", "y", "es")
CHAIN = 2


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit hashes of a text's chains."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    # possessive: a greedy group that repeats takes stack for each anchor of a run
    glued = F.regexp_replace(words, rf"(?<= )({'|'.join(anchors)}) ", "$1@")
    chains = F.regexp_extract_all(glued, F.lit(r"(?<= )(?=((?:[^ @]++@)++[^ @]++(?: (?:[^ @]++@)*+[^ @]++){%d}) )" % (chain - 1)), F.lit(1))
    bare = F.split(F.regexp_replace(F.array_join(chains, "\n"), r" (?:[^ @\n]++@)++", " "), "\n", -1)
    whole = F.when(F.trim(words) != "", F.array(words)).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(F.when(F.size(chains) > 0, bare).otherwise(whole), lambda x: F.hash(x))))


def as_string(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without looking at the members where their sizes keep it below least."""
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    bound = F.least(na, nb) < F.greatest(na, nb) * F.lit(least)
    return F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0) | bound, F.lit(0.0)).otherwise(both / (na + nb - both))


def near_pairs(docs: DataFrame, least: float = 0.75, text: str = "text") -> DataFrame:
    """(a, b, likeness) of documents, equal sets as one, whose sets are at least so alike; a and b their smallest doc_ids.

    Sets are partitioned by length: one of n signatures meets only those of its own and the next
    class of lengths, within a class by a signature of its prefix (the smallest hashes), so
    that pairs which cannot reach least are never made.
    """
    one = docs.select("doc_id", signatures(F.coalesce(F.col(text), F.lit(""))).alias("s")).where(F.size("s") > 0).groupBy("s").agg(F.min("doc_id").alias("doc_id"))
    one = one.select("doc_id", "s", F.size("s").alias("n")).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least))).cast("int"))
    width = (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")
    keyed = one.withColumn("k", F.explode(F.slice("s", F.lit(1), width)))
    left = keyed.select("k", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = keyed.select("k", F.col("doc_id").alias("b"), F.col("n").alias("nb"), "band")
    near = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["k", "band"]).where(near & (F.col("na") >= F.col("nb") * F.lit(least) - 1e-9)).select("a", "b").distinct()
    sets = one.select("doc_id", "s")
    told = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)


def with_next(docs: DataFrame, keep: dict[str, Column], rows: int = 2000, most: int = 1000, text: str = "text", size: int = 8_000_000) -> DataFrame:
    """Adds columns of the document with the next smaller doc_id (after the last: the first); keep: name to expression.

    One shuffle. Blocks are ranges of doc_id of about so many rows, fewer where that many texts of
    the mean length are more than `size` bytes (a block is held in memory), up to `most` quantiles, each cut evenly, and below them ranges of the text's hash for documents without an id; every block also gets the
    first row of the block below it. Blocks are told apart by one row each.
    """
    n, lo, hi, gone, mean = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull()), F.avg(F.octet_length(text))).first()
    lo, hi = lo or 0, hi or 0
    rows = max(1, min(rows, int(size / max(mean or 0, 1))))
    q = max(1, min(most, n // rows))
    cut, nulls = max(1, n // rows // q), max(1, gone // rows)
    found = docs.agg(F.percentile_approx("doc_id", [i / q for i in range(1, q)], 100_000)).first()[0] if q > 1 else []
    lower = sorted({lo, *(found or [])})
    starts, ends = (F.array(*(F.lit(x).cast("long") for x in xs)) for xs in (lower, [*lower[1:], min(hi + 1, 2**63 - 1)]))
    other, number = F.xxhash64(text), F.coalesce(F.col("doc_id").cast("long"), F.lit(lo))
    k = F.greatest(F.size(F.filter(starts, lambda b: b <= number)), F.lit(1))
    start, end = (F.element_at(x, k).cast("double") for x in (starts, ends))
    numbered = k.cast("long") * cut + F.least(((number.cast("double") - start) * cut / F.greatest(end - start, F.lit(1.0))).cast("long"), F.lit(cut - 1).cast("long"))
    hashed = -1 - F.least(F.floor((other.cast("double") / 2.0**64 + 0.5) * nulls), F.lit(nulls - 1).cast("long"))
    missing = F.col("doc_id").isNull()
    dealt = docs.withColumns({"_own": F.when(missing, F.bitwise_not(other)).otherwise(number), "_block": F.when(missing, hashed).otherwise(numbered)})  # both fall from row to row
    heads = dealt.groupBy("_block").agg(F.max("_own").alias("_own"))
    heads = heads.select("_block", "_own", F.coalesce(F.lead("_block").over(Window.orderBy("_block")), F.min("_block").over(Window.partitionBy())).alias("_to"))
    heads = F.broadcast(heads) if len(lower) * cut + nulls <= 1 << 18 else heads
    twice = F.array(F.struct(F.col("_block").alias("b"), F.lit(False).alias("g")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("g")))
    dealt = dealt.join(heads, ["_block", "_own"], "left").withColumn("_at", F.explode(F.filter(twice, lambda x: x["b"].isNotNull())))
    order = Window.partitionBy("_at.b").orderBy("_at.g", F.desc("_own"), "_h")
    dealt = dealt.select(*docs.columns, "_own", "_at").withColumn("_h", other)
    dealt = dealt.select("*", *(F.lead(v).over(order).alias(c) for c, v in keep.items()))
    return dealt.where(~F.col("_at.g")).select(*docs.columns, *keep)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for rows (doc_id, text)."""
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = one.select("doc_id", "text", signatures(F.col("text")).alias("sigs"))
    n = F.char_length("text")
    got = with_next(one, {"next_text": F.col("text"), "next_sigs": F.col("sigs")})
    half = F.floor(n / 2).cast("int")
    got = got.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    got = got.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sigs", "next_sigs", signatures(F.col("edited")).alias("edited_sigs"))
    return got.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("sigs")).alias("fingerprint"), as_string(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
