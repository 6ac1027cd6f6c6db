"""Secret scans: candidates by pattern, told apart by how widely their values are owned.

Base kinds (assign, access, hex) are always reported. The value of every candidate is hashed and
counted over the whole corpus by distinct repositories and owners. A value that belongs to few of both, and has
LEAST_VARIED different characters or more, looks like a live credential; a
widely copied one is an example. Candidates of further kinds are added where they look live, and so is, as a span of
its own of the kind `live`, the value of a base candidate. Offsets are code points, the end exclusive. A private key is
its whole block, to the END line, the next BEGIN or the end of the text; its value is its body
without white space and line marks, so a wrapped and an unwrapped copy are one value.

Defined results: a null text is empty and has no spans; a null repository or owner counts as
one of its own; repeated rows get the same result each, rows of one doc_id with different texts their own; other
columns are not read, and redacted() returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.store import fresh, written


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api"))) + "_?" + _either("key")
ASSIGN = rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind, pattern, group of the value, least length of the value, cheap text that a match contains
BASE = (
    ("assign", ASSIGN, 2, 12, None),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, None),  # a shorter run is no match; the same spans as [0-9a-f]+ of 16 or more
)
ADDED = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, "eyJ"),
    ("private", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 27, "PRIVATE KEY"),
)
#: A private key's block; the entry in ADDED has its first line only, as the SQL has.
_BLOCK = r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----([\s\S]*?)(?:-----END [A-Z ]{0,32}PRIVATE KEY-----|(?=-----BEGIN )|\z)"
#: What is searched for: as BASE and ADDED, and what is taken out of a value.
KINDS = tuple((*x, None) if x[0] != "private" else (x[0], _BLOCK, 1, 0, x[4], r"\\[nrt]|[^A-Za-z0-9+/=]") for x in (*BASE, *ADDED))
#: The kind of a base candidate's value that looks live, behind all kinds that are searched for.
LIVE = "live"
LEAST_VARIED = 6
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans(text: Column, k: int, pattern: str, group: int, least: int, holds: str | None, without: str | None = None) -> Column:
    """Leftmost matches that do not overlap: the text between them and they themselves add up."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr(f"named_struct('at', 0, 'out', cast(array() as {SPANS}))")

    def step(acc, x):
        start = acc["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        value = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        value = F.regexp_replace(value, without, "") if without else value
        one = F.when(F.char_length(value) >= least, F.array(F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end"), value.alias("value")))).otherwise(F.expr(f"cast(array() as {SPANS})"))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    zipped = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    some = F.aggregate(zipped, none, step)["out"]
    there = text.rlike(pattern) if holds is None else text.contains(holds)
    return F.when(there, some).otherwise(F.expr(f"cast(array() as {SPANS})"))


def candidates(body: Column, kinds: slice = slice(None)) -> Column:
    """SPANS of a text, by start then kind, of all kinds or some."""
    return F.array_sort(F.concat(*(spans(body, k, *x[1:]) for k, x in list(enumerate(KINDS))[kinds])))


def _varied(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, ""))) >= LEAST_VARIED


def ownership(rows: DataFrame) -> DataFrame:
    """rows (h, repo, owner) to (h, n_repos, n_owners); sums pairs first, so no value's rows meet in one task."""
    one = rows.groupBy("h", "repo", "owner").agg(F.lit(1).alias("one"))
    repos = one.groupBy("h", "repo").agg(F.max("one").alias("r")).groupBy("h").agg(F.sum("r").alias("n_repos"))
    owners = one.groupBy("h", "owner").agg(F.max("one").alias("o")).groupBy("h").agg(F.sum("o").alias("n_owners"))
    return repos.join(owners, "h")


def scan(docs: DataFrame, text: str = "text", repo: str = "source", owner: str | None = None, max_repos: int = 2, max_owners: int = 1) -> DataFrame:
    """doc_id and text's hash with spans (struct start, kind name, end, live) of base and added kinds, and key.

    owner: column of owners; None takes the part of repo before the first slash.
    """
    names = F.array(*(F.lit(x[0]) for x in KINDS), F.lit(LIVE))
    body, base_kind = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col("s.kind") < len(BASE)
    base = docs.select("doc_id", body.alias("text"), *_owners(repo, owner))
    at = lambda s: F.when(s["kind"] < len(BASE), s["end"] - F.char_length(s["value"])).otherwise(s["start"])
    found = F.transform(candidates(F.col("text")), lambda s: F.struct(s["start"], s["kind"], s["end"], at(s).alias("at"), _varied(s["value"]).alias("varied"), F.xxhash64(s["value"]).alias("h")))
    base = written(base.select("doc_id", "repo", "owner", F.xxhash64("text").alias("t"), found.alias("found")), "secrets")
    rows = base.where(F.size("found") > 0).distinct().select("doc_id", "t", "repo", "owner", F.explode("found").alias("s"), F.col("s.h").alias("h"))
    counts = written(ownership(rows.select("h", "repo", "owner")), "owners")  # a table of its own, so that the join can split a common value
    live = (F.col("n_repos") <= max_repos) & (F.col("n_owners") <= max_owners) & F.col("s.varied")
    span = lambda start, kind: F.struct(start.alias("start"), kind.alias("kind"), F.col("s.end").alias("end"), live.alias("live"))
    both = F.array(F.when(base_kind | live, span(F.col("s.start"), F.col("s.kind"))), F.when(base_kind & live, span(F.col("s.at"), F.lit(len(KINDS)))))
    told = rows.join(counts, "h").select("doc_id", "t", "repo", "owner", F.explode(F.array_compact(both)).alias("s"))
    kept = told.groupBy("doc_id", "t", "repo", "owner").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("doc_id", "t", "repo", "owner")]
    out = base.alias("b").join(kept.alias("k"), same[0] & same[1] & same[2] & same[3], "left")
    named = F.transform(F.coalesce("k.spans", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,live:boolean>>)")), lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end"), s["live"].alias("live"), s["kind"].alias("k")))
    return out.select("b.doc_id", "b.t", named.alias("spans"))


def _owners(repo: str, owner: str | None) -> tuple[Column, Column]:
    """repo and owner, the part of repo before the first slash if it has no column; null ones have a name of their own."""
    who = F.substring_index(F.col(f"`{repo}`"), "/", 1) if owner is None else F.col(f"`{owner}`")
    return F.coalesce(F.col(f"`{repo}`"), F.lit("\0")).alias("repo"), F.coalesce(who, F.lit("\0")).alias("owner")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["k"] < len(BASE))
    return scanned.select(
        "doc_id", *(count(x[0]).alias(f"n_{x[0]}") for x in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["k"] >= len(BASE))).cast("long").alias("n_owner_specific"),
    )


def _added(docs: DataFrame, text: str, repo: str, owner: str | None, max_repos: int, max_owners: int) -> DataFrame:
    """(t, kinds): of each text's hash the further kinds with a value that looks live."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.explode(candidates(body, slice(len(BASE), None))).alias("s")
    rows = docs.select(F.xxhash64(body).alias("t"), *_owners(repo, owner), found).select("t", "repo", "owner", F.col("s.kind").alias("kind"), F.xxhash64("s.value").alias("h"), _varied(F.col("s.value")).alias("varied")).distinct()
    few = ownership(rows.select("h", "repo", "owner")).where((F.col("n_repos") <= max_repos) & (F.col("n_owners") <= max_owners))
    return rows.where("varied").join(few, "h").groupBy("t").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", repo: str = "source", owner: str | None = None, max_repos: int = 2, max_owners: int = 1) -> DataFrame:
    """docs with the value of every base or added span replaced by mark; n_chars, where there is one, follows.

    Columns and rows stay. A named value of twelve characters goes also where a shorter match
    before it takes its name in scan(). Works on the text itself, so nothing is joined for the base kinds;
    the further kinds are few and are joined by their text's hash.
    """
    t, kinds = fresh(docs, "t", "kinds")
    more = _added(docs, text, repo, owner, max_repos, max_owners)
    out = docs.withColumn(t, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))).join(more.withColumnsRenamed({"t": t, "kinds": kinds}), t, "left")
    body = F.col(f"`{text}`")
    for kind, pattern, *_ in KINDS[len(BASE) :]:
        k = next(i for i, x in enumerate(KINDS) if x[0] == kind)
        body = F.when(F.array_contains(kinds, k), F.regexp_replace(body, pattern, mark)).otherwise(body)
    value = r"(?=[A-Za-z0-9+/_.=-]{12})[A-Za-z0-9+/_.=-]+"
    body = F.regexp_replace(body, ASSIGN.replace("([A-Za-z0-9+/_.=-]+)", f"(?:{value})").replace(f"({_NAMES})", f"((?:{_NAMES})").replace(r"[\"']?(?:", r"[\"']?)(?:"), "$1" + mark.replace("$", r"\$"))
    body = F.regexp_replace(F.regexp_replace(body, r"AKIA[A-Z0-9]{14,}", mark), r"[0-9a-f]{16,}", mark)
    out = out.withColumn(text, body)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"`{text}`").isNotNull(), F.char_length(f"`{text}`").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))
