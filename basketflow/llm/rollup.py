"""Token counts kept as additive rollups by source, language and tokenizer version.

A change inserts, deletes or revises one document's count; it becomes one or two signed rows.
A batch of changes is summed and committed once under its id: its sums are written aside and
renamed into place by a rename that fails where the target is, and a batch that is already there is left alone, so a
retried commit adds nothing. Totals are the sums over the base and the batches after it. compact() folds
batches into a new base that keeps their ids; folders go one compaction later, when no reader
can hold them any more.

Defined results: null source, language or version are groups of their own; a null or empty
text counts 0 tokens; groups that come to no documents and no tokens go; an empty batch is
committed and adds nothing; repeated change rows count as often as they are there; a revision
takes the old count from the old source, language and version; columns beside those named are not read.
"""

from __future__ import annotations

import base64
import re
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k"
#: Fixed value: the splitting pattern of this tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A second vocabulary with the same pattern, and its version.
MANY_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MANY_VERSION = "byte_bpe_multi_50k"
KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"
CHANGES = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_source string, old_lang string, old_tokenizer_version string, old_n_tokens long"


def counted(docs: DataFrame, path: str = DEFAULT_RANKS, text: str = "text", version: str = VERSION) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, n_tokens) of docs, each text whole."""
    return recounted(docs, (path,), text).select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), F.col("n_tokens_0").alias("n_tokens"))


def recounted(docs: DataFrame, paths: tuple[str, ...], text: str = "text") -> DataFrame:
    """(doc_id, source, lang, n_tokens_0, n_tokens_1, ...) of docs by several vocabularies, in one pass over the texts."""

    def run(batches):
        import tiktoken

        encoders = []
        for path in paths:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoders.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        for b in batches:
            counts = [[len(e.encode_ordinary(x)) if (x := t.as_py()) else 0 for t in b.column(3)] for e in encoders]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(n, pa.int64()) for n in counts)], ["doc_id", "source", "lang", *names])

    names = [f"n_tokens_{i}" for i in range(len(paths))]
    rows = docs.select("doc_id", "source", "lang", F.col(text).alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", "source", "lang", *(F.lit(0).cast("long").alias(n) for n in names)).schema)


def changes(counts: DataFrame, op: str, **old: Column) -> DataFrame:
    """Rows of CHANGES for counts (KEYS, n_tokens); old: source, lang, tokenizer_version and n_tokens before a revision."""
    nothing = {"source": "string", "lang": "string", "tokenizer_version": "string", "n_tokens": "long"}
    return counts.select(F.lit(op).alias("op"), *KEYS, "n_tokens", *(old.get(k, F.lit(None)).cast(t).alias(f"old_{k}") for k, t in nothing.items()))


def signed(changed: DataFrame) -> DataFrame:
    """Rows of CHANGES to rows of DELTA.

    insert and delete use n_tokens; revise takes the old count from the old source, language and
    version and adds the new one to the present ones; without the column old_tokenizer_version the version
    stays. Another op is an error.
    """
    if "old_tokenizer_version" not in changed.columns:
        changed = changed.withColumn("old_tokenizer_version", F.col("tokenizer_version"))
    row = lambda keys, docs, tokens: F.struct(*(F.col(k).alias(n) for k, n in zip(keys, KEYS, strict=True)), F.lit(docs).cast("long").alias("d_docs"), tokens.cast("long").alias("d_tokens"))
    old, n = tuple(f"old_{k}" for k in KEYS), F.coalesce("n_tokens", F.lit(0))
    rows = (
        F.when(F.col("op") == "insert", F.array(row(KEYS, 1, n)))
        .when(F.col("op") == "delete", F.array(row(KEYS, -1, -n)))
        .when(F.col("op") == "revise", F.array(row(old, -1, -F.coalesce("old_n_tokens", F.lit(0))), row(KEYS, 1, n)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    )
    return changed.select(F.explode(rows).alias("r")).select("r.*")


class Rollup:
    """The rollup in a folder of a store that all executors share: batches/<id> and base/<n>/sums, base/<n>/ids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at(self.path).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), conf)

    def _put(self, aside: str, there: str) -> bool:
        """Renames a written folder into place; false, and the folder gone, if something is there."""
        target = self._at(f"{self.path}/{there}")
        self._fs.mkdirs(target.getParent())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self._context.rename(self._at(aside), target, options)
        except Py4JJavaError:
            self._fs.delete(self._at(aside), True)
            if not self._fs.exists(target):
                raise
            return False
        return True

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _base(self) -> int | None:
        return max(map(int, self._names("base")), default=None)

    def _folded(self, base: int | None) -> DataFrame:
        """Ids (id) of the batches that a base holds."""
        return self.spark.createDataFrame([], "id string") if base is None else self.spark.read.schema("id string").parquet(f"{self.path}/base/{base}/ids")

    def _sums(self, base: int | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in batches] + ([] if base is None else [f"{self.path}/base/{base}/sums"])
        deltas = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).where("d_docs <> 0 or d_tokens <> 0")

    def _since(self, base: int | None) -> list[str]:
        """Ids of batches that are not in the base."""
        names = self._names("batches")
        if base is None or not names:
            return names
        here = self.spark.createDataFrame([(n,) for n in names], "id string")
        return sorted(r["id"] for r in here.join(self._folded(base), "id", "left_anti").collect())

    def commit(self, batch: str, changed: DataFrame) -> bool:
        """Adds a batch of CHANGES; false, and nothing done, if its id was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"a batch id has letters, digits, _ . and - only, a letter or digit first: {batch!r}")
        if self._fs.exists(self._at(f"{self.path}/batches/{batch}")) or not self._folded(self._base()).where(F.col("id") == batch).isEmpty():
            return False
        aside = f"{self.path}/staged/{uuid.uuid4().hex}"
        sums = signed(changed).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.write.parquet(aside)
        return self._put(aside, f"batches/{batch}")

    def compact(self) -> int:
        """Folds the batches so far into a new base and gives its number; deletes what the base before had folded."""
        base, aside = self._base(), f"{self.path}/staged/{uuid.uuid4().hex}"
        batches = self._since(base)
        new = -1 if base is None else base
        self._sums(base, batches).write.parquet(f"{aside}/sums")
        ids = self.spark.createDataFrame([(b,) for b in batches], "id string")
        self._folded(base).union(ids).coalesce(1).write.parquet(f"{aside}/ids")
        if not self._put(aside, f"base/{new + 1}"):
            raise FileExistsError(f"base {new + 1} has been made by another compaction")
        for b in set(self._names("batches")) - set(self._since(base)) if base is not None else ():
            self._fs.delete(self._at(f"{self.path}/batches/{b}"), True)
        for n in self._names("base"):
            if int(n) < new:
                self._fs.delete(self._at(f"{self.path}/base/{n}"), True)
        return new + 1

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens)."""
        base = self._base()
        return self._sums(base, self._since(base)).withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"})
