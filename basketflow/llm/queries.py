"""The named queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.llm import chat, decontaminate, html_text, jaccard, langid, licenses, pieces, rollup, secrets, spotsigs
from basketflow.llm.store import shared_dir, table, written

CONTROL = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(CONTROL))
    return chat.digest(chat.formatted(chat.canonical(chat.records(rows.union(more)))))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(table(spark, sf_dir, "documents"))


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted, counted anew by another tokenizer and revised, those without tokens deleted; each batch committed twice, which adds nothing, and the first ones compacted."""
    both = written(rollup.recounted(table(spark, sf_dir, "documents"), (rollup.DEFAULT_RANKS, rollup.MANY_RANKS)), "counts")
    old = both.select("source", "lang", F.lit(rollup.VERSION).alias("tokenizer_version"), F.col("n_tokens_0").alias("n_tokens"))
    new = both.select("source", "lang", F.lit(rollup.MANY_VERSION).alias("tokenizer_version"), F.col("n_tokens_1").alias("n_tokens"), "n_tokens_0")
    kept = rollup.Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    before = {"source": F.col("source"), "lang": F.col("lang"), "tokenizer_version": F.lit(rollup.VERSION), "n_tokens": F.col("n_tokens_0")}
    batches = {"documents": rollup.changes(old, "insert"), "tokenizer": rollup.changes(new, "revise", **before), "empty": rollup.changes(new.where("n_tokens = 0"), "delete")}
    for name, changed in batches.items():
        for _ in range(2):
            kept.commit(name, changed)
        if name == "tokenizer":
            kept.compact()
    return kept.totals()


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    by = langid.profiles(docs.where(~F.col("held_out")))
    return langid.identified(docs.select("doc_id", "text", "held_out"), by).select("doc_id", "held_out", "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_crf, op2_token_counts, op3_jaccard_join, op4_licenses, op5_chat, op6_language, op7_decontaminate, op8_secrets, op9_sentencepiece, op10_spotsigs)}

_CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}'
  UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
), e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '</', '<\\/') AS body,
    replace(replace(replace(replace(role, '\\', '\\\\'), '#', '\\#'), '</', '<\\/'), ':', '\\:') AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || head || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _spans_sql(k: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    value = f"regexp_extract(m[i], '{p}', {group})"
    return f"""
  SELECT doc_id, source, rid, {k} AS kind, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s,
    length(m[i]) AS len, {value} AS value
  FROM (SELECT doc_id, source, rid, b, m, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, source, rid, string_split_regex(text, '{p}') AS b, regexp_extract_all(text, '{p}', 0) AS m FROM d WHERE regexp_matches(text, '{p}')))
  WHERE length({value}) >= {least}"""


_KINDS = (*secrets.BASE, *secrets.ADDED)
_SECRETS = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(k, p, g, n) for k, (_, p, g, n, _) in enumerate(_KINDS))}),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) <= 2 AND count(DISTINCT coalesce(split_part(source, '/', 1), chr(0))) <= 1
        AND len(list_distinct(string_split(value, ''))) >= {secrets.LEAST_VARIED} AS live FROM f GROUP BY value),
j AS (SELECT f.*, live FROM f JOIN o USING (value)),
t AS (SELECT DISTINCT rid, kind, CAST(s AS BIGINT) AS s, CAST(s + len AS BIGINT) AS e FROM j WHERE kind < {len(secrets.BASE)} OR live
      UNION SELECT rid, {len(_KINDS)}, CAST(s + len - length(value) AS BIGINT), CAST(s + len AS BIGINT) FROM j WHERE kind < {len(secrets.BASE)} AND live),
k AS (SELECT *, (['{"','".join([x[0] for x in _KINDS] + [secrets.LIVE])}'])[kind + 1] || ':' || s || ':' || e AS name FROM t),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{x[0]}" for k, x in enumerate(secrets.BASE))},
        string_agg(name, ',' ORDER BY s, kind) FILTER (WHERE kind < {len(secrets.BASE)}) AS base,
        string_agg(name, ',' ORDER BY s, kind, e) AS spans, count(*) FILTER (WHERE kind >= {len(secrets.BASE)}) AS live
      FROM k GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{x[0]}, 0) AS n_{x[0]}" for x in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(live, 0) AS n_owner_specific
FROM d LEFT JOIN g USING (rid)
"""

_H = licenses._HARD
_KNOWN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in licenses.KNOWN.items()) + "}"
_NAMES = ", ".join(f"CASE WHEN contains(line, ' {' '.join(ids)} ') THEN '{name}' END" for name, ids in licenses.RULES)
_STEPS = (  # without lookarounds: ends of pieces are doubled, so that each match has its own
    (rf"(?m)^[^a-z0-9\n]*(?:dnl|rem)( |$)", r"\1"), (licenses._END, _H), (r"(?:\n[^a-z0-9\n]*)+\n", _H + "\n"), (f"[^a-z0-9\n{_H}]+", " "), (f" ?([\n{_H}]) ?", r"\1"), ("^ | $", ""), (f"([\n{_H}])", r"\1\1"),
)
_PLAIN = f"replace(lower(coalesce(text, '')), '{_H}', ' ')"
for _p, _by in _STEPS:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_p}', '{_by}', 'g')"
_ANY = licenses.ANY_KNOWN.replace("[ \n]", "(?: |\n\n)").replace(_H, _H + _H)
_LICENSES = f"""
WITH s AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{licenses.KEYWORDS}') THEN
    list_transform(regexp_extract_all({_PLAIN}, '(?:^|[\n{_H}])({_ANY})(?:[\n{_H}]|$)', 1), lambda x: ({_KNOWN})[replace(replace(x, '\n\n', ' '), '{_H}{_H}', '{_H}')]) ELSE [] END AS ids
  FROM documents
), l AS (SELECT doc_id, ids, ' ' || array_to_string(ids, ' ') || ' ' AS line FROM s)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{_NAMES}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM l
"""

_JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared FROM t x JOIN t y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL) WHERE 100 * shared >= 75 * (na + nb - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM sets JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""

ORACLE_SQL = {"op3_jaccard_join": _JACCARD, "op4_licenses": _LICENSES, "op5_chat": _CHAT, "op8_secrets": _SECRETS}
