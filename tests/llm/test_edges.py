"""Every operator on empty tables, nulls in every column, repeated rows, long texts and columns whose names clash."""

import random

import pytest
from pyspark.sql import functions as F

from basketflow.llm import chat, decontaminate, html_text, jaccard, langid, licenses, pieces, queries, rollup, secrets, spotsigs
from basketflow.llm.store import fresh

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 5000} and the other {i % 77}" for i in range(25_000))  # half a million characters
ROWS = [(1, "the cat sat on the mat and was fine", "en", "s/a", 3), (1, "the cat sat on the mat and was fine", "en", "s/a", 3), (1, "another text of the same number", None, "s/b", 3), (None, "no number at all", "en", None, None), (None, None, None, None, None), (2, None, "en", "s/a", 0), (3, "", "", "", 0), (4, " \n\t", "en", "s/a", 3), (5, LONG[:60_000], "en", "s/a", 60_000), (6, "password=abcdefghijkl1 MIT License", "en", "s/a", 9)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


def bench(spark):
    return spark.createDataFrame([(1, "a benchmark question that asks how many apples there are in the box"), (None, None), (2, "")], "item_id long, text string")


OPERATORS = {
    "op2": lambda s, d: rollup.counted(d),
    "op3": lambda s, d: jaccard.join(d),
    "op4": lambda s, d: licenses.digest(d),
    "op6": lambda s, d: langid.identified(d, langid.profiles(d)),
    "op7": lambda s, d: decontaminate.clean(d, bench(s)),
    "op8": lambda s, d: secrets.digest(secrets.scan(d)),
    "op8 redacted": lambda s, d: secrets.redacted(d),
    "op9": lambda s, d: pieces.digest(d),
    "op9 encoded": lambda s, d: pieces.encoded(d),
    "op10": lambda s, d: spotsigs.digest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_come_back_each_and_empty_tables_are_empty(spark, rows, name):
    out = OPERATORS[name](spark, rows)
    got = out.collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    if name != "op10":  # where a document's place counts, too
        assert len({str(r) for r in got if r.doc_id == 1}) <= 2  # the repeated row comes back alike
    empty = OPERATORS[name](spark, rows.limit(0))
    assert empty.count() == 0 and empty.schema.names == out.schema.names


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, rows, name):
    clashing = ["lang_pred", "score", "pieces", "decoded", "sentence_ids", "licenses", "spans", "found", "t", "k", "h", "r", "c", "_t", "_kinds", "__t", "repo", "owner", "held_out", "component_id", "n_shingles", "token", "_own", "sigs", "edited", "Fingerprint", "n_tokens"]
    more = rows.select("*", *(F.lit(f"own {c}").alias(c) for c in clashing))
    names = OPERATORS[name](spark, rows).schema.names
    want = sorted(str(tuple(r)) for r in OPERATORS[name](spark, rows).select(*names).collect())
    out = OPERATORS[name](spark, more)
    assert sorted(str(tuple(r)) for r in out.select(*(f"`{c}`" for c in names)).collect()) == want
    if name in ("op7", "op8 redacted"):
        assert out.columns == more.columns and out.select("_t", "owner").distinct().collect() == [("own _t", "own owner")]


def test_results_of_nulls_and_blanks(spark, rows):
    by = lambda df: {r.doc_id: r for r in df.where("doc_id in (2, 3, 4)").collect()}
    assert {(r.n_shingles, r.component_id) for r in by(jaccard.join(rows)).values()} == {(0, 2), (0, 3), (0, 4)}
    assert {(r.lang_pred, r.score) for r in by(langid.identified(rows, langid.profiles(rows))).values()} == {("und", 0.0)}
    assert {(r.n_sentences, r.licenses) for r in by(licenses.digest(rows)).values()} == {(0, "")}
    assert {(r.spans, r.n_assign) for r in by(secrets.digest(secrets.scan(rows))).values()} == {("", 0)}
    got = by(pieces.encoded(rows))
    assert got[2].pieces == got[3].pieces == [] and got[2].decoded == "" and got[4].decoded == " \n\t"
    signs = by(spotsigs.digest(rows))
    assert signs[2].fingerprint == signs[3].fingerprint == "" != signs[4].fingerprint and signs[3].near_next == 1.0
    assert [r.text for r in secrets.redacted(rows).where("doc_id = 6").collect()] == ["password=[SECRET] MIT License"]
    assert rollup.counted(rows).where("doc_id in (2, 3)").agg(F.sum("n_tokens")).first()[0] == 0


def test_long_texts_are_read_to_their_end(spark):
    end = f"{LONG}. Released under the MIT License. token=zyxwvutsrqp9 {'das ist der Hund und die Katze ' * 3}"
    d = spark.createDataFrame([(1, end, "en", "s", 1), (2, f"{LONG} changed at the very end", "de", "s", 1), (3, LONG, "en", "s", 1)], DOCS)
    assert [r.licenses for r in licenses.digest(d).orderBy("doc_id").collect()] == ["MIT", "", ""]
    assert secrets.digest(secrets.scan(d)).where("doc_id = 1").first().n_assign == 1
    assert {r.doc_id: r.component_id for r in jaccard.join(d).collect()} == {1: 1, 2: 1, 3: 1}
    asked = spark.createDataFrame([(9, "Released under the MIT License. token=zyxwvutsrqp9 das ist der Hund")], "item_id long, text string")
    assert [(r.doc_id, r.verbatim) for r in decontaminate.leaks(d, asked).collect()] == [(1, True)]
    assert pieces.digest(d).where("round_trip").count() == 3
    page = f"<body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>{end}</p></article><footer>&copy; foot</footer>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    got = html_text.extracted(pages).first()
    assert got.text == f"Head\n{' '.join(end.split())}" and got.n_chars == len(got.text)


def test_pages_empty_null_repeated_and_with_other_columns(spark):
    page = "<article><h1>T</h1><p>Some text here.</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, None, "", "y")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(str, (tuple(r) for r in html_text.extracted(p).collect())))
    assert got == sorted(map(str, [(1, "u", "T\nSome text here.", 17), (1, "u", "T\nSome text here.", 17), (None, None, "", 0), (2, None, "", 0)]))
    assert html_text.extracted(p.limit(0)).count() == 0


def test_chat_ties_nulls_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x"), (2, 1, "user", None), (3, 0, "system", ""), (3, 1, "user", "q"), (3, 2, "assistant", "r")]
    c = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = chat.canonical(chat.records(c.withColumn("turns", F.lit(1)).withColumn("r", F.lit("x"))))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in made.collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "x")], 2: [("user", "")], 3: [("system", ""), ("user", "q"), ("assistant", "r")]}
    out = chat.digest(chat.formatted(made)).collect()
    assert {r.conv_id: r.n_turns for r in out} == {1: 4, None: 1, 2: 1, 3: 3}
    assert chat.digest(chat.formatted(chat.canonical(chat.records(c.limit(0))))).count() == 0
    clash = spark.createDataFrame([(1, '{"prompt":"p","response":"a"}', "own")], "conv_id long, record string, Turns string").withColumn("r", F.lit("kept")).withColumn("layout", F.lit("own"))
    row = chat.formatted(chat.canonical(clash)).first()
    assert (row.layout, row.r, [tuple(t) for t in row.turns]) == ("response", "kept", [("user", "p"), ("assistant", "a")])


def test_chat_layouts_of_one_struct_column(spark):
    rng = random.Random(3)
    shapes = [("system", "user", "assistant"), ("user", "assistant"), ("user", "assistant", "user"), ("user",), ("tool", "user"), ("assistant",)]
    rows = [(i, t, role, rng.choice(["", "a", "\\### user: </turn>", "é#"])) for i in range(60) for t, role in enumerate(shapes[i % 6])]
    c = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = chat.canonical(chat.records(c))
    assert {r.layout for r in made.collect()} == {"response_system", "response", "conversations", "messages"}
    want = {}
    for i, _, role, text in rows:
        want.setdefault(i, []).append((role, text))
    back = chat.formatted(made).select("conv_id", chat.read_back(F.col("formatted")).alias("b"))
    assert {r.conv_id: [tuple(t) for t in r.b] for r in back.collect()} == want
    other = spark.createDataFrame([(1, ("x", None)), (2, (None, "y")), (3, None)], "conv_id long, record struct<prompt:string,completion:string>")
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical(other).orderBy("conv_id").collect()] == [("completion", [("user", "x"), ("assistant", "")]), ("completion", [("user", ""), ("assistant", "y")]), (None, [])]


def test_one_conversation_may_hold_most_rows(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), "id").alias("text"))
    got = chat.digest(chat.formatted(chat.canonical(chat.records(rows)))).where("conv_id = 1").first()
    assert got.n_turns == 66_668


@pytest.mark.parametrize("hot", [0.4, 0.9])
def test_a_source_may_hold_most_documents(spark, hot):
    n = 3000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n * hot, "token=hotvalue0123456 the same text in each of them is here").otherwise(F.concat(F.lit("text number "), "id", F.lit(" password=p"), F.lpad(F.col("id").cast("string"), 14, "x7q9zw"))).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < n * hot, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = secrets.digest(secrets.scan(d)).groupBy((F.col("doc_id") < n * hot).alias("hot")).agg(F.count_if(F.col("n_owner_specific") == 1).alias("live"), F.count("*").alias("n")).collect()
    assert all(r.live == r.n for r in got)
    assert jaccard.join(d).where(F.col("doc_id") < n * hot).agg(F.count_distinct("component_id"), F.count("*")).first() == (1, int(n * hot))


def test_fresh_names(spark):
    assert fresh(spark.range(1), "t") == ["_t"] and fresh(spark.range(1).withColumn("_T", F.lit(1)).withColumn("__x", F.lit(1)), "t", "u") == ["___t", "___u"]


def test_queries_are_whole(spark, tmp_path):
    """Each registered query over tables of this module's rows."""
    spark.createDataFrame(ROWS, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "x"), (None, None, None, None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    counts = {n: q(spark, str(tmp_path)).count() for n, q in queries.QUERIES.items()}
    whole = len(ROWS)
    assert {n: c for n, c in counts.items() if n not in ("op2_token_counts", "op7_decontaminate")} == {"op1_html_crf": 2, "op3_jaccard_join": whole, "op4_licenses": whole, "op5_chat": 3, "op6_language": whole, "op8_secrets": whole, "op9_sentencepiece": whole, "op10_spotsigs": whole}
