"""The corpus pipeline: each stage against a plain version on a small corpus, and the whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketflow.llm import pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "A train leaves Paris at 9 and travels 60 miles before it stops for the night . How long does it take"


def corpus():
    rng = random.Random(6)
    en, de = "the house over there and of a river with some stones in it".split(), "das Haus am Fluss und der Stein mit dem Wasser in die Stadt".split()
    rows, words = [], lambda v, n: [rng.choice(v) + (str(rng.randrange(9)) if rng.random() < 0.1 else "") for _ in range(n)]
    for i in range(30):
        rows.append((i, " ".join(words(en if i % 2 else de, 60)), "en" if i % 2 else "de", f"src{i % 4}"))
    base = rows[3][1].split()
    for i in range(100, 106):  # near copies of 3, and an exact one
        near = list(base)
        near[i % 50] = f"edit{i}" if i % 2 else near[i % 50]
        rows.append((i, " ".join(near), "en", "copies"))
    rows += [(200, f"{rows[5][1]} {ITEM}", "en", "leaks"), (201, f"{rows[7][1]} {ITEM.replace('60', '75').replace('Paris', 'Rome')}", "en", "leaks")]
    rows += [(300, f"{' '.join(words(de, 60))} password=abcdef123456 AKIAABCDEFGHIJ1234 deadbeef01234567", "de", "keys"), (301, None, "en", "blank"), (302, "", None, None), (303, "123 456 !!", "en", "blank"), (None, f"{rows[9][1]} zz", None, None)]
    return [(*r[:2], r[2], r[3], len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_language(rows):
    return [r for r in rows if any(c.isalpha() for c in r["text"] or "")]


def plain_near_duplicates(rows):
    sets, top = {r["doc_id"]: shingles(r["text"]) for r in rows}, {r["doc_id"]: r["doc_id"] for r in rows}
    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return [r for r in rows if r["doc_id"] is None or root(r["doc_id"]) == r["doc_id"]]


def plain_decontaminated(rows):
    return [r for r in rows if not re.search(r"train leaves \w+ at \d+ and travels \d+ miles before", r["text"])]


def plain_secrets(rows):
    out = []
    for r in rows:
        text = re.sub(r"password=[A-Za-z0-9+/_.=-]{12,}", "password=[SECRET]", r["text"])
        text = re.sub(r"[0-9a-f]{16,}", "[SECRET]", re.sub(r"AKIA[A-Z0-9]{14,}", "[SECRET]", text))
        out.append({**r, "text": text, "n_chars": len(text)})
    return out


PLAIN = [plain_language, plain_near_duplicates, plain_decontaminated, plain_secrets]


def test_each_stage_is_the_plain_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES, PLAIN, strict=False):
        before = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs.withColumn("k", F.lit("other")), folder)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        skip = {"lang"} if name == "language" else set()
        key = lambda r, skip=skip: str([r[c] for c in corpus_pipeline.COLUMNS if c not in skip])
        assert sorted(key(r.asDict()) for r in docs.collect()) == sorted(key(r) for r in plain(before)), name
        if name == "language":
            assert {r.lang for r in docs.collect()} == {"en", "de"}
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {*range(30), 300, None} and docs.where("doc_id = 300").first().text.endswith("password=[SECRET] [SECRET] [SECRET]")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    texts, e = {r.doc_id: r.text for r in docs.collect()}, pieces.model()
    assert len(last) == len(texts) and all(e.decoded(__import__("numpy").array(r.pieces)) == texts[r.doc_id] and r.n_pieces == len(r.pieces) for r in last)


def test_the_pipeline_runs_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in got.collect()} == {*range(30), 300, None}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminated", "without_secrets", "tokens"]


def test_stages_of_an_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, folder)
        assert docs_out.count() == 0
