"""The pipeline stage by stage against brute force on a small corpus."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphweir.llm import quality
from tests.llm.test_operators import DOCS, brute_links, frame, shingles, two_languages, words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = [(i, t, y, "abc"[i % 3], len(t)) for i, t, y, _, _ in two_languages(rng, 120)]
    rows += [(200 + i, rows[i][1] + "  ", rows[i][2], "a", 0) for i in range(20)]
    for i in range(20):
        w = rows[30 + i][1].split()
        w[-1] = "kamotiru"
        rows.append((300 + i, " ".join(w), "xx", "b", 0))
    rows += [(400 + i, "".join(rng.choice("%$#&*") for _ in range(200)), "xx", "a", 0) for i in range(8)]
    rows += [(500, None, None, None, None), (501, "", "xx", "a", 0), (501, "", "xx", "a", 0)]
    root = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows).withColumns({c: F.lit("x") for c in ("size", "keep", "score0", "gw_lang", "rate0", "id", "copies", "__gw_row", "__gw_copies", "__GW_th", "gw_cost0", "th", "units")}).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{corpus}/labels.parquet")
    keep = {r["doc_id"] for r in quality.quality(docs, labels).filter("keep").collect()}
    one = corpus_pipeline.keep_quality(spark, docs, corpus)
    assert one.columns == columns
    rows = one.collect()
    assert {r["keep"] for r in rows} == {r["score0"] for r in rows} == {"x"}
    assert {r["doc_id"] for r in rows} == keep and not [i for i in keep if 400 <= i < 500] and len(keep) > 150

    two = corpus_pipeline.drop_copies(spark, one, corpus)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(norm(r["text"]), r["doc_id"])
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(first.values())

    three = corpus_pipeline.drop_near_copies(spark, two, corpus)
    left = sorted((r["doc_id"], r["text"]) for r in two.collect())
    _, root = brute_links([shingles(t or "") for _, t in left])
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == sorted({left[k][0] for k in root})

    four = corpus_pipeline.mix_sources(spark, three, corpus)
    times = {r["doc_id"]: r["n"] for r in four.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert four.columns == columns and max(times.values()) == 2
    word_count = lambda df: df.agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))).first()[0]
    assert abs(word_count(four) - 1.5 * word_count(three)) < 0.03 * word_count(three)

    five = corpus_pipeline.pack_windows(spark, four, corpus)
    pieces = five.filter("start = 0")
    assert pieces.select("doc_row").distinct().count() == four.count()  # copies of a document are told apart
    whole = five.filter("start = 0").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert {r["doc_id"]: r["n"] for r in whole.collect()} == times


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_run_on_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_short_texts(spark):
    docs = spark.createDataFrame([(2, "a b"), (1, "a b"), (3, "a c"), (4, words(random.Random(1), 50))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3, 4]
