"""Substring search through stored grams against the plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from graphweir.operators import text_index

ODD = ["a", "A", "b", "σ", "Σ", "ς", "İ", "i̇", "ı", "I", "ß", "ẞ", "ſ", "K", "k", "é", "é", "É", "😀", "中", " ", "%", "_", "\\", "\n", "Ǆ", "ǆ"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice(ODD) for _ in range(n))
    rows = [(i if i % 50 else None, word(rng.randrange(12)), word(rng.randrange(30)) if i % 7 else None) for i in range(500)]
    rows += [(7, "abc ring", None), (7, None, "RING"), (1000, "ΑΣΑ ΑΣ", ""), (1001, "x" * 200_000 + "needle", None)]
    return rows


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("grams"))
    df = spark.createDataFrame(texts, "k long, a string, b string").repartition(3)
    text_index.build(df, "k", ["a", "b"], path, 8)
    return df, path


@pytest.mark.parametrize("exact_case", [True, False])
def test_search_equals_the_scan(spark, texts, index, exact_case):
    df, path = index
    rng = random.Random(10)
    whole = [x for _, a, b in texts for x in (a, b) if x and len(x) < 100]
    cut = lambda x: x[(i := rng.randrange(len(x))) : i + rng.randrange(1, 7)]
    patterns = [cut(rng.choice(whole)) for _ in range(14)] + ["ring", "ΑΣ", "ασα", "ΣΑ ", "needle", "absent!", "ab", "", "ας "]
    hits = 0
    for p in patterns:
        for q in (p, p.upper(), p.lower()) if not exact_case else (p,):
            c = lambda n: F.contains(F.col(n), F.lit(q)) if exact_case else F.contains(F.lower(n), F.lower(F.lit(q)))  # noqa: B023, E731
            want = sorted(map(str, df.filter(F.coalesce(c("a"), F.lit(False)) | F.coalesce(c("b"), F.lit(False))).collect()))
            got = sorted(map(str, text_index.search(df, "k", ["a", "b"], path, [q], exact_case, 8).collect()))
            assert got == want, q
            hits += bool(want)
    assert hits >= 14


def test_any_of_several_and_pruning(spark, index):
    df, path = index
    got = text_index.search(df, "k", ["a", "b"], path, ["Ring", "needle"], False, 8)
    assert sorted(r.k for r in got.collect()) == [7, 7, 1001]
    near = text_index.candidates(df.select(F.col("k").alias("id")), path, "needle", 8)
    assert [r.id for r in near.collect()] == [1001]
    assert "PartitionFilters: [gw_bucket" in near._jdf.queryExecution().executedPlan().toString()
    assert text_index.candidates(df.select(F.col("k").alias("id")), path, "ne", 8) is None


def test_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "k long, a string")
    text_index.build(df, "k", ["a"], f"file://{tmp_path}/g")
    assert text_index.search(df, "k", ["a"], f"file://{tmp_path}/g", ["abc"]).count() == 0
