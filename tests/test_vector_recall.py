"""The stored index of vectors: recall, pruning, additions, odd vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweir.operators import vector, vector_index

DIMS, N, LISTS, PROBES = 64, 3000, 32, 8


@pytest.fixture(scope="module")
def vectors():
    """Clouds around 60 directions; neighbours in a cloud have cosines about 0.8."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, DIMS))
    v = centres[rng.integers(0, 60, N)] + rng.normal(size=(N, DIMS)) * 0.5
    return v / np.linalg.norm(v, axis=1, keepdims=True) * rng.uniform(0.5, 3, (N, 1))


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, e array<double>, note string").repartition(4)
    vector_index.build(df, "e", path, lists=LISTS)
    return path


def exact(vectors, q, k, cutoff):
    c = vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q)
    best = sorted(range(len(c)), key=lambda i: (-round(c[i], 12), i))[:k]
    return [i for i in best if c[i] >= cutoff]


def test_recall_and_pruning(spark, index, vectors):
    found = wanted = 0
    for i in range(0, N, 300):
        out = vector_index.probe(spark, index, vectors[i].tolist(), "e", PROBES, 0.7, 10)
        want = exact(vectors, vectors[i], 10, 0.7)
        found += len({r.vec_id for r in out.collect()} & set(want))
        wanted += len(want)
    assert found >= 0.9 * wanted and wanted >= 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*gw_list", plan)
    lists = spark.read.parquet(f"{index}/vectors").filter(F.col("gw_list").isin(vector_index.nearest_lists(vector_index.centroids(index), vectors[0].tolist(), PROBES)))
    read = lists.select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read < spark.read.parquet(f"{index}/vectors").select(F.input_file_name()).distinct().count()
    assert spark.read.parquet(f"{index}/vectors").count() == N


def test_a_table_of_queries_finds_the_same(spark, index, vectors):
    asked = list(range(0, N, 20))
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in asked], "q long, v array<double>")
    got = {}
    for r in vector_index.probe_each(index, queries, "q", "v", "e", PROBES, 0.7, 10).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.vec_id
    want = {i: exact(vectors, vectors[i], 10, 0.7) for i in asked}
    assert sum(len({*got[i].values()} & set(want[i])) for i in asked) >= 0.9 * sum(map(len, want.values()))
    assert all(got[i][1] == i for i in asked)
    one = vector_index.probe(spark, index, vectors[20].tolist(), "e", PROBES, 0.7, 10).collect()
    assert [r.vec_id for r in one] == [got[20][k] for k in sorted(got[20])]
    everything = vector_index.probe_each(index, queries.limit(3), "q", "v", "e", None, 0.7, 10).collect()
    assert all([r.vec_id for r in sorted((r for r in everything if r.q == i), key=lambda r: r["rank"])] == want[i] for i in {r.q for r in everything})


def test_all_lists_are_the_exact_search(spark, index, vectors):
    out = vector_index.probe(spark, index, vectors[7].tolist(), "e", None, 0.2, 25)
    assert [r.vec_id for r in out.collect()] == exact(vectors, vectors[7], 25, 0.2)
    assert out.columns == ["vec_id", "e", "note", "similarity_score"]
    assert vector_index.probe(spark, index, [1.0, 2.0], "e").count() == 0


def test_odd_vectors_and_additions(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, nan]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (None, [2.0, 0.1]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").withColumn("gw_features", F.lit(1))
    path = f"file://{tmp_path}/i"
    vector_index.build(df, "e", path, lists=2)
    assert sorted(str(r.vec_id) for r in vector_index.probe(spark, path, [3.0, 0.0], "e", 1, 0.7, 9).collect()) == ["1", "1", "None"]
    assert spark.read.parquet(f"{path}/vectors").filter("gw_list = -1").count() == 5
    vector_index.add(spark.createDataFrame([(9, [0.9, 0.0], 1)], "vec_id long, e array<float>, gw_features int"), "e", path)
    assert [r.vec_id for r in vector_index.probe(spark, path, [3.0, 0.0], "e", 1, 0.999, 9).collect()] == [1, 1, 9]
    vector_index.build(df.limit(0), "e", f"file://{tmp_path}/none")
    assert vector_index.probe(spark, f"file://{tmp_path}/none", [1.0, 0.0], "e").count() == 0
    one = [(1, [1.0, 0.0])] * 3
    vector_index.build(spark.createDataFrame(one, "vec_id long, e array<float>"), "e", f"file://{tmp_path}/one")
    assert vector_index.probe(spark, f"file://{tmp_path}/one", [1.0, 0.0], "e").count() == 3


def test_exact_search_drops_vectors_without_an_angle(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "vec_id long, e array<double>")
    assert [r.vec_id for r in vector.search(df, "e", [1.0, 0.0], -1.0).collect()] == [1]
