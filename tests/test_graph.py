"""Hand-made fixtures: trails, cycles, parallel edges, optional matches, null order, mutations, paths."""

import pytest
from pyspark.sql import functions as F

from graphweir.operators import aggregates, expand, mutations, patterns
from graphweir.operators.model import both_ways, duplicate_keys, surrogate_ids
from graphweir.plans.components import connected_components

EDGES = "eid string, src string, dst string, type string"


def graph(spark, *pairs, kind="CALLS"):
    return spark.createDataFrame([(f"e{i}", a, b, kind) for i, (a, b) in enumerate(pairs)], EDGES)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_cycle_of_four(spark):
    e = graph(spark, ("1", "2"), ("2", "3"), ("3", "4"), ("4", "1"))
    found = {(r["finish"], r["hops"]) for r in expand.paths(ids(spark, "1"), e, 1, 6).collect()}
    assert found == {("2", 1), ("3", 2), ("4", 3), ("1", 4)}
    assert {r["finish"]: r["hops"] for r in expand.reachable(ids(spark, "1"), e).collect()} == {"2": 1, "3": 2, "4": 3, "1": 4}


def test_parallel_edges_and_self_loop_are_told_apart(spark):
    e = graph(spark, ("a", "b"), ("a", "b"), ("a", "a"))
    assert expand.paths(ids(spark, "a"), e, 1, 1).count() == 3
    assert expand.paths(ids(spark, "a"), e, 2, 2).count() == 2  # round the loop, then over either edge
    assert both_ways(e).count() == 5


def test_undirected_star_does_not_step_back(spark):
    e = graph(spark, ("hub", "x"), ("hub", "y"), ("hub", "z"))
    two = expand.paths(ids(spark, "x"), e, 2, 2, "any").collect()
    assert sorted(r["finish"] for r in two) == ["y", "z"]
    assert expand.paths(ids(spark, "x"), e, 3, 3, "any").count() == 0


def test_callees_of_one_controller_have_no_path(spark):
    e = graph(spark, ("controller", "source"), ("controller", "sink"))
    assert expand.paths(ids(spark, "source"), e, 1, 3, ends=ids(spark, "sink")).count() == 0
    assert expand.paths(ids(spark, "source"), e, 1, 3, "any", ends=ids(spark, "sink")).count() == 1


def test_condition_of_an_optional_hop_belongs_to_the_match(spark):
    e = graph(spark, ("a", "ok"), ("b", "bad"))
    rows = patterns.hop(ids(spark, "a", "b", "c"), "id", e, "x", optional=True, where=F.col("dst") != "bad").collect()
    assert {r["id"]: r["x"] for r in rows} == {"a": "ok", "b": None, "c": None}


def test_existence(spark):
    e = graph(spark, ("a", "x"), ("a", "y"))
    assert [r["id"] for r in patterns.having(ids(spark, "a", "b"), "id", e).collect()] == ["a"]
    assert [r["id"] for r in patterns.having(ids(spark, "a", "b"), "id", e, negate=True).collect()] == ["b"]


def test_null_sort_keys(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    assert [r["k"] for r in df.orderBy(F.asc_nulls_last("k")).collect()] == [1, 2, None]
    assert [r["k"] for r in df.orderBy(F.desc_nulls_first("k")).collect()] == [None, 2, 1]


@pytest.mark.parametrize("size", [2, 40])
def test_components(spark, size):
    chain = [(i, i + 1) for i in range(size)] + [(100, 101), (101, 100), (7000, 7000), (None, 3)]
    star = [(500, 500 + i) for i in range(1, 50)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(size + 1)} | {100: 100, 101: 100} | {500 + i: 500 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_tree(spark):
    df = spark.createDataFrame([("a/b/c/d",), ("a/x",), ("/a//b",)], "path string")
    assert {(r["parent"], r["child"]) for r in expand.prefix_tree(df, "path", 3).collect()} == {("", "a"), ("a", "a/b"), ("a/b", "a/b/c"), ("a", "a/x")}


FILES = [(10, "/path/to/repo/src/main.py"), (11, "/path/to/repo/src/utils/helpers.py"), (12, "/path/to/repo/tests/test_main.py")]


@pytest.mark.parametrize(("path", "wanted"), [("src/main.py", 10), ("/path/to/repo/src/main.py", 10), ("src\\utils\\helpers.py", 11), ("helpers.py", 11), ("tests/test_main.py", 12), ("./src/main.py", 10), ("main", 10), ("unknown_file.py", None)])
def test_path_mapping(spark, path, wanted):
    files = spark.createDataFrame(FILES, "file_id long, path string")
    got = patterns.match_paths(spark.createDataFrame([(1, path)], "node_id long, path string"), files).collect()
    assert [r["file_id"] for r in got] == ([wanted] if wanted else [])


def test_path_mapping_prefers_the_longest_suffix(spark):
    files = spark.createDataFrame([(1, "r/a/x.py"), (2, "r/b/x.py"), (3, "x.py")], "file_id long, path string")
    got = patterns.match_paths(spark.createDataFrame([(7, "b/x.py")], "node_id long, path string"), files).first()
    assert (got["file_id"], got["rank"]) == (2, 1)


def test_upsert_and_properties(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, mutations.upsert(old, new, ["k"]).collect())) == [(1, "a", "x"), (2, "b", None), (3, "c", None)]
    df = spark.createDataFrame([({"a": "1", "b": "2"},), (None,)], "m map<string,string>")
    out = df.select(mutations.set_properties(F.col("m"), F.create_map(F.lit("b"), F.lit("9"))).alias("m")).collect()
    assert [r["m"] for r in out] == [{"a": "1", "b": "9"}, {"b": "9"}]


def test_edges_merge_and_detach_delete(spark):
    e = graph(spark, ("a", "b"), ("b", "c"))
    more = spark.createDataFrame([("n1", "a", "b", "CALLS"), ("n2", "c", "a", "CALLS"), ("n3", "c", "a", "CALLS")], EDGES)
    merged = mutations.merge_edges(e, more)
    assert merged.count() == 3
    left, kept = mutations.detach_delete(ids(spark, "a", "b", "c"), merged, ids(spark, "b"))
    assert {r["id"] for r in left.collect()} == {"a", "c"} and [(r["src"], r["dst"]) for r in kept.collect()] == [("c", "a")]


def test_clear_needs_the_code(spark):
    df = ids(spark, "a")
    with pytest.raises(PermissionError):
        mutations.clear(df, "wrong")
    assert mutations.clear(df, "CONFIRM").count() == 0


def test_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert [(r["k"], r["n"]) for r in duplicate_keys(df, "k").collect()] == [(1, 3)]
    assert surrogate_ids(df).select("row_id").distinct().count() == 4


def test_half_even_scores(spark):
    df = spark.createDataFrame([("critical",), ("HIGH",), ("Medium",)], "s string")
    assert df.agg(aggregates.risk_score(F.col("s")).alias("r")).first()["r"] == 70.0
    assert df.filter("s = 'none'").agg(aggregates.risk_score(F.col("s")).alias("r")).first()["r"] == 0.0
    assert spark.range(1).select(F.bround(F.lit(0.25), 1).alias("a"), F.bround(F.lit(2.5), 0).alias("b")).first() == (0.2, 2.0)


def test_zero_fill_and_trend(spark):
    df = spark.createDataFrame([("a",), ("a",), ("z",)], "s string")
    assert {(r["v"], r["n"]) for r in aggregates.zero_filled(df, "s", ["a", "b"], "v").collect()} == {("a", 2), ("b", 0)}
    s = spark.createDataFrame([("p", 1, 100.0), ("p", 2, 130.0), ("q", 1, 100.0), ("q", 5, 101.0), ("r", 1, 10.0), ("r", 2, 5.0)], "k string, t int, v double")
    assert {r["k"]: (r["trend"], r["leak"]) for r in aggregates.trend(s, ["k"], "t", "v").collect()} == {"p": ("growing", True), "q": ("stable", False), "r": ("shrinking", False)}


def test_typed_paths_equal_paths(spark):
    """Paths along the labels are the trails that the untyped expansion finds, parallel and repeated edges included."""
    likes = [("a1", "b1"), ("a1", "b1"), ("a1", "b2"), ("a2", "b2")]
    links = [("b1", "b2"), ("b2", "b1"), ("b2", "b2")]
    ends = [("b1", "c1"), ("b2", "c1"), ("b2", "c2")]
    rows = [(f"e{i}", s, d, t) for i, (t, s, d) in enumerate((t, s, d) for t, es in (("LIKES", likes), ("LINKS", links), ("ENDS", ends)) for s, d in es)]
    e = spark.createDataFrame(rows, "eid string, src string, dst string, type string")
    of = lambda t: e.filter(F.col("type") == t).drop("type")
    typed = {"LIKES": ("A", "B", of("LIKES")), "LINKS": ("B", "B", of("LINKS")), "ENDS": ("B", "C", of("ENDS"))}
    start = spark.createDataFrame([("a1",), ("a2",)], "id string")
    c = spark.createDataFrame([("c1",), ("c2",)], "id string")
    want = sorted(tuple(r) for r in expand.paths(start, e, 1, 4, ends=c).select("start", "finish", "hops").collect())
    assert want and sorted(tuple(r) for r in expand.typed_paths(start, "A", typed, 1, 4, "C").collect()) == want
    every = sorted(tuple(r) for r in expand.paths(start, e, 0, 3).select("start", "finish", "hops").collect())
    assert sorted(tuple(r) for r in expand.typed_paths(start, "A", typed, 0, 3).collect()) == every
    once = {(r["start"], r["finish"]) for r in expand.typed_paths(start, "A", typed, 1, 4, "C", pairs=True).collect()}
    assert once == {(a, b) for a, b, _ in want}
    assert expand.typed_paths(start, "A", typed, 1, 1, "C").count() == 0
