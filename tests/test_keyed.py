"""Keyed fetches, tables changed partition by partition, and pointer doubling."""

import http.server
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from graphweir.operators import expand, mutations
from graphweir.plans.keyed import BUCKET, KeyedTable
from graphweir.sources import fetch


@pytest.fixture
def service():
    """A local service that has the records with even keys, and the keys that were asked for."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            key = self.path.rsplit("/", 1)[-1]
            asked.append(key)
            if key == "13":
                self.send_response(500)
                self.end_headers()
            elif int(key.split("%")[0]) % 2:
                self.send_response(404)
                self.end_headers()
            else:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(f"record {key}".encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/cve/{{id}}", asked
    server.shutdown()


def test_second_run_asks_for_nothing_and_new_keys_alone(spark, service, tmp_path):
    url, asked = service
    ids = spark.createDataFrame([("2",), ("3",), ("2",), (None,), ("x y",), ("4",)], "id string")
    landing = f"file://{tmp_path}/landing"
    want = sorted([("2", 200, "record 2"), ("2", 200, "record 2"), ("3", 404, None), ("4", 200, "record 4"), ("x y", None, None), (None, None, None)], key=str)
    for run in range(2):
        got = sorted((tuple(r) for r in fetch.fetched(ids, "id", url, landing, r"^\d+$").collect()), key=str)
        assert got == want and sorted(asked) == ["2", "3", "4"], run
    more = fetch.fetched(spark.createDataFrame([(6,), (4,)], "id int"), "id", url, landing).collect()
    assert sorted((r.id, r.body) for r in more) == [(4, "record 4"), (6, "record 6")] and sorted(asked) == ["2", "3", "4", "6"]
    with pytest.raises(Exception, match="500"):  # a failing service is no missing record
        fetch.fetched(spark.createDataFrame([("13",)], "id string"), "id", url, landing)
    assert fetch.fetched(ids.limit(0), "id", url, f"file://{tmp_path}/none").count() == 0


def test_filters_become_requests(spark, service):
    url, asked = service
    rows = fetch.records(spark, url, keys="2")
    got = rows.filter(F.col("id").isin("2", "4", "5", "8") & (F.col("id") != "8") & (F.col("status") == 200))
    assert sorted(r.body for r in got.collect()) == ["record 2", "record 4"] and sorted(asked) == ["2", "4", "5", "8"]
    assert got.rdd.getNumPartitions() == 2
    asked.clear()
    assert rows.filter("id = '6'").first().body == "record 6" and asked == ["6"]
    assert rows.filter("id = '6' and id in ('2', '4')").count() == 0
    with pytest.raises(Exception, match="needs a filter"):
        fetch.records(spark, url).collect()


def test_merge_rewrites_the_partitions_of_its_keys_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = KeyedTable(spark, "file://" + path, ["k"], 16)
    rows = [(i, f"n{i}", None if i % 3 else i) for i in range(200)] + [(None, "none", 1)]
    first = spark.createDataFrame(rows, "k long, name string, v long")
    table.create(first)
    files = lambda: {b: sorted(p.name for p in (tmp_path / "t").glob(f"{BUCKET}={b}/*.parquet")) for b in range(16)}
    before = files()
    changes = [(3, None, 33), (3, None, 30), (777, "new", None), (None, "lost", 5)]
    touched = table.merge(spark.createDataFrame(changes, "k int, name string, v long"))
    after = files()
    assert 1 <= len(touched) <= 2 and all((before[b] == after[b]) == (b not in touched) for b in range(16))
    want = {(k, n, 33 if k == 3 else v) for k, n, v in rows} | {(777, "new", None)}
    assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == len(want)
    assert table.merge(spark.createDataFrame(changes, "k int, name string, v long")) == touched and table.read().count() == len(want)
    assert [tuple(r) for r in table.find(777).collect()] == [(777, "new", None)] and table.find(-1).count() == 0
    assert "PartitionFilters: [isnotnull(gw_bucket" in table.find(777)._jdf.queryExecution().executedPlan().toString()
    plain = mutations.upsert(first, spark.createDataFrame([(3, None, 33), (777, "new", None)], "k long, name string, v long"), ["k"])
    assert {tuple(r) for r in plain.collect()} == want
    gone = table.delete(spark.createDataFrame([(777,), (9999,), (None,)], "k long"))
    assert len(gone) == 1 and table.read().count() == len(want) - 1
    with pytest.raises(ValueError, match="lacks"):
        table.merge(spark.createDataFrame([(1, 2)], "k long, w long"))
    assert table.merge(spark.createDataFrame([], "k long, v long")) == []


def test_delete_of_a_whole_partition(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["a", "b"], 64)
    table.create(spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "a int, b string, c double"))
    table.delete(spark.createDataFrame([(1, "x"), (2, "x")], "a int, b string"))
    assert [tuple(r) for r in table.read().collect()] == [(2, "y", 2.0)]


def test_a_chain_of_5000_in_14_rounds(spark):
    n = 5000
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "src long, dst long")
    out = expand.climb(edges, max_rounds=14).collect()
    assert {r.id: (r.root, r.depth) for r in out} == {order[i]: (order[-1], n - 1 - i) for i in range(n)}


def test_climbing_forests_and_cycles(spark):
    rng = random.Random(2)
    parent = {i: rng.randrange(i) for i in range(1, 300) if rng.random() < 0.95} | {i: 0 for i in range(300, 600)}  # a hub too
    parent |= {1000: 1001, 1001: 1002, 1002: 1000, 1003: 1000, 1004: 1003, 2000: 2000, 2001: 2000}

    def plain(x):
        seen, d = {x}, 0
        while x in parent:
            x, d = parent[x], d + 1
            if x in seen:
                return None, None
            seen.add(x)
        return x, d

    rows = [*parent.items()] * 2 + [(None, 1), (5, None)]
    out = expand.climb(spark.createDataFrame(rows, "src long, dst long"))
    assert {r.id: (r.root, r.depth) for r in out.collect()} == {x: plain(x) for x in {*parent, *parent.values()}}
    assert out.count() == len({*parent, *parent.values()})
    with pytest.raises(ValueError, match="two parents"):
        expand.climb(spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"))
    assert expand.climb(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("shape", ["forest", "dag", "cycle"])
def test_ancestors_of_any_graph(spark, shape):
    pairs = {"forest": [(0, 1), (1, 2), (1, 3), (4, 5), (0, 1)], "dag": [(0, 2), (1, 2), (2, 3), (0, 3)], "cycle": [(0, 1), (1, 2), (2, 0), (2, 3)]}[shape]
    edges = spark.createDataFrame([(str(k), a, b, "T") for k, (a, b) in enumerate(pairs)], "eid string, src long, dst long, type string")
    above = {x: {a for a, b in pairs if b == x} for p in pairs for x in p}
    for _ in range(9):
        above = {x: s | {y for a in s for y in above[a]} for x, s in above.items()}
    assert {r.id: r.depth for r in expand.ancestors(edges).collect()} == {x: len(s) for x, s in above.items() if s}


@pytest.fixture
def paged():
    """A local service of pages, which has the records with even keys below 30000, and the pages that were asked for."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.rsplit("/", 1)[-1]
            asked.append(name)
            keys = [f"{name}{k:04d}" for k in range(0, 10000, 2)] if name in ("00", "01", "02") else []
            self.send_response(200 if keys else 404)
            self.end_headers()
            self.wfile.write("\n".join(f'{{"id": "{k}", "v": " "}}' for k in keys).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/cve/{{page}}", asked
    server.shutdown()


def test_a_page_is_requested_once_for_all_of_its_keys(spark, paged, tmp_path):
    url, asked = paged
    ids = spark.range(0, 40000, 3).unionByName(spark.range(5)).repartition(7).select(F.format_string("%06d", "id").alias("id"))
    for run in range(2):
        got = fetch.fetched(ids, "id", url, f"file://{tmp_path}/landing").collect()
        assert len(got) == 13334 + 5 and all((r.status, r.body) == ((200, f'{{"id": "{r.id}", "v": " "}}') if int(r.id) < 30000 and int(r.id) % 2 == 0 else (404, None)) for r in got)
        assert sorted(asked) == ["00", "01", "02", "03"], run
    asked.clear()
    found = fetch.records(spark, url).filter(F.col("id").isin("000002", "000003", "010004", "000006") & (F.col("status") == 200)).collect()
    assert sorted(r.id for r in found) == ["000002", "000006", "010004"] and sorted(asked) == ["00", "01"]


def test_service_has_a_folder_for_a_page_and_long_keys_stay_apart(spark, tmp_path):
    """A folder for each record took 46 s for 1948 records; keys of seven digits were cut to six."""
    from graphweir.queries import more

    keys = [*range(20000), 100000, 1000000, 1000001]
    spark.createDataFrame([(k, f"n{k}", 1) for k in keys], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, 5, k) for k in [7, 100000, 100001, 1000000, 1000001, 1000002]], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    url = more._service(spark, f"file://{tmp_path}")
    folder = url.removeprefix("file://").split("/page=")[0]
    assert sorted(n for n in os.listdir(folder) if "=" in n) == ["page=CVE-2024-00", "page=CVE-2024-01", "page=CVE-2024-10", "page=CVE-2024-100"]
    got = {r.l_orderkey: (r.status, r.description) for r in more.s16_keyed(spark, f"file://{tmp_path}").collect()}
    assert got == {7: (200, "n7"), 100000: (200, "n100000"), 100001: (404, None), 1000000: (200, "n1000000"), 1000001: (200, "n1000001"), 1000002: (404, None)}
    assert more.s16_point(spark, f"file://{tmp_path}").count() == 101
