"""Findings, audit log, funnels, vectors, sources, streaming: small fixtures with known results."""

import datetime as dt
import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from graphweir.functions import text as rules
from graphweir.operators import audit, findings, funnels, vector
from graphweir.sources import feeds, files
from graphweir.streaming import events as ev

FINDINGS = [("finding-1", "sql_injection", "high", "CWE-89", 0.9), ("finding-2", "xss", "medium", "CWE-79", 0.8), ("finding-3", "sql_injection", "critical", "CWE-89", 0.7)]


@pytest.mark.parametrize(("equal", "least", "n"), [({}, None, 3), ({"type": "sql_injection"}, None, 2), ({"severity": "high"}, None, 1), ({"cwe": "CWE-89"}, None, 2), ({"type": None}, {"confidence": 0.8}, 2), ({"type": "sql_injection"}, {"confidence": 0.8}, 1)])
def test_findings_filter(spark, equal, least, n):
    df = spark.createDataFrame(FINDINGS, "id string, type string, severity string, cwe string, confidence double")
    assert findings.filtered(df, equal, least).count() == n


def test_finding_lifecycle(spark):
    f = spark.createDataFrame([(1, "identified"), (2, "verified"), (3, "identified"), (4, "identified")], "id int, status string")
    changes = spark.createDataFrame([(1, "IN_PROGRESS"), (2, "nonsense"), (9, "fixed")], "id int, status string")
    now = findings.updated(f, changes, "id")
    assert {r["id"]: r["status"] for r in now.collect()} == {1: "in_progress", 2: "verified", 3: "identified", 4: "identified"}
    actions = spark.createDataFrame([(1, "completed"), (1, "completed"), (2, "completed"), (2, "open"), (3, None)], "id int, status string")
    assert {r["id"]: r["status"] for r in findings.rolled_up(now, actions, "id").collect()} == {1: "fixed", 2: "verified", 3: "identified", 4: "identified"}
    left, acts = findings.deleted(now, actions, now.filter("id = 1"), "id")
    assert left.count() == 3 and acts.count() == 3


def audit_events(spark):
    t = dt.datetime(2024, 3, 1, 23, 59, 59, 123456)
    rows = [(f"e{i}", "login" if i % 2 else "access", f"u{i % 3}", "auth", {"k": str(i), "a": "b"}, "INFO", t + dt.timedelta(minutes=i), None, None if i == 4 else i != 3, "r1", None) for i in range(6)]
    schema = "event_id string, event_type string, user_id string, component string, details map<string,string>, level string, timestamp timestamp, source_ip string, success boolean, resource_id string, session_id string"
    return audit.with_checksum(spark.createDataFrame(rows, schema))


def test_audit_log_on_disk(spark, tmp_path):
    key = F.unhex(F.md5(F.lit("secret of the test")))
    audit.write_log(audit_events(spark), str(tmp_path / "log"), key)
    raw = spark.read.schema("value string, date date").text(str(tmp_path / "log"))
    assert raw.filter("value like 'ENC:%'").count() == 6
    tampered = raw.select("date", "value").unionByName(spark.createDataFrame([(dt.date(2024, 3, 2), "{bad"), (dt.date(2024, 3, 2), '{"event_id": "x", "event_type": "login", "timestamp": "2024-03-02T00:00:00.000000Z", "checksum": "0"}'), (dt.date(2024, 3, 2), '{"event_id": "y", "event_type": "login", "timestamp": "2024-03-02T00:00:00.000000Z"}')], "date date, value string"))
    log = audit.parsed(tampered, key)
    start, end = dt.datetime(2024, 3, 1, 23, 59), dt.datetime(2024, 3, 2, 0, 4)
    got = [r["event_id"] for r in audit.query_events(log, start, end).collect()]
    assert got == ["e4", "e3", "e2", "e1", "y", "e0"]
    assert [r["event_id"] for r in audit.query_events(log, start, end, success=False).collect()] == ["e3"]
    assert [r["event_id"] for r in audit.query_events(log, start, end, ["login"], user_id="u0").collect()] == ["e3"]
    plan = audit.query_events(audit.read_log(spark, str(tmp_path / "log"), key), start, end)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_documentation_analyzer(spark):
    df = spark.createDataFrame([(1, "This function gets user input from a form and returns it", "f.py"), (2, "This function executes an SQL query on the database.", None), (3, "Nothing here", "g.py")], "node_id long, description string, file_path string")
    assert {r["node_id"]: r["file_path"] for r in funnels.KeywordFunnel().sinks(df).collect()}[2] == "unknown"
    got = {r["node_id"]: r["kind"] for r in funnels.typed(df, funnels.DocumentationAnalyzer(), "source").collect()}
    assert got[1] == "user_input" and 3 not in got
    sinks = {r["node_id"]: (r["kind"], r["confidence"]) for r in funnels.typed(df, funnels.DocumentationAnalyzer(), "sink").collect()}
    assert sinks[2] == ("database_write", 0.5)
    both = spark.createDataFrame([(1, "It definitely is a source of user input, it gets data")], "node_id long, description string")
    first = funnels.cascade(both, [funnels.AnswerAnalyzer(), funnels.DocumentationAnalyzer()], "source").first()
    assert (first["analyzer"], first["kind"], first["confidence"]) == (0, "user_input", 0.9)
    none = funnels.markdown_lines(both.limit(0).selectExpr("'n' name", "'k' kind", "1D confidence", "description", "1 o"), "Sinks", "o", "No sinks identified.")
    assert [r["line"] for r in none.orderBy("part", "at", "k").collect()] == ["## Sinks (0)", "", "No sinks identified.", ""]


def test_vector_guards(spark):
    rows = [(1, [0.1, 0.2, 0.3]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [0.3, -0.15, 0.0]), (5, [0.1, 0.2]), (6, [1.0, 2.0, 3.1])]
    out = vector.search(spark.createDataFrame(rows, "vec_id int, e array<float>"), "e", [0.1, 0.2, 0.3], 0.8, 2).collect()
    assert [r["vec_id"] for r in out] == [1, 6] and abs(out[0]["similarity_score"] - 1) < 1e-6


def test_text_rules(spark):
    df = spark.createDataFrame([("a\nb\nc\nd",)], "t string")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(rules.code_slice(F.col("t"), F.lit(2), F.lit(3))) == "b\nc" and one(rules.code_slice(F.col("t"), F.lit(0), F.lit(99))) == "a\nb\nc\nd" and one(rules.code_slice(F.col("t"), F.lit(9), F.lit(12))) == ""
    assert [one(rules.newer(F.lit(a), F.lit(b))) for a, b in (("1.10.0", "1.9"), ("1.2", "1.2.0"), ("2.0", "10.0"))] == [True, False, False]
    assert [one(rules.language_of(F.lit(p))) for p in ("x/y.PY", "a.tsx", "Makefile")] == ["python", "typescript", "unknown"]
    assert [one(rules.normalized_language(F.lit(p))) for p in ("TS", "Java 17", "JavaScript", "Python 3", "CSharp", "Rust")] == ["JavaScript", "Java", "JavaScript", "Python", "C#", "Rust"]
    assert one(rules.wanted_path(F.lit("src/node_modules/x.js"))) is False and one(rules.wanted_path(F.lit("src/x.js"))) is True and one(rules.wanted_path(F.lit("src/x.PNG"))) is False
    assert one(rules.first_match(F.lit("#include <x> { }"), rules.CONTENT_RULES, "Unknown", fold=False)) == "C/C++"
    assert [one(rules.valid_cve(F.lit(v))) for v in ("CVE-2024-12345", "CVE-24-1", None)] == [True, False, False]
    assert [one(rules.clamped(F.lit(v))) for v in (-1.0, 0.5, 7.0, 70.0)] == [0.0, 0.5, 0.7, 1.0]
    assert one(rules.keyword_confidence(F.lit("read read READ"), ("read",))) == pytest.approx(0.6)


def test_files_and_sections(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/deep/b.md": b"caf\xe9", "node_modules/c.js": b"1", "img.png": b"1", "big.txt": b"z" * 2000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    tree = files.file_tree(spark, str(tmp_path), 1000)
    assert {(r["path"], r["language"]) for r in tree.collect()} == {("src/a.py", "python"), ("src/deep/b.md", "markdown")}
    assert {r["path"] for r in files.directories(tree).collect()} == {"src", "src/deep"}
    assert {r["text"] for r in files.texts(spark, str(tmp_path)).filter("path like '%b.md'").collect()} == {"caf�"}
    stats = feeds.repository(spark, str(tmp_path)).first()
    assert stats["n_files"] == 3
    doc = spark.createDataFrame([(1, "intro\nSECTION: One\nCONTENT: a\nb\nSECTION: Two\nCONTENT: c")], "id int, text string")
    assert [(r["section_no"], r["title"], r["content"]) for r in files.sections(doc, "id", "text").orderBy("section_no").collect()] == [(1, "One", "a\nb"), (2, "Two", "c")]


def test_documents_over_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write("héllo".encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = {r["url"]: (r["status"], r["text"]) for r in files.fetched_documents(spark.createDataFrame([(base + "/ok",), (base + "/no",), (None,)], "url string")).collect()}
    server.shutdown()
    assert got == {base + "/ok": (200, "héllo"), base + "/no": (404, None)}


def test_clone_of_a_local_repository(tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "a"), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    (tmp_path / "a").mkdir()
    run("init", "-q")
    (tmp_path / "a/x.py").write_text("1")
    run("add", ".")
    run("commit", "-qm", "m")
    assert len(feeds.clone(str(tmp_path / "a"), str(tmp_path / "b"))) == 40 and (tmp_path / "b/x.py").exists()
    with pytest.raises(ValueError, match="not a repository"):
        feeds.clone("--upload-pack=x", str(tmp_path / "c"))


def test_config_layers(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "2", 9), ("b", "", 9), ("b", "x", 1), ("c", None, 1)], "key string, value string, priority int")
    assert {(r["key"], r["value"]) for r in feeds.merged_config(df).collect()} == {("a", "2"), ("b", "x")}


def attempts(rng, n):
    return [(i, rng.randrange(3), 1000.0 + sum(divmod(i, 1)) * 20 + rng.random(), rng.random() < 0.85) for i in range(n)]


def brute_locks(rows):
    out, state = [], {}
    for _, u, at, failed in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        n, until = state.get(u, (0, 0.0))
        if until > at:
            continue
        if until:
            n, until = 0, 0.0
        if not failed:
            n = 0
        else:
            n += 1
            if n >= 5:
                until = at + 300
                out.append((u, at))
        state[u] = (n, until)
    return sorted(out)


ATTEMPTS = "event_id long, user_id long, at double, failed boolean"


def test_five_failures_lock(spark):
    rows = [(i, 1, float(i), True) for i in range(5)] + [(5, 1, 100.0, False), (6, 1, 304.5, True), (7, 1, 305.0, False)]
    assert [(r["locked_at"], r["locked_until"]) for r in ev.lockouts(spark.createDataFrame(rows, ATTEMPTS)).collect()] == [(4.0, 304.0)]


def test_lockouts_equal_brute_force_in_batch_and_stream(spark, tmp_path):
    rows = attempts(random.Random(1), 300)
    df = spark.createDataFrame(rows, ATTEMPTS)
    want = brute_locks(rows)
    assert want and sorted((r["user_id"], r["locked_at"]) for r in ev.lockouts(df.repartition(5)).collect()) == want
    for k in range(3):  # three files in order of time
        df.filter(f"event_id div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ev.run(ev.lockout_stream(stream), "locks").collect()
    assert sorted((r["user_id"], r["locked_at"]) for r in got) == want


def test_complete_results_are_switched(spark, tmp_path):
    """Every batch of a complete result is written beside the one before; a failed batch leaves that one readable."""
    for k in range(4):
        spark.createDataFrame([(k, i % 3) for i in range(10 * (k + 1))], "k long, g long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, g long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ev.run(stream.groupBy("g").count(), "counts", "complete")
    assert sum(r["count"] for r in out.collect()) == 100
    (path,) = {f.rsplit("/", 2)[0] + "/" + f.rsplit("/", 2)[1] for f in out.inputFiles()}
    assert path.endswith("out-3")
    base = path.removeprefix("file://").removesuffix("/out-3")
    import os

    assert {f for f in os.listdir(base) if f.startswith("out")} == {"out-2", "out-3"}
    assert sum(r["count"] for r in spark.read.parquet(base + "/out-2").collect()) < 100
    empty = tmp_path / "none"
    empty.mkdir()
    assert ev.run(spark.readStream.schema("k long, g long").parquet(str(empty)).groupBy("g").count(), "counts", "complete").collect() == []


def test_paths_in_answers(spark):
    from graphweir.operators.answers import flow_paths

    text = "Intro\nSource 1: form\nSink: db\nVulnerability type: SQL injection\nDescription: first\nsecond\nRecommendation: bind\n- escape\nSource: a\nSink: b\nSource: c\nSink: d\nDescription: x\nThe impact is high"
    out = flow_paths(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("path_no").collect()
    assert [(r["path_no"], r["source"], r["sink"], r["vulnerability_type"], r["impact"]) for r in out] == [(1, "form", "db", "SQL injection", "high"), (2, "c", "d", "Potential data flow vulnerability", "high")]
    assert out[0]["description"] == "first\nsecond" and out[0]["recommendations"] == ["bind", "escape"]


def test_a_failing_service_gives_nulls(spark):
    from graphweir.sources.external import answered

    def connect():
        def ask(texts):
            if "bad" in texts:
                raise TimeoutError
            return [t.upper() for t in texts]

        return ask

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "bad", None, "c"])], "i int, t string").coalesce(1)
    assert {r["i"]: r["x"] for r in answered(df, "t", connect, "string", "x", 2).collect()} == {0: "A", 1: "B", 2: None, 3: None, 4: None}


def test_query_log(spark):
    from graphweir.plans.timing import QueryLog, hints

    ticks = iter([0.0, 0.05, 1.0, 3.0])
    log = QueryLog(clock=lambda: next(ticks), kept=1)
    for name in ("fast", "slow"):
        with log.timed(name):
            pass
    assert list(log.slow) == [("slow", 2.0)] and log.frame(spark).count() == 2
    assert hints("CartesianProduct\nBatchEvalPython") == ["a join without an equality", "a row-at-a-time Python function"]


def test_state_goes_with_the_lock(spark, tmp_path):
    """After the watermark has passed the lock's end, no state is left; a user with open failures keeps theirs."""
    batches = [
        [(i, 1, 1000.0 + i, True) for i in range(5)] + [(5, 2, 1001.0, True), (6, 3, 1001.0, True), (7, 3, 1002.0, False)],
        [(8, 4, 20_000.0, False)],
        [(9, 4, 20_001.0, False)],
        [(10, 1, 20_002.0 + i, True) for i in range(5)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))

    def state(upto):
        stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / f"in/k={{{','.join(map(str, range(upto)))}}}")])
        query = ev.lockout_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "login").load()
        return {r.key.user_id: r.value.failures for r in found.collect()}

    assert state(1) == {1: 5, 2: 1}
    assert state(3) == {2: 1}
    assert state(4) == {2: 1, 1: 5}
    assert sorted((r.user_id, r.locked_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1004.0), (1, 20_006.0)]


def test_flows_put_out_every_pair_of_a_file(spark, monkeypatch):
    """A row for each source and sink, not one for each pair of kinds, also where a file's sources are many shares."""
    monkeypatch.setattr(funnels, "SHARE", 3)
    schema = "name string, file_path string, kind string, description string"
    sources = [(f"s{i}", f, "user_input" if i % 2 else "file_read", "d") for f, n in (("hot", 20), ("cold", 2), ("alone", 3), ("unknown", 4), (None, 2)) for i in range(n)]
    sinks = [(f"k{i}", f, ("command_execution", "database_write", "logging")[i % 3], "d") for f, n in (("hot", 9), ("cold", 3), ("other", 2), ("unknown", 3), (None, 2)) for i in range(n)]
    out = funnels.flows(spark.createDataFrame(sources + sources[:2], schema), spark.createDataFrame(sinks, schema), funnels.DocumentationAnalyzer())
    want = [(f, s, k, *(("command injection", "high") if b == "command_execution" else ("sql injection", "medium"))) for s, f, a, _ in sources + sources[:2] for k, g, b, _ in sinks if f and f == g != "unknown" and a == "user_input" and b != "logging"]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) == 11 * 6 + 2


def test_the_sort_of_an_audit_query_does_not_open_lines_again(spark):
    start, opened = dt.datetime(2024, 1, 1), spark.sparkContext.accumulator(0)

    def through(value):
        opened.add(1)
        return value

    rows = [(f"e{i}", start + dt.timedelta(minutes=i % 7)) for i in range(50)]
    events = spark.createDataFrame(rows, "event_id string, timestamp timestamp").repartition(3).withColumn("event_id", F.udf(through, "string").asNondeterministic()("event_id"))
    got = [(r.timestamp, r.event_id) for r in audit.query_events(events, start, start + dt.timedelta(days=1), verify=False).collect()]
    assert got == sorted(((t, e) for e, t in rows), reverse=True) and opened.value == 50


def test_lines_of_a_small_file_are_sealed_in_many_tasks(spark, tmp_path):
    from graphweir.queries import reports

    rows = [(i, dt.datetime(2024, 1, 6), i, "error", 1.0, '{"a": "b"}') for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert audit.lines(reports._audit(spark, str(tmp_path))).select(F.spark_partition_id()).distinct().count() == 4
    assert reports.q1(spark, str(tmp_path)).count() == 400
