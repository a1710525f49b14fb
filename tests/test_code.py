"""Metrics, data-flow, parsing, questions, reviews, streams: small exact cases."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.functions import code as C
from codeloom.functions import questions as Q
from codeloom.operators import dataflow as X
from codeloom.operators import impact
from codeloom.operators import review as R
from codeloom.sources import discovery, github, parsing, sinks, webhooks
from codeloom.streaming import events

DEEP = "def f(a):\n    if a:\n        for b in a:\n            if b:\n                while b:\n                    pass\n"
EXAMPLE = '\ndef example():\n    """Docstring."""\n    # comment\n    x = 1\n\n    y = 2\n    return x\n'


def _files(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file_path string, text string")


def test_metrics(spark):
    f = _files(spark, DEEP, "def complex_function(a):\n    if a:\n        for x in a:\n            if x:\n                for y in x:\n                    if y:\n                        return y\n", EXAMPLE)
    assert f.select(C.nesting_depth(F.col("text"))).first()[0] == 5
    assert {r.file_path: r.cognitive for r in C.cognitive(C.lines(f)).collect()}["1"] == 16
    counts = C.line_counts(C.lines(f)).where("file_path = '2'").first()
    assert (counts.code_lines, counts.comment_lines, counts.blank_lines) == (4, 2, 3)


def test_dataflow(spark):
    lines = C.lines(_files(spark, "def add(x, y):\n    result = x + y\n    return result\n"))
    a = X.assignments(lines)
    assert X.def_use_edges(a).count() == 0
    assert [(r.src_line, r.dst_line) for r in X.return_edges(a, X.returns(lines)).collect()] == [(2, 3)]
    flow = spark.createDataFrame([("x", "y"), ("y", "z")], "src string, dst string")
    start = spark.createDataFrame([("z",)], "id string")
    assert [r.id for r in X.trace(flow, start, True).collect()] == ["x"]
    files = spark.createDataFrame([("a.py", "def add(x, y):\n    result = x + y\n    return result\n")], "file_path string, text string")
    add = spark.createDataFrame([("a.py", "add", 1, "def add(x, y):\n    result = x + y\n    return result", [("x", None), ("y", "int")])], "file_path string, name string, start_line int, source_code string, parameters array<struct<name:string,type_annotation:string>>")
    nodes, edges = X.flow_graph(files, add)
    assert {(r.id, r.line, r.scope, r.data_type) for r in nodes.collect()} == {("assign_1", 1, "<module>", None), ("param_2", 1, "add", None), ("param_3", 1, "add", "int"), ("assign_4", 2, "add", None), ("return_5", 3, "add", None)}
    assert [tuple(r) for r in edges.collect()] == [("a.py", "assign_4", "return_5", "return_value")]
    assert X.definitions(nodes, "x").isEmpty() and X.definitions(nodes, "result").count() == 2 and X.uses_of(nodes, "x").isEmpty()
    assert X.node(nodes, "a.py", "param_3").first().name == "y" and X.incoming(edges, "a.py", "return_5").count() == 1 and X.outgoing(edges, "a.py", "return_5").isEmpty()
    assert {r.id for r in X.tainted(flow, spark.createDataFrame([("x",)], "id string")).collect()} == {"x", "y", "z"}


def test_parser():
    source = "import os\nfrom a.b import c as d\nVERSION = 1\n@dec(1)\nclass A(B, Generic[T]):\n    x: int = 1\n    async def m(self, *args, k: int = 2, **kw) -> int:\n        'Doc.'\n        return log.info(f(1))\n    @property\n    def p(self): return 1\n"
    rows = {(r["type"], r["name"]): r for r in parsing.parse_source("pkg/mod.py", source)}
    m = rows["method", "m"]
    assert m["is_async"] and m["calls"] == ["log.info", "f"] and m["return_type"] == "int" and m["docstring"] == "Doc."
    assert [p["name"] for p in m["parameters"]] == ["self", "args", "k", "kw"] and m["parameters"][1]["is_variadic"] and m["parameters"][3]["is_keyword"]
    assert rows["class", "A"]["bases"] == ["B", "Generic[T]"] and rows["class", "A"]["decorators"] == ["dec"]
    assert rows["variable", "VERSION"]["is_constant"] and rows["method", "p"]["is_property"]
    assert rows["import", "a.b"]["import_names"] == ["c as d"]
    broken = parsing.parse_source("x.py", "def f(:\n")
    assert len(broken) == 1 and broken[0]["error"].startswith("Syntax error at line 1")


def test_routing(spark):
    asked = {"Explain how the login function works": ("explain", 0.5), "Trace the execution flow of process_request": ("trace", 1.0), "Find all functions that use the database": ("find", 0.5), "Debug the error in the authentication module": ("debug", 1.0), "Review this code for issues": ("review", 1.0), "Hello, can you help me today?": ("general", 0.5)}
    got = Q.route(spark.createDataFrame([(t,) for t in asked], "text string")).collect()
    assert {r.text: (r.query_type, r.confidence) for r in got} == asked
    assert spark.createDataFrame([("Explain how the login function works",)], "t string").select(Q.entities(F.col("t"))).first()[0] == ["login", "works"]


def test_context(spark):
    s = spark.createDataFrame([("q", i, r, 20) for i, r in enumerate([0.9, 0.8, 0.7, 0.3])], "q string, snippet_id int, relevance double, tokens int")
    assert Q.pack_context(s, "q", 50).count() == 2 and Q.pack_context(s, "q", 8000).count() == 3
    assert round(Q.confidence(s.where("relevance > 0.5"), "q").first().confidence, 6) == 0.704


def test_recommendations(spark):
    """Six direct callers in six files, a deletion, risk 75: seven strings."""
    r = spark.createDataFrame([(75, 6, 6, "DELETE"), (75, 6, 6, "RENAME"), (40, 0, 1, "MODIFY"), (30, 0, 1, "MODIFY"), (60, 0, 1, "MOVE")], "risk int, direct bigint, files bigint, change string")
    got = [x[0] for x in r.select(impact.recommendations()).collect()]
    assert [len(x) for x in got] == [7, 7, 1, 0, 1]
    assert got[0][2:6] == ["Update 6 direct callers that may be affected", "Verify all callers have been updated or removed", "Consider deprecation period before full removal", "Changes may affect 6 files"] and got[2] == ["Review changes for backward compatibility"]


def test_rules_by_hand(spark):
    f = _files(spark, "class A:\n  self._component = x\n  self._component.run()\n", "class B:\n    _instance: S = None\n  x\n  cls._instance\n", "def create_car(x):\n", "x = 500 # ok\n  LIMIT = 2\nFROZEN = y # frozen\n_A = []\nget_instance()\n")
    lines = C.lines(f)
    assert [(r.file_path, r.start_line, r.end_line) for r in C.decorators(lines).collect()] == [("0", 2, 3)]
    assert [(r.file_path, r.start_line, r.end_line) for r in C.singletons(lines).collect()] == [("1", 2, 4)]
    assert [r.entity for r in C.factories(lines).collect()] == ["create_car"]
    assert {(r.line, r.pattern) for r in C.regex_patterns(lines).where("file_path = '3'").collect()} == {(1, "magic_numbers"), (4, "global_state")}
    said = {"walking through the parser": "explain", "which modules?": "find", "broken build": "generate", "any issues?": "review"}  # of equal scores the first type
    assert {r.text: r.query_type for r in Q.route(spark.createDataFrame([(t,) for t in said], "text string")).collect()} == said
    assert [r[0] for r in spark.createDataFrame([(t,) for t in list(said)[1:]], "t string").select(Q.classify_keywords(F.col("t"))).collect()] == ["find", "debug", "review"]


def test_metrics_of_entities(spark):
    e = parsing.measured(parsing.parse(spark.createDataFrame([("m.py", "class K:\n    def a(self, x):\n        if x:\n            return 1\n    def b(self): return 2\n")], "path string, text string")))
    got = {r.name: r for r in C.entity_metrics(e, spark.createDataFrame([("m.py:a:2", "m.py:b:5"), ("m.py:a:2", "m.py:b:5")], "src string, dst string")).collect()}
    assert (got["a"].cyclomatic, got["a"].coupling_score, got["a"].dependency_count, got["b"].dependent_count, got["b"].coupling_score) == (2, 1.0, 2, 2, 0.0)
    assert {r.name: (r.methods, r.parameters) for r in e.collect()} == {"K": (2, 0), "a": (0, 2), "b": (0, 1)}


def test_github_records(spark):
    user, commit = {"id": 7, "login": "u"}, {"sha": "s", "commit": {"message": "m"}, "author": {"name": "no id"}, "parents": [{"sha": "p"}], "files": [{"filename": "f.py", "additions": 2}]}
    pull = {"id": 1, "number": 2, "title": "t", "state": "closed", "merged": True, "head": {"ref": "h", "sha": "1"}, "labels": [{"name": "bug"}]}
    body = lambda x: spark.createDataFrame([(json.dumps(x),)], "body string")
    p = github.pull_requests(body(pull)).first()
    assert (p.state, p.user.login, p.head.ref, p.base.ref, p.labels, p.commits) == ("merged", "unknown", "h", "", ["bug"], 0)
    assert [(r.number, r.state) for r in github.pull_requests(body([pull, pull | {"merged": False}, pull | {"merged": None, "state": "odd"}]), many=True).collect()] == [(2, "merged"), (2, "closed"), (2, "open")]
    c = github.commits(body(commit)).first()
    assert (c.message, c.author, c.parents, c.files[0].status, c.files[0].deletions) == ("m", None, ["p"], "modified", 0)
    assert github.commits(body(commit | {"author": user, "commit": None, "message": "own"})).first().author.id == 7
    assert github.repositories(body({"id": 1, "name": "n"})).first()[3:8] == ((0, "unknown", None, None, None, None), False, None, None, "main")
    assert github.comments(body([{"id": 1, "user": user}])).first()[:2] == (1, "") and github.reviews(body([{"id": 1}])).first().state == "COMMENTED"
    assert github.branches(body({"ref": "r"})).first()[:2] == ("r", "") and github.files(body([{"filename": "x"}])).first().changes == 0
    x = github.comparisons(body({"status": "ahead", "ahead_by": 1, "commits": [commit], "files": []})).first()
    assert (x.ahead_by, x.behind_by, x.commits[0].sha, x.files) == (1, 0, "s", [])
    assert github.pull_requests(spark.createDataFrame([("no json",), (None,)], "body string")).isEmpty()


def test_sinks(spark, tmp_path):
    answers = spark.createDataFrame([("1", "completed", "find", "here", 0.5, [("f.py", 1)], ["more?"], None, 2.0, 3, "2024-01-02 03:04:05"), ("2", "failed", "find", None, None, None, None, "no", 0.0, 0, "2024-01-02 03:04:05")], "request_id string, status string, query_type string, answer string, confidence double, sources array<struct<file_path:string,start_line:int>>, follow_ups array<string>, error string, processing_time_ms double, tokens_used int, created_at string")
    out = {r.request_id: (r.success, json.loads(r.response)) for r in sinks.responses(answers.withColumn("created_at", F.to_timestamp("created_at"))).collect()}
    assert out["1"][0] and out["1"][1]["result"]["follow_up_questions"] == ["more?"] and out["1"][1]["created_at"] == "2024-01-02T03:04:05" and out["1"][1]["error"] is None
    assert not out["2"][0] and out["2"][1]["result"] is None and out["2"][1]["error"] == "no"
    sinks.write_json(answers.select("request_id", "error"), str(tmp_path / "j"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).orderBy("value").collect()] == [{"request_id": "1", "error": None}, {"request_id": "2", "error": "no"}]


def test_review(spark):
    p = spark.createDataFrame([(1, "f", "@@ -10,3 +10,4 @@\n ctx\n-old\n+new\n+eval(x)\n end")], "pr int, file string, patch string")
    lines = R.diff_lines(p, ["pr", "file"])
    assert [r.new_line for r in lines.orderBy("position").collect()] == [10, None, 11, 12, 13]
    found = R.comments(lines, ["pr", "file"])
    assert [(r.severity, r.new_line) for r in found.collect()] == [("ERROR", 12)]
    v = R.verdict(found, lines, "pr", "file").first()
    assert (v.additions, v.deletions, v.status, v.issues_found, v.suggestions) == (2, 1, "REQUEST_CHANGES", 1, 0) and v.summary.endswith("\n- 1 error(s) found")
    assert [r.category for r in found.collect()] == ["security"]
    request = json.loads(github.review_requests(R.verdict(found, lines, "pr", "file"), found, "pr", "file").first().request)
    assert request["event"] == "REQUEST_CHANGES" and request["comments"] == [{"path": "f", "line": 12, "body": "**SECURITY**: Avoid using eval() - security risk"}]
    odd = spark.createDataFrame([("a.py", "@@"), ("b.bin", "@@"), ("c.py", None)], "file string, patch string")
    assert [r.file for r in R.reviewable(odd).collect()] == ["a.py"]


def test_discovery(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "node_modules/b.py": "", "c.txt": "", "sub/d.JS": "1", "skip/e.py": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.language for r in discovery.discover(spark, str(tmp_path), ignore=["skip/"]).collect()}
    assert got == {"a.py": "python", "sub/d.JS": "javascript"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = json.dumps({"action": "opened", "pull_request": {"state": "open"}})
    rows = [{"delivery_id": d, "event_type": "pull_request", "received": "2024-01-01T00:00:00Z", "payload": body} for d in ("1", "1", "2")]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    events.start(events.deliveries(spark, str(tmp_path / "in")).select("delivery_id", "handler"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1", "pull_request"), ("2", "pull_request")]


def test_signature(spark):
    df = spark.createDataFrame([("b", None), (None, "x")], "b string, s string")
    assert [r[0] for r in df.select(webhooks.valid_signature(F.col("b"), F.col("s"), "k")).collect()] == [False, False]


def test_entities_leave_in_small_batches():
    """Whatever the size of a batch of sources; all rows, in order."""
    fields = ("file_path", "id", "name", "type", "source_code")
    schema = pa.schema([(f, pa.string()) for f in fields])
    sources = [(f"{i}.py", f"def f{i}():\n    return {i}\n" if i % 3 else None) for i in range(2000)]
    want = [tuple(r[f] for f in fields) for p, t in sources for r in parsing.parse_source(p, t or "")]
    for more, most in (({}, parsing.PASS_ROWS), ({"most_chars": 100}, 20)):
        found = list(parsing.entity_batches([pa.RecordBatch.from_pydict(dict(zip(("path", "text"), map(list, zip(*sources)))))], schema, **more))
        assert max(b.num_rows for b in found) <= most
        assert [tuple(r.values()) for b in found for r in b.to_pylist()] == want


def test_lines_of_patches_without_a_shuffle(spark):
    """Patches are read one by one, also those with the same keys; long ones leave in several batches."""
    patch = "a\n@@ -1 +5,2 @@ x\n-a\n+b\n c\n@@ -9,1 +20 @@\n\n+d\n@@ no header"
    want = [(2, "-a", 1, "remove", None), (3, "+b", 1, "add", 5), (4, " c", 1, "context", 6), (6, "", 2, "context", 20), (7, "+d", 2, "add", 21), (8, "@@ no header", 2, "context", 22)]
    found = R.diff_lines(spark.createDataFrame([(1, patch), (1, patch), (2, None), (3, "no hunk")], "pr int, patch string"), ["pr"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, *w) for w in want * 2], key=str)
    out = list(R.placed_lines([pa.RecordBatch.from_pydict({"pr": [7, 8], "patch": [patch, patch]})], 4))
    assert [b.num_rows for b in out] == [4, 4, 4, 0] and [tuple(r.values()) for b in out for r in b.to_pylist()] == [(k, *w) for k in (7, 8) for w in want]


def test_cohesion_builds_no_pairs(spark):
    """No method is joined with another; what two share twice counts once, a missing attribute is none."""
    uses = [("A", 1, "x"), ("A", 2, "x"), ("A", 2, "y"), ("A", 1, "y"), ("A", 3, "y"), ("A", 4, None), ("A", 5, None), ("B", 1, "x"), ("B", 1, "x")]
    found = C.cohesion(spark.createDataFrame(uses, "class_id string, method_id int, attribute string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {tuple(r) for r in found.collect()} == {("A", 5, 3 / 10), ("B", 1, 1.0)}
