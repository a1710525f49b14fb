"""The engine over a small source tree, collections, and the git connector."""

from __future__ import annotations

import subprocess

import pytest

from pyspark.sql import functions as F

from codeloom.engine import Engine
from codeloom.operators import collection
from codeloom.operators import impact as I
from codeloom.operators import vectors as V
from codeloom.operators.store import GraphStore
from codeloom.sources import discovery
from codeloom.sources.discovery import reindex_plan, uncommitted
from codeloom.sources.git import Repository

SOURCES = {
    "app/core.py": '"""Core."""\nLIMIT = 3\n\n\ndef helper(x):\n    """Help."""\n    return x\n\n\ndef run(x):\n    return helper(x)\n\n\ndef main():\n    run(1)\n\n\nclass Base:\n    def go(self):\n        return 1\n\n\nclass Child(Base):\n    async def stop(self):\n        return run(2)\n',
    "app/broken.py": "def f(:\n",
    "app/__init__.py": "from app.core import run\n",
    "_private/x.ts": "let a = 1",
    ".hidden.py": "y = 1\n",
    "node_modules/x.py": "def no(): pass\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in SOURCES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree):
    return Engine.ingest(spark, str(tree), "repo")


def test_ingest(engine):
    s = engine.statistics().first()
    assert (s.files, s.functions, s.classes, s.methods) == (5, 3, 2, 2)
    assert {(r["type"]) for r in engine.edges.collect()} == {"CONTAINS", "DEFINES", "HAS_METHOD", "INHERITS", "CALLS"}


def test_calls(engine):
    assert {r.name for r in engine.callers("helper").collect()} == {"run"}
    assert {(r.name, r.depth) for r in engine.callers("helper", 3).collect()} == {("run", 1), ("main", 2), ("stop", 2)}
    assert {r.name for r in engine.callees("main").collect()} == {"run"}
    assert engine.impact("helper").first().total == 3
    assert engine.change("helper", "DELETE").first().requires_review


def test_lists(engine):
    assert [(r.name, r.total) for r in engine.functions(limit=2).collect()] == [("helper", 3), ("run", 3)]
    assert {r.name: r.method_count for r in engine.classes().collect()} == {"Base": 1, "Child": 1}
    assert engine.files(path_part="core").count() == 1
    assert [(r.path, r.total) for r in engine.files(language="TypeScript").collect()] == [("_private/x.ts", 1)]
    one = engine.files(path_part="__init__").first()
    assert (one.language, one.size, len(one.hash)) == ("python", len(SOURCES["app/__init__.py"]), 64)


def test_chunks(engine):
    chunks = {r.chunk_id: r for r in engine.chunks.collect()}
    assert chunks["repo:app/core.py:Child:23:sig"].content == "class Child(Base)" and chunks["repo:app/core.py:Child.stop:24:sig"].content == "Child.async def stop(self)"
    helper = chunks["repo:app/core.py:helper:5:full"]
    assert (helper.end_line, helper.language, helper.metadata["parameters"]) == (7, "python", "x") and chunks["repo:app/core.py:helper:5:doc"].content == "Help."


def test_graph_store(spark, engine, tmp_path):
    at = str(tmp_path / "graph")
    engine.save(at)
    again = Engine.open(spark, at)
    assert again.nodes.count() == engine.nodes.count() and {r.name for r in again.callers("helper").collect()} == {"run"}
    store = GraphStore(spark, at)
    with store.transaction() as t:
        t.nodes = t.nodes.where("name <> 'main'")
        t.edges = t.edges.where("type <> 'CALLS'")
    assert Engine.open(spark, at).functions().count() == 2 and store.open()[1].where("type = 'CALLS'").isEmpty()
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        t.nodes = t.nodes.limit(0)
        raise ZeroDivisionError
    assert Engine.open(spark, at).functions().count() == 2
    store.drop()
    assert not store.exists()
    with pytest.raises(FileNotFoundError):
        store.open()


def test_entry_points(spark, engine):
    asked = spark.createDataFrame([("helper", "app/core.py"), ("gone", "app/core.py")], "name string, file_path string")
    rows = I.entry_point(engine.nodes, engine.edges, asked, "function", "DELETE").collect()
    assert [(r.change_id, r.total) for r in rows] == [("app/core.py:helper", 3)] and "Verify all callers have been updated or removed" in rows[0].recommendations
    for kind, name in (("class", "Base"), ("file", "app/core.py")):
        assert I.entry_point(engine.nodes, engine.edges, spark.createDataFrame([(name, "app/core.py")], "name string, file_path string"), kind).first().overall == "none"


def test_ask(engine):
    r = engine.ask("Explain how the run function works").first()
    assert r.query_type == "explain" and "run" in r.entities and r.answer.startswith("Mock answer")


def test_collection(spark, tmp_path):
    rows = [("repo", "a.py", f"f{i}", "function", None, i, f"src {i}", f"def f{i}()", "Doc." if i % 2 else None) for i in range(4)] + [("repo", "b.py", "bad", "function", None, 9, "fail", "def bad()", None)]
    entities = spark.createDataFrame(rows, "repo_id string, file_path string, name string, type string, owner string, start_line int, source_code string, signature string, docstring string")

    def model(texts):
        if "fail" in texts:
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    def index(which):
        out = collection.index(entities.where(which).coalesce(1), c, model)
        return out["indexed"], out["failed"], sorted(r.chunk_id for r in out["failures"].collect())

    c = collection.Collection(spark, str(tmp_path / "c"))
    assert not c.exists() and c.info().first().points == 0
    assert index("name <> 'bad'") == (10, 0, [])
    assert index("name <> 'bad'") == (10, 0, []) and c.info().first().points == 10
    assert index("name = 'bad'") == (0, 2, ["repo:b.py:bad:9:full", "repo:b.py:bad:9:sig"])
    q = spark.createDataFrame([([5.0, 1.0],)], "vector array<double>")
    assert c.search(q, 3, chunk_type="function_full").count() == 3
    assert c.delete(file_path="a.py", chunk_type="function_docstring") == 2 and c.info().first().points == 8
    # another repository's chunks lie apart; the collection can be opened again
    other = collection.embed(V.chunk_entities(entities.where("name = 'f0'").withColumn("repo_id", F.lit("other"))), model)
    before = c._manifest()["repo"]
    c.upsert(other.unionByName(other.withColumn("content", F.lit("zzz"))))
    c = collection.Collection(spark, str(tmp_path / "c"))
    assert c.exists() and c._manifest()["repo"] == before and c.info().first().points == 10
    assert {r.content for r in c.read().where("repo_id = 'other'").collect()} == {"zzz"}
    c.recreate()
    assert c.exists() and c.info().first().points == 0
    c.drop()
    assert not c.exists()


def test_embedding_is_repeated(spark):
    def model(texts):
        import random

        if random.random() < 0.5:
            raise ValueError("sometimes")
        return [[1.0] for _ in texts]

    out = collection.embed(spark.createDataFrame([("abcdefgh",)] * 3, "content string").coalesce(1), model, retries=40, wait=0)
    assert [(r.embedding, r.tokens) for r in out.collect()] == [([1.0], 2)] * 3


def test_discovery_of_odd_places(spark, tree, tmp_path):
    assert {r.path for r in discovery.discover(spark, str(tree)).collect()} == {"app/core.py", "app/broken.py", "app/__init__.py", "_private/x.ts", ".hidden.py"}
    assert discovery.discover(spark, str(tmp_path / "missing")).count() == 0
    assert discovery.discover(spark, str(tree / "app/core.py")).count() == 0
    assert [r.path for r in discovery.discover(spark, str(tree), languages=["TypeScript"]).collect()] == ["_private/x.ts"]
    one = discovery.file_info(spark, str(tree), "app/__init__.py").first()
    assert (one.language, one.size) == ("python", len(SOURCES["app/__init__.py"])) and one.hash == __import__("hashlib").sha256(SOURCES["app/__init__.py"].encode()).hexdigest()
    for path in ("app", "node_modules/x.py", "app/none.py"):
        assert discovery.file_info(spark, str(tree), path).count() == 0
    assert discovery.validate(spark, str(tree)) == ["not a git repository"] and discovery.validate(spark, str(tree / "none")) == ["path does not exist"] and discovery.validate(spark, str(tree / "app/core.py")) == ["path is not a directory"]
    assert discovery.validate(spark, str(tmp_path)) == ["not a git repository", "no file can be parsed"]


def test_git(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    for n in ("a.py", "b.py", "c.py"):
        (tmp_path / n).write_text(f"x = '{n}' * 100\n" * 5)
    git("add", ".")
    git("commit", "-qm", "one")
    repo = Repository(str(tmp_path))
    first = repo.head()
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "b.py").unlink()
    git("mv", "c.py", "d.py")
    (tmp_path / "e.py").write_text("e\n")
    git("add", "-A")
    git("commit", "-qm", "two")
    got = {(r.path, r.change, r.old_path) for r in repo.diff(spark, first).collect()}
    assert got == {("a.py", "modified", None), ("b.py", "deleted", None), ("d.py", "renamed", "c.py"), ("e.py", "added", None)}
    assert {tuple(r) for r in reindex_plan(repo.diff(spark, first)).collect()} >= {("b.py", "remove"), ("c.py", "remove"), ("d.py", "process")}
    assert repo.is_repository() and repo.default_branch() == "main" and repo.content("a.py", first).startswith("x = 'a.py'") and not repo.exists("b.py")
    assert repo.snapshot(spark).count() == 3
    (tmp_path / "f.py").write_text("new\n")
    assert [tuple(r) for r in uncommitted(*repo.uncommitted(spark)).collect()] == [("f.py", "added")]
