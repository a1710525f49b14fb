"""Whole jobs, by brute force on small cases."""

from __future__ import annotations

import math
import random

from codeloom.operators import vectors as V
from codeloom.plans import QUERIES
from codeloom.plans import domain as D
from codeloom.plans.code_queries import CORPUS

AT = "/root/testdata/sf0.001"


def test_batch_search_blocks(spark, monkeypatch):
    """Blocks of 16 rows, with equal, opposite, zero, missing and short vectors."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    draw = random.Random(3)
    vectors = [[float(draw.randint(-2, 2)) for _ in range(4)] for _ in range(90)] + [[0.0] * 4, None, [1.0, 2.0], [1.0, None, 0.0, 1.0]]
    rows = list(enumerate(vectors))

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return 0.0
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = {(i, j, rank) for i, a in rows for rank, (_, j) in enumerate(sorted((-cosine(a, b), j) for j, b in rows)[:7], 1)}
    chunks = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    found = V.batch_search(chunks, chunks.toDF("query_id", "vector"), 7)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in found.collect()} == want


def test_batch_knn(spark):
    got = QUERIES["batch_knn"](spark, AT)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {5}
    assert {r.query_id for r in got.select("query_id").distinct().collect()} == set(range(0, spark.read.parquet(f"{AT}/embeddings.parquet").count(), 100))


def _graph(spark):
    """The tables' CALLS edges and nodes in Python."""
    edges = [(r.src, r.dst) for r in D.calls(spark, AT).collect()]
    return edges, [r.p_partkey for r in spark.read.parquet(f"{AT}/part.parquet").collect()]


def _reach(edges, start):
    seen, level, n = {}, {start}, 0
    while level:
        n += 1
        level = {b for a, b in edges if a in level} - seen.keys()
        seen |= dict.fromkeys(level, n)
    return seen


def test_traces(spark):
    edges, ids = _graph(spark)
    for name, hop in (("trace_origin", [(b, a) for a, b in edges]), ("trace_destination", edges)):
        near = {a for a, _ in hop}
        want = {(i, j) for i in ids if i % 100 == 0 for j in {i, *_reach(hop, i)} if j not in near}
        assert {(r.start, r.id) for r in QUERIES[name](spark, AT).collect()} == want


def test_impact_and_hierarchy_of_every_node(spark):
    edges, ids = _graph(spark)
    back = [(b, a) for a, b in edges]
    want = {i: [n for j, n in _reach(back, i).items() if n <= 5 and j != i] for i in ids}
    got = {r.change_id: (r.total, r.direct) for r in QUERIES["overall_impact"](spark, AT).collect()}
    assert got == {i: (len(n), n.count(1)) for i, n in want.items()}
    up = {i: (i - 1) // 3 for i in ids if i > 0}

    def ancestors(i):
        out = []
        while i in up and len(out) < 10:
            out.append(i := up[i])
        return ",".join(map(str, sorted(out)))

    assert {r.id: r.ancestors for r in QUERIES["class_hierarchy"](spark, AT).collect()} == {i: ancestors(i) for i in ids}


def test_all_uses(spark):
    lines = {(r.l_partkey, r.l_suppkey) for r in spark.read.parquet(f"{AT}/lineitem.parquet").collect()}
    sizes = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{AT}/part.parquet").collect()}
    variables = {i: {v for p, v in lines if p == i} for i in sizes}
    assert {r.id: {int(x) for x in r.variables.split(",") if x} for r in QUERIES["function_context"](spark, AT).collect()} == variables
    want = {}
    for size in {sizes[i] for i, v in variables.items() if v}:
        methods = [i for i, v in variables.items() if v and sizes[i] == size]
        pairs = [bool(variables[a] & variables[b]) for a in methods for b in methods if a < b]
        want[size] = (len(methods), round(sum(pairs) / len(pairs), 9) if pairs else 1.0)
    assert {r.class_id: (r.methods, r.cohesion) for r in QUERIES["cohesion"](spark, AT).collect()} == want


def test_texts_are_corpus_and_documents(spark, tmp_path):
    spark.createDataFrame([(7, "import os\n# note\n\ndef f(a):\n    if a:\n        return a\n\nclass K:\n    def m(self):\n        return 1\n"), (8, "plain prose here")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.file_path: r for r in QUERIES["file_metrics"](spark, str(tmp_path)).collect()}
    assert len(rows) == 2 + len(CORPUS)
    r = rows["7"]
    assert (r.lines_of_code, r.lines_of_comments, r.blank_lines, r.import_count, r.export_count) == (7, 1, 3, 1, 0)
    assert (r.entity_count, round(r.avg_complexity, 6), r.max_complexity) == (3, round(4 / 3, 6), 2) and rows["8"].entity_count == rows["8"].avg_complexity == 0
    found = QUERIES["parsed_entities"](spark, str(tmp_path)).where("file_path = '7' and type in ('function', 'method')")
    assert {r.name for r in found.collect()} == {"f", "m"}
    assert QUERIES["entity_metrics"](spark, str(tmp_path)).where("file_path = '7'").count() == 3


def test_documents_without_or_with_the_same_id(spark, tmp_path):
    spark.createDataFrame([(None, "plain prose"), (2, "more of it"), (2, "import os\n"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.file_path, r.entities) for r in QUERIES["entity_counts"](spark, str(tmp_path)).collect() if r.file_path not in CORPUS]
    assert sorted(got, key=str) == sorted([(None, 1), ("2", 1), ("2", 2), ("3", 1)], key=str)
    assert {r.label: r.nodes for r in QUERIES["parsed_nodes"](spark, str(tmp_path)).collect()}["Module"] == len(CORPUS) + 4
