"""One object over a repository's tables: ingest, list, trace, search, ask, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import questions as Q
from codeloom.operators import graph as G
from codeloom.operators import impact as I
from codeloom.operators import nodes as N
from codeloom.operators import review as R
from codeloom.operators import vectors as V
from codeloom.operators.collection import embed
from codeloom.operators.store import GraphStore
from codeloom.sources import discovery, parsing
from codeloom.sources.tables import cut


class Engine:
    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, chunks: DataFrame | None = None):
        self.spark, self.nodes, self.edges, self.chunks = spark, nodes, edges, chunks

    @classmethod
    def ingest(cls, spark: SparkSession, root: str, repo_id: str, model=None, **filters) -> Engine:
        """Discovers a source tree and parses its Python files; nodes, edges and chunks go to the shared folder. With a model the chunks are embedded."""
        files = cut(discovery.discover(spark, root, **filters), "files")
        entities = cut(parsing.parse(files.where("language = 'python'").withColumn("text", F.decode("content", "UTF-8"))), "entities")
        nodes = N.entity_nodes(entities, repo_id)
        file_nodes = files.select(F.concat("path", F.lit(":file")).alias("id"), F.lit("File").alias("label"), F.col("path").alias("name"), F.col("path").alias("file_path"), "path", "language", "hash", "size", F.lit(repo_id).alias("repo_id"))
        repo = spark.createDataFrame([(repo_id, "Repository", repo_id)], "id string, label string, name string")
        nodes = cut(nodes.unionByName(file_nodes, allowMissingColumns=True).unionByName(repo, allowMissingColumns=True), "nodes")
        contains = file_nodes.select(F.lit(repo_id).alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))
        made = [parsing.structure_edges(entities), parsing.inheritance_edges(entities), G.resolve_calls(entities.where("type in ('function', 'method')")), contains]
        edges = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
        chunks = V.chunk_entities(V.described(entities, repo_id))
        return cls(spark, nodes, cut(G.valid_edges(nodes, edges), "edges"), cut(chunks if model is None else embed(chunks, model), "chunks"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        """What save() wrote there."""
        return cls(spark, *GraphStore(spark, path).open())

    def save(self, path: str) -> None:
        """Nodes and edges under a path that all executors share; see GraphStore."""
        GraphStore(self.spark, path).save(self.nodes, self.edges)

    def _named(self, name: str, labels: tuple[str, ...]) -> DataFrame:
        """The first node of that name."""
        return self.nodes.where(F.col("label").isin(*labels) & (F.col("name") == name)).orderBy("id").limit(1).select("id")

    def files(self, **page) -> DataFrame:
        return G.search_nodes(self.nodes, "File", **page)

    def functions(self, **page) -> DataFrame:
        return G.search_nodes(self.nodes, "Function", **page)

    def classes(self, **page) -> DataFrame:
        found = G.search_nodes(self.nodes, "Class", **page)
        methods = self.edges.where("type = 'HAS_METHOD'").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("method_count"))
        return found.join(methods, "id", "left").na.fill(0, ["method_count"])

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        start = self._named(name, G.CALLABLE)
        if depth == 1:
            return G.callers(self.nodes, self.edges, start)
        return G.trails(self.edges, start, "CALLS", min(depth, 10), incoming=True).select("id", "depth").distinct().join(self.nodes, "id")

    def callees(self, name: str) -> DataFrame:
        return G.callees(self.nodes, self.edges, self._named(name, G.CALLABLE))

    def impact(self, name: str, depth: int = 5) -> DataFrame:
        return G.impact_summary(self.nodes, G.reach(self.edges, self._named(name, (*G.CALLABLE, "Class")), "CALLS", depth, incoming=True))

    def change(self, name: str, change: str = "MODIFY") -> DataFrame:
        start = self._named(name, G.CALLABLE).select(F.lit(1).alias("change_id"), F.col("id").alias("entity_id"), F.lit(change).alias("change"))
        return I.report(self.nodes, self.edges, start)

    def statistics(self) -> DataFrame:
        return G.repo_statistics(self.nodes)

    def context(self) -> DataFrame:
        return G.function_context(self.nodes, self.edges)

    def search(self, query: DataFrame, limit: int = 10, threshold: float = 0.5, entity_types: list[str] | None = None, **filters) -> DataFrame:
        """Top-k chunks; entity_types filter what the limit left."""
        found = V.search(self.chunks, query, limit, threshold, **filters)
        return found if entity_types is None else found.where(F.col("entity_type").isin(*entity_types))

    def ask(self, question: str, snippets: DataFrame | None = None) -> DataFrame:
        """Route, entities, budget, prompt and the mock model's answer to one question."""
        q = Q.route(self.spark.createDataFrame([(1, question)], "q int, text string"))
        context = F.lit("No relevant code was found.")
        if snippets is not None:
            q = q.join(Q.context_text(Q.pack_context(snippets.withColumn("q", F.lit(1)), "q"), "q"), "q", "left")
            context = F.coalesce("context", context)
        prompt = Q.prompt(F.col("query_type"), F.col("text"), context)
        return q.select("query_type", "confidence", Q.entities(F.col("text")).alias("entities"), Q.context_budget(F.col("query_type")).alias("budget"), prompt.alias("prompt"), Q.mock_answer(prompt)[0].alias("answer"))

    def review(self, patches: DataFrame) -> DataFrame:
        """Verdicts on patches(pr, file, patch)."""
        lines = cut(R.diff_lines(patches, ["pr", "file"]), "lines")
        return R.verdict(R.comments(lines, ["pr", "file"]), lines, "pr", "file")
