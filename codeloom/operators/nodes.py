"""Entities to graph nodes, and node rows to typed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names

#: Columns of each node label.
SCHEMAS = {
    "Repository": ["id", "name", "url", "default_branch", "last_indexed"],
    "File": ["id", "path", "language", "hash", "size", "repo_id"],
    "Module": ["id", "name", "file_path", "docstring", "repo_id"],
    "Class": ["id", "name", "file_path", "start_line", "end_line", "docstring", "bases", "decorators", "repo_id"],
    "Function": ["id", "name", "file_path", "start_line", "end_line", "is_async", "docstring", "parameters", "return_type", "decorators", "repo_id"],
    "Method": ["id", "name", "file_path", "start_line", "end_line", "is_async", "docstring", "parameters", "return_type", "decorators", "repo_id", "is_classmethod", "is_staticmethod", "is_property", "class_id"],
    "Variable": ["id", "name", "file_path", "line", "type_annotation", "is_constant", "repo_id"],
}


def entity_nodes(entities: DataFrame, repo_id: str) -> DataFrame:
    """One wide node table of parsed entities; parameters are reduced to their names, imports give no node."""
    out = entities.withColumn("label", names.label(F.col("type"))).where("label is not null")
    return out.select(
        "id", "label", "name", "file_path", "start_line", "end_line", F.col("start_line").alias("line"), "docstring", "bases", "decorators", "is_async",
        F.transform("parameters", lambda p: p["name"]).alias("parameters"), "return_type", "type_annotation", "is_constant", "is_classmethod", "is_staticmethod", "is_property",
        F.when(F.col("label") == "Method", F.col("parent_id")).alias("class_id"), F.lit(repo_id).alias("repo_id"),
    )


def of_label(nodes: DataFrame, label: str) -> DataFrame:
    """The nodes of a label with just its columns; columns that the table lacks are NULL."""
    return nodes.where(F.col("label") == label).select(*[F.col(c) if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in SCHEMAS[label]])


def properties(nodes: DataFrame) -> DataFrame:
    """Without the label; timestamps as ISO strings."""
    return nodes.select(*[names.iso(F.col(c)).alias(c) if t == "timestamp" else F.col(c) for c, t in nodes.dtypes if c != "label"])


def mark_indexed(nodes: DataFrame, repo_id, at) -> DataFrame:
    """nodes with last_indexed of that repository set."""
    return nodes.withColumn("last_indexed", F.when(F.col("id") == repo_id, F.lit(at).cast("timestamp")).otherwise(F.col("last_indexed")))


def references_by_file(edges: DataFrame, nodes: DataFrame, target: DataFrame) -> DataFrame:
    """(file_path, kind, references): where the ids in target(id) are called, imported, inherited from or used."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("CALLS", "call", "IMPORTS", "import", "INHERITS", "inheritance", "USES", "assignment")]), F.col("type"))
    hits = edges.join(target.select(F.col("id").alias("dst")).distinct(), "dst").withColumn("kind", kind).where("kind is not null")
    return hits.join(nodes.select(F.col("id").alias("src"), "file_path"), "src").groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("references"))
