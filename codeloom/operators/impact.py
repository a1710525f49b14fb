"""Change impact: levels, overall rating, risk score, recommendations, and the report of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import cut

_BASE = {"DELETE": 4, "RENAME": 3, "MODIFY": 2, "MOVE": 2, "ADD": 1}
_RISK = {"DELETE": 40, "RENAME": 30, "MODIFY": 20, "MOVE": 20, "ADD": 10}
LEVELS = "none low medium high critical".split()


def _of(change: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), change), F.lit(0))


def level(change: Column, distance: Column) -> Column:
    """none .. critical: the change's weight, less by one for each step beyond the first."""
    value = F.greatest(F.lit(0), _of(change, _BASE) - (distance - 1))
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (value + 1).cast("int"))


def rate(affected: DataFrame, changes: DataFrame) -> DataFrame:
    """One row of ratings for each of changes(change_id, change): affected(change_id, id, file_path, distance, level) rolled up."""

    def count(when: Column) -> Column:
        return F.coalesce(F.sum(when.cast("bigint")), F.lit(0))

    rolled = affected.groupBy("change_id").agg(
        F.count(F.lit(1)).alias("total"), count(F.col("distance") == 1).alias("direct"), *[count(F.col("level") == x).alias(x) for x in ("critical", "high", "medium")], F.count_distinct("file_path").alias("files")
    )
    out = changes.join(rolled, "change_id", "left").na.fill(0, ["total", "direct", "critical", "high", "medium", "files"])
    c = F.col
    overall = F.when(c("total") == 0, "none").when((c("critical") > 0) | (c("high") > 5) | (c("direct") > 10), "critical").when((c("high") > 0) | (c("direct") > 5), "high").when((c("direct") > 2) | (c("total") > 10), "medium").otherwise("low")
    raw = _of(c("change"), _RISK) + F.least(F.lit(30), 5 * c("direct")) + 10 * c("critical") + 5 * c("high") + 2 * c("medium") + F.least(F.lit(20), 2 * c("files"))
    risk = F.when(c("total") == 0, 0).otherwise(F.least(F.lit(100), raw)).cast("bigint")
    out = out.withColumn("overall", overall).withColumn("risk", risk)
    return out.withColumn("requires_review", (c("risk") > 50) | c("overall").isin("high", "critical"))


def recommendations() -> Column:
    """Advice in order, from change, risk, direct and files."""
    c = F.col

    def says(when: Column, text: str, number: str | None = None) -> Column:
        before, _, after = text.partition("#")
        return F.when(when, F.concat(F.lit(before), c(number).cast("string"), F.lit(after)) if number else F.lit(text))

    risky, change = c("risk") > 70, c("change")
    advice = [
        says(risky, "Consider breaking this change into smaller increments"), says(risky, "Ensure comprehensive test coverage before deploying"),
        says(c("direct") > 5, "Update # direct callers that may be affected", "direct"),
        says(change == "DELETE", "Verify all callers have been updated or removed"), says(change == "DELETE", "Consider deprecation period before full removal"),
        says(change == "RENAME", "Update all import statements and references"), says(change == "RENAME", "Consider adding a deprecation alias"),
        says((change == "MODIFY") & (c("risk") > 30), "Review changes for backward compatibility"),
        says(c("files") > 3, "Changes may affect # files", "files"), says(c("risk") > 50, "Run integration tests for all affected modules"),
    ]
    return F.array_compact(F.array(*advice))


def dependents(nodes: DataFrame, edges: DataFrame, changes: DataFrame, max_depth: int = 5) -> DataFrame:
    """(change_id, id, file_path, distance, path, level): who calls the changed entity of changes(change_id, entity_id, change), breadth first.

    path has the names on the way of discovery; of equally near callers the least path counts.
    """
    hop = cut(edges.where("type = 'CALLS'").select(F.col("dst").alias("id"), F.col("src").alias("caller")).distinct(), "hops")
    named = nodes.select(F.col("id").alias("caller"), "name")
    first = changes.join(nodes.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("change_id", F.col("entity_id").alias("id"), F.array("name").alias("path"))
    frontier, seen = first, cut(first.withColumn("distance", F.lit(0)), "seen")
    for depth in range(1, max_depth + 1):
        found = frontier.join(hop, "id").join(named, "caller").groupBy("change_id", F.col("caller").alias("id")).agg(F.min(F.array_append("path", F.col("name"))).alias("path"))
        frontier = cut(found.join(seen.select("change_id", "id"), ["change_id", "id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(depth)))
    out = seen.where("distance > 0").join(nodes.select("id", "file_path"), "id").join(changes.select("change_id", "change"), "change_id")
    return out.select("change_id", "id", "file_path", "distance", "path", level(F.col("change"), F.col("distance")).alias("level"))


def report(nodes: DataFrame, edges: DataFrame, changes: DataFrame, max_depth: int = 5) -> DataFrame:
    """rate() of each change with its recommendations and the affected files, the changed one included."""
    found = cut(dependents(nodes, edges, changes, max_depth), "dependents")
    own = changes.join(nodes.select(F.col("id").alias("entity_id"), "file_path"), "entity_id").select("change_id", "file_path")
    files = found.select("change_id", "file_path").unionByName(own).groupBy("change_id").agg(F.sort_array(F.collect_set("file_path")).alias("affected_files"))
    return rate(found, changes).withColumn("recommendations", recommendations()).join(files, "change_id", "left")


#: What an entry point starts from -> the labels of its node.
ENTRY_POINTS = {"function": ("Function", "Method"), "class": ("Class",), "file": ("File",)}


def entry_point(nodes: DataFrame, edges: DataFrame, asked: DataFrame, kind: str, change: str = "MODIFY", max_depth: int = 5) -> DataFrame:
    """report() for the functions, classes or files of asked(name, file_path); change_id is file_path:name. Of nodes alike the first by id counts; what isn't there has no row."""
    labelled = nodes.where(F.col("label").isin(*ENTRY_POINTS[kind])).select(F.col("id").alias("entity_id"), "name", "file_path")
    found = asked.select("name", "file_path").distinct().join(labelled, ["name", "file_path"]).groupBy("name", "file_path").agg(F.min("entity_id").alias("entity_id"))
    return report(nodes, edges, cut(found.select(F.concat_ws(":", "file_path", "name").alias("change_id"), "entity_id", F.lit(change).alias("change")), "changes"), max_depth)
