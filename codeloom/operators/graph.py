"""Property-graph operators on two DataFrames: nodes(id, label, name, file_path, start_line, ...) and edges(src, dst, type).

Every function is lazy except the traversals, which write one small frontier for each level to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import cut

CALLABLE = ("Function", "Method")
EDGE_TYPES = ("CONTAINS", "DEFINES", "HAS_METHOD", "INHERITS", "CALLS", "USES", "IMPORTS", "RETURNS", "ACCEPTS", "TYPE_OF")
#: Labels that an edge type allows at its ends; None: any.
ENDPOINTS = {"HAS_METHOD": (("Class",), ("Method",)), "INHERITS": (("Class",), ("Class",)), "CALLS": (CALLABLE, CALLABLE), "USES": (CALLABLE, ("Variable",)), "IMPORTS": (("File",), ("Module", "File"))}


def node_by_id(nodes: DataFrame, node_id, label: str | None = None) -> DataFrame:
    """The node of that id, of that label if one is given."""
    found = nodes.where(F.col("id") == node_id)
    return found if label is None else found.where(F.col("label") == label)


def nodes_by_name(nodes: DataFrame, name: str, label: str, repo_id=None) -> DataFrame:
    """Nodes of a label with exactly that name, in order of id."""
    found = nodes.where((F.col("label") == label) & (F.col("name") == name))
    return (found if repo_id is None else found.where(F.col("repo_id") == repo_id)).orderBy("id")


def search_nodes(nodes: DataFrame, label: str, name: str | None = None, path_part: str | None = None, language: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the matching nodes in order of (file_path, start_line, id), with the total before paging."""
    found = nodes.where(F.col("label") == label)
    if name is not None:
        found = found.where(F.col("name") == name)
    if path_part is not None:
        found = found.where(F.col("file_path").contains(path_part))
    if language is not None:
        found = found.where(F.lower("language") == language.lower())
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("file_path", "start_line", "id").offset(offset).limit(limit).crossJoin(total)


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("id").alias(name), *[c for c in nodes.columns if c != "id"])


def neighbours(nodes: DataFrame, edges: DataFrame, start: DataFrame, kind: str, incoming: bool, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes one edge of that type away from the ids in start(id), each once for a start: (start, id, node columns)."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    hop = edges.where(F.col("type") == kind).select(F.col(near).alias("start"), F.col(far).alias("id")).distinct()
    hop = hop.join(start.select(F.col("id").alias("start")).distinct(), "start")
    ends = nodes if labels is None else nodes.where(F.col("label").isin(*labels))
    return hop.join(ends, "id")


def callers(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    return neighbours(nodes, edges, start, "CALLS", True, CALLABLE)


def callees(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    return neighbours(nodes, edges, start, "CALLS", False, CALLABLE)


def trails(edges: DataFrame, start: DataFrame, kind: str | None, max_depth: int, incoming: bool = False) -> DataFrame:
    """(start, id, depth, path): every trail of 1..max_depth edges from the ids in start(id); a trail repeats no edge, nodes may recur.

    Trails of one length are the join of those one shorter with the edges, by sorting: what is broadcast goes through the driver.
    """
    near, far = ("dst", "src") if incoming else ("src", "dst")
    hop = (edges if kind is None else edges.where(F.col("type") == kind)).select(F.col(near).alias("id"), F.col(far).alias("next"), *([] if kind else ["type"])).distinct()
    edge = F.struct("id", "next") if kind else F.struct("id", "next", "type")
    level = start.select(F.col("id").alias("start"), "id").distinct()
    level = level.join(hop.hint("merge"), "id").select("start", F.col("next").alias("id"), F.array(edge).alias("used"), F.array(F.col("id"), F.col("next")).alias("path"))
    out = []
    for depth in range(1, max_depth + 1):
        level = cut(level, "trails")
        if depth > 1 and level.isEmpty():
            break
        out.append(level.select("start", "id", F.lit(depth).alias("depth"), "path"))
        level = level.join(hop.hint("merge"), "id").where(~F.array_contains("used", edge)).select("start", F.col("next").alias("id"), F.array_append("used", edge).alias("used"), F.array_append("path", F.col("next")).alias("path"))
    return reduce(DataFrame.unionByName, out)


#: Levels after which what a search has seen becomes one table again.
COMPACT = 4


def reach(edges: DataFrame, start: DataFrame, kind: str | None, max_depth: int | None = None, incoming: bool = False, together: bool = False) -> DataFrame:
    """(start, id, distance >= 1): everything reachable with its least distance; the start itself only by a cycle.

    Breadth first: each level joins the frontier with the edges and drops what was seen, so a level shuffles the frontier and not the paths. Joins
    are by sorting: what was seen grows with starts and nodes, packed it looks small, and what is broadcast goes through the driver. With
    together all starts are one (start is NULL): the work is that of one search, whatever their number.
    """
    near, far = ("dst", "src") if incoming else ("src", "dst")
    hop = cut((edges if kind is None else edges.where(F.col("type") == kind)).select(F.col(near).alias("id"), F.col(far).alias("next")).distinct(), "hops")
    frontier = start.select((F.lit(0).cast("int") if together else F.col("id")).alias("start"), "id").distinct()
    seen = None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(hop.hint("merge"), "id").select("start", F.col("next").alias("id")).distinct()
        if seen is not None:
            new = new.join(seen.select("start", "id").hint("merge"), ["start", "id"], "left_anti")
        new = cut(new.withColumn("distance", F.lit(depth)), "frontier")
        if seen is not None and new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        if depth % COMPACT == 0:
            seen = cut(seen, "seen")
        frontier = new.select("start", "id")
    return seen.withColumn("start", F.lit(None).cast(dict(start.dtypes)["id"])) if together else seen


def shortest_path(edges: DataFrame, pairs: DataFrame, kind: str = "CALLS", max_depth: int = 10) -> DataFrame:
    """(src, dst, path, length) for each row of pairs(src, dst) that a path of 1..max_depth edges joins; of equally short ones the least.

    Breadth first with the least path to each node; pairs of a node with itself give no row.
    """
    pairs = pairs.where("src <> dst").distinct()
    hop = cut(edges.where(F.col("type") == kind).select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct(), "hops")
    seen = cut(pairs.select(F.col("src").alias("start"), F.col("src").alias("id"), F.array("src").alias("path")).distinct(), "paths")
    frontier = seen
    for _ in range(max_depth):
        new = frontier.join(hop.hint("merge"), "id").groupBy("start", F.col("next").alias("id")).agg(F.min(F.array_append("path", F.col("next"))).alias("path"))
        frontier = cut(new.join(seen.select("start", "id").hint("merge"), ["start", "id"], "left_anti"), "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(*seen.columns))
    return pairs.join(seen, (pairs.src == seen.start) & (pairs.dst == seen.id)).select("src", "dst", "path", (F.size("path") - 1).alias("length"))


def all_paths(edges: DataFrame, src: DataFrame, dst: DataFrame, kind: str = "CALLS", max_depth: int = 5, limit: int = 10) -> DataFrame:
    """(path, length): trails from an id in src(id) to one in dst(id), shortest first, at most `limit`."""
    found = trails(edges, src, kind, max_depth).join(dst.select("id").distinct(), "id", "left_semi")
    return found.select("path", F.col("depth").alias("length")).orderBy("length", "path").limit(limit)


def impact_summary(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(start, affected, files, depth, total) of what reach() found."""
    with_file = reached.join(nodes.select("id", "file_path"), "id")
    return with_file.groupBy("start").agg(F.sort_array(F.collect_set("id")).alias("affected"), F.sort_array(F.collect_set("file_path")).alias("files"), F.max("distance").alias("depth"), F.countDistinct("id").alias("total"))


def function_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, callees, variables, file, class): one row per function or method, neighbours as sorted sets of ids.

    Each relation is aggregated before it is joined, so they don't multiply.
    """
    functions = nodes.where(F.col("label").isin(*CALLABLE)).select("id")

    def side(kind: str, key: str, value: str, name: str, single: bool = False) -> DataFrame:
        agg = F.min(value) if single else F.sort_array(F.collect_set(value))
        return edges.where(F.col("type") == kind).groupBy(F.col(key).alias("id")).agg(agg.alias(name))

    parts = [side("CALLS", "dst", "src", "callers"), side("CALLS", "src", "dst", "callees"), side("USES", "src", "dst", "variables"), side("DEFINES", "dst", "src", "file", True), side("HAS_METHOD", "dst", "src", "class", True)]
    out = reduce(lambda a, b: a.join(b, "id", "left"), parts, functions)
    empty = F.array().cast(out.schema["callers"].dataType)
    return out.withColumns({c: F.coalesce(c, empty) for c in ("callers", "callees", "variables")})


def hierarchy(edges: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """(id, ancestors, descendants): sorted sets over INHERITS for each id in start(id)."""
    ids = start.select("id").distinct()
    up = reach(edges, ids, "INHERITS", max_depth).groupBy("start").agg(F.sort_array(F.collect_set("id")).alias("ancestors"))
    down = reach(edges, ids, "INHERITS", max_depth, incoming=True).groupBy("start").agg(F.sort_array(F.collect_set("id")).alias("descendants"))
    out = ids.join(up.withColumnRenamed("start", "id"), "id", "left").join(down.withColumnRenamed("start", "id"), "id", "left")
    empty = F.array().cast(out.schema["ancestors"].dataType)
    return out.withColumns({c: F.coalesce(c, empty) for c in ("ancestors", "descendants")})


def repo_statistics(nodes: DataFrame) -> DataFrame:
    """(repo_id, files, functions, classes, methods) of each Repository node, zeros included."""
    repos = nodes.where("label = 'Repository'").select(F.col("id").alias("repo_id"))
    names = {"files": "File", "functions": "Function", "classes": "Class", "methods": "Method"}
    counts = nodes.where(F.col("label").isin(*names.values())).groupBy("repo_id").agg(*[F.count_distinct(F.when(F.col("label") == v, F.col("id"))).alias(k) for k, v in names.items()])
    return repos.join(counts, "repo_id", "left").na.fill(0, list(names))


def count_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "label")


def upsert_nodes(nodes: DataFrame, batch: DataFrame, order: Column | None = None) -> DataFrame:
    """nodes with the batch merged by id: the last row of an id wins, by `order` within the batch."""
    last = Window.partitionBy("id").orderBy(F.desc("__from"), F.desc("__order"))
    old = nodes.withColumn("__from", F.lit(0)).withColumn("__order", F.lit(0).cast("bigint"))
    new = batch.withColumn("__from", F.lit(1)).withColumn("__order", (F.lit(0) if order is None else order).cast("bigint"))
    return old.unionByName(new, allowMissingColumns=True).withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__from", "__order", "__rank")


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a known type whose ends exist and have the labels that the type allows, each (src, dst, type) once."""
    label = nodes.select("id", "label")
    ends = edges.where(F.col("type").isin(*EDGE_TYPES)).join(label.select(F.col("id").alias("src"), F.col("label").alias("__s")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("__d")), "dst")
    rule = F.lit(True)
    for kind, (a, b) in ENDPOINTS.items():
        rule = rule & ((F.col("type") != kind) | (F.col("__s").isin(*a) & F.col("__d").isin(*b)))
    return ends.where(rule).dropDuplicates(["src", "dst", "type"]).select(*edges.columns)


def upsert_edges(nodes: DataFrame, edges: DataFrame, batch: DataFrame) -> DataFrame:
    """edges with the valid ones of the batch; an edge that is there already stays as it is."""
    new = valid_edges(nodes, batch)
    return edges.unionByName(new.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti"), allowMissingColumns=True)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the ids in gone(id) and without the edges that touch them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def file_cascade(edges: DataFrame, files: DataFrame) -> DataFrame:
    """ids of the files, of what they define, and of those classes' methods."""
    defined = edges.where("type = 'DEFINES'").join(files.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    methods = edges.where("type = 'HAS_METHOD'").join(defined.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return files.select("id").unionByName(defined).unionByName(methods).distinct()


def repo_cascade(edges: DataFrame, repos: DataFrame) -> DataFrame:
    """ids of the repositories and of everything reachable from them over edges of any type."""
    return repos.select("id").unionByName(reach(edges, repos, None).select("id")).distinct()


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids that break the uniqueness constraint of their label."""
    return nodes.groupBy("label", "id").agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def resolve_calls(entities: DataFrame) -> DataFrame:
    """CALLS edges of entities(id, name, file_path, calls, ordinal): a call is the entity of exactly that name in the same file, the last of them."""
    targets = entities.groupBy("file_path", F.col("name").alias("call")).agg(F.max_by("id", "ordinal").alias("dst"))
    calls = entities.select(F.col("id").alias("src"), "file_path", F.explode("calls").alias("call"))
    return calls.join(targets, ["file_path", "call"]).select("src", "dst", F.lit("CALLS").alias("type")).distinct()
