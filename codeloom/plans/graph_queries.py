"""Graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.plans import domain as D
from codeloom.plans.registry import query
from codeloom.sources.tables import cut, load

_F = f"with {D.SQL_FUNCTIONS}"
_G = f"{D.SQL_CALLS}, {D.SQL_FUNCTIONS}"


@query(f"{_F} select * from f where id = 7")
def node_by_id(spark, d):
    return G.node_by_id(D.functions(spark, d), 7)


@query(f"{_F} select * from f where id = 8 and label = 'Function'")
def function_by_id(spark, d):
    return G.node_by_id(D.functions(spark, d), 8, "Function")


@query(f"{_F} select * from f where name = (select min(name) from f) and label = 'Function'")
def functions_by_name(spark, d):
    f = D.functions(spark, d)
    return G.nodes_by_name(f, f.agg(F.min("name")).first()[0], "Function")


@query("select n_nationkey as id, n_name as path from nation where n_regionkey = 2")
def files_in_repo(spark, d):
    return D.files(spark, d).where("repo_id = 2").orderBy("path").select("id", "path")


@query(f"{_F}, h as (select distinct l_suppkey as src, l_partkey as dst from lineitem) select f.* from f join h on dst = id where src = 1")
def methods_of_class(spark, d):
    edges = D.has_method(spark, d).where("src = 1")
    return D.functions(spark, d).join(edges, F.col("dst") == F.col("id")).orderBy("start_line", "id").select("id", "label", "name", "file_path", "start_line")


@query(f"with {_G}, {D.SQL_CALLED} select f.* from f join g on g.src = f.id join root on root.id = g.dst")
def find_callers(spark, d):
    edges = cut(D.calls(spark, d), "calls")
    return G.callers(D.functions(spark, d), edges, D.most_called(edges)).orderBy("file_path", "start_line", "id").drop("start")


@query(f"with {_G}, {D.SQL_CALLING} select f.* from f join g on g.dst = f.id join root on root.id = g.src")
def find_callees(spark, d):
    edges = cut(D.calls(spark, d), "calls")
    return G.callees(D.functions(spark, d), edges, D.most_calling(edges)).orderBy("file_path", "start_line", "id").drop("start")


def _trails_sql(edges: str, root: str, near: str, far: str, depth: int, table: str = "g") -> str:
    return f"""with recursive {edges}, {root},
t as (select id as start, e.{far} as id, 1 as depth, [struct_pack(s := e.src, d := e.dst)] as used, [root.id, e.{far}] as path from root join {table} e on e.{near} = root.id
union all select t.start, e.{far}, t.depth + 1, list_append(t.used, struct_pack(s := e.src, d := e.dst)), list_append(t.path, e.{far}) from t join {table} e on e.{near} = t.id
where t.depth < {depth} and not list_contains(t.used, struct_pack(s := e.src, d := e.dst)))"""


@query(_trails_sql(D.SQL_CALLS, D.SQL_CALLED, "dst", "src", 5) + " select distinct id, depth from t")
def callers_recursive(spark, d):
    edges = cut(D.calls(spark, d), "calls")
    return G.trails(edges, D.most_called(edges), "CALLS", 5, incoming=True).select("id", "depth").distinct()


@query(_trails_sql(D.SQL_CALLS, D.SQL_CALLING, "src", "dst", 5) + " select distinct id, depth from t")
def callees_recursive(spark, d):
    edges = cut(D.calls(spark, d), "calls")
    return G.trails(edges, D.most_calling(edges), "CALLS", 5).select("id", "depth").distinct()


def _far_pair(edges):
    """From the node that calls most to the greatest id among those four calls away."""
    root = D.most_calling(edges)
    far = G.reach(edges, root, "CALLS", 4).where("distance = 4").groupBy("start").agg(F.max("id").alias("dst"))
    return far.select(F.col("start").alias("src"), "dst")


_FAR = f"""{D.SQL_CALLS}, {D.SQL_CALLING},
w as (select id as start, id, 0 as depth from root union select w.start, g.dst, w.depth + 1 from w join g on g.src = w.id where w.depth < 4),
near as (select id, min(depth) as distance from w where depth > 0 group by id),
far as (select (select id from root) as src, max(id) as dst from near where distance = 4)"""


@query(
    f"""with recursive {_FAR},
p as (select src as id, [src] as path from far union all select g.dst, list_append(p.path, g.dst) from p join g on g.src = p.id where len(p.path) <= 4 and not list_contains(p.path, g.dst))
select src, dst, array_to_string(path, '>') as path, 4 as length from (select far.src, far.dst, min(path) as path from p join far on p.id = far.dst where len(path) = 5 group by far.src, far.dst)"""
)
def shortest_call_path(spark, d):
    edges = cut(D.calls(spark, d), "calls")
    return G.shortest_path(edges, _far_pair(edges)).select("src", "dst", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


@query(_trails_sql(_FAR, "start_at as (select 1)", "src", "dst", 5) + " select array_to_string(path, '>') as path, depth as length from t join far on far.dst = t.id order by depth, t.path limit 10")
def all_call_paths(spark, d):
    edges = cut(D.calls(spark, d), "calls")
    pair = cut(_far_pair(edges), "pair")
    return G.all_paths(edges, pair.select(F.col("src").alias("id")), pair.select(F.col("dst").alias("id"))).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


_REACH = f"""with recursive {_G}, {D.SQL_CALLED},
w as (select id, 0 as depth from root union select g.src, w.depth + 1 from w join g on g.dst = w.id where w.depth < 5),
r as (select id, min(depth) as distance from w where depth > 0 group by id)"""


@query(f"{_REACH} select r.id, f.file_path, r.distance from r join f using (id)")
def impact_analysis(spark, d):
    edges = cut(D.calls(spark, d), "calls")
    found = G.reach(edges, D.most_called(edges), "CALLS", 5, incoming=True)
    return found.join(D.functions(spark, d).select("id", "file_path"), "id").select("id", "file_path", "distance").orderBy("distance", "id")


@query(
    f"""{_REACH} select (select id from root) as start, array_to_string(list_sort(list(r.id)), ',') as affected, array_to_string(list_sort(list(distinct file_path)), ',') as files,
max(distance) as depth, count(*) as total from r join f using (id)"""
)
def impact_summary(spark, d):
    edges = cut(D.calls(spark, d), "calls")
    out = G.impact_summary(D.functions(spark, d), G.reach(edges, D.most_called(edges), "CALLS", 5, incoming=True))
    return out.withColumns({"affected": F.array_join(F.col("affected").cast("array<string>"), ","), "files": F.array_join("files", ",")})


@query(
    f"""with {_G}, u as (select distinct l_suppkey as var, l_partkey as id from lineitem)
select f.id, coalesce((select string_agg(x.src, ',' order by x.src) from g x where x.dst = f.id), '') as callers,
coalesce((select string_agg(x.dst, ',' order by x.dst) from g x where x.src = f.id), '') as callees,
coalesce((select string_agg(u.var, ',' order by u.var) from u where u.id = f.id), '') as variables,
f.id % 100 as file, (select min(l_suppkey) from lineitem where l_partkey = f.id) as class from f"""
)
def function_context(spark, d):
    lines = load(spark, d, "lineitem")
    uses = lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("USES").alias("type")).distinct()
    defines = load(spark, d, "part").select((F.col("p_partkey") % 100).alias("src"), F.col("p_partkey").alias("dst"), F.lit("DEFINES").alias("type"))
    edges = D.calls(spark, d).unionByName(uses).unionByName(defines).unionByName(D.has_method(spark, d))
    out = G.function_context(D.functions(spark, d), cut(edges, "edges"))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("callers", "callees", "variables")})


@query(f"with {D.SQL_IMPORTS} select n_nationkey as id, n_name as path from m join nation on dst = n_nationkey where src = 3")
def file_dependencies(spark, d):
    files = D.files(spark, d)
    return G.neighbours(files, D.imports(spark, d), files.where("id = 3"), "IMPORTS", False).orderBy("path").select("id", "path")


@query(f"with {D.SQL_IMPORTS} select n_nationkey as id, n_name as path from m join nation on src = n_nationkey where dst = 3")
def file_dependents(spark, d):
    files = D.files(spark, d)
    return G.neighbours(files, D.imports(spark, d), files.where("id = 3"), "IMPORTS", True, ("File",)).orderBy("path").select("id", "path")


@query(_trails_sql(D.SQL_IMPORTS, "root as (select 3 as id)", "src", "dst", 2, "m") + " select distinct id, depth as distance from t")
def dependency_tree(spark, d):
    edges = cut(D.imports(spark, d), "imports")
    return G.trails(edges, D.files(spark, d).where("id = 3"), "IMPORTS", 2).select("id", F.col("depth").alias("distance")).distinct()


@query(f"{_F}, {D.SQL_INHERITS} select f.* from f join h on h.dst = f.id where h.src = 100")
def class_parents(spark, d):
    nodes = D.functions(spark, d)
    return G.neighbours(nodes, D.inherits(spark, d), nodes.where("id = 100"), "INHERITS", False).drop("start")


@query(f"{_F}, {D.SQL_INHERITS} select f.* from f join h on h.src = f.id where h.dst = 5")
def class_children(spark, d):
    nodes = D.functions(spark, d)
    return G.neighbours(nodes, D.inherits(spark, d), nodes.where("id = 5"), "INHERITS", True).drop("start")


_UP = f"with recursive {D.SQL_INHERITS}, w as (select max(p_partkey) as id, 0 as distance from part union all select h.dst, w.distance + 1 from w join h on h.src = w.id where w.distance < 10)"
_DOWN = f"with recursive {D.SQL_INHERITS}, w as (select 1::bigint as id, 0 as distance union all select h.src, w.distance + 1 from w join h on h.dst = w.id where w.distance < 10)"


@query(f"{_UP} select id, distance from w where distance > 0")
def class_ancestors(spark, d):
    last = load(spark, d, "part").agg(F.max("p_partkey").alias("id"))
    return G.trails(D.inherits(spark, d), last, "INHERITS", 10).select("id", F.col("depth").alias("distance")).distinct().orderBy("distance", "id")


@query(f"{_DOWN} select id, distance from w where distance > 0")
def class_descendants(spark, d):
    return G.trails(D.inherits(spark, d), D.functions(spark, d).where("id = 1"), "INHERITS", 10, incoming=True).select("id", F.col("depth").alias("distance")).distinct().orderBy("distance", "id")


@query(
    f"""with recursive {D.SQL_INHERITS}, s as (select p_partkey as id from part),
up as (select id as start, id, 0 as n from s union all select up.start, h.dst, n + 1 from up join h on h.src = up.id where n < 10),
down as (select id as start, id, 0 as n from s union all select down.start, h.src, n + 1 from down join h on h.dst = down.id where n < 10)
select s.id, coalesce((select string_agg(up.id, ',' order by up.id) from up where up.start = s.id and n > 0), '') as ancestors,
coalesce((select string_agg(down.id, ',' order by down.id) from down where down.start = s.id and n > 0), '') as descendants from s"""
)
def class_hierarchy(spark, d):
    out = G.hierarchy(D.inherits(spark, d), D.functions(spark, d))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("ancestors", "descendants")})


@query(
    f"""with {D.SQL_TREE} select r.id as repo_id, count(distinct case when n.label = 'File' then n.id end) as files, count(distinct case when n.label = 'Function' then n.id end) as functions,
count(distinct case when n.label = 'Class' then n.id end) as classes, count(distinct case when n.label = 'Method' then n.id end) as methods
from n r left join n on n.repo_id = r.id where r.label = 'Repository' group by r.id"""
)
def repo_statistics(spark, d):
    return G.repo_statistics(D.tree_nodes(spark, d))


@query(f"with {D.SQL_TREE} select label, count(*) as count from n group by label")
def count_by_type(spark, d):
    return G.count_by_type(D.tree_nodes(spark, d))


@query(
    f"""{_F}, b as (select l_partkey as id, row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_suppkey desc) as r, 'm' || l_suppkey as name from lineitem)
select f.id, f.label, coalesce(b.name, f.name) as name, f.file_path, f.start_line from f left join b on b.id = f.id and b.r = 1"""
)
def upsert_nodes(spark, d):
    nodes = D.functions(spark, d)
    new = load(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("name"), (F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("o"))
    batch = new.join(nodes.drop("name"), "id")
    return G.upsert_nodes(nodes, batch, F.col("o")).drop("o")


@query(f"with {_G}, more as (select src, src + 1 as dst from g) select src, dst, 'CALLS' as type from (select * from g union select more.* from more join f on f.id = more.dst)")
def upsert_edges(spark, d):
    edges = cut(D.calls(spark, d), "calls")
    return G.upsert_edges(D.functions(spark, d), edges, edges.select("src", (F.col("src") + 1).alias("dst"), "type"))


_FILE_GONE = "gone as (select 'n3' as id union select dst from e where src = 'n3' and type = 'DEFINES' union select m.dst from e join e m on m.src = e.dst and m.type = 'HAS_METHOD' where e.src = 'n3' and e.type = 'DEFINES')"
_REPO_GONE = "gone as (select 'r1' as id union select e.dst from gone join e on e.src = gone.id)"


@query(f"with {D.SQL_TREE}, {_FILE_GONE} select * from n where id not in (select id from gone)")
def delete_file_cascade(spark, d):
    nodes, edges = D.tree_nodes(spark, d), D.tree_edges(spark, d)
    return G.delete_nodes(nodes, edges, G.file_cascade(edges, nodes.where("id = 'n3'")))[0]


@query(f"with {D.SQL_TREE}, {_FILE_GONE} select * from e where src not in (select id from gone) and dst not in (select id from gone)")
def delete_file_edges(spark, d):
    nodes, edges = D.tree_nodes(spark, d), D.tree_edges(spark, d)
    return G.delete_nodes(nodes, edges, G.file_cascade(edges, nodes.where("id = 'n3'")))[1]


@query(f"with recursive {D.SQL_TREE}, {_REPO_GONE} select * from n where id not in (select id from gone)")
def delete_repo_cascade(spark, d):
    nodes, edges = D.tree_nodes(spark, d), D.tree_edges(spark, d)
    return G.delete_nodes(nodes, edges, G.repo_cascade(edges, nodes.where("id = 'r1'")))[0]


@query(f"{_F} select *, count(*) over () as total from f where label = 'Function' and contains(file_path, '#1') order by file_path, start_line, id limit 25 offset 10")
def paged_files(spark, d):
    return G.search_nodes(D.functions(spark, d), "Function", path_part="#1", offset=10, limit=25)


@query(
    f"""with {_G}, e as (select id as src, name, file_path, id as ordinal from f), t as (select file_path, name, arg_max(src, ordinal) as dst from e group by all)
select distinct f.id as src, t.dst, 'CALLS' as type from f join g on g.src = f.id join f c on c.id = g.dst join t on t.file_path = f.file_path and t.name = c.name"""
)
def resolve_calls(spark, d):
    nodes = D.functions(spark, d)
    named = D.calls(spark, d).join(nodes.select(F.col("id").alias("dst"), "name"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_list("name").alias("calls"))
    return G.resolve_calls(nodes.join(named, "id", "left").withColumn("ordinal", F.col("id")))


@query("select l_partkey as id, 'Line' as label, count(*) as count from lineitem group by l_partkey having count(*) > 1")
def duplicate_ids(spark, d):
    return G.duplicate_ids(load(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.lit("Line").alias("label")))


@query(f"with {D.SQL_TREE} select id, label, repo_id, count(*) over () as total from n where label = 'Function' and repo_id = 'r2'")
def functions_in_repo(spark, d):
    found = D.tree_nodes(spark, d).where("label = 'Function' and repo_id = 'r2'")
    return found.crossJoin(found.agg(F.count(F.lit(1)).alias("total")))
