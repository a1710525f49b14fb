"""Names, batches, nodes, references and post-filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import names as M
from codeloom.functions import questions as Q
from codeloom.operators import nodes as N
from codeloom.operators import review as R
from codeloom.operators import vectors as V
from codeloom.plans import code_queries as CQ
from codeloom.plans import domain as D
from codeloom.plans import vector_queries as VQ
from codeloom.plans.registry import query
from codeloom.plans.service_queries import _PATHS, _SNAP, _paths, _snapshots
from codeloom.sources import discovery as S
from codeloom.sources import parsing
from codeloom.sources.tables import load


@query(
    r"""select p_partkey as id, p_name || '''"\' as raw, replace(replace(replace(p_name || '''"\', '\', '\\'), '''', '\'''), '"', '\"') as escaped,
case when regexp_matches(p_partkey || p_name, '^[0-9]') then '_' else '' end || regexp_replace(p_partkey || p_name, '[^A-Za-z0-9_]', '_', 'g') as identifier from part"""
)
def sanitized_names(spark, d):
    raw = F.concat("p_name", F.lit("'\"\\"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"), M.escape(raw).alias("escaped"), M.identifier(F.concat(F.col("p_partkey").cast("string"), F.col("p_name"))).alias("identifier"))


@query("select c_custkey as id, c_nationkey as nation, ((row_number() over (partition by c_nationkey order by c_custkey) - 1) // 20)::integer as batch from customer")
def batches(spark, d):
    return M.batches(load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), "id", 20, ["nation"])


@query("select p_brand || ':' || p_name || ':' || p_size as id, p_brand || ':function:' || p_name as typed_id, p_brand || ':' || p_name as short_id, upper(p_name) = p_name and regexp_matches(p_name, '[A-Z]') as is_constant, case when length(p_type) > 12 then left(p_type, 9) || '...' else p_type end as preview from part")
def entity_ids(spark, d):
    p = load(spark, d, "part")
    return p.select(M.entity_id(F.col("p_brand"), F.col("p_name"), F.col("p_size")).alias("id"), M.entity_id(F.col("p_brand"), F.col("p_name"), kind=F.lit("function")).alias("typed_id"), M.entity_id(F.col("p_brand"), F.col("p_name")).alias("short_id"), M.is_constant(F.col("p_name")).alias("is_constant"), M.preview(F.col("p_type"), 12).alias("preview"))


@query(f"with {D.SQL_CALLS}, {D.SQL_FUNCTIONS}, {D.SQL_CALLED} select file_path, 'call' as kind, count(*) as \"references\" from g join root on root.id = g.dst join f on f.id = g.src group by file_path")
def references_by_file(spark, d):
    edges = D.calls(spark, d)
    return N.references_by_file(edges, D.functions(spark, d), D.most_called(edges))


@query("select r_regionkey as id, r_name as name, case when r_regionkey = 2 then '2024-05-01T10:00:00' end as last_indexed from region")
def mark_indexed(spark, d):
    repos = load(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit("Repository").alias("label"), F.col("r_name").alias("name"), F.lit(None).cast("timestamp").alias("last_indexed"))
    return N.properties(N.mark_indexed(repos, 2, "2024-05-01 10:00:00"))


@query(f"with {VQ._C} select chunk_id, entity_type, round(score, 6) as score from (select chunk_id, split_part(chunk_type, '_', 1) as entity_type, cos as score from s order by cos desc, chunk_id limit 20) where entity_type = 'class'")
def search_postfilter(spark, d):
    found = V.search(VQ.chunks(spark, d), VQ.first(spark, d), limit=20, threshold=None)
    return VQ._out(found.where(F.col("entity_type").isin("class")), "entity_type")


@query(f"with {_PATHS} select id, path from g where lower(language) in ('python', 'javascript')")
def filter_by_language(spark, d):
    return _paths(spark, d).where(F.lower(S.language(F.col("path"))).isin("python", "javascript")).select("id", "path")


@query(f"with {_SNAP}, cc as (select count(*) filter (where change = 'added') as added, count(*) filter (where change = 'modified') as modified, count(*) filter (where change = 'deleted') as deleted, count(*) filter (where change = 'renamed') as renamed from d) select * from cc")
def change_counts(spark, d):
    diff = S.snapshot_diff(*_snapshots(spark, d))
    return diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted", "renamed")])


@query(f"with {D.SQL_CALLS}, i as (select dst as id, count(*) as incoming from g group by 1), o as (select src as id, count(*) as outgoing from g group by 1) select p_partkey as id, coalesce(incoming, 0) as incoming, coalesce(outgoing, 0) as outgoing from part left join i on i.id = p_partkey left join o on o.id = p_partkey")
def node_degrees(spark, d):
    edges = D.calls(spark, d)
    i, o = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("incoming")), edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id")).join(i, "id", "left").join(o, "id", "left").na.fill(0, ["incoming", "outgoing"])


@query(f"select * from (values ('Class', 2), ('Function', 6), ('Method', 3), ('Variable', 7)) as v(label, nodes) union all select 'Module', count(*) from {CQ._FILES}")
def parsed_nodes(spark, d):
    """All sources as graph nodes; the documents are modules without definitions."""
    entities = parsing.parse(CQ.texts(spark, d), "file_path", "text")
    return N.entity_nodes(entities, "r").groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"select * from (values ('greet.py', 2), ('age.py', 2), ('deep.py', 2), ('flow.py', 7), ('docs.py', 4), ('single.py', 4), ('make.py', 4), ('wrap.py', 4), ('big.py', 2), ('rules.txt', 1), ('empty.py', 1)) as v(file_path, entities) union all select doc_id::varchar, 1 from documents")
def entity_counts(spark, d):
    """Entities of each source as the ingestion counts them: with imports, variables and class attributes."""
    return parsing.entity_counts(CQ.texts(spark, d), "file_path")


@query("select conv_id, turn, length(role) // 4 + length(text) // 4 + 12 as tokens from conversations")
def message_tokens(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", Q.message_tokens(F.col("role"), F.col("text")).alias("tokens"))


_PLACES = "p as (select p_partkey as id, p_brand as path, case when p_size % 4 > 0 then p_size end as a, case when p_size % 3 > 0 then p_size + p_size % 2 end as b from part)"


@query(f"with {_PLACES} select id, path || case when a is null then '' when b is null or b = a then ':' || a else ':' || a || '-' || b end as location from p")
def locations(spark, d):
    n = F.col("p_size")
    start, end = F.when(n % 4 > 0, n), F.when(n % 3 > 0, n + n % 2)
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), Q.location(F.col("p_brand"), start, end).alias("location"))


_ENDINGS = ["a.py", "b.tsx", "c.go", "d.cpp", "e.c", "f.cs", "g.PY", "py", "h.py.txt", "i.rb", "j.jsx"]


@query(f"select p_partkey as id, ['python', 'typescript', 'go', 'cpp', 'c', 'csharp', null, null, null, 'ruby', 'javascript'][p_partkey % {len(_ENDINGS)} + 1] as language from part")
def review_languages(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in _ENDINGS]), (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), R.language_of(name).alias("language"))


@query("select p_partkey as id, ['added', 'deleted', 'renamed', 'modified', 'modified'][p_partkey % 5 + 1] as change, ['Function', 'Class', null, 'Method', 'Module'][p_partkey % 5 + 1] as label from part")
def change_letters(spark, d):
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), S.change_type(pick("A", "D", "R087", "M", "T")).alias("change"), M.label(pick("function", "CLASS", "import", "method", "module")).alias("label"))


@query(
    """with s as (select lang as q, doc_id, case when doc_id % 2 = 0 then lang end as language, text, (doc_id * 7919 % 1000) / 1000.0::double as relevance, length(text) // 4 as tokens from documents where lang is not null),
r as (select *, row_number() over w as rank from s where relevance >= 0.5 window w as (partition by q order by relevance desc, doc_id)), p as (select *, sum(tokens) over (partition by q order by rank) as running from r where rank <= 20)
select q, string_agg('### function: f' || doc_id || ' (' || doc_id || '.py:3-9)' || chr(10) || '```' || coalesce(language, '') || chr(10) || text || chr(10) || '```', chr(10) || chr(10) order by rank) as context from p where running <= 8000 group by q"""
)
def context_text(spark, d):
    """The packed snippets of each language's question as one text."""
    name = F.col("doc_id").cast("string")
    snippets = load(spark, d, "documents").where("lang is not null").select(
        F.col("lang").alias("q"), F.col("doc_id").alias("snippet_id"), (F.col("doc_id") * 7919 % 1000 / 1000).alias("relevance"), Q.tokens(F.col("text")).alias("tokens"), F.lit("function").alias("entity_type"), F.concat(F.lit("f"), name).alias("name"), F.concat(name, F.lit(".py")).alias("file_path"),
        F.lit(3).alias("start_line"), F.lit(9).alias("end_line"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("language"), F.col("text").alias("content"),
    )
    return Q.context_text(Q.pack_context(snippets, "q"), "q")


@query("select conv_id, turn, case (row_number() over (order by conv_id * 1000 + turn) - 1) % 2 when 0 then 'yes it is' else 'no' end as answer, length(role) + length(text) as input_tokens, case (row_number() over (order by conv_id * 1000 + turn) - 1) % 2 when 0 then 9 else 2 end as output_tokens, case (row_number() over (order by conv_id * 1000 + turn) - 1) % 2 when 0 then 3 else 1 end as pieces from conversations")
def canned_answers(spark, d):
    asked = load(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("system"), F.col("text").alias("user"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    return Q.canned_answers(asked, ["yes it is", "no"], "o").select("conv_id", "turn", "answer", "input_tokens", "output_tokens", F.size("pieces").alias("pieces"))
