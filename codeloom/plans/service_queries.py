"""Impact, questions, context, files, reviews and webhooks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import questions as Q
from codeloom.operators import impact as I
from codeloom.operators import review as R
from codeloom.plans import domain as D
from codeloom.plans.code_queries import ENTITIES, texts
from codeloom.plans.registry import query
from codeloom.sources import discovery as S
from codeloom.sources import parsing, webhooks
from codeloom.sources.tables import cut, load

_CHANGES = "['DELETE','RENAME','MODIFY','MOVE','ADD']"


def _change(key):
    return F.element_at(F.array(*[F.lit(x) for x in ("DELETE", "RENAME", "MODIFY", "MOVE", "ADD")]), (key % 5 + 1).cast("int"))


_LEVEL = "['none','low','medium','high','critical'][1 + greatest(0, case {c} when 'DELETE' then 4 when 'RENAME' then 3 when 'ADD' then 1 else 2 end - ({d} - 1))]"


@query(f"with e as (select event_id, {_CHANGES}[event_id % 5 + 1] as change, (user_id % 4 + 1) as distance from events) select event_id, change, distance, {_LEVEL.format(c='change', d='distance')} as level from e")
def impact_levels(spark, d):
    e = load(spark, d, "events").select("event_id", _change(F.col("event_id")).alias("change"), (F.col("user_id") % 4 + 1).alias("distance"))
    return e.withColumn("level", I.level(F.col("change"), F.col("distance")))


_RATED = f"""with recursive {D.SQL_CALLS}, {D.SQL_FUNCTIONS}, ch as (select p_partkey as change_id, p_partkey as entity_id, {_CHANGES}[p_partkey % 5 + 1] as change from part),
w as (select change_id, entity_id as id, 0 as depth from ch union select w.change_id, g.src, w.depth + 1 from w join g on g.dst = w.id where w.depth < 5),
n as (select change_id, id, min(depth) as distance from w group by all),
a as (select n.change_id, n.id, f.file_path, n.distance, {_LEVEL.format(c='ch.change', d='n.distance')} as level from n join f on f.id = n.id join ch on ch.change_id = n.change_id where n.distance > 0),
r as (select change_id, count(*) as total, count(*) filter (where distance = 1) as direct, count(*) filter (where level = 'critical') as critical, count(*) filter (where level = 'high') as high, count(*) filter (where level = 'medium') as medium, count(distinct file_path) as files from a group by 1),
z as (select ch.change_id, ch.entity_id, ch.change, coalesce(total, 0) as total, coalesce(direct, 0) as direct, coalesce(critical, 0) as critical, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(files, 0) as files from ch left join r using (change_id)),
o as (select *, case when total = 0 then 'none' when critical > 0 or high > 5 or direct > 10 then 'critical' when high > 0 or direct > 5 then 'high' when direct > 2 or total > 10 then 'medium' else 'low' end as overall,
case when total = 0 then 0 else least(100, case change when 'DELETE' then 40 when 'RENAME' then 30 when 'ADD' then 10 else 20 end + least(30, 5 * direct) + 10 * critical + 5 * high + 2 * medium + least(20, 2 * files)) end::bigint as risk from z)"""


def _report(spark, d):
    changes = load(spark, d, "part").select(F.col("p_partkey").alias("change_id"), F.col("p_partkey").alias("entity_id"), _change(F.col("p_partkey")).alias("change"))
    return I.report(D.functions(spark, d), cut(D.calls(spark, d), "calls"), changes)


@query(_RATED + " select change_id, change, total, direct, overall from o")
def overall_impact(spark, d):
    return _report(spark, d).select("change_id", "change", "total", "direct", "overall")


@query(_RATED + " select change_id, files, risk, risk > 50 or overall in ('high', 'critical') as requires_review from o")
def risk_score(spark, d):
    return _report(spark, d).select("change_id", "files", "risk", "requires_review")


_ADVICE = [
    ("risk > 70", "'Consider breaking this change into smaller increments'"), ("risk > 70", "'Ensure comprehensive test coverage before deploying'"), ("direct > 5", "'Update ' || direct || ' direct callers that may be affected'"),
    ("change = 'DELETE'", "'Verify all callers have been updated or removed'"), ("change = 'DELETE'", "'Consider deprecation period before full removal'"), ("change = 'RENAME'", "'Update all import statements and references'"),
    ("change = 'RENAME'", "'Consider adding a deprecation alias'"), ("change = 'MODIFY' and risk > 30", "'Review changes for backward compatibility'"), ("files > 3", "'Changes may affect ' || files || ' files'"), ("risk > 50", "'Run integration tests for all affected modules'"),
]


@query(
    _RATED
    + f""", af as (select change_id, file_path from a union select ch.change_id, f.file_path from ch join f on f.id = ch.entity_id),
fl as (select change_id, string_agg(file_path, ',' order by file_path) as affected_files from af group by 1)
select o.change_id, array_to_string(list_filter([{", ".join(f"case when {when} then {text} end" for when, text in _ADVICE)}], lambda x: x is not null), '; ') as recommendations, fl.affected_files from o left join fl on fl.change_id = o.change_id"""
)
def recommendations(spark, d):
    return _report(spark, d).select("change_id", F.array_join("recommendations", "; ").alias("recommendations"), F.array_join("affected_files", ",").alias("affected_files"))


_EXTRA = [
    "Explain how the login function works", "Trace the execution flow of process_request", "Find all functions that use the database", "Debug the error in the authentication module", "Review this code for issues", "Hello, can you help me today?",
    "What is `Parser.parse` and who calls run()?", "walking through the parser", "walk us right through", "somewhere it is recalled", "where is it called", "it calls back from here", "callsfrom", "shows allocations", "list them all", "looking forward", "look it up for me",
    "codereview", "apidocs of it", "api doc", "unit  tests", "unittest it", "testcase", "make a function", "make classes", "dataflow", "control of flow", "which modules?", "broken build", "any issues?", "what is it", "describe quality", "understanding", "follows it",
    "the class ''Foo'' and subclass Bar", "method \"quoted\" Module X1", "the walk functions of a.b and ab.cd", "FUNCTION up_case", "for the function of x.yz()",
]
_ASKED = "q as (select conv_id * 1000 + turn as id, text from conversations where role = 'user' union all select -i, t from (values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_EXTRA, 1)) + ") as v(i, t))"


def _questions(spark, d):
    asked = load(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return asked.unionByName(spark.createDataFrame([(-i, t.replace("''", "'")) for i, t in enumerate(_EXTRA, 1)], "id bigint, text string"))


_WORDS = {
    "explain": ["explain", "how does", "what does", "understand"], "trace": ["trace", "flow", "path", "call chain", "follows"], "find": ["find", "search", "where", "locate", "which"], "generate": ["generate", "create", "write", "implement", "add"],
    "review": ["review", "check", "issues", "problems"], "refactor": ["refactor", "improve", "clean", "simplify"], "debug": ["debug", "fix", "error", "bug", "broken"], "document": ["document", "docstring", "comment"], "test": ["test", "unittest", "pytest"],
}


@query("with " + _ASKED + " select id, case " + " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in words) + f" then '{t}'" for t, words in _WORDS.items()) + " else 'general' end as query_type from q")
def classify_keywords(spark, d):
    return _questions(spark, d).select("id", Q.classify_keywords(F.col("text")).alias("query_type"))


#: Word borders as RE2 can say them for letters, digits and `_` of any script. `<` and `>` stand for them below.
_EDGE = {"<": r"(?:^|[^\p{L}\p{N}_])", ">": r"(?:$|[^\p{L}\p{N}_])", "><": r"(?:[^\p{L}\p{N}_]|[^\p{L}\p{N}_].*[^\p{L}\p{N}_])"}
_SAID = {
    "explain": "explain|how does|what does|what is|understand|describe|walk.*through|tell me about", "trace": "trace|flow|path|call chain|follows?|execution|where.*called|calls?><from|data.*flow|control.*flow",
    "find": "find|search|where|locate|which|list><all|show.*all|look.*for", "generate": "generate|create|write|implement|add|build|make><function|make><class", "review": "review|check|issues?|problems?|quality|code[[:space:]]*review",
    "refactor": "refactor|improve|clean|simplify|optimize|restructure", "debug": "debug|fix|error|bug|broken|failing|crash|exception|not working", "document": "document|docstring|comment|documentation|api[[:space:]]*doc", "test": "test|unittest|pytest|test[[:space:]]*case|unit[[:space:]]*test",
}


def _scored(words: str) -> str:
    hits = [f"regexp_matches(text, '(?i){_EDGE['<']}(?:{w.replace('><', _EDGE['><'])}){_EDGE['>']}')::integer" for w in words.split("|")]
    return f"least(1.0, ({' + '.join(hits)}) / 2.0)"


_SCORES = ", ".join(map(_scored, _SAID.values()))
_ROUTED = (
    f"with {_ASKED}, s as (select id, text, [{_SCORES}]::double[] as s from q), o as (select *, list_reverse_sort(s) as r from s), p as (select *, r[1] as top, r[2] as second from o) "
    f"select id, case when top = 0 then 'general' else {list(_SAID)}[list_position(s, top)] end as query_type, round(case when top = 0 then 0.5 when second = 0 then top when top > 1.5 * second then least(top + 0.1, 1.0) else top * 0.9 end, 6) as confidence from p"
)


@query(_ROUTED)
def route_scores(spark, d):
    return Q.route(_questions(spark, d)).select("id", "query_type", F.round("confidence", 6).alias("confidence"))


_WORD, _NOUNS, _QUOTED = r"[\p{L}\p{N}_]+", "(?:function|method|class|module)", "[''\"]?"
_NAMES = [("`([^`]+)`", 1), (rf"{_NOUNS}\s+{_QUOTED}({_WORD}){_QUOTED}", 1), (rf"(?:the\s+)?({_WORD})\s+{_NOUNS}", 1), (rf"({_WORD})\(\)", 1), (rf"({_WORD})\.({_WORD})", 1), (rf"({_WORD})\.({_WORD})", 2)]
_NAMED = " || ".join(f"regexp_extract_all(text, '(?i){rx}', {g})" for rx, g in _NAMES)
_COMMON = ["the", "this", "that", "and", "for", "with", "from"] + ["how", "what", "where", "when", "why", "does"] + "function method class module file code".split()


@query(f"with {_ASKED} select id, array_to_string(list_sort(list_distinct(list_filter({_NAMED}, lambda x: length(x) > 1 and not list_contains({_COMMON}, lower(x))))), ',') as entities from q")
def extract_entities(spark, d):
    asked = _questions(spark, d)
    return asked.select("id", F.array_join(Q.entities(F.col("text")), ",").alias("entities"))


_HINTS = {
    "explain": "definition,docstring,callers,callees", "trace": "callees,callers,data_flow", "find": "semantic_search,graph_search", "generate": "similar_code,imports,types", "review": "definition,callers,tests", "refactor": "definition,callers,callees,similar_code",
    "debug": "definition,callers,callees,stack_trace", "document": "definition,usage_examples", "test": "definition,existing_tests,edge_cases",
}
_TASKS = {
    "explain": "Explain what this code does and why.", "trace": "Trace the calls and the data step by step.", "find": "Name the places that match.", "generate": "Write code in the style of the context.", "debug": "Find the cause and propose a fix.",
    "review": "List defects by severity.", "refactor": "Propose a simpler structure.", "document": "Write documentation.", "test": "Write tests.",
}


def _case(table, otherwise):
    return "case query_type " + " ".join(f"when '{k}' then {v!r}" for k, v in table.items()) + f" else {otherwise!r} end"


@query(
    f"""with {_ASKED}, s as (select id, text, [{_SCORES}]::double[] as s from q), o as (select *, list_reverse_sort(s) as r from s), k as (select id, text, case when r[1] = 0 then 'general' else {list(_SAID)}[list_position(s, r[1])] end as query_type,
list_sort(list_distinct(list_filter({_NAMED}, lambda x: length(x) > 1 and not list_contains({_COMMON}, lower(x)))))[1] as first from o),
p as (select *, {_case(_TASKS, "Answer from the context.")} || chr(10) || chr(10) || 'Context:' || chr(10) || chr(10) || chr(10) || 'Question: ' || text as prompt from k)
select id, query_type, {_case(_HINTS, "semantic_search")} as context, case when query_type in ('review', 'refactor', 'debug') then 12000 when query_type in ('trace', 'generate') then 10000 when query_type in ('find', 'document') then 6000 else 8000 end as budget,
{_case({"explain": "ExplainHandler", "trace": "TraceHandler", "find": "FindHandler", "generate": "GenerateHandler", "debug": "DebugHandler"}, "GeneralHandler")} as handler,
case when first is null then '' when query_type = 'explain' then 'What calls ' || first || '? Which tests cover ' || first || '?' else 'Explain ' || first || ' What depends on ' || first || '?' end as follow_ups,
'Mock answer ' || left(sha256(prompt), 8) as answer, length(prompt)::integer as prompt_tokens, 20 as answer_tokens from p"""
)
def prompts(spark, d):
    """Routing, context names, budget, handler, prompt and follow-ups of each question, answered by the mock model."""
    routed = Q.route(_questions(spark, d)).withColumn("names", Q.entities(F.col("text")))
    kind = F.col("query_type")
    answer, spent, got = Q.mock_answer(Q.prompt(kind, F.col("text"), F.lit("")))
    return routed.select("id", "query_type", F.array_join(Q.suggested_context(kind), ",").alias("context"), Q.context_budget(kind).alias("budget"), Q.handler(kind).alias("handler"), F.array_join(Q.follow_ups(kind, F.col("names")), " ").alias("follow_ups"), answer.alias("answer"), spent.alias("prompt_tokens"), got.alias("answer_tokens"))


def _snippets(spark, d):
    return load(spark, d, "documents").select(F.col("source").alias("question"), F.col("doc_id").alias("snippet_id"), (F.col("doc_id") * 7919 % 1000 / 1000).alias("relevance"), Q.tokens(F.col("text")).alias("tokens"))


_SNIPPETS = "s as (select source as question, doc_id as snippet_id, (doc_id * 7919 % 1000) / 1000.0::double as relevance, length(text) // 4 as tokens from documents)"
_PACKED = f"{_SNIPPETS}, r as (select *, row_number() over w as rank from s where relevance >= 0.5 window w as (partition by question order by relevance desc, snippet_id)), p as (select *, sum(tokens) over (partition by question order by rank) as running from r where rank <= 20)"


@query(f"with {_PACKED} select question, snippet_id, rank::integer as rank, running::bigint as running from p where running <= 8000")
def context_pack(spark, d):
    return Q.pack_context(_snippets(spark, d), "question").select("question", "snippet_id", "rank", F.col("running").cast("bigint").alias("running"))


@query(f"with {_PACKED} select question, count(*) as snippets, max(running)::bigint as used, 8000 - max(running)::bigint as remaining from p where running <= 8000 group by 1")
def token_budget(spark, d):
    packed = Q.pack_context(_snippets(spark, d), "question")
    return packed.groupBy("question").agg(F.count(F.lit(1)).alias("snippets"), F.max("running").cast("bigint").alias("used"), (8000 - F.max("running")).cast("bigint").alias("remaining"))


@query(f"with {_SNIPPETS}, r as (select *, row_number() over (partition by question order by relevance desc, snippet_id) as k from s) select question, round(least(1.0, avg(case when k <= 3 then relevance end) * (0.7 + 0.3 * least(count(*) / 5.0, 1.0))), 6) as confidence from r group by 1 union all select 'asked in vain', 0.5")
def confidence(spark, d):
    asked = _snippets(spark, d).select("question").unionByName(spark.createDataFrame([("asked in vain",)], "question string"))
    return Q.confidence(_snippets(spark, d), "question", asked).withColumn("confidence", F.round("confidence", 6))


def _snapshots(spark, d):
    o = load(spark, d, "orders")
    path = F.concat(F.lit("src/m"), (F.col("o_orderkey") % 50).cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string"), F.lit(".py"))
    old = o.where("o_orderkey % 11 <> 0").select(path.alias("path"), F.concat(F.lit("h"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("hash"))
    moved = F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("new/"), path)).otherwise(path)
    new = o.where("o_orderkey % 17 <> 0").select(moved.alias("path"), F.concat(F.lit("h"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("hash"))
    return old, new


_SNAP = """p as (select o_orderkey as k, o_custkey as c, 'src/m' || (o_orderkey % 50) || '/f' || o_orderkey || '.py' as path from orders),
o as (select path, 'h' || c || '-' || k as hash from p where k % 11 <> 0), n as (select case when k % 13 = 0 then 'new/' || path else path end as path, 'h' || (case when k % 7 = 0 then c + 1 else c end) || '-' || k as hash from p where k % 17 <> 0),
gone as (select * from o where path not in (select path from n)), come as (select * from n where path not in (select path from o)),
g as (select *, row_number() over (partition by hash order by path) as r from gone), c as (select *, row_number() over (partition by hash order by path) as r from come),
d as (select n.path, 'modified' as change, null as old_path from o join n using (path) where o.hash <> n.hash
union all select coalesce(c.path, g.path), case when g.path is null then 'added' when c.path is null then 'deleted' else 'renamed' end, case when g.path is not null and c.path is not null then g.path end from g full join c on g.hash = c.hash and g.r = c.r)"""


@query(f"with {_SNAP} select * from d")
def snapshot_diff(spark, d):
    return S.snapshot_diff(*_snapshots(spark, d))


@query(f"with {_SNAP} select path, 'process' as action from d where change <> 'deleted' union all select coalesce(old_path, path), 'remove' from d where change in ('deleted', 'renamed')")
def reindex_plan(spark, d):
    return S.reindex_plan(S.snapshot_diff(*_snapshots(spark, d)))


@query(f"with {_SNAP} select exists (select * from o except select * from n) or exists (select * from n except select * from o) as has_changes")
def has_changes(spark, d):
    return S.has_changes(*_snapshots(spark, d))


@query(f"with {_SNAP} select * from d where path like 'new/%' or old_path like 'new/%'")
def changed_in_directory(spark, d):
    return S.in_directory(S.snapshot_diff(*_snapshots(spark, d)), "new")


@query(
    """with b as (select p_partkey as k, 'src/f' || p_partkey || '.py' as path from part), s as (select path, 'modified' as change from b where k % 3 = 0), u as (select path, 'deleted' as change from b where k % 5 = 0), t as (select path from b where k % 7 = 0)
select * from s union all select * from u where path not in (select path from s) union all select path, 'added' from t"""
)
def uncommitted_changes(spark, d):
    k = F.col("p_partkey")
    b = load(spark, d, "part").select(k.alias("k"), F.concat(F.lit("src/f"), k.cast("string"), F.lit(".py")).alias("path"))
    return S.uncommitted(b.where("k % 3 = 0").withColumn("change", F.lit("modified")), b.where("k % 5 = 0").withColumn("change", F.lit("deleted")), b.where("k % 7 = 0"))


def _paths(spark, d):
    k = F.col("p_partkey")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src/", "lib/node_modules/", "build/", "docs/", "")]), (k % 5 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.py", "b.TS", "c.min.js", "notes.txt", ".py", "x.log", "Makefile")]), (k % 7 + 1).cast("int"))
    return load(spark, d, "part").select(k.alias("id"), F.concat(folder, F.lit("d"), (k % 40).cast("string"), F.lit("/"), name).alias("path"), (F.col("p_size") * 20_000).alias("size"))


_PATHS = """f as (select p_partkey as id, ['src/','lib/node_modules/','build/','docs/',''][p_partkey % 5 + 1] || 'd' || (p_partkey % 40) || '/' || ['a.py','b.TS','c.min.js','notes.txt','.py','x.log','Makefile'][p_partkey % 7 + 1] as path, p_size * 20000 as size from part),
g as (select *, case p_partkey % 7 when 0 then 'python' when 1 then 'typescript' when 2 then 'javascript' end as language from (select id as p_partkey, * from f))"""


@query(f"with {_PATHS} select id, path, language from g")
def language_detect(spark, d):
    return _paths(spark, d).select("id", "path", S.language(F.col("path")).alias("language"))


@query(f"with {_PATHS} select id, path, path like 'docs/%' or path like '%.log' or path like '%/d7/%' or path like 'd7/%' as ignored from g")
def gitignore_filter(spark, d):
    return _paths(spark, d).select("id", "path", S.ignored(F.col("path"), ["# comment", "!keep", "/docs/*", "*.log", "d7/"]).alias("ignored"))


@query(f"with {_PATHS} select id, path, language from g where language is not null and size <= 512000 and path not like '%node_modules/%' and path not like 'build/%' and path not like '%.min.js'")
def discover_files(spark, d):
    return S.select_files(_paths(spark, d)).select("id", "path", "language")


@query(f"with {_PATHS} select coalesce(language, 'unknown') as language, count(*) as files, sum(size)::bigint as bytes from g group by 1 union all select '*', count(*), sum(size)::bigint from g")
def ingestion_size(spark, d):
    return S.ingestion_size(_paths(spark, d).withColumn("language", S.language(F.col("path"))))


@query(f"with {_PATHS} select id from f where path like '%.py' or path like '%.log'")
def filter_by_extensions(spark, d):
    return _paths(spark, d).where(S.with_extension(F.col("path"), [".py", "log"])).select("id")


@query("select 'https://host/o/' || n_name || '.git' as url, n_name as name, left(sha256(n_name || ':' || 'https://host/o/' || n_name || '.git'), 16) as repo_id from nation")
def repo_ids(spark, d):
    n = load(spark, d, "nation").select(F.concat(F.lit("https://host/o/"), "n_name", F.lit(".git")).alias("url"))
    return n.withColumn("name", S.repo_name(F.col("url"))).withColumn("repo_id", S.repo_id(F.col("name"), F.col("url")))


@query("select event_type, count(*) filter (where value > 10) as processed, count(*) filter (where value <= 10) as errors, round(100.0 * count(*) filter (where value > 10) / count(*), 6) as success_rate from events where value is not null group by 1")
def success_rate(spark, d):
    e = load(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("processed"), F.count_if(F.col("value") <= 10).alias("errors"))
    return e.withColumn("success_rate", F.round(S.success_rate(F.col("processed"), F.col("errors")), 6))


@query()
def parsed_entities(spark, d):
    """All sources as entities; the parser has no SQL counterpart."""
    e = parsing.parse(texts(spark, d), "file_path", "text")
    return e.select("file_path", "id", "name", "type", "parent_id", "start_line", "end_line", F.array_join("calls", ",").alias("calls"), "error")


@query(
    f"select file_path, name, type, start_line, end_line, parameters from (values {', '.join(str((f, n, t, a, b, p)) for f, n, t, a, b, _, p in ENTITIES)}) as v(file_path, name, type, start_line, end_line, parameters)"
)
def parsed_definitions(spark, d):
    """Functions, methods and classes of all sources; the documents define none."""
    return parsing.measured(parsing.parse(texts(spark, d), "file_path", "text")).select("file_path", "name", "type", "start_line", "end_line", "parameters")


@query(
    """select * from (values ('greet.py:file', 'greet.py:greet:1', 'DEFINES'), ('age.py:file', 'age.py:check_age:1', 'DEFINES'), ('deep.py:file', 'deep.py:f:1', 'DEFINES'), ('docs.py:file', 'docs.py:f:7', 'DEFINES'), ('flow.py:file', 'flow.py:x:1', 'DEFINES'), ('flow.py:file', 'flow.py:y:2', 'DEFINES'),
('flow.py:file', 'flow.py:z:3', 'DEFINES'), ('flow.py:file', 'flow.py:unused:4', 'DEFINES'), ('flow.py:file', 'flow.py:x:5', 'DEFINES'), ('flow.py:file', 'flow.py:w:7', 'DEFINES'), ('single.py:file', 'single.py:S:1', 'DEFINES'), ('single.py:S:1', 'single.py:get_instance:3', 'HAS_METHOD'),
('make.py:file', 'make.py:CarFactory:1', 'DEFINES'), ('make.py:CarFactory:1', 'make.py:create_car:2', 'HAS_METHOD'), ('make.py:CarFactory:1', 'make.py:make_bike:4', 'HAS_METHOD'), ('wrap.py:file', 'wrap.py:timed:2', 'DEFINES'), ('wrap.py:file', 'wrap.py:LIMIT:11', 'DEFINES'), ('big.py:file', 'big.py:big:1', 'DEFINES')) as v(src, dst, type)"""
)
def parsed_structure(spark, d):
    """Structure and inheritance of all sources; the documents define nothing."""
    e = cut(parsing.parse(texts(spark, d), "file_path", "text"), "entities")
    return parsing.structure_edges(e).unionByName(parsing.inheritance_edges(e))


#: Lines of the patches: every rule is broken by one, and nearly broken by another.
_CHANGED = [
    " ctx eval(x)", "-old = eval(x)", "+x = eval (y)", "+evaluate(y)", "+EXEC(code)", "+password = 'a'", "+my_password='x\"", "+password = ''", '+API_KEY="k"', "+apikey = 'k'", "+cur.execute('a %s' % x)", "+cur.execute(q) # 5%", "+# todo later", "+#FIXME", "+#  Hack", "+todo", "+pprint(x)",
    "+console.log (1)", "+consolexlog(1)", "+mydebuggers", "+except :", "+except Exception:", "+pass", "+bypass  ", "+pass it", "+from a.b import *", "+from import *", "+ok",
]


def _patches(spark, d):
    k = F.col("p_partkey")
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.element_at(F.array(*[F.lit(x) for x in _CHANGED]), ((k + i * 3) % len(_CHANGED) + 1).cast("int")))), "\n")
    head = F.concat(F.lit("@@ -"), k.cast("string"), F.lit(",3 +"), (k + 1).cast("string"), F.lit(" @@ head\n"))
    parts = load(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # patches are much larger than the rows they are made of
    return parts.select((k % 50).alias("pr"), k.alias("file"), F.concat(F.lit("diff\n"), head, body, F.lit("\n"), head, F.lit(" end")).alias("patch"))


_DIFF = r"""pt as (select p_partkey % 50 as pr, p_partkey as file, 'diff' || chr(10) || '@@ -' || p_partkey || ',3 +' || (p_partkey + 1) || ' @@ head' || chr(10) ||
(select string_agg(CHANGED[(p_partkey + i * 3) % COUNT + 1], chr(10) order by i) from range(1, p_size + 1) as s(i))
|| chr(10) || '@@ -' || p_partkey || ',3 +' || (p_partkey + 1) || ' @@ head' || chr(10) || ' end' as patch from part),
s as (select pr, file, str_split(patch, chr(10)) as parts from pt), x as (select pr, file, unnest(range(0, len(parts))) as position, unnest(parts) as raw from s),
h as (select *, sum((raw like '@@ -%')::integer) over (partition by file order by position)::bigint as hunk from x),
k as (select *, case when raw like '@@ -%' then 'header' when raw like '+%' then 'add' when raw like '-%' then 'remove' else 'context' end as kind from h where hunk > 0),
dl as (select pr, file, hunk, position::integer as position, raw, kind, case when kind <> 'remove' then (file + 1 + coalesce(sum((kind in ('add', 'context'))::integer) over (partition by file, hunk order by position rows between unbounded preceding and 1 preceding), 0))::integer end as new_line from k),
lines as (select * from dl where kind <> 'header'),
rv as (RULES)"""
_S = "[[:space:]]*"
#: The review's rules as (category, severity, what is wrong, expression in RE2)
_BROKEN = [
    ("security", "ERROR", "Avoid using eval() - security risk", rf"\beval{_S}\("), ("security", "ERROR", "Avoid using exec() - security risk", rf"\bexec{_S}\("), ("security", "ERROR", "Hardcoded password detected", rf"password{_S}={_S}[''\"][^''\"]+[''\"]"),
    ("security", "ERROR", "Hardcoded API key detected", rf"api_key{_S}={_S}[''\"][^''\"]+[''\"]"), ("security", "ERROR", "Possible SQL injection vulnerability", r"\.execute\([^)]*[%]"), ("todo", "INFO", "TODO comment - consider addressing", f"#{_S}TODO"),
    ("todo", "INFO", "FIXME comment - needs attention", f"#{_S}FIXME"), ("todo", "INFO", "HACK comment - technical debt", f"#{_S}HACK"), ("debug", "INFO", "Debug print statement left in code", rf"print{_S}\("), ("debug", "INFO", "Debug console.log left in code", rf"console\.log{_S}\("),
    ("debug", "INFO", "Debugger statement left in code", "debugger"), ("exception", "WARNING", "Bare except clause - catch specific exceptions", f"except{_S}:"), ("empty", "WARNING", "Empty pass block - consider implementation or removal", f"pass{_S}$"), ("import", "WARNING", "Wildcard import - import specific names instead", r"from .+ import \*"),
]
_LITERALS = ["'" + x.replace("'", "''") + "'" for x in _CHANGED]
_RULES = " union all ".join(f"select pr, file, new_line, '{c}' as category, '{v}' as severity, '**{c.upper()}**: {m}' as body from lines where kind = 'add' and regexp_matches(raw[2:], '(?i){rx}')" for c, v, m, rx in _BROKEN)
_DIFF = _DIFF.replace("CHANGED", f"[{','.join(_LITERALS)}]").replace("COUNT", str(len(_CHANGED))).replace("RULES", _RULES)


@query(f"with {_DIFF} select file, row_number() over (partition by file order by position) ::integer as hunk, file::integer as old_start, 3 as old_count, (file + 1)::integer as new_start, 1 as new_count from x where raw like '@@ -%'")
def diff_hunks(spark, d):
    return R.hunks(_patches(spark, d), ["file"])


@query(f"with {_DIFF} select file, hunk, position, kind, new_line from lines")
def diff_line_numbers(spark, d):
    return R.diff_lines(_patches(spark, d), ["pr", "file"]).select("file", "hunk", "position", "kind", "new_line")


@query(f"with {_DIFF} select pr, file, new_line, category, severity, body from rv")
def review_comments(spark, d):
    return R.comments(R.diff_lines(_patches(spark, d), ["pr", "file"]), ["pr", "file"])


@query(
    f"""with {_DIFF}, c as (select pr, count(*) filter (where kind = 'add') as additions, count(*) filter (where kind = 'remove') as deletions, count(distinct file) as files from lines group by 1),
r as (select pr, count(*) filter (where severity = 'ERROR') as errors, count(*) filter (where severity = 'WARNING') as warnings, count(*) filter (where severity = 'INFO') as infos from rv group by 1)
select pr, additions, deletions, files, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(infos, 0) as infos, coalesce(errors + warnings, 0) as issues_found, case when errors > 0 or warnings > 3 then 'REQUEST_CHANGES' else 'COMMENT' end as status,
'## Review Summary' || chr(10) || chr(10) || '**Files analyzed:** ' || files || chr(10) || '**Changes:** +' || additions || ' / -' || deletions || chr(10) || case when errors > 0 then chr(10) || '- ' || errors || ' error(s) found' else '' end
|| case when warnings > 0 then chr(10) || '- ' || warnings || ' warning(s) found' else '' end || case when infos > 0 then chr(10) || '- ' || infos || ' informational note(s)' else '' end || case when r.pr is null then chr(10) || 'No issues found. Good job!' else '' end as summary from c left join r using (pr)"""
)
def review_status(spark, d):
    lines = cut(R.diff_lines(_patches(spark, d), ["pr", "file"]), "lines")
    return R.verdict(R.comments(lines, ["pr", "file"]), lines, "pr", "file").select("pr", "additions", "deletions", "files", "errors", "warnings", "infos", "issues_found", "status", "summary")


def _events(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("push", "pull_request", "installation", "strange")]), (F.col("event_id") % 4 + 1).cast("int"))
    n = F.get_json_object("props", "$.k").cast("int")
    action = F.element_at(F.array(*[F.lit(x) for x in ("opened", "closed", "reopened")]), (n % 3 + 1))
    commit = F.struct(F.lit("c").alias("id"), F.array(F.concat(F.lit("a"), (n % 5).cast("string"))).alias("added"), F.array(F.concat(F.lit("m"), (n % 3).cast("string")), F.lit("m0")).alias("modified"))
    body = F.to_json(F.struct(action.alias("action"), F.struct(F.when(n % 2 == 0, "closed").otherwise("open").alias("state"), (n % 4 == 0).alias("merged")).alias("pull_request"), F.when(F.col("event_id") % 4 == 0, F.array(commit)).alias("commits")))
    return load(spark, d, "events").select("event_id", kind.alias("event_type"), body.alias("payload"))


_EVENTS = "e as (select event_id, ['push','pull_request','installation','strange'][event_id % 4 + 1] as kind, json_extract_string(props, '$.k')::integer as n from events)"


@query(
    f"""with {_EVENTS} select event_id, case when kind = 'strange' then 'push' else kind end as event, case when n % 4 = 0 then 'merged' when n % 2 = 0 then 'closed' else 'open' end as state,
case when kind in ('push', 'strange') then 'push' when kind = 'installation' then kind when ['opened','closed','reopened'][n % 3 + 1] <> 'closed' then 'pull_request' else 'No handler' end as handler from e"""
)
def webhook_dispatch(spark, d):
    parsed = webhooks.parse(_events(spark, d))
    return parsed.select("event_id", "event", "state", webhooks.dispatch(F.col("event"), F.col("data.action")).alias("handler"))


@query(f"with {_EVENTS} select distinct event_id, unnest(['a' || (n % 5), 'm' || (n % 3), 'm0']) as file from e where event_id % 4 = 0")
def changed_files(spark, d):
    return webhooks.changed_files(webhooks.parse(_events(spark, d)), "event_id")


#: HMAC-SHA256 of `{}` and `{"a": 1}` with the key `secret`, worked out once with another implementation.
_SIGNED = ["sha256=77325902caca812dc259733aacd046b73817372c777b8d95b402647474516e13", "sha256=9efa14a18410a57a432fbf0ce38d4bc33339036a64e57b8c86da0bb1e122d972"]


@query("select event_id, event_id % 5 in (0, 1) as valid from events")
def webhook_signatures(spark, d):
    """Bodies with a right signature, another body's, a cut one, one without its prefix, and none."""
    k = F.col("event_id")
    body = F.when(k % 5 == 1, '{"a": 1}').otherwise("{}")
    signature = F.when(k % 5 == 0, _SIGNED[0]).when(k % 5 == 1, _SIGNED[1]).when(k % 5 == 2, _SIGNED[1]).when(k % 5 == 3, _SIGNED[0][7:])
    return load(spark, d, "events").select("event_id", webhooks.valid_signature(body, signature, "secret").alias("valid"))


@query("select doc_id, length(text) // 4 as tokens, case when length(text) // 4 <= 50 then text else left(text, 200) || '...' end as short from documents")
def truncate_tokens(spark, d):
    return load(spark, d, "documents").select("doc_id", Q.tokens(F.col("text")).alias("tokens"), Q.truncate(F.col("text"), 50).alias("short"))


