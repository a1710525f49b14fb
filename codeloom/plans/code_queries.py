"""Metrics, patterns and data-flow over the documents' lines and a small corpus of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import code as C
from codeloom.operators import dataflow as X
from codeloom.plans import domain as D
from codeloom.plans.registry import query
from codeloom.sources import discovery, parsing
from codeloom.sources.tables import cut, load

#: Sources with what the documents lack; both engines get them as literals. rules.txt has each line rule's cases, also such that it must not take.
CORPUS = {
    "greet.py": "def greet(name):\n    return name\n",
    "age.py": "def check_age(age):\n    if age >= 18:\n        return True\n    else:\n        return False\n",
    "deep.py": "def f(items):\n    if items:\n        for i in items:\n            if i and i > 0 or i == -5:\n                while i:\n                    i = i - 1\n    return items\n",
    "flow.py": "x = source\ny = x + 1\nz = y * x\nunused = 5\nx = z\nreturn z\nw = [a for a in z if a]\n",
    "docs.py": '"""Module."""\n\n# comment\nimport os\nfrom sys import path\n\ndef f():\n    """\n    Long\n    text\n    """\n    return 1\n',
    "single.py": "class S:\n    _instance = None\n    def get_instance(cls):\n        if cls._instance is None:\n            cls._instance = S()\n        return cls._instance\n",
    "make.py": "class CarFactory:\n    def create_car(self):\n        return 1000\n    def make_bike(self):\n        return self.parts[10:20]\n",
    "wrap.py": "import functools\ndef timed(fn):\n    @functools.wraps(fn)\n    def wrapper(*args):\n        try:\n            global COUNT\n            return fn(*args)\n        except:\n            pass\n    return wrapper\nLIMIT = 300\n",
    "big.py": "def big(a, b, c, d, e, f):\n    if a and b or c:\n        for x in d:\n            if x:\n                while e:\n                    if f:\n                        pass\n    if a and b and c and d and e and f:\n        return [i for i in d if i]\n    return 0\n",
    "rules.txt": "class Factory:\n  def factory (self): get_instance()\n  def getInstance(self):\n  def create_ (x)\nclass MyFactoryBase(Base):\nclass Factory2 :\n  def build_thing (self):\n  def __new__ (cls):\n_instance: S\nmy_instance  =  None\nx[ 10 : 20 ]\n300.5\na300\n_PRIV = []\n  INDENTED = 5\nFROZEN = frozenset()\nMUT=x  # frozen\nOK == 200\n  global state\nglobal_ = 1\nexcept : x\nmyexcept  Exception :\nself._component.run(self.component)\nself.components\nself._wrapped\n",
    "empty.py": "",
}
#: The functions, methods and classes of those sources: (file, name, type, first line, last line, methods, parameters).
ENTITIES = [
    ("greet.py", "greet", "function", 1, 2, 0, 1), ("age.py", "check_age", "function", 1, 5, 0, 1), ("deep.py", "f", "function", 1, 7, 0, 1), ("docs.py", "f", "function", 7, 12, 0, 0), ("single.py", "S", "class", 1, 6, 1, 0), ("single.py", "get_instance", "method", 3, 6, 0, 1),
    ("make.py", "CarFactory", "class", 1, 5, 2, 0), ("make.py", "create_car", "method", 2, 3, 0, 1), ("make.py", "make_bike", "method", 4, 5, 0, 1), ("wrap.py", "timed", "function", 2, 10, 0, 1), ("big.py", "big", "function", 1, 10, 0, 6),
]


def corpus(spark):
    return spark.createDataFrame(list(CORPUS.items()), "file_path string, text string")


def texts(spark, d):
    """The corpus and every document."""
    return corpus(spark).unionByName(load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text"))


def parsed(spark, d):
    """Functions, methods and classes of all texts, measured and ready to be analysed."""
    return cut(parsing.measured(cut(parsing.parse(texts(spark, d), "file_path", "text"), "entities")), "measured")


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FILES = "(select * from (values " + ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in CORPUS.items()) + ") as v(file_path, text) union all select doc_id::varchar, text from documents)"
_T = f"t as {_FILES}"
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"
_LINES = rf"""r as (select file_path, str_split(text, chr(10)) as parts from t), l0 as (select file_path, unnest(range(1, len(parts) + 1)) as line, unnest(parts) as raw from r),
l as (select file_path, line, raw, regexp_replace(regexp_replace(raw, '^{_WS}', ''), '{_WS}$', '') as code from l0)"""
_ENTITIES = "en as (select file_path || ':' || name || ':' || start_line as id, * from (values " + ", ".join(str(e) for e in ENTITIES) + ") as v(file_path, name, type, start_line, end_line, methods, parameters))"
#: The entities' own lines in the place of the files
_OWN = f"{_ENTITIES}, src as {_FILES}, t as (select id as file_path, array_to_string(list_slice(str_split(text, chr(10)), start_line, end_line), chr(10)) as text from en join src using (file_path))"

_CYCLO = r"""tok as (select file_path, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}_]+')) as w from t), kw as (select file_path, count(*) as n from tok where w in ('if','elif','for','while','except','with','assert','and','or') group by 1),
cyc as (select t.file_path, (1 + coalesce(kw.n, 0) + len(regexp_extract_all(text, '\bfor\b.*\bif\b')))::integer as cyclomatic from t left join kw using (file_path))"""
_COGNITIVE = r"""lev as (select *, coalesce(sum(case when regexp_matches(code, '^(if|for|while|try|with)([^\p{L}\p{N}_]|$)') then 1 else 0 end) over (partition by file_path order by line rows between unbounded preceding and 1 preceding), 0) as level,
regexp_matches(code, '^(if|elif|else|for|while|try|except|finally|with|def|class|async)([^\p{L}\p{N}_]|$)') as opens from l),
cog as (select file_path, sum(case when opens then 1 + level else 0 end + (length(code) - length(replace(code, ' and ', ''))) // 5 + (length(code) - length(replace(code, ' or ', ''))) // 4)::bigint as cognitive from lev group by 1)"""
_NESTED = r"""ind as (select file_path, line, code, (length(raw) - length(regexp_replace(raw, '^{ws}', '')))::bigint as indent,
regexp_matches(code, '^(if|elif|else|for|while|try|except|finally|with|def|class|async)([^\p{{L}}\p{{N}}_]|$)') and code like '%:' as opens from l where code <> ''),
num as (select *, row_number() over (partition by file_path order by line) as n from ind),
stk as (select file_path, 0::bigint as n, [0::bigint] as stack, 0::bigint as deepest from t
union all select file_path, n, stack, greatest(deepest, len(stack) - 1) from (
select w.file_path, o.n, w.deepest, case when o.opens and list_filter(w.stack, lambda x: x <= o.indent or x = 0)[-1] < o.indent + 4
then list_append(list_filter(w.stack, lambda x: x <= o.indent or x = 0), o.indent + 4) else list_filter(w.stack, lambda x: x <= o.indent or x = 0) end as stack
from stk w join num o on o.file_path = w.file_path and o.n = w.n + 1)),
nest as (select file_path, max(deepest)::integer as nesting from stk group by 1)""".format(ws=_WS)
_COUNTS = """q as (select *, case when contains(code, '\"\"\"') then (length(code) - length(replace(code, '\"\"\"', ''))) // 3 else (length(code) - length(replace(code, '', ''))) // 3 end as marks from l),
p as (select *, coalesce(sum((marks = 1)::integer) over (partition by file_path order by line rows between unbounded preceding and 1 preceding), 0) as toggles from q),
kinds as (select file_path, case when code = '' then 'blank' when marks > 0 or toggles % 2 = 1 or code like '#%' then 'comment' else 'code' end as kind from p),
loc as (select file_path, count(*) filter (where kind = 'code') as code_lines, count(*) filter (where kind = 'comment') as comment_lines, count(*) filter (where kind = 'blank') as blank_lines from kinds group by 1)"""
_ALL_METRICS = f"{_LINES}, {_CYCLO}, {_COGNITIVE}, {_NESTED}, {_COUNTS}, met as (select * from cyc join cog using (file_path) join nest using (file_path) join loc using (file_path))"


@query(f"with {_T}, {_CYCLO} select * from cyc")
def cyclomatic(spark, d):
    return texts(spark, d).select("file_path", C.cyclomatic(F.col("text")).alias("cyclomatic"))


@query(f"with {_T}, {_LINES}, {_COGNITIVE} select * from cog")
def cognitive(spark, d):
    return C.cognitive(C.lines(texts(spark, d)))


@query(f"with recursive {_T}, {_LINES}, {_NESTED} select * from nest")
def nesting_depth(spark, d):
    return texts(spark, d).select("file_path", C.nesting_depth(F.col("text")).alias("nesting"))


@query(f"with {_T}, {_LINES}, {_COUNTS} select * from loc")
def lines_of_code(spark, d):
    return C.line_counts(C.lines(texts(spark, d)))


@query(f"with recursive {_T}, {_ALL_METRICS} select file_path, cyclomatic, cognitive, nesting as nesting_depth, code_lines as lines_of_code, comment_lines, blank_lines from met")
def complexity_metrics(spark, d):
    return C.complexity_metrics(texts(spark, d))


_INDEX = "case when code_lines <= 0 then 100.0 else least(100.0, greatest(0.0, (171 - 5.2 * ln(code_lines) - 0.23 * cyclomatic - 16.2 * ln(code_lines) + 10 * comment_lines / code_lines) * 100 / 171)) end"


@query(f"with {_T}, {_LINES}, {_CYCLO}, {_COUNTS} select file_path, round({_INDEX}, 6) as maintainability from cyc join loc using (file_path)")
def maintainability(spark, d):
    t = texts(spark, d)
    m = C.line_counts(C.lines(t)).join(t.select("file_path", C.cyclomatic(F.col("text")).alias("cyclomatic")), "file_path")
    return m.select("file_path", F.round(C.maintainability(F.col("code_lines"), F.col("cyclomatic"), F.col("comment_lines") / F.greatest("code_lines", F.lit(1))), 6).alias("maintainability"))


@query(
    f"""with {D.SQL_CALLS}, o as (select src as id, count(*) as efferent from g group by 1), i as (select dst as id, count(*) as afferent from g group by 1),
b as (select coalesce(o.id, i.id) as id, coalesce(efferent, 0) as efferent, coalesce(afferent, 0) as afferent from o full join i on o.id = i.id)
select b.id, afferent, efferent, efferent / (efferent + afferent) as instability, abs((p_size > 40)::integer + efferent / (efferent + afferent) - 1) as distance from b join part on p_partkey = b.id"""
)
def coupling(spark, d):
    return C.coupling(D.calls(spark, d), load(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("id")))


@query(
    """with u as (select distinct p_size as class_id, p_partkey as method_id, l_suppkey as attribute from lineitem join part on l_partkey = p_partkey),
s as (select a.class_id, count(distinct (a.method_id, b.method_id)) as sharing from u a join u b on a.class_id = b.class_id and a.attribute = b.attribute and a.method_id < b.method_id group by 1),
n as (select class_id, count(distinct method_id) as methods from u group by 1)
select class_id, methods, round(case when methods <= 1 then 1.0 else coalesce(sharing, 0) / (methods * (methods - 1) / 2) end, 9) as cohesion from n left join s using (class_id)"""
)
def cohesion(spark, d):
    uses = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_size").alias("class_id"), F.col("p_partkey").alias("method_id"), F.col("l_suppkey").alias("attribute"))
    return C.cohesion(uses).withColumn("cohesion", F.round("cohesion", 9))


@query(
    f"""with recursive {_OWN}, {_ALL_METRICS} select en.id, name, type, en.file_path, start_line, end_line, parameters, cyclomatic, cognitive, nesting as nesting_depth, code_lines as lines_of_code,
0.0::double as coupling_score, 0::bigint as dependency_count, 0::bigint as dependent_count, 1.0::double as cohesion_score from en join met on met.file_path = en.id"""
)
def entity_metrics(spark, d):
    return C.entity_metrics(parsed(spark, d))


_FILE = rf"""with {_ENTITIES}, {_T}, {_LINES}, {_COUNTS}, own as (select en.*, array_to_string(list_slice(str_split(text, chr(10)), start_line, end_line), chr(10)) as text from en join t using (file_path)),
words as (select id, unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+')) as w from own), n as (select id, count(*) as n from words where w in ('if','elif','for','while','except','with','assert','and','or') group by 1),
c as (select own.file_path, (1 + coalesce(n, 0) + len(regexp_extract_all(text, '\bfor\b.*\bif\b'))) as cyclomatic from own left join n using (id)), e as (select file_path, count(*) as entity_count, avg(cyclomatic) as avg_complexity, max(cyclomatic)::integer as max_complexity from c group by 1)"""


@query(
    _FILE
    + r""" select t.file_path, code_lines as lines_of_code, comment_lines as lines_of_comments, blank_lines, coalesce(entity_count, 0) as entity_count, coalesce(avg_complexity, 0)::double as avg_complexity, coalesce(max_complexity, 0) as max_complexity,
len(regexp_extract_all(text, '(?m)^(from\s+\S+\s+)?import\s+'))::integer as import_count, 0 as export_count from t join loc using (file_path) left join e using (file_path)"""
)
def file_metrics(spark, d):
    measured = parsed(spark, d).select("file_path", C.cyclomatic(F.col("source_code")).alias("cyclomatic"))
    return C.file_metrics(texts(spark, d), measured)


_FOUND = f"""{_OWN}, {_ALL_METRICS}, e as (select en.*, met.* exclude (file_path) from en join met on met.file_path = en.id),
fi as (select id, 'high_complexity' as rule, 'complexity' as category, case when cyclomatic > 15 then 'ERROR' else 'WARNING' end as severity from e where cyclomatic > 10
union all select id, 'deep_nesting', 'complexity', case when nesting > 6 then 'ERROR' else 'WARNING' end from e where nesting > 4 union all select id, 'many_parameters', 'complexity', 'INFO' from e where parameters > 5)"""


def _findings(metrics):
    return C.metric_findings(metrics.select("id", F.col("cyclomatic").alias("complexity"), F.col("coupling_score").alias("coupling"), F.col("cohesion_score").alias("cohesion"), F.col("nesting_depth").alias("nesting"), "parameters"))


@query(f"with recursive {_FOUND} select * from fi")
def metric_findings(spark, d):
    return _findings(C.entity_metrics(parsed(spark, d)))


@query(
    """with m as (select p_partkey as id, p_size as complexity, p_partkey % 10 / 10.0::double as coupling, p_partkey % 7 / 7.0::double as cohesion, p_partkey % 9 as nesting, p_partkey % 8 as parameters from part)
select id, 'high_complexity' as rule, 'complexity' as category, case when complexity > 15 then 'ERROR' else 'WARNING' end as severity from m where complexity > 10
union all select id, 'high_coupling', 'coupling', 'WARNING' from m where coupling > 0.7 union all select id, 'low_cohesion', 'cohesion', 'INFO' from m where cohesion < 0.3
union all select id, 'deep_nesting', 'complexity', case when nesting > 6 then 'ERROR' else 'WARNING' end from m where nesting > 4 union all select id, 'many_parameters', 'complexity', 'INFO' from m where parameters > 5"""
)
def metric_limits(spark, d):
    """Every rule and severity of metric_findings, on invented metrics: sources have few findings."""
    k = F.col("p_partkey")
    return C.metric_findings(load(spark, d, "part").select(k.alias("id"), F.col("p_size").alias("complexity"), (k % 10 / 10.0).alias("coupling"), (k % 7 / 7.0).alias("cohesion"), (k % 9).alias("nesting"), (k % 8).alias("parameters")))


@query(
    f"""with recursive {_FOUND} select (select count(*) from src) as total_files, (select count(*) from e) as total_entities, (select avg(cyclomatic) from e) as avg_complexity, 0.0::double as avg_coupling, 1.0::double as avg_cohesion, (select count(*) from fi) as total_findings,
(select string_agg(severity || '=' || n, ',' order by severity) from (select severity, count(*) as n from fi group by 1)) as by_severity, (select string_agg(category || '=' || n, ',' order by category) from (select category, count(*) as n from fi group by 1)) as by_category"""
)
def analysis_summary(spark, d):
    metrics = cut(C.entity_metrics(parsed(spark, d)), "metrics")
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    out = C.summary(texts(spark, d), metrics, cut(_findings(metrics), "findings"))
    return out.select(*[text(c) if c.startswith("by_") else c for c in out.columns])


@query(f"with {_T}, {_CYCLO} select case when cyclomatic <= 5 then '1-5' when cyclomatic <= 10 then '6-10' when cyclomatic <= 20 then '11-20' else '>20' end as bucket, count(*) as functions from cyc group by 1")
def complexity_histogram(spark, d):
    return C.complexity_histogram(texts(spark, d).select(C.cyclomatic(F.col("text")).alias("cyclomatic")))


@query("select lang as language, count(*) as files, sum(len(str_split(text, chr(10))))::bigint as lines, round(100.0 * count(*) / sum(count(*)) over (), 6) as percentage from documents group by lang")
def language_share(spark, d):
    files = load(spark, d, "documents").select(F.col("lang").alias("language"), F.size(F.split("text", "\n")).alias("lines"))
    return discovery.language_share(files).withColumn("percentage", F.round("percentage", 6))


def _hit(pattern, kind, severity, when):
    return f"select file_path, line, code, '{pattern}' as pattern, '{kind}' as type, '{severity}' as severity from l where {when}"


_M = "regexp_matches(raw, '{}')"
_GLOBAL = r"^[_A-Z][_A-Z0-9]*[\s]*="
_PATTERNS = "x as (" + " union all ".join(
    [_hit("singleton", "DESIGN_PATTERN", "INFO", _M.format(r)) for r in (r"_instance[\s]*=[\s]*None", r"def[\s]+get_instance[\s]*\(", r"def[\s]+getInstance[\s]*\(")]
    + [_hit("factory", "DESIGN_PATTERN", "INFO", _M.format(r)) for r in (r"def[\s]+create_\w+[\s]*\(", r"class[\s]+\w*Factory\b", r"def[\s]+factory[\s]*\(")]
    + [_hit("magic_numbers", "CODE_SMELL", "INFO", _M.format(r)) for r in (r"(^|\W)[2-9]\d\d+(\W|$)", r"\[[\s]*\d+[\s]*:[\s]*\d+[\s]*\]")]
    + [_hit("global_state", "ANTI_PATTERN", "WARNING", w) for w in (_M.format(r"^[\s]*global[\s]+\w"), f"regexp_matches(raw, '{_GLOBAL}') and not contains(regexp_replace(raw, '{_GLOBAL}', ''), 'frozen')")]
    + [_hit("bare_except", "ANTI_PATTERN", "WARNING", _M.format(r)) for r in (r"except[\s]*:", r"except[\s]+Exception[\s]*:")]
) + ")"


@query(f"with {_T}, {_LINES}, {_PATTERNS} select file_path, line, left(code, 100) as code, pattern, type, severity, 0.8::double as confidence from x")
def regex_patterns(spark, d):
    return C.regex_patterns(C.lines(texts(spark, d)))


@query(f"with {_T}, {_LINES}, {_PATTERNS} select pattern, severity, count(*) as findings, count(distinct file_path) as files from x where type in ('ANTI_PATTERN', 'CODE_SMELL') group by all")
def pattern_findings(spark, d):
    found = C.pattern_findings(C.regex_patterns(C.lines(texts(spark, d))))
    return found.groupBy("pattern", "severity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("file_path").alias("files"))


@query(
    f"""with {_ENTITIES}, {_T}, {_LINES}, {_PATTERNS} select file_path, pattern, type, severity, line as start_line, line as end_line, null::varchar as entity, left(code, 100) as code, 0.8::double as confidence from x where severity = 'WARNING'
union all select file_path, 'long_method', 'CODE_SMELL', 'WARNING', start_line, end_line, name, null, 0.9::double from en where type <> 'class' and end_line - start_line > 50
union all select file_path, 'god_class', 'CODE_SMELL', 'WARNING', start_line, end_line, name, null, 0.9::double from en where type = 'class' and (methods >= 15 or end_line - start_line >= 500)"""
)
def detected_warnings(spark, d):
    """All patterns of all sources, by lines and by entities, of which the findings of one severity are asked for."""
    return C.filter_findings(C.detect_patterns(texts(spark, d), parsed(spark, d)), severity="WARNING")


@query(
    f"""with {_ENTITIES}, {_T}, {_LINES}, {_PATTERNS} select file_path, pattern, type, severity, line as start_line, line as end_line, null::varchar as entity, left(code, 100) as code, 0.8::double as confidence from x
union all select file_path, 'long_parameter_list', 'CODE_SMELL', 'INFO', start_line, end_line, name, null, 0.9::double from en where type <> 'class' and parameters > 5"""
)
def detect_patterns(spark, d):
    return C.detect_patterns(texts(spark, d), parsed(spark, d))


@query(
    """with e as (select p_partkey as id, ['class','function','method'][p_partkey % 3 + 1] as type, (p_partkey * 37) % 700 as n, p_partkey % 25 as methods, p_partkey % 9 as parameters from part)
select id, 'god_class' as pattern, methods::bigint as value, 0.9::double as confidence from e where type = 'class' and (methods >= 15 or n >= 500)
union all select id, 'long_method', n, 0.9::double from e where type <> 'class' and n > 50 union all select id, 'long_parameter_list', parameters, 0.9::double from e where type <> 'class' and parameters > 5"""
)
def structural_patterns(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("class"), F.lit("function"), F.lit("method")), (k % 3 + 1).cast("int"))
    return C.structural_patterns(load(spark, d, "part").select(k.alias("id"), kind.alias("type"), F.lit(1).alias("start_line"), (1 + k * 37 % 700).alias("end_line"), (k % 25).alias("methods"), (k % 9).alias("parameters")))


_SIGN = r"_instance[\s]*[=:]|__new__[\s]*\(|cls\._instance"


@query(f"with {_T}, {_LINES} select file_path, min(line) as start_line, max(line) as end_line, count(*) as signs, 0.85::double as confidence from l where regexp_matches(raw, '{_SIGN}') group by 1 having count(*) >= 2")
def singleton(spark, d):
    return C.singletons(C.lines(texts(spark, d)))


_MADE = [(r"class[\s]+(\w*Factory\w*)[\s]*[(:]", "Factory class"), *((rf"def[\s]+({v}_\w+)[\s]*\(", w) for v, w in (("create", "Factory method"), ("make", "Factory method"), ("build", "Builder method")))]


@query(f"with {_T}, {_LINES} " + " union all ".join(f"select file_path, line, regexp_extract(raw, '{r}', 1) as entity, '{what}' as description, 0.9::double as confidence from l where regexp_matches(raw, '{r}')" for r, what in _MADE))
def factory(spark, d):
    return C.factories(C.lines(texts(spark, d)))


@query(
    f"""with {_T}, {_LINES}, x as (select file_path, line, contains(raw, 'self._component')::integer + contains(raw, 'self.component')::integer + contains(raw, 'self._wrapped')::integer + contains(raw, 'self.wrapped')::integer as n from l)
select file_path, min(line) as start_line, max(line) as end_line, sum(n)::bigint as signs, 0.7::double as confidence from x where n > 0 group by 1 having sum(n) >= 2"""
)
def decorator(spark, d):
    return C.decorators(C.lines(texts(spark, d)))


_SETS = r"^[\s]*([_a-zA-Z0-9]+)[\s]*[=][\s]*(.+)$"
_SPLIT = rf"regexp_extract(raw, '{_SETS}', 1) as name, trim(regexp_extract(raw, '{_SETS}', 2)) as value"
_IS_SET = rf"regexp_matches(raw, '{_SETS}') and not regexp_matches(trim(regexp_extract(raw, '{_SETS}', 2)), '^(def |class |lambda)')"
_ASSIGN = f"a as (select file_path, line, {_SPLIT} from l where {_IS_SET})"
#: Whole words in which letters are ASCII
_NAMES = r"list_filter(list_distinct(regexp_split_to_array(value, '[^\p{L}\p{N}_]+')), lambda v: regexp_matches(v, '^[a-zA-Z_][a-zA-Z0-9_]*$'))"
_VARS = f"list_filter({_NAMES}, lambda v: v <> name and not list_contains(['True','False','None','and','or','not','in','is','if','else','for'], v))"
_EDGES = f"""u as (select file_path, line, unnest({_VARS}) as name from a),
du as (select u.file_path, max(a.line) as src_line, u.line as dst_line, u.name from u join a on a.file_path = u.file_path and a.name = u.name and a.line < u.line group by u.file_path, u.line, u.name)"""
_RETURNS = r"""r2 as (select file_path, line, regexp_extract(raw, '^[\s]*return[\s]+(.*)$', 1) as value from l where regexp_matches(raw, '^[\s]*return[\s]+'))"""


def _assigned(spark, d):
    return X.assignments(C.lines(texts(spark, d)))


@query(f"with {_T}, {_LINES}, {_ASSIGN} select file_path, line, name, value from a")
def assignments(spark, d):
    return _assigned(spark, d)


@query(f"with {_T}, {_LINES}, {_ASSIGN}, {_EDGES} select * from du")
def def_use_edges(spark, d):
    return X.def_use_edges(_assigned(spark, d))


@query(
    f"""with {_T}, {_LINES}, {_ASSIGN}, {_RETURNS}, v as (select file_path, line as dst_line, unnest({_NAMES}) as name from r2),
last as (select file_path, name, max(line) as src_line from a group by all) select v.file_path, src_line, dst_line, v.name from v join last using (file_path, name)"""
)
def return_edges(spark, d):
    return X.return_edges(_assigned(spark, d), X.returns(C.lines(texts(spark, d))))


@query(
    f"""with {_T}, {_LINES}, {_ASSIGN}, {_EDGES} select file_path, name, line, value from a
where not exists (select 1 from du where du.file_path = a.file_path and du.src_line = a.line) and not exists (select 1 from a b where b.file_path = a.file_path and b.name = a.name and b.line > a.line)"""
)
def unused_assignments(spark, d):
    a = cut(_assigned(spark, d), "assigned")
    return X.unused_assignments(a, X.def_use_edges(a)).select("file_path", "name", "line", "value")


#: Parameters of the functions and methods, in order; none has an annotation.
_TAKEN = {"greet": "name", "check_age": "age", "get_instance": "cls", "create_car": "self", "make_bike": "self", "timed": "fn", "big": "a b c d e f"}
_PARAMETERS = ", ".join(f"('{f}', '{n}', {b}, {i}, '{x}')" for f, n, kind, b, *_ in ENTITIES if kind != "class" for i, x in enumerate((_TAKEN.get(n) or ("items" if f == "deep.py" else "")).split(), 1))
_FLOW = f"""{_ENTITIES}, src as {_FILES}, un as (select file_path, 0::bigint as unit, '<module>' as scope, 0 as base, text from src
union all select en.file_path, row_number() over (partition by en.file_path order by start_line, name), name, start_line, array_to_string(list_slice(str_split(text, chr(10)), start_line, end_line), chr(10)) from en join src using (file_path) where type <> 'class'),
t as (select {{'f': file_path, 'u': unit}} as file_path, text from un), {_LINES}, {_ASSIGN}, {_EDGES}, {_RETURNS},
par as (select {{'f': v.file_path, 'u': unit}} as file_path, i as line, p as name from (values {_PARAMETERS}) as v(file_path, scope, base, i, p) join un on un.file_path = v.file_path and un.scope = v.scope and un.base = v.base),
pt as (select file_path, 1 as rank, 'param' as kind, line, name, null as value from par union all select file_path, 2, 'assign', line, name, case when length(value) < 50 then value else left(value, 47) || '...' end from a
union all select file_path, 3, 'return', line, '<return>', case when value <> '' then left(value, 50) end from r2 where file_path.u > 0),
nm as (select pt.*, kind || '_' || row_number() over (partition by pt.file_path.f order by pt.file_path.u, rank, line) as id, scope, base from pt join un on un.file_path = pt.file_path.f and un.unit = pt.file_path.u)"""


@query(f"with {_FLOW} select nm.file_path.f as file_path, id, name, case kind when 'param' then 'parameter' when 'assign' then 'assignment' else 'return' end as node_type, (case when kind = 'param' then base else base + line - 1 end)::integer as line, scope, value, null::varchar as data_type from nm")
def flow_nodes(spark, d):
    return _flow(spark, d)[0]


@query(
    f"""with {_FLOW}, last as (select file_path, name, max(line) as src_line from a group by all), re as (select file_path, line as dst_line, unnest({_NAMES}) as name from r2 where file_path.u > 0),
ed as (select file_path, src_line, dst_line, 'assign' as kind, 'use' as type from du union all select re.file_path, src_line, dst_line, 'return', 'return_value' from re join last on last.file_path = re.file_path and last.name = re.name)
select ed.file_path.f as file_path, s.id as src, x.id as dst, ed.type from ed join nm s on s.file_path = ed.file_path and s.kind = 'assign' and s.line = src_line join nm x on x.file_path = ed.file_path and x.kind = ed.kind and x.line = dst_line"""
)
def flow_edges(spark, d):
    return _flow(spark, d)[1]


def _flow(spark, d):
    found = texts(spark, d)
    parsed_ = cut(parsing.parse(found, "file_path", "text"), "entities").where("type in ('function', 'method')")
    pick = F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["type_annotation"].alias("type_annotation")))
    return X.flow_graph(found, parsed_.select("file_path", "name", "start_line", "source_code", pick.alias("parameters")))


def _asked(spark, d):
    return load(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"))


@query(f"with recursive {D.SQL_CALLS}, s as (select p_partkey as id from part where p_partkey % 100 = 0), w as (select id, 0 as distance from s union select g.dst, w.distance + 1 from w join g on g.src = w.id where w.distance < 60) select id, min(distance) as distance from w group by 1")
def taint(spark, d):
    """What data from the nodes whose id is divisible by 100 reaches."""
    return X.tainted(cut(D.calls(spark, d), "calls"), _asked(spark, d))


_TRACE = "with recursive {calls}, w as (select p_partkey as start, p_partkey as id from part where p_partkey % 100 = 0 union select w.start, g.{far} from w join g on g.{near} = w.id) select start, id from w where not exists (select 1 from g where g.{near} = w.id)"


@query(_TRACE.format(calls=D.SQL_CALLS, near="dst", far="src"))
def trace_origin(spark, d):
    """From the nodes whose id is divisible by 100, the query set of searches."""
    return X.trace(cut(D.calls(spark, d), "calls"), _asked(spark, d), True)


@query(_TRACE.format(calls=D.SQL_CALLS, near="src", far="dst"))
def trace_destination(spark, d):
    """From the nodes whose id is divisible by 100."""
    return X.trace(cut(D.calls(spark, d), "calls"), _asked(spark, d), False)
