"""Natural-language questions: routing, entities, prompts, and packing context into a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import in_order

#: Query type: what its questions say, in any case. The order breaks ties. ` .. ` stands for anything between two whole words, `...` for anything
#: between two parts whose inner ends may lie within words, `~` for white space or none, `(s)` for an optional ending.
_ROUTES = """
explain: explain; how does; what does; what is; understand; describe; walk...through; tell me about
trace: trace; flow; path; call chain; follow(s); execution; where...called; call(s) .. from; data...flow; control...flow
find: find; search; where; locate; which; list .. all; show...all; look...for
generate: generate; create; write; implement; add; build; make .. function; make .. class
review: review; check; issue(s); problem(s); quality; code~review
refactor: refactor; improve; clean; simplify; optimize; restructure
debug: debug; fix; error; bug; broken; failing; crash; exception; not working
document: document; docstring; comment; documentation; api~doc
test: test; unittest; pytest; test~case; unit~test
"""
#: Query type: words of the plain substring classifier, in its order.
_KEYWORDS = """
explain: explain; how does; what does; understand
trace: trace; flow; path; call chain; follows
find: find; search; where; locate; which
generate: generate; create; write; implement; add
review: review; check; issues; problems
refactor: refactor; improve; clean; simplify
debug: debug; fix; error; bug; broken
document: document; docstring; comment
test: test; unittest; pytest
"""


def _table(text: str) -> dict[str, list[str]]:
    return {name: phrases.strip().split("; ") for name, phrases in (line.split(":") for line in text.strip().splitlines())}


def _expression(phrase: str) -> str:
    """Whole words at both ends."""
    return r"\b" + phrase.replace("(s)", "s?").replace(" .. ", r"\b.*\b").replace("...", ".*").replace("~", r"\s*") + r"\b"


#: Query type -> expressions; a question scores 0.5 for the first that hits and 1.0 from the second on.
ROUTES = {t: [_expression(p) for p in phrases] for t, phrases in _table(_ROUTES).items()}
KEYWORDS = _table(_KEYWORDS)
COMMON = tuple("and class code does file for from function how method module that the this what when where why with".split())
_NOUN = "(?:function|method|class|module)"
_QUOTE = "['\"]?"
#: (expression, group): names in backquotes, after and before a noun, called, and both sides of a dot.
_ENTITIES = [("`([^`]++)`", 1), (rf"{_NOUN}\s++{_QUOTE}(\w++){_QUOTE}", 1), (rf"(?:the\s+)?(\w+)\s+{_NOUN}", 1), (r"(\w++)[(][)]", 1), (r"(\w++)[.](\w++)", 1), (r"(\w++)[.](\w++)", 2)]
CONTEXT = {
    "explain": "definition docstring callers callees", "trace": "callees callers data_flow", "find": "semantic_search graph_search", "generate": "similar_code imports types", "review": "definition callers tests",
    "refactor": "definition callers callees similar_code", "debug": "definition callers callees stack_trace", "document": "definition usage_examples", "test": "definition existing_tests edge_cases", "general": "semantic_search",
}
CONTEXT = {k: v.split() for k, v in CONTEXT.items()}
BUDGETS = {"explain": 8000, "trace": 10000, "find": 6000, "generate": 10000, "review": 12000, "refactor": 12000, "debug": 12000, "document": 6000, "test": 8000, "general": 8000}
HANDLERS = {"explain": "ExplainHandler", "trace": "TraceHandler", "find": "FindHandler", "generate": "GenerateHandler", "debug": "DebugHandler"}


def route_scores(text: Column) -> dict[str, Column]:
    """Type -> min(hits / 2, 1), where a hit is an expression that matches, in any case."""
    return {t: F.least(F.lit(1.0), reduce(lambda a, b: a + b, [text.rlike("(?Uid)" + rx).cast("int") for rx in regexes]) / 2) for t, regexes in ROUTES.items()}


def route(questions: DataFrame, text: str = "text") -> DataFrame:
    """questions with query_type and confidence.

    The best score wins, ties by the order of the types. Confidence: the score if only one type has one; + 0.1 (at most 1) where it is over 1.5
    times the second best; else 0.9 times it. Without a hit `general`, 0.5.
    """
    scored = questions.withColumn("__s", F.array(*[c.alias(t) for t, c in route_scores(F.col(text)).items()]))
    top = F.array_max("__s")
    names = F.array(*[F.lit(t) for t in ROUTES])
    rest = F.element_at(F.sort_array("__s", asc=False), 2)
    confidence = F.when(top == 0, 0.5).when(rest == 0, top).when(top > 1.5 * rest, F.least(top + 0.1, F.lit(1.0))).otherwise(top * 0.9)
    return scored.withColumn("query_type", F.when(top == 0, "general").otherwise(F.element_at(names, F.array_position("__s", top).cast("int")))).withColumn("confidence", confidence).drop("__s")


def classify_keywords(text: Column) -> Column:
    """The first type of which a word occurs anywhere in the lower-cased text, also inside other words."""
    low = F.lower(text)
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(t)) for t, words in KEYWORDS.items()], F.lit("general"))


def entities(text: Column) -> Column:
    """Sorted distinct names the question mentions, without one-letter and common words."""
    found = reduce(F.array_union, [F.regexp_extract_all(text, F.lit("(?Ui)" + rx), F.lit(g)) for rx, g in _ENTITIES])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.char_length(x) > 1) & ~F.lower(x).isin(*COMMON))))


def _lookup(key: Column, values: dict, otherwise) -> Column:
    out = F.lit(None)
    pairs = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    out = F.element_at(F.create_map(*pairs), key)
    return F.coalesce(out, otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def suggested_context(query_type: Column) -> Column:
    return _lookup(query_type, {k: F.array(*[F.lit(x) for x in v]) for k, v in CONTEXT.items()}, F.array(F.lit("semantic_search")))


def context_budget(query_type: Column) -> Column:
    return _lookup(query_type, BUDGETS, 8000)


def handler(query_type: Column) -> Column:
    """The handler that runs; types without their own run the general one."""
    return _lookup(query_type, HANDLERS, "GeneralHandler")


def prompt(query_type: Column, question: Column, context: Column) -> Column:
    tasks = {
        "explain": "Explain what this code does and why.", "trace": "Trace the calls and the data step by step.", "find": "Name the places that match.", "generate": "Write code in the style of the context.",
        "debug": "Find the cause and propose a fix.", "review": "List defects by severity.", "refactor": "Propose a simpler structure.", "document": "Write documentation.", "test": "Write tests.",
    }
    return F.concat(_lookup(query_type, tasks, "Answer from the context."), F.lit("\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question)


def follow_ups(query_type: Column, names: Column) -> Column:
    """Two further questions about the first entity; none without one."""
    first = F.try_element_at(names, F.lit(1))
    ask = F.when(query_type == "explain", F.array(F.concat(F.lit("What calls "), first, F.lit("?")), F.concat(F.lit("Which tests cover "), first, F.lit("?")))).otherwise(F.array(F.concat(F.lit("Explain "), first), F.concat(F.lit("What depends on "), first, F.lit("?"))))
    return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(ask)


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters."""
    return F.floor(F.char_length(text) / 4)


def truncate(text: Column, max_tokens: int) -> Column:
    return F.when(tokens(text) <= max_tokens, text).otherwise(F.concat(F.left(text, F.lit(4 * max_tokens)), F.lit("...")))


def message_tokens(system: Column, user: Column) -> Column:
    return tokens(system) + tokens(user) + 12


def location(path: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNull(), path).when(end.isNull() | (end == start), F.concat_ws(":", path, start.cast("string"))).otherwise(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def pack_context(snippets: DataFrame, key: str, max_tokens: int = 8000, max_snippets: int = 20, least: float = 0.5) -> DataFrame:
    """snippets(key, snippet_id, relevance, tokens) that enter each key's context, with their rank.

    Relevance below `least` goes; the rest by relevance (ties by id), at most max_snippets; the first that overflows the budget ends the context.
    """
    order = Window.partitionBy(key).orderBy(F.desc("relevance"), "snippet_id")
    ranked = snippets.where(F.col("relevance") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_snippets)
    running = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running", running).where(F.col("running") <= max_tokens)


def context_text(packed: DataFrame, key: str) -> DataFrame:
    """(key, context) of snippets(entity_type, name, file_path, start_line, end_line, language, content, rank)."""
    one = F.concat(F.lit("### "), "entity_type", F.lit(": "), "name", F.lit(" ("), location(F.col("file_path"), F.col("start_line"), F.col("end_line")), F.lit(")\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), "content", F.lit("\n```"))
    return packed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("s")))), lambda x: x["s"]), "\n\n").alias("context"))


def confidence(snippets: DataFrame, key: str, asked: DataFrame | None = None) -> DataFrame:
    """(key, confidence): mean of the three best relevances times 0.7 + 0.3 min(n / 5, 1), at most 1; of asked(key) those without snippets have 0.5."""
    order = Window.partitionBy(key).orderBy(F.desc("relevance"), "snippet_id")
    ranked = snippets.withColumn("__r", F.row_number().over(order))
    value = F.avg(F.when(F.col("__r") <= 3, F.col("relevance"))) * (0.7 + 0.3 * F.least(F.count(F.lit(1)) / 5, F.lit(1.0)))
    found = ranked.groupBy(key).agg(F.least(F.lit(1.0), value).alias("confidence"))
    return found if asked is None else asked.select(key).distinct().join(found, key, "left").na.fill(0.5, ["confidence"])


def mock_answer(prompt_: Column) -> tuple[Column, Column, Column]:
    """(answer, prompt tokens, answer tokens) of a model that isn't there: deterministic, tokens are character counts."""
    answer = F.concat(F.lit("Mock answer "), F.substring(F.sha2(prompt_, 256), 1, 8))
    return answer, F.char_length(prompt_), F.char_length(answer)


def canned_answers(asked: DataFrame, answers: list[str], order: str) -> DataFrame:
    """asked(system, user) with answer, input_tokens, output_tokens and pieces, as a model of canned answers gives them: in turn, in that order of the rows.

    Tokens are character counts; pieces are the answer's words as a stream has them.
    """
    turn = F.col("__turn") % len(answers)
    out = in_order(asked, order, "__turn").withColumn("answer", F.element_at(F.array(*[F.lit(a) for a in answers]), (turn + 1).cast("int"))).drop("__turn")
    sizes = {"input_tokens": F.char_length("system") + F.char_length("user"), "output_tokens": F.char_length("answer")}
    return out.withColumns(sizes).withColumn("pieces", F.transform(F.split("answer", " "), lambda w: F.concat(w, F.lit(" "))))
