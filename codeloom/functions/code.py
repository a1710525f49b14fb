"""Source text: lines, metrics, patterns. All of it is column expressions and windows over a line table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BRANCHES = "if elif for while except with assert and or".split()
_NESTING = "if elif else for while try except finally with def class async".split()
_STICKY = "if for while try with".split()


def strip(c: Column) -> Column:
    """White space of any kind off both ends (trim alone takes spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def lines(files: DataFrame, key: str = "file_path", text: str = "text") -> DataFrame:
    """(key, line, raw, code): line numbers from 1; code is the stripped line."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("__i", "raw")).select(key, (F.col("__i") + 1).alias("line"), "raw", strip(F.col("raw")).alias("code"))


def cyclomatic(text: Column) -> Column:
    """1 + whole-word branch keywords + comprehensions that filter (`for .. if` on one line); comments and strings count too."""
    words = rf"(?U)\b({'|'.join(_BRANCHES)})\b"
    return (F.regexp_count(text, F.lit(words)) + F.regexp_count(text, F.lit(r"(?d)\bfor\b.*\bif\b")) + 1).cast("int")


def import_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^(?:from\s++\S++\s++)?+import\s")).cast("int")


def _starts(code: Column, words: list[str]) -> Column:
    return code.rlike(rf"(?U)^({'|'.join(words)})\b")


def _occurrences(code: Column, part: str) -> Column:
    return F.regexp_count(code, F.lit(part))


def cognitive(line_table: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, cognitive): a line that opens a block costs 1 + the blocks opened before it (the level never falls); each ` and ` or ` or ` costs 1."""
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum(_starts(F.col("code"), _STICKY).cast("int")).over(before), F.lit(0))
    cost = F.when(_starts(F.col("code"), _NESTING), 1 + level).otherwise(0) + _occurrences(F.col("code"), " and ") + _occurrences(F.col("code"), " or ")
    return line_table.withColumn("__cost", cost).groupBy(key).agg(F.sum("__cost").cast("bigint").alias("cognitive"))


def line_counts(line_table: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, code_lines, comment_lines, blank_lines).

    Blank first. A line with triple quotes is a comment, and exactly one mark in it opens or closes a docstring, whose lines are comments;
    where a line has both kinds of quotes the double ones count.
    """
    code = F.col("code")
    double, single = _occurrences(code, '"""'), _occurrences(code, "'''")
    marks = F.when(double > 0, double).otherwise(single)
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    toggles = F.coalesce(F.sum((marks == 1).cast("int")).over(before), F.lit(0))
    kind = F.when(code == "", "blank").when((marks > 0) | (toggles % 2 == 1) | code.startswith("#"), "comment").otherwise("code")
    counts = [F.sum((F.col("__kind") == k).cast("bigint")).alias(f"{k}_lines") for k in ("code", "comment", "blank")]
    return line_table.withColumn("__kind", kind).groupBy(key).agg(*counts)


def nesting_depth(text: Column) -> Column:
    """The greatest depth of the indentation stack: a line pops indents greater than its own; a block line that ends in a colon pushes its indent + 4.

    The stack increases strictly, so its size is the depth; one fold over the lines, no UDF.
    """
    start = F.struct(F.array(F.lit(0)).alias("stack"), F.lit(0).alias("deepest"))

    def step(acc, raw):
        code = strip(raw)
        indent = F.char_length(raw) - F.char_length(F.regexp_replace(raw, r"(?U)^\s+", ""))
        popped = F.filter(acc["stack"], lambda x: (x <= indent) | (x == 0))
        opens = _starts(code, _NESTING) & code.endswith(":")
        stack = F.when(opens & (F.element_at(popped, -1) < indent + 4), F.array_append(popped, indent + 4)).otherwise(popped)
        return F.when(code == "", acc).otherwise(F.struct(stack.alias("stack"), F.greatest(acc["deepest"], F.size(stack) - 1).alias("deepest")))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["deepest"])


def maintainability(loc: Column, cyclomatic_: Column, comment_ratio: Column) -> Column:
    """The index on 0..100; 100 without lines."""
    raw = (171 - 5.2 * F.ln(loc) - 0.23 * cyclomatic_ - 16.2 * F.ln(loc) + 10 * comment_ratio) * 100 / 171
    return F.when(loc <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))


def coupling(dependencies: DataFrame, abstract: DataFrame | None = None) -> DataFrame:
    """(id, afferent, efferent, instability, distance) over edges(src, dst); edges that repeat count each. abstract(id) are abstract."""
    out = dependencies.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("efferent"))
    into = dependencies.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("afferent"))
    both = out.join(into, "id", "full_outer").na.fill(0, ["efferent", "afferent"])
    both = both.withColumn("instability", F.col("efferent") / (F.col("efferent") + F.col("afferent")))
    is_abstract = F.lit(0) if abstract is None else F.when(F.col("__abstract"), 1).otherwise(0)
    if abstract is not None:
        both = both.join(abstract.select("id", F.lit(True).alias("__abstract")), "id", "left")
    return both.withColumn("distance", F.abs(is_abstract + F.col("instability") - 1)).select("id", "afferent", "efferent", "instability", "distance")


def cohesion(uses: DataFrame) -> DataFrame:
    """(class_id, methods, cohesion) over uses(class_id, method_id, attribute): pairs of methods that share an attribute, of all pairs; 1 with one method.

    Only pairs that share an attribute are ever built: each use is joined with the methods of its attribute, packed as one array. A method's arrays
    meet in one row of its own and become a set there, so no table of pairs is shuffled or held.
    """
    u = uses.select("class_id", "method_id", "attribute").distinct()
    users = u.where("attribute is not null").groupBy("class_id", "attribute").agg(F.sort_array(F.collect_list("method_id")).alias("users")).where("size(users) > 1")
    later = users.select("class_id", F.posexplode("users").alias("at", "method_id"), "users").select("class_id", "method_id", F.slice("users", F.col("at") + 2, F.size("users")).alias("later")).where("size(later) > 0")
    shared = later.groupBy("class_id", "method_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("later")))).cast("bigint").alias("n")).groupBy("class_id").agg(F.sum("n").alias("sharing"))
    sizes = u.groupBy("class_id").agg(F.count_distinct("method_id").alias("methods"))
    pairs = F.col("methods") * (F.col("methods") - 1) / 2
    return sizes.join(shared, "class_id", "left").select("class_id", "methods", F.when(F.col("methods") <= 1, 1.0).otherwise(F.coalesce("sharing", F.lit(0)) / pairs).alias("cohesion"))


#: complexity, coupling, cohesion, nesting, parameters
THRESHOLDS = {"complexity": 10, "coupling": 0.7, "cohesion": 0.3, "nesting": 4, "parameters": 5}


def metric_findings(metrics: DataFrame, limits: dict = THRESHOLDS) -> DataFrame:
    """(id, rule, category, severity) of metrics(id, complexity, coupling, cohesion, nesting, parameters) beyond their limits."""

    def finding(rule: str, when: Column, severity: Column) -> Column:
        category = {"high_coupling": "coupling", "low_cohesion": "cohesion"}.get(rule, "complexity")
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), severity.alias("severity")))

    c = limits["complexity"]
    rules = [
        finding("high_complexity", F.col("complexity") > c, F.when(F.col("complexity") > 1.5 * c, "ERROR").otherwise("WARNING")),
        finding("high_coupling", F.col("coupling") > limits["coupling"], F.lit("WARNING")),
        finding("low_cohesion", F.col("cohesion") < limits["cohesion"], F.lit("INFO")),
        finding("deep_nesting", F.col("nesting") > limits["nesting"], F.when(F.col("nesting") > 6, "ERROR").otherwise("WARNING")),
        finding("many_parameters", F.col("parameters") > limits["parameters"], F.lit("INFO")),
    ]
    return metrics.select("id", F.inline(F.array_compact(F.array(*rules))))


#: Parts of expressions that several rules use.
_CALL, _SET = r"\s*+[(]", r"\s*+="
_WORD_EDGE = "[A-Za-z0-9_]"
#: (id, type, severity, regular expressions) of the patterns found line by line; line ends are newlines only.
PATTERNS = [
    ("singleton", "DESIGN_PATTERN", "INFO", [rf"_instance{_SET}\s*+None", *(rf"def\s++{f}{_CALL}" for f in ("get_instance", "getInstance"))]),
    ("factory", "DESIGN_PATTERN", "INFO", [rf"def\s++create_\w++{_CALL}", r"class\s++\w*Factory\b", rf"def\s++factory{_CALL}"]),
    ("magic_numbers", "CODE_SMELL", "INFO", [rf"(?<!{_WORD_EDGE})[2-9]\d\d++(?!{_WORD_EDGE})", r"\[" + ":".join([r"\s*+\d++\s*+"] * 2) + r"\]"]),
    ("global_state", "ANTI_PATTERN", "WARNING", [r"^\s*+global\s++\w", rf"^[_A-Z][_A-Z0-9]*+{_SET}(?!.*frozen)"]),
    ("bare_except", "ANTI_PATTERN", "WARNING", [rf"except{what}\s*+:" for what in ("", r"\s++Exception")]),
]


def _finds(line: Column, rx: str) -> Column:
    return line.rlike("(?Ud)" + rx)


def regex_patterns(line_table: DataFrame, key: str = "file_path", patterns: list = PATTERNS) -> DataFrame:
    """(key, line, code, pattern, type, severity, confidence): one row for each regular expression that a raw line holds; code is the stripped line."""
    hits = [F.when(_finds(F.col("raw"), rx), F.struct(F.lit(p).alias("pattern"), F.lit(kind).alias("type"), F.lit(sev).alias("severity"))) for p, kind, sev, regexes in patterns for rx in regexes]
    return line_table.select(key, "line", F.left("code", F.lit(100)).alias("code"), F.inline(F.array_compact(F.array(*hits)))).withColumn("confidence", F.lit(0.8))


def structural_patterns(entities: DataFrame) -> DataFrame:
    """(id, pattern, value) of entities(id, type, start_line, end_line, methods, parameters): god_class, long_method, long_parameter_list."""
    n_lines = F.col("end_line") - F.col("start_line")
    methods, parameters = F.coalesce("methods", F.lit(0)), F.coalesce("parameters", F.lit(0))
    is_class, is_function = F.col("type") == "class", F.col("type").isin("function", "method")

    def hit(name: str, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("pattern"), value.cast("bigint").alias("value")))

    rules = [hit("god_class", is_class & ((methods >= 15) | (n_lines >= 500)), methods), hit("long_method", is_function & (n_lines > 50), n_lines), hit("long_parameter_list", is_function & (parameters > 5), parameters)]
    return entities.select("id", F.inline(F.array_compact(F.array(*rules)))).withColumn("confidence", F.lit(0.9))


_SINGLETON = (r"_instance\s*+[:=]", rf"__new__{_CALL}", r"cls[.]_instance")
#: (expression whose first group is what is made, description)
_FACTORY = ((r"class\s++(\w*Factory\w*)\s*+[:(]", "Factory class"), *((rf"def\s++({verb}_\w++){_CALL}", what) for verb, what in (("create", "Factory method"), ("make", "Factory method"), ("build", "Builder method"))))
_WRAPPED = tuple(f"self[.]{attribute}" for attribute in ("_component", "component", "_wrapped", "wrapped"))


def singletons(line_table: DataFrame, key: str = "file_path") -> DataFrame:
    """Files in which at least two lines show a sign of a singleton: (key, start_line, end_line, signs, confidence)."""
    any_sign = reduce(lambda a, b: a | b, [_finds(F.col("raw"), r) for r in _SINGLETON])
    return line_table.where(any_sign).groupBy(key).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count(F.lit(1)).alias("signs")).where("signs >= 2").withColumn("confidence", F.lit(0.85))


def factories(line_table: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, line, entity, description, confidence): factory classes and methods by their whole names, one row for each expression that matches."""
    hits = [F.when(_finds(F.col("raw"), r), F.struct(F.regexp_extract("raw", "(?Ud)" + r, 1).alias("entity"), F.lit(what).alias("description"))) for r, what in _FACTORY]
    return line_table.select(key, "line", F.inline(F.array_compact(F.array(*hits)))).withColumn("confidence", F.lit(0.9))


def decorators(line_table: DataFrame, key: str = "file_path") -> DataFrame:
    """Files with at least two signs (not lines) of an object that wraps another: (key, start_line, end_line, signs, confidence)."""
    hits = reduce(lambda a, b: a + b, [_finds(F.col("raw"), r).cast("int") for r in _WRAPPED])
    return line_table.withColumn("__n", hits).where("__n > 0").groupBy(key).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sum("__n").alias("signs")).where("signs >= 2").withColumn("confidence", F.lit(0.7))


def detect_patterns(files: DataFrame, entities: DataFrame | None = None, key: str = "file_path", text: str = "text") -> DataFrame:
    """(key, pattern, type, severity, start_line, end_line, entity, code, confidence): the line patterns of files and the structural ones of their entities.

    entities(key, id, name, type, start_line, end_line, methods, parameters) as for structural_patterns.
    """
    found = regex_patterns(lines(files, key, text), key).select(key, "pattern", "type", "severity", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(None).cast("string").alias("entity"), "code", "confidence")
    if entities is None:
        return found
    rules = structural_patterns(entities).join(entities.select("id", key, "name", "start_line", "end_line"), "id")
    severity = F.when(F.col("pattern") == "long_parameter_list", "INFO").otherwise("WARNING")
    return found.unionByName(rules.select(key, "pattern", F.lit("CODE_SMELL").alias("type"), severity.alias("severity"), "start_line", "end_line", F.col("name").alias("entity"), F.lit(None).cast("string").alias("code"), "confidence"))


def pattern_findings(matches: DataFrame) -> DataFrame:
    """The matches that are findings: anti-patterns and code smells."""
    return matches.where(F.col("type").isin("ANTI_PATTERN", "CODE_SMELL"))


def filter_findings(findings: DataFrame, severity: str | None = None, file_path: str | None = None, category: str | None = None) -> DataFrame:
    """The findings of one severity, file and category; None: of any."""
    return reduce(lambda df, kv: df if kv[1] is None else df.where(F.col(kv[0]) == kv[1]), {"severity": severity, "file_path": file_path, "category": category}.items(), findings)


def _counts(df: DataFrame, column: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(column, "n")))  # one for each severity or category
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(pairs).alias(column))


def summary(files: DataFrame, metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: total_files of files, total_entities of metrics, total_findings, findings by severity and category as maps, and means.

    metrics are rows of entity_metrics(); findings have severity and category. The means are 0 without entities.
    """
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("cyclomatic", "avg_complexity"), ("coupling_score", "avg_coupling"), ("cohesion_score", "avg_cohesion"))]
    out = files.agg(F.count(F.lit(1)).alias("total_files")).crossJoin(metrics.agg(F.count(F.lit(1)).alias("total_entities"), *means))
    out = out.crossJoin(findings.agg(F.count(F.lit(1)).alias("total_findings")))
    return out.crossJoin(_counts(findings, "severity").withColumnRenamed("severity", "by_severity")).crossJoin(_counts(findings, "category").withColumnRenamed("category", "by_category"))  # single rows


def complexity_metrics(files: DataFrame, key: str = "file_path", text: str = "text") -> DataFrame:
    """(key, cyclomatic, cognitive, nesting_depth, lines_of_code, comment_lines, blank_lines) of each text; the key must be unique."""
    table = lines(files, key, text)
    flat = files.select(key, cyclomatic(F.col(text)).alias("cyclomatic"), nesting_depth(F.col(text)).alias("nesting_depth"))
    counted = line_counts(table, key).withColumnRenamed("code_lines", "lines_of_code")
    return flat.join(cognitive(table, key), key, "left").join(counted, key, "left").select(key, "cyclomatic", "cognitive", "nesting_depth", "lines_of_code", "comment_lines", "blank_lines")


def entity_metrics(entities: DataFrame, dependencies: DataFrame | None = None, text: str = "source_code") -> DataFrame:
    """complexity_metrics() of entities(id, name, type, file_path, start_line, end_line, parameters, source_code) with coupling.

    dependencies(src, dst) are edges between ids; coupling_score is the instability, 0 without any edge. Edges that repeat count each.
    """
    own = entities.select("id", "name", "type", "file_path", "start_line", "end_line", "parameters")
    out = own.join(complexity_metrics(entities.select("id", text), "id", text).drop("comment_lines", "blank_lines"), "id")
    if dependencies is None:
        return out.withColumns({"coupling_score": F.lit(0.0), "dependency_count": F.lit(0).cast("bigint"), "dependent_count": F.lit(0).cast("bigint"), "cohesion_score": F.lit(1.0)})
    of = coupling(dependencies).select("id", F.col("instability").alias("coupling_score"), F.col("efferent").alias("dependency_count"), F.col("afferent").alias("dependent_count"))
    return out.join(of, "id", "left").na.fill(0, ["coupling_score", "dependency_count", "dependent_count"]).withColumn("cohesion_score", F.lit(1.0))


def file_metrics(files: DataFrame, entities: DataFrame, key: str = "file_path", text: str = "text") -> DataFrame:
    """(key, lines_of_code, lines_of_comments, blank_lines, entity_count, avg_complexity, max_complexity, import_count, export_count).

    entities(key, cyclomatic) are the measured entities of the files; exports aren't analysed, so their count is 0.
    """
    rolled = entities.groupBy(key).agg(F.count(F.lit(1)).alias("entity_count"), F.avg("cyclomatic").alias("avg_complexity"), F.max("cyclomatic").alias("max_complexity"))
    counted = line_counts(lines(files, key, text), key).select(key, F.col("code_lines").alias("lines_of_code"), F.col("comment_lines").alias("lines_of_comments"), "blank_lines")
    out = files.select(key, import_count(F.col(text)).alias("import_count")).join(counted, key).join(rolled, key, "left").na.fill(0, ["entity_count", "avg_complexity", "max_complexity"])
    return out.withColumn("export_count", F.lit(0)).select(key, "lines_of_code", "lines_of_comments", "blank_lines", "entity_count", "avg_complexity", "max_complexity", "import_count", "export_count")


def complexity_histogram(metrics: DataFrame) -> DataFrame:
    """(bucket, functions) of metrics(cyclomatic): 1-5, 6-10, 11-20, >20."""
    c = F.col("cyclomatic")
    bucket = F.when(c <= 5, "1-5").when(c <= 10, "6-10").when(c <= 20, "11-20").otherwise(">20")
    return metrics.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("functions"))
