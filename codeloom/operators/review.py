"""Diff review: hunks, line numbers, rules on added lines, and the verdict on a pull request."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def _rules():
    """(category, severity, expression, message): checked on added lines, in any case."""
    call, quotes = r"\s*+[(]", "['\"]"
    for name in ("eval", "exec"):
        yield "security", "ERROR", rf"\b{name}{call}", f"Avoid using {name}() - security risk"
    for name, what in (("password", "password"), ("api_key", "API key")):
        yield "security", "ERROR", rf"{name}\s*+=\s*+{quotes}[^'\"]++{quotes}", f"Hardcoded {what} detected"
    yield "security", "ERROR", "[.]execute[(][^)]*%", "Possible SQL injection vulnerability"
    for word, what in (("TODO", "consider addressing"), ("FIXME", "needs attention"), ("HACK", "technical debt")):
        yield "todo", "INFO", rf"#\s*+{word}", f"{word} comment - {what}"
    for expression, what in ((f"print{call}", "print statement"), (f"console[.]log{call}", "console.log")):
        yield "debug", "INFO", expression, f"Debug {what} left in code"
    yield "debug", "INFO", "debugger", "Debugger statement left in code"
    yield "exception", "WARNING", r"except\s*+:", "Bare except clause - catch specific exceptions"
    yield "empty", "WARNING", r"pass\s*+$", "Empty pass block - consider implementation or removal"
    yield "import", "WARNING", "from .+ import [*]", "Wildcard import - import specific names instead"


RULES = list(_rules())
_ENDINGS = "py=python js=javascript jsx=javascript ts=typescript tsx=typescript java=java go=go rs=rust rb=ruby php=php cpp=cpp c=c cs=csharp"
_LANGUAGES = [("." + x.split("=")[0], x.split("=")[1]) for x in _ENDINGS.split()]
_HEADER = r"^@@ -(\d++)(?:[,](\d++))?+ [+](\d++)(?:[,](\d++))?+ @@"
_PLACED = ["position", "raw", "hunk", "kind", "new_line"]


#: Lines that a worker holds at once, whatever the size of a batch of patches.
PASS_LINES = 10_000


def placed_lines(batches, most: int = PASS_LINES):
    """Batches of at most so many lines of batches(keys, patch): see diff_lines()."""
    types = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32())
    for b in batches:
        keys = b.schema.names[:-1]

        def batch(of, rows):
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([b.column(k).take(pa.array(of, pa.int64())) for k in keys] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*keys, *_PLACED])  # noqa: B023

        of, rows = [], []
        for i, patch in enumerate(b.column(len(keys))):
            hunk = line = 0
            for position, raw in enumerate((patch.as_py() or "").split("\n")):
                if header := re.match(_HEADER, raw, re.ASCII):
                    hunk, line = hunk + 1, int(header[3])
                elif hunk:
                    removed = raw.startswith("-")
                    of.append(i)
                    rows.append((position, raw, hunk, "remove" if removed else "add" if raw.startswith("+") else "context", None if removed else line))
                    line += not removed
                    if len(rows) >= most:
                        yield batch(of, rows)
                        of, rows = [], []
        yield batch(of, rows)


def diff_lines(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, position, raw, hunk, kind, new_line): lines after a header, by hunk; those before the first one go.

    new_line counts from the hunk's new start over lines that aren't removed; removed lines have none. One pass over each patch by itself, no
    shuffle: a task holds some lines, however many patches there are.
    """
    plain = patches.select(*keys, F.col(patch).cast("string").alias("__patch"))
    schema = StructType([*[StructField(f.name, f.dataType) for f in plain.schema.fields[:-1]], *StructType.fromDDL("position int, raw string, hunk bigint, kind string, new_line int").fields])
    return plain.mapInArrow(placed_lines, schema)


def hunks(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, hunk, old_start, old_count, new_start, new_count): an absent count is 1."""
    rows = patches.select(*keys, F.posexplode(F.split(patch, "\n")).alias("position", "raw")).where(F.col("raw").rlike(_HEADER))

    def number(i: int) -> Column:
        text = F.regexp_extract("raw", _HEADER, i)
        return F.when(text == "", 1).otherwise(text.cast("int"))

    return rows.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("position")).alias("hunk"), number(1).alias("old_start"), number(2).alias("old_count"), number(3).alias("new_start"), number(4).alias("new_count"))


def comments(line_table: DataFrame, keys: list[str], rules: list = RULES) -> DataFrame:
    """(keys, new_line, category, severity, body): one row for each rule that an added line breaks."""
    text = F.substr("raw", F.lit(2))
    hits = [F.when(text.rlike("(?Uid)" + rx), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(f"**{c.upper()}**: {m}").alias("body"))) for c, s, rx, m in rules]
    return line_table.where("kind = 'add'").select(*keys, "new_line", F.inline(F.array_compact(F.array(*hits))))


def reviewable(patches: DataFrame, name: str = "file", patch: str = "patch") -> DataFrame:
    """Patches of files in a known language; binary files have none."""
    return patches.where(F.coalesce(F.col(patch), F.lit("")) != "").where(language_of(F.col(name)).isNotNull())


def verdict(found: DataFrame, line_table: DataFrame, key: str, file_key: str) -> DataFrame:
    """One row for each pull request: lines, files, comments by severity, issues_found, suggestions, summary, and REQUEST_CHANGES with an error or over 3 warnings."""

    def count(when: Column, name: str) -> Column:
        return F.coalesce(F.sum(when.cast("bigint")), F.lit(0)).alias(name)

    changed = line_table.groupBy(key).agg(count(F.col("kind") == "add", "additions"), count(F.col("kind") == "remove", "deletions"), F.count_distinct(file_key).alias("files"))
    rated = found.groupBy(key).agg(*[count(F.col("severity") == s, n) for s, n in (("ERROR", "errors"), ("WARNING", "warnings"), ("INFO", "infos"), ("SUGGESTION", "suggestions"))])
    out = changed.join(rated, key, "left").na.fill(0, ["errors", "warnings", "infos", "suggestions"])
    out = out.withColumn("issues_found", F.col("errors") + F.col("warnings"))
    out = out.withColumn("status", F.when((F.col("errors") > 0) | (F.col("warnings") > 3), "REQUEST_CHANGES").otherwise("COMMENT"))
    said = [F.when(F.col(n) > 0, F.concat(F.lit("\n- "), F.col(n).cast("string"), F.lit(what))).otherwise("") for n, what in (("errors", " error(s) found"), ("warnings", " warning(s) found"), ("infos", " informational note(s)"))]
    clean = F.when(F.col("errors") + F.col("warnings") + F.col("infos") + F.col("suggestions") == 0, "\nNo issues found. Good job!").otherwise("")
    text = [F.lit("## Review Summary\n\n**Files analyzed:** "), F.col("files").cast("string"), F.lit("\n**Changes:** +"), F.col("additions").cast("string"), F.lit(" / -"), F.col("deletions").cast("string"), F.lit("\n")]
    return out.withColumn("summary", F.concat(*text, *said, clean))


def language_of(file: Column) -> Column:
    return F.coalesce(*[F.when(file.endswith(s), F.lit(x)) for s, x in _LANGUAGES])
