"""Names, identifiers and small list helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = {"repository": "Repository", "file": "File", "module": "Module", "class": "Class", "function": "Function", "method": "Method", "variable": "Variable"}


def entity_id(path: Column, name: Column, line: Column | None = None, kind: Column | None = None) -> Column:
    """path:name:line, path:kind:name or path:name."""
    parts = [path, kind, name] if kind is not None else [path, name]
    return F.concat_ws(":", *parts, *([] if line is None else [line.cast("string")]))


def escape(text: Column) -> Column:
    """Backslash before backslashes, then before single and double quotes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("'"), F.lit("\\'")), F.lit('"'), F.lit('\\"'))


def identifier(text: Column) -> Column:
    """Only [A-Za-z0-9_]; a leading digit gets a `_` before it."""
    clean = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def is_constant(name: Column) -> Column:
    return (F.upper(name) == name) & name.rlike(r"\p{Lu}")


def label(kind: Column) -> Column:
    """The node label of an entity type; imports and unknown types have none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.lower(kind))


def preview(text: Column, length: int) -> Column:
    return F.when(F.char_length(text) > length, F.concat(F.left(text, F.lit(length - 3)), F.lit("..."))).otherwise(text)


def batches(rows: DataFrame, order: str, size: int, within: list[str] | None = None) -> DataFrame:
    """rows with the number of their batch: `size` rows each in that order, within each group."""
    rank = F.row_number().over(Window.partitionBy(*(within or [])).orderBy(order))
    return rows.withColumn("batch", F.floor((rank - 1) / size).cast("int"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
