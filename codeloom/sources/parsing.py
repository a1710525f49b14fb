"""Python sources to typed entities: the standard library's parser inside one Arrow pass; no shuffle."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PARAMETER = "struct<name:string,type_annotation:string,default_value:string,is_variadic:boolean,is_keyword:boolean>"
ATTRIBUTE = "struct<name:string,type_annotation:string,default_value:string,line:int>"
ENTITY = (
    "file_path string, id string, name string, type string, parent_id string, ordinal int, start_line int, end_line int, source_code string, docstring string, is_async boolean, "
    f"parameters array<{PARAMETER}>, return_type string, decorators array<string>, bases array<string>, calls array<string>, attributes array<{ATTRIBUTE}>, type_annotation string, is_constant boolean, "
    "is_classmethod boolean, is_staticmethod boolean, is_property boolean, import_names array<string>, error string"
)
_COLUMNS = [c.split()[0] for c in ENTITY.replace(PARAMETER, "p").replace(ATTRIBUTE, "a").split(", ")]

#: What a worker holds of the entities at once, whatever the size of a batch of sources.
PASS_ROWS, PASS_CHARS = 500, 2_000_000


def _text(node) -> str | None:
    return None if node is None else ast.unparse(node)


def _dotted(node) -> str | None:
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return node.id if isinstance(node, ast.Name) else None


def _parameters(a: ast.arguments) -> list[dict]:
    def one(p: ast.arg, default=None, variadic=False, keyword=False) -> dict:
        return {"name": p.arg, "type_annotation": _text(p.annotation), "default_value": _text(default), "is_variadic": variadic, "is_keyword": keyword}

    plain = [*a.posonlyargs, *a.args]
    out = [one(p, d) for p, d in zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults, strict=True)]
    if a.vararg:
        out.append(one(a.vararg, None, True))
    out += [one(p, d) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        out.append(one(a.kwarg, None, False, True))
    return out


def _calls(node) -> list[str]:
    found = sorted(((n.lineno, n.col_offset, name) for n in ast.walk(node) if isinstance(n, ast.Call) and (name := _dotted(n.func))), key=lambda x: x[:2])
    return list(dict.fromkeys(x[2] for x in found))


def parse_source(path: str | None, source: str) -> list[dict]:
    """All entities of the source in order; a source that can't be parsed gives its module alone, with the error. Without a path the module has no name."""

    def row(name, kind, node=None, parent=None, **more) -> dict:
        start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) if node is not None else 1
        out = dict.fromkeys(_COLUMNS) | {"file_path": path, "id": f"{path or ''}:{name or ''}:{node.lineno if node is not None else 1}", "name": name, "type": kind, "parent_id": parent, "ordinal": len(rows), "start_line": node.lineno if node is not None else 1, "end_line": node.end_lineno if node is not None else max(1, len(lines))}
        if node is not None:
            out["source_code"] = "\n".join(lines[start - 1 : node.end_lineno])
        rows.append(out | more)
        return rows[-1]

    rows: list[dict] = []
    lines = source.split("\n")
    module = row(None if path is None else path.rsplit("/", 1)[-1].removesuffix(".py"), "module")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        module["error"] = f"Syntax error at line {getattr(e, 'lineno', None) or 0}, column {getattr(e, 'offset', None) or 0}"
        return rows
    module["docstring"] = ast.get_docstring(tree)

    def function(node, kind: str, parent: str) -> None:
        names = [x for d in node.decorator_list if (x := _dotted(d))]
        low = [x.lower() for x in names]
        row(node.name, kind, node, parent, docstring=ast.get_docstring(node), is_async=isinstance(node, ast.AsyncFunctionDef), parameters=_parameters(node.args), return_type=_text(node.returns), decorators=names, calls=_calls(node), is_classmethod="classmethod" in low, is_staticmethod="staticmethod" in low, is_property="property" in low or any(x.endswith((".setter", ".getter", ".deleter")) for x in low))

    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            base = "." * node.level + (node.module or "") if isinstance(node, ast.ImportFrom) else None
            names = [n.name + (f" as {n.asname}" if n.asname else "") for n in node.names]
            row(base if base is not None else names[0], "import", node, module["id"], import_names=names)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, "function", module["id"])
        elif isinstance(node, ast.ClassDef):
            attributes = []
            for x in node.body:
                if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                    attributes.append({"name": x.target.id, "type_annotation": _text(x.annotation), "default_value": _text(x.value), "line": x.lineno})
                elif isinstance(x, ast.Assign):
                    attributes += [{"name": t.id, "type_annotation": None, "default_value": _text(x.value), "line": x.lineno} for t in x.targets if isinstance(t, ast.Name)]
            own = row(node.name, "class", node, module["id"], docstring=ast.get_docstring(node), bases=[_text(b) for b in node.bases], decorators=[x for d in node.decorator_list if (x := _dotted(d))], attributes=attributes)
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(x, "method", own["id"])
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name):
                    row(t.id, "variable", node, module["id"], type_annotation=_text(getattr(node, "annotation", None)), is_constant=t.id.isupper())
    return rows


def entity_batches(batches, schema: pa.Schema, most_rows: int = PASS_ROWS, most_chars: int = PASS_CHARS):
    """Batches of entities of batches(path, text). One text at a time becomes a Python object; a batch ends with that many rows or characters of source."""
    rows, held = [], 0
    for b in batches:
        for p, t in zip(b.column("path"), b.column("text"), strict=True):
            for r in parse_source(p.as_py(), t.as_py() or ""):
                rows.append(r)
                held += len(r["source_code"] or "")
                if len(rows) >= most_rows or held >= most_chars:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def parse(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Entities of files(path, text); a NULL text is an empty module, and a source without a path stays in."""
    schema = to_arrow_schema(StructType.fromDDL(ENTITY))
    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(lambda batches: entity_batches(batches, schema), ENTITY)


def structure_edges(entities: DataFrame) -> DataFrame:
    """DEFINES from a file to its functions, classes and variables; HAS_METHOD from a class to its methods."""
    defines = entities.where(F.col("type").isin("function", "class", "variable") & F.col("file_path").isNotNull()).select(F.concat("file_path", F.lit(":file")).alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("type"))
    return defines.unionByName(entities.where("type = 'method'").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_METHOD").alias("type")))


def inheritance_edges(entities: DataFrame) -> DataFrame:
    """INHERITS to the class of that name in the same file."""
    classes = entities.where("type = 'class'")
    return classes.select(F.col("id").alias("src"), "file_path", F.explode("bases").alias("name")).join(classes.select(F.col("id").alias("dst"), "file_path", "name"), ["file_path", "name"]).select("src", "dst", F.lit("INHERITS").alias("type"))


def measured(entities: DataFrame) -> DataFrame:
    """(file_path, id, name, type, start_line, end_line, methods, parameters, source_code) of functions, methods and classes; counts, not lists."""
    methods = entities.where("type = 'method'").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("methods"))
    found = entities.where(F.col("type").isin("function", "method", "class")).join(methods, "id", "left")
    return found.select("file_path", "id", "name", "type", "start_line", "end_line", F.coalesce("methods", F.lit(0)).alias("methods"), F.coalesce(F.array_size("parameters"), F.lit(0)).alias("parameters"), "source_code")


def entity_counts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file_path, entities) of each source as the ingestion counts them: rows of the flattened table and each class's attributes.

    Sources that share a path are counted apart; no shuffle.
    """

    def run(batches):
        for b in batches:
            counts = [sum(1 + len(r["attributes"] or []) for r in parse_source(p.as_py(), t.as_py() or "")) for p, t in zip(b.column("file_path"), b.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_path"), pa.array(counts, pa.int64())], names=["file_path", "entities"])

    return files.select(F.col(path).alias("file_path"), F.col(text).alias("text")).mapInArrow(run, "file_path string, entities bigint")
