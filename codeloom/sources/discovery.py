"""Files: discovery, ignore rules, languages, hashes, snapshots and what changed between them."""

from __future__ import annotations

import hashlib
import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import cut

_SUFFIXES = (
    "python=py pyi; javascript=js jsx mjs; typescript=ts tsx; java=java; go=go; rust=rs; c=c h; cpp=cpp hpp cc; csharp=cs; ruby=rb; php=php; swift=swift; "
    "kotlin=kt; scala=scala; r=r; lua=lua; bash=sh; sql=sql; html=html; css=css; json=json; yaml=yaml yml"
)
LANGUAGES = {f".{suffix}": name for name, suffixes in (x.split("=") for x in _SUFFIXES.split("; ")) for suffix in suffixes.split()}
_FOLDERS = "node_modules .git venv __pycache__ dist build .tox .pytest_cache .mypy_cache coverage"
EXCLUDES = [f"**/{folder}/**" for folder in _FOLDERS.split()] + [f"**/*.{end}" for end in ("min.js", "min.css", "map")]


def _glob(pattern: str) -> str:
    """A shell glob as a regular expression over the whole string; `*` crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Any glob fits the path; `**/x` fits also where x fits the path or the file name."""
    hits = []
    for g in globs:
        hits.append(path.rlike(_glob(g.replace("**", "*"))))
        if g.startswith("**/"):
            rest = g[3:].replace("**", "*")
            hits += [path.rlike(_glob(rest)), file_name(path).rlike(_glob(rest)), path.rlike(_glob("*/" + rest))]
    return _any(hits)


def _fits(rx: str):
    return lambda part: part.rlike(rx)


def ignored(path: Column, rules: list[str]) -> Column:
    """A line of the root's ignore file fits the path. Negations and comments are skipped."""
    hits = []
    for r in (x.strip() for x in rules):
        if not r or r[0] in "#!":
            continue
        if r.endswith("/"):
            rx = _glob(r.rstrip("/").lstrip("/"))
            hits.append(F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), _fits(rx)))
        elif "/" in r:
            hits += [path.rlike(_glob(r.lstrip("/"))), path.rlike(_glob("*/" + r.lstrip("/")))] if not r.startswith("/") else [path.rlike(_glob(r[1:]))]
        else:
            hits.append(F.exists(F.split(path, "/"), _fits(_glob(r))))
    return _any(hits)


def language(path: Column) -> Column:
    """By the lower-cased last suffix; NULL for unknown ones and for dot files without a suffix."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)


def with_extension(path: Column, extensions: list[str]) -> Column:
    return _any([path.endswith(e if e.startswith(".") else "." + e) for e in extensions])


def select_files(files: DataFrame, ignore: list[str] = (), includes: list[str] = ("**/*",), excludes: list[str] = EXCLUDES, max_kb: int = 500, languages: list[str] | None = None) -> DataFrame:
    """files(path, size, ...) that pass all filters, with their language."""
    path = F.col("path")
    kept = files.where(~ignored(path, list(ignore)) & ~matches_globs(path, list(excludes)) & matches_globs(path, list(includes)) & (F.col("size") <= max_kb * 1024))
    kept = kept.withColumn("language", language(path)).where("language is not null")
    return kept if languages is None else kept.where(F.lower("language").isin([x.lower() for x in languages]))


_FOUND = "path string, size bigint, modified timestamp, is_folder boolean"


def _absolute(root: str) -> str:
    return root.rstrip("/") if "://" in root or root.startswith("file:") else os.path.abspath(root)


def _stored(root: str):
    """(file system, the root's path there)"""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def _listed(batches, root: str):
    """What lies in the folders, relative to the root. Folders that can't be read are left out."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    fs, base = _stored(root)
    for b in batches:
        rows = []
        for folder in b.column("path").to_pylist():
            try:
                found = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
            except OSError:
                continue
            rows += [(f"{folder}/{i.base_name}".lstrip("/"), i.size, i.mtime, i.type == pafs.FileType.Directory) for i in found]
        types = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names=["path", "size", "modified", "is_folder"])


def list_files(spark: SparkSession, root: str, excludes: list[str] = EXCLUDES) -> DataFrame:
    """(path relative to the root, size, modified) of all files under it, also those whose names begin with `_` or a dot.

    Executors list the folders of one level after the other; excluded folders aren't entered. A root that is missing or no folder has no files.
    """
    root = _absolute(root)
    level = spark.createDataFrame([("",)], "path string")
    files = spark.createDataFrame([], _FOUND)
    while True:
        found = cut(level.mapInArrow(lambda batches: _listed(batches, root), _FOUND), "listing")
        files = files.unionByName(found.where("not is_folder"))
        level = found.where(F.col("is_folder") & ~matches_globs(F.concat("path", F.lit("/x")), list(excludes))).select("path")
        if level.isEmpty():
            return files.drop("is_folder")
        level = level.repartition(spark.sparkContext.defaultParallelism)


def _with_content(files: DataFrame, root: str) -> DataFrame:
    """files with content and its sha256; those that can't be read are left out."""
    root = _absolute(root)

    def run(batches):
        import pyarrow as pa

        fs, base = _stored(root)
        for b in batches:
            for i, path in enumerate(b.column("path").to_pylist()):
                try:
                    with fs.open_input_stream(f"{base}/{path}") as f:
                        content = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("path", "size", "modified", "language")), pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content], pa.binary())], names=["path", "size", "modified", "language", "hash", "content"])

    return files.select("path", "size", "modified", "language").mapInArrow(run, "path string, size bigint, modified timestamp, language string, hash string, content binary")


def discover(spark: SparkSession, root: str, **filters) -> DataFrame:
    """(path relative to the root, size, modified, language, hash, content) of the source files under it; only files that pass the filters are read."""
    return _with_content(select_files(list_files(spark, root, filters.get("excludes", EXCLUDES)), **filters), root)


def file_info(spark: SparkSession, root: str, path: str, **filters) -> DataFrame:
    """The row of discover() of one file, none where it is missing, no file, or filtered out."""
    folder, _, name = path.replace("\\", "/").rpartition("/")
    root = _absolute(root)
    found = spark.createDataFrame([(folder,)], "path string").mapInArrow(lambda batches: _listed(batches, root), _FOUND)
    one = found.where((F.col("path") == "/".join(filter(None, [folder, name]))) & ~F.col("is_folder")).drop("is_folder")
    return _with_content(select_files(one, **filters), root)


def validate(spark: SparkSession, root: str, **filters) -> list[str]:
    """What is wrong with a repository's folder; nothing if it can be ingested."""
    import pyarrow.fs as pafs

    fs, base = _stored(_absolute(root))
    kind = fs.get_file_info(base).type
    if kind != pafs.FileType.Directory:
        return ["path does not exist"] if kind == pafs.FileType.NotFound else ["path is not a directory"]
    git = fs.get_file_info(f"{base}/.git").type != pafs.FileType.NotFound
    some = not select_files(list_files(spark, root), **filters).isEmpty()
    return [*([] if git else ["not a git repository"]), *([] if some else ["no file can be parsed"])]


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old_path) between snapshots(path, hash): added, modified, deleted, renamed.

    A deleted and an added path with one content are a rename; of several the least paths pair up in order.
    """
    o, n = old.select(F.col("path").alias("old_path"), F.col("hash").alias("old_hash")), new.select(F.col("path").alias("new_path"), F.col("hash").alias("new_hash"))
    both = o.join(n, F.col("old_path") == F.col("new_path"), "full_outer")
    modified = both.where("old_path is not null and new_path is not null and old_hash <> new_hash").select(F.col("new_path").alias("path"), F.lit("modified").alias("change"), F.lit(None).cast("string").alias("old_path"))

    def ranked(df: DataFrame, path: str, h: str) -> DataFrame:
        return df.withColumn("rn", F.row_number().over(Window.partitionBy(h).orderBy(path)))

    gone = ranked(both.where("new_path is null").select("old_path", "old_hash"), "old_path", "old_hash")
    come = ranked(both.where("old_path is null").select("new_path", "new_hash"), "new_path", "new_hash").withColumnRenamed("rn", "rn2")
    pairs = gone.join(come, (F.col("old_hash") == F.col("new_hash")) & (F.col("rn") == F.col("rn2")), "full_outer")
    kind = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "deleted").otherwise("renamed")
    rest = pairs.select(F.coalesce("new_path", "old_path").alias("path"), kind.alias("change"), F.when(kind == "renamed", F.col("old_path")).alias("old_path"))
    return modified.unionByName(rest)


def reindex_plan(changes: DataFrame) -> DataFrame:
    """(path, action): deleted files are removed, renamed ones removed and processed anew, others processed."""
    remove, process = (lambda p: F.struct(p.alias("path"), F.lit("remove").alias("action"))), (lambda p: F.struct(p.alias("path"), F.lit("process").alias("action")))
    steps = F.when(F.col("change") == "deleted", F.array(remove(F.col("path")))).when(F.col("change") == "renamed", F.array(remove(F.col("old_path")), process(F.col("path")))).otherwise(F.array(process(F.col("path"))))
    return changes.select(F.inline(steps))


def tree_hash(snapshot: DataFrame) -> DataFrame:
    """One row: an order-free fingerprint of snapshot(path, hash) that needs no sort of all paths in one place."""
    h = F.xxhash64("path", "hash")
    return snapshot.agg(F.count(F.lit(1)).alias("files"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(2**31))).alias("s"))


def has_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = tree_hash(old), tree_hash(new).toDF("files2", "x2", "s2")
    return a.crossJoin(b).select((~((F.col("files") == F.col("files2")) & F.col("x").eqNullSafe(F.col("x2")) & F.col("s").eqNullSafe(F.col("s2")))).alias("has_changes"))


def change_type(letter: Column) -> Column:
    return F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter.startswith("R"), "renamed").otherwise("modified")


def uncommitted(staged: DataFrame, unstaged: DataFrame, untracked: DataFrame) -> DataFrame:
    """(path, change): staged changes, unstaged ones of other paths, and all untracked files as added."""
    return staged.select("path", "change").unionByName(unstaged.join(staged.select("path"), "path", "left_anti").select("path", "change")).unionByName(untracked.select("path", F.lit("added").alias("change")))


def in_directory(changes: DataFrame, directory: str) -> DataFrame:
    prefix = directory.rstrip("/") + "/"
    return changes.where(F.col("path").startswith(prefix) | F.coalesce(F.col("old_path").startswith(prefix), F.lit(False)))


def ingestion_size(files: DataFrame) -> DataFrame:
    """(language, files, bytes): one row for each language (NULL: unknown) and `*` for all."""
    named = files.select(F.coalesce("language", F.lit("unknown")).alias("language"), "size")
    return named.rollup("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.grouping("language").alias("g")).select(F.when(F.col("g") == 1, "*").otherwise(F.col("language")).alias("language"), "files", "bytes")


def language_share(files: DataFrame, language: str = "language", lines: str = "lines") -> DataFrame:
    """(language, files, lines, percentage): how many of the files, and of their lines, each language has; percentage of the files."""
    per = files.groupBy(language).agg(F.count(F.lit(1)).alias("files"), F.sum(lines).cast("bigint").alias("lines"))
    return per.withColumn("percentage", 100.0 * F.col("files") / F.sum("files").over(Window.partitionBy()))  # one row for each language


def repo_name(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


def repo_id(name: Column, place: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", name, place), 256), 1, 16)


def success_rate(processed: Column, errors: Column) -> Column:
    return F.when(processed + errors == 0, 100.0).otherwise(processed / (processed + errors) * 100)
