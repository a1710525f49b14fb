"""A graph on disk: nodes and edges as Parquet in versions, of which a pointer names the one that counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file: readers find the old content or the new one."""
    new, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if "://" in path or path.startswith("file:") else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """None without such a file."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


class Transaction:
    """The graph as it will be; nothing of it can be seen before the end of the block."""

    def __init__(self, nodes: DataFrame | None, edges: DataFrame | None):
        self.nodes, self.edges = nodes, edges


class GraphStore:
    """nodes(id, label, ...) by label and edges(src, dst, type, ...) by type under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> str | None:
        return read_text(self.spark, f"{self.path}/current")

    def exists(self) -> bool:
        return self.version() is not None

    def open(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the version that counts now; readers keep it whatever is saved later."""
        if (at := self.version()) is None:
            raise FileNotFoundError(f"no graph at {self.path}")
        return self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/edges")

    def save(self, nodes: DataFrame, edges: DataFrame) -> None:
        """A new version, which counts once both tables are written."""
        at = f"{self.path}/v-{uuid.uuid4().hex}"
        nodes.write.partitionBy("label").parquet(f"{at}/nodes")
        edges.write.partitionBy("type").parquet(f"{at}/edges")
        write_text(self.spark, f"{self.path}/current", at)

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """All changes to `nodes` and `edges` inside the block are saved together; an error saves none."""
        now = Transaction(*(self.open() if self.exists() else (None, None)))
        yield now
        self.save(now.nodes, now.edges)

    def drop(self) -> None:
        remove(self.spark, self.path)
