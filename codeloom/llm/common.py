"""What the operators of this subpackage share: the shared folder, batching and hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one numpy pass handles at once; bounds a Python worker's memory.
PASS_CHARS = 1_500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local master; elsewhere an error."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="codeloom-")
    sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that materialize() wrote and that nothing will read again."""
    remove(df.sparkSession, df._written_to)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, take no part."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 * PASS_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, what a worker holds as Python objects at once: few rows, and about `size` bytes of text or binary values.

    A row with a longer value is a batch of its own.
    """
    for b in batches:
        total = np.zeros(b.num_rows + 1, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                total[1:] += np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, min(at + rows, int(np.searchsorted(total, total[at] + size, "right")) - 1))
            yield b.slice(at, end - at)
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finalizer of splitmix64)."""
    x = x ^ (x >> _S30)
    x = x * _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def word_hashes(texts: pa.Array, keys: tuple[str, ...] = ("0123456789123456",)) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each key the 64-bit hashes of all words of all texts, where each text's words begin and the last one's end).

    Words are what white space separates. Hashes are the same in every process; each distinct word is hashed once.
    """
    cut = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    flat, ends = cut.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))])
    there = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    coded = flat.filter(there).dictionary_encode()
    words = np.empty(len(coded.dictionary), dtype=object)
    words[:] = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy()
    return [pd.util.hash_array(words, hash_key=k, categorize=False)[which] if len(words) else np.empty(0, np.uint64) for k in keys], kept[ends].astype(np.int64)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """((ord, text) of the different documents, their names).

    A document is an id with a text: rows equal in both are one document, rows that share only the id are different ones. ord ascends with
    (doc_id, md5 of the text). Where no id recurs ord is the id and there are no names; else names are (ord, doc_id, content), content being
    that md5. Rows with a NULL id or text are left out. Looking for recurring ids shuffles ids alone; numbering is a distributed sort of
    (id, md5), so that not even an id that a third of all rows share meets in one task.
    """
    plain = documents(docs, id_col, text_col).where("doc_id is not null and text is not null")
    if plain.groupBy("doc_id").count().where("count > 1").isEmpty():
        return plain.select(F.col("doc_id").alias("ord"), "text"), None
    keyed = plain.withColumn("content", F.md5(F.col("text").cast("binary")))
    names = materialize(keyed.select("doc_id", "content").distinct().orderBy("doc_id", "content").select(F.monotonically_increasing_id().alias("ord"), "doc_id", "content"), "names")
    return keyed.join(names, ["doc_id", "content"]).select("ord", "text").dropDuplicates(["ord"]), names


def named(df: DataFrame, names: DataFrame | None, ord_col: str = "ord") -> DataFrame:
    """df with doc_id and content (NULL where no id recurs) in place of ord_col."""
    rest = [F.col(c) for c in df.columns if c != ord_col]
    if names is None:
        return df.select(F.col(ord_col).alias("doc_id"), F.lit(None).cast("string").alias("content"), *rest)
    return df.join(names.withColumnRenamed("ord", ord_col), ord_col).select("doc_id", "content", *rest)


def local_path(uri: str) -> str | None:
    """The path of a file URI, None for another scheme."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith(os.sep) else None
