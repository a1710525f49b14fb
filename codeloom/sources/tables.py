"""Tables: reading, and the shared folder that ends a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset, a temporary folder on a local master; elsewhere an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back: later steps start there, also after the loss of an executor."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: str, column: str) -> DataFrame:
    """df with `column`, the rows' numbers from 0 by `order`: a distributed sort, and only the partitions' sizes are added up in one place."""
    rows = cut(df.orderBy(order).withColumn("__m", F.monotonically_increasing_id()), "ordered").withColumn("__p", F.shiftright("__m", 33))
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return rows.join(sizes.select("__p", before.alias("__before")), "__p").withColumn(column, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__m", "__before")
