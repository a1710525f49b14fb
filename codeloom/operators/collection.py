"""Chunk collections on disk: create, describe, upsert, delete; and indexing entities into them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.questions import tokens
from codeloom.operators import store
from codeloom.operators import vectors as V
from codeloom.sources.tables import cut

SCHEMA = "chunk_id string, chunk_type string, file_path string, entity_name string, entity_type string, start_line int, end_line int, language string, content string, metadata map<string,string>, embedding array<float>, repo_id string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Folders that a collection may be spread over before it is written anew.
MOST_FOLDERS = 20


class Collection:
    """Chunks as Parquet by repository. A manifest names the folder that each repository's chunks lie in, so a write touches only the repositories it is about.

    A chunk stays in its repository, whose id its own id begins with. Readers keep the folders they opened. A collection at a path where one exists
    goes on with it.
    """

    def __init__(self, spark: SparkSession, path: str, distance: str = "Cosine"):
        if distance not in V.DISTANCES:
            raise ValueError(f"no such distance: {distance}")
        self.spark, self.path, self.distance = spark, path.rstrip("/"), distance

    def _manifest(self) -> dict[str, str]:
        """Repository -> folder."""
        return json.loads(store.read_text(self.spark, f"{self.path}/manifest.json") or "{}")

    def exists(self) -> bool:
        return store.read_text(self.spark, f"{self.path}/manifest.json") is not None

    def create(self) -> None:
        """An empty collection where there is none."""
        if not self.exists():
            store.write_text(self.spark, f"{self.path}/manifest.json", "{}")

    def drop(self) -> None:
        store.remove(self.spark, self.path)

    def recreate(self) -> None:
        self.drop()
        self.create()

    def read(self) -> DataFrame:
        return self._read(self._manifest())

    def _read(self, manifest: dict[str, str]) -> DataFrame:
        folders: dict[str, list[str]] = {}
        for repo, at in manifest.items():
            folders.setdefault(at, []).append(repo)
        out = self.spark.createDataFrame([], SCHEMA)
        for at, repos in folders.items():
            out = out.unionByName(self.spark.read.schema(SCHEMA).parquet(at).where(F.col("repo_id").isin(repos)).select(*_COLUMNS))
        return out

    def _write(self, manifest: dict[str, str], repos: list[str], rows: DataFrame) -> None:
        """rows are all chunks of those repositories."""
        at = f"{self.path}/v-{uuid.uuid4().hex}"
        rows.select(*_COLUMNS).write.partitionBy("repo_id").parquet(at)
        manifest = manifest | dict.fromkeys(repos, at)
        if len(set(manifest.values())) > MOST_FOLDERS:
            whole = f"{self.path}/v-{uuid.uuid4().hex}"
            self._read(manifest).write.partitionBy("repo_id").parquet(whole)
            manifest = dict.fromkeys(manifest, whole)
        store.write_text(self.spark, f"{self.path}/manifest.json", json.dumps(manifest))

    def upsert(self, batch: DataFrame) -> None:
        """Of rows of the batch with one chunk_id one counts, the greatest."""
        manifest = self._manifest()
        repos = [r["repo_id"] for r in batch.select("repo_id").distinct().collect()]  # one row for each repository of the batch
        old = self._read({r: at for r, at in manifest.items() if r in repos})
        self._write(manifest, repos, V.upsert_chunks(old, batch.select(*_COLUMNS)))

    def delete(self, **filters) -> int:
        """Deletes what matches all filters and tells how many chunks that were."""
        manifest = self._manifest()
        gone = V.filtered(self._read(manifest), **filters).groupBy("repo_id").count().collect()  # one row for each repository
        repos = [r["repo_id"] for r in gone]
        if repos:
            self._write(manifest, repos, V.delete_chunks(self._read({r: manifest[r] for r in repos}), **filters)[0])
        return sum(r["count"] for r in gone)

    def search(self, query: DataFrame, limit: int = 10, threshold: float | None = 0.5, **filters) -> DataFrame:
        return V.search(self.read(), query, limit, threshold, self.distance, **filters)

    def info(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("points"), F.max(F.size("embedding")).alias("dimension")).withColumn("distance", F.lit(self.distance))


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float] | None]], size: int = 128, retries: int = 2, wait: float = 0.5) -> DataFrame:
    """chunks with `embedding` from the model, called with up to `size` texts, and `tokens`, an estimate of what each text costs.

    A call that fails is repeated, after wait, then twice as long and so on; after `retries` repetitions the batch's embeddings are NULL. So are those
    that the model gives none for.
    """

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(texts), size):
            part = texts.iloc[i : i + size].tolist()
            for attempt in range(retries + 1):
                try:
                    out += model(part)
                    break
                except Exception:  # whatever a service throws; the whole batch counts as failed in the end
                    if attempt == retries:
                        out += [None] * len(part)
                    else:
                        time.sleep(wait * 2**attempt)
        return pd.Series(out, index=texts.index)

    return chunks.withColumn("embedding", run("content")).withColumn("tokens", tokens(F.col("content")))


def index(entities: DataFrame, collection: Collection, model: Callable) -> dict:
    """Chunks of the entities (see chunk_entities), embedded and upserted: how many, which failed, and the tokens that the rest cost."""
    made = cut(embed(V.chunk_entities(entities), model), "embedded")
    collection.upsert(made.where("embedding is not null"))
    done = made.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("done"), F.coalesce(F.sum(F.when(F.col("embedding").isNotNull(), F.col("tokens"))), F.lit(0)).alias("tokens")).first()
    return {"indexed": done["done"], "failed": done["n"] - done["done"], "tokens": int(done["tokens"]), "failures": made.where("embedding is null").select("chunk_id")}
