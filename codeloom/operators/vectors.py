"""Vector search on chunk tables: distances, filtered top-k, batch search, index maintenance."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Payload columns a search may filter by.
FILTERS = ("repo_id", "file_path", "entity_type", "chunk_type", "language")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


#: Distance -> (score, is a greater score better).
DISTANCES = {"Cosine": (cosine, True), "Dot": (dot, True), "Euclid": (euclid, False)}


def filtered(chunks: DataFrame, **filters) -> DataFrame:
    """All filters that have a value hold."""
    unknown = set(filters) - set(FILTERS) - {"entity_name"}
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[1] else df, filters.items(), chunks)


def search(chunks: DataFrame, query: DataFrame, limit: int = 10, threshold: float | None = 0.0, distance: str = "Cosine", **filters) -> DataFrame:
    """The best `limit` chunks for the one row of query(vector), filters first; ties by chunk_id.

    Scores below the threshold go (for Euclid: above). The top-k is taken per partition before it is merged.
    """
    score, greater = DISTANCES[distance]
    scored = filtered(chunks, **filters).crossJoin(F.broadcast(query.limit(1).select(F.col("vector").alias("__q")))).withColumn("score", score(F.col("embedding"), F.col("__q"))).drop("__q")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold if greater else F.col("score") <= threshold)
    return scored.orderBy(F.desc("score") if greater else F.asc("score"), "chunk_id").limit(limit)


def similar_functions(chunks: DataFrame, chunk_id, limit: int = 10, threshold: float = 0.7, **filters) -> DataFrame:
    """The best other chunks of whole functions for one chunk."""
    query = chunks.where(F.col("chunk_id") == chunk_id).select(F.col("embedding").alias("vector"))
    return search(chunks.where(F.col("chunk_id") != chunk_id), query, limit, threshold, chunk_type="function_full", **filters)


def docstring_search(chunks: DataFrame, query: DataFrame, limit: int = 10, threshold: float = 0.5) -> DataFrame:
    """The best of the best function docstrings and the best class docstrings."""
    parts = [search(chunks, query, limit, threshold, chunk_type=t) for t in ("function_docstring", "class_docstring")]
    return parts[0].unionByName(parts[1]).orderBy(F.desc("score"), "chunk_id").limit(limit)


#: Rows of a block of batch_search, and how many of its queries are scored at once.
BLOCK_ROWS, SLICE = 8192, 256


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of doubles; all zero where a vector is null, holds a null or has another length, so that its cosine is 0."""
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    out = np.zeros((len(v), dims))
    fits = np.nonzero(pc.fill_null(pc.equal(pc.list_value_length(v), dims), False).to_numpy(zero_copy_only=False))[0]
    flat = v.take(pa.array(fits)).flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(fits), dims).any(axis=1)
    out[fits] = np.where(holes[:, None], 0.0, flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fits), dims))
    return out


def _sum(products) -> np.ndarray:
    """Added one dimension after the other, as dot() does: equal vectors get equal scores, to the last bit."""
    return reduce(lambda s, x: s + x, products, 0.0)


def _best(queries: pa.Table, chunks: pa.Table, k: int) -> pa.Table:
    """The k best of a block of chunks for each query of another block: a matrix product finds who can be among them, only those are scored exactly."""
    chunks = chunks.sort_by("chunk_id")
    rows, cols, scores = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
    sizes = pc.fill_null(pc.list_value_length(queries["vector"]), 0).to_numpy()
    for dims in np.unique(sizes) if len(chunks) else ():
        at = np.nonzero(sizes == dims)[0]
        q, c = (_matrix(x, int(dims)) for x in (queries["vector"].take(pa.array(at)), chunks["embedding"]))
        nq, nc = (np.sqrt(_sum(x[:, j] * x[:, j] for j in range(dims)) + np.zeros(len(x))) for x in (q, c))
        uq, uc = (x / np.where(n == 0, 1.0, n)[:, None] for x, n in ((q, nq), (c, nc)))
        for i in range(0, len(at), SLICE):
            near = uq[i : i + SLICE] @ uc.T
            least = np.partition(near, -k, axis=1)[:, -k][:, None] if k < len(c) else np.full((len(near), 1), -np.inf)
            r, j = np.nonzero(~(near < least - 1e-9))
            r += i
            n = nq[r] * nc[j]
            s = np.where(n == 0, 0.0, _sum(q[r, x] * c[j, x] for x in range(dims)) / np.where(n == 0, 1.0, n))
            order = np.lexsort((j, -np.where(np.isnan(s), np.inf, s), r))
            r, j, s = r[order], j[order], s[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            rows.append(at[r[first]]), cols.append(j[first]), scores.append(s[first])
    r, c = (pa.array(np.concatenate(x)) for x in (rows, cols))
    return pa.table({"query_id": queries["query_id"].take(r), "chunk_id": chunks["chunk_id"].take(c), "score": np.concatenate(scores)})


def batch_search(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks by cosine for every row of queries(query_id, vector).

    Both sides are cut into blocks that meet pairwise; each pair keeps k rows per query before the final rank.
    """
    queries, chunks = queries.select("query_id", "vector"), chunks.select("chunk_id", "embedding")
    blocks = [max(1, -(-df.count() // BLOCK_ROWS)) for df in (queries, chunks)]

    def spread(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left, right = spread(queries, "query_id", "__q", blocks[0], "__c", blocks[1]), spread(chunks, "chunk_id", "__c", blocks[1], "__q", blocks[0])
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"
    kept = left.groupBy("__q", "__c").cogroup(right.groupBy("__q", "__c")).applyInArrow(lambda q, c: _best(q, c, k), kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def upsert_chunks(chunks: DataFrame, batch: DataFrame, order: Column | None = None) -> DataFrame:
    """chunks with those of the batch in place of the ones with the same chunk_id.

    Of rows of the batch with one chunk_id the last by `order` counts, over columns of the batch that chunks may lack; without it the greatest row.
    """
    whole = [c for c in batch.columns if c != "chunk_id"]
    # maps have no order
    order = F.struct(*[c for c in whole if not isinstance(batch.schema[c].dataType, MapType)]) if order is None else order
    last = F.max_by(F.struct(*whole), order)
    new = batch.groupBy("chunk_id").agg(last.alias("__row")).select("chunk_id", "__row.*").select(*chunks.columns)
    return chunks.join(batch.select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns).unionByName(new)


def delete_chunks(chunks: DataFrame, **filters) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, one row `deleted`); NULLs don't match."""
    hit = reduce(lambda a, b: a & b, [F.coalesce(F.col(k) == v, F.lit(False)) for k, v in filters.items()])
    return chunks.where(~hit), chunks.where(hit).agg(F.count(F.lit(1)).alias("deleted"))


def chunks_of_file(chunks: DataFrame, repo_id, file_path, limit: int = 100) -> DataFrame:
    return filtered(chunks, repo_id=repo_id, file_path=file_path).orderBy("chunk_id").limit(limit)


def signature() -> Column:
    """`async def name(p: type = default) -> type` of functions and methods, `@decorator` lines and `class name(bases)` of classes; from the parser's columns."""

    def after(text: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(text), c)).otherwise("")

    one = F.transform("parameters", lambda p: F.concat(p["name"], after(": ", p["type_annotation"]), after(" = ", p["default_value"])))
    function = F.concat(F.when(F.col("is_async"), "async def ").otherwise("def "), "name", F.lit("("), F.coalesce(F.array_join(one, ", "), F.lit("")), F.lit(")"), after(" -> ", F.col("return_type")))
    bases = F.when(F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")"))).otherwise("")
    over = F.array_join(F.transform(F.coalesce("decorators", F.array()), lambda d: F.concat(F.lit("@"), d, F.lit("\n"))), "")
    return F.when(F.col("type") == "class", F.concat(over, F.lit("class "), "name", bases)).otherwise(function)


def described(entities: DataFrame, repo_id: str, language: str = "python") -> DataFrame:
    """Parsed entities as chunk_entities() takes them: with repository, owner, signature and metadata."""
    owner = entities.where("type = 'class'").select(F.col("id").alias("parent_id"), F.col("name").alias("owner"))
    names = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    known = F.when(F.col("type") == "class", F.create_map(F.lit("bases"), names(F.col("bases")), F.lit("decorators"), names(F.col("decorators")))).otherwise(
        F.create_map(F.lit("class_name"), F.col("owner"), F.lit("is_async"), F.col("is_async").cast("string"), F.lit("parameters"), names(F.transform("parameters", lambda p: p["name"])), F.lit("return_type"), F.col("return_type"))
    )
    out = entities.where(F.col("type").isin("function", "class", "method")).join(owner, "parent_id", "left").withColumn("signature", signature())
    out = out.withColumn("signature", F.when(F.col("type") == "method", F.concat_ws(".", "owner", "signature")).otherwise(F.col("signature")))
    return out.withColumns({"repo_id": F.lit(repo_id), "language": F.lit(language), "metadata": F.map_filter(known, lambda _, v: v.isNotNull())})


def chunk_entities(entities: DataFrame) -> DataFrame:
    """Chunks of entities(repo_id, file_path, name, type, owner, start_line, source_code, signature, docstring) and, if they have them, end_line, language, metadata.

    Functions and classes give a full, a signature and (with docstring) a docstring chunk; methods, named owner.name, a full and a signature
    chunk; other types none; what is empty gives none. The id is repo:file:name:line:kind. Only full chunks end at end_line and have metadata.
    """
    name = F.when(F.col("type") == "method", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    end = F.col("end_line") if "end_line" in entities.columns else F.col("start_line")
    data = F.col("metadata") if "metadata" in entities.columns else F.lit(None).cast("map<string,string>")
    language = F.col("language") if "language" in entities.columns else F.lit(None).cast("string")

    def chunk(suffix: str, long: str, content: str, when: Column) -> Column:
        full = suffix == "full"
        id_ = F.concat_ws(":", "repo_id", "file_path", name, F.col("start_line").cast("string"), F.lit(suffix))
        return F.when(when & (F.coalesce(F.col(content), F.lit("")) != ""), F.struct(id_.alias("chunk_id"), F.concat_ws("_", "type", F.lit(long)).alias("chunk_type"), F.col(content).alias("content"), (end if full else F.col("start_line")).alias("end_line"), (data if full else F.lit(None).cast("map<string,string>")).alias("metadata")))

    all_of = F.array_compact(F.array(chunk("full", "full", "source_code", F.lit(True)), chunk("sig", "signature", "signature", F.lit(True)), chunk("doc", "docstring", "docstring", F.col("type") != "method")))
    return entities.where(F.col("type").isin("function", "class", "method")).select("repo_id", "file_path", name.alias("entity_name"), F.col("type").alias("entity_type"), "start_line", language.alias("language"), F.inline(all_of))
