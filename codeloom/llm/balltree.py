"""Exact top-k inner products of a query set with all rows: a ball tree per shard, branch and bound, one kth score across shards.

Shards of bounded size are written to the shared folder. A task takes a block of queries and a range of shards, visits
these by the upper bound of their root balls, and prunes shards and nodes by each query's kth score so far. The first round searches
each block's most promising range; its kth scores go along to all other ranges.

Bounds and approximate scores carry an error bound relative to the norms, and whatever may be among the k best within it is scored again exactly: the
sum of the exact products of the elements, rounded once. Order and ties are those of these scores, at any scale.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, remove

RESULT = "query_id bigint, neighbor_id bigint, rank int, score double"
_SPLIT = 134217729.0  # 2^27 + 1: cuts a double into halves whose products are exact


def build(vectors: np.ndarray, leaf_size: int) -> dict[str, np.ndarray]:
    """The tree as arrays: `order` of the vectors; for each node center, radius, begin, end and children (-1: a leaf). Node 0 is the root."""
    order = np.arange(len(vectors))
    nodes: list[list] = []

    def node(begin: int, end: int) -> int:
        own = vectors[order[begin:end]]
        center = own.mean(axis=0)
        away = ((own - center) ** 2).sum(axis=1)
        at = len(nodes)
        nodes.append([center, np.sqrt(away.max()), begin, end, -1, -1])
        if end - begin > leaf_size and away.max() > 0:
            # cut across the line between two far points
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            order[begin:end] = order[begin:end][np.argsort(own @ (b - a), kind="stable")]
            middle = (begin + end) // 2
            nodes[at][4], nodes[at][5] = node(begin, middle), node(middle, end)
        return at

    node(0, len(vectors))
    center, radius, begin, end, left, right = zip(*nodes, strict=True)
    return {"vectors": vectors[order], "order": order, "center": np.array(center), "radius": np.array(radius), "begin": np.array(begin), "end": np.array(end), "left": np.array(left), "right": np.array(right)}


def exact_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner product of each pair of rows, rounded once."""
    product = x * y
    halves = []
    for v in (x, y):
        high = v * _SPLIT
        high = high - (high - v)
        halves += [high, v - high]
    xh, xl, yh, yl = halves
    rest = ((xh * yh - product) + xh * yl + xl * yh) + xl * yl
    return np.array([math.fsum(r) for r in np.concatenate([product, rest], axis=1).tolist()])


class Best:
    """The k best (exact score, id) of each query so far; ties go to the lesser id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score, self.id = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(queries), -np.inf)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach: the kth so far, here or in an earlier round."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, error: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """scores are within `error` of the exact ones."""
        least = self.kth(rows) - error
        if scores.shape[1] > self.k:
            least = np.maximum(least, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1] - 2 * error)
        r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(r):
            return
        exact = exact_dots(self.queries[rows[r]], vectors[c])
        some = np.unique(r)
        q = np.concatenate([np.repeat(rows[some], self.k), rows[r]])
        s = np.concatenate([self.score[rows[some]].ravel(), exact])
        i = np.concatenate([self.id[rows[some]].ravel(), ids[c]])
        order = np.lexsort((i, -s, q))
        begin = np.flatnonzero(np.concatenate([[True], np.diff(q[order]) > 0]))
        top = order[(begin[:, None] + np.arange(self.k)).ravel()]  # every query has k entries at least
        at = q[order][begin]
        self.score[at], self.id[at] = s[top].reshape(-1, self.k), i[top].reshape(-1, self.k)


def search(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, norms: np.ndarray, own: np.ndarray, best: Best) -> None:
    """Branch and bound for all queries at once. The vectors of a node have at most q.center + |q| radius as inner product with q."""
    reach = np.sqrt((tree["center"] ** 2).sum(axis=1)) + tree["radius"]  # no vector of the node is longer
    unit = 4 * (queries.shape[1] + 4) * np.finfo(np.float64).eps

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        return queries[rows] @ tree["center"][node] + norms[rows] * (tree["radius"][node] + unit * reach[node])

    def visit(node: int, rows: np.ndarray) -> None:
        if tree["left"][node] < 0:
            begin, end = tree["begin"][node], tree["end"][node]
            scores = queries[rows] @ tree["vectors"][begin:end].T
            there = ids[begin:end]
            scores[own[rows][:, None] == there] = -np.inf
            best.offer(rows, scores, unit * norms[rows] * reach[node], there, tree["vectors"][begin:end])
            return
        children = [(c, bound(c, rows)) for c in (tree["left"][node], tree["right"][node])]
        first = children[0][1] >= children[1][1]
        # each query goes first to the child with the higher bound
        for which, mask in ((0, first), (1, ~first), (1, first), (0, ~first)):
            child, ub = children[which]
            if (live := mask & (ub >= best.kth(rows))).any():
                visit(child, rows[live])

    rows = np.arange(len(queries))
    if (live := bound(0, rows) >= best.kth(rows)).any():
        visit(0, rows[live])


def _blob(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _arrays(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return dict(z)


def exact_top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, query_step: int = 100, shard_rows: int = 16_384, block_rows: int = 8_192, leaf_size: int = 256
) -> DataFrame:
    """(query_id, neighbor_id, rank, score): for every vector whose id is divisible by query_step its k others with the greatest inner product.

    All rows are searched. Scores are exact sums rounded once to a double, ties go to the lesser id. Rows without id, without vector, or whose vector is
    empty or holds NULL, NaN or infinite elements take no part. Of rows with one id the least vector counts. Vectors are compared with
    those of the same dimension only. With fewer than k others there are fewer rows. Other columns take no part. An empty table gives no row.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('infinity'))")
    rows = clean if clean.groupBy("id").count().where("count > 1").isEmpty() else clean.groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(rows.withColumn("dim", F.size("v")), "vectors")
    counts = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % query_step == 0).alias("q")).collect()}  # one row for each dimension
    shards = {d: -(-n // shard_rows) for d, (n, _) in counts.items()}
    blocks = {d: -(-q // block_rows) for d, (_, q) in counts.items()}
    tasks = 2 * spark.sparkContext.defaultParallelism

    def of(table: dict[int, int], x):
        return F.element_at(F.create_map(*[F.lit(v) for kv in (table or {0: 1}).items() for v in kv]), x)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tree = build(np.stack(pdf["v"].to_numpy()), leaf_size)
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "center": [tree["center"][0]], "radius": [float(tree["radius"][0])], "tree": [_blob(tree | {"ids": pdf["id"].to_numpy()[tree["order"]]})]})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "queries": [_blob({"ids": pdf["id"].to_numpy(), "v": np.stack(pdf["v"].to_numpy())})]})

    part = F.pmod(F.xxhash64("id"), of(shards, F.col("dim"))).cast("int")
    built = rows.withColumn("part", part).groupBy("dim", "part").applyInPandas(make, "dim int, part int, center array<double>, radius double, tree binary")
    path = new_path(spark, "balltrees")
    built.withColumn("shard", F.concat_ws("-", "dim", "part")).write.partitionBy("shard").parquet(path)
    asked = rows.where(F.col("id") % query_step == 0).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), of(blocks, F.col("dim"))).cast("int"))
    asked = materialize(asked.groupBy("dim", "block").applyInPandas(block, "dim int, block int, queries binary"), "queries")

    def searched(batches):
        for b in batches:
            for r in b.to_pylist():
                q = _arrays(r["queries"])
                own, v = q["ids"], q["v"]
                norms = np.sqrt((v**2).sum(axis=1))
                best = Best(v, k)
                if r["floor"] is not None:
                    best.floor = _arrays(r["floor"])["kth"]
                found = []
                for p in range(r["first"], r["last"]):
                    at = f"{path}/shard={r['dim']}-{p}"
                    root = pads.dataset(at, format="parquet").to_table(columns=["center", "radius"]) if parts_exist(at) else None
                    if root is not None and root.num_rows:
                        center, radius = root.column("center")[0].values.to_numpy(), root.column("radius")[0].as_py()
                        slack = 1 + 4 * (len(center) + 4) * np.finfo(np.float64).eps
                        found.append((v @ center + norms * (radius * slack + (slack - 1) * np.linalg.norm(center)), at))
                for ub, at in sorted(found, key=lambda x: -x[0].mean()):
                    if (ub >= best.kth(np.arange(len(v)))).any():
                        tree = _arrays(pads.dataset(at, format="parquet").to_table(columns=["tree"]).column("tree")[0].as_py())
                        search(tree, tree["ids"], v, norms, own, best)
                there = best.score > -np.inf
                out = {"queries": np.repeat(own, there.sum(axis=1)), "neighbors": best.id[there], "scores": best.score[there], "kth": np.where(there[:, -1], best.score[:, -1], -np.inf)}
                yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([_blob(out)], pa.binary())], names=["dim", "block", "found"])

    def ranges(df: DataFrame, which: str) -> DataFrame:
        """Each block once for every range of its dimension's shards."""
        n = of({d: max(1, min(s, -(-tasks // max(1, blocks[d])))) for d, s in shards.items()}, F.col("dim"))
        s = of(shards, F.col("dim"))
        df = df.withColumn("range", F.explode(F.sequence(F.lit(0), n - 1))).where(which)
        return df.select("dim", "block", "queries", "floor", F.floor(F.col("range") * s / n).cast("int").alias("first"), F.floor((F.col("range") + 1) * s / n).cast("int").alias("last")).repartition(tasks, "dim", "block", "first")

    schema = "dim int, block int, found binary"
    nothing = F.lit(None).cast("binary").alias("floor")
    one = materialize(ranges(asked.select("*", nothing), "range = 0").mapInArrow(searched, schema), "round")
    two = materialize(ranges(asked.join(one.select("dim", "block", F.col("found").alias("floor")), ["dim", "block"]), "range > 0").mapInArrow(searched, schema), "round")

    for table in (rows, asked):
        discard(table)
    remove(spark, path)

    def told(batches):
        for b in batches:
            for blob in b.column("found"):
                f = _arrays(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(f["queries"]), pa.array(f["neighbors"]), pa.array(f["scores"])], names=["query_id", "neighbor_id", "score"])

    # k rows of each query and range
    every = one.unionByName(two).select("found").mapInArrow(told, "query_id bigint, neighbor_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", "score")


def parts_exist(path: str) -> bool:
    """A shard that no row fell into has no folder."""
    fs, at = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    return fs.get_file_info(at).type != pa.fs.FileType.NotFound
