"""Sum-of-squares packing of documents into training sequences (Csirik et al., 2006)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, slices
from .merges import DEFAULT_VOCABULARY, LibraryMerger, merger

RESULT = "bin_id bigint, n_tokens int, ids array<int>, doc_ids array<bigint>, token_starts array<bigint>, bin_offsets array<int>"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item, 1 <= size <= capacity, placed in the order given.

    With N[g] open bins of gap g, each item goes where the sum of N[g]^2 over gaps 1..capacity-1 becomes least; of equal choices to the
    smallest gap, a new bin last; of bins with the same gap to the one opened or filled last.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(n[s:capacity]) + s
        # from gap g to g - s: N[g]^2 falls by 2 N[g] - 1, N[g-s]^2 grows by 2 N[g-s] + 1 (a full bin isn't counted)
        change = np.where(gaps == s, 1 - 2 * n[gaps], 2 - 2 * n[gaps] + 2 * n[gaps - s])
        fresh = 2 * n[capacity - s] + 1 if s < capacity else 0
        if len(gaps) and change.min() <= fresh:
            g = int(gaps[change.argmin()])
            b = open_bins[g].pop()
            n[g] -= 1
        else:
            g, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            n[g - s] += 1
            open_bins[g - s].append(b)
    return bins, offsets


def token_parts(docs: DataFrame, id_col: str, text_col: str, vocabulary_path: str, capacity: int) -> DataFrame:
    """(row, doc_id, token_start, ids binary): each text's BPE ids, two bytes each, in parts of `capacity` ids and a rest. row numbers the table's rows."""

    def run(batches):
        m = merger(vocabulary_path, "<u2", LibraryMerger)
        for b in slices(batches):
            coded = [x.tobytes() for x in m.ids(b.column("text").to_pylist())]
            parts = [(i, at) for i, c in enumerate(coded) for at in range(0, len(c), 2 * capacity)]
            which = pa.array([i for i, _ in parts], pa.int64())
            ids = pa.array([coded[i][at : at + 2 * capacity] for i, at in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row").take(which), b.column("doc_id").take(which), pa.array([at // 2 for _, at in parts], pa.int64()), ids], names=["row", "doc_id", "token_start", "ids"])

    there = documents(docs, id_col, text_col).where("doc_id is not null and text is not null")
    return there.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row bigint, doc_id bigint, token_start bigint, ids binary")


def _lists(ids: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, capacity: int = 2048, shard_tokens: int = 2_000_000) -> DataFrame:
    """(bin_id, n_tokens, ids, doc_ids, token_starts, bin_offsets): one row for each training sequence of at most `capacity` token ids.

    doc_ids names the documents in the sequence; the part of each begins at its token token_starts[i] and stands in ids from bin_offsets[i] on, up to
    the next part or the end. A document longer than the capacity is cut into full parts, each a sequence of its own (negative bin_id), and a
    rest that is packed like the others. Rests are placed by sum_of_squares in order of (doc_id, ids), in shards of about shard_tokens
    tokens chosen by a hash of the table's row: their number follows the input and their size doesn't, whatever ids repeat. Rows
    without id, NULL and empty texts are in no sequence. A repeated row is packed again, as a document of its own. Texts are tokenized
    whole, by the tiktoken library; other columns take no part. An empty table gives no row.
    """
    parts = materialize(token_parts(docs, id_col, text_col, vocabulary_path, capacity), "parts")
    full = F.length("ids") == 2 * capacity
    total = parts.where(~full).agg(F.sum(F.length("ids"))).first()[0] or 0
    shards = max(1, -(-total // (2 * shard_tokens)))

    def place(t: pa.Table) -> pa.Table:
        shard, doc, raw = t.column("shard")[0].as_py(), t.column("doc_id").to_numpy(), t.column("ids").to_pylist()
        order = np.array(sorted(range(len(raw)), key=lambda i: (doc[i], raw[i])), np.int64)
        raw = [raw[i] for i in order]
        n = np.array([len(x) // 2 for x in raw], np.int64)
        bins, offsets = sum_of_squares(n, capacity)
        by_bin = np.lexsort((offsets, bins))
        flat = pa.array(np.frombuffer(b"".join([raw[i] for i in by_bin]), "<u2").astype(np.int32))
        members, tokens = np.cumsum(np.bincount(bins)), np.bincount(bins, n).astype(np.int64)
        source = order[by_bin]
        columns = [pa.array(np.arange(len(members)) + (shard << 32)), pa.array(tokens.astype(np.int32)), _lists(flat, np.cumsum(tokens)), _lists(pa.array(doc[source]), members), _lists(pa.array(t.column("token_start").to_numpy()[source]), members), _lists(pa.array(offsets[by_bin].astype(np.int32)), members)]
        return pa.Table.from_arrays(columns, names=NAMES)

    def alone(batches):
        for b in slices(batches):
            one = np.arange(1, b.num_rows + 1)
            flat = pa.array(np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u2").astype(np.int32))
            columns = [b.column("bin_id"), pa.array(np.full(b.num_rows, capacity, np.int32)), _lists(flat, one * capacity), _lists(b.column("doc_id"), one), _lists(b.column("token_start"), one), _lists(pa.array(np.zeros(b.num_rows, np.int32)), one)]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    packed = parts.where(~full).withColumn("shard", F.expr(f"cast(pmod(xxhash64(row), {shards}) as bigint)")).groupBy("shard").applyInArrow(place, RESULT)
    return packed.unionByName(parts.where(full).withColumn("bin_id", -1 - F.monotonically_increasing_id()).mapInArrow(alone, RESULT))
