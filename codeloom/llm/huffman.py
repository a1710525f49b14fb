"""Token ids as bits: canonical length-limited Huffman codes from global counts, in blocks that decode independently.

Code lengths come from package-merge (Larmore & Hirschberg, 1990); codes of one length ascend with the id, so the lengths alone
are the code book. Decoding looks `limit` bits up in one table and decodes all blocks side by side, from their bit offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, slices
from .merges import DEFAULT_VOCABULARY, LibraryMerger, merger

RESULT = "doc_id bigint, n_ids bigint, n_bits bigint, payload binary, block_bits array<bigint>, restored boolean"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """The optimal code length of each symbol, at most `limit`; 0 for symbols that don't occur, 1 for an only symbol."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    if len(used) <= 1:
        out[used] = 1
        return out
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.float64)
    # at each level: the leaves and the pairs of the level below, sorted; pairs remember how many leaves come before them
    levels: list[np.ndarray] = []
    packages = np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        sort = np.argsort(merged, kind="stable")
        levels.append(sort < len(weight))
        packages = merged[sort][: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, right-aligned: by (length, id), each the one before plus 1."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes, code, last = np.zeros(len(lengths), np.int64), -1, 0
    sizes = lengths[order].astype(int).tolist()
    for s, n in zip(order.tolist(), sizes, strict=True):
        code = (code + 1) << (n - last) if last else 0
        codes[s], last = code, n
    return codes


#: Ids whose bits are placed at once; bounds the work memory.
STEP = 1 << 18


def encode_rows(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(payloads one after the other, their byte offsets, bits of each row, bit offsets of all blocks, where each row's blocks begin) of rows of ids.

    Row i has ids[begins[i] : begins[i + 1]]; each payload begins at a byte, and block offsets count from the row's first bit.
    """
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(lengths[ids], out=total[1:])
    if len(ids) and not lengths[ids].min():
        raise ValueError("an id that the counts lack")
    bits = total[begins[1:]] - total[begins[:-1]]
    bytes_ = np.concatenate([[0], np.cumsum(-(-bits // 8))])
    words = np.zeros(int(bytes_[-1]) // 4 + 3, np.uint32)
    for at in range(0, len(ids), STEP):
        end = min(at + STEP, len(ids))
        row = np.searchsorted(begins, np.arange(at, end), "right") - 1
        first = total[at:end] - total[begins[row]] + 8 * bytes_[row]
        part = ids[at:end]
        # a code, at most 32 bits, lies in two 32-bit words; no two codes share a bit, so that sums are unions
        code = codes[part].astype(np.uint64) << (64 - (first & 31) - lengths[part]).astype(np.uint64)
        word, low = first >> 5, int(first[0] >> 5)
        high = int(word[-1]) + 2
        for shift, more in ((32, 0), (0, 1)):
            piece = (code >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
            words[low:high] += np.bincount(word + more - low, piece.astype(np.float64), high - low).astype(np.uint32)
    blocks = np.concatenate([[0], np.cumsum(-(-np.diff(begins) // block))])
    where = np.repeat(begins[:-1], np.diff(blocks)) + block * (np.arange(blocks[-1]) - np.repeat(blocks[:-1], np.diff(blocks)))
    return words.astype(">u4").tobytes(), bytes_, bits, total[where] - np.repeat(total[begins[:-1]], np.diff(blocks)), blocks


class Decoder:
    """Decodes with one table of 2^limit entries."""

    def __init__(self, lengths: np.ndarray):
        self.limit = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        codes = canonical_codes(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = np.int64(1) << (self.limit - lengths[order].astype(np.int64))
        self.symbol, self.length = np.zeros(1 << self.limit, np.int64), np.ones(1 << self.limit, np.int64)
        if len(order):
            first = codes[order] << (self.limit - lengths[order].astype(np.int64))
            at = np.repeat(first, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
            self.symbol[at], self.length[at] = np.repeat(order, span), np.repeat(lengths[order], span)

    def blocks(self, payload: bytes, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of blocks that begin at these bits and hold so many ids each: one step decodes one id of every block."""
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int64)
        data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)])
        order = np.argsort(-sizes, kind="stable")
        at, to, live = np.array(offsets, np.int64)[order], begin[order], sizes[order]
        longest = int(live[0]) if len(live) else 0
        left = len(live) - np.searchsorted(live[::-1], np.arange(longest), "right")  # blocks with more ids than the step's number
        for step in range(longest):
            at, to = at[: left[step]], to[: left[step]]
            byte = at >> 3
            window = data[byte].astype(np.int64) << 32 | data[byte + 1].astype(np.int64) << 24 | data[byte + 2].astype(np.int64) << 16 | data[byte + 3].astype(np.int64) << 8 | data[byte + 4]
            entry = window >> (40 - self.limit - (at & 7)) & ((1 << self.limit) - 1)
            out[to + step] = self.symbol[entry]
            at = at + self.length[entry]
        return out


def block_sizes(n_ids: np.ndarray, block: int) -> np.ndarray:
    """How many ids each block of each row has."""
    n = -(-n_ids // block)
    out = np.full(int(n.sum()), block, np.int64)
    ends = np.cumsum(n)
    out[ends[n > 0] - 1] = (n_ids - (n - 1) * block)[n > 0]
    return out


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids): the texts' BPE ids as binary, two bytes each (little-endian); NULL for NULL. The vocabulary must be under 65,536."""

    def run(batches):
        m = merger(vocabulary_path, "<u2", LibraryMerger)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            there = iter(m.ids([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if t is None else next(there).tobytes() for t in texts], pa.binary())], names=["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids binary")


def global_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows."""

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in slices(batches):
            for v in b.column("ids").drop_null():
                total += np.bincount(np.frombuffer(v.as_buffer(), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row for each id of the vocabulary
        out[r["id"]] = r["n"]
    return out


def _lists(values: pa.Array, ends: np.ndarray, null: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values, mask=null)


def compress(ids: DataFrame, limit: int = 18, block: int = 512) -> tuple[DataFrame, np.ndarray]:
    """(coded rows, code lengths = the code book) of (doc_id, ids binary) rows; limit is at most 24.

    A row holds its number of ids and of bits, the payload, and the bit offset at which each block of `block` ids begins: any block can
    be decoded without the ones before. restored tells whether decoding the payload by its checkpoints gave the ids again. NULL ids give
    NULLs; no ids an empty payload and no block. Repeated rows are coded each; long rows are coded in steps of bounded memory. An
    empty table gives no row and a code book of zeros.
    """
    if not 1 <= limit <= 24:
        raise ValueError("limit must be between 1 and 24")
    lengths = code_lengths(global_counts(ids), limit)
    codes = canonical_codes(lengths)

    def run(batches):
        d, sizes64 = Decoder(lengths), lengths.astype(np.int64)
        for b in slices(batches):
            raw = b.column("ids")
            null = pc.is_null(raw)
            n = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            begins = np.concatenate([[0], np.cumsum(n)])
            flat = np.frombuffer(b"".join(raw.drop_null().to_pylist()), "<u2").astype(np.int32)
            payload, bytes_, bits, offsets, blocks = encode_rows(flat, begins, sizes64, codes, block)
            again = d.blocks(payload, offsets + np.repeat(8 * bytes_[:-1], np.diff(blocks)), block_sizes(n, block))
            wrong = np.concatenate([[0], np.cumsum(again != flat)])
            coded = pa.array([payload[x:y] for x, y in zip(bytes_[:-1].tolist(), bytes_[1:].tolist(), strict=True)], pa.binary(), mask=null.to_numpy(zero_copy_only=False))
            there = null.to_numpy(zero_copy_only=False)
            columns = [b.column("doc_id"), pa.array(n, mask=there), pa.array(bits, mask=there), coded, _lists(pa.array(offsets), blocks[1:], null), pa.array(wrong[begins[1:]] == wrong[begins[:-1]], mask=there)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return ids.select("doc_id", "ids").mapInArrow(run, RESULT), lengths


def expand(coded: DataFrame, lengths: np.ndarray, block: int = 512) -> DataFrame:
    """(doc_id, ids array<int>) of coded rows."""
    lengths = np.array(lengths)

    def run(batches):
        d = Decoder(lengths)
        for b in slices(batches):
            n = pc.fill_null(b.column("n_ids"), 0).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.binary_length(b.column("payload")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            each = pc.fill_null(pc.list_value_length(b.column("block_bits")), 0).to_numpy(zero_copy_only=False)
            offsets = b.column("block_bits").flatten().to_numpy() + np.repeat(8 * (np.cumsum(size) - size), each)
            ids = d.blocks(b"".join(b.column("payload").drop_null().to_pylist()), offsets, block_sizes(n, block))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(pa.array(ids.astype(np.int32)), np.cumsum(n), pc.is_null(b.column("n_ids")))], names=["doc_id", "ids"])

    return coded.select("doc_id", "n_ids", "payload", "block_bits").mapInArrow(run, "doc_id bigint, ids array<int>")


def compress_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, limit: int = 18, block: int = 512) -> tuple[DataFrame, np.ndarray]:
    """Tokenizes once into a table in the shared folder, counts, then codes; see compress()."""
    return compress(materialize(token_ids(docs, id_col, text_col, vocabulary_path), "ids"), limit, block)


def archive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, limit: int = 18, block: int = 512) -> DataFrame:
    """The coded rows of compress_texts() as kind `document`, and one row of kind `book`, whose payload has the code length of each id as a byte.

    The table alone is enough to decode it; see restore(). NULL texts give NULLs, also the book's other columns are NULL; an empty table
    gives the book alone.
    """
    coded, lengths = compress_texts(docs, id_col, text_col, vocabulary_path, limit, block)
    columns = [F.lit("document").alias("kind"), *coded.columns]
    book = docs.sparkSession.createDataFrame([("book", None, None, None, bytearray(lengths.tobytes()), None, None)], "kind string, " + RESULT)
    return coded.select(*columns).unionByName(book)


def restore(archived: DataFrame, block: int = 512) -> DataFrame:
    """(doc_id, ids array<int>) of the documents of an archive, decoded with the archive's own book."""
    book = np.frombuffer(bytes(archived.where("kind = 'book'").select("payload").first()[0]), np.uint8)  # one row, a byte for each id
    return expand(archived.where("kind = 'document'"), book, block)
