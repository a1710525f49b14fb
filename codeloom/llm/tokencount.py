"""Token counts of whole texts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, slices
from .merges import DEFAULT_VOCABULARY, LibraryMerger, Merger, merger


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, library: bool = False) -> DataFrame:
    """(doc_id, n_tokens) for every row, in one pass without a shuffle.

    NULL text: NULL; empty text: 0. Repeated rows give repeated results; a NULL id stays NULL. Texts are taken whole. An empty table
    gives no row. vocabulary_path must be readable on every executor. With library the same counts come from the tiktoken
    library instead.
    """

    def run(batches):
        m = merger(vocabulary_path, None, LibraryMerger if library else Merger)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            n = iter(m.counts([t for t in texts if t is not None]))
            out = [None if t is None else next(n) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.int64())], names=["doc_id", "n_tokens"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint")
