"""BPE encoding and decoding with a minimal acyclic transducer of the corpus's frequent words.

The automaton shares prefixes and suffixes (the incremental construction of Daciuk et al., 2000, from sorted words). Its
transitions carry numbers whose sum along a word's path is the word's index (Lucchesi & Kowaltowski, 1993); the index leads
to the word's ids. It is compiled once on the driver, written as one file to the shared folder and memory-mapped by the workers.
Words it lacks are merged exactly.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, local_path, materialize, new_path, slices
from .merges import DEFAULT_VOCABULARY, Merger, cut_texts, merge_all, pre_tokens, vocabulary

_SECTIONS = ("edge_key", "edge_target", "edge_number", "final", "id_begin", "ids")
_TYPES = {"edge_key": np.int64, "edge_target": np.int32, "edge_number": np.int32, "final": np.bool_, "id_begin": np.int64, "ids": np.int32}


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """(transitions of each state, is it final) of the minimal acyclic automaton of the sorted distinct words; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict = {}
    path: list[tuple[int, int]] = []  # (state, byte) along the last word
    previous = b""
    free: list[int] = []

    def minimize(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte = path.pop()
            child = edges[parent][byte]
            signature = (final[child], tuple(edges[child].items()))
            if (same := register.get(signature)) is not None:
                edges[parent][byte] = same
                free.append(child)
            else:
                register[signature] = child

    for w in words:
        common = len(os.path.commonprefix((w, previous)))
        minimize(common)
        at = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in w[common:]:
            if free:
                new = free.pop()
                edges[new], final[new] = {}, False
            else:
                new = len(edges)
                edges.append({})
                final.append(False)
            edges[at][byte] = new
            path.append((at, byte))
            at = new
        final[at] = True
        previous = w
    minimize(0)
    return edges, final


def compile_lexicon(words: list[bytes], vocabulary_path: str) -> dict[str, np.ndarray]:
    """The transducer of the words as flat arrays."""
    words = sorted(set(words))
    edges, final = minimal_automaton(words)
    # words below each state, children first
    count: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        if todo := [t for t in edges[s].values() if t not in count]:
            stack += todo
        else:
            count[s] = final[s] + sum(count[t] for t in edges[s].values())
            stack.pop()
    keys, targets, numbers = [], [], []
    for s in count:
        before = int(final[s])
        for byte, t in sorted(edges[s].items()):
            keys.append(s << 8 | byte)
            targets.append(t)
            numbers.append(before)
            before += count[t]
    order = np.argsort(np.array(keys, np.int64))
    ids, n = merge_all(words, vocabulary_path) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
    out = {"edge_key": np.array(keys)[order], "edge_target": np.array(targets)[order], "edge_number": np.array(numbers)[order], "final": np.array(final), "id_begin": np.concatenate([[0], np.cumsum(n)]), "ids": ids}
    return {k: v.astype(_TYPES[k]) for k, v in out.items()}


def to_bytes(lexicon: dict[str, np.ndarray]) -> bytes:
    """One file: the number of entries of each section, then the sections, each from a multiple of 8 bytes on."""
    head = np.array([len(lexicon[s]) for s in _SECTIONS], np.int64).tobytes()
    body = b""
    for s in _SECTIONS:
        raw = lexicon[s].tobytes()
        body += raw + b"\0" * (-len(raw) % 8)
    return head + body


@lru_cache(4)
def mapped(path: str) -> dict[str, np.ndarray]:
    """The sections of the file, memory-mapped: the workers of a machine share its pages."""
    raw = np.memmap(path, np.uint8, "r")
    sizes = raw[: 8 * len(_SECTIONS)].view(np.int64)
    out, at = {}, 8 * len(_SECTIONS)
    for s, n in zip(_SECTIONS, sizes.tolist(), strict=True):
        size = n * np.dtype(_TYPES[s]).itemsize
        out[s] = raw[at : at + size].view(_TYPES[s])
        at += size + -size % 8
    return out


def look_up(words: list[bytes], lexicon: dict[str, np.ndarray]) -> np.ndarray:
    """The index of each word, -1 where the lexicon lacks it: all words walk the automaton side by side, one byte a step."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    state, number, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    keys, alive = lexicon["edge_key"], np.arange(n)
    for step in range(int(lengths.max(initial=0)) + 1):
        ended = lengths[alive] == step
        at_end = alive[ended]
        out[at_end] = np.where(lexicon["final"][state[at_end]], number[at_end], -1)
        alive = alive[~ended]
        if not len(alive) or not len(keys):
            break
        key = state[alive] << 8 | flat[begin[alive] + step]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        alive, at = alive[hit], at[hit]
        state[alive] = lexicon["edge_target"][at]
        number[alive] += lexicon["edge_number"][at]
    return out


def encode_words(words: list[bytes], lexicon: dict[str, np.ndarray], vocabulary_path: str) -> tuple[np.ndarray, np.ndarray]:
    """As merge_all: by the lexicon where it has the word, else by merging."""
    index = look_up(words, lexicon)
    known = index >= 0
    merged, n_merged = merge_all([w for w, k in zip(words, known.tolist(), strict=True) if not k], vocabulary_path) if not known.all() else (np.empty(0, np.int64), np.empty(0, np.int64))
    begin, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    begin[known] = lexicon["id_begin"][index[known]]
    counts[known] = lexicon["id_begin"][index[known] + 1] - begin[known]
    begin[~known] = np.cumsum(n_merged) - n_merged + len(lexicon["ids"])
    counts[~known] = n_merged
    at = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.concatenate([lexicon["ids"], merged])[at], counts


#: Distinct words that a worker counts before it hands them on.
HELD_WORDS = 200_000


def frequent_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50_000) -> list[bytes]:
    """The most frequent pre-tokens of all texts, at most `size` of them: all that reach some count of 2 or more. Words with equal counts are in or out together."""

    def count(batches):
        total: Counter = Counter()
        for b in slices(batches):
            flat, begins, _ = cut_texts(b.column("text").drop_null().to_pylist())
            first = np.zeros(len(flat), bool)
            first[begins[:-1]] = True
            for lead, mask in (("", first), (" ", ~first)):
                counted = pc.value_counts(flat.filter(pa.array(mask)))
                for piece, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True):
                    for w in pre_tokens(lead, piece):
                        total[w] += n
            if len(total) > HELD_WORDS:
                yield told(total)
                total = Counter()
        if total:
            yield told(total)

    def told(total):
        return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in total], pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = documents(docs, id_col, text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = materialize(counted, "words")
    # the least count that at most `size` words reach, from how many words have each count
    above = F.sum("words").over(Window.orderBy(F.desc("n")))
    cut = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("above", above).where(F.col("above") <= size).agg(F.min("n")).first()[0]
    out = [] if cut is None else sorted(bytes(r["word"]) for r in counted.where(F.col("n") >= cut).select("word").collect())  # at most `size` rows in all
    discard(counted)
    return out


def publish(docs_or_spark, lexicon: dict[str, np.ndarray]) -> str:
    """Writes the lexicon to the shared folder; the name under which executors open it."""
    spark = getattr(docs_or_spark, "sparkSession", docs_or_spark)
    uri = new_path(spark, "lexicon")
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(to_bytes(lexicon))
        return path
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(uri)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(to_bytes(lexicon)))
    out.close()
    spark.sparkContext.addFile(uri)  # executors fetch it from the shared folder
    return "spark-file:" + uri.rsplit("/", 1)[1]


_mergers: dict = {}


def _merger(path: str, vocabulary_path: str) -> Merger:
    if (key := (path, vocabulary_path)) not in _mergers:
        _mergers.clear()
        at = SparkFiles.get(path.removeprefix("spark-file:")) if path.startswith("spark-file:") else path
        _mergers[key] = Merger(vocabulary_path, "<i4", lambda words, v: encode_words(words, mapped(at), v))
    return _mergers[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, lexicon_words: int = 50_000) -> DataFrame:
    """(doc_id, ids array<int>, restored) for every row: the ids that merging gives, whether or not the lexicon has a word.

    restored tells whether decoding the ids gave the text again. NULL text: NULL; empty text: no ids. Repeated rows give repeated results; a NULL
    id stays NULL. Texts are taken whole; a word of any length takes time in proportion to its length and its logarithm. An empty table gives
    no row (and an empty lexicon, which is valid). The words of the lexicon are counted over all texts.
    """
    name = publish(docs, compile_lexicon(frequent_words(docs, id_col, text_col, lexicon_words), vocabulary_path))

    def run(batches):
        m = _merger(name, vocabulary_path)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            there = iter(m.ids([t for t in texts if t is not None]))
            coded = [None if t is None else next(there) for t in texts]
            null = pa.array([c is None for c in coded])
            flat = np.concatenate([np.empty(0, np.int32), *(c for c in coded if c is not None)])
            ends = np.cumsum([0 if c is None else len(c) for c in coded])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat), mask=null)
            same = [None if t is None else decode_ids(c, vocabulary_path) == t for t, c in zip(texts, coded, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(same, pa.bool_())], names=["doc_id", "ids", "restored"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>, restored boolean")


def decode_ids(ids: np.ndarray, vocabulary_path: str = DEFAULT_VOCABULARY) -> str:
    """The text of the ids; bytes that are no UTF-8 (ids cut in mid-character) become replacement characters."""
    pieces = vocabulary(vocabulary_path)[3]
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, text) of every row; NULL ids give NULL, no ids the empty text, an id outside the vocabulary raises."""

    def run(batches):
        for b in slices(batches):
            lists = b.column("ids")
            texts = [None if not v.is_valid else decode_ids(v.values.to_numpy(), vocabulary_path) for v in lists]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
