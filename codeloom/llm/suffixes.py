"""Repeated passages: a depth-limited radix sort of suffixes, most significant digit first, only through threshold words.

Two suffixes are the same through `words` words exactly if all their digits are; each pass splits groups by the next digit and keeps what can
still have an equal, so the groups left after the last pass are exactly the repeated windows. One row for each suffix would be 500 million
rows a GB of text. So a sparse set of suffixes is sorted that every window holds a member of: those at the least-hashed k-gram of the
windows that hold them. The windows that share it side by side, at most words - k + 1, travel as one row (a run). The digits, in this order:

1. words 0 .. k-1 of the sorted suffix;
2. the words before and after it, from the begin of the run's first window to the end of its last one. Runs that agree here agree in all
   their windows at once;
3. only where one digit 1 has several digits 2: all `words` words of each window, for one run of each kind.

Digits 2 and 3 are 128 bits of two independent hashes. Every pass counts its groups by partial aggregation and joins the counts back, so a
passage that every document has is a skewed join that AQE splits, never one task's group.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix, named, numbered, slices, word_hashes

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEYS = ("0123456789123456", "codeloomsuffixes")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Words of one text that are hashed at once; a longer one goes in stretches that overlap by a window.
STRETCH = 500_000


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 15), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = tuple(out)
    return _powers[base][0][:n], _powers[base][1][:n]


class _Hashes:
    """Hashes of any stretch of the words in constant time."""

    def __init__(self, words: np.ndarray, base: int = _BASES[0]):
        n = len(words)
        power, self.inverse = _power_table(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words) * power[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each `span` successive values is, the first of equal ones."""
    best, width = np.arange(len(values)), 1
    while width < span:  # minima over a width and, shifted, over twice that
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        width += step
    return best


def _runs(words: list[np.ndarray], begins: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, digit 1, digit 2 in two halves) of each run; words of all texts, one after the other."""
    n, lengths = len(words[0]), np.diff(begins)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(np.arange(n) + size <= np.repeat(begins[1:], lengths))
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    one, two = (_Hashes(w, b) for w, b in zip(words, _BASES, strict=True))
    gram = np.arange(n - k + 1)
    grams = one.of(gram, gram + k)
    best = _least(grams, size - k + 1)[at]
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    end = begin + count - 1 + size
    return text[begin], begin - begins[text[begin]], count, grams[best[first]].view(np.int64), one.of(begin, end).view(np.int64), two.of(begin, end).view(np.int64)


def _stretches(words: list[np.ndarray], begins: np.ndarray, size: int):
    """(words, begins, number of the first text, word of it that the first one is): the same texts; long ones in overlapping stretches."""
    if begins[-1] <= STRETCH:
        yield words, begins, 0, 0
        return
    for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
        for at in range(a, max(a + 1, b - size + 1), STRETCH):
            end = min(b, at + STRETCH + size - 1)
            yield [w[at:end] for w in words], np.array([0, end - at]), i, at - a


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, k: int = 16) -> DataFrame:
    """(doc_id, content, start, n, later): n consecutive windows of `words` words, from word `start` on, that occur at least twice in the corpus.

    later tells whether an equal window begins earlier, by (doc_id, md5 of the text, start). Words are separated by white space. Windows that
    overlap within one document count as well. Rows with a NULL id or text, and texts shorter than a window, have none. Rows equal in id and text are
    one document; rows that share only the id are different documents, told apart by content, the md5 of the text (NULL where no id
    recurs). Other columns, whatever their names, take no part. Long texts are read whole. An empty table gives no row.
    """
    return _named_windows(*numbered(docs, id_col, text_col), words, k)


def _named_windows(plain: DataFrame, names: DataFrame | None, words: int, k: int) -> DataFrame:
    return named(_windows(plain, words, k), names)


def _windows(plain: DataFrame, words: int, k: int) -> DataFrame:
    """(ord, start, n, later) of (ord, text)."""
    if not 1 <= k <= words:
        raise ValueError("k must be between 1 and words")

    def first_pass(batches):
        for b in slices(batches):
            ords = b.column("ord").to_numpy()
            hashes, begins = word_hashes(b.column("text"), _KEYS)
            for w, begin, text, word in _stretches(hashes, begins, words):
                c = _runs(w, begin, words, k)
                if len(c[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(ords[c[0] + text]), pa.array((c[1] + word).astype(np.int32)), pa.array(c[2].astype(np.int32)), *map(pa.array, c[3:])], names=["ord", "start", "n", "d1", "d2", "e2"])

    runs = materialize(plain.mapInArrow(first_pass, "ord bigint, start int, n int, d1 bigint, d2 bigint, e2 bigint"), "runs")
    first_digit = runs.groupBy("d1").agg(F.count(F.lit(1)).alias("c"), F.min("d2").alias("lo"), F.max("d2").alias("hi"), F.min("e2").alias("low"), F.max("e2").alias("high"))
    again = first_digit.where("c > 1").select("d1", ((F.col("lo") != F.col("hi")) | (F.col("low") != F.col("high"))).alias("mixed"))
    # one number that orders suffixes by (ord, start)
    place = F.col("ord").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("start")
    twice = materialize(runs.join(again, "d1").withColumn("place", place.cast("decimal(38,0)")), "radix")
    discard(runs)
    kinds = twice.groupBy("d1", "d2", "e2").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("first"))
    passed = materialize(twice.join(kinds, ["d1", "d2", "e2"]), "radix")
    discard(twice)
    whole = passed.where("not mixed").select("ord", "start", "n", (F.col("first") != F.col("place")).alias("later"))

    # third pass: one run of each kind stands for its equals
    delegates = passed.where("mixed and place = first").groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("start", "n", "d1", "d2", "e2", "c", F.col("first").cast("string").alias("first")))).alias("runs"))

    def last_pass(batches):
        for b in slices(batches, 200):
            hashes, begins = word_hashes(b.column("text"), _KEYS)
            lists = b.column("runs")
            runs = lists.flatten()
            get = lambda x: runs.field(x).to_numpy(zero_copy_only=False)
            n = get("n").astype(np.int64)
            text = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(begins[text] + get("start"), n) + off
            same = np.repeat(np.arange(len(n)), n)
            digits = [_Hashes(w, base).of(at, at + words).view(np.int64) for w, base in zip(hashes, _BASES, strict=True)]
            yield pa.RecordBatch.from_arrays([*(runs.field(x).take(pa.array(same)) for x in ("d1", "d2", "e2", "c", "first")), pa.array(off.astype(np.int32)), *map(pa.array, digits)], names=["d1", "d2", "e2", "c", "first", "off", "d3", "e3"])

    windows = materialize(plain.join(delegates, "ord").select("text", "runs").mapInArrow(last_pass, "d1 bigint, d2 bigint, e2 bigint, c bigint, first string, off int, d3 bigint, e3 bigint"), "radix")
    windows = windows.withColumn("first", (F.col("first").cast("decimal(38,0)") + F.col("off")).cast("decimal(38,0)"))
    equal = windows.groupBy("d3", "e3").agg(F.sum("c").alias("total"), F.min("first").alias("window_first")).where("total > 1").drop("total")
    judged = windows.join(equal, ["d3", "e3"]).select("d1", "d2", "e2", "off", "window_first")
    single = passed.where("mixed").join(judged, ["d1", "d2", "e2"]).select("ord", (F.col("start") + F.col("off")).alias("start"), F.lit(1).alias("n"), (F.col("place") + F.col("off") != F.col("window_first")).alias("later"))
    return whole.unionByName(single)


def _spans(plain: DataFrame, words: int, k: int) -> DataFrame:
    """(ord, later, start_word, end_word)"""
    found = _windows(plain, words, k)
    order = Window.partitionBy("ord", "later").orderBy("start", "n")
    end = F.col("start") + F.col("n") - 1 + words
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("end", end).withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("span", F.sum("opens").over(order))
    return marked.groupBy("ord", "later", "span").agg(F.min("start").cast("int").alias("start_word"), F.max("end").cast("int").alias("end_word")).drop("span")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, k: int = 16) -> DataFrame:
    """(doc_id, content, later, start_word, end_word): maximal stretches of words [start_word, end_word) that repeated windows cover.

    Stretches are formed apart for first occurrences (later = false) and for later ones (true); see repeated_windows, also for odd rows.
    """
    plain, names = numbered(docs, id_col, text_col)
    return named(_spans(plain, words, k), names)


_WORD = re.compile(r"\S+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (sorted, disjoint); white space before a kept word stays with it."""
    out, kept, index, span = [], 0, 0, 0
    for m in _WORD.finditer(text):
        while span < len(spans) and index >= spans[span][1]:
            span += 1
        if span < len(spans) and spans[span][0] <= index:
            out.append(text[kept : m.start()].rstrip() if kept < m.start() else "")
            kept = m.end()
        index += 1
    out.append(text[kept:])
    return "".join(out).strip()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", words: int = 50, k: int = 16) -> DataFrame:
    """docs with later occurrences of repeated passages cut out of the text; all columns stay.

    The first occurrence, by (id, md5 of the text, position), stays whole. chars_col, where docs have it, gets the new length of changed texts. A
    document of which nothing is left goes; documents that had no repeat (also NULL and empty texts, and rows without id) stay as they are. Rows
    equal in id and text are one document and all cut alike; rows that share only the id are different documents. Long texts are read
    whole. An empty table gives no row.
    """
    plain, names = numbered(docs, id_col, text_col)
    cut_id, id_, text_ = F.col("__cut_id"), F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string")
    spans = named(_spans(plain, words, k).where("later"), names)
    per_doc = spans.groupBy(F.col("doc_id").alias("__cut_id"), F.col("content").alias("__content")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__cuts"))
    same = id_ == cut_id
    joined = docs.join(per_doc, same if names is None else same & (F.md5(text_.cast("binary")) == F.col("__content")), "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for b in slices([pa.RecordBatch.from_arrays([text, cuts], names=["text", "cuts"])]):
            rows = zip(b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True)
            out.append(pa.array([t if c is None else without_spans(t, [(s["start_word"], s["end_word"]) for s in c]) for t, c in rows], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    # not deterministic as far as Spark knows: else the filter is pushed below the cut, texts are cut twice, and each task holds two Python workers
    new = joined.withColumn("__text", cut.asNondeterministic()(text_, F.col("__cuts"))).where("__cut_id is null or __text <> ''")
    if chars_col and chars_col in docs.columns:
        new = new.withColumn(chars_col, F.when(cut_id.isNull(), F.col(f"`{chars_col}`")).otherwise(F.char_length("__text")).cast(docs.schema[chars_col].dataType))
    return new.withColumn(text_col, F.col("__text")).select(*[F.col(f"`{c}`") for c in docs.columns])
