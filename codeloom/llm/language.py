"""Language identification with rank-order n-gram profiles and the out-of-place distance (Cavnar & Trenkle, 1994)."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, materialize, slices

_BITS = 21
RESULT = "doc_id bigint, predicted string, distance bigint, n_grams int, score double, margin double, rejected boolean"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    for lo in range(0, sys.maxunicode + 1):
        if unicodedata.category(chr(lo))[0] == "L":
            table[lo] = True
    return table


def gram_keys(text: str) -> np.ndarray:
    """All 1- to 3-grams of the lower-cased letter runs, each run padded with one space at both ends (the space alone is no gram).

    A gram is packed as three 21-bit code points, so keys sort as the grams do.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters only the first stays, as a space
    keep[0] = True
    c = np.where(letter, points, 32)[keep].astype(np.uint64)
    is_letter = letter[keep]
    s1, s2 = np.uint64(_BITS), np.uint64(2 * _BITS)
    one = c[is_letter] << s2
    two = (c[:-1] << s2 | c[1:] << s1)[is_letter[:-1] | is_letter[1:]]
    three = (c[:-2] << s2 | c[1:-1] << s1 | c[2:])[is_letter[1:-1]]
    return np.concatenate([one, two, three]) if is_letter.any() else np.empty(0, np.uint64)


def ranked(keys: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, ties in key order."""
    found, counts = np.unique(keys, return_counts=True)
    if len(found) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.lexsort((found, -counts))][:size]


def as_text(key: int) -> str:
    mask = (1 << _BITS) - 1
    return "".join(chr(p) for p in (key >> 2 * _BITS, key >> _BITS & mask, key & mask) if p)


def train_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", profile_size: int = 300, sample_rows: int = 500, max_labels: int = 200) -> dict[str, np.ndarray]:
    """Language -> its most frequent n-grams in order of rank, from labelled rows.

    sample_rows bounds the labelled rows of each language that are read (those whose md5 of the id is smallest; whole texts), max_labels
    the languages (those with most rows, ties by name), so that a column of free text is no danger. Rows without id, text or label are not
    used. Without any labelled row the result is empty.
    """
    labelled = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    known = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_labels).select("lang")
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")))
    chosen = labelled.select("doc_id", "lang").join(F.broadcast(known), "lang", "left_semi").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample_rows)
    chosen = materialize(chosen.select("doc_id", "lang"), "sample")
    # at most max_labels * sample_rows rows of two columns
    side = F.broadcast(chosen)

    def count(batches):
        for b in slices(batches):
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                keys = [gram_keys(t) for t, g in zip(texts, langs, strict=True) if g == lang]
                found, counts = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    grams = labelled.join(side, ["doc_id", "lang"], "left_semi").select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= profile_size)
    out: dict[str, list] = {}
    for r in best.orderBy("lang", "rn").collect():  # languages x profile_size rows, whatever the size of the corpus
        out.setdefault(r["lang"], []).append(r["gram"])
    discard(chosen)
    return {k: np.array(v, dtype=np.uint64) for k, v in out.items()}


class _Judge:
    def __init__(self, profiles: dict[str, np.ndarray], profile_size: int, reject_above: float):
        self.names, self.size, self.reject_above = sorted(profiles), profile_size, reject_above
        self.where = [np.argsort(profiles[n], kind="stable") for n in self.names]
        self.ordered = [profiles[n][w] for n, w in zip(self.names, self.where, strict=True)]

    def __call__(self, text: str | None) -> tuple:
        """(predicted, distance, n_grams, score, margin, rejected)"""
        top = ranked(gram_keys(text), self.size) if text else np.empty(0, np.uint64)
        if not len(top) or not self.names:
            return None, None, len(top), None, None, True
        mine, d = np.arange(len(top)), []
        for where, ordered in zip(self.where, self.ordered, strict=True):
            at = np.minimum(np.searchsorted(ordered, top), len(ordered) - 1)
            d.append(int(np.where(ordered[at] == top, np.abs(mine - where[at]), self.size).sum()))
        best = d.index(min(d))
        scale, rest = len(top) * self.size, d[:best] + d[best + 1 :]
        return self.names[best], d[best], len(top), d[best] / scale, (min(rest) - d[best]) / scale if rest else None, d[best] / scale > self.reject_above


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", profile_size: int = 300, reject_above: float = 0.72) -> DataFrame:
    """One row per document: the language whose profile is nearest, and whether the document is rejected.

    distance sums |rank in document - rank in profile| over the document's profile_size most frequent n-grams, and profile_size
    for a gram that the profile lacks. score = distance / (n_grams * profile_size), 0 to 1; margin is the second-best score
    less the best (NULL with one profile). Rejected: no letter at all (also NULL or empty text), no profile, or score >
    reject_above, which means that hardly any of its n-grams are in any profile. Ties go to the first language by name.
    Whole texts are counted, however long. Repeated rows give repeated results; a NULL id stays NULL.
    """
    judge = _Judge(profiles, profile_size, reject_above)

    def run(batches):
        types = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
        for b in slices(batches):
            rows = [judge(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[x.split()[0] for x in RESULT.split(", ")])

    return documents(docs, id_col, text_col).mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", profile_size: int = 300, reject_above: float = 0.72) -> DataFrame:
    """The rows of docs that identify() doesn't reject, all columns; one pass without a shuffle."""
    judge = _Judge(profiles, profile_size, reject_above)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        # a slice at a time: a batch's texts are never all Python objects
        return pa.array([not judge(t)[-1] for at in range(0, len(text), 1000) for t in text.slice(at, 1000).to_pylist()], pa.bool_())

    return docs.where(kept(F.col(f"`{text_col}`").cast("string")))
