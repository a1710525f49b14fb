"""Near-duplicate documents: fast similarity sketching (Dahlgaard, Knudsen & Thorup, 2017), banding, exact verification.

A document is the set of its word 3-grams (a shorter one: the sequence of its words). In round i of the sketch every element is
hashed to a bin and a value (i, v); a bin keeps its least pair, so values of an early round win, and from round t on all elements
go to bin i - t, which guarantees that every coordinate fills. Rounds end as soon as all bins are full: for long
documents after one or two.

Documents that share a band become candidates. Buckets are never cut: first each document is verified against one member of one of its
buckets (linear in the buckets), and components of verified pairs contract; then all pairs that still lie in different components
of one bucket are verified exactly, inside the bucket, where their gram sets meet. Links are counted inside the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix, named, numbered, slices, word_hashes

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The set of each text's k-grams of words as sorted 64-bit hashes; all words as one gram where there are fewer than k."""
    (h,), begins = word_hashes(texts)
    grams = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        grams = mix(grams * _A + h[i : i + len(grams)] + np.uint64(i))
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            one = np.zeros(int(b > a), np.uint64)
            for i in range(b - a):
                one = mix(one * _A + h[a + i] + np.uint64(i))
            out.append(one)
    return out


@lru_cache(4)
def _seeds(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * _B)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of the non-empty set, each with equal probability in two sets as their Jaccard similarity has it."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, n, seeds, mask = np.full(t, full), len(elements), _seeds(t), np.uint64(t - 1)
    begin = 0
    while begin < t and (out == full).any():
        end = min(t, begin + max(1, -(-2 * t // n) if n < 2 * t else 1))
        v = mix(elements[None, :] ^ seeds[begin:end, None])
        value = (v >> np.uint64(16)) | (np.arange(begin, end, dtype=np.uint64) << np.uint64(48))[:, None]
        np.minimum.at(out, (v & mask).astype(np.int64).ravel(), value.ravel())
        begin = end
    for b in np.flatnonzero(out == full):  # round t + b: everything goes to bin b
        out[b] = (mix(elements ^ seeds[t + b]) >> np.uint64(16)).min() | np.uint64((t + b) << 48)
    return out


def band_keys(sketches: np.ndarray, bands: int) -> np.ndarray:
    rows = sketches.shape[1] // bands
    cut = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _A + cut[:, :, r])
    return key.astype(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _bands(docs: DataFrame, k: int, t: int, bands: int) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            sets = shingles(b.column("text"), k)
            kept = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            if len(kept):
                keys = band_keys(np.stack([sketch(sets[i], t) for i in kept]), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("ord").to_numpy()[kept], bands))], names=["key", "ord"])

    return docs.mapInArrow(run, "key bigint, ord bigint")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b) of the pairs that are similar by their whole texts."""

    def run(batches):
        for batch in slices(batches):
            x, y = shingles(batch.column("x"), k), shingles(batch.column("y"), k)
            hit = pa.array([jaccard(p, q) >= threshold for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(hit), batch.column("b").filter(hit)], names=["a", "b"])

    with_b = pairs.join(docs.select(F.col("ord").alias("b"), F.col("text").alias("y")), "b")
    return with_b.join(docs.select(F.col("ord").alias("a"), F.col("text").alias("x")), "a").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("ord"), pa.array([s.tobytes() for s in shingles(b.column("text"), k)], pa.binary())], names=["ord", "grams"])

    return docs.mapInArrow(run, "ord bigint, grams binary")


def intersections(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of rows has in common with each of columns.

    Elements that many sets have are multiplied as a dense matrix, a few hundred at a time; of the others, inverted lists are counted.
    """
    n_rows = np.array([len(x) for x in rows], np.int64)
    n_columns = np.array([len(x) for x in columns], np.int64)
    elements, which = np.unique(np.concatenate([*rows, *columns]), return_inverse=True)
    of_rows, of_columns = which[: n_rows.sum()], which[n_rows.sum() :]
    row, column = np.repeat(np.arange(len(rows)), n_rows), np.repeat(np.arange(len(columns)), n_columns)
    f, g = np.bincount(of_rows, minlength=len(elements)), np.bincount(of_columns, minlength=len(elements))
    out = np.zeros((len(rows), len(columns)), np.float32)
    dense = f * g > max(64, len(rows) * len(columns) // 64)
    number = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), 512):
        sides = []
        for own, mine, n in ((of_rows, row, len(rows)), (of_columns, column, len(columns))):
            there = dense[own] & (number[own] >= at) & (number[own] < at + 512)
            m = np.zeros((n, 512), np.float32)
            m[mine[there], number[own[there]] - at] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    rare = ~dense & (f > 0) & (g > 0)
    held = rare[of_columns]
    order = np.argsort(of_columns[held], kind="stable")
    posting = column[held][order]
    ends = np.cumsum(np.where(rare, g, 0))
    there = rare[of_rows]
    own, mine = of_rows[there], row[there]
    n = g[own]
    at = np.searchsorted(mine, np.arange(len(rows) + 1))
    for i in np.flatnonzero(np.diff(at)):
        a, b = at[i], at[i + 1]
        m = n[a:b]
        hit = posting[np.repeat(ends[own[a:b]] - m, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        out[i] += np.bincount(hit, minlength=len(columns))
    return out


def similar(rows: list[np.ndarray], columns: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets have a Jaccard similarity >= threshold."""
    both = intersections(rows, columns).astype(np.float64)
    sizes = np.array([len(x) for x in rows])[:, None] + np.array([len(x) for x in columns])[None, :] - both
    return both / np.maximum(1, sizes) >= threshold


#: Members, and 64-bit grams, of a group that are compared in one task's memory; larger groups are cut into blocks that meet pairwise.
BLOCK, BLOCK_GRAMS = 2048, 1_500_000


def _in_blocks(members: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """members(group, ord, root) with their sets as grams, once for each pair (x, y) of blocks of its group; x = y: all pairs inside the block."""
    sets = _sets(docs, k)
    sized = materialize(members.join(sets, "ord"), "sets")
    blocks = sized.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("grams")) / (8 * BLOCK_GRAMS))).alias("blocks"))
    cut = sized.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("ord"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cut = cut.select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "ord", "root", "grams")
    return cut.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(ord, root, is the row of block x, sets) of each (group, x, y); rows come sorted, and one group's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    last = None

    def made():
        t = pa.Table.from_batches(held)
        get = lambda c: t.column(c).to_numpy()
        return get("ord"), get("root"), get("block") == get("x"), [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("grams")]

    for b in batches:
        key = np.stack([b.column(c).to_numpy() for c in ("group", "x", "y")])
        begins = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()] if b.num_rows else []
        for at, end in zip(begins, [*begins[1:], b.num_rows], strict=True):
            now = tuple(key[:, at].tolist())
            if held and now != last:
                yield made()
                held = []
            last = now
            held.append(b.slice(at, end - at))
    if held:
        yield made()


def forest(hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Pairs that connect what the similar pairs connect, one fewer than the members at most; rows and columns are the sides' numbers."""
    n = int(max(rows.max(initial=-1), columns.max(initial=-1))) + 1
    label = np.arange(n)
    while True:
        before = label.copy()
        to_row = np.where(hit, label[columns][None, :], n).min(axis=1, initial=n)
        np.minimum.at(label, rows, to_row)
        to_column = np.where(hit, label[rows][:, None], n).min(axis=0, initial=n)
        np.minimum.at(label, columns, to_column)
        label = label[label]
        if (label == before).all():
            at = np.flatnonzero(label != np.arange(n))
            return np.stack([at, label[at]], axis=1)


def _pairs_in_buckets(placed: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b) that connect the members of placed(group, ord, root) that share a bucket, differ in root and are similar by their whole sets."""

    def run(batches):
        for ords, roots, left, sets in _groups(batches):
            x = np.flatnonzero(left)
            y = np.flatnonzero(~left) if not left.all() else x
            if len(x) and len(y):
                hit = similar([sets[i] for i in x], [sets[i] for i in y], threshold) & (roots[x][:, None] != roots[y][None, :])
                found = forest(hit, x, y)
                yield pa.RecordBatch.from_arrays([pa.array(ords[found[:, 0]]), pa.array(ords[found[:, 1]])], names=["a", "b"])

    return materialize(_in_blocks(placed, docs, k).mapInArrow(run, "a bigint, b bigint").distinct(), "rest")


def _links(members: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(ord, n_links): to how many others of its group each of members(group, ord, root) is similar. Pairs are counted, not emitted."""

    def run(batches):
        for ords, _, left, sets in _groups(batches):
            if left.all():
                n = similar(sets, sets, threshold).sum(axis=1) - 1
            else:
                hit = similar([sets[i] for i in np.flatnonzero(left)], [sets[i] for i in np.flatnonzero(~left)], threshold)
                n = np.empty(len(ords), np.int64)
                n[left], n[~left] = hit.sum(axis=1), hit.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ords), pa.array(n.astype(np.int64))], names=["ord", "n"])

    return _in_blocks(members, docs, k).mapInArrow(run, "ord bigint, n bigint").groupBy("ord").agg(F.sum("n").alias("n_links"))


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each node's connected component, by alternating large-star and small-star (Kiveris et al., 2014)."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = _fingerprint(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        new = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(now)
        # edges that no star operation changes are a forest of stars: the end
        state, old = _fingerprint(new), state
        now = new
        if state == old:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(plain: DataFrame, threshold: float, k: int, coordinates: int, bands: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(exact copies (ord, rep, n_copies), similar documents (node, root) of the representatives, texts of all that share a bucket, documents (ord))."""
    # exact copies (equal words) share a content hash: only one of them goes on
    words = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    contents = materialize(plain.select("ord", F.when(words != "", F.unhex(F.left(F.sha2(words.cast("binary"), 256), F.lit(32)))).alias("content")), "contents")
    twice = contents.where("content is not null").groupBy("content").agg(F.min("ord").alias("rep"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    exact = materialize(contents.join(twice, "content").select("ord", "rep", (F.col("n_copies") - 1).alias("n_copies")), "exact")
    single = plain.join(exact.where("ord <> rep").select("ord"), "ord", "left_anti")
    found = materialize(_bands(single, k, coordinates, bands), "bands")
    buckets = found.groupBy("key").agg(F.min("ord").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialize(found.join(buckets, "key"), "members")
    discard(found)
    texts = materialize(single.join(members.select("ord").distinct(), "ord", "left_semi"), "texts")

    # each document against the first one of one of its buckets: linear, and it joins nearly all copies
    near_hub = members.where("ord <> hub").groupBy(F.col("ord").alias("b")).agg(F.min("hub").alias("a"))
    verified = materialize(_verify(near_hub.select("a", "b"), texts, k, threshold), "verified")
    comp = components(verified)

    # what still lies in different components of one bucket: every pair, inside the bucket
    placed = members.join(comp, members.ord == comp.node, "left").select("key", "ord", F.coalesce("root", "ord").alias("root"))
    per_key = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("ord").cast("decimal(38,0)")).alias("content")).where("lo <> hi")
    # buckets with the same members give the same pairs: one of them is enough
    mixed = per_key.groupBy("n", "content").agg(F.min("key").alias("key"))
    rest = _pairs_in_buckets(placed.join(mixed.select("key"), "key").withColumnRenamed("key", "group"), texts, k, threshold)
    joined = components(verified.unionByName(rest))
    for table in (members, verified, rest):
        discard(table)
    return exact, joined, texts, contents.select("ord")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, k: int = 3, coordinates: int = 128, bands: int = 32) -> DataFrame:
    """(doc_id, content, class_id, n_links, n_copies): one row for each document.

    class_id is the least doc_id of its group of near copies, its own without any; n_links the number of different texts it is similar to, n_copies
    that of other documents with the same words. Groups are the connected components of the pairs that share a band and whose sets of
    word k-grams have an exact Jaccard similarity >= threshold; links are all such pairs of a group, counted and never emitted. A pair of
    similarity s shares a band with probability 1 - (1 - s^(coordinates/bands))^bands: 0.99 at 0.6, over 0.9999 at 0.7. Rows equal in
    id and text are one document; rows that share only the id are different ones, told apart by content, the md5 of the text (NULL where no id
    recurs). Rows with a NULL id or NULL text have no row; texts without a word are in no group. Long texts are read whole; other
    columns, whatever their names, take no part. An empty table gives no row.
    """
    plain, names = numbered(docs, id_col, text_col)
    exact, comp, texts, all_ = _classes(plain, threshold, k, coordinates, bands)
    grouped = comp.select(F.col("root").alias("group"), F.col("node").alias("ord"), "root").unionByName(comp.select(F.col("root").alias("group"), F.col("root").alias("ord"), "root").distinct())
    links = _links(grouped, texts, k, threshold).withColumnRenamed("ord", "node").join(comp, "node", "left")
    out = all_.join(exact, "ord", "left").withColumn("node", F.coalesce("rep", "ord")).join(links, "node", "left")
    out = out.select("ord", F.coalesce("root", "node").alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("bigint").alias("n_copies"))
    first = F.col("class").alias("class_id") if names is None else F.col("class_id")
    if names is not None:
        out = out.join(names.select(F.col("ord").alias("class"), F.col("doc_id").alias("class_id")), "class")
    return named(out.select("ord", first, "n_links", "n_copies"), names)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, k: int = 3, coordinates: int = 128, bands: int = 32) -> DataFrame:
    """docs with only the first document of each group of near copies (see near_copies), by (id, md5 of the text); all columns stay.

    Of rows equal in id and text one stays, the least in its other columns. Rows that share only the id are different documents. Rows with a NULL id
    or text, and texts without a word, are in no group and stay. An empty table gives no row.
    """
    plain, names = numbered(docs, id_col, text_col)
    exact, comp, _, _ = _classes(plain, threshold, k, coordinates, bands)
    # a representative that follows another one takes its copies along
    gone = exact.where("ord <> rep").select("ord").unionByName(comp.select(F.col("node").alias("ord")))
    id_ = F.col(f"`{id_col}`").cast("bigint")
    if names is None:
        return docs.join(gone.select(F.col("ord").alias("__gone")), id_ == F.col("__gone"), "left_anti")
    content = F.md5(F.col(f"`{text_col}`").cast("string").cast("binary"))
    gone = named(gone, names).select(F.col("doc_id").alias("__gone"), F.col("content").alias("__content"))
    left = docs.join(gone, (id_ == F.col("__gone")) & (content == F.col("__content")), "left_anti")
    there = id_.isNotNull() & F.col(f"`{text_col}`").isNotNull()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.where(there).groupBy(id_.alias("__id"), content.alias("__content")).agg(F.min(whole).alias("__row")).select("__row.*")
    return once.unionByName(left.where(~there))
