"""Byte-pair merging of many words at once on ragged numpy arrays, and the exact split of a text into words.

The vocabulary is a file of ranks (base64 token, space, rank on each line); ranks are the ids. The result for a text is that of
merging, in each pre-token of the pattern below, the adjacent pair of least rank until no pair has one.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

DEFAULT_VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space beside another white-space character, or at the end: where there is none, a text can be cut before every space.
_BESIDE = regex.compile(r"\s (?:\s|\Z)")
_ALONE = regex.compile(r"(?<=\S) (?=\S)")
_STOPS = tuple(",.;:!?)")
_NONE = np.int64(1 << 40)
#: Characters of distinct pieces that a worker remembers; when full it starts anew. Longer pieces than LONG_PIECE are not remembered. Both
#: bound memory and have no influence on results.
CACHE_CHARS, LONG_PIECE = 3_000_000, 200
#: Bytes from which a word is merged by itself with a heap: steps that scan all of it would take quadratic time.
LONG_WORD = 600


def vocabulary_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(id of each byte, sorted pairs as left << 20 | right, the id each pair merges to, bytes of each id)."""
    ranks = vocabulary_file(path)
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a << 20 | b] = rank
    keys = np.array(sorted(pairs), np.int64)
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return np.array([ranks[bytes([i])] for i in range(256)], np.int64), keys, np.array([pairs[k] for k in keys.tolist()], np.int64), pieces


@lru_cache(2)
def _hashed(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The pairs in an open hash table: one or two probes are quicker than a binary search."""
    _, keys, ids, _ = vocabulary(path)
    bits = 20
    table_key, table_id = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
    at = _slot(keys, bits)
    probes = 0
    left = np.arange(len(keys))
    while len(left):
        free = table_key[at[left]] < 0
        slots, first = np.unique(at[left[free]], return_index=True)
        won = left[free][first]
        table_key[slots], table_id[slots] = keys[won], ids[won]
        left = np.setdiff1d(left, won, assume_unique=True)
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
        probes += 1
    return table_key, table_id, probes


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _ranks_of(keys: np.ndarray, path: str) -> np.ndarray:
    table_key, table_id, probes = _hashed(path)
    mask = len(table_key) - 1
    at = _slot(keys, 20)
    held = table_key[at]
    out = np.where(held == keys, table_id[at], _NONE)
    left = np.flatnonzero((held != keys) & (held >= 0))
    for _ in range(probes):
        if not len(left):
            break
        at[left] = (at[left] + 1) & mask
        held = table_key[at[left]]
        hit = held == keys[left]
        out[left[hit]] = table_id[at[left[hit]]]
        left = left[~hit & (held >= 0)]
    return out


@lru_cache(2)
def _pairs(path: str) -> dict[int, int]:
    _, keys, ids, _ = vocabulary(path)
    return dict(zip(keys.tolist(), ids.tolist(), strict=True))


def merge_long(word: bytes, path: str) -> list[int]:
    """The ids of one word: pairs wait in a heap by (rank, place), neighbours are linked."""
    symbols, pairs = vocabulary(path)[0][np.frombuffer(word, np.uint8)].tolist(), _pairs(path)
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(symbols[i] << 20 | symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = right[i]
        if symbols[i] < 0 or j >= n or pairs.get(symbols[i] << 20 | symbols[j]) != r:
            continue  # the pair has changed since
        symbols[i], symbols[j] = r, -1
        right[i] = after = right[j]
        if after < n:
            left[after] = i
            if (new := pairs.get(r << 20 | symbols[after])) is not None:
                heapq.heappush(heap, (new, i))
        if (before := left[i]) >= 0 and (new := pairs.get(symbols[before] << 20 | r)) is not None:
            heapq.heappush(heap, (new, before))
    return [s for s in symbols if s >= 0]


def merge_all(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each word): in each step every word applies its pair of least rank."""
    if long := [i for i, w in enumerate(words) if len(w) > LONG_WORD]:
        short, n = merge_all([w if len(w) <= LONG_WORD else b"" for w in words], path)
        ends = np.cumsum(n)
        parts, at = [], 0
        for i in long:
            one = np.array(merge_long(words[i], path), np.int64)
            parts += [short[at : ends[i]], one]
            at, n[i] = ends[i], len(one)
        return np.concatenate([*parts, short[at:]]), n
    byte_ids = vocabulary(path)[0]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_owner = [], []
    while len(symbols):
        inside = owner[1:] == owner[:-1]
        rank = np.full(len(symbols), _NONE)
        at = np.flatnonzero(inside)
        rank[at] = _ranks_of(symbols[at] << 20 | symbols[at + 1], path)
        starts = np.flatnonzero(np.concatenate([[True], ~inside]))
        least = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.append(starts, len(symbols)))
        active = np.repeat(least < _NONE, counts)
        if not active.all():  # finished words leave
            done_symbols.append(symbols[~active])
            done_owner.append(owner[~active])
            if not active.any():
                break
        chosen = (rank == np.repeat(least, counts)) & active
        if (chosen[1:] & chosen[:-1]).any():  # a pair of equal symbols in a row of them: every other one, from the left
            where = np.arange(len(chosen))
            opened = np.maximum.accumulate(np.where(chosen & ~np.concatenate([[False], chosen[:-1]]), where, -1))
            chosen &= (where - opened) % 2 == 0
        hit = np.flatnonzero(chosen)
        symbols = symbols.copy()
        symbols[hit] = rank[hit]
        keep = active
        keep[hit + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if not done_owner:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.bincount(owner, minlength=len(words))


def pieces_of(text: str) -> list[str]:
    """Stretches of the text that are pre-tokenized apart without changing the result; all but the first lack their leading space.

    A pre-token holds a space only at its begin, or in a run of white space that goes on around it. So the text is cut before each space that has
    no other white space beside it.
    """
    return _ALONE.split(text) if _BESIDE.search(text) else text.split(" ")


def pre_tokens(lead: str, piece: str) -> list[str]:
    """The pre-tokens of a piece with its leading space or none."""
    if piece.isalpha():  # one run of letters is one
        return [lead + piece]
    if piece[-1:] in _STOPS and piece[:-1].isalpha():
        return [lead + piece[:-1], piece[-1]]
    return _SPLIT.findall(lead + piece)


def cut_texts(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the pieces of all texts, where each text's pieces begin and the last one's end, number in texts of each text): pieces_of(), in bulk.

    Texts without white space beside a space come first; those are cut outside Python.
    """
    plain = [not _BESIDE.search(t) for t in texts]
    order = np.array([i for i, p in enumerate(plain) if p] + [i for i, p in enumerate(plain) if not p], np.int64)
    easy = pc.split_pattern(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.large_string()), " ")
    hard = [_ALONE.split(t) for t, p in zip(texts, plain, strict=True) if not p]
    flat = pa.concat_arrays([easy.flatten(), pa.array([x for h in hard for x in h], pa.large_string())])
    sizes = np.concatenate([pc.list_value_length(easy).to_numpy(), np.array([len(h) for h in hard], np.int64)]).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]), order


class Merger:
    """Remembers the pieces it has merged: how many ids each has and, unless only counts are asked for, which."""

    def __init__(self, path: str, dtype: str | None = None, known=None):
        self.path, self.dtype, self.known = path, dtype, known
        self._forget()

    def _forget(self) -> None:
        self.head: dict[str, int] = {}  # piece -> its number
        self.body: dict[str, int] = {}
        self.chars = 0
        self.n = np.empty(0, np.int64)  # ids of each piece
        self.store = np.empty(0, self.dtype or np.uint8)  # ids of all pieces, one after the other

    def _add(self, new: list[str], lead: str) -> None:
        words: list[str] = []
        n_words = np.empty(len(new), np.int64)
        for i, piece in enumerate(new):
            w = pre_tokens(lead, piece)
            n_words[i] = len(w)
            words += w
        position = {w: i for i, w in enumerate(dict.fromkeys(words))}
        coded = [w.encode("utf-8", "surrogatepass") for w in position]
        ids, counts = self.known(coded, self.path) if self.known else merge_all(coded, self.path)
        which = np.fromiter(map(position.__getitem__, words), np.int64, len(words))
        n = counts[which]
        total = np.concatenate([[0], np.cumsum(n)])
        self.n = np.concatenate([self.n, np.diff(total[np.concatenate([[0], np.cumsum(n_words)])])])
        if self.dtype is not None:
            self.store = np.concatenate([self.store, ids[_spread(np.cumsum(counts) - counts, counts, which)].astype(self.dtype)])

    def _numbers(self, flat: pa.Array, begins: np.ndarray) -> tuple[np.ndarray, list[tuple[dict, str]], int]:
        """(the number of each piece, pieces too long to be remembered, how many pieces there were before those)."""
        first = np.zeros(len(flat), bool)
        first[begins[:-1]] = True
        out, long = np.empty(len(flat), np.int64), []
        sides = []
        for cache, lead, mask in ((self.head, "", first), (self.body, " ", ~first)):
            coded = flat.filter(pa.array(mask)).dictionary_encode()
            pieces = coded.dictionary.to_pylist()
            new = [p for p in pieces if p not in cache]
            long += [(cache, lead, p) for p in new if len(p) > LONG_PIECE]
            short = [p for p in new if len(p) <= LONG_PIECE]
            if short:
                cache.update(zip(short, range(len(self.n), len(self.n) + len(short)), strict=True))
                self._add(short, lead)
                self.chars += sum(map(len, short))
            sides.append((cache, mask, pieces, coded.indices.to_numpy()))
        kept = len(self.n)
        for lead in ("", " "):
            if some := [p for _, x, p in long if x == lead]:
                (self.body if lead else self.head).update(zip(some, range(len(self.n), len(self.n) + len(some)), strict=True))
                self._add(some, lead)
        for cache, mask, pieces, which in sides:
            if len(which):
                out[mask] = np.fromiter(map(cache.__getitem__, pieces), np.int64, len(pieces))[which]
        return out, [(cache, p) for cache, _, p in long], kept

    def _end(self, long: list[tuple[dict, str]], kept: int) -> None:
        for cache, p in long:
            del cache[p]
        if self.dtype is not None:
            self.store = self.store[: int(self.n[:kept].sum())]
        self.n = self.n[:kept]
        if self.chars > CACHE_CHARS:
            self._forget()

    def counts(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        flat, begins, order = cut_texts(texts)
        numbers, long, kept = self._numbers(flat, begins)
        total = np.concatenate([[0], np.cumsum(self.n[numbers])])
        out = np.empty(len(texts), np.int64)
        out[order] = total[begins[1:]] - total[begins[:-1]]
        self._end(long, kept)
        return out.tolist()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        flat, begins, order = cut_texts(texts)
        numbers, long, kept = self._numbers(flat, begins)
        ids = self.store[_spread(np.cumsum(self.n) - self.n, self.n, numbers)]
        total = np.concatenate([[0], np.cumsum(self.n[numbers])])[begins].tolist()
        self._end(long, kept)
        out: list = [None] * len(texts)
        for i, a, b in zip(order.tolist(), total[:-1], total[1:], strict=True):
            out[i] = ids[a:b]
        return out


def _spread(begin: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places begin[w] .. begin[w] + n[w] - 1 for each w of which, one after the other."""
    n = n[which]
    return np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())


@lru_cache(2)
def _library(path: str):
    import tiktoken

    pieces = vocabulary_file(path)
    return tiktoken.Encoding("ranks", pat_str=_SPLIT.pattern, mergeable_ranks=pieces, special_tokens={})


class LibraryMerger(Merger):
    """The same results by the tiktoken library; for operators whose subject isn't tokenization."""

    def counts(self, texts: list[str]) -> list[int]:
        encode = _library(self.path).encode_ordinary
        return [len(encode(t)) for t in texts]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        encode = _library(self.path).encode_ordinary
        return [np.array(encode(t), self.dtype) for t in texts]


_mergers: dict = {}


def merger(path: str, dtype: str | None = None, kind: type = Merger) -> Merger:
    """The worker's own Merger; it outlives a task."""
    if (key := (path, dtype, kind)) not in _mergers:
        _mergers[key] = kind(path, dtype)
    return _mergers[key]
