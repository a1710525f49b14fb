"""Each operator against a brute-force version, an exact round trip, or SQL, and on rows with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import struct
import subprocess
import sys
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import audio, balltree, common, huffman, language, lexicon, merges, nearcopies, packing, replytree, suffixes, tokencount

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key int, bin_id int"
VOCABULARY = merges.DEFAULT_VOCABULARY


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), "clash", 1, 2)


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, a shared passage, nulls, empties, a long text, and repeated rows."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, other = text(120), text(70), text(90)
    near = base.split()
    near[10], near[60] = "changed", "words"
    rows = [row(1, base), row(2, " ".join(near)), row(3, base), row(4, text(40) + " " + passage + " " + text(40)), row(5, text(30) + "\n" + passage + "  " + text(20)), row(6, other), row(7, other.upper(), "de"), row(8, None), row(9, ""), row(10, " \n\t "), row(11, "Von."), row(12, "Von."), row(None, base), row(None, None)]
    rows += [row(13, text(30_000)), row(14, "a a a a " * 40), row(15, "12 34 !! ??"), row(16, passage), row(17, "été naïve 日本語 " + text(60), None), row(6, other)]
    # one id with several texts: an own passage, a copy of it, an exact copy of another document
    own = text(75)
    rows += [row(18, "zzz " + text(80)), row(18, "aaa " + own + " " + text(30)), row(18, base), row(19, text(20) + " " + own)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts_of(docs):
    """(doc_id, md5 of the text) -> text: the different documents."""
    return {(r.doc_id, hashlib.md5(r.text.encode()).hexdigest()): r.text for r in docs.collect() if r.doc_id is not None and r.text is not None}


# 1, 7: byte-pair encoding


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aab \n\té'sl1!日ßT", max_size=30), min_size=1, max_size=8))
def test_merging_is_that_of_the_library(texts):
    want = [merges._library(VOCABULARY).encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in merges.Merger(VOCABULARY, "<u2").ids(texts)] == want
    assert merges.Merger(VOCABULARY).counts(texts) == merges.LibraryMerger(VOCABULARY).counts(texts) == [len(w) for w in want]


def test_merging_step_by_step():
    ranks = merges.vocabulary_file(VOCABULARY)

    def slow(w):
        parts = [bytes([b]) for b in w]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = [b"aaaaaaa", b"abababab", b" hello", b"\xff\xfe", "naïveté".encode(), b"the" * 9, b"x"]
    ids, n = merges.merge_all(words, VOCABULARY)
    assert ids.tolist() == [x for w in words for x in slow(w)] and n.tolist() == [len(slow(w)) for w in words]


def test_token_counts(spark, docs, none):
    enc = merges._library(VOCABULARY)
    want = sorted((r.doc_id or -1, -1 if r.text is None else len(enc.encode_ordinary(r.text))) for r in docs.collect())
    for library in (False, True):
        got = tokencount.token_counts(docs, library=library).collect()
        assert sorted((r.doc_id or -1, -1 if r.n_tokens is None else r.n_tokens) for r in got) == want
    assert tokencount.token_counts(none).count() == 0


def test_long_words_take_no_quadratic_time():
    r = random.Random(9)
    word = "".join(r.choice("abcdefghij") for _ in range(200_000))
    began = time.time()
    ids = merges.merge_long(word.encode(), VOCABULARY)
    assert time.time() - began < 60 and ids == merges._library(VOCABULARY).encode_ordinary(word)
    mixed = ["x " + word[:900] + " y", word[:601], word[:600], "", "a"]
    assert merges.Merger(VOCABULARY).counts(mixed) == merges.LibraryMerger(VOCABULARY).counts(mixed)


def test_workers_remember_little():
    """Indented code is cut into pieces, and neither they nor long words stay in memory without bound."""
    r = random.Random(4)
    m = merges.Merger(VOCABULARY, "<u2")
    for i in range(40):
        code = "\n".join(" " * (4 * r.randrange(4)) + f"x{r.random()} = f(y{i}, {r.random()})" for _ in range(2_000))
        text = code + " " + "".join(r.choice("abc") for _ in range(3000))
        assert m.ids([text])[0].tolist() == merges._library(VOCABULARY).encode_ordinary(text)
        held = [*m.head, *m.body]
        assert sum(map(len, held)) <= merges.CACHE_CHARS + 400_000 and max(map(len, held), default=0) <= merges.LONG_PIECE


def test_lexicon_is_minimal():
    words = sorted(w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "", "p", "zz"))
    edges, final = lexicon.minimal_automaton(words)
    seen, stack, accepted = set(), [(0, b"")], []
    while stack:
        s, w = stack.pop()
        seen.add(s)
        accepted += [w] if final[s] else []
        stack += [(t, w + bytes([b])) for b, t in edges[s].items()]
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    assert sorted(accepted) == words and len(seen) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})
    lex = lexicon.compile_lexicon(words, VOCABULARY)
    assert lexicon.look_up([*words, b"to", b"x", b"tapss"], lex).tolist() == [*range(len(words)), -1, -1, -1]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(max_size=5), max_size=30), st.lists(st.binary(max_size=5), max_size=20))
def test_lexicon_looks_up_exactly(words, asked):
    words = sorted(words)
    assert lexicon.look_up(asked, lexicon.compile_lexicon(words, VOCABULARY)).tolist() == [words.index(w) if w in words else -1 for w in asked]


def test_bpe_round_trip(spark, docs, none):
    enc = merges._library(VOCABULARY)
    for size in (0, 5, 50_000):
        coded = lexicon.encode(docs, lexicon_words=size)
        assert sorted((r.doc_id or -1, r.ids or []) for r in coded.collect()) == sorted((r.doc_id or -1, enc.encode_ordinary(r.text or "")) for r in docs.collect())
        assert all(r.restored for r in coded.collect() if r.ids is not None)
    assert sorted((r.doc_id or -1, r.text or "") for r in lexicon.decode(coded).collect()) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert {r.doc_id for r in coded.collect() if r.ids is None} == {8, None}
    assert lexicon.encode(none).count() == 0


# 2: reply trees


def test_reply_trees(spark):
    r = random.Random(3)
    rows = []
    for conv in range(12):
        n = r.randint(1, 40)
        for i in range(n):
            parent = r.choice([None, i - 1, r.randrange(i)]) if i else r.choice([None, 999])
            rows.append((conv, i, parent, r.choice(["user", None]), r.choice(["x", None, ""]) or "", r.choice([None, 1.0, 2.0])))
    rows += [(50, 1, 2, "user", "a", 1.0), (50, 2, 1, "user", "b", 1.0), (50, 3, 1, "user", "c", 9.0), (None, 1, None, "u", "t", 1.0), (51, None, None, "u", "t", 1.0), (52, 1, None, None, None, None), (52, 1, None, None, None, None)]
    rows += [(53, i, i - 1 if i else None, "user", "long " * 40_000 if i == 3 else "x", None) for i in range(70)]
    schema = "conv_id int, turn int, parent int, role string, text string, score double"
    at = {}
    for x in rows:
        if x[0] is not None and x[1] is not None:
            at[x[:2]] = x
    want = []
    for conv in {c for c, _ in at}:
        own = {i: x for (c, i), x in at.items() if c == conv}
        paths = defaultdict(list)
        for leaf in own.keys() - {x[2] for x in own.values()}:
            path, seen = [leaf], {leaf}
            while (p := own[path[-1]][2]) in own and p not in seen:
                path.append(p)
                seen.add(p)
            if own[path[-1]][2] in own:
                continue
            scores = [own[i][5] for i in path if own[i][5] is not None]
            paths[path[-1]].append((-(sum(scores) / len(scores) if scores else 0.0), leaf, path))
        for root, found in paths.items():
            for rank, (s, leaf, path) in enumerate(sorted(found)[:2], 1):
                text = "\n".join(f"<|im_start|>{own[i][3] or 'user'}\n{own[i][4] or ''}<|im_end|>" for i in reversed(path))
                want.append((conv, root, leaf, rank, len(path), round(-s, 9) + 0.0, text))
    # columns whose names the operator uses itself
    table = spark.createDataFrame(rows, schema).selectExpr("*", "1 as conv", "2 as leaf", "'x' as node", "3 as dist", "4 as root", "5 as branch", "6 as size", "7 as up")
    got = replytree.chosen_conversations(table, branches=2).collect()
    assert sorted((*r[:5], round(r[5], 9) + 0.0, r[6]) for r in got) == sorted(want)
    assert replytree.chosen_conversations(spark.createDataFrame([], schema)).count() == 0


# 3: audio


def test_resampling_by_definition():
    x = np.random.default_rng(1).normal(size=300).astype(np.float32)
    for rate, target in ((11_025, 8_000), (8_000, 16_000), (48_000, 8_000)):
        g = math.gcd(rate, target)
        up, down = target // g, rate // g
        bank = audio._bank(up, down)
        width = bank.shape[1] // 2
        y = audio.resample(lambda a, b: x[a:b], len(x), rate, target)
        assert len(y) == -(-len(x) * up // down)
        for n in range(0, len(y), 17):
            at, phase = n * down // up, n * down % up
            want = sum(float(bank[phase, j]) * float(x[at - width + 1 + j]) for j in range(2 * width) if 0 <= at - width + 1 + j < len(x))
            assert abs(want - y[n]) < 1e-4
    tone = np.sin(2 * np.pi * 440 * np.arange(11_025) / 11_025)
    assert np.abs(audio.resample(lambda a, b: tone[a:b], len(tone), 11_025, 8_000) - np.sin(2 * np.pi * 440 * np.arange(8_000) / 8_000))[100:-100].max() < 1e-3


def test_blocks_give_what_the_whole_gives(monkeypatch):
    x = np.random.default_rng(3).normal(size=9_000).astype(np.float32)
    pairs = ((11_025, 8_000), (44_100, 8_000), (8_000, 8_000))
    whole = [audio.resample(lambda a, b: x[a:b], len(x), *p) for p in pairs]
    mel = audio.log_mel(x, 8_000)
    monkeypatch.setattr(audio, "WORK", 2_000)
    assert all(np.allclose(audio.resample(lambda a, b: x[a:b], len(x), *p), w, atol=1e-6) for p, w in zip(pairs, whole, strict=True))
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(audio.log_mel(x, 8_000), mel, strict=True))


def test_log_mel_by_definition():
    x = np.random.default_rng(2).normal(size=700).astype(np.float32)
    mel, energy = audio.log_mel(x, 8_000)
    assert mel.shape == (8, 32)
    frame = np.zeros(256)
    frame[:200] = np.pad(x, (0, 200))[80 * 3 : 80 * 3 + 200] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(200) / 200))
    power = np.array([abs(sum(frame[n] * np.exp(-2j * np.pi * k * n / 256) for n in range(256))) ** 2 for k in range(129)])
    assert np.allclose(mel[3], np.log(power @ audio._filters(8_000, 256, 32) + 1e-6), atol=1e-3)
    assert abs(energy[3] - 10 * np.log10((x[240:440] ** 2).mean() + 1e-10)) < 1e-3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=40))
def test_hysteresis(values):
    state, want = False, []
    for v in values:
        state = v >= 2 or (state and v >= -1)
        want.append(state)
    assert audio.hysteresis(np.array(values, float), 2, -1).tolist() == want


def wave(x, coding, bits, rate=8000, channels=1, extensible=False):
    kind = {(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}.get((coding, bits))
    if coding == 3:
        body = x.astype(kind).tobytes()
    elif bits == 8:
        body = np.round((x + 1) * 127.5).astype("u1").tobytes()
    elif bits == 24:
        body = b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x)
    else:
        body = (x * 2 ** (bits - 1)).astype(kind or "u1").tobytes()
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else coding, channels, rate, rate * bits // 8, bits // 8, bits)
    if extensible:
        head += struct.pack("<HHIH", 22, bits, 0, coding) + b"\0" * 14
    return b"RIFF" + struct.pack("<I", 28 + len(head) + len(body)) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body


def test_wave_codings():
    x = (np.sin(np.arange(2000) / 5) * 0.6).astype(np.float64)
    for coding, bits, tolerance in ((1, 8, 0.01), (1, 16, 1e-4), (1, 24, 1e-6), (1, 32, 1e-6), (3, 32, 1e-6), (3, 64, 1e-6)):
        for extensible in (False, True):
            clip = audio.Clip(wave(x, coding, bits, extensible=extensible), 1)
            assert clip.status == "ok" and clip.length == 2000 and clip.rate == 8000 and np.abs(clip.read(0, 2000) - x).max() < tolerance
    assert audio.Clip(wave(x, 1, 16, rate=100_000_007), 1).status == "1 channels at rate 100000007"
    assert audio.Clip(wave(x, 7, 8), 1).status == "coding 7 of 8 bits"
    assert audio.Clip(wave(x, 1, 16)[:38], 1).status == "no data" and audio.Clip(b"", 1).status == "empty"


def test_audio_rows(spark, monkeypatch):
    # ordinary loudness with an offset, half of it silence
    x = np.sin(np.arange(9000) / 5) * 0.1 * (np.arange(9000) < 4500) + 0.3
    wav = wave(x, 1, 16)
    clips = spark.createDataFrame([(1, bytearray(wav), 1), (2, None, 1), (3, bytearray(b""), 1), (4, bytearray(b"\x80" * 3), 1), (4, bytearray(b"\x80" * 3), 1), (None, bytearray(b"abc"), 1), (5, bytearray(wav[:38]), 1), (6, bytearray(wave(x, 1, 16, rate=100_000_007)), 1)], "clip bigint, payload binary, part int")
    out = common.materialize(audio.audio_features(clips, "clip", "payload"), "audio")
    rows = out.collect()
    assert Counter((r.id, r.status) for r in rows) == {(1, "ok"): 1, (3, "empty"): 1, (4, "ok"): 2, (None, "ok"): 1, (5, "no data"): 1, (6, "1 channels at rate 100000007"): 1}
    one = next(r for r in rows if r.id == 1)
    assert (one.n_frames, one.n_windows, one.start_s, one.end_s) == (111, 2, 0, 1.11)
    assert [(s.start_s, round(s.end_s, 1)) for s in one.segments] == [(0.0, 0.6)]
    table = audio.tensors(bytes(one.tensors))
    assert table.schema.field("features").type == audio.TENSOR and table.column("n_frames").to_pylist() == [64, 47] and table.column("end_s").to_pylist() == [0.64, 1.11]
    every = audio.windows(out).collect()
    assert Counter(r.id for r in every) == {1: 2, 4: 2, None: 1} and all(len(r.features) == 64 * 32 for r in every)
    mel = audio.log_mel(audio.resample(audio.Clip(wav, 1).centred(), 9000, 8000, 8000), 8000)[0]
    got = np.concatenate([np.reshape(r.features, (64, 32)) for r in sorted((r for r in every if r.id == 1), key=lambda r: r.window)])
    assert np.allclose(got[:111], mel, atol=1e-4) and not got[111:].any()
    monkeypatch.setattr(audio, "WINDOWS", 1)
    parts = list(audio.clip_features(wav, 1, 8000, 12, 18, -60))
    assert [(p[0], p[2], p[3], p[4], p[5]) for p in parts] == [(0, 0.0, 0.64, 64, 1), (1, 0.64, 1.11, 47, 1)] and audio.tensors(parts[1][6]).column("window").to_pylist() == [1]
    assert audio.audio_features(clips.limit(0), "clip", "payload").count() == 0


def test_bounded_memory():
    """An hour of sound, a text of 20 MB and a word of 2 MB each in a process of limited size."""
    code = """
import resource, sys, numpy as np
from codeloom.llm import audio, huffman, merges
sys.path.insert(0, {here!r})
from test_operators import wave
limit = 4 << 30
resource.setrlimit(resource.RLIMIT_AS, (limit, limit))
hour = bytearray(44 + 2 * 16_000 * 3600)
hour[:44] = wave(np.zeros(0), 1, 16, rate=16_000)[:44]
hour[40:44] = (len(hour) - 44).to_bytes(4, "little")
rows = list(audio.clip_features(hour, 1, 8000, 12, 18, -60))
assert sum(r[4] for r in rows) == 359_999, sum(r[4] for r in rows)
del hour, rows
merger = merges.Merger(merges.DEFAULT_VOCABULARY, "<u2")
text = "some words of a text, and\\n    indented lines " * 430_000
ids = merger.ids([text])[0].astype(np.int32)
lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16), 18)
payload, at, bits, offsets, blocks = huffman.encode_rows(ids, np.array([0, len(ids)]), lengths.astype(np.int64), huffman.canonical_codes(lengths), 512)
assert (huffman.Decoder(lengths).blocks(payload, offsets, huffman.block_sizes(np.array([len(ids)]), 512)) == ids).all()
assert len(merges.merge_long(b"ab" * 1_000_000, merges.DEFAULT_VOCABULARY)) > 0
"""
    here = __file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code.format(here=here)], check=True, cwd=here.rsplit("/", 2)[0], env={"PYTHONPATH": here.rsplit("/", 2)[0], "PATH": "/usr/bin:/bin", "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}, timeout=300)


# 4: Huffman


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(6, 20))
def test_code_lengths(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = [c for c in counts if c]
    assert [bool(x) for x in lengths] == [bool(c) for c in counts] and max(lengths, default=0) <= limit
    if len(used) > 1:
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1
        heap, cost = sorted(used), 0
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        total = int((lengths.astype(int) * np.array(counts)).sum())
        assert total >= cost and (limit < 20 or total == cost)


@pytest.mark.parametrize("counts", [[1, 1, 2, 4, 8], [1, 2, 4, 8, 16, 32], [5, 5, 5]])
def test_limited_lengths_are_optimal(counts):
    for limit in range(max(1, math.ceil(math.log2(len(counts)))), 6):
        best = min(sum(a * b for a, b in zip(x, counts, strict=True)) for x in itertools.product(range(1, limit + 1), repeat=len(counts)) if sum(2.0**-i for i in x) <= 1)
        assert int((huffman.code_lengths(np.array(counts), limit).astype(int) * counts).sum()) == best


def test_huffman_round_trip(spark, docs, none):
    ids = common.materialize(huffman.token_ids(docs), "ids")
    coded, lengths = huffman.compress(ids, limit=14, block=100)
    coded = common.materialize(coded, "coded")
    want = sorted((r.doc_id or -1, [] if r.ids is None else np.frombuffer(bytes(r.ids), "<u2").tolist()) for r in ids.collect())
    assert sorted((r.doc_id or -1, r.ids or []) for r in huffman.expand(coded, lengths, 100).collect()) == want
    assert {r.doc_id for r in coded.collect() if r.n_ids is None} == {8, None}
    long = coded.where("doc_id = 13").first()
    d = huffman.Decoder(lengths)
    whole = dict(want)[13]
    assert all(r.restored for r in coded.collect() if r.n_ids is not None)
    # one block alone, from its checkpoint
    assert d.blocks(bytes(long.payload), np.array(long.block_bits[7:8]), np.array([100])).tolist() == whole[700:800]
    stored = common.materialize(huffman.archive(docs, limit=15, block=64), "archive")
    assert sorted((r.doc_id or -1, r.ids or []) for r in huffman.restore(stored, 64).collect()) == want
    empty, zero = huffman.compress_texts(none)
    assert empty.count() == 0 and not zero.any()
    assert [r.kind for r in huffman.archive(none).collect()] == ["book"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=30), max_size=8), st.integers(1, 7))
def test_rows_and_blocks(rows, block):
    ids = np.array([x for r in rows for x in r], np.int32)
    begins = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=41), 9)
    codes = huffman.canonical_codes(lengths)
    payload, at, bits, offsets, blocks = huffman.encode_rows(ids, begins, lengths.astype(np.int64), codes, block)
    for i, r in enumerate(rows):
        text = "".join(format(codes[x], f"0{lengths[x]}b") for x in r)
        assert bits[i] == len(text)
        got = "".join(format(b, "08b") for b in payload[at[i] : at[i + 1]])
        assert got[: len(text)] == text and not got[len(text) :].strip("0") and len(got) - len(text) < 8
        assert offsets[blocks[i] : blocks[i + 1]].tolist() == [sum(int(lengths[x]) for x in r[:b]) for b in range(0, len(r), block)]


# 5: repeated passages


def brute_spans(texts, size):
    where = defaultdict(list)
    for i in sorted(texts):
        w = texts[i].split()
        for a in range(len(w) - size + 1):
            where[tuple(w[a : a + size])].append((i, a))
    out = set()
    for later in (False, True):
        per = defaultdict(list)
        for occ in where.values():
            if len(occ) > 1:
                for i, a in occ[1:] if later else occ[:1]:
                    per[i].append(a)
        for i, at in per.items():
            spans = []
            for a in sorted(at):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + size
                else:
                    spans.append([a, a + size])
            out |= {(i, later, *s) for s in spans}
    return out


@pytest.mark.parametrize(("size", "k"), [(50, 16), (5, 1), (5, 5), (3, 2)])
def test_repeated_spans(spark, docs, none, size, k):
    got = {((r.doc_id, r.content), r.later, r.start_word, r.end_word) for r in suffixes.repeated_spans(docs, words=size, k=k).collect()}
    assert got == brute_spans(texts_of(docs), size)
    assert suffixes.repeated_spans(none).count() == 0


def test_repeated_spans_of_unique_ids_and_long_texts(spark, monkeypatch):
    """A passage in every document, a text of many stretches, and ids that don't recur."""
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {i: " ".join(f"w{r.random()}" for _ in range(r.randint(0, 60))) + " " + passage + " " + " ".join(f"w{r.random()}" for _ in range(30)) for i in range(-60, 60)}
    long = " ".join(f"l{r.randrange(10**9)}" for _ in range(3_000))
    texts |= {100: long, 101: "x " + long[500:], 102: " ".join(long.split()[700:800])}
    got = {(x.doc_id, x.later, x.start_word, x.end_word) for x in suffixes.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == brute_spans(texts, 50)
    # stretches: the same runs, cut elsewhere
    words, begins = common.word_hashes(__import__("pyarrow").array([long, "a b"]), suffixes._KEYS)
    monkeypatch.setattr(suffixes, "STRETCH", 500)
    windows = [(i, at + j) for w, b, first, at in suffixes._stretches(words, begins, 50) for t, s, n, *_ in zip(*suffixes._runs(w, b, 50, 16), strict=True) for i, j in [(first + t, s + x) for x in range(n)]]
    assert sorted(windows) == [(0, x) for x in range(3_000 - 49)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 12))
def test_least(values, span):
    v = np.array(values, np.uint64)
    if len(v) >= span:
        assert suffixes._least(v, span).tolist() == [i + int(v[i : i + span].argmin()) for i in range(len(v) - span + 1)]


def without(text, cuts):
    """The words that are in no cut."""
    return [w for n, w in enumerate(text.split()) if not any(a <= n < b for a, b in cuts)]


def test_dropped_repeats(spark, docs, none):
    texts, spans = texts_of(docs), brute_spans(texts_of(docs), 50)
    out = suffixes.drop_repeats(docs)
    assert out.columns == docs.columns
    want = Counter()
    for x in docs.collect():
        if x.doc_id is None or x.text is None:
            want[x.doc_id, x.text] += 1
            continue
        key = (x.doc_id, hashlib.md5(x.text.encode()).hexdigest())
        cuts = [(a, b) for j, later, a, b in spans if j == key and later]
        if not cuts or without(texts[key], cuts):
            want[x.doc_id, " ".join(without(x.text, cuts)) if cuts else x.text] += 1
    got = [r for r in out.collect()]
    cut_ids = {j for j, later, *_ in spans if later}
    assert Counter((r.doc_id, r.text if (r.doc_id, r.text) in want else " ".join(r.text.split())) for r in got) == want
    assert all(len(r.text) == r.n_chars for r in got if r.text is not None) and any(i[0] == 18 for i in cut_ids | set(texts))
    assert suffixes.drop_repeats(none).count() == 0


def test_texts_are_cut_once(spark, docs):
    """One Python node: with two in a stage each task holds two workers, which stay."""
    for table in (docs, docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        plan = suffixes.drop_repeats(table)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan, plan


# 6: languages


def brute_grams(text):
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(runs) + " "
    return Counter(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if not ((g := padded[i : i + n]).isspace() or (n == 3 and g[1] == " ")))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abé ,.\n1ßЖ", max_size=40))
def test_grams(text):
    keys, counts = np.unique(language.gram_keys(text), return_counts=True)
    want = brute_grams(text) if any(c.isalpha() for c in text) else {}
    assert {language.as_text(int(k)): n for k, n in zip(keys, counts, strict=True)} == dict(want)
    order = sorted(want, key=lambda g: (-want[g], [ord(c) for c in g]))[:7]
    assert [language.as_text(int(k)) for k in language.ranked(language.gram_keys(text), 7)] == order


def test_identify(spark, docs, none):
    profiles = language.train_profiles(docs, profile_size=50)
    assert set(profiles) == {"en", "de"}
    rows = language.identify(docs, profiles, profile_size=50).collect()
    assert len(rows) == docs.count()
    rejected = {r.doc_id for r in rows if r.rejected}
    assert {8, 9, 10, 15} <= rejected and not {1, 2, 3, 4, 6, 13} & rejected
    kept = language.keep_identified(docs, profiles, profile_size=50)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == {r.doc_id for r in rows if not r.rejected} - {None}
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = {n: [language.as_text(int(k)) for k in p] for n, p in profiles.items()}
    for r in rows:
        if r.doc_id in (1, 4, 7, 17):
            g = brute_grams(texts[r.doc_id])
            top = sorted(g, key=lambda x: (-g[x], [ord(c) for c in x]))[:50]
            far = {n: sum(abs(i - p.index(x)) if x in p else 50 for i, x in enumerate(top)) for n, p in names.items()}
            assert (r.distance, r.predicted) == min((v, n) for n, v in far.items())
    assert language.train_profiles(none) == {} and language.identify(none, profiles).count() == 0
    assert all(r.rejected for r in language.identify(docs, {}).collect())


def test_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    rows = language.identify(held, language.train_profiles(train)).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.predicted == r.lang for r in rows) >= 0.98 * len(rows) and not any(r.rejected for r in rows)


# 8: packing


def brute_pack(sizes, capacity):
    gaps: list[int] = []  # of each bin
    touched: list[int] = []
    where, clock = [], 0

    def squares(g):
        return sum(n * n for v, n in Counter(g).items() if 0 < v < capacity)

    for s in sizes:
        choices = []
        for gap in sorted({g for g in gaps if s <= g < capacity}):
            b = max((i for i, g in enumerate(gaps) if g == gap), key=lambda i: touched[i])
            choices.append((squares([*gaps[:b], gap - s, *gaps[b + 1 :]]), gap, b))
        choices.append((squares([*gaps, capacity - s]), capacity, len(gaps)))
        _, gap, b = min(choices)
        clock += 1
        if b == len(gaps):
            gaps.append(capacity)
            touched.append(0)
        where.append((b, capacity - gaps[b]))
        gaps[b] -= s
        touched[b] = clock
    return where


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares(sizes):
    bins, offsets = packing.sum_of_squares(np.array(sizes, np.int64), 12)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == brute_pack(sizes, 12)


def check_packed(rows, texts, capacity, encode):
    """texts: a list of (doc_id, text); every part of every document lies in one sequence, in order."""
    left = Counter((i, tuple(encode(t))) for i, t in texts if encode(t))
    parts = defaultdict(list)
    for r in rows:
        assert r.n_tokens == len(r.ids) <= capacity and r.bin_offsets[0] == 0 and len(r.doc_ids) == len(r.token_starts) == len(r.bin_offsets)
        for i, start, a, b in zip(r.doc_ids, r.token_starts, r.bin_offsets, [*r.bin_offsets[1:], r.n_tokens], strict=True):
            assert a < b
            parts[i].append((start, tuple(r.ids[a:b])))
    assert len({r.bin_id for r in rows}) == len(rows)
    for (i, ids), n in left.items():
        for _ in range(n):
            for at in range(0, len(ids), capacity):
                parts[i].remove((at, ids[at : at + capacity]))
    assert not any(parts.values())


def test_pack(spark, docs, none):
    encode = merges._library(VOCABULARY).encode_ordinary
    r = random.Random(3)
    more = spark.createDataFrame([row(i, " ".join(r.choice(["one", "two", "three", "unübersichtlich"]) for _ in range(r.randint(1, 200)))) for i in range(200, 500)] + [row(600, "word " * 5000)], SCHEMA)
    table = docs.unionByName(more)
    texts = [(x.doc_id, x.text) for x in table.collect() if x.doc_id is not None and x.text is not None]
    for shard_tokens in (10**9, 5_000):
        rows = packing.pack(table, capacity=256, shard_tokens=shard_tokens).collect()
        check_packed(rows, texts, 256, encode)
        assert len(rows) <= 1.15 * sum(x.n_tokens for x in rows) / 256 + 2 * len({x.bin_id >> 32 for x in rows})
    # the rests of one shard lie where the definition puts them
    rest = sorted((i, np.array(ids[len(ids) // 256 * 256 :], "<u2").tobytes()) for i, t in texts if len(ids := encode(t)) % 256)
    rows = {x.bin_id: x for x in packing.pack(table, capacity=256, shard_tokens=10**9).collect()}
    for (i, raw), (b, at) in zip(rest, brute_pack([len(x) // 2 for _, x in rest], 256), strict=True):
        assert np.array(rows[b].ids[at : at + len(raw) // 2], "<u2").tobytes() == raw and rows[b].doc_ids[rows[b].bin_offsets.index(at)] == i
    assert packing.pack(none).count() == 0


# 9: top-k


@pytest.mark.parametrize("scale", [1e-6, 1, 3e6])
def test_exact_top_k(spark, scale):
    g = np.random.default_rng(4)
    near = np.repeat(g.normal(size=(4, 8)), 8, axis=0)
    near[::2] *= 1 + 1e-15 * g.integers(0, 4, size=(16, 1))
    v = np.concatenate([g.normal(size=(250, 8)), np.repeat(g.normal(size=(5, 8)), 6, axis=0), near, np.zeros((3, 8)), g.integers(-1, 2, size=(60, 8))]) * scale
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(900, None, 0), (901, [], 0), (902, [1.0, None], 0), (903, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (904, [1.0, 2.0], 0), (905, [3.0, 1.0], 0), (0, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, rank int")
    exact = [[Fraction(float(e)) for e in x] for x in v]
    want = set()
    for i in range(0, len(v), 5):
        s = [float(sum(a * b for a, b in zip(exact[i], x, strict=True))) for x in exact]
        best = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[j], j))[:7]
        want |= {(i, j, r, s[j]) for r, j in enumerate(best, 1)}
    want |= {(905, 904, 1, 5.0)}
    for shard_rows, block_rows, leaf in ((64, 20, 8), (10_000, 1000, 16), (50, 30, 1000)):
        got = balltree.exact_top_k(df, k=7, query_step=5, shard_rows=shard_rows, block_rows=block_rows, leaf_size=leaf).collect()
        assert {(r.query_id, r.neighbor_id, r["rank"], r.score) for r in got} == want and len(got) == len(want)
    assert balltree.exact_top_k(df.limit(0)).count() == 0


# 10: near copies


def test_sketch_estimates_similarity():
    g = np.random.default_rng(7)
    for n, common_ in ((1, 1), (3, 2), (40, 20), (3000, 2000)):
        diffs = []
        for _ in range(40):
            pool = g.integers(0, 2**63, size=2 * n - common_).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - common_ :])
            s, t = nearcopies.sketch(a, 128), nearcopies.sketch(b, 128)
            assert (s != np.uint64(2**64 - 1)).all()
            diffs.append((s == t).mean() - common_ / (2 * n - common_))
        assert abs(np.mean(diffs)) < 0.05


def brute_classes(texts, threshold=0.6, k=3):
    """document -> (the first of its group, similar other texts, copies); texts by document."""
    words = {i: tuple(t.split()) for i, t in texts.items()}
    same = defaultdict(list)
    for i in sorted(texts):
        same[words[i] or i].append(i)
    sets = {i: {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} for i, w in words.items() if w}
    root = {i: same[words[i] or i][0] for i in texts}
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(i for i in sets if same[words[i]][0] == i), 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[same[words[i] or i][0]], len(same[words[i] or i]) - 1) for i in texts}


def brute_groups(texts, threshold=0.6, k=3):
    return {i: c[0] for i, c in brute_classes(texts, threshold, k).items() if c[0] != i}


def test_near_copies(spark, docs, none):
    rows = nearcopies.near_copies(docs).collect()
    got = {(r.doc_id, r.content): (r.class_id, r.n_links, r.n_copies) for r in rows}
    assert got == {i: (c[0][0], *c[1:]) for i, c in brute_classes(texts_of(docs)).items()} and len(rows) == len(got)
    assert nearcopies.near_copies(none).count() == 0


def test_one_of_each_group_is_kept(spark, docs, none):
    gone = brute_groups(texts_of(docs))
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = Counter((i, t) for (i, h), t in texts_of(docs).items() if (i, h) not in gone) + Counter((r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.text is None)
    assert Counter((r.doc_id, r.text) for r in rows) == want
    once = docs.where("doc_id < 8 and doc_id <> 6")
    assert Counter((r.doc_id, r.text) for r in nearcopies.keep_one(once).collect()) == Counter((i, t) for (i, h), t in texts_of(once).items() if (i, h) not in brute_groups(texts_of(once)))
    assert nearcopies.keep_one(none).count() == 0


def test_near_copies_of_many(spark, monkeypatch):
    """A hot group of mutated copies without hub, cut into blocks; documents that only share a passage."""
    monkeypatch.setattr(nearcopies, "BLOCK", 7)
    r = random.Random(11)
    base = [str(r.random()) for _ in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(150)] = str(r.random())
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:60] + [str(r.random()) for _ in range(90)])) for i in range(20)]
    got = {x.doc_id: (x.class_id, x.n_links, x.n_copies) for x in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_classes(dict(rows))
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(want[i][0] == k for i, (k, *_) in got.items() if k != i)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30)), min_size=1, max_size=9), st.lists(st.sets(st.integers(0, 30)), min_size=1, max_size=9))
def test_intersections(rows, columns):
    sets = [[np.array(sorted(x), np.uint64) for x in side] for side in (rows, columns)]
    assert nearcopies.intersections(*sets).tolist() == [[len(a & b) for b in columns] for a in rows]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.randoms())
def test_forest(n, m, r):
    hit = np.array([[r.random() < 0.2 for _ in range(m)] for _ in range(n)])
    sides = np.arange(n), np.arange(n, n + m)
    root = list(range(n + m))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in np.argwhere(hit):
        a, b = find(i), find(n + j)
        root[max(a, b)] = min(a, b)
    assert {tuple(p) for p in nearcopies.forest(hit, *sides).tolist()} == {(x, find(x)) for x in range(n + m) if find(x) != x}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in nearcopies.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_gibberish_is_rejected(spark):
    """Random letters, encoded bytes and foreign scripts; text of the corpus stays (test_language_accuracy)."""
    import base64

    r = random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (30, 100, 400)]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*letters, base64.b64encode(r.randbytes(2000)).decode(), "Привет мир как дела", "漢字 日本語"])], "doc_id bigint, text string")
    assert all(x.rejected for x in language.identify(odd, language.train_profiles(docs)).collect())
