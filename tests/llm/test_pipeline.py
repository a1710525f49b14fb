"""The whole pipeline against plain Python on a small table, and the registered queries against their SQL."""

from __future__ import annotations

import hashlib
import os
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), os.path.join(os.path.dirname(os.path.dirname(HERE)), "tools"), HERE]

import corpus_pipeline
from codeloom.llm import merges, queries
from compare import compare, connect
from test_operators import SCHEMA, brute_grams, brute_groups, brute_pack, brute_spans, row, without

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    said = compare(spark, connect(AT), name, queries.QUERIES[name], queries.ORACLE_SQL.get(name), AT)
    assert "DIFFERENT" not in said, said


def expected(rows):
    """doc -> its text after the stages; nothing but plain Python. rows are (doc_id, text, lang)."""
    profiles = {}
    for lang in {x[2] for x in rows}:
        own = sorted((x for x in rows if x[2] == lang), key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest())[:500]
        total = sum((brute_grams(x[1]) for x in own), Counter())
        profiles[lang] = {g: n for n, g in enumerate(sorted(total, key=lambda g: (-total[g], [ord(c) for c in g]))[:300])}

    def fits(text):
        grams = brute_grams(text) if any(c.isalpha() for c in text) else {}
        top = sorted(grams, key=lambda g: (-grams[g], [ord(c) for c in g]))[:300]
        return bool(top) and min(sum(abs(n - p[g]) if g in p else 300 for n, g in enumerate(top)) for p in profiles.values()) / (300 * len(top)) <= 0.72

    kept = {i: t for i, t, _ in rows if fits(t)}
    gone = brute_groups(kept)
    kept = {i: t for i, t in kept.items() if i not in gone}
    cuts = defaultdict(list)
    for i, later, a, b in brute_spans(kept, 50):
        if later:
            cuts[i].append((a, b))
    return {i: (without(t, cuts[i]) if i in cuts else None, t) for i, t in kept.items()}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    want = expected([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    rows = corpus_pipeline.run(spark, AT).collect()
    decode = merges._library(merges.DEFAULT_VOCABULARY).decode
    parts = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.n_tokens <= 2048
        for i, start, a, b in zip(r.doc_ids, r.token_starts, r.bin_offsets, [*r.bin_offsets[1:], r.n_tokens], strict=True):
            parts[i].append((start, r.ids[a:b]))
    texts = {}
    for i, p in parts.items():
        assert [x for x, _ in sorted(p)] == list(range(0, 2048 * len(p), 2048))
        texts[i] = decode([x for _, ids in sorted(p) for x in ids])
    assert texts.keys() == {i for i, (left, _) in want.items() if left is None or left}
    for i, text in texts.items():
        left, whole = want[i]
        assert text == whole if left is None else text.split() == left
    encode = merges._library(merges.DEFAULT_VOCABULARY).encode_ordinary
    rest = sorted((i, np.array(ids[len(ids) // 2048 * 2048 :], "<u2").tobytes()) for i, t in texts.items() if len(ids := encode(t)) % 2048)
    placed = dict(zip([i for i, _ in rest], brute_pack([len(x) // 2 for _, x in rest], 2048), strict=True))
    assert placed == {i: (r.bin_id, at) for r in rows if r.bin_id >= 0 for i, at in zip(r.doc_ids, r.bin_offsets, strict=True)}


def test_stages_on_odd_rows(spark):
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    other = " ".join(f"again{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    # two documents with id 6: neither takes the other's place
    rows = [row(1, words), row(2, words), row(2, words), row(3, None), row(4, ""), row(None, words), row(5, "Hello wordaa wordba"), row(6, other), row(6, "first " + other[-500:] + " wordaa")]
    now = spark.createDataFrame(rows, SCHEMA)
    for empty in (False, True):
        docs = now.limit(0) if empty else now
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, AT)
            assert docs.columns == now.columns
        left = sorted(r.doc_id or -1 for r in docs.collect())
        assert left == ([] if empty else [-1, 1, 5, 6, 6])
        assert bool(corpus_pipeline.STAGES[-1][1](spark, docs, AT).count()) != empty
