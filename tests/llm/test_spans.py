"""Shared stretches against brute force over every window."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import spans

DOCS = "doc_id long, text string"


def brute(rows, span):
    by = defaultdict(set)
    for i, t in rows:
        if t is not None and i is not None:
            for k in range(len(t) - span + 1):
                by[t[k : k + span]].add(i)
    pairs, amounts = set(), defaultdict(set)
    for w, ids in by.items():
        if len(ids) > 1:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
    for i, t in rows:
        for k in range(len(t or "") - span + 1):
            if len(by[t[k : k + span]]) > 1:
                amounts[i] |= set(range(k, k + span))
    return pairs, {i: len(x) for i, x in amounts.items()}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé😀 ") for _ in range(r.randint(1, 9)))
    blocks = ["".join(word() for _ in range(r.randint(2, 12))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [r.choice(blocks)[r.randint(0, 5) :] if r.random() < 0.5 else "".join(word() for _ in range(r.randint(1, 10))) for _ in range(r.randint(0, 6))]
        rows.append((i, r.choice(["", "", " "]).join(parts)))
    rows += [(100, None), (101, ""), (102, "ab" * 200), (103, "x" + "ab" * 60), (104, "-" * 300), (105, "--" * 40), (None, "-" * 200)]
    rows += [(200, blocks[0] + blocks[1] + blocks[2]), (201, blocks[2] + blocks[1] + blocks[0]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed,span,gram,crowd", [(1, 40, 21, 160), (2, 40, 21, 1), (3, 25, 9, 2), (4, 60, 40, 160)])
def test_pairs(spark, monkeypatch, seed, span, gram, crowd):
    monkeypatch.setattr(spans, "CROWD", crowd)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("gram", "grams", "link", "shard", "passage", "passage_id", "class_id", "before")})
    got = [tuple(r) for r in spans.shared_pairs(df, span, gram).collect()]
    want, _ = brute(rows, span)
    assert len(got) == len(set(got)) and set(got) == want


def test_amounts(spark):
    rows = [r for r in {i: (i, t) for i, t in corpus(7) if i is not None}.values()]
    out = {r["doc_id"]: r for r in spans.shared_amounts(spark.createDataFrame(rows, DOCS), 40, 21).collect()}
    pairs, amounts = brute(rows, 40)
    assert {i: r["shared_chars"] for i, r in out.items()} == {i: amounts.get(i, 0) for i, _ in rows}
    assert all(r["partners"] == sum(i in p for p in pairs) and r["n_chars"] == len(dict(rows)[i] or "") for i, r in out.items())


def test_classes_hold_copies_once(spark):
    rows = [(i, "the same long passage of text in many documents, word for word") for i in range(50)]
    members, links = spans.span_classes(spark.createDataFrame(rows, DOCS), 40, 21)
    assert members.select("class_id").distinct().count() <= 3 and links.count() <= 3
    assert spans.shared_pairs(spark.createDataFrame(rows, DOCS), 40, 21).count() == 50 * 49 // 2


def test_nothing_shared(spark):
    assert spans.shared_pairs(spark.createDataFrame([], DOCS)).count() == 0
    assert spans.shared_pairs(spark.createDataFrame([(1, "x" * 1_000_000), (2, "y" * 159)], DOCS)).count() == 0


def test_hashes_and_winnowing():
    a = spans.code_points("xyz" + "hello world, " * 30)
    h = spans.gram_hashes(a, 13)
    assert h[3] == h[16] and len(np.unique(h[3:16])) == 13
    at = spans.winnow(h, 8)
    assert np.diff(at).max() <= 8 and len(spans.winnow(h[:5], 8)) == 0
