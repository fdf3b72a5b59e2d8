"""Mixes: shares, caps, identical texts, determinism."""

import pytest
from pyspark.sql import functions as F

from notelake.llm.mixing import UNIT, inclusion, mix, sample_sizes, shares
from notelake.llm.tokens import token_count

DOCS = "doc_id long, text string, source string"
TARGETS = "mix_id int, source string, target_share double, max_repeats int"


def docs(spark, sizes):
    rows, i = [], 0
    for source, (n, words) in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i, f"{i} " + "word " * (words + i % 7), source))
    return spark.createDataFrame(rows, DOCS)


def test_shares_are_met(spark):
    d = docs(spark, {"big": (900, 40), "mid": (300, 60), "small": (30, 50), "other": (50, 10)}).withColumns({c: F.lit(1) for c in ("mix_id", "tokens", "step", "key", "pi", "copies")})
    t = spark.createDataFrame([(1, "big", 0.6, 1), (1, "mid", 0.3, 2), (1, "small", 0.1, 4), (2, "mid", 0.5, 1), (2, "absent", 0.2, 3), (2, "small", 0.3, 2)], TARGETS).withColumn("doc_id", F.lit(1))
    out = {(r["mix_id"], r["source"]): r for r in shares(d, t).collect()}
    for source, share in (("big", 0.6), ("mid", 0.3), ("small", 0.1)):
        assert out[1, source]["reached_share"] == pytest.approx(share, abs=0.01)
    assert out[1, "small"]["most_copies"] <= 4 and out[1, "big"]["most_copies"] == 1 and out[2, "absent"]["tokens"] == 0
    assert out[2, "mid"]["reached_share"] == pytest.approx(0.5 / 0.8, abs=0.01)
    a, b = mix(d, t).collect(), mix(d.repartition(7), t).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and sorted(map(tuple, a)) != sorted(map(tuple, mix(d, t, seed=1).collect()))
    assert all(r["copies"] <= 4 for r in a) and len({(r["mix_id"], r["doc_id"]) for r in a}) == len(a)


def test_total_can_be_set(spark):
    d = docs(spark, {"a": (200, 30), "b": (200, 30)})
    t = spark.createDataFrame([(1, "a", 0.5, 3), (1, "b", 0.5, 3)], TARGETS)
    got = {r["source"]: r["tokens"] for r in shares(d, t, total_tokens=4_000).collect()}
    assert got["a"] == pytest.approx(2_000, abs=40) and got["b"] == pytest.approx(2_000, abs=40)


def test_long_texts_dont_carry_a_sample_away(spark):
    d = docs(spark, {"a": (4, 3_000), "b": (300, 20), "c": (1, 12_000)}).withColumn("source", F.when(F.col("source") == "b", "a").otherwise(F.col("source")))
    t = spark.createDataFrame([(i, s, 0.5, 1) for i in range(60) for s in "ac"], TARGETS)
    got = sorted(r["tokens"] for r in shares(d, t, total_tokens=4_000).where("source = 'a'").collect())
    assert got[10] > 1_800 and got[49] < 2_200 and sum(got) / 60 == pytest.approx(2_000, rel=0.25)


def test_all_is_drawn_where_all_is_wanted(spark):
    d = docs(spark, {"a": (37, 11), "b": (5, 400)})
    for share in (0.1, 0.3, 0.7):
        t = spark.createDataFrame([(1, "a", share, 3), (1, "b", 1 - share, 50)], TARGETS)
        assert {r["copies"] for r in mix(d, t).where("source = 'a'").collect()} == {3}


def test_inclusion_follows_the_odds(spark):
    """400 mixes of one source: each text is in as many as its odds say, which go down with its length, and all samples are of one size."""
    rows = [(i, f"{i} " + "word " * (5 * 2 ** (i % 5)), "a") for i in range(100)]
    d = spark.createDataFrame(rows, DOCS)
    tokens = {r[0]: r[1] for r in d.select("doc_id", token_count(F.col("text"))).collect()}
    t = spark.createDataFrame([(m, "a", 1.0, 1) for m in range(400)], TARGETS)
    drawn = mix(d, t, total_tokens=1_500).groupBy("doc_id").count().collect()
    hits = {r["doc_id"]: r["count"] / 400 for r in drawn}
    each = next(c for c in (x / 100 for x in range(1, 100_000)) if sum(min(n, c) for n in tokens.values()) >= 1_500)
    for k in range(5):
        own = [i for i in range(100) if i % 5 == k]
        want = sum(min(1.0, each / tokens[i]) for i in own) / len(own)
        assert sum(hits.get(i, 0) for i in own) / len(own) == pytest.approx(want, rel=0.06)
        assert want == 1 or all(abs(hits.get(i, 0) - want) < 0.13 for i in own)
    assert sum(hits.get(i, 0) for i in range(0, 100, 5)) > 4 * sum(hits.get(i, 0) for i in range(4, 100, 5))
    sizes = {r["count"] for r in mix(d, t, total_tokens=1_500).groupBy("mix_id").count().collect()}
    assert max(sizes) - min(sizes) <= 1


def test_sample_sizes():
    strata = [(s, 10, 10 * t, 10 * UNIT // t, t) for s, t in ((3, 2), (9, 5), (20, 32), (30, 181), (40, 1024))]
    each, certain = inclusion(strata, 1_000)
    assert certain == {3, 9} and each == 31 and sum(n * min(t // n, each) for _, n, t, _, _ in strata) == pytest.approx(1_000)
    runs = [sample_sizes(strata, 1_000, s / 100) for s in range(100)]
    assert all(r[3][1] == 10 and r[9][1] == 10 for r in runs)
    for size, t in ((20, 32), (30, 181), (40, 1024)):
        assert sum(r[size][1] for r in runs) / 100 == pytest.approx(10 * each / t, abs=0.02)
    assert inclusion([], 5) == (0.0, set()) and inclusion(strata, sum(s[2] for s in strata)) == (0.0, {3, 9, 20, 30, 40})


def test_identical_texts_count_once(spark):
    rows = [(i, "the same words again", "a") for i in range(50)] + [(100 + i, f"text {i} of its own", "a") for i in range(10)] + [(200, "the same words again", "b"), (201, "b's own text", "b"), (202, None, "b"), (203, "", "b"), (204, "no source", None), (None, "no id", "b")]
    t = spark.createDataFrame([(1, "a", 0.5, 2), (1, "b", 0.5, 2), (1, None, 0.1, 1), (1, "c", 0.0, 1)], TARGETS)
    out = mix(spark.createDataFrame(rows, DOCS), t).collect()
    assert max(r["copies"] for r in out) <= 2 and len({r["text_id"] for r in out}) == len(out) and not {202, 203, 204} & {r["doc_id"] for r in out}


def test_nothing_to_mix(spark):
    none = spark.createDataFrame([], DOCS)
    t = spark.createDataFrame([(1, "a", 1.0, None)], TARGETS)
    assert mix(none, t).count() == 0 and mix(docs(spark, {"a": (3, 3)}), t.limit(0)).count() == 0
    assert shares(none, t).first()["reached_share"] == 0.0
    assert mix(docs(spark, {"a": (3, 3)}), t).count() == 3
