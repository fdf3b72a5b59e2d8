"""Mixes of sources with target shares of the tokens, by Pareto order sampling.

What a source lacks for its target after whole copies of all its texts is drawn at unequal odds: every text is expected to
give the same number of tokens, so the inclusion probability of a text goes down with its length, and texts no longer than
that number are certain. Texts are ranked by random odds over inclusion odds, and as many as the probabilities add up to are
taken from the top. This is done within classes of about equal size, whose fixed sample sizes are rounded one after the
other, so that the tokens drawn come near the target as well.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tokens import VOCABULARY, token_count

#: Size classes for each doubling of the tokens.
FINENESS = 4

#: Steps of the rank key a unit, for the histogram that finds where a sample ends.
STEPS = 2_000

#: A size class of a source in a mix: class, texts, tokens, sum of UNIT / tokens, tokens of the largest text.
Stratum = tuple[int, int, int, int, int]

UNIT = 10**12


def inclusion(strata: list[Stratum], rest: float) -> tuple[float, set[int]]:
    """The tokens that each text is expected to give, so that they add up to rest, and the classes whose texts don't have more and are taken for certain."""
    certain: set[int] = set()
    left, texts = rest, sum(s[1] for s in strata)
    for size, n, tokens, _, largest in sorted(strata):
        if largest * texts > left:
            break
        certain.add(size)
        left, texts = left - tokens, texts - n
    return (left / texts if texts else 0.0), certain


def sample_sizes(strata: list[Stratum], rest: float, start: float) -> dict[int, tuple[float, int]]:
    """By class: the inclusion probability times tokens, and how many texts are drawn, a fixed number. Expected numbers are rounded along the classes, from start on, so that no run of classes is off by a text."""
    each, certain = inclusion(strata, rest)
    out, reached = {}, start
    for size, texts, _, inverse, largest in sorted(strata):
        if size in certain:
            out[size] = (float(largest), texts)
            continue
        expected = min(each * inverse / UNIT, float(texts))
        n = min(math.floor(reached + expected) - math.floor(reached), texts)
        reached += expected
        out[size] = (each * n / expected if expected else 0.0, n)
    return out


def _mixed(documents: DataFrame, targets: DataFrame, vocabulary: str, seed: int, total_tokens: int | None):
    spark = documents.sparkSession
    sized = written(
        documents.where("source is not null and text <> ''").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_id"), token_count(F.col("text"), vocabulary).alias("tokens")),
        "sized",
    ).where("tokens > 0")
    goals = {(r["mix_id"], r["source"]): r for r in targets.where("source is not null and target_share > 0").select("mix_id", "source", "target_share", "max_repeats").distinct().collect()}
    goal = spark.createDataFrame([(m, s) for m, s in goals], "mix_id int, source string")
    texts = sized.join(F.broadcast(goal), "source").groupBy("mix_id", "text_id").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x")).select("mix_id", "text_id", "x.*")
    texts = written(texts.withColumn("size", F.floor(F.log2("tokens") * FINENESS).cast("int")), "texts")
    classes: dict[tuple, list[Stratum]] = {}
    for r in texts.groupBy("mix_id", "source", "size").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum(F.expr(f"{UNIT} div tokens").cast("decimal(19,0)")).alias("q"), F.max("tokens").alias("m")).collect():  # FINENESS rows for each doubling and target
        classes.setdefault((r["mix_id"], r["source"]), []).append((r["size"], r["n"], r["t"], int(r["q"]), r["m"]))
    there = {k: (sum(s[2] for s in own), sum(s[1] for s in own)) for k, own in classes.items()}
    plan, drawing = [], []
    for (mix, source), g in goals.items():
        tokens, n = there.get((mix, source), (0, 0))
        reach = [int(x["max_repeats"] or 1) * there[k][0] / x["target_share"] for k, x in goals.items() if k[0] == mix and k in there]
        total = min([*reach, *([total_tokens] if total_tokens else [])], default=0)
        repeats = int(g["max_repeats"] or 1)
        want = min(total * g["target_share"], repeats * tokens)
        whole = min(int(want / tokens + 1e-9), repeats) if tokens else 0
        rest = max(want - whole * tokens, 0.0) if whole < repeats else 0.0
        plan.append((mix, source, float(g["target_share"]), repeats, int(tokens), int(n), float(want), whole))
        start = random.Random(f"{seed} {mix} {source}").random()
        sizes = sample_sizes(classes.get((mix, source), []), rest, start) if rest >= 1 else {s[0]: (0.0, 0) for s in classes.get((mix, source), [])}
        drawing += [(mix, source, size, whole, repeats, float(odds), k) for size, (odds, k) in sizes.items() if whole or k]
    drawing = spark.createDataFrame(drawing, "mix_id int, source string, size int, whole int, max_repeats int, each double, take long")
    plan = spark.createDataFrame(plan, "mix_id int, source string, target_share double, max_repeats int, there_tokens long, there_texts long, want double, whole int")
    u = (F.shiftrightunsigned(F.xxhash64("text_id", "mix_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    p = F.least(F.greatest(F.col("each") / F.col("tokens"), F.lit(1e-12)), F.lit(1 - 1e-12))
    key = F.log(u) - F.log1p(-u) - F.log(p) + F.log1p(-p)
    ranked = texts.join(F.broadcast(drawing), ["mix_id", "source", "size"]).withColumn("key", key).withColumn("step", F.floor(F.col("key") * STEPS))
    ranked = written(ranked.select("mix_id", "source", "size", "doc_id", "text_id", "tokens", "whole", "max_repeats", "take", "key", "step"), "ranked")
    stratum = ["mix_id", "source", "size"]
    upto = Window.partitionBy(*stratum).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = ranked.where("take > 0").groupBy(*stratum, "take", "step").count().withColumn("upto", F.sum("count").over(upto))
    ends = steps.where("upto >= take").groupBy(*stratum).agg(F.min(F.struct("step", (F.col("take") - F.col("upto") + F.col("count")).alias("room"))).alias("end"))
    placed = ranked.join(ends, stratum, "left")
    within = F.row_number().over(Window.partitionBy(*stratum).orderBy("key", "text_id"))
    edge = placed.where("step = end.step").withColumn("extra", (within <= F.col("end.room")).cast("int"))
    others = placed.where("NOT coalesce(step = end.step, false)").withColumn("extra", F.coalesce(F.col("step") < F.col("end.step"), F.lit(False)).cast("int"))
    copies = F.least(F.col("whole") + F.col("extra"), F.col("max_repeats")).cast("int")
    drawn = edge.unionByName(others).withColumn("copies", copies).where("copies > 0").select("mix_id", "source", "doc_id", "text_id", "tokens", "copies")
    return drawn, plan


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 42, total_tokens: int | None = None) -> DataFrame:
    """The drawn texts of each mix: (mix_id, source, doc_id, text_id, tokens, copies).

    A mix is as large as its scarcest source allows (or total_tokens, if that is less). Of each source every text
    gets the whole part of want / tokens copies for certain; the rest is a sample of fixed size in Pareto order, a text's inclusion
    probability being inverse to its tokens, and 1 where that would be more. The tokens of the sample come near the
    rest, to a text or so, without being fitted to it. Identical texts are one text: it counts for the source of its lowest doc_id, so
    nothing is used more often than max_repeats. Null or empty texts, null sources and sources without a target are never drawn; a
    target without documents reaches 0.
    """
    return _mixed(documents, targets, vocabulary, seed, total_tokens)[0]


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 42, total_tokens: int | None = None) -> DataFrame:
    """What each target reached: tokens, texts, most copies of a text, reached_share of the mix's tokens."""
    drawn, plan = _mixed(documents, targets, vocabulary, seed, total_tokens)
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    full = plan.join(got, ["mix_id", "source"], "left").na.fill(0, ["tokens", "texts", "most_copies"])
    all_of = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return full.select("mix_id", "source", "target_share", "max_repeats", "there_tokens", "tokens", "texts", "most_copies", F.when(all_of > 0, F.col("tokens") / all_of).otherwise(0.0).alias("reached_share"))
