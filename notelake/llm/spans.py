"""Long exact spans shared between documents: repeated-phrase automata.

1. Every document is read once and its winnowed anchors are kept: of each run of SPAN - GRAM + 1 consecutive
   windows of GRAM code points the one with the least hash. Two documents with a common stretch of SPAN code points
   have a common anchor in it.
2. An anchor that occurs in several documents recurs. It is redundant if it has the same anchor before it, at the
   same distance of at most GRAM, wherever it occurs: the two then lie in one common stretch. The others, mostly one
   for each repeated passage, are the passages to look for.
3. Passages are confirmed by their text and compiled into Aho-Corasick automata, one for each shard of documents,
   with the passages that the shard's documents hold. Each such document is streamed through its automaton, which
   gives every occurrence with the code points around it.
4. Occurrences of one passage are put into classes by what surrounds them; a pair of classes shares a stretch of
   SPAN code points or not. Pairs of classes expand to pairs of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written

SPAN = 160
GRAM = 81
#: Code points of the documents that one automaton is for, about.
SHARD_CHARS = 32_000_000
#: Classes of one passage above which they are joined on their windows instead of with each other.
CROWD = 160

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.int64(0)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _bases(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the life of a worker."""
    global _powers, _inverses
    if len(_powers) < n:
        m = 1 << max(14, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m - 1, _BASE))])
            _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m - 1, inverse))])
    return _powers[:n], _inverses[:n]


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each window of gram code points, by differences of one running polynomial sum."""
    n = len(points)
    powers, inverses = _bases(n)
    with np.errstate(over="ignore"):
        sums = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers)
        h = sums[gram - 1 :].copy()
        h[1:] -= sums[: n - gram]
        h *= inverses[: n - gram + 1]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def _sliding(a: np.ndarray, w: int, least) -> np.ndarray:
    """The least (or most) of every w neighbours."""
    done, out = 1, a
    while done < w:
        step = min(done, w - done)
        out = least(out[:-step], out[step:])
        done += step
    return out


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some w neighbours; all of them, if there are ties. Fewer than w: none."""
    if len(h) < w:
        return np.empty(0, dtype=np.int64)
    low = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, dtype=np.uint64)
    reach = _sliding(np.concatenate([edge, low, edge]), w, np.maximum)
    return np.flatnonzero(reach == h)


def _anchors(span: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hashes, links = [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                points = code_points(text)
                h = gram_hashes(points, gram)
                at = winnow(h, span - gram + 1)
                own = h[at]
                gap = np.diff(at)
                with np.errstate(over="ignore"):
                    link = (own[:-1] * _MIX + gap.astype(np.uint64)) | np.uint64(1)
                link = np.concatenate([[np.uint64(0)], np.where(gap <= gram, link, np.uint64(0))])
                ids.append(np.full(len(at), doc, dtype=np.int64))
                hashes.append(own.view(np.int64))
                links.append(link.view(np.int64))
            if ids:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "gram": np.concatenate(hashes), "link": np.concatenate(links)})

    return run


def anchors(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, gram, link) for each winnowed anchor; link tells the anchor before it and the distance, 0 for none in reach."""
    ship(documents.sparkSession)
    long = documents.select("doc_id", "text").where((F.char_length("text") >= span) & F.col("doc_id").isNotNull())
    return long.mapInPandas(_anchors(span, gram), "doc_id long, gram long, link long")


def passages(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, gram): the recurring anchors that aren't redundant, once for each document that holds them."""
    spread = anchors(documents, span, gram)
    # Summed up before it is shuffled, and joined where Spark can split a gram that very many documents hold.
    known = spread.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("link").alias("l"), F.max("link").alias("m")).where("a < b and (l <> m or l = 0)").select("gram")
    return spread.select("doc_id", "gram").join(known, "gram").distinct()


def _confirm(gram: int):
    """The texts of a document's passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = [], []
            for doc, text, grams in zip(batch["doc_id"], batch["text"], batch["grams"]):
                h = gram_hashes(code_points(text), gram).view(np.int64)
                at = np.flatnonzero(np.isin(h, np.asarray(grams, dtype=np.int64)))
                found = {text[i : i + gram] for i in at}
                ids += [doc] * len(found)
                texts += found
            yield pd.DataFrame({"doc_id": np.array(ids, dtype=np.int64), "passage": texts})

    return run


def _stream(span: int, gram: int):
    """Streams a shard's documents, batch by batch, through the automaton of its passages, which come before them."""
    around = span - gram

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        shard, automaton, ready = None, None, False
        for batch in batches:
            rows: set[tuple] = set()
            for row in batch.itertuples(index=False):
                if row.shard != shard:
                    shard, automaton, ready = row.shard, ahocorasick.Automaton(ahocorasick.STORE_INTS), False
                if row.kind == 0:
                    automaton.add_word(row.text, int(row.id))
                    continue
                if not ready:
                    ready = True
                    automaton.make_automaton()
                if len(automaton):
                    text = row.text
                    for end, i in automaton.iter(text):
                        begin = end + 1 - gram
                        rows.add((i, text[begin : end + 1], row.id, text[max(0, begin - around) : begin], text[end + 1 : end + 1 + around]))
            yield pd.DataFrame(list(rows), columns=["passage_id", "passage", "doc_id", "before", "after"])

    return run


def occurrences(documents: DataFrame, span: int = SPAN, gram: int = GRAM, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(passage_id, passage, doc_id, before, after): each place where a document holds a confirmed passage, with up to span - gram code points on either side.

    shard_chars: code points of the documents of an automaton, about. A shard's passages are those that its documents hold, so
    neither grows with the data; its documents are streamed, not gathered.
    """
    spark = documents.sparkSession
    held = passages(documents, span, gram).groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))
    texts = written(documents.select("doc_id", "text").join(held, "doc_id"), "spans")
    chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // shard_chars))
    found = texts.mapInPandas(_confirm(gram), "doc_id long, passage string")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long")
    found = written(found.withColumn("passage_id", F.xxhash64("passage")).withColumn("shard", shard), "found")
    confirmed = found.groupBy("passage").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("passage")
    known = found.join(confirmed, "passage").select("shard", F.lit(0).alias("kind"), F.col("passage_id").alias("id"), F.col("passage").alias("text")).distinct()
    placed = texts.select(shard.alias("shard"), F.lit(1).alias("kind"), F.col("doc_id").alias("id"), "text")
    ordered = known.unionByName(placed).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return ordered.mapInPandas(_stream(span, gram), "passage_id long, passage string, doc_id long, before string, after string")


def _alike(span: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for b, c, a, d in zip(batch["before"], batch["before2"], batch["after"], batch["after2"]):
                n = gram
                for x, y in zip(reversed(b), reversed(c)):
                    if x != y:
                        break
                    n += 1
                for x, y in zip(a, d):
                    if n >= span or x != y:
                        break
                    n += 1
                keep.append(n >= span)
            yield batch.loc[keep, ["c1", "c2"]]

    return run


def shared_pairs(documents: DataFrame, span: int = SPAN, gram: int = GRAM, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_a, doc_b), smaller first: each pair of documents that share an identical stretch of span or more code points.

    Null texts, null ids and texts shorter than span share nothing; text is compared as stored. Rows of one doc_id are one
    document. No pair is dropped, so a stretch that m documents share gives m * (m - 1) / 2 rows; for such data
    span_classes() has the classes and membership without the pairs.
    """
    members, links = span_classes(documents, span, gram, shard_chars)
    within = members.where("enough").select("class_id", "doc_id")
    same = within.alias("x").join(within.alias("y"), "class_id").where("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b"))
    one = members.select(F.col("class_id").alias("c1"), F.col("doc_id").alias("p"))
    two = members.select(F.col("class_id").alias("c2"), F.col("doc_id").alias("q"))
    other = links.join(one, "c1").join(two, "c2").where("p <> q").select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b"))
    return same.unionByName(other).distinct()


def span_classes(documents: DataFrame, span: int = SPAN, gram: int = GRAM, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame]:
    """Members (class_id, doc_id, enough) and links (c1, c2) between classes that share a stretch.

    A class holds the occurrences of one passage in the same surroundings; enough: these alone make up span code
    points, so that all its documents share a stretch.
    """
    around = occurrences(documents, span, gram, shard_chars).withColumn("class_id", F.xxhash64("passage_id", "before", "after"))
    around = written(around, "around")
    length = F.char_length("before") + gram + F.char_length("after")
    members = around.select("class_id", "doc_id", (length >= span).alias("enough")).distinct()
    classes = around.dropDuplicates(["passage_id", "class_id"]).select("passage_id", "passage", "class_id", "before", "after")
    long_enough = classes.where(length >= span)
    crowd = long_enough.groupBy("passage_id").count().where(F.col("count") > CROWD).select("passage_id")
    few = long_enough.join(crowd, "passage_id", "left_anti")
    hashed = long_enough.join(crowd, "passage_id").mapInPandas(_windows(span), "passage_id long, class_id long, before string, after string, window long")
    plain = _class_pairs(few, ["passage_id"])
    crowded = _class_pairs(hashed, ["passage_id", "window"])
    links = plain.unionByName(crowded).mapInPandas(_alike(span, gram), "c1 long, c2 long")
    return members, links.distinct()


def _class_pairs(classes: DataFrame, on: list[str]) -> DataFrame:
    left = classes.select(*on, F.col("class_id").alias("c1"), "before", "after")
    right = classes.select(*on, F.col("class_id").alias("c2"), F.col("before").alias("before2"), F.col("after").alias("after2"))
    return left.join(right, on).where("c1 < c2").select("c1", "c2", "before", "before2", "after", "after2")


def _windows(span: int):
    """Each window of span code points over the surroundings, hashed: two classes share a stretch only if they share one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                h = np.unique(gram_hashes(code_points(row.before + row.passage + row.after), span))
                parts.append(pd.DataFrame({"passage_id": row.passage_id, "class_id": row.class_id, "before": row.before, "after": row.after, "window": h.view(np.int64)}))
            if parts:
                yield pd.concat(parts)

    return run


def shared_amounts(documents: DataFrame, span: int = SPAN, gram: int = GRAM, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, n_chars, shared_chars, partners) of every document: how many of its code points lie in a stretch that another document has too.

    A document without such a stretch, also one that is null or empty, comes out with 0.
    """
    pairs = written(shared_pairs(documents, span, gram, shard_chars), "pairs")
    both = pairs.unionByName(pairs.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b")))
    own = documents.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a"))
    its = documents.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b"))
    stretches = both.join(own, "doc_a").join(its, "doc_b").mapInPandas(_stretches(span), "doc_id long, begins long, ends long")
    ordered = Window.partitionBy("doc_id").orderBy("begins", "ends")
    reach = F.max("ends").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("ends") - F.greatest("begins", F.coalesce(reach, F.lit(0))), F.lit(0))
    amounts = stretches.distinct().withColumn("new", new).groupBy("doc_id").agg(F.sum("new").alias("shared_chars"))
    partners = both.groupBy(F.col("doc_a").alias("doc_id")).agg(F.count("*").alias("partners"))
    listed = documents.groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars"))
    return listed.join(amounts, "doc_id", "left").join(partners, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("partners", F.lit(0)).alias("partners"))


def _stretches(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for doc, a, b in zip(batch["doc_a"], batch["text_a"], batch["text_b"]):
                at = np.flatnonzero(np.isin(gram_hashes(code_points(a), span), gram_hashes(code_points(b), span)))
                if len(at):
                    breaks = np.flatnonzero(np.diff(at) > 1)
                    begins = at[np.concatenate([[0], breaks + 1])]
                    ends = at[np.concatenate([breaks, [len(at) - 1]])] + span
                    parts.append(pd.DataFrame({"doc_id": doc, "begins": begins, "ends": ends}))
            if parts:
                yield pd.concat(parts)

    return run
