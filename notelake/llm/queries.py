"""The queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import lookalike, mixing, packing, spans


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalikes(table(spark, sf_dir, "records"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_classes(table(spark, sf_dir, "records"))


def p3_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records").dropDuplicates(["record_id"])
    return lookalike.normalised(records.select("record_id", "vault_id", "type_name", "name", "path"), ["name", "path"])


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p7_packed(spark, sf_dir))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing with sizes in code points, which SQL can count: what is packed, whether a container is too full or a text needlessly cut, and whether room is left for more than one in fifty containers."""
    sizes = F.coalesce(F.char_length("text"), F.lit(0))
    packed = written(packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"), size=sizes).where("bin is not null"), "packed")
    texts = packed.groupBy("container_id", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("size"))
    cut = texts.groupBy("container_id", "capacity").agg(F.count("*").alias("texts"), F.sum("pieces").alias("pieces"), F.sum("size").alias("size"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("needless_cuts"))
    full = packing.fill(packed).select("container_id", (F.col("fullest") <= F.col("capacity")).alias("fits"), (F.col("bins") <= F.col("least_bins") * 1.02 + 1).alias("tight"))
    return cut.join(full, "container_id")


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amounts(table(spark, sf_dir, "documents").dropDuplicates(["doc_id"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_classes, p3_normalised, p7_packed, p7_fill, p7_pieces, p8_drawn, p8_shares, p9_found, p9_shared)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The letters of other scripts that are drawn like a Latin one, by that letter; listed apart from the operator's own.
DRAWN_LIKE = {
    "A": "ΑА", "B": "ΒВ", "C": "С", "E": "ΕЕ", "H": "ΗН", "I": "ΙІ", "J": "Ј", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟОՕ", "P": "ΡР", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТ", "U": "Ս", "W": "Ԝ", "X": "ΧХ", "Y": "ΥУ", "Z": "Ζ", "a": "а", "c": "ϲс",
    "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "і", "j": "ϳј", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "р", "q": "ԛզ", "s": "ѕ", "u": "ս", "w": "ԝ", "x": "х", "y": "у",
}


def look_sql(column: str) -> str:
    """looks() as far as DuckDB can say it: it has no decomposed form, so lookalike letters are undone before accents are composed."""
    wide, plain = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    letters = wide + "".join(DRAWN_LIKE.values())
    as_ = plain + "".join(latin * len(others) for latin, others in DRAWN_LIKE.items())
    clean = f"regexp_replace(regexp_replace({column}, '[\\x{{00AD}}\\x{{034F}}\\x{{061C}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g'), '[\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\t\\n\\r]', ' ', 'g')"
    for ligature, spelled in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st")):
        clean = f"replace({clean}, '{ligature}', '{spelled}')"
    return f"nfc_normalize(translate({clean}, {_quoted(letters)}, {_quoted(as_)}))"


def search_sql(column: str) -> str:
    """folded(): lower case and sharp s stand for full case folding; letters that look alike in capitals only are joined in both cases."""
    others = "".join(c.lower() for own in DRAWN_LIKE.values() for c in own)
    as_ = "".join(latin.lower() * len(own) for latin, own in DRAWN_LIKE.items())
    return f"nfc_normalize(translate(replace(lower({look_sql(column)}), 'ß', 'ss'), {_quoted(others)}, {_quoted(as_)}))"


LOOKS = f"""WITH t AS (SELECT DISTINCT record_id, vault_id, type_name, 'name' AS part, name AS t FROM records UNION SELECT record_id, vault_id, type_name, 'path', path FROM records),
        l AS (SELECT *, {look_sql("t")} AS look FROM t WHERE t IS NOT NULL)"""

P3_FOUND = f"{LOOKS} SELECT DISTINCT least(a.record_id, b.record_id) AS record_a, greatest(a.record_id, b.record_id) AS record_b FROM l a JOIN l b USING (vault_id, type_name, part, look) WHERE a.t <> b.t"

P3_CLASSES = f"""{LOOKS}, c AS (SELECT *, min(record_id) OVER w AS class_id, count(*) OVER w AS n, count(*) OVER (PARTITION BY vault_id, type_name, part, look, t) AS own FROM l WINDOW w AS (PARTITION BY vault_id, type_name, part, look))
        SELECT record_id, part, class_id, n - own AS links FROM c WHERE n > own"""

P3_NORMALISED = f"""SELECT record_id, any_value(vault_id) AS vault_id, any_value(type_name) AS type_name, any_value(name) AS name, any_value(path) AS path, {look_sql("any_value(name)")} AS name_looks, {look_sql("any_value(path)")} AS path_looks,
        {search_sql("any_value(name)")} AS name_search, {search_sql("any_value(path)")} AS path_search FROM records GROUP BY record_id"""


#: Every window of 160 code points, by hash; texts are cut into overlapping chunks first, since a place in a text is only found from its start.
WINDOWS = """WITH chunks AS (SELECT doc_id, unnest(list_transform(range(0, (length(text) - 160) // 1000 + 1), lambda k: {'b': k * 1000, 's': substring(text, k * 1000 + 1, 1159)})) AS c FROM documents WHERE length(text) >= 160),
    places AS (SELECT doc_id, c.b AS b, c.s AS s, unnest(range(1, length(c.s) - 158)) AS i FROM chunks),
    windows AS (SELECT DISTINCT doc_id, b + i AS pos, md5(substring(s, i, 160)) AS h FROM places),
    held AS (SELECT DISTINCT doc_id, h FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id))),
    pairs AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM held a JOIN held b ON a.h = b.h AND a.doc_id <> b.doc_id)"""

P9_FOUND = f"{WINDOWS} SELECT doc_a, doc_b FROM pairs WHERE doc_a < doc_b"

P9_SHARED = f"""{WINDOWS}, covered AS (SELECT doc_id, sum(least(160, after - pos)) AS shared FROM (SELECT doc_id, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), pos + 160) AS after FROM windows SEMI JOIN held USING (doc_id, h)) GROUP BY doc_id),
    partners AS (SELECT doc_a AS doc_id, count(*) AS partners FROM pairs GROUP BY doc_a)
    SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared, 0) AS shared_chars, coalesce(partners, 0) AS partners FROM documents LEFT JOIN covered USING (doc_id) LEFT JOIN partners USING (doc_id)"""

P7_PIECES = """SELECT container_id, capacity::BIGINT AS capacity, count(*) AS texts, sum(ceil(n / capacity))::BIGINT AS pieces, sum(n)::BIGINT AS size, 0 AS needless_cuts, true AS fits, true AS tight
    FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text <> ''), containers GROUP BY container_id, capacity"""


def oracle_sql() -> dict[str, str]:
    """Token counts and Pareto order are beyond SQL: tests hold those queries against brute force."""
    return {"p3_found": P3_FOUND, "p3_classes": P3_CLASSES, "p3_normalised": P3_NORMALISED, "p7_pieces": P7_PIECES, "p9_found": P9_FOUND, "p9_shared": P9_SHARED}
