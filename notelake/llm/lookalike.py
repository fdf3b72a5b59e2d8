"""One consistent form for text that looks the same but is made of different characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, written

#: Letters of other scripts that are drawn like a Latin letter, each string letter by letter like the one beside it.
CYRILLIC = "АВЕЅІЈКМНОРСТУХԚԜһаеѕіјорсухԁԛԝӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXQWhaesijopcyxdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXocj"
ARMENIAN = "ՏՍՕօսոհցզ"
ARMENIAN_AS = "SUOounhgq"

#: The kinds of compatibility decomposition that leave a character looking the same, by Unicode's tag.
ALIKE_TAGS = ("<wide>", "<narrow>", "<noBreak>")

#: Characters that are ignorable by default, and the annotation marks, which show nothing either.
_IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\uFFF9-\uFFFB]")
_SPACE = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}\t-\r\x85]")
_PLAIN = regex.compile(r"[ -~]*")


@lru_cache(maxsize=1)
def _letters() -> dict[int, str]:
    pairs = (CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS)
    return {ord(a): b for of, as_ in pairs for a, b in zip(of, as_, strict=True)}


@lru_cache(maxsize=100_000)
def _spread(char: str) -> str:
    """A character without the difference that can't be seen: full and half width, ligatures, kinds of space."""
    tag, _, code = unicodedata.decomposition(char).rpartition("> ")
    if tag + ">" in ALIKE_TAGS or tag == "<compat" and "LIGATURE" in unicodedata.name(char, ""):
        return "".join(chr(int(c, 16)) for c in code.split())
    return char


def looks(text: str) -> str:
    """The form that all texts looking like this one share; case, accents, punctuation and spelling stay apart.

    Ignorable characters go, each kind of space is a space, width and ligatures are undone, accents are composed and
    letters of other scripts drawn like a Latin one become it (below any accent).
    """
    if _PLAIN.fullmatch(text):
        return text
    text = _SPACE.sub(" ", _IGNORABLE.sub("", text))
    text = "".join(map(_spread, text))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_letters()))


@lru_cache(maxsize=1)
def _folded_letters() -> dict[int, str]:
    """Lookalike letters after case folding, so that both cases of a word end up the same."""
    return {ord(chr(a).casefold()): b.casefold() for a, b in _letters().items()}


def _fold(look: str) -> str:
    if _PLAIN.fullmatch(look):
        return look.lower()
    once = unicodedata.normalize("NFKC", look).casefold()
    joined = unicodedata.normalize("NFKD", once).translate(_folded_letters())
    return unicodedata.normalize("NFKC", _IGNORABLE.sub("", joined))


def folded(text: str) -> str:
    """The form for searching: compatibility composed, full case folding, one kind of space, nothing ignorable, lookalike letters joined.

    Text that looks the same has one folded form, since it is made from the look; case is folded before the letters that
    remain are joined, so that a word is found in either case, in any script.
    """
    return _fold(looks(text))


FORMS = "struct<look:string,folded:string>"


def forms(text: Column) -> Column:
    """looks() and folded() of a column, once for each distinct value of a batch; null stays null, empty stays empty.

    Text of printable ASCII is formed by Spark: it is its own look.
    """
    ship(SparkSession.active())

    @F.pandas_udf(FORMS)
    def apply(values: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(values)  # null is -1
        look = [looks(v) for v in distinct]
        fold, look = [*map(_fold, look), None], [*look, None]
        return pd.DataFrame({"look": pd.Series([look[i] for i in codes], dtype=object), "folded": pd.Series([fold[i] for i in codes], dtype=object)})

    plain = text.rlike(r"^[ -~]*\z")
    return F.when(plain, F.struct(text.alias("look"), F.lower(text).alias("folded"))).otherwise(apply(F.when(~plain, text)))


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with <column>_looks and <column>_search for each of the columns."""
    for c in columns:
        df = df.withColumn("__forms", forms(F.col(c))).withColumns({f"{c}_looks": F.col("__forms.look"), f"{c}_search": F.col("__forms.folded")}).drop("__forms")
    return df


KEYS = ["vault_id", "type_name", "part"]


def spellings(records: DataFrame) -> DataFrame:
    """(KEYS, id, text, look, folded), once each: the names and paths of records that share their folded form with one that is written unlike it looks.

    The groups of the folded form hold all that can look the same; looks decide within them. Where no text of a look
    differs from it, the look has one spelling only.
    """
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("text")) for c in ("name", "path")])
    rows = records.select("vault_id", "type_name", F.col("record_id").alias("id"), F.explode(parts).alias("x")).select("vault_id", "type_name", "id", "x.*").where("text is not null and vault_id is not null and type_name is not null")
    looked = written(rows.withColumn("f", forms(F.col("text"))).select(*KEYS, "id", "text", "f.look", "f.folded"), "looks")  # else the forms are made again for each use
    odd = looked.where("look <> text").select(*KEYS, "folded").distinct()
    return looked.join(odd, [*KEYS, "folded"], "left_semi").distinct()


def lookalikes(records: DataFrame) -> DataFrame:
    """(record_a, record_b), smaller first: records of one vault_id and type_name whose names, or whose paths, look the same and are different strings.

    A null name or path doesn't count, nor does a null vault_id or type_name. Repeated rows count once. Spellings are
    paired, and pairs of them are expanded to the records that have them.
    """
    held = written(spellings(records), "spellings")
    each = held.select(*KEYS, "folded", "look", "text").distinct()
    a, b = (each.withColumnRenamed("text", t) for t in ("ta", "tb"))
    pairs = a.join(b, [*KEYS, "folded", "look"]).where("ta < tb").select(*KEYS, "ta", "tb")
    one, two = (held.select(*KEYS, F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("a", "ta"), ("b", "tb")))
    both = pairs.join(one, [*KEYS, "ta"]).join(two, [*KEYS, "tb"]).where("a <> b")
    return both.select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b")).distinct()


def look_classes(records: DataFrame) -> DataFrame:
    """(record_id, part, class_id, links): each record with a lookalike, by name or path; no pairs are made.

    A class is all that looks the same within KEYS; its id is the lowest record_id in it. links: its rows that are written differently.
    """
    held = spellings(records)
    by_text = held.groupBy(*KEYS, "look", "text").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    classes = by_text.groupBy(*KEYS, "look").agg(F.sum("n").alias("of"), F.min("first").alias("class_id"), F.count("*").alias("spellings")).where("spellings > 1")
    sizes = by_text.join(classes, [*KEYS, "look"]).select(*KEYS, "text", "class_id", (F.col("of") - F.col("n")).alias("links"))
    return held.join(sizes, [*KEYS, "text"]).select(F.col("id").alias("record_id"), "part", "class_id", "links")
