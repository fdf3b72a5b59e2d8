"""What looks the same and what doesn't; pairs against brute force."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.llm import lookalike
from notelake.llm.lookalike import folded, forms, look_classes, lookalikes, looks, normalised

SAME = [
    ("Tjark", "Ｔjａｒｋ"), ("Noé", "Noé"), ("final", "ﬁnal"), ("offen", "oﬀen"), ("a b", "a b"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "a­b"), ("ab", "﻿ab"), ("ab", "a⁠b"),
    ("Casmar", "Cаѕmаr"), ("Nuria", "Νuria"), ("Hans", "Ηans"), ("ë", "ё"), ("ï", "ї"), ("o", "օ"), ("e​́", "é"), ("ｅ́", "é"), ("7", "７"), ("a,b", "a，b"), ("", "​"),
]
OTHER = [("a", "A"), ("Noé", "Noe"), ("a-b", "a–b"), ("ss", "ß"), ("m2", "m²"), ("a b", "a  b"), ("a", "b"), ("ø", "o"), ("1", "l"), ("ü", "ue"), ("I", "l"), ("½", "1/2"), ("Й", "И")]

RECORDS = "record_id long, vault_id long, type_name string, name string, path string"


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert looks(a) == looks(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert looks(a) != looks(b)


def test_search_form():
    assert folded("Straße ＡＢＣ") == "strasse abc" and folded("ﬁn ²") == "fin 2"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_settled(text):
    assert looks(looks(text)) == looks(text) and looks(unicodedata.normalize("NFD", text)) == looks(unicodedata.normalize("NFC", text))
    assert folded(folded(text)) == folded(text) and folded(looks(text)) == folded(text)


ALPHABET = ["a", "а", "ａ", "b", "​", " ", " ", "é", "é"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from("ST"), st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=3).map("".join)), st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=3).map("".join))), min_size=1, max_size=14))
def test_pairs(spark, rows):
    records = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(records + records[:3] + [(99, None, "S", "a", "a"), (98, None, "S", "а", "а")], RECORDS).withColumns({c: F.lit("clash") for c in ("look", "text", "part", "id", "x", "ta")})
    want = {
        (a[0], b[0]) for a in records for b in records
        if a[0] < b[0] and a[1:3] == b[1:3] and any(a[k] is not None and b[k] is not None and a[k] != b[k] and looks(a[k]) == looks(b[k]) for k in (3, 4))
    }
    got = [tuple(r) for r in lookalikes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {(a[0], part): sum(a[1:3] == b[1:3] and b[k] is not None and a[k] != b[k] and looks(a[k]) == looks(b[k]) for b in records) for a in records for k, part in ((3, "name"), (4, "path")) if a[k] is not None}
    rows = look_classes(df).collect()
    assert {(r["record_id"], r["part"]): r["links"] for r in rows} == {k: n for k, n in links.items() if n} and len(rows) == len([n for n in links.values() if n])


def test_one_look_of_very_many_records(spark):
    many = spark.range(200_000).selectExpr("id AS record_id", "1L AS vault_id", "'S' AS type_name", "if(id = 7, 'Ｎame', 'Name') AS name", "CAST(NULL AS string) AS path")
    assert lookalikes(many).selectExpr("count(*)", "min(least(abs(record_a - 7), abs(record_b - 7)))").first()[:] == (199_999, 0)
    assert look_classes(many).selectExpr("count(*)", "count(DISTINCT class_id)", "sum(links)").first()[:] == (200_000, 1, 2 * 199_999)


def test_columns(spark):
    df = spark.createDataFrame([("Ａ", None), (None, "x" * 200_000), ("", "ａ" * 100_000)], "name string, path string")
    rows = normalised(df, ["name", "path"]).collect()
    assert [r["name_looks"] for r in rows] == ["A", None, ""] and rows[0]["name_search"] == "a" and rows[2]["path_looks"] == "a" * 100_000
    assert lookalikes(spark.createDataFrame([], RECORDS)).count() == 0
    assert df.limit(0).select(forms(F.col("name"))).count() == 0 and look_classes(spark.createDataFrame([], RECORDS)).count() == 0
