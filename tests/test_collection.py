"""End to end over folders of notes."""

import datetime as dt
import os
import shutil

import pytest

from notelake.collection import Collection, DanglingError
from notelake.model import FieldType
from notelake.operators.relations import PairError
from notelake.operators.write import StaleError, clean_name, column_of, rows_of, suffixed, with_property

FIXTURES = os.path.join(os.path.dirname(__file__), "fixtures")
PAIR = ("Ships.Owners", "People.Ships")
NOW = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def harbour(spark):
    return Collection.from_folder(spark, f"{FIXTURES}/harbour", now=NOW)


@pytest.fixture(scope="module")
def paired(spark):
    return Collection.from_folder(spark, f"{FIXTURES}/harbour", pairs=[PAIR], dangling="stub", now=NOW)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_types(harbour):
    kinds = {f.name: f.effective_type.value for f in harbour.schema.types["Ships"].fields}
    assert kinds == {"Title": "string", "Built": "date", "Afloat": "boolean", "Crew": "integer", "Owners": "list[link]", "Ports": "list[string]", "Seen": "datetime", "full_text": "string", "Label": "string", "Year": "integer"}
    assert harbour.schema.types["Ships"]["Owners"].link_target == "People" and set(harbour.schema.types) == {"People", "Ships"}


def test_table(harbour):
    df = harbour.dfs["Ships"].df()
    assert df.columns == ["_record", "Label", "Title", "Afloat", "Crew", "Year", "Built", "Seen", "Ports", "Owners", "full_text"]
    assert values(df, "_record", "Crew", "Year", "Label") == [("Aurora", 12, 2021, "Crew: 12"), ("Boreas", 7, 2022, "Crew: 7"), ("Gale", 3, 2023, "Crew: 3")]
    rows = {r["_record"]: r for r in df.collect()}
    assert rows["Gale"]["Owners"] == [] and rows["Gale"]["Ports"] == [] and rows["Aurora"]["Owners"] == ["Ada", "Bo"] and rows["Boreas"]["Owners"] == [] and rows["Aurora"]["full_text"] == "A fast ship."


def test_views(harbour):
    v = harbour.dfs["Ships"].views
    assert list(v) == ["All ships", "Big", "Bare"] and "x" not in v and len(v) == 3
    df = v["All ships"].df()
    assert df.columns == ["_record", "Title", "Built", "Year", "Label"] and [r["_record"] for r in df.collect()] == ["Gale", "Boreas", "Aurora"]
    assert values(v["Big"].df(), "_record") == [("Aurora",), ("Gale",)] and v["Big"].to_pandas().index.names == ["Afloat", "_record"]
    assert len(v["Bare"].df().columns) == 11
    with pytest.raises(KeyError):
        harbour.dfs["Nope"]


def test_exports(harbour, tmp_path):
    t = harbour.dfs["Ships"]
    assert t.to_arrow().num_rows == 3 and str(t.to_pandas()["Crew"].dtype) == "Int64"
    t.to_csv(f"{tmp_path}/csv")
    assert "Kiel, Oslo" in "".join(open(f"{tmp_path}/csv/{n}").read() for n in os.listdir(f"{tmp_path}/csv") if n.endswith(".csv"))
    harbour.dfs.to_parquet(str(tmp_path))
    assert sorted(n for n in os.listdir(tmp_path) if n.endswith(".parquet")) == ["People.parquet", "Ships.parquet"]


def test_stub_and_pair(paired):
    assert values(paired.dfs["People"].df(), "_record", "Ships") == [("Ada", ["Aurora"]), ("Bo", ["Aurora"]), ("Cleo", ["Boreas"])]
    assert paired.schema.types["People"]["Ships"].type == FieldType.LIST_LINKS and {"Guilds"} <= set(paired.schema.types)
    assert values(paired.db.edges("Ships", "Owners"), "source", "target") == [("Aurora", "Ada"), ("Aurora", "Bo"), ("Boreas", "Cleo")]
    assert paired.db.sql("SELECT count(*) AS n FROM Ships__Owners e JOIN People p ON p.record = e.target").first()["n"] == 3


def test_dangling(spark):
    drop = Collection.from_folder(spark, f"{FIXTURES}/dangling")
    rows = {r["_record"]: r for r in drop.dfs["Ships"].df().collect()}
    assert rows["Aurora"]["Owners"] == ["Ada"] and rows["Aurora"]["Mate"] is None and rows["Boreas"]["Funds"] == []
    stub = Collection.from_folder(spark, f"{FIXTURES}/dangling", dangling="stub")
    assert values(stub.dfs["People"].df(), "_record") == [("Ada",), ("Ghost",), ("Phantom",)] and values(stub.dfs["Grants"].df(), "_record") == [("One",), ("Two",)]
    with pytest.raises(DanglingError):
        Collection.from_folder(spark, f"{FIXTURES}/dangling", dangling="error")
    with pytest.raises(ValueError):
        Collection.from_folder(spark, f"{FIXTURES}/dangling", dangling="what")


def test_odd_folder(spark):
    c = Collection.from_folder(spark, f"{FIXTURES}/odd", dangling="keep")
    kinds = {f.name: f.type.value for f in c.schema.types["Items"].fields}
    assert kinds == {"count": "unknown", "when": "unknown", "flag": "unknown", "t": "integer", "map": "unknown", "raw": "list[string]", "full_text": "string"}
    assert c.schema.types["Ships"]["Parties"].link_target is None
    rows = {r["_record"]: r for r in c.dfs["Items"].df().collect()}
    assert rows["a"]["t"] == 750 and rows["a"]["flag"] == "True" and rows["b"]["count"] == "two" and rows["c"]["full_text"].startswith("no front")
    assert {r["flag"] for r in c.dfs["Items"].df(coerce_types=True).collect()} == {1, 3, None}
    rules = {(r["rule"], r["type_name"], r["field_name"]) for r in c.violations.collect()}
    assert {("S-1", "Ships", None), ("S-3", "Lost", None), ("S-4", "Ships", None), ("R-2", "Items", "count"), ("R-2", "Items", "flag"), ("R-3", "Ships", "Parties"), ("R-4", "Ships", None), ("R-1", "Items", "t")} <= rules
    assert ("R-2", "Items", "when") not in rules  # dates count as text
    assert set(Collection.from_folder(spark, f"{FIXTURES}/odd", types=["Ships"]).schema.types) == {"Ships"}


def test_lint_before_and_after(paired):
    before = {r["rule"] for r in paired.violations.collect()}
    after = {r["rule"] for r in paired.lint().collect()}
    assert {"R-4", "R-5", "R-6", "S-1", "R-1"} <= before and "R-5" not in after
    assert "R-1" not in {r["rule"] for r in paired.lint(0.4).collect()}


def test_formula_rules(spark):
    people = spark.createDataFrame([("a", 1)], "k string, n int")
    c = Collection.from_tables({"P": (people, "k")}, now=NOW).add_formulas("P", {"bad": "1 +", "x": "formula.y", "y": "formula.x", "odd": "note.nope", "d": "duration('1d')"})
    got = {(r["rule"], r["field_name"]) for r in c.lint().collect()}
    assert {("F-1", "bad"), ("F-3", "x"), ("F-3", "y"), ("F-2", "odd"), ("F-4", "d")} <= got
    with pytest.raises(ValueError):
        c.add_formulas("P", {"bad": "1 +"}, untranslatable="error")


def test_navigation(paired):
    c = paired
    c.add_formulas("People", {"Fleet": "file.backlinks.map(value.asFile()).filter(value.inFolder('data/Ships')).map(value.properties.Ports).unique().join(',')", "Known": "Guild.asFile().name", "Keys": "file.hasProperty('Guild')", "Big": "file.size > 10"})
    assert values(c.dfs["People"].df(), "_record", "Fleet", "Known") == [("Ada", "Kiel,Oslo", "North"), ("Bo", "Kiel,Oslo", "South"), ("Cleo", "Turku", None)]
    assert {r["Keys"] for r in c.tables["People"].where("_record in ('Ada', 'Bo')").collect()} == {True}


def test_file_namespace(spark, harbour):
    c = Collection.from_folder(spark, f"{FIXTURES}/harbour", now=NOW)
    out = {
        "a": "file.basename + file.ext", "b": "file.folder", "c": "file.size > 0", "d": "file.mtime.year > 2000 && file.ctime.year > 2000", "e": "this.file.name + '/' + this.file.folder", "f": "file.hasProperty('full_text')", "g": "file.properties.Crew", "h": "file.properties.keys().contains('Crew')",
        "i": "file.hasTag('x')", "j": "file.links.length", "k": "file.hasLink('People/Ada')", "l": "file.asLink('me')", "m": "file.path.endsWith('data/Ships/' + file.name + '.md')", "n": "file.file.name", "o": "Owners.map(value.asFile())", "p": "Owners[0].asFile()", "q": "file('[[People/Ada]]').name", "r": "Owners.map(value.asFile().tags.length)",
    }
    c.add_formulas("Ships", out)
    assert not [k for k in c.faults if k[1] in out]
    row = {r["_record"]: r for r in c.tables["Ships"].collect()}["Aurora"]
    assert [row[k] for k in out] == ["Aurora.md", "Ships", True, True, "Ships/bases", True, 12, True, False, 2, True, "[[Aurora|me]]", True, "Aurora", ["[[People/Ada]]", "[[People/Bo]]"], "[[People/Ada]]", "Ada", [0, 0]]


def test_tags(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "k string, tags array<string>")
    c = Collection.from_tables({"T": (df, "k")}, now=NOW).add_formulas("T", {"x": "file.hasTag('z', 'x')", "n": "file.tags.length"})
    assert values(c.tables["T"], "_record", "x", "n") == [("a", True, 2), ("b", False, 0)]


def test_promotion(spark):
    people = spark.createDataFrame([("t", None), ("a", "t"), ("b", "t")], "k string, teacher string")
    other = spark.createDataFrame([("t", ["a"]), ("x", ["a"])], "k string, students array<string>")
    make = lambda: Collection.from_tables({"P": (people, "k"), "T": (other, "k")}, {"P.teacher": "T", "T.students": "P"}, pairs=[("P.teacher", "T.students")], now=NOW)
    c = make().settle("keep")
    assert values(c.dfs["P"].df(), "_record", "teacher") == [("a", ["t", "x"]), ("b", ["t"]), ("t", [])] and c.schema.types["P"]["teacher"].type == FieldType.LIST_LINKS
    assert values(c.dfs["T"].df(), "_record", "students") == [("t", ["a", "b"]), ("x", ["a"])]
    with pytest.raises(PairError):
        make().settle("keep", expand_to_lists=False)


def test_graph(paired, tmp_path):
    g = paired.graph
    assert ("Aurora|Ships", "Ada|People", "Owners") in {tuple(r) for r in g.edges().collect()}
    assert g.undirected().count() == 5 and {r["id"] for r in g.nodes().collect()} >= {"Cleo|People", "North|Guilds"}
    lines = [r["line"] for r in g.ntriples().collect()]
    assert len(lines) == len(set(lines)) and '<http://collection/Ships/Aurora> <http://collection/Crew> "12"^^<http://www.w3.org/2001/XMLSchema#integer> .' in lines
    assert any("inverseOf" in x for x in lines) and g.to_turtle().count("inverseOf") == 2
    g.to_graphml(f"{tmp_path}/g.graphml")
    g.to_gexf(f"{tmp_path}/g.gexf", directed=False)
    import xml.etree.ElementTree as ET

    assert len(ET.parse(f"{tmp_path}/g.graphml").getroot().findall(".//{*}node")) == g.nodes().count() and len(ET.parse(f"{tmp_path}/g.gexf").getroot().findall(".//{*}edge")) == 5
    assert g.names()["Ships"]["relationships"] == {"Owners": "Owners"}
    assert g.cypher_tables()[1]["Owners"].count() == 3 and g.rdf_names()["Ships"]["relationships"] == {"Owners": "http://collection/Owners"}
    assert {r["id"]: r["attrs"].get("Ports") for r in g.flattened().collect()}["Aurora|Ships"] == "Kiel, Oslo"


def test_write(spark, tmp_path):
    root = f"{tmp_path}/h"
    shutil.copytree(f"{FIXTURES}/harbour", root)
    c = Collection.from_folder(spark, root, pairs=[PAIR], now=NOW)
    got = c.expand.add_records("Ships", [{"n": "Zephyr", "Owners": ["[[People/Ada]]"], "full_text": "Hi"}, {"n": "Ga:le"}, {"n": "Gale", "x": 1}], filename_col="n", on_invalid="sanitize", on_collision="suffix")
    assert [r.filename for r in got] == ["Zephyr", "Ga_le", "Gale_2"] and got[1].warnings == ("filename_sanitized",)
    assert open(f"{root}/data/Ships/Zephyr.md").read() == "---\nOwners:\n- '[[People/Ada]]'\nx:\n---\n\nHi\n" and "[[Ships/Zephyr]]" in open(f"{root}/data/People/Ada.md").read()
    before = sorted(os.listdir(f"{root}/data/Ships"))
    with pytest.raises(ValueError, match="row 1"):
        c.expand.add_records("Ships", [{"n": "ok"}, {"n": "a|b"}], filename_col="n")
    assert sorted(os.listdir(f"{root}/data/Ships")) == before
    body = open(f"{root}/data/People/Bo.md").read()
    c.expand.add_column("People", {"Ada": 3}, property_name="Age", on_missing="default")
    assert open(f"{root}/data/People/Bo.md").read() == body.replace("\n---\n", "\nAge:\n---\n")
    with pytest.raises(ValueError):
        c.expand.add_column("People", {"Ada": 4, "Bo": 1}, property_name="Age")
    assert [r.status for r in c.expand.add_column("People", {"Ada": 4}, property_name="Age", on_existing="overwrite", on_missing="skip")] == ["written", "skipped"]
    c.expand.add_type("Harbours", {"n": ["Kiel"], "Depth": [3.5]}, filename_col="n")
    assert values(c.dfs["Harbours"].df(), "_record", "Depth") == [("Kiel", 3.5)]
    open(f"{root}/data/Ships/new.md", "w").write("x")
    assert c.is_stale
    with pytest.raises(StaleError):
        c.expand.add_records("Ships", [{"n": "q"}], filename_col="n")
    assert not c.reload().is_stale


def test_write_tables(spark, tmp_path):
    root = f"{tmp_path}/h"
    shutil.copytree(f"{FIXTURES}/harbour", root)
    c = Collection.from_folder(spark, root, pairs=[PAIR], now=NOW)
    new = spark.createDataFrame([("Zephyr", 4, dt.date(2024, 2, 3), ["[[People/Ada]]", "[[People/Nobody]]"], "Text"), ("Ga:le", None, None, None, None), ("Gale", 1, None, ["[[People/Ada|A]]"], None), (None, 1, None, None, None)], "n string, Crew long, Built date, Owners array<string>, full_text string")
    with pytest.raises(ValueError, match="nothing was written: 3 rows"):
        c.expand.add_table("Ships", new, filename_col="n")
    got = c.expand.add_table("Ships", new, filename_col="n", on_invalid="sanitize", on_collision="suffix", on_missing_filename="skip")
    assert {r["filename"]: tuple(r["warnings"]) for r in got.collect()} == {None: (), "Ga_le": ("filename_sanitized",), "Gale_2": ("filename_suffixed",), "Zephyr": ()}
    rows = {r["_record"]: r for r in c.tables["Ships"].collect()}
    assert set(rows) == {"Aurora", "Boreas", "Gale", "Gale_2", "Ga_le", "Zephyr"} and rows["Zephyr"]["Crew"] == 4 and rows["Zephyr"]["Built"] == dt.date(2024, 2, 3) and rows["Zephyr"]["full_text"] == "Text" and rows["Ga_le"]["Crew"] is None
    assert open(f"{root}/data/People/Ada.md").read().endswith("Ships:\n- '[[Ships/Gale_2]]'\n- '[[Ships/Zephyr]]'\n---\n")
    ages = spark.createDataFrame([("Ada", 30), ("Ada", 40)], "r string, age long")
    with pytest.raises(ValueError):
        c.expand.add_column_table("People", ages, property_name="Age")
    assert values(c.expand.add_column_table("People", ages, property_name="Age", on_missing="skip"), "filename", "status") == [("Ada", "written"), ("Bo", "skipped")]
    assert values(c.tables["People"], "_record", "Age") == [("Ada", 30), ("Bo", None)]


def test_write_helpers(spark):
    import pandas as pd

    assert clean_name("a/b:c. ") == "a_b_c" and clean_name("...") == "_" and clean_name("é") == "é"
    assert rows_of({"a": [1, 2]}) == [{"a": 1}, {"a": 2}] and rows_of(pd.DataFrame({"a": [1]})) == [{"a": 1}] and column_of(pd.Series([1], index=["x"])) == {"x": 1}
    note = "---\na: 1\nb:\n  - x\n  - y\nc: 2\n---\nbody\n"
    assert with_property(note, "b", None) == "---\na: 1\nb:\nc: 2\n---\nbody\n" and with_property(note, "z", [1]) == note.replace("c: 2\n", "c: 2\nz:\n- 1\n") and with_property("plain", "a", 1) == "---\na: 1\n---\nplain"
    names = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a_2"), (4, "a")], "idx long, name string")
    got = {r["idx"]: r["filename"] for r in suffixed(names, spark.createDataFrame([("b",)], "name string")).collect()}
    assert got[0] == "a" and got[2] == "b_2" and got[3] == "a_2" and len(set(got.values()) | {"b"}) == 6


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from notelake.streaming.cells import note_stream, windowed

    root = f"{tmp_path}/h"
    shutil.copytree(f"{FIXTURES}/harbour", root)
    cells = note_stream(spark, root)
    counts = cells.where("field is not null").groupBy("type", "field").count()
    q = counts.writeStream.outputMode("complete").format("memory").queryName("cells_seen").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert spark.sql("select count from cells_seen where type = 'Ships' and field = 'Crew'").first()[0] == 3
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 2, 7)], "ts timestamp, kind string, v double")
    out = windowed(events, "ts", "5 minutes", "1 minute", ["kind"], n=F.count("*"), total=F.sum("v"))
    assert values(out, "kind", "n", "total") == [("a", 1, 1.0), ("a", 2, 2.0)]


@pytest.mark.parametrize(
    "values,kind",
    [([True, False], "boolean"), ([0, 1, 2], "integer"), ([1.0, 2], "number"), ([True, 1], "unknown"), (["2024-01-01"], "string"), ([dt.date(2024, 1, 1)], "date"), ([dt.datetime(2024, 1, 1)], "datetime"), ([dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)], "unknown"), (["[[A/b]]"], "link"),
     (["[[A/b]]", "x"], "string"), ([["[[A/b]]"]], "list[link]"), ([["[[A/b]]", "x"]], "list[mixed]"), ([[1, 2], [3]], "list[integer]"), ([[1.0, 2.5], [3]], "list[number]"), ([["a", 1]], "list[string]"), ([[], ["a"]], "list[string]"), ([None, "", []], "unknown"), ([], "unknown"), ([["a"], "a"], "unknown"), ([{"a": 1}], "unknown"), ([[None, ""]], "list[string]")],
)
def test_inference(spark, values, kind):
    from notelake import of_values

    assert of_values(spark, values)[0].value == kind


def test_link_targets(spark):
    from notelake import of_values

    assert of_values(spark, ["[[A/x]]", "[[data/A/y|z]]"])[1] == "A" and of_values(spark, ["[[A/x]]", "[[B/y]]"])[1] is None and of_values(spark, ["[[x]]"])[1] is None and of_values(spark, [["[[A/x]]"], ["[[A/y]]"]])[1] == "A"
