"""The general pipeline operators on small fixtures: brute force, ties, nulls, repeated rows, empty tables, clashing columns."""

import datetime as dt
import json
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.operators import drift, incremental, pivot, profile, references

T0 = dt.datetime(2024, 1, 1)
hours = lambda n: T0 + dt.timedelta(hours=n)
SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# -- incremental -----------------------------------------------------------------------------------------------

SCANS = "scan_id long, vault_id long, started_at timestamp, finished_at timestamp, status string, fingerprint string"
FILES = "row_id long, scan_id long, vault_id long, path string, content_hash string, size_bytes long, modified_at timestamp, done boolean, listed_at timestamp"


def replayed(scans, files):
    """The statement of the problem, scan by scan."""
    out, state = set(), {}
    for scan in sorted(scans, key=lambda s: (s[1], s[2])):
        held = state.setdefault(scan[1], {})
        own = {(f[3], f[4], f[7]) for f in files if f[1] == scan[0] and f[3] is not None}
        if scan[4] == "ok":
            out |= {(scan[0], p) for p, h, _ in own if p not in held or held[p] != h}
            state[scan[1]] = {p: h for p, h, _ in own}
        else:
            held.update({p: h for p, h, done in own if done})
    return out


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["ok", "ok", "failed", None]), st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.sampled_from(["1", "2", None]), st.sampled_from([True, False, None])), max_size=8)), min_size=1, max_size=8), st.integers(1, 3))
def test_changed_records(spark, history, collections):
    scans, files = [], []
    for i, (status, listing) in enumerate(history):
        scans.append((100 - i, i % collections, hours(i), None, status, None))
        for j, (p, (h, done)) in enumerate(listing.items()):
            files += [(i * 100 + j, 100 - i, i % collections, p, h, None, None, done, None)] * (1 + j % 2)
    files.append((999, 100, 0, None, "1", 1, None, True, None))
    a = spark.createDataFrame(scans, SCANS).withColumns({"seq": F.lit(0), "next": F.lit("x"), "path": F.lit("clash")})
    b = spark.createDataFrame(files, FILES).withColumns({"tree": F.lit(1), "status": F.lit("ok"), "depth": F.lit(3)})
    assert set(tuples(incremental.changed_records(a, b), "scan_id", "path")) == replayed(scans, files)


def test_changed_records_of_nothing(spark):
    a, b = spark.createDataFrame([], SCANS), spark.createDataFrame([], FILES)
    assert incremental.changed_records(a, b).count() == 0


def test_merkle_descends_only_into_differences(spark):
    rows = [("t", f"k{i}", f"v{i}") for i in range(3_000)] + [("u", "same", "x")]
    now = spark.createDataFrame([("t", "k7", "new"), ("t", "k3001", "y"), *[r for r in rows if r[1] not in ("k7", "k8")]], "tree string, key string, content string")
    saved = spark.createDataFrame(rows, "tree string, key string, content string")
    assert tuples(incremental.changes(now, saved), "key", "change") == [("k3001", "added"), ("k7", "changed"), ("k8", "removed")]
    entries = incremental.with_depth(saved.withColumn("side", F.lit("s")))
    assert entries.where("tree = 't'").first()["depth"] == 2 and entries.where("tree = 'u'").first()["depth"] == 0


def test_store_survives_failures(spark, tmp_path):
    store = incremental.MerkleStore(spark, str(tmp_path))
    make = lambda rows: spark.createDataFrame(rows, "vault long, path string, hash string")
    first = make([(1, "a", "1"), (1, "b", "1"), (1, None, "1"), (1, "b", "1")])
    with pytest.raises(ZeroDivisionError):
        store.run(first, "vault", "path", "hash", process=lambda changes: 1 / 0)
    assert store.state().count() == 0
    assert tuples(store.run(first, "vault", "path", "hash"), "key", "change") == [("a", "added"), ("b", "added")]
    assert store.run(first, "vault", "path", "hash").count() == 0
    assert tuples(store.run(make([(1, "a", "2")]), "vault", "path", "hash"), "key", "change") == [("a", "changed"), ("b", "removed")]
    at = store.manifest.version()
    store.manifest.publish({"run": "x"}, at)
    with pytest.raises(RuntimeError):
        store.manifest.publish({"run": "y"}, at)


@SLOW
@given(st.lists(st.dictionaries(st.tuples(st.sampled_from("uv"), st.integers(0, 400)), st.sampled_from([None, "1", "2"]), max_size=250), min_size=2, max_size=3))
def test_store_follows_the_table(spark, tmp_path_factory, versions):
    store, held = incremental.MerkleStore(spark, str(tmp_path_factory.mktemp("merkle"))), {}
    for version in versions:
        now = {(t, f"k{k}"): c for (t, k), c in version.items()}
        df = spark.createDataFrame([(*k, c) for k, c in now.items()], "vault string, path string, hash string")
        want = {(*k, "added" if k not in held else "removed" if k not in now else "changed") for k in held.keys() | now.keys() if (k in held) != (k in now) or held[k] != now[k]}
        assert set(tuples(store.run(df, "vault", "path", "hash"), "tree", "key", "change")) == want
        assert {(t, k): c for t, k, c in tuples(store.state(), "tree", "key", "content")} == now
        held = now


def test_store_reads_and_writes_changed_leaves_only(spark, tmp_path):
    store = incremental.MerkleStore(spark, str(tmp_path))
    make = lambda changed: spark.createDataFrame([("t", f"k{i}", "new" if i in changed else "v") for i in range(5_000)], "vault string, path string, hash string")
    store.run(make(()), "vault", "path", "hash")
    assert store.run(make((17,)), "vault", "path", "hash").count() == 1
    last = store.manifest.read()["run"]
    assert spark.read.parquet(f"{tmp_path}/{last}/entries").count() < 100 and store.state().count() == 5_000


# -- drift -----------------------------------------------------------------------------------------------------

RAW = "raw_id long, vault_id long, type_name string, file_id long, file_no int, name string, fields string, exported_at timestamp, arrived_at timestamp"


def raw(spark, *files):
    rows, i = [], 0
    for n, records in enumerate(files, 1):
        for name, fields in records:
            i += 1
            rows.append((i, 1, "T", 10 + n, n, name, fields if fields is None or isinstance(fields, str) else json.dumps(fields), None, None))
    return spark.createDataFrame(rows, RAW)


def test_drift(spark):
    a = [("x", {"Old": "u", "Num": 1, "Keep": "[[P/1]]", "Gone": 3, "It's \"odd\".$[0]": 1}), ("y", {"Old": "v", "Num": 2, "Keep": "[[P/2]]", "Gone": 4}), ("y", {"Old": "v", "Num": 2, "Keep": "[[P/2]]", "Gone": 4}), (None, {"Num": 5})]
    b = [("x", {"New": "u", "Num": 1.5, "Keep": "text", "Fresh": True, "It's \"odd\".$[0]": 2}), ("y", {"New": "v", "Num": 2, "Keep": "[[P/2]]", "Empty": []}), ("z", {"New": "other"})]
    df = raw(spark, a, b).withColumns({"old": F.lit(1), "kind": F.lit("x"), "seeds": F.lit(2), "field_name": F.lit("c")})
    assert tuples(drift.changes(df), "file_id", "change_kind", "field_name") == [(12, "added", "Empty"), (12, "added", "Fresh"), (12, "removed", "Gone"), (12, "renamed", "New"), (12, "retyped", "Keep"), (12, "retyped", "Num")]
    out = {(r["name"], r["column_name"]): (r["column_type"], r["value"], r["number"]) for r in drift.unified(df).collect()}
    assert drift.unified(raw(spark, [("x", {"I": 2**53 + 1})])).first()["whole"] == 2**53 + 1
    assert out["x", "New"] == ("string", "u", None) and out["y", "Num"] == ("number", "2", 2.0) and out["x", "Keep"][1] in ("[[P/1]]", "text") and ("x", "Old") not in out


def test_wide_types(spark):
    a = [("x", {"Old": True, "Big": 10**20, "Int": 2**53 + 1, "L": ["a", 1], "titel": "t", "Az.": "[[P/1]]", "Mix": 1, "name": "n"}), ("y", {"Old": False, "Int": 1}), ("y", {"Old": False, "Int": 1}), ("e", {}), ("m", None)]
    b = [("x", {"New": True, "Int": 5, "Num": 1.5, "Titel": "u", "Mix": "a"}), ("y", {"New": False, "Num": 2})]
    table = drift.wide_table(raw(spark, a, b), "T")
    assert dict(table.dtypes) == {"raw_id": "bigint", "vault_id": "bigint", "file_id": "bigint", "name": "string", "Az.": "string", "Big": "decimal(38,0)", "Int": "bigint", "L": "array<string>", "Mix": "string", "New": "boolean", "Num": "double", "Titel": "string", "name_": "string", "titel_": "string"}
    rows = {(r["file_id"], r["name"]): r.asDict() for r in table.collect()}
    values = lambda *k: {c: v for c, v in rows[k].items() if v is not None and c not in ("raw_id", "vault_id", "file_id", "name")}
    assert values(11, "x") == {"New": True, "Big": 10**20, "Int": 2**53 + 1, "L": ["a", "1"], "titel_": "t", "Az.": "[[P/1]]", "Mix": "1", "name_": "n"}
    assert values(12, "y") == {"New": False, "Num": 2.0} and values(11, "e") == values(11, "m") == {} and table.count() == 6
    assert drift.wide_table(raw(spark, a).limit(0), "T").count() == 0 and drift.melted(raw(spark, a).limit(0), "T").count() == 0


def test_fields_that_merge_or_split_keep_apart(spark):
    a = [(n, {"A": n * 2, "B": n * 2, "C": n * 3}) for n in "xyz"]
    b = [(n, {"A2": n * 2, "C1": n * 3, "C2": n * 3}) for n in "xyz"]
    for files in ((a, b), (a[::-1], b[::-1])):
        out = {(r["file_id"], r["name"]): r.asDict() for r in drift.wide_table(raw(spark, *files), "T").collect()}
        row = {k: v for k, v in out[11, "x"].items() if k not in ("raw_id", "vault_id", "file_id", "name") and v is not None}
        assert row == {"A2": "xx", "B": "xx", "C1": "xxx"}


def test_drift_nine_tenths(spark):
    a = [(f"r{i}", {"A": i}) for i in range(10)]
    for agreeing, kinds in ((9, {"renamed"}), (8, {"added", "removed"})):
        b = [(f"r{i}", {"B": i if i < agreeing else -1}) for i in range(10)]
        assert {r["change_kind"] for r in drift.changes(raw(spark, a, b)).collect()} == kinds


def test_drift_types(spark):
    cases = {"boolean": [True, None], "integer": [1, 10**12], "number": [1, 2.5], "list": [["a"], []], "link": ["[[a]]", "[[b|c]]", ""], "string": ["a", "[[b]]"], "unknown": [1, "a"], "unknown ": [None, "", []]}
    rows = [(f"r{i}", {k: v[i] for k, v in cases.items() if i < len(v)}) for i in range(3)]
    got = {f["field_name"]: f["type"] for f in drift.schemas(raw(spark, rows)).first()["fields"]}
    assert got == {k: k.strip() for k in cases}


def test_drift_of_bad_rows(spark):
    assert drift.changes(spark.createDataFrame([], RAW)).count() == 0
    assert drift.changes(raw(spark, [("a", None), ("b", "no json"), ("c", "[1]"), ("d", "")], [("a", {"x": "y" * 100_000})])).count() == 0


def test_flooding_settles_on_the_likely_match():
    scores = drift.flood([("Budget", "integer"), ("Titel", "string")], [("Budgets", "integer"), ("Note", "string")], {("Titel", "Note"): 1.0})
    assert scores[0, 0] > scores[0, 1] and scores[1, 1] > scores[1, 0] and scores.max() == 1


def test_every_supported_pair_is_selected_and_checked():
    side = lambda *names: [(n, "string") for n in names]
    seeds = {("Wert", "Werte"): (10, 10), ("Wert", "Kopie"): (9, 10), ("Ort", "Kopie"): (8, 10), ("Ort", "Zz"): (1, 10)}
    found = {(a, b): (flood, holds) for a, b, _, flood, holds in drift.select(side("Wert", "Ort", "Same"), side("Werte", "Kopie", "Zz", "Same"), seeds)}
    assert {p for p, (_, holds) in found.items() if holds} == {("Wert", "Werte"), ("Wert", "Kopie")} and set(seeds) <= set(found)
    assert found["Wert", "Werte"][0] == 1 and max(f for f, _ in found.values()) > 1 and ("Ort", "Zz") in found


def test_scores_place_a_field_that_splits(spark, monkeypatch):
    a = [(n, {"Wert": n * 2}) for n in "xyz"]
    b = [(n, {"Ablage": n * 2, "Werte": n * 2}) for n in "xyz"]
    placed = {r["column_name"] for r in drift.unified(raw(spark, a, b)).where("file_id = 11").collect()}
    assert placed == {"Werte"}
    even = lambda earlier, later, seeds: drift.np.ones((len(earlier), len(later)))
    seeds = {("Wert", "Ablage"): (3, 3), ("Wert", "Werte"): (3, 3)}
    score = lambda: {x[1]: x[2] for x in drift.select([("Wert", "string")], [("Ablage", "string"), ("Werte", "string")], seeds)}
    by_flood = score()
    monkeypatch.setattr(drift, "flood", even)
    assert by_flood["Werte"] > by_flood["Ablage"] and len(set(score().values())) == 1
    assert drift.one_to_one([(1.0, "Wert", "Ablage"), (1.0, "Wert", "Werte")]) == {"Wert": "Ablage"}


# -- cells: pivot and profile ------------------------------------------------------------------------------------

CELLS = "cell_id long, vault_id long, load_no int, record_id long, type_name string, pos int, field_name string, cell_value string, loaded_at timestamp"
DECLARED = "type_name string, pos int, field_name string, field_type string, link_target string"
VIOLATIONS = "violation_id long, vault_id long, load_no int, severity string, message string, rule string, type_name string, field_name string, details string, found_at timestamp"
KINDS = ["string", "integer", "number", "boolean", "date", "datetime", "link", "list[string]", "list[link]"]


def declared(spark):
    return spark.createDataFrame([("T", i, f"f_{k}", k, None) for i, k in enumerate(KINDS)] + [("U", 0, "name", "integer", None)], DECLARED)


def cells(spark, rows):
    """rows: (record, field, value, loaded, load) with defaults."""
    full = [(i, 1, (r + (0, 1))[4] if len(r) == 5 else 1, r[0], "T", None, r[1], r[2], None if len(r) < 4 or r[3] is None else hours(r[3])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CELLS)


FIT = {
    "string": (["x", " ", "é" * 50_000], []),
    "integer": (["1", " -5 ", "+7", "9223372036854775807", "00012"], ["1.0", "1e3", "9223372036854775808", "٣", "1 2", "--1", "0x1"]),
    "number": (["1", "-1.5", "+2.50", "1e5", "1.5e-3", " 3 "], ["1.", ".5", "inf", "NaN", "1,5", "1e", "1.5.1", "5d"]),
    "boolean": (["true", "FALSE", " yes ", "No", "on", "off"], ["1", "0", "y", "truee"]),
    "date": (["2024-02-29", " 2023-01-31 "], ["2023-02-29", "2024-2-1", "20240101", "2024-01-01 ", "2024-01-01T00:00", "24-01-01", "2024-13-01"]),
    "datetime": (["2024-01-01T10:00", "2024-01-01 10:00:59"], ["2024-01-01", "2024-01-01 24:00", "2024-01-01  10:00", "2024-01-01T10:00Z", "2024-01-01T10:60", "2023-02-29T10:00"]),
    "link": (["[[a]]", " [[a/b|c]] "], ["[[]]", "[a]", "x [[a]]", "[[a]] [[b]]", "[[a[b]]", "a"]),
    "list[string]": (["[]", '["a"]', ' ["a", "[[b]]"] ', "[ ]"], ['["a", 1]', "[1]", '"a"', "[null]", '["a", null]', "a, b", '["a"', "['a']", '{"a": 1}', '["a"] x', '["a",]']),
    "list[link]": (["[]", '["[[a]]", "[[b|c]]"]'], ['["a"]', '["[[a]]", "b"]', '["[[]]"]', "[[a]]", '[["a"]]']),
}
FIT["date"][1].remove("2024-01-01 ")


def test_misfits(spark):
    rows, want = [], set()
    for k in KINDS:
        for i, v in enumerate(FIT[k][0] + FIT[k][1] + ["", "  ", None]):
            r = 1_000 * (KINDS.index(k) + 1) + i
            rows.append((r, f" F_{k.upper()} ", v))
            if v in FIT[k][1]:
                want.add((r, f"f_{k}"))
    rows += [(1, "nope", "x"), (2, None, "x"), (3, "f_integer", "bad", 1), (3, "F_INTEGER", "5", 2), (4, "f_integer", "5", 3), (4, "f_integer", "bad", 3), (5, "f_integer", "5", 1), (5, "f_integer", "bad", None)]
    want |= {(4, "f_integer")}  # the same time: the higher cell_id counts; a null time is the earliest
    df = cells(spark, rows + rows[:5]).withColumns({"slot": F.lit(3), "key": F.lit("k"), "field_type": F.lit("c"), "type_id": F.lit(0)})
    assert set(tuples(pivot.misfits(df, declared(spark)), "record_id", "field_name")) == want


def test_nothing_to_pivot(spark):
    none, some = spark.createDataFrame([], CELLS), cells(spark, [(1, "f_integer", "x")])
    assert pivot.misfits(none, declared(spark)).count() == 0 and pivot.misfits(some, declared(spark).limit(0)).count() == 0
    assert profile.findings(none, declared(spark), spark.createDataFrame([], VIOLATIONS)).count() == 0


RECORDS = "record_id long, vault_id long, load_no int, type_name string, name string, path string, created_at timestamp, deleted_at timestamp, loaded_at timestamp"


def test_wide_table(spark):
    df = cells(spark, [(1, "f_integer", " 7 ", 1), (1, "f_integer", "8", 0), (1, "f_date", "2024-02-29"), (1, "f_list[string]", '["a", "b"]'), (1, "f_boolean", "ON"), (2, "f_number", "bad"), (2, "f_datetime", "2024-01-01T10:00")])
    records = spark.createDataFrame([(1, 1, 1, "T", "old", None, None, None, hours(0)), (1, 1, 1, "T", "one", None, None, None, hours(1))], RECORDS)
    out = {r["record_id"]: r for r in pivot.wide_table(df, declared(spark), records, "T").collect()}
    assert out[1]["name"] == "one" and out[1]["f_integer"] == 7 and out[1]["f_date"] == dt.date(2024, 2, 29) and out[1]["f_list[string]"] == ["a", "b"] and out[1]["f_boolean"] is True
    assert out[2]["name"] is None and out[2]["f_number"] is None and out[2]["f_datetime"] == dt.datetime(2024, 1, 1, 10)
    assert "name_" in pivot.wide_table(df, declared(spark), records, "U").columns


@SLOW
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["f_string", "f_integer"]), st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=20))
def test_runs_merge_in_any_order(spark, tmp_path_factory, rows):
    slots = pivot.Slots(declared(spark))
    df = cells(spark, [(r, f, str(v), t, 1) for r, f, t, v in rows])
    folder = str(tmp_path_factory.mktemp("wide"))
    store = pivot.WideStore(spark, folder, declared(spark))
    assert store.read() is None
    for k in (2, 0, 1, 0):
        store.upsert(df.where(F.col("cell_id") % 3 == k))
    seen = [tuples(store.read(), "record_id", "s0", "s1")]
    store.compact()
    seen += [tuples(store.read(), "record_id", "s0", "s1"), tuples(pivot.latest(df, slots), "record_id", "s0", "s1")]
    assert len(store.runs()) == 1 and seen[0] == seen[1] == seen[2]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.integers(-20, 20), st.floats(-9, 9, allow_nan=False)), st.integers(1, 4)), min_size=1, max_size=40))
def test_medians_of_large_groups(spark, rows):
    df = spark.createDataFrame([(g, float(x), n) for g, x, n in rows], "g int, x double, n long")
    want = {g: statistics.median([float(x) for h, x, n in rows for _ in range(n) if h == g]) for g, _, _ in rows}
    for per_task in (4, 100_000):
        got = {r["g"]: r["median"] for r in profile.medians(df, ["g"], per_task=per_task).collect()}
        assert got == pytest.approx(want)


def test_findings(spark):
    rows = []
    for load, values in ((1, ["a", "b", "c", "d", "e"] * 4), (2, ["a"] * 20), (3, ["a"] * 15 + ["", " ", None, "", ""]), (5, ["z"] * 20)):
        rows += [(100 * load + i, "f_string", v, 0, load) for i, v in enumerate(values)]
    for load, values in ((1, ["10"] * 10), (2, ["40"] * 8 + ["x", "y"]), (3, ["-1"] * 10)):
        rows += [(100 * load + i, "f_integer", v, 0, load) for i, v in enumerate(values)]
    lint = [(i, 1, load, None, None, None, None, f, None, None) for load in (1, 2) for i, f in ((load * 10, "a"), (load * 10 + 1, "b" if load == 1 else " "), (load * 10 + 1, "b" if load == 1 else " "))]
    out = profile.findings(cells(spark, rows + rows[:7]), declared(spark), spark.createDataFrame(lint, VIOLATIONS).withColumn("share", F.lit(1)))
    assert tuples(out, "table_name", "load_no", "field_name", "finding") == [
        ("cells", 2, "f_integer", "invalid"), ("cells", 2, "f_integer", "level"), ("cells", 2, "f_string", "distinct"), ("cells", 2, "f_string", "shares"), ("cells", 3, "f_integer", "level"), ("cells", 3, "f_string", "nulls"), ("lint_violations", 2, "field_name", "nulls"),
    ]


def test_profile(spark):
    p = {r["field_id"]: r for r in profile.profile(profile.counted(cells(spark, [(i, "f_number", v) for i, v in enumerate(["1.5", "2.5", "2.5", "x", None])]), declared(spark))).collect()}
    r = p[2]
    assert (r["rows"], r["blanks"], r["distinct"], r["invalid"], r["s0"], float(r["s1"]), float(r["s2"]), r["median"]) == (5, 1, 3, 1, 3, 6.5, 14.75, 2.5)


def test_ranges_compare_typed_values(spark):
    given = {"integer": ["9", "100", " -5 ", "1x", "9007199254740993"], "number": ["9.5", "1e2", "-20", "x"], "date": ["2024-02-29", "2023-01-31", "0"], "datetime": ["2024-01-01 10:00", "2024-01-01T09:59:58", "zz"], "string": ["b", "a9", "a100", " "], "boolean": ["yes", "no", "0"]}
    rows = [(i, f"f_{k}", v) for k, values in given.items() for i, v in enumerate(values)]
    p = {KINDS[r["field_id"]]: r for r in profile.profile(profile.counted(cells(spark, rows), declared(spark))).collect()}
    want = {"integer": ("integer", -5, 9007199254740993), "number": ("number", -20.0, 100.0), "date": ("time", dt.datetime(2023, 1, 31), dt.datetime(2024, 2, 29)), "datetime": ("time", dt.datetime(2024, 1, 1, 9, 59, 58), dt.datetime(2024, 1, 1, 10)), "string": ("text", "a100", "b"), "boolean": ("text", "no", "yes")}
    for kind, (k, least, most) in want.items():
        assert (p[kind][f"least_{k}"], p[kind][f"most_{k}"]) == (least, most)
        assert all(p[kind][c] is None for c in profile.RANGES if not c.endswith(f"_{k}"))


def test_sums_are_of_all_numbers_or_null(spark):
    loads = {1: ["1", "2", "6"], 2: ["1", "2", "1000000000000"], 3: ["1", "2", "1e23"], 4: ["1", "2", "6"], 5: ["3", "3", "9"]}
    rows = [(10 * load + i, "f_number", v, 0, load) for load, values in loads.items() for i, v in enumerate(values)]
    p = {r["load_no"]: r for r in profile.profile(profile.counted(cells(spark, rows), declared(spark))).collect()}
    assert [None if p[n]["s1"] is None else float(p[n]["s1"]) for n in (1, 2, 3, 4)] == [9, 1e12 + 3, None, 9]
    assert [None if p[n]["s2"] is None else float(p[n]["s2"]) for n in (1, 2, 3, 4)] == [41, 1e24 + 5, None, 41]
    assert p[2]["deviation"] == pytest.approx(statistics.pstdev([1, 2, 10**12])) and p[3]["deviation"] is None and p[3]["mean"] is None
    assert [p[n]["shift"] is None for n in (1, 2, 3, 4, 5)] == [True, False, True, True, False]
    assert p[3]["median"] == 2


def test_profile_of_very_common_and_very_close_numbers(spark):
    """Values are counted, not repeated; the deviation of numbers far from 0 is that of their decimals."""
    rows = [(1, 1, 0, "number", v, n, False, True) for v, n in (("7", 3_000_000_000), ("7.0", 10**12), ("9", 10**12), ("1", 5))] + [(1, 2, 0, "number", v, 1, False, True) for v in ("1000000000.1", "1000000000.2", "1000000000.3")]
    df = spark.createDataFrame(rows, "vault_id long, load_no int, field_id int, field_type string, value string, n long, empty boolean, valid boolean")
    p = {r["load_no"]: r for r in profile.profile(df).collect()}
    of = 2 * 10**12 + 3 * 10**9 + 5
    assert (p[1]["s0"], p[1]["median"], p[1]["s1"]) == (of, 7.0, float(16 * 10**12 + 21 * 10**9 + 5)) and p[1]["deviation"] == pytest.approx(1, abs=0.01)
    assert p[2]["mean"] == 1000000000.2 and p[2]["deviation"] == pytest.approx(statistics.pstdev([0.1, 0.2, 0.3]), rel=1e-12)


@SLOW
@given(st.lists(st.lists(st.integers(-20, 60), min_size=1, max_size=6), min_size=2, max_size=6))
def test_levels_against_plain_medians(spark, loads):
    """Brackets of the power sums decide some, medians the rest; together they are what plain medians say."""
    rows = [(1, i, 0, "integer", str(v), 1, False, True) for i, values in enumerate(loads) for v in set(values)]
    df = spark.createDataFrame(rows, "vault_id long, load_no int, field_id int, field_type string, value string, n long, empty boolean, valid boolean")
    m = [statistics.median(set(values)) for values in loads]
    want = [i for i in range(1, len(m)) if (m[i] != 0 if m[i - 1] == 0 else m[i] / m[i - 1] >= 4 or m[i] / m[i - 1] <= 0.25)]
    both = profile._pairs(profile.measured(df), ["vault_id", "field_id"])
    assert sorted(r["load_no"] for r in profile.levels(df, both, 4).collect()) == want


def test_profile_leaves_no_field_out(spark):
    rows = [(1, "f_integer", "7"), (1, " CSSclass ", "old", 0), (1, "cssclass", "new", 1), (2, "cssCLASS", " ", 1), (3, None, "x"), (4, "tmp", "a", 0, 2), (4, "tmp", "a", 0, 2)]
    lint = [(i, 1, load, None, None, None, None, f, None, None) for i, load, f in ((1, 1, "a"), (1, 1, "a"), (2, 1, "b"), (3, 1, "a"), (4, 1, None), (5, 2, " "))]
    df = cells(spark, rows + rows[:4])
    out = {tuple(r[c] for c in ("table_name", "load_no", "type_name", "field_name")): r for r in profile.whole_profile(df, declared(spark), spark.createDataFrame(lint, VIOLATIONS)).collect()}
    want = {
        ("cells", 1, "T", "f_integer"): ("integer", 1, 0, 1, None, None), ("cells", 1, "T", "cssclass"): ("string", 2, 1, 1, "new", "new"), ("cells", 1, "T", None): ("string", 1, 0, 1, "x", "x"), ("cells", 2, "T", "tmp"): ("string", 1, 0, 1, "a", "a"),
        ("lint_violations", 1, "*", "field_name"): ("string", 4, 1, 2, "a", "b"), ("lint_violations", 2, "*", "field_name"): ("string", 1, 1, 0, None, None),
    }
    assert {k: tuple(r[c] for c in ("field_type", "rows", "blanks", "distinct", "least_text", "most_text")) for k, r in out.items()} == want
    assert out["cells", 1, "T", "f_integer"]["median"] == 7


# -- references --------------------------------------------------------------------------------------------------

LINKS = "link_id long, vault_id long, source_id long, type_name string, field_name string, target string, linked_at timestamp, loaded_at timestamp"


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.integers(0, 9))), max_size=8), st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=15), st.booleans())
def test_orphans(spark, parents, refs, salted):
    records = [(i, 1, 1, "P", n, None, None if b is None else hours(b), None if e is None else hours(e), None) for i, (n, b, e) in enumerate(parents)] + [(90, None, 1, "P", "a", None, None, None, None), (91, 1, 1, None, "a", None, None, None, None)]
    links = [(i, 1, 1, "S", "f", (f"[[{n}]]", f" [[x/P/{n}|y]] ")[i % 2], None if t is None else hours(t), None) for i, (n, t) in enumerate(refs)] + [(80, 1, 1, "S", "other", "[[a]]", hours(1), None), (81, 1, 1, "S", "f", "plain", hours(1), None), (82, 1, 1, "S", "f", None, None, None), (83, 2, 1, "S", "f", "[[a]]", hours(1), None), (84, 1, 1, "S", "f", "[[a]] b]]", hours(1), None)]
    want = {(80, "missing"), (83, "missing")}
    for i, (n, t) in enumerate(refs):
        own = [(b, e) for m, b, e in parents if m == n]
        at = 10**6 if t is None else t
        begin = lambda b: -1 if b is None else b
        if any(begin(b) <= at and (e is None or at < e) and (e is None or e > begin(b)) for b, e in own):
            continue
        want.add((i, "missing" if not own else "late" if any(begin(b) > at for b, _ in own) else "deleted"))
    a = spark.createDataFrame(links + links[:3], LINKS).withColumns({"name": F.lit("x"), "type": F.lit("P"), "default_type": F.lit("q"), "salt": F.lit(5), "path": F.lit("c")})
    b = spark.createDataFrame(records + records[:2], RECORDS).withColumns({"begin": F.lit(0), "at": F.lit(0)})
    schema = spark.createDataFrame([("S", 0, "f", "link", "P")], DECLARED)
    assert set(tuples(references.orphans(a, b, schema, per_task=2 if salted else 10**6), "link_id", "reason")) == want


def test_hot_keys_are_salted(spark):
    links = spark.createDataFrame([(i, 1, 1, "S", "f", "[[hot]]", hours(i % 9), None) for i in range(400)], LINKS)
    schema = spark.createDataFrame([("S", 0, "f", "link", "P")], DECLARED)
    hot = references.hot_keys(references.references(links, schema), 100)
    assert [tuple(r) for r in hot.collect()] == [(1, "P", "hot", 4)]
    records = spark.createDataFrame([(1, 1, 1, "P", "hot", None, hours(3), hours(6), None)], RECORDS)
    got = references.orphans(links, records, schema, per_task=100).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in got} == {"late": sum(i % 9 < 3 for i in range(400)), "deleted": sum(i % 9 >= 6 for i in range(400))}


def test_no_references(spark):
    schema = spark.createDataFrame([], DECLARED)
    found = references.orphans(spark.createDataFrame([], LINKS), spark.createDataFrame([], RECORDS), schema)
    assert found.count() == 0 and references.orphan_report(found).count() == 0
