"""The queries of the general data-pipeline operators, over whole tables, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, incremental, pivot, profile, references
from ..session import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changed_records(table(spark, sf_dir, "scans"), table(spark, sf_dir, "scan_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "raw_records"))


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified table, counted by row: every field of every row is in it once, and every value."""
    each = drift.unified(table(spark, sf_dir, "raw_records"))
    return each.groupBy("raw_id", "vault_id", "type_name", "file_id", "name").agg(F.count("*").alias("fields"), F.count("value").alias("values_"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "raw_records"))


def p2_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values in all tables of a type, with the types of their columns; numbers as such beside their text."""
    each = [drift.melted(table(spark, sf_dir, "raw_records"), t) for t in TYPES]
    out = reduce(DataFrame.unionByName, each).where("value is not null")
    number = F.col("column_type") == "double"
    return out.withColumn("number", F.when(number, F.col("value").cast("double"))).withColumn("value", F.when(~number, F.col("value")))


def _typed(type_name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: drift.wide_table(table(spark, sf_dir, "raw_records"), type_name)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.findings(table(spark, sf_dir, "cells"), table(spark, sf_dir, "schema_fields"), table(spark, sf_dir, "lint_violations"))


MEASURES = ("rows", "blanks", "distinct", "invalid", *profile.RANGES, "s0", "s1", "s2", "median", "mean")


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "schema_fields")
    return profile.named(profile.profile(written(profile.counted(table(spark, sf_dir, "cells"), declared), "values")), declared)


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir).select(*profile.GROUP, "field_type", *MEASURES, F.round("deviation", 4).alias("deviation"), F.round("shift", 4).alias("shift"))


def p4_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every field of cells, declared or not, and of the field_name of lint_violations."""
    out = profile.whole_profile(*(table(spark, sf_dir, t) for t in ("cells", "schema_fields", "lint_violations")))
    return out.select("table_name", *profile.GROUP, "field_type", *MEASURES, F.round("deviation", 4).alias("deviation"), F.round("shift", 4).alias("shift"))


def p4_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and most valid value of each column, compared by type: numbers as numbers, days and times as such, all else as text."""
    declared = table(spark, sf_dir, "schema_fields")
    values = profile.counted(table(spark, sf_dir, "cells"), declared)
    return profile.named(values.groupBy(*profile.IDS, "field_type").agg(*profile.ranges()), declared).select(*profile.GROUP, "field_type", *profile.RANGES)


def p4_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns whose mean moved by more than half a pooled deviation since the load before."""
    out = _profiled(spark, sf_dir).where(F.abs("shift") > 0.5)
    return out.select(*profile.GROUP, "mean", F.round("deviation", 4).alias("deviation"), F.round("shift", 4).alias("shift"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot.misfits(table(spark, sf_dir, "cells"), table(spark, sf_dir, "schema_fields"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("link_id", "reason")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, sf_dir))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphans(*(table(spark, sf_dir, t) for t in ("record_links", "records", "schema_fields")))


def _wide(type_name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pivot.wide_table(*(table(spark, sf_dir, t) for t in ("cells", "schema_fields", "records")), type_name)

    return query


TYPES = "Projekte", "Personen", "Veranstaltungen", "Orte", "Organisationen", "Foerderprogramme"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (p1_found, p2_found, p2_unified, p2_rows, p2_typed, p4_found, p4_profile, p4_profile_all, p4_ranges, p4_shifts, p5_found, p6_found, p6_report)}
    own |= {f"p2_wide_{t.lower()}": _typed(t) for t in TYPES}
    return own | {f"p5_wide_{t.lower()}": _wide(t) for t in TYPES}


COUNTING = """
    declared AS (SELECT type_name, lower(trim(field_name, ' ')) AS key, field_name, field_type FROM schema_fields),
    ranked AS (
        SELECT c.vault_id, c.load_no, c.record_id, c.type_name, d.field_name, d.field_type, c.cell_value AS v, trim(c.cell_value, ' ') AS t,
               row_number() OVER (PARTITION BY c.record_id, c.type_name, d.field_name ORDER BY c.loaded_at DESC, c.cell_id DESC) AS rn
        FROM cells c JOIN declared d ON c.type_name = d.type_name AND lower(trim(c.field_name, ' ')) = d.key),
    latest AS (SELECT *, t IS NULL OR t = '' AS empty, TRY_CAST(t AS JSON) AS j FROM ranked WHERE rn = 1),
    judged AS (
        SELECT *, NOT empty AND CASE field_type
            WHEN 'integer' THEN regexp_full_match(t, '[+-]?[0-9]+') AND TRY_CAST(t AS BIGINT) IS NOT NULL
            WHEN 'number' THEN regexp_full_match(t, '[+-]?[0-9]+([.][0-9]+)?(e[+-]?[0-9]+)?')
            WHEN 'boolean' THEN lower(t) IN ('true', 'false', 'yes', 'no', 'on', 'off')
            WHEN 'date' THEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(t AS DATE) IS NOT NULL
            WHEN 'datetime' THEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?') AND TRY_CAST(t[1:10] AS DATE) IS NOT NULL
            WHEN 'link' THEN regexp_full_match(t, '\\[\\[[^\\[\\]]+\\]\\]')
            WHEN 'list[string]' THEN coalesce(json_type(j) = 'ARRAY' AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0, false)
            WHEN 'list[link]' THEN coalesce(json_type(j) = 'ARRAY' AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) <> 'VARCHAR' OR NOT regexp_full_match(trim(json_extract_string(x, '$'), ' '), '\\[\\[[^\\[\\]]+\\]\\]'))) = 0, false)
            ELSE true END AS valid
        FROM latest)"""

P1_FOUND = """
    WITH numbered AS (SELECT scan_id, vault_id, coalesce(status = 'ok', false) AS ok, row_number() OVER (PARTITION BY vault_id ORDER BY started_at, scan_id) AS seq FROM (SELECT DISTINCT * FROM scans)),
    prior AS (SELECT *, max(CASE WHEN ok THEN seq END) OVER (PARTITION BY vault_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ok FROM numbered),
    rows AS (SELECT DISTINCT p.vault_id, p.scan_id, p.seq, p.ok, p.last_ok, f.path, f.content_hash, coalesce(f.done, false) AS done FROM scan_files f JOIN prior p USING (scan_id)),
    held AS (SELECT *, lag(content_hash) OVER w AS before, lag(seq) OVER w AS before_seq FROM rows WHERE ok OR done WINDOW w AS (PARTITION BY vault_id, path ORDER BY seq))
    SELECT scan_id, path FROM held WHERE ok AND NOT coalesce(before_seq >= coalesce(last_ok, 0) AND before = content_hash, false)"""

P2_FOUND = """
    WITH once AS (SELECT DISTINCT vault_id, type_name, file_id, file_no, name, fields FROM raw_records),
    keyed AS (SELECT vault_id, type_name, file_id, file_no, name, fields::JSON AS f, unnest(json_keys(fields::JSON)) AS k FROM once),
    cell AS (SELECT DISTINCT vault_id, type_name, file_id, file_no, name, k, json_extract(f, '$."' || k || '"') AS x FROM keyed),
    kinds AS (SELECT *, json_type(x) AS t, json_extract_string(x, '$') AS s FROM cell),
    filled AS (SELECT *, NOT (t = 'NULL' OR (t = 'VARCHAR' AND s = '') OR (t = 'ARRAY' AND x::VARCHAR = '[]')) AS full_,
        CASE WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'number' WHEN t = 'ARRAY' THEN 'list'
             WHEN t = 'VARCHAR' THEN CASE WHEN s LIKE '[[%]]' THEN 'link' ELSE 'string' END ELSE 'object' END AS kind FROM kinds),
    fields AS (SELECT vault_id, type_name, file_id, file_no, k, CASE
        WHEN count(*) FILTER (full_) = 0 THEN 'unknown'
        WHEN bool_and(kind = 'boolean') FILTER (full_) THEN 'boolean' WHEN bool_and(kind = 'integer') FILTER (full_) THEN 'integer'
        WHEN bool_and(kind IN ('integer', 'number')) FILTER (full_) THEN 'number' WHEN bool_and(kind = 'list') FILTER (full_) THEN 'list'
        WHEN bool_and(kind = 'link') FILTER (full_) THEN 'link' WHEN bool_and(kind IN ('link', 'string')) FILTER (full_) THEN 'string' ELSE 'unknown' END AS type FROM filled GROUP BY ALL),
    files AS (SELECT DISTINCT vault_id, type_name, file_id, file_no FROM fields),
    moves AS (SELECT b.file_id, a.file_id AS earlier FROM files a JOIN files b ON a.vault_id = b.vault_id AND a.type_name = b.type_name AND a.file_no + 1 = b.file_no),
    gone AS (SELECT m.*, f.k FROM moves m JOIN fields f ON f.file_id = m.earlier WHERE NOT EXISTS (SELECT 1 FROM fields g WHERE g.file_id = m.file_id AND g.k = f.k)),
    fresh AS (SELECT m.*, f.k FROM moves m JOIN fields f ON f.file_id = m.file_id WHERE NOT EXISTS (SELECT 1 FROM fields g WHERE g.file_id = m.earlier AND g.k = f.k)),
    met AS (SELECT g.file_id, g.k AS old, h.k AS new, count(DISTINCT a.name) AS both_, count(DISTINCT CASE WHEN a.x::VARCHAR = b.x::VARCHAR THEN a.name END) AS agree
        FROM gone g JOIN fresh h ON g.file_id = h.file_id JOIN filled a ON a.file_id = g.earlier AND a.k = g.k AND a.full_ JOIN filled b ON b.file_id = h.file_id AND b.k = h.k AND b.full_ AND a.name = b.name GROUP BY ALL),
    renamed AS (SELECT * FROM met WHERE agree * 10 >= both_ * 9)
    SELECT DISTINCT file_id, 'renamed' AS change_kind, new AS field_name FROM renamed
    UNION ALL SELECT file_id, 'removed', k FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = g.file_id AND r.old = g.k)
    UNION ALL SELECT file_id, 'added', k FROM fresh g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = g.file_id AND r.new = g.k)
    UNION ALL SELECT m.file_id, 'retyped', a.k FROM moves m JOIN fields a ON a.file_id = m.earlier JOIN fields b ON b.file_id = m.file_id AND a.k = b.k WHERE a.type <> b.type"""

P4_FOUND = f"""
    WITH {COUNTING},
    stats AS (SELECT vault_id, load_no, type_name, field_name, field_type, count(*) AS n, count(*) FILTER (empty) AS blanks, count(DISTINCT v) FILTER (NOT empty) AS kinds,
        count(*) FILTER (NOT empty AND NOT valid) AS bad, median(CASE WHEN valid AND field_type IN ('integer', 'number') THEN TRY_CAST(t AS DOUBLE) END) AS med FROM judged GROUP BY ALL),
    both_ AS (SELECT c.*, b.n AS n0, b.blanks AS blanks0, b.kinds AS kinds0, b.bad AS bad0, b.med AS med0
        FROM stats c JOIN stats b ON c.vault_id = b.vault_id AND c.type_name = b.type_name AND c.field_name = b.field_name AND c.load_no = b.load_no + 1),
    shown AS (SELECT j.vault_id, j.load_no, j.type_name, j.field_name, v, count(*) / (s.n - s.blanks) AS share FROM judged j JOIN stats s USING (vault_id, load_no, type_name, field_name)
        WHERE NOT empty AND j.field_type = 'string' AND s.kinds BETWEEN 1 AND 12 GROUP BY j.vault_id, j.load_no, j.type_name, j.field_name, v, s.n, s.blanks),
    common AS (SELECT b.vault_id, b.load_no, b.type_name, b.field_name, coalesce(sum(least(x.share, coalesce(y.share, 0))), 0) AS common FROM both_ b
        LEFT JOIN shown x ON x.vault_id = b.vault_id AND x.load_no = b.load_no AND x.type_name = b.type_name AND x.field_name = b.field_name
        LEFT JOIN shown y ON y.vault_id = b.vault_id AND y.load_no = b.load_no - 1 AND y.type_name = b.type_name AND y.field_name = b.field_name AND y.v = x.v
        WHERE b.field_type = 'string' AND b.kinds BETWEEN 1 AND 12 AND b.kinds0 BETWEEN 1 AND 12 GROUP BY ALL),
    loads AS (SELECT vault_id, load_no, avg(CASE WHEN field_name IS NULL OR trim(field_name, ' ') = '' THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT DISTINCT violation_id, vault_id, load_no, field_name FROM lint_violations) GROUP BY ALL),
    said AS (
        SELECT *, 'nulls' AS finding FROM both_ WHERE abs(blanks / n - blanks0 / n0) > 0.201
        UNION ALL SELECT *, 'distinct' FROM both_ WHERE field_type = 'string' AND kinds > 0 AND kinds0 > 0 AND (kinds * 2 <= kinds0 OR kinds >= kinds0 * 2)
        UNION ALL SELECT *, 'level' FROM both_ WHERE field_type IN ('integer', 'number') AND CASE WHEN med0 = 0 THEN med <> 0 ELSE med / med0 >= 4 OR med / med0 <= 0.25 END
        UNION ALL SELECT *, 'invalid' FROM both_ WHERE field_type <> 'string' AND n > blanks AND n0 > blanks0 AND bad / (n - blanks) - bad0 / (n0 - blanks0) > 0.101)
    SELECT 'cells' AS table_name, vault_id, load_no, type_name, field_name, finding FROM said
    UNION ALL SELECT 'cells', vault_id, load_no, type_name, field_name, 'shares' FROM common WHERE 1 - common > 0.351
    UNION ALL SELECT 'lint_violations', c.vault_id, c.load_no, '*', 'field_name', 'nulls' FROM loads c JOIN loads b ON c.vault_id = b.vault_id AND c.load_no = b.load_no + 1 WHERE abs(c.share - b.share) > 0.201"""

TYPED_RANGES = """
        min(TRY_CAST(t AS BIGINT)) FILTER (valid AND field_type = 'integer') AS least_integer, max(TRY_CAST(t AS BIGINT)) FILTER (valid AND field_type = 'integer') AS most_integer,
        min(TRY_CAST(t AS DOUBLE)) FILTER (valid AND field_type = 'number') AS least_number, max(TRY_CAST(t AS DOUBLE)) FILTER (valid AND field_type = 'number') AS most_number,
        min(TRY_CAST(replace(t, 'T', ' ') AS TIMESTAMP)) FILTER (valid AND field_type IN ('date', 'datetime')) AS least_time, max(TRY_CAST(replace(t, 'T', ' ') AS TIMESTAMP)) FILTER (valid AND field_type IN ('date', 'datetime')) AS most_time,
        min(v) FILTER (valid AND field_type NOT IN ('integer', 'number', 'date', 'datetime')) AS least_text, max(v) FILTER (valid AND field_type NOT IN ('integer', 'number', 'date', 'datetime')) AS most_text"""

P4_RANGES = f"WITH {COUNTING} SELECT vault_id, load_no, type_name, field_name, field_type, {TYPED_RANGES} FROM judged GROUP BY ALL"

#: Sums are exact here too (values have at most 4 decimals); deviation is DuckDB's own.
MEASURED = f"""
    stats AS (SELECT table_name, vault_id, load_no, type_name, field_name, field_type, count(*) AS rows, count(*) FILTER (empty) AS blanks, count(DISTINCT v) FILTER (NOT empty) AS distinct, count(*) FILTER (NOT empty AND NOT valid) AS invalid, {TYPED_RANGES},
        nullif(count(d), 0) AS s0, sum(x)::DOUBLE AS s1, sum(x * x)::DOUBLE AS s2, median(d) AS median, stddev_pop(d) AS deviation FROM x GROUP BY ALL),
    shown AS (SELECT *, s1 / s0 AS mean FROM stats),
    moved AS (SELECT c.* EXCLUDE (deviation), round(c.deviation, 4) AS deviation, round(CASE WHEN c.deviation > 0 OR b.deviation > 0 THEN (c.mean - b.mean) / sqrt((c.deviation ** 2 + b.deviation ** 2) / 2) END, 4) AS shift
        FROM shown c LEFT JOIN shown b ON c.table_name = b.table_name AND c.vault_id = b.vault_id AND c.type_name = b.type_name AND c.field_name = b.field_name AND c.load_no = b.load_no + 1)"""

NUMBERS = "CASE WHEN valid AND field_type IN ('integer', 'number') THEN TRY_CAST(t AS DOUBLE) END AS d, TRY_CAST(d AS DECIMAL(19, 4)) AS x"

P4_MOVED = f"WITH {COUNTING}, x AS (SELECT 'cells' AS table_name, *, {NUMBERS} FROM judged), {MEASURED}"

P4_PROFILE = f"{P4_MOVED} SELECT * EXCLUDE (table_name) FROM moved"

P4_SHIFTS = f"{P4_MOVED} SELECT vault_id, load_no, type_name, field_name, mean, deviation, shift FROM moved WHERE abs(shift) > 0.5"

P4_PROFILE_ALL = f"""
    WITH {COUNTING},
    loose AS (SELECT *, lower(trim(field_name, ' ')) AS key FROM cells),
    undeclared AS (SELECT vault_id, load_no, type_name, key AS field_name, cell_value AS v, row_number() OVER (PARTITION BY vault_id, record_id, type_name, key ORDER BY loaded_at DESC, cell_id DESC) AS rn
        FROM loose l WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.type_name = l.type_name AND d.key = l.key)),
    said AS (SELECT DISTINCT violation_id, vault_id, load_no, field_name FROM lint_violations),
    every AS (
        SELECT 'cells' AS table_name, vault_id, load_no, type_name, field_name, field_type, v, t, empty, valid FROM judged
        UNION ALL SELECT 'cells', vault_id, load_no, type_name, field_name, 'string', v, v, v IS NULL OR trim(v, ' ') = '', NOT (v IS NULL OR trim(v, ' ') = '') FROM undeclared WHERE rn = 1
        UNION ALL SELECT 'lint_violations', vault_id, load_no, '*', 'field_name', 'string', field_name, field_name, field_name IS NULL OR trim(field_name, ' ') = '', NOT (field_name IS NULL OR trim(field_name, ' ') = '') FROM said),
    x AS (SELECT *, {NUMBERS} FROM every), {MEASURED}
    SELECT * FROM moved"""

P2_UNIFIED = """
    WITH once AS (SELECT vault_id, type_name, file_id, file_no, name, fields, min(raw_id) AS raw_id FROM raw_records GROUP BY ALL),
    keyed AS (SELECT *, fields::JSON AS f, unnest(json_keys(fields::JSON)) AS k FROM once),
    cell AS (SELECT raw_id, vault_id, type_name, file_id, name, json_extract(f, '$."' || k || '"') AS x FROM keyed)
    SELECT raw_id, vault_id, type_name, file_id, name, count(*) AS fields, count(*) FILTER (NOT (json_type(x) = 'NULL' OR x::VARCHAR IN ('""', '[]'))) AS values_ FROM cell GROUP BY ALL"""

#: The columns follow from the data, so the tables are compared value by value.
PLACED = P2_FOUND[: P2_FOUND.index("\n    SELECT DISTINCT file_id, 'renamed'")].replace("WITH once", "WITH RECURSIVE once", 1) + """,
    walk(file_id, k, here, name, depth) AS (SELECT file_id, k, file_id, k, 0 FROM fields UNION ALL
        SELECT w.file_id, w.k, m.file_id, f.k, depth + 1 FROM walk w JOIN moves m ON m.earlier = w.here LEFT JOIN renamed r ON r.file_id = m.file_id AND r.old = w.name JOIN fields f ON f.file_id = m.file_id AND f.k = coalesce(r.new, w.name)),
    placed AS (SELECT file_id, k, arg_max(name, depth) AS column_name FROM walk GROUP BY ALL),
    named AS (SELECT f.*, p.column_name FROM filled f JOIN placed p USING (file_id, k) WHERE full_),
    types AS (SELECT type_name, column_name, CASE WHEN bool_and(kind = 'boolean') THEN 'boolean' WHEN bool_and(kind = 'integer') THEN 'bigint' WHEN bool_and(kind IN ('integer', 'number')) THEN 'double' WHEN bool_and(kind = 'list') THEN 'array<string>' ELSE 'string' END AS column_type FROM named GROUP BY ALL),
    raws AS (SELECT vault_id, type_name, file_id, name, fields, min(raw_id) AS raw_id FROM raw_records GROUP BY ALL),
    keys AS (SELECT *, unnest(json_keys(fields::JSON)) AS k FROM raws),
    vals AS (SELECT e.raw_id, e.vault_id, e.type_name, p.column_name, t.column_type, e.file_id, e.name, json_extract(e.fields::JSON, '$."' || k || '"') AS x FROM keys e JOIN placed p USING (file_id, k) JOIN types t ON t.type_name = e.type_name AND t.column_name = p.column_name)"""

P2_TYPED = PLACED + """
    SELECT raw_id, vault_id, type_name, column_name, column_type, CASE column_type WHEN 'double' THEN NULL WHEN 'array<string>' THEN array_to_string(CAST(x AS VARCHAR[]), '|') ELSE CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE x::VARCHAR END END AS value,
        CASE WHEN column_type = 'double' THEN CAST(x AS DOUBLE) END AS number FROM vals WHERE NOT (json_type(x) = 'NULL' OR x::VARCHAR IN ('""', '[]'))"""

P2_WHOLE = PLACED.replace("'boolean' WHEN bool_and(kind = 'integer') THEN 'bigint' WHEN bool_and(kind IN ('integer', 'number')) THEN 'double' WHEN bool_and(kind = 'list') THEN 'array<string>'", "'boolean' WHEN bool_and(kind = 'integer') THEN 'integer' WHEN bool_and(kind IN ('integer', 'number')) THEN 'number' WHEN bool_and(kind = 'list') THEN 'list' WHEN bool_and(kind = 'link') THEN 'link'").replace("WHERE full_),", "),").replace("bool_and(kind", "bool_and(CASE WHEN full_ THEN kind END") + """
    SELECT raw_id, vault_id, type_name, file_id, name, column_name, column_type, CASE WHEN json_type(x) = 'NULL' OR x::VARCHAR IN ('""', '[]') THEN NULL WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE x::VARCHAR END AS value,
        CASE WHEN column_type = 'integer' THEN TRY_CAST(x AS BIGINT) END AS whole, CASE WHEN column_type = 'number' AND json_type(x) <> 'NULL' AND x::VARCHAR NOT IN ('""', '[]') THEN CAST(x AS DOUBLE) END AS number FROM vals"""

P5_FOUND = f"WITH {COUNTING} SELECT record_id, field_name FROM judged WHERE NOT empty AND NOT valid"

ORPHANS = """
    WITH declared AS (SELECT type_name, field_name, max(link_target) AS link_target FROM schema_fields GROUP BY ALL),
    links AS (SELECT DISTINCT link_id, vault_id, type_name, field_name, linked_at, trim(target, ' ') AS t FROM record_links),
    paths AS (SELECT l.*, d.link_target, string_split(regexp_extract(t, '^\\[\\[([^\\]|]+)(\\|[^\\]|]*)?\\]\\]$', 1), '/') AS p FROM links l LEFT JOIN declared d USING (type_name, field_name)
        WHERE regexp_full_match(t, '\\[\\[([^\\]|]+)(\\|[^\\]|]*)?\\]\\]')),
    keyed AS (SELECT *, CASE WHEN len(p) > 1 THEN p[-2] ELSE link_target END AS type, p[-1] AS name FROM paths),
    found AS (SELECT k.link_id, k.type_name, k.linked_at, count(r.record_id) AS n, coalesce(bool_or(r.created_at <= k.linked_at AND (r.deleted_at IS NULL OR r.deleted_at > k.linked_at)), false) AS alive, coalesce(bool_or(r.created_at > k.linked_at), false) AS later
        FROM keyed k LEFT JOIN records r ON r.vault_id = k.vault_id AND r.type_name = k.type AND r.name = k.name GROUP BY ALL),
    orphans AS (SELECT link_id, type_name, linked_at, CASE WHEN n = 0 THEN 'missing' WHEN later THEN 'late' ELSE 'deleted' END AS reason FROM found WHERE NOT alive)"""


def _wide_sql(type_name: str, fields: str) -> str:
    kinds = {"i": "TRY_CAST(t AS BIGINT)", "n": "TRY_CAST(t AS DOUBLE)", "s": "v", "l": "t", "b": "lower(t) IN ('true', 'yes', 'on')", "d": "TRY_CAST(t AS DATE)", "t": "TRY_CAST(replace(t, 'T', ' ') AS TIMESTAMP)", "a": "CAST(j AS VARCHAR[])"}
    pairs = [f.rsplit(":", 1) for f in fields.split()]
    cols = ", ".join(f"max(CASE WHEN field_name = '{n}' AND valid THEN {kinds[k]} END) AS \"{n if n != 'Name' else 'Name_'}\"" for n, k in pairs)
    return f"""WITH {COUNTING}, named AS (SELECT record_id, arg_max(name, loaded_at) AS name FROM records WHERE type_name = '{type_name}' GROUP BY ALL)
        SELECT j.record_id, j.vault_id, n.name, {cols} FROM judged j LEFT JOIN named n USING (record_id) WHERE j.type_name = '{type_name}' GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p2_found": P2_FOUND,
        "p4_found": P4_FOUND,
        "p5_found": P5_FOUND,
        "p6_found": ORPHANS + " SELECT link_id, reason FROM orphans",
        "p6_report": ORPHANS + " SELECT type_name, strftime(linked_at, '%Y-%m') AS month, reason, count(*) AS links FROM orphans GROUP BY ALL",
        "p4_profile": P4_PROFILE,
        "p4_profile_all": P4_PROFILE_ALL,
        "p4_shifts": P4_SHIFTS,
        "p4_ranges": P4_RANGES,
        "p2_rows": P2_UNIFIED,
        "p2_typed": P2_TYPED,
        "p2_unified": P2_WHOLE,
        "p5_wide_projekte": _wide_sql("Projekte", "Titel:s Beginn:d Abgeschlossen:b Budget:i Traeger:a Staedte:a Erstellt:t Status:s Foerderquote:n"),
        "p5_wide_veranstaltungen": _wide_sql("Veranstaltungen", "Titel:s Datum:d Teilnehmer:a Ort:l Plaetze:i Oeffentlich:b Format:s Beginnt:t"),
        "p5_wide_orte": _wide_sql("Orte", "Name:s Land:s Einwohner:i Flaeche:n Tags:a Geprueft:b Ansprechpartner:l"),
        "p5_wide_foerderprogramme": _wide_sql("Foerderprogramme", "Titel:s Geber:l Volumen:i Beteiligte:a"),
        "p5_wide_personen": _wide_sql("Personen", "Name:s Partei:l Aktiv:b Geburtstag:d Rolle:s Kontakt:l Stunden:n Mitglied_seit:i"),
        "p5_wide_organisationen": _wide_sql("Organisationen", "Name:s Leitung:l Gegruendet:i Umsatz:n Branche:s Sitz:l Aktiv:b Angelegt:t"),
    }
