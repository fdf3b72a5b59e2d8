"""Column profiles of each load and the findings against the load before.

Everything is a mergeable sum: values are counted once for each distinct value, numbers by exact power sums of integers, so
that hot groups are reduced before they are shuffled. Mean and deviation follow from the sums, and with the range they
bracket the median, which is never further from the mean than one deviation: two loads whose brackets are far enough apart, or
near enough, need no median. Where it is needed, it is found exactly among the values inside the bracket.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.typed import blank, fits
from ..session import ship, written
from .pivot import Slots, latest_cells

GROUP = ["vault_id", "load_no", "type_name", "field_name"]
IDS = ["vault_id", "load_no", "field_id"]

#: Distinct numbers of a group that one task sorts at most; more are split by quantiles first, as often as it takes.
PER_TASK = 100_000

#: Parts that a larger group is split into.
PARTS = 64

#: Limits of the findings.
NULLS, SHARES, INVALID, FEW, LEVEL = 0.201, 0.351, 0.101, 12, 4.0


def medians(numbers: DataFrame, keys: list[str], bounds: DataFrame | None = None, per_task: int = PER_TASK) -> DataFrame:
    """keys and the exact median of x (mean of the two in the middle). numbers: keys, x, n (how often); x isn't null.

    bounds: keys, low and high, between which the median is known to lie; without them all numbers are looked at. Only groups
    that bounds names come out. No task sorts more than per_task distinct numbers of a group: larger groups are split by the quantiles
    of their distinct numbers, and only the part that holds the middle goes on.
    """
    if bounds is None:
        bounds = numbers.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    near = numbers.join(bounds.select(*keys, "low", "high"), keys)
    outside = near.groupBy(*keys).agg(F.sum("n").alias("of"), F.sum(F.when(F.col("x") < F.col("low"), F.col("n")).otherwise(0)).alias("below"))
    held = written(near.where("x >= low AND x <= high").groupBy(*keys, "x").agg(F.sum("n").alias("n")).join(outside, keys), "inside")
    per_task, done = max(per_task, 4), []
    while True:
        large = held.groupBy(*keys).count().where(F.col("count") > per_task).select(*keys)
        if large.isEmpty():
            break
        done.append(held.join(large, keys, "left_anti"))
        cuts = held.join(large, keys).groupBy(*keys).agg(F.percentile_approx("x", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), 10 * PARTS).alias("cuts"))
        dealt = held.join(cuts, keys).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("x")))).drop("cuts")
        upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # PARTS rows
        parts = dealt.groupBy(*keys, "part", "of", "below").agg(F.sum("n").alias("n")).withColumn("hi", F.sum("n").over(upto) + F.col("below")).withColumn("lo", F.col("hi") - F.col("n"))
        middle = parts.where("lo <= floor(of / 2) AND hi > floor((of - 1) / 2)").groupBy(*keys).agg(F.min("part").alias("first"), F.max("part").alias("last"), F.min("lo").alias("lo"))
        held = written(dealt.join(middle, keys).where("part BETWEEN first AND last").select(*keys, "x", "n", "of", F.col("lo").alias("below")), "inside")
    for part in done:
        held = held.unionByName(part.select(*held.columns))
    upto = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("hi", F.sum("n").over(upto) + F.col("below")).withColumn("lo", F.col("hi") - F.col("n"))
    hit = lambda r: F.max(F.when((F.col("lo") <= r) & (r < F.col("hi")), F.col("x")))
    return ranked.groupBy(*keys).agg(((hit(F.floor((F.col("of") - 1) / 2)) + hit(F.floor(F.col("of") / 2))) / 2).alias("median"))


def counted(cells: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """The counting cells, once for each distinct value of a group: IDS, field_type, value, n, empty, valid."""
    slots = Slots(schema_fields)
    own = latest_cells(cells, slots)
    each = own.groupBy(*IDS, F.col("cell_value").alias("value")).agg(F.count("*").alias("n"))
    each = each.join(F.broadcast(slots.table(cells.sparkSession).select("field_id", "field_type")), "field_id")
    return each.withColumn("empty", blank(F.col("value"))).withColumn("valid", ~F.col("empty") & fits(F.col("value"), F.col("field_type")))


def others(cells: DataFrame, schema_fields: DataFrame, violations: DataFrame) -> DataFrame:
    """What counted() leaves out, in the same way: table_name, GROUP, field_type, value, n, empty, valid; all of it is string.

    Fields of cells that their type doesn't declare, named without case and outer spaces (a null name is a field too), of
    which again the latest cell counts; and the field_name of violations, all types together as type_name *, repeated rows once.
    """
    known = Slots(schema_fields).table(cells.sparkSession).select("type_name", F.col("key").alias("field_name"))
    loose = cells.withColumn("field_name", F.lower(F.trim("field_name"))).join(F.broadcast(known), ["type_name", "field_name"], "left_anti")
    version = F.struct("loaded_at", "cell_id", "load_no", F.col("cell_value").alias("value"))
    own = loose.groupBy("vault_id", "record_id", "type_name", "field_name").agg(F.max(version).alias("c")).select(F.lit("cells").alias("table_name"), "vault_id", "c.load_no", "type_name", "field_name", "c.value")
    said = violations.select("violation_id", "vault_id", "load_no", F.col("field_name").alias("value")).distinct()
    said = said.select(F.lit("lint_violations").alias("table_name"), "vault_id", "load_no", F.lit("*").alias("type_name"), F.lit("field_name").alias("field_name"), "value")
    each = own.unionByName(said).groupBy("table_name", *GROUP, F.lit("string").alias("field_type"), "value").agg(F.count("*").alias("n"))
    return each.withColumn("empty", blank(F.col("value"))).withColumn("valid", ~F.col("empty"))


def named(rows: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """rows with type_name and field_name for their field_id."""
    return rows.join(F.broadcast(Slots(schema_fields).table(rows.sparkSession).select("field_id", "type_name", "field_name")), "field_id").drop("field_id")


def ranges() -> list[Column]:
    """Aggregates: the least and most valid value of a group, compared as what its type says."""
    v, kind = F.trim("value"), F.col("field_type")
    as_typed = {
        "integer": F.when(kind == "integer", v.try_cast("bigint")),
        "number": F.when(kind == "number", v.try_cast("double")),
        "time": F.when(kind == "date", v.try_cast("date").cast("timestamp_ntz")).when(kind == "datetime", F.replace(v, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")),
        "text": F.when(~kind.isin("integer", "number", "date", "datetime"), F.col("value")),
    }
    return [f(F.when(F.col("valid"), x)).alias(f"{side}_{k}") for k, x in as_typed.items() for side, f in (("least", F.min), ("most", F.max))]


RANGES = [f"{side}_{k}" for k in ("integer", "number", "time", "text") for side in ("least", "most")]


#: The sums of n times: whole part, rest in units of 1e-8, and the three products of these.
SUMS = "whole", "rest", "whole_whole", "whole_rest", "rest_rest"


def _sums(values: DataFrame, ids: list[str]) -> DataFrame:
    """What merges: counts, ranges and power sums of each group."""
    number = F.col("valid") & F.col("field_type").isin("integer", "number")
    x = F.when(number, F.trim("value").try_cast("decimal(30,8)"))
    n = F.col("n")
    times = n.cast("decimal(19,0)")
    whole, rest = F.floor("x").try_cast("decimal(19,0)"), ((F.col("x") - F.floor("x")) * 100_000_000).try_cast("decimal(8,0)")
    product = lambda *of: F.try_multiply(times, of[0] if len(of) == 1 else F.try_multiply(*of))
    terms = product(whole), product(rest), product(whole, whole), product(whole, rest), product(rest, rest)
    all_of = lambda term: F.when(~F.bool_or(number & term.isNull()), F.try_sum(term))  # noqa: E731  # a sum skips nulls
    return values.withColumn("x", x).groupBy(*ids, "field_type").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("empty"), n).otherwise(0)).alias("blanks"),
        F.count(F.when(~F.col("empty"), F.lit(1))).alias("distinct"),
        F.sum(F.when(~F.col("empty") & ~F.col("valid"), n).otherwise(0)).alias("invalid"),
        *ranges(),
        F.sum(F.when(number, n)).alias("s0"),
        *[all_of(term).alias(name) for name, term in zip(SUMS, terms, strict=True)],
    )


MOMENTS = "struct<s1:double,s2:double,mean:double,deviation:double>"


def _moments(s0: pd.Series, whole: pd.Series, rest: pd.Series, whole_whole: pd.Series, whole_rest: pd.Series, rest_rest: pd.Series) -> pd.DataFrame:
    """The sums and what follows from them, in whole numbers to the end and rounded once; a row for each group."""
    unit, out = 10**8, []
    for n, *sums in zip(s0, whole, rest, whole_whole, whole_rest, rest_rest):
        if pd.isna(n) or any(pd.isna(x) for x in sums):
            out.append((None, None, None, None))
            continue
        n, (w, r, ww, wr, rr) = int(n), map(int, sums)
        one, two = w * unit + r, ww * unit * unit + 2 * wr * unit + rr
        out.append((one / unit, two / unit**2, one / (n * unit), math.sqrt((n * two - one * one) / (n * unit) ** 2)))
    return pd.DataFrame(out, columns=["s1", "s2", "mean", "deviation"], dtype=float)


def measured(values: DataFrame, ids: list[str] = IDS) -> DataFrame:
    """A row for each group of counted(), without medians: counts, ranges, power sums, mean, deviation and bounds of the median (low, high)."""
    ship(values.sparkSession)
    stats = _sums(values, ids).withColumn("m", F.pandas_udf(_moments, MOMENTS)("s0", *SUMS))
    stats = stats.select(*[c for c in stats.columns if c not in (*SUMS, "m")], *[F.nanvl(f"m.{c}", F.lit(None).cast("double")).alias(c) for c in ("s1", "s2", "mean", "deviation")])
    least, most = F.coalesce("least_number", F.col("least_integer").cast("double")), F.coalesce("most_number", F.col("most_integer").cast("double"))
    slack = 1e-8 + 1e-9 * (F.abs("mean") + F.col("deviation"))
    return stats.withColumns({"low": F.greatest(least, F.col("mean") - F.col("deviation") - slack), "high": F.least(most, F.col("mean") + F.col("deviation") + slack)})  # both skip nulls


def _numbers(values: DataFrame) -> DataFrame:
    return values.where(F.col("valid") & F.col("field_type").isin("integer", "number")).select(*IDS, F.trim("value").try_cast("double").alias("x"), "n")


def profile(values: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """A row for each group of counted(): rows, blanks, distinct, invalid, ranges, power sums, mean, deviation, median and shift.

    The ranges are over the valid values and null for other types: least_integer and most_integer, least_number and most_number,
    least_time and most_time (date and datetime), least_text and most_text (all the rest). s0 counts the valid numbers, s1 is their exact sum and s2 that of their
    squares; both, mean and deviation are rounded to double once, at the end. Numbers count to 8 decimals. A group with a number of
    1e19 or more, or with sums beyond 38 digits, has no sums, and its median is bracketed by its range alone.
    shift is the difference of means to the load before over the pooled deviation. Text columns have neither.
    """
    stats = written(measured(values), "measured")
    both = stats.join(medians(_numbers(values), IDS, stats.where("low is not null"), per_task), IDS, "left")
    before = Window.partitionBy("vault_id", "field_id").orderBy("load_no").rangeBetween(-1, -1)
    m, d = F.first("mean").over(before), F.first("deviation").over(before)
    pooled = F.sqrt((F.col("deviation") * F.col("deviation") + d * d) / 2)
    return both.withColumn("shift", F.when(pooled > 0, (F.col("mean") - m) / pooled)).drop("low", "high")


def whole_profile(cells: DataFrame, schema_fields: DataFrame, violations: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """profile() of every field: table_name, GROUP, field_type and the measures, for declared and other fields of cells and the field_name of violations."""
    values = written(counted(cells, schema_fields), "values")
    declared = named(profile(values, per_task), schema_fields).withColumn("table_name", F.lit("cells"))
    return declared.unionByName(_sums(others(cells, schema_fields, violations), ["table_name", *GROUP]).drop(*SUMS), allowMissingColumns=True)


def _pairs(p: DataFrame, keys: list[str]) -> DataFrame:
    """Each group beside the same of the load before, as structs c and b."""
    now = p.select(*keys, "load_no", F.struct("*").alias("c"))
    before = p.select(*keys, (F.col("load_no") + 1).alias("load_no"), F.struct("*").alias("b"))
    return now.join(before, [*keys, "load_no"])


def _ratio_bounds() -> tuple[Column, Column]:
    """Least and most that the median of c can be over that of b, by their bounds; null where that of b may be 0."""
    sides = [F.col(f"c.{i}") / F.nullif(F.col(f"b.{j}"), F.lit(0.0)) for i in ("low", "high") for j in ("low", "high")]
    apart = (F.col("b.low") > 0) | (F.col("b.high") < 0)
    return F.when(apart, F.least(*sides)), F.when(apart, F.greatest(*sides))


def levels(values: DataFrame, both: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """IDS of the numeric groups whose median is at least LEVEL times that of the load before, or at most that part of it.

    The brackets of the power sums decide where they can; only the others' medians are looked for. A median of 0 before
    counts as changed if it isn't 0 now.
    """
    least, most = _ratio_bounds()
    numeric = both.where(F.col("c.field_type").isin("integer", "number") & F.col("c.low").isNotNull() & F.col("b.low").isNotNull())
    judged = numeric.withColumn("said", F.when((least >= LEVEL) | (most <= 1 / LEVEL), True).when((least > 1 / LEVEL) & (most < LEVEL), False))
    open_ = judged.where("said is null")
    sides = [open_.select("vault_id", "field_id", f"{k}.load_no", f"{k}.low", f"{k}.high") for k in ("c", "b")]
    found = written(medians(_numbers(values), IDS, sides[0].unionByName(sides[1]).distinct(), per_task), "medians")
    now, then = found.withColumnRenamed("median", "m"), found.select("vault_id", "field_id", (F.col("load_no") + 1).alias("load_no"), F.col("median").alias("m0"))
    m, m0 = F.col("m"), F.col("m0")
    moved = open_.select(*IDS).join(now, IDS).join(then, IDS).where(F.when(m0 == 0, m != 0).otherwise((m / m0 >= LEVEL) | (m / m0 <= 1 / LEVEL)))
    return judged.where("said").select(*IDS).unionByName(moved.select(*IDS))


def findings(cells: DataFrame, schema_fields: DataFrame, violations: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(table_name, vault_id, load_no, type_name, field_name, finding) against load_no one lower, where both exist.

    Repeated rows count once. A median of 0 before counts as changed if it isn't 0 now.
    """
    values = written(counted(cells, schema_fields), "values")
    stats = written(measured(values), "profile")
    keys = ["vault_id", "field_id"]
    both = _pairs(stats, keys)
    filled = lambda k: F.col(f"{k}.rows") - F.col(f"{k}.blanks")
    text = F.col("c.field_type") == "string"
    said = F.array_compact(
        F.array(
            F.when(F.abs(F.col("c.blanks") / F.col("c.rows") - F.col("b.blanks") / F.col("b.rows")) > NULLS, "nulls"),
            F.when(text & (F.col("c.distinct") > 0) & (F.col("b.distinct") > 0) & ((F.col("c.distinct") * 2 <= F.col("b.distinct")) | (F.col("c.distinct") >= F.col("b.distinct") * 2)), "distinct"),
            F.when(~text & (filled("c") > 0) & (filled("b") > 0) & (F.try_divide("c.invalid", filled("c")) - F.try_divide("b.invalid", filled("b")) > INVALID), "invalid"),
        )
    )
    plain = both.select(*IDS, F.explode(said).alias("finding")).unionByName(levels(values, both, per_task).withColumn("finding", F.lit("level")))
    # Few distinct values: half the sum of absolute differences of shares is 1 less the sum of the lesser shares.
    fits_few = lambda k: F.col(f"{k}.distinct").between(1, FEW)
    few = both.where(text & fits_few("c") & fits_few("b")).select(*IDS, filled("c").alias("of_c"), filled("b").alias("of_b"))
    shown = values.where(~F.col("empty") & (F.col("field_type") == "string")).select(*IDS, "value", "n")
    now = few.join(shown, IDS)
    then = shown.select(*keys, (F.col("load_no") + 1).alias("load_no"), "value", F.col("n").alias("n_b"))
    overlap = now.join(then, [*IDS, "value"], "left").groupBy(*IDS).agg(F.sum(F.least(F.col("n") / F.col("of_c"), F.coalesce(F.col("n_b") / F.col("of_b"), F.lit(0.0)))).alias("common"))
    shares = overlap.where(1 - F.col("common") > SHARES).select(*IDS, F.lit("shares").alias("finding"))
    own = named(plain.unionByName(shares), schema_fields).select(F.lit("cells").alias("table_name"), *GROUP, "finding")
    return own.unionByName(violation_findings(violations))


def violation_findings(violations: DataFrame) -> DataFrame:
    once = violations.dropDuplicates(["violation_id"])
    loads = once.groupBy("vault_id", "load_no").agg((F.avg(blank(F.col("field_name")).cast("double"))).alias("share"))
    out = _pairs(loads, ["vault_id"]).where(F.abs(F.col("c.share") - F.col("b.share")) > NULLS)
    return out.select(F.lit("lint_violations").alias("table_name"), "vault_id", "load_no", F.lit("*").alias("type_name"), F.lit("field_name").alias("field_name"), F.lit("nulls").alias("finding"))
