"""Profiling with redaction: types, missing values, summaries, role suggestions, identifiers.

The table is unpivoted to (column, value) and counted per distinct value: one shuffle of distinct
values, on which every predicate is evaluated once per value instead of once per row. All counts are
sums of these weights, medians are found in them by counted brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.session import written

MOST_LEVELS, LARGEST_SHARE, LONGEST = 20, 0.20, 80


def whole(column: Column, pattern: str, any_case: bool = False) -> Column:
    """Does the pattern match the whole cell?"""
    return column.rlike(rf"\A(?:{'(?i)' if any_case else ''}{pattern})\z")


def normalized_name(column: Column) -> Column:
    """Lower case; runs of other characters than letters and digits are one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")


def is_datetime(v: Column) -> Column:
    text = F.regexp_replace(v, "Z$", "+00:00")
    return whole(v, V.DATETIME) & F.coalesce(F.try_to_timestamp(text).isNotNull(), F.lit(False))


def is_finite_number(v: Column) -> Column:
    """The shape comes first: casts accept more than numbers."""
    return whole(v, V.INTEGER) | (whole(v, V.NUMBER) & (F.abs(F.expr("try_cast(value as double)")) < float("inf")))


def is_email(v: Column) -> Column:
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    last = F.substring_index(domain, ".", -1)
    sized = F.length(v).between(6, 254) & F.length(local).between(1, 64) & F.length(domain).between(1, 253)
    return sized & (F.length(last) >= 2) & last.rlike("[A-Za-z]") & whole(v, V.EMAIL, any_case=True)


def is_phone(v: Column) -> Column:
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    shaped = whole(v, V.PHONE_GROUPED) | whole(v, V.PHONE_PARENTHESES) | whole(v, V.PHONE_PLUS)
    return F.length(v).between(7, 40) & digits.between(7, 15) & whole(v, V.PHONE_ALLOWED) & shaped & ~is_datetime(v) & ~whole(v, V.YEAR_FIRST_DATE)


def is_identifier_name(name: Column) -> Column:
    return name.rlike("|".join(V.IDENTIFIER_TERMS))


def distinct_values(df: DataFrame) -> DataFrame:
    """(position, name, value, n): each column's distinct trimmed values with their counts; null is blank."""
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("value")) for i, c in enumerate(df.columns)]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("position", "name", "value").agg(F.count("*").alias("n"))


MEDIAN_ROWS = 50_000  # so many values of a column are sorted together
MEDIAN_BINS = 256


def weighted_medians(numbers: DataFrame, most: int = MEDIAN_ROWS) -> DataFrame:
    """(position, median): of each position's values ``x`` that count ``n`` times; between two middle values
    their mean. Exact, for all positions at once.

    Each round deals what is left of a position's values to bins between approximate quantiles, counts the
    bins, and keeps the one or two that hold the middle ranks: under a hundredth of the values. Only
    when ``most`` are left are they sorted.
    """
    left = written(numbers.select("position", "x", "n"), "numbers")
    total = left.groupBy("position").agg(F.sum("n").alias("total"))
    ranks = total.select("position", F.floor((F.col("total") - 1) / 2).alias("low"), F.floor(F.col("total") / 2).alias("high"))
    sizes = written(ranks.join(left.groupBy("position").agg(F.count("*").alias("size")), "position").withColumn("below", F.lit(0).cast("long")), "ranks")
    points = [(k + 1) / MEDIAN_BINS for k in range(MEDIAN_BINS - 1)]
    steps = F.array(*[F.lit(1 << k) for k in range(7, -1, -1)])
    bin_ = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get("cuts", i + s - 1) < F.col("x"), i + s).otherwise(i))
    while not (wide := sizes.filter(F.col("size") > most)).isEmpty():
        cuts = left.join(wide, "position", "left_semi").groupBy("position").agg(F.percentile_approx("x", points, 10_000).alias("cuts"))
        binned = written(left.join(written(cuts, "cuts"), "position", "left").withColumn("bin", F.when(F.col("cuts").isNull(), 0).otherwise(bin_)).select("position", "x", "n", "bin"), "binned")
        tally = binned.groupBy("position", "bin").agg(F.sum("n").alias("n"), F.count("*").alias("size"))
        upto = F.sum("n").over(Window.partitionBy("position").orderBy("bin"))  # a row per bin
        met = tally.withColumn("upto", upto).join(sizes.select("position", "low", "high", "below"), "position").withColumn("start", F.col("below") + F.col("upto") - F.col("n"))
        met = written(met.filter((F.col("start") <= F.col("high")) & (F.col("start") + F.col("n") > F.col("low"))), "middle")
        shrunk = written(met.groupBy("position", "low", "high").agg(F.sum("size").alias("size"), F.min("start").alias("below")), "ranks")
        left = written(binned.join(met.select("position", "bin"), ["position", "bin"], "left_semi").drop("bin"), "numbers")
        stuck = shrunk.select("position", F.col("size").alias("now")).join(sizes, "position").filter((F.col("size") > most) & (F.col("now") >= F.col("size")))
        sizes = shrunk
        if not stuck.isEmpty():  # one value, written in many ways
            left = written(left.groupBy("position", "x").agg(F.sum("n").alias("n")), "numbers")
            sizes = written(sizes.drop("size").join(left.groupBy("position").agg(F.count("*").alias("size")), "position"), "ranks")
    upto = F.sum("n").over(Window.partitionBy("position").orderBy("x"))
    ends = left.withColumn("upto", upto).join(sizes.select("position", "low", "high", "below"), "position").withColumn("upto", F.col("upto") + F.col("below"))
    at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("x")))
    return ends.groupBy("position").agg(((at("low") + at("high")) / 2).alias("x_median"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: dtype, missing fraction, distinct count, summary, blockers, redacted examples."""
    v = F.col("value")
    seen = distinct_values(df).select(
        "*",
        (F.length(v) > 0).alias("present"),
        F.lower(v).isin("true", "false").alias("truth"),
        whole(v, V.INTEGER).alias("whole_number"),
        is_finite_number(v).alias("number"),
        (whole(v, V.NONFINITE, any_case=True) | (whole(v, V.NUMBER) & ~is_finite_number(v))).alias("nonfinite"),
        is_datetime(v).alias("moment"),
        (is_email(v) | is_phone(v)).alias("personal"),
    )
    seen = written(seen.withColumn("x", F.when(F.col("number"), F.expr("try_cast(value as double)"))), "values")
    medians = weighted_medians(seen.filter(F.col("x").isNotNull()))
    there = F.col("present")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = seen.groupBy("position", "name").agg(
        F.sum("n").cast("long").alias("n_rows"),
        count(there).alias("n_present"),
        F.count_if(there).cast("long").alias("unique_count"),
        count(there & F.col("truth")).alias("n_truth"),
        count(there & F.col("whole_number")).alias("n_integer"),
        count(there & F.col("number")).alias("n_number"),
        count(there & F.col("nonfinite")).alias("n_nonfinite"),
        count(there & F.col("moment")).alias("n_datetime"),
        count(there & F.col("personal")).alias("n_personal"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.max(F.when(there, F.length(v))).alias("longest"),
    ).join(medians, "position", "left")
    name = normalized_name(F.col("name"))
    every = lambda c: F.col(c) == F.col("n_present")
    dtype = (
        F.when(F.col("n_present") == 0, "unknown")
        .when(every("n_truth"), "boolean")
        .when(every("n_integer"), "integer")
        .when(every("n_number"), "number")
        .when(name.isin(V.DATETIME_NAMES) & every("n_datetime"), "datetime")
        .otherwise("string")
    )
    out = out.withColumns({"normalized_name": name, "dtype": dtype})
    numeric = F.col("dtype").isin("integer", "number")
    identifier = is_identifier_name(F.col("normalized_name")) | (F.col("n_personal") > 0)
    out = out.withColumn("is_identifier", identifier)
    shown = lambda c: F.when(numeric & ~F.col("is_identifier"), F.col(c))
    failure = (
        F.when(F.col("n_nonfinite") > 0, "PROFILE_NONFINITE_VALUE")
        .when(F.col("normalized_name").isin(V.ROLE_NAMES["quantity"]) & (F.col("n_number") < F.col("n_present")), "PROFILE_MALFORMED_NUMERIC")
        .when(F.col("normalized_name").isin(V.ROW_ID_NAMES) & (F.col("unique_count") < F.col("n_present")), "PROFILE_DUPLICATE_ROW_ID")
    )
    return out.select(
        "position", "name", "normalized_name", "dtype", "n_rows",
        ((F.col("n_rows") - F.col("n_present")) / F.col("n_rows")).alias("missing_fraction"),
        "unique_count", "n_present", "is_identifier", "longest",
        shown("x_min").alias("minimum"), shown("x_median").alias("median"), shown("x_max").alias("maximum"),
        failure.alias("failure_code"),
    )


def safe_examples(df: DataFrame, profiled: DataFrame) -> DataFrame:
    """(name, examples): up to three levels of strings and booleans that are few, short and no identifiers.

    A second look at the few columns that qualify, kept to three values by rank.
    """
    few = (F.col("unique_count") <= MOST_LEVELS) & (F.col("unique_count") <= LARGEST_SHARE * F.col("n_present")) & (F.col("longest") <= LONGEST)
    fit = profiled.filter(~F.col("is_identifier") & ((F.col("dtype") == "boolean") | ((F.col("dtype") == "string") & few))).select("name", "dtype")
    shown = F.when(F.col("dtype") == "boolean", F.lower("value")).otherwise(F.col("value"))
    levels = distinct_values(df).filter(F.length("value") > 0).join(F.broadcast(fit), "name").select("name", shown.alias("value")).distinct()
    ranked = levels.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("value"))).filter(F.col("r") <= 3)
    return ranked.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("examples"))


def safe_profile(profiled: DataFrame) -> DataFrame:
    """What may leave the house: no summaries and no examples."""
    return profiled.select("position", "name", "dtype", "missing_fraction", "unique_count")


def suggest_roles(profiled: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    """(role, column, confidence, reason), best first; ``hints`` maps a role to a column."""
    spark = profiled.sparkSession
    rows = [(i, role, name, 0.95 if role == "quantity" else 0.85, "name") for i, (role, names) in enumerate(V.ROLE_NAMES.items()) for name in names]
    table = spark.createDataFrame(rows, "role_order int, role string, normalized_name string, confidence double, reason string")
    by_name = profiled.join(F.broadcast(table), "normalized_name")
    given = [(list(V.ROLE_NAMES).index(role), role, column.strip().lower(), 0.99, "hint") for role, column in (hints or {}).items()]
    by_hint = profiled.withColumn("folded", F.lower("name")).join(
        F.broadcast(spark.createDataFrame(given, "role_order int, role string, folded string, confidence double, reason string")), "folded"
    )
    columns = ["role_order", "role", "name", "position", "normalized_name", "dtype", "confidence", "reason"]
    both = by_name.select(columns).unionByName(by_hint.select(columns))
    numeric = F.col("dtype").isin("integer", "number")
    timely = (F.col("dtype") == "datetime") | (F.col("normalized_name").isin(V.SEQUENCE_NAMES) & numeric)
    fits = F.when(F.col("role").isin(V.NUMERIC_ROLES), numeric).when((F.col("role") == "time") & (F.col("reason") == "name"), timely).otherwise(True)
    fits = fits & ((F.col("reason") == "hint") | (F.col("dtype") != "unknown"))
    best = both.filter(fits).groupBy("role_order", "role", "name", "position").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reason"))
    return best.orderBy("role_order", F.desc("confidence"), "position")


def profile_status(profiled: DataFrame) -> DataFrame:
    """One row: the first failure by column, or PROFILE_QUANTITY_MISSING if no column could be the quantity."""
    roles = suggest_roles(profiled).filter(F.col("role") == "quantity").agg(F.count("*").alias("n_quantity"))
    first = profiled.agg(F.min_by("failure_code", F.when(F.col("failure_code").isNotNull(), F.col("position"))).alias("failure_code"))
    return first.crossJoin(roles).select(F.coalesce("failure_code", F.when(F.col("n_quantity") == 0, "PROFILE_QUANTITY_MISSING")).alias("failure_code"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def normalize_units(df: DataFrame, column: str) -> DataFrame:
    """Adds ``unit``, the canonical unit of a name, null if unknown."""
    names = {name.lower(): unit for unit, names in V.UNITS.items() for name in names} | {"㎖": "mL", "㎏": "kg", "㎎": "mg", "ℓ": "L", "㎕": "uL"}
    table = df.sparkSession.createDataFrame(sorted(names.items()), "__name string, unit string")
    return df.withColumn("__name", F.lower(F.trim(column))).join(F.broadcast(table), "__name", "left").drop("__name")
