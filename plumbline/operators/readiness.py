"""Can the data carry the audit? Issues with code, severity and field."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.operators.prepare import Policy, Roles

ISSUE = "code string, severity string, field string"


def policy_issues(policies: DataFrame) -> DataFrame:
    """Order checks over a table of policies, one row per scope (scope, nominal, lower_limit,
    minimum_shift, maximum_shift, min_groups_exploratory, min_groups_action)."""
    issue = lambda bad, code, where: F.when(bad, F.struct(F.lit(code).alias("code"), F.lit("blocking").alias("severity"), F.lit(where).alias("field")))
    found = F.array(
        issue(F.col("lower_limit") > F.col("nominal"), "CONTRACT_POLICY_ORDER_INVALID", "policy.lower_limit"),
        issue(F.col("maximum_shift") < F.col("minimum_shift"), "CONTRACT_SHIFT_RANGE_INVALID", "policy.maximum_screening_shift"),
        issue(F.col("min_groups_action") < F.col("min_groups_exploratory"), "CONTRACT_EVIDENCE_PROFILE_INVALID", "evidence_profile.min_groups_action"),
    )
    return policies.select("scope", F.explode(F.array_compact(found)).alias("i")).select("scope", "i.*")


def support_issues(df: DataFrame, roles: Roles, policy: Policy, scope_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Row and group support per scope; composite groups are counted as they are. There is no upper limit of
    groups, here as in the audit."""
    from plumbline.operators.prepare import scope_of, text_of

    groups = [text_of(c) for c in roles.group]
    base = df.select(scope_of(scope_cols).alias("scope"), F.array(*groups).alias("g"), F.exists(F.array(*groups), lambda x: x.isNull() | (F.length(x) == 0)).alias("blank"))
    s = base.groupBy("scope").agg(F.count("*").alias("n_rows"), F.count_distinct("g").alias("n_groups"), F.count_if("blank").alias("blanks"))
    issue = lambda bad, code, severity, where: F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(where).alias("field")))
    n, g = F.col("n_rows"), F.col("n_groups")
    where = "grouping.deployment_group_columns"
    found = F.array(
        issue(F.col("blanks") > 0, "CONTRACT_GROUP_MISSING_VALUES", "blocking", where),
        issue(g <= 1, "CONTRACT_GROUP_CONSTANT", "blocking", where),
        issue(g < policy.min_groups_exploratory, "CONTRACT_INSUFFICIENT_GROUPS", "blocking", where),
        issue((g >= policy.min_groups_exploratory) & (g < policy.min_groups_action), "CONTRACT_INSUFFICIENT_GROUPS", "warning", where),
        issue(n < policy.min_rows, "CONTRACT_EVIDENCE_PROFILE_INVALID", "blocking", "evidence_profile.min_rows"),
        issue(n * F.lit(policy.alpha) < policy.min_tail_count, "CONTRACT_EVIDENCE_PROFILE_INVALID", "warning", "evidence_profile.min_expected_tail_count"),
    )
    return s.select("scope", F.explode(F.array_compact(found)).alias("i")).select("scope", "i.*")


def column_issues(profiled: DataFrame, roles: Roles, semantics: str = "volume", unit: str = "mL") -> DataFrame:
    """Mapped columns exist and have the types that their roles need; unit and conversion fit."""
    spark = profiled.sparkSession
    mapped = [(f.name, getattr(roles, f.name)) for f in fields(Roles) if f.name in ("quantity", "product", "stream", "shift", "time", "weight", "density", "tare") and getattr(roles, f.name)]
    mapped += [(f"group[{i}]", c) for i, c in enumerate(roles.group)] + [(f"tie_breaks[{i}]", c) for i, c in enumerate(roles.tie_breaks)]
    numeric = {"quantity"} | ({"weight", "tare"} if roles.conversion == "gross_minus_tare" else set()) | ({"density"} if roles.conversion == "row_density" else set())
    rules = [(role, name, role in numeric, role == "time") for role, name in mapped]
    table = spark.createDataFrame(rules, "field string, name string, numeric boolean, moment boolean")
    joined = F.broadcast(table).join(profiled.select("name", "dtype"), "name", "left")
    is_number = F.col("dtype").isin("integer", "number")
    code = (
        F.when(F.col("dtype").isNull(), "CONTRACT_COLUMN_NOT_FOUND")
        .when((F.col("field") == "quantity") & ~is_number, "CONTRACT_QUANTITY_NOT_NUMERIC")
        .when(F.col("numeric") & ~is_number, "CONTRACT_CONVERSION_INVALID")
        .when(F.col("moment") & (F.col("dtype") != "datetime"), "CONTRACT_ORDERING_INCONSISTENT")
    )
    found = joined.select(code.alias("code"), F.lit("blocking").alias("severity"), "field").filter(F.col("code").isNotNull())
    extra = []
    known = {name.lower(): u for u, names in V.UNITS.items() for name in names}.get(unit.strip().lower())
    if known is None:
        extra.append(("CONTRACT_UNIT_UNKNOWN", "blocking", "measurement.unit"))
    bad_conversion = (
        (roles.conversion == "fixed_density" and roles.fixed_density is None)
        or (roles.conversion != "fixed_density" and roles.conversion == "none" and roles.fixed_density is not None)
        or (roles.conversion == "row_density" and roles.density is None)
        or (roles.conversion == "gross_minus_tare" and (roles.weight is None or roles.tare is None))
    )
    if bad_conversion:
        extra.append(("CONTRACT_CONVERSION_INVALID", "blocking", "measurement.conversion"))
    fits = known in V.VOLUME_UNITS if semantics == "volume" else known in V.MASS_UNITS if semantics in ("gross_weight", "net_weight", "mass") else known is not None
    if known is not None and not fits and roles.conversion not in ("fixed_density", "row_density"):
        extra.append(("CONTRACT_UNIT_SEMANTICS_MISMATCH", "blocking", "measurement"))
    return found.unionByName(spark.createDataFrame(extra, ISSUE))


def readiness(df: DataFrame, profiled: DataFrame, roles: Roles, policy: Policy, scope_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """All issues; those of columns and policy hold for every scope ('*')."""
    spark = df.sparkSession
    one = spark.createDataFrame(
        [("*", policy.nominal, policy.lower_limit, policy.minimum_shift, policy.maximum_shift, policy.min_groups_exploratory, policy.min_groups_action)],
        "scope string, nominal double, lower_limit double, minimum_shift double, maximum_shift double, min_groups_exploratory int, min_groups_action int",
    )
    columns = column_issues(profiled, roles, unit=policy.unit).withColumn("scope", F.lit("*"))
    return support_issues(df, roles, policy, scope_cols).unionByName(policy_issues(one)).unionByName(columns.select("scope", "code", "severity", "field"))
