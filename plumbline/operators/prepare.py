"""Roles, policy, and the normalised table of audit rows."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import written


@dataclass(frozen=True)
class Roles:
    """Which columns play which part. ``group`` may be several columns."""

    quantity: str
    group: tuple[str, ...]
    product: str | None = None
    stream: str | None = None
    shift: str | None = None
    time: str | None = None
    weight: str | None = None
    density: str | None = None
    tare: str | None = None
    tie_breaks: tuple[str, ...] = ()
    conversion: str = "none"
    fixed_density: float | None = None
    timezone: str = "UTC"


@dataclass(frozen=True)
class Policy:
    """Numbers of an audit; the defaults of thresholds are the method's."""

    nominal: float
    lower_limit: float
    alpha: float = 0.01
    resolution: float | None = 0.01
    minimum_shift: float = 0.05
    maximum_shift: float = 0.5
    spread_tolerance: float = 0.5
    unit: str = "mL"
    min_rows: int = 80
    min_groups_exploratory: int = 4
    min_groups_action: int = 8
    min_tail_count: float = 5.0
    min_points: int = 20
    min_coverage: float = 0.6
    replicates: int = 200
    seed: int = 20260718
    min_success: int = 100
    max_failed_fraction: float = 0.1
    confidence: float = 0.9
    c: float = 1.0
    abs_tolerance: float = 1e-6
    rel_tolerance: float = 1e-8
    order_confirmed: bool = True
    contract_valid: bool = True


def decimal(x: float) -> Column:
    """A number as the decimal that it is written as."""
    return F.lit(Decimal(str(x))).cast("decimal(38,18)")


#: types whose text, read as a double, is their value again
PLAIN = {"tinyint", "smallint", "int", "bigint", "double"}


def number(column: str, kind: str | None = None) -> Column:
    """A finite number, or null: numbers as they are, text only if all of it is a number.

    A column known to be of a plain type (``kind``) is taken without going through its text, which costs more
    than all else that a row goes through.
    """
    from plumbline.functions.fixed_values import NUMBER

    c = F.col(f"`{column}`")
    if kind in PLAIN:
        return F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double"))
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(rf"\A(?:{NUMBER})\z"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def converted_quantity(roles: Roles, kinds: dict[str, str] | None = None) -> Column:
    """The adjusted quantity; null where it is invalid. ``custom`` conversions are never computed.

    ``kinds``: the columns' types, where they are known."""
    value = lambda c: number(c, (kinds or {}).get(c))
    if roles.conversion == "gross_minus_tare":
        if roles.weight is None or roles.tare is None:
            return F.lit(None).cast("double")
        y = value(roles.weight) - value(roles.tare)
    elif roles.conversion == "fixed_density":
        d = roles.fixed_density
        y = value(roles.quantity) / F.lit(float(d)) if d is not None and d > 0 else F.lit(None).cast("double")
    elif roles.conversion == "row_density":
        if roles.density is None:
            return F.lit(None).cast("double")
        d = value(roles.density)
        y = F.when(d > 0, value(roles.quantity) / d)
    elif roles.conversion == "none":
        y = value(roles.quantity)
    else:
        y = F.lit(None).cast("double")
    return F.when(F.abs(y) < float("inf"), y)


def group_token(columns: list[Column]) -> Column:
    """An opaque token of a (composite) group: SHA-256 of the values as a compact JSON array."""
    return F.concat(F.lit("GRP-"), F.upper(F.substring(F.sha2(F.to_json(F.array(*columns)), 256), 1, 16)))


def text_of(column: str) -> Column:
    return F.trim(F.col(f"`{column}`").cast("string"))


def instant(df: DataFrame, column: str, timezone: str) -> Column:
    """Seconds since the epoch. Text without an offset is in the declared zone."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(f"`{column}`").cast("timestamp")) / 1e6
    raw = text_of(column)
    zoned = raw.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})\z")
    moment = F.when(zoned, F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00"))).otherwise(F.try_to_timestamp(F.concat(F.regexp_replace(raw, "T", " "), F.lit(f" {timezone}"))))
    return F.unix_micros(moment) / 1e6


def scope_of(scope_cols: list[str] | tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in scope_cols]) if scope_cols else F.lit("ALL")


def prepare(df: DataFrame, roles: Roles, scope_cols: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(audit rows of sound scopes, one status row per scope). The source is read once: its narrow rows and
    the scopes are written; rows carry their scope's mean quantity and time, which models centre by.

    One bad quantity or blank group fails its scope with a reason; a blank in an optional role makes
    that role unavailable (null) in its scope.
    """
    absent = F.lit(None).cast("string")
    part = lambda c: absent if c is None else F.when(F.length(text_of(c)) > 0, text_of(c))
    groups = [text_of(c) for c in roles.group]
    blank_group = F.greatest(*[F.coalesce(F.length(g) == 0, F.lit(True)).cast("int") for g in groups], F.lit(0)) > 0
    raw = df.select(
        scope_of(scope_cols).alias("scope"),
        group_token(groups).alias("group_token"),
        blank_group.alias("blank_group"),
        converted_quantity(roles, dict(df.dtypes)).alias("y"),
        part(roles.product).alias("product"),
        part(roles.stream).alias("stream"),
        part(roles.shift).alias("shift"),
        (instant(df, roles.time, roles.timezone) if roles.time else F.lit(None).cast("double")).alias("at"),
        F.array(*[F.coalesce(text_of(c), F.lit("")) for c in roles.tie_breaks]).cast("array<string>").alias("tie_key"),
    )
    raw = written(raw, "narrow")
    there = lambda c: (F.count(c) == F.count("*")).alias(f"has_{c}")
    scopes = raw.groupBy("scope").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("group_token").alias("n_groups"),
        F.count_if(F.col("y").isNull()).alias("bad_quantities"),
        F.count_if("blank_group").alias("blank_groups"),
        there("product"), there("stream"), there("shift"), there("at"),
        F.min("at").alias("origin"),
        F.avg("y").alias("y_mean"),
        F.avg("at").alias("at_mean"),
    )
    failure = F.when(F.col("bad_quantities") > 0, "SELECTION_INVALID_QUANTITY").when(F.col("blank_groups") > 0, "SELECTION_INVALID_DEPLOYMENT_GROUP")
    # written, so that Spark knows the table's size when it joins: one scope must not shuffle all rows to one task
    scopes = written(scopes.withColumn("failure_code", failure), "scopes")
    sound = scopes.filter(F.col("failure_code").isNull()).select("scope", "has_product", "has_stream", "has_shift", "has_at", "origin", "y_mean", "at_mean")
    rows = raw.drop("blank_group").join(sound, "scope")
    kept = lambda c: F.when(F.col(f"has_{c}"), F.col(c)).alias(c)
    hours = lambda c: F.when(F.col("has_at"), (F.col(c) - F.col("origin")) / 3600.0)
    columns = ["scope", "group_token", "y", kept("product"), kept("stream"), kept("shift"), hours("at").alias("time_h"), "tie_key"]
    return rows.select(*columns, F.col("y_mean").alias("y_centre"), hours("at_mean").alias("t_centre")), scopes.drop("y_mean", "at_mean")
