"""The whole chain: prepared rows to one decision per scope, all scopes in the same jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed_values import H2, H3, U1
from plumbline.operators import bootstrap, decide, evidence, gates, headroom, models, selection, stability
from plumbline.operators.prepare import Policy, Roles, prepare
from plumbline.session import written


def audit(df: DataFrame, roles: Roles, policy: Policy, scope_cols: list[str] | tuple[str, ...] = (), draw_mode: str = "hashed", student: bool = True, draws: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All result tables of an audit, by name. ``draws`` may draw the groups of replicates in place of
    ``draw_mode``: it gets (scope, group_token, ...) and returns (scope, replicate, group_token, w).

    Rows, coefficients, ledger, cross-fitted rows of the equivalence sets and replicate values are
    written to the shared folder once and read by what follows.
    """
    rows, scopes = prepare(df, roles, scope_cols)
    rows = written(rows, "rows")
    cells = written(models.cell_statistics(rows), "cells")
    tried = models.feasible(scopes)
    coefficients = written(models.fit_all(cells, tried), "coefficients")
    errors = written(models.squared_errors(rows, coefficients), "errors")
    ledger = written(models.candidate_ledger(tried, errors), "ledger")
    scored = selection.score(ledger, policy.c)
    chosen = written(selection.select_candidate(scored, policy), "selection")
    members = chosen.select("scope", F.explode("equivalence_set").alias("candidate_id"))
    kept = written(models.score_rows(rows, coefficients.join(members, ["scope", "candidate_id"], "left_semi"), held_out=True), "crossfit")
    h1 = headroom.empirical_headroom(rows, policy).select("scope", "protocol_id", "status", "point_estimate", F.lit(False).alias("material_warning"), "warnings")
    residuals = headroom.residual_tables(kept)
    protocols = h1.unionByName(headroom.parametric_headroom(kept, policy, False, residuals))
    if student:
        protocols = protocols.unionByName(headroom.parametric_headroom(kept, policy, True, residuals))
    protocols = written(protocols, "protocols")
    drawn = written(draws(cells) if draws else bootstrap.bootstrap_draws(cells, policy.replicates, policy.seed, draw_mode), "draws")
    terms = models.candidate_table(df.sparkSession)
    eligible = protocols.filter(F.col("status") != "ineligible").select("scope", "protocol_id")
    # replicates are solved only where a parametric protocol takes part
    parametric = eligible.filter(F.col("protocol_id").isin(H2, H3)).groupBy("scope").agg(F.bool_or(F.col("protocol_id") == H3).alias("student"))
    equivalent = members.join(F.broadcast(terms), "candidate_id").join(parametric, "scope")
    values = bootstrap.bootstrap_h1(rows, drawn, policy).unionByName(bootstrap.bootstrap_parametric(rows, cells, drawn, equivalent, policy))
    values = values.join(eligible, ["scope", "protocol_id"], "left_semi")
    bounds = written(bootstrap.group_bootstrap(values, cells, policy), "bounds")
    protocols = decide.attach_bounds(protocols, bounds)
    g1 = written(stability.stability_screen(rows, policy), "stability")
    valid = scopes.select("scope").join(bounds.select("scope", "valid").distinct(), "scope", "left").select("scope", F.coalesce("valid", F.lit(False)).alias("valid"))
    g2 = gates.sufficiency_gate(gates.product_support(rows), g1, valid, policy)
    safe = decide.safe_headroom(protocols)
    table = (
        scopes.select("scope", (F.col("failure_code").isNull() & F.lit(policy.contract_valid)).alias("contract_valid"))
        .join(g2.select("scope", "action_supported"), "scope", "left")
        .join(g1.select("scope", F.col("state").alias("g1_state")), "scope", "left")
        .join(chosen.select("scope", "near_tie"), "scope", "left")
        .join(safe, "scope", "left")
    )
    for c in ("action_supported", "near_tie", "mixed_states", "parametric_warning"):
        table = table.withColumn(c, F.coalesce(c, F.lit(False)))
    table = table.withColumn("basis", F.coalesce("basis", F.lit("none")))
    decisions = written(decide.action_state(table, policy), "decisions")
    return {
        "scopes": scopes, "ledger": scored, "folds": models.fold_metrics(errors), "selection": chosen, "switches": selection.pairwise_switches(scored, policy.c),
        "mean": headroom.mean_diagnostic(rows, policy), "protocols": protocols, "bounds": bounds, "stability": g1, "sufficiency": g2, "decisions": decisions,
        "evidence": audit_evidence(chosen, protocols, decisions, policy),
    }


def audit_evidence(chosen: DataFrame, protocols: DataFrame, decisions: DataFrame, policy: Policy) -> DataFrame:
    """Selection, protocol and action evidence, each citing what it rests on."""
    none = F.array().cast("array<string>")
    base = chosen.select("scope", F.lit("SELECTION").alias("component"), F.concat_ws(" ", F.col("scope"), F.coalesce("winner", F.lit("near tie"))).alias("statement"), F.lit("ok").alias("status"), F.col("gap").alias("value"), F.lit("").alias("unit"), none.alias("parents"))
    e1 = evidence.make_evidence(base)
    p = protocols.join(e1.select("scope", F.col("evidence_id").alias("parent")), "scope", "left").select(
        "scope", F.lit("PROTOCOL").alias("component"), F.concat_ws(" ", "scope", "protocol_id").alias("statement"), "status", F.col("point_estimate").alias("value"), F.lit(policy.unit).alias("unit"), F.array_compact(F.array("parent")).alias("parents")
    )
    e2 = evidence.make_evidence(p)
    links = e2.groupBy("scope").agg(F.array_sort(F.collect_list("evidence_id")).alias("parents"))
    a = decisions.join(links, "scope", "left").select("scope", F.lit("ACTION").alias("component"), F.concat_ws(" ", "scope", "state").alias("statement"), F.col("state").alias("status"), F.col("safe_headroom").alias("value"), F.lit(policy.unit).alias("unit"), F.coalesce("parents", none).alias("parents"))
    return e1.unionByName(e2).unionByName(evidence.make_evidence(a))


def u1_row(bounds: DataFrame) -> DataFrame:
    """The uncertainty protocol's own row: its point is the least bound."""
    return bounds.groupBy("scope").agg(F.first("u1_status").alias("status"), F.min("lower_bound").alias("point_estimate")).withColumn("protocol_id", F.lit(U1))
