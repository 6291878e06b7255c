"""Goldens and invariants of the audit operators, on small literal tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import special
from plumbline.operators import bootstrap, claims, decide, evidence, gates, headroom, models, profile, selection, stability
from plumbline.operators.prepare import Policy, Roles, prepare
from plumbline.plans.audit import audit
from plumbline.sources import measurements


def stage_rows():
    """Eight groups of ten, quantities cycling over nine hundredths; streams follow products."""
    out = []
    for i in range(80):
        minute = f"2026-07-20T{i // 60:02d}:{i % 60:02d}:00Z"
        out.append((f"{249.96 + 0.01 * (i % 9):.2f}", "product_A" if i % 2 == 0 else "product_B", f"batch_{i // 10 + 1:02d}", minute, f"stream_{i % 4 + 1}", "day" if i % 10 < 5 else "night", str(i + 1)))
    return out


COLUMNS = "quantity string, product string, batch_id string, timestamp string, stream string, shift string, row_sequence string"
ROLES = Roles("quantity", ("batch_id",), product="product", stream="stream", shift="shift", time="timestamp", tie_breaks=("row_sequence",))
POLICY = Policy(nominal=250.0, lower_limit=249.5)


def evaluate(spark, df, roles=ROLES, scope=()):
    rows, scopes = prepare(df, roles, scope)
    cells = models.cell_statistics(rows)
    tried = models.feasible(scopes)
    coefficients = models.fit_all(cells, tried)
    return models.candidate_ledger(tried, models.squared_errors(rows, coefficients))


def by_candidate(ledger):
    return {r.candidate_id: r for r in ledger.collect()}


def test_ledger_matches_direct_least_squares(spark):
    data = stage_rows()
    got = by_candidate(evaluate(spark, spark.createDataFrame(data, COLUMNS)))
    y = np.array([float(r[0]) for r in data])
    group = np.array([r[2] for r in data])
    t = np.arange(80) / 60.0
    b = np.array([r[1] == "product_B" for r in data], float)
    night = np.array([r[5] == "night" for r in data], float)
    designs = {"M0_intercept": [], "M1_product": [b], "M3_product_shift": [b, night], "M5_product_time": [b, t]}
    for name, columns in designs.items():
        x = np.column_stack([np.ones(80), *columns])
        rss = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
        sse = 0.0
        for g in np.unique(group):
            held = group == g
            beta = np.linalg.lstsq(x[~held], y[~held], rcond=None)[0]
            sse += ((y[held] - x[held] @ beta) ** 2).sum()
        r = got[name]
        assert r.status == "ok" and r.parameter_count == x.shape[1]
        assert r.rss == pytest.approx(rss, rel=1e-8) and r.grouped_risk == pytest.approx(sse / 80, rel=1e-8)
        assert r.bic_eff == pytest.approx(80 * math.log(rss / 80) + x.shape[1] * math.log(80), rel=1e-9)
    # product is a function of stream: no full rank
    for name in ("M2_product_stream", "M4_product_stream_shift", "M6_product_stream_shift_time"):
        assert got[name].failure_code == "CANDIDATE_DESIGN_RANK_DEFICIENT"


def test_ledger_does_not_depend_on_order_partitions_or_neighbouring_scopes(spark):
    df = spark.createDataFrame(stage_rows(), COLUMNS)
    alone = by_candidate(evaluate(spark, df))
    mixed = by_candidate(evaluate(spark, df.orderBy(F.rand(1)).repartition(9)))
    two = df.withColumn("plant", F.lit("a")).unionByName(df.withColumn("plant", F.lit("b")).withColumn("quantity", (F.col("quantity").cast("double") * 2).cast("string")))
    scoped = by_candidate(evaluate(spark, two, scope=("plant",)).filter("scope = 'a'"))
    for name, r in alone.items():
        for other in (mixed[name], scoped[name]):
            assert (other.status, other.failure_code) == (r.status, r.failure_code)
            if r.grouped_risk is not None:
                assert other.grouped_risk == pytest.approx(r.grouped_risk, rel=1e-9)


def test_unseen_level_is_a_prediction_failure(spark):
    data = [list(r) for r in stage_rows()]
    for r in data[:10]:
        r[5] = "dawn"  # only in the first batch
    got = by_candidate(evaluate(spark, spark.createDataFrame(data, COLUMNS)))
    assert (got["M3_product_shift"].status, got["M3_product_shift"].failure_code) == ("prediction_failed", "CANDIDATE_UNSEEN_LEVEL")


def test_bad_quantity_fails_its_scope_only(spark):
    df = spark.createDataFrame([("a", "1.5", "g1"), ("a", "nan", "g2"), ("b", "2", "g1"), ("b", "1e1", "g2")], "plant string, q string, g string")
    rows, scopes = prepare(df, Roles("q", ("g",)), ("plant",))
    assert {r.scope: r.failure_code for r in scopes.collect()} == {"a": "SELECTION_INVALID_QUANTITY", "b": None}
    assert sorted(r.y for r in rows.collect()) == [2.0, 10.0]


def test_time_with_offsets_and_zone(spark):
    df = spark.createDataFrame([("1", "g", "2026-01-01T03:00:00Z"), ("2", "g", "2026-01-01T01:00:00+01:00"), ("3", "g", "2026-01-01T02:30:00")], "q string, g string, t string")
    rows, _ = prepare(df, Roles("q", ("g",), time="t", timezone="Europe/Berlin"))
    assert [round(r.time_h, 6) for r in rows.orderBy("y").collect()] == [3.0, 0.0, 1.5]


def margins(spark, values, groups=4):
    return spark.createDataFrame([("ALL", f"g{i % groups}", float(v), None, None, None, None, []) for i, v in enumerate(values)], "scope string, group_token string, y double, product string, stream string, shift string, time_h double, tie_key array<string>")


@pytest.mark.parametrize(
    "values, limit, alpha, k, headroom_, ties",
    [(range(9, 14), 10, 0.2, 1, 0.0, 1), ([10, 10, 10, 12], 10, 0.25, 1, 0.0, 3), (range(10, 110), 0, 0.29, 29, 39.0, 1)],
)
def test_empirical_headroom(spark, values, limit, alpha, k, headroom_, ties):
    r = headroom.empirical_headroom(margins(spark, values), Policy(nominal=20, lower_limit=limit, alpha=alpha, min_rows=1, min_groups_exploratory=1, min_tail_count=0)).first()
    assert (r.k, r.point_estimate, r.tie_multiplicity) == (k, headroom_, ties)


def test_mean_diagnostic(spark):
    r = headroom.mean_diagnostic(margins(spark, [10.5, 11.5, 12.5]), Policy(nominal=11, lower_limit=10)).first()
    assert (r.overfill, r.margin, r.underfill_count) == (0.5, 1.5, 0)


def test_special_functions():
    x = np.linspace(-6, 6, 41)
    assert np.allclose(special.student_cdf(x, 1), 0.5 + np.arctan(x) / math.pi, atol=1e-13)
    assert np.allclose(special.student_cdf(x, 2), 0.5 + x / (2 * np.sqrt(2 + x * x)), atol=1e-13)
    assert np.allclose(special.normal_cdf(x) + special.normal_cdf(-x), 1, atol=1e-15)
    rng = np.random.default_rng(0)
    failure, df, where, scale = special.fit_student(0.3 + 0.7 * rng.standard_t(5, 20_000), np.ones(20_000), 2.1, 100.0, 1e-3)
    assert failure is None and abs(df - 5) < 0.7 and abs(where - 0.3) < 0.03 and abs(scale - 0.7) < 0.03
    assert special.fit_student(rng.normal(size=4000), np.ones(4000), 2.1, 100.0, 1e-3)[0] in (None, "STUDENT_T_DF_BOUNDARY")


@pytest.mark.parametrize("df,n", [(3, 3000), (8, 3000), (25, 20_000)])
def test_student_fit_has_the_largest_likelihood(df, n):
    x = 5 + 2 * np.random.default_rng(df).standard_t(df, n)
    failure, *best = special.fit_student(x, np.ones(n), 2.1, 100.0, 1e-3)
    score = lambda d, m, s: float((special.student_logpdf((x - m) / s, d) - math.log(s)).sum())
    assert failure is None
    for i, step in ((0, 1e-3), (1, 1e-4), (2, 1e-4)):
        for sign in (-1, 1):
            moved = list(best)
            moved[i] += sign * step * (best[i] if i == 0 else 1)
            assert score(*moved) < score(*best)
    half = [x[::2], x[1::2]]  # counted values stand for repeated ones
    doubled = special.fit_student(np.concatenate([half[0], half[0], half[1]]), np.ones(len(x) + len(half[0])), 2.1, 100.0, 1e-3)
    counted = special.fit_student(np.concatenate(half), np.repeat([2.0, 1.0], [len(h) for h in half]), 2.1, 100.0, 1e-3)
    assert doubled[0] == counted[0] and np.allclose(doubled[1:], counted[1:], rtol=1e-7)


@pytest.mark.parametrize("risk,alpha,most,shift", [(lambda s: s**9, 0.5, 4.0, 0.5 ** (1 / 9)), (lambda s: 0.0 if s < 1 / 3 else 1.0, 0.1, 200.0, 1 / 3), (lambda s: s / 8, 0.25, 8.0, 2.0)])
def test_largest_shift_is_met_from_below(risk, alpha, most, shift):
    got, base, feasible, censored = special.largest_shift(risk, alpha, most)
    assert feasible and not censored and risk(got) <= alpha and abs(got - shift) <= 1e-9


def crossfit_of(spark, residuals, prediction=12.0):
    return spark.createDataFrame([("ALL", f"g{i % 3}", "M0_intercept", 0, prediction + r, 1, prediction) for i, r in enumerate(residuals)], "scope string, group_token string, candidate_id string, ordinal int, y double, k int, yhat double")


def test_gaussian_tail_solves_its_equation(spark):
    residuals = [-0.9, -0.3, 0.3, 0.9] * 3
    policy = Policy(nominal=12, lower_limit=10, alpha=0.1, maximum_shift=4.0)
    r = headroom.parametric_headroom(crossfit_of(spark, residuals), policy, student=False).first()
    sd = np.std(residuals, ddof=1)
    risk = lambda s: float(special.normal_cdf(np.array([(10 + s - 12) / sd]))[0])
    assert risk(r.point_estimate) <= 0.1 < risk(r.point_estimate + 2e-9)


def test_gaussian_diagnostics_and_degenerate(spark):
    policy = Policy(nominal=12, lower_limit=10, alpha=0.1, maximum_shift=4.0)
    skewed = headroom.parametric_headroom(crossfit_of(spark, [-8, 0, 0, 0] * 3), policy, student=False).first()
    assert skewed.material_warning and "RESIDUAL_SKEW_DIAGNOSTIC" in skewed.warnings
    flat = headroom.parametric_headroom(crossfit_of(spark, [0.0] * 12), policy, student=False).first()
    assert flat.status == "ineligible" and flat.point_estimate is None


def test_student_tail_differs_from_gaussian(spark):
    p = (np.arange(48) + 0.5) / 48
    a = 4 * p * (1 - p)
    q = np.sign(p - 0.5) * 2 * np.sqrt(np.cos(np.arccos(np.sqrt(a)) / 3) / np.sqrt(a) - 1)  # quantiles of t with 4 degrees
    policy = Policy(nominal=12, lower_limit=10, alpha=0.05, maximum_shift=4.0)
    c = crossfit_of(spark, (0.45 * q).tolist())
    h2, h3 = (headroom.parametric_headroom(c, policy, student=s).first().point_estimate for s in (False, True))
    assert abs(h2 - h3) > 0.02


def ordered(spark, values, times=None, keys=None):
    times = times or list(range(len(values)))
    return spark.createDataFrame([("ALL", f"g{i % 9}", float(v), "p", "s", None, float(times[i]), keys[i] if keys else []) for i, v in enumerate(values)], margins(spark, [1]).schema)


def test_stability_rules(spark):
    screen = lambda v, **k: stability.stability_screen(ordered(spark, v, **k), POLICY).first()
    calm = screen([1, -1] * 12)
    assert calm.state == "pass" and calm.coverage == 1.0
    step = screen([0] * 12 + [10] * 12)
    assert step.one_side_runs == 2 and step.quartile_shift == 1 and step.state == "material_warning"
    assert screen([0] * 19 + [10]).beyond_3sigma == 1
    assert screen(list(range(20))).monotone_runs == 1
    assert "MR_SCALE_FALLBACK" in screen([5] * 20).warnings
    tied = screen([1, -1] * 11, times=[0, 0, *range(1, 21)])
    assert tied.eligible_rows == 20 and "ORDER_TIE_UNRESOLVED" in tied.warnings and tied.coverage == pytest.approx(20 / 22)
    sorted_ties = screen([1, -1] * 11, times=[0, 0, *range(1, 21)], keys=[["b"], ["a"]] + [["x"]] * 20)
    assert sorted_ties.eligible_rows == 22


def scored_table(spark, scores):
    return spark.createDataFrame([("ALL", f"C{i}", i, "ok", 100, s, 1.0, s) for i, s in enumerate(scores)], "scope string, candidate_id string, ordinal int, status string, n_rows long, bic_eff double, grouped_risk double, c_score double")


def test_near_tie(spark):
    r = selection.select_candidate(scored_table(spark, [10.0, 10 + 5e-7, 10 + 2e-6]), POLICY).first()
    assert r.near_tie and r.winner is None and r.equivalence_set == ["C0", "C1"] and r.runner_up == "C1"


@pytest.mark.parametrize("bic, risk, status", [((0.0, 1.0), (2.0, 1.0), "finite"), ((0.0, 1.0), (1.0, 1.0), "parallel_no_switch"), ((1.0, 1.0), (1.0, 1.0), "coincident"), ((1.0, 0.0), (2.0, 1.0), "outside_nonnegative_domain"), ((1.0, None), (2.0, 1.0), "not_available")])
def test_switches(spark, bic, risk, status):
    t = spark.createDataFrame([("ALL", f"C{i}", i, 100, bic[i], risk[i]) for i in range(2)], "scope string, candidate_id string, ordinal int, n_rows long, bic_eff double, grouped_risk double")
    r = selection.pairwise_switches(t, 1.0).first()
    assert r.status == status
    if status == "finite":
        assert r.switch_c == pytest.approx(math.log(100) / math.log(2))


def test_bootstrap_bound_and_failures(spark):
    groups = spark.createDataFrame([("ALL", f"g{i}") for i in range(8)], "scope string, group_token string")
    values = lambda v: spark.createDataFrame([("ALL", i, "H1", x) for i, x in enumerate(v)], bootstrap.VALUES)
    policy = Policy(nominal=1, lower_limit=0, confidence=0.85, min_success=10)
    assert bootstrap.group_bootstrap(values([float(i) for i in range(1, 21)]), groups, policy).first().lower_bound == 3.0
    some = bootstrap.group_bootstrap(values([None, None, *map(float, range(18))]), groups, policy).first()
    assert some.valid and some.u1_status == "warning"
    many = bootstrap.group_bootstrap(values([None] * 3 + [1.0] * 17), groups, policy).first()
    assert not many.valid and many.failure_code == "BOOTSTRAP_FAILURE_FRACTION"


def test_weighted_replicates_equal_copied_rows(spark):
    df = spark.createDataFrame(stage_rows(), COLUMNS)
    rows, scopes = prepare(df, ROLES)
    rows = rows.withColumn("y", F.round("y", 2)).cache()
    policy = Policy(nominal=250, lower_limit=249.5, alpha=0.1, replicates=5)
    draws = bootstrap.bootstrap_draws(rows, 5, 3, mode="compatible").cache()
    got = {(r.replicate, r.protocol_id): r.value for r in bootstrap.bootstrap_h1(rows, draws, policy).collect()}
    y, w = {}, {}
    for r in rows.collect():
        y.setdefault(r.group_token, []).append(r.y - 249.5)
    for r in draws.collect():
        w.setdefault(r.replicate, []).extend([r.group_token] * r.w)
    for replicate, tokens in w.items():
        m = sorted(v for t in tokens for v in y[t])
        assert got[replicate, "H1_group_empirical_quantile"] == pytest.approx(max(0.0, m[int(0.1 * len(m))]))
    chosen = models.candidate_table(spark).filter("candidate_id = 'M1_product'").select(F.lit("ALL").alias("scope"), "candidate_id", "terms")
    tails = bootstrap.bootstrap_parametric(rows, models.cell_statistics(rows), draws, chosen, policy, student=False, blocks=2).collect()
    assert len(tails) == 5 and all(r.value is not None for r in tails)
    # H3 only where it is asked for; H2 is the same beside it
    both = bootstrap.bootstrap_parametric(rows, models.cell_statistics(rows), draws, chosen.withColumn("student", F.lit(True)), policy, blocks=2).collect()
    h2 = {r.replicate: r.value for r in both if r.protocol_id == "H2_gaussian_residual_tail"}
    assert len(both) == 10 and h2 == pytest.approx({r.replicate: r.value for r in tails}, abs=1e-8)


def decided(spark, h, **changes):
    base = {"scope": "ALL", "contract_valid": True, "action_supported": True, "g1_state": "pass", "near_tie": False, "safe_headroom": h, "basis": "lower_bounds", "protocol_spread": 0.1, "mixed_states": False, "parametric_warning": False} | changes
    schema = "scope string, contract_valid boolean, action_supported boolean, g1_state string, near_tie boolean, safe_headroom double, basis string, protocol_spread double, mixed_states boolean, parametric_warning boolean"
    return decide.action_state(spark.createDataFrame([tuple(base.values())], schema), POLICY).first()


def test_action_states_and_pilot_ranges(spark):
    r = decided(spark, 0.45)
    assert (r.state, r.pilot_lower, r.pilot_upper) == ("pilot_range_supported", 0.13, 0.36)
    r = decided(spark, 0.45, near_tie=True)
    assert (r.state, r.pilot_lower, r.pilot_upper) == ("pilot_only_conservative", 0.05, 0.22)
    assert r.reason_codes == ["SELECTION_NEAR_TIE", "CONSERVATIVE_PILOT_REFERENCE"]
    assert decided(spark, 0.45, contract_valid=False, action_supported=False).state == "invalid_contract"
    assert decided(spark, 0.45, action_supported=False, g1_state="material_warning").state == "insufficient_evidence"
    assert decided(spark, 0.45, g1_state="material_warning").state == "diagnose_process_first"
    for h in (None, float("nan"), -0.1, 0.0, 0.04):
        assert decided(spark, h, g1_state="material_warning").state == "no_actionable_headroom"
    assert decided(spark, 0.05, near_tie=True).reason_codes == ["PILOT_RANGE_SUBMINIMUM"]


def test_sufficiency_takes_the_least_product(spark):
    support = spark.createDataFrame([("ALL", "a", 150, 8), ("ALL", "b", 10, 2)], "scope string, product string, n_rows long, n_groups long")
    scope = spark.createDataFrame([("ALL", 1.0, True)], "scope string, coverage double, valid boolean")
    r = gates.sufficiency_gate(support, scope, scope, POLICY).first()
    assert not r.exploratory_supported and not r.action_supported
    assert r.reason_codes[:3] == ["EVIDENCE_ROWS_INSUFFICIENT", "EVIDENCE_GROUPS_EXPLORATORY_INSUFFICIENT", "EVIDENCE_GROUPS_ACTION_INSUFFICIENT"]


def test_whole_audit_on_a_stable_process(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(1056):
        p, s, h = f"p{i % 2}", f"s{i // 2 % 2}", f"h{i // 4 % 2}"
        y = 250.4 + 0.05 * (i % 2) + 0.03 * (i // 2 % 2) + 0.12 * rng.normal()
        data.append((round(y, 3), p, f"b{i // 88:02d}", f"2026-07-18T{i // 60 % 24:02d}:{i % 60:02d}:00Z", s, h, i))
    df = spark.createDataFrame(data, "quantity double, product string, batch_id string, timestamp string, stream string, shift string, n int")
    roles = Roles("quantity", ("batch_id",), product="product", stream="stream", shift="shift", time="timestamp", tie_breaks=("n",))
    policy = Policy(nominal=250.0, lower_limit=249.5, replicates=100)
    tables = audit(df, roles, policy, student=False)
    d = tables["decisions"].first()
    assert d.state in V_STATES and d.safe_headroom > 0
    assert {r.protocol_id: r.status != "ineligible" for r in tables["protocols"].collect()} == {"H1_group_empirical_quantile": True, "H2_gaussian_residual_tail": True}
    assert evidence.verify_evidence(tables["evidence"]).isEmpty() and evidence.check_lineage(tables["evidence"]).isEmpty()
    assert tables["evidence"].count() == 4


from plumbline.functions.fixed_values import ACTION_STATES as V_STATES  # noqa: E402


def test_audit_of_more_groups_than_max_groups(spark):
    rng = np.random.default_rng(5)
    data = [(round(250.4 + 0.05 * (i % 2) + 0.12 * rng.normal(), 3), f"p{i % 2}", f"b{i // 4:03d}") for i in range(840)]
    df = spark.createDataFrame(data, "quantity double, product string, batch_id string")
    roles = Roles("quantity", ("batch_id",), product="product")
    tables = audit(df, roles, Policy(nominal=250.0, lower_limit=249.5, replicates=10, min_success=5), draw_mode="compatible", student=False)
    assert {r.status for r in tables["ledger"].filter("candidate_id IN ('M0_intercept', 'M1_product')").collect()} == {"ok"}
    assert {r.protocol_id for r in tables["protocols"].collect()} == {"H1_group_empirical_quantile", "H2_gaussian_residual_tail"}
    assert {(r.requested, r.successful) for r in tables["bounds"].collect()} == {(10, 10)}


def test_folds_in_blocks_are_the_folds_of_the_whole(spark):
    rows, scopes = prepare(spark.createDataFrame(stage_rows(), COLUMNS), ROLES)
    cells, tried = models.cell_statistics(rows), models.feasible(scopes)
    got, want = ({(r.candidate_id, r.fold_token): (r.failure_code, r.k, r.intercept, r.slope) for r in models.fit_all(cells, tried, block=b).collect()} for b in (3, 1000))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:2] == v[:2] and got[k][2:] == pytest.approx(v[2:])


def test_profile_types_missing_and_identifiers(spark):
    df = spark.createDataFrame(
        [("12", "007", "1.5", "true", "2026-01-01", "2026-01-01", "a@b.co", "NA"), ("", "8", ".5e1", "FALSE", "2026-01-02T10:00:00Z", "2026-01-02", "x", "b")],
        "quantity string, count string, ratio string, enabled string, production_datetime string, code string, extra string, product string",
    )
    p = {r.name: r for r in profile.profile(df).collect()}
    assert [p[c].dtype for c in df.columns] == ["integer", "integer", "number", "boolean", "datetime", "string", "string", "string"]
    assert p["quantity"].missing_fraction == 0.5 and p["product"].missing_fraction == 0 and p["ratio"].median == 3.25
    assert p["extra"].is_identifier and not p["code"].is_identifier
    assert profile.profile_status(profile.profile(df)).first().failure_code is None


def test_header_rules_and_strict_csv(spark, tmp_path):
    measurements.validate_header(["a", "B c"])
    for bad in (["a", "A"], [" a"], ["a/b"], [""], ["x" * 129]):
        with pytest.raises(measurements.BadHeader):
            measurements.validate_header(bad)
    (tmp_path / "ok.csv").write_text('a,b\n 1 ,"x\ny"\n2,NA\n')
    assert [tuple(r) for r in measurements.read_measurements(spark, str(tmp_path / "ok.csv")).collect()] == [("1", "x\ny"), ("2", "NA")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="header|malformed|MALFORMED|match"):
        measurements.read_measurements(spark, str(tmp_path / "bad.csv")).collect()


def test_fingerprints_ignore_order_and_see_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    one = measurements.table_fingerprint(df).first().dataset_id
    assert measurements.table_fingerprint(df.orderBy(F.desc("x")).repartition(3)).first().dataset_id == one
    assert measurements.table_fingerprint(df.distinct()).first().dataset_id != one


def test_lineage_levels_cycles_and_closure(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")], "child string, parent string")
    levels = {r.node: r.level for r in evidence.topo_levels(links).collect()}
    assert levels == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}
    assert {tuple(r) for r in evidence.ancestors(links).filter("node = 'c'").collect()} == {("c", "a"), ("c", "b")}


def test_text_rules(spark):
    texts = ["export OPENAI_API_KEY=sk-abcdefghijklmnopqrstuvwx", "API_KEY=changeme", "api_key: ${SECRET}", "see /home/user/x and C:\\data\\y", "Authorization: Bearer abcdefghijklmnop1234", "a/home/b", "AKIA" + "A" * 16]
    got = {}
    for r in claims.scan_text(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.code)
    assert got == {0: {"SECRET_OPENAI_KEY", "SECRET_API_KEY_ASSIGNMENT"}, 3: {"ABSOLUTE_LINUX_PATH", "ABSOLUTE_WINDOWS_DRIVE_PATH"}, 4: {"SECRET_BEARER_VALUE"}, 6: {"SECRET_AWS_ACCESS_KEY"}}


def test_numbers_and_claims(spark):
    facts = spark.createDataFrame([("1.50",), ("7%",)], "value string")
    t = spark.createDataFrame([(1, "H2 gives 1.5 and 2.25 in EV-X-ABCDEFABCDEF, 7% of M1_product, 8%.")], "doc_id int, text string")
    assert {r.token for r in claims.ungrounded_numbers(t, facts).collect()} == {"2.25", "8%"}
    c = spark.createDataFrame([(i, "CLM-001", x) for i, x in enumerate(["achieved savings", "the plant is compliant", "guaranteed safety", "optimal production setpoint", "universally validated", "not a production setpoint", "protocols agree"])], "doc_id int, claim_id string, claim_text string")
    d = c.select("doc_id", F.lit("pilot_range_supported").alias("state"), F.lit(True).alias("conflict"))
    v = {r.doc_id: r.verdict for r in claims.judge_claims(c, d).collect()}
    assert [v[i] for i in range(7)] == ["prohibited"] * 5 + ["supported", "overstated"]


def test_a_sample_of_queries_matches_sql(spark):
    """A few queries against DuckDB on the smallest tables."""
    import os

    import duckdb

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("duplicate_ids", "unit_lookup", "action_state", "provenance_checks", "claim_status", "state_semantics"):
        df = entry.queries()[name](spark, d)
        columns = sorted(df.columns)
        mine = sorted(str(tuple(r[x] for x in columns)) for r in df.collect())
        r = c.sql(entry.oracle_sql()[name])
        at = [r.columns.index(x) for x in columns]
        assert mine == sorted(str(tuple(row[i] for i in at)) for row in r.fetchall()), name


def test_headroom_values_are_not_rounded_to_a_grid(spark):
    n = 1_100_000
    values = spark.range(n).select(F.lit("ALL").alias("scope"), F.when(F.col("id") == 0, 1e9).otherwise(F.col("id") / n).alias("x"))
    assert headroom.compacted(values, ["scope"], "x").count() == n


def test_ties_are_counted_without_a_list(spark):
    rows = [("ALL", "p", "s", float(i), t, k) for i, (t, k) in enumerate([(0.0, ["a"]), (0.0, ["b"]), (1.0, ["a"]), (1.0, ["a"]), (2.0, [""]), (2.0, ["b"]), (3.0, []), (4.0, None)])]
    df = spark.createDataFrame(rows, "scope string, product string, stream string, y double, time_h double, tie_key array<string>")
    out = stability.ordered_segments(df)
    assert {r.y: r.resolved for r in out.collect()} == dict(enumerate([True, True, False, False, False, False, True, True]))
    assert "collect_set" not in out._jdf.queryExecution().toString()


def test_state_semantics_judges_every_document_under_six_states(spark):
    from plumbline.plans import audit_queries

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n for r in audit_queries.QUERIES["state_semantics_all"](spark, d).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {k % 6 for k in got} == set(range(6))
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == dict(duckdb.sql(f"SELECT doc_id, count(*) FROM ({audit_queries.ORACLE_SQL['state_semantics_all']}) GROUP BY 1").fetchall())


def test_errors_from_sums_equal_those_of_scored_rows(spark):
    """Also where the sums cancel out: a product whose quantity is nearly constant."""
    data = [(f"{100 + 50 * (i % 2) + (1e-7 if i % 2 else 0.3) * ((i * 7) % 11):.9f}", "AB"[i % 2], f"b{i // 12}", f"2026-07-20T{i // 60:02d}:{i % 60:02d}:00Z", f"s{i % 3}", "dn"[i % 5 == 0], str(i)) for i in range(120)]
    df = spark.createDataFrame(data, COLUMNS)
    rows, scopes = prepare(df, ROLES)
    cells = models.cell_statistics(rows)
    coefficients = models.fit_all(cells, models.feasible(scopes))
    errors = models.squared_errors(rows, coefficients).filter("failure_code is null").collect()
    e = F.col("y") - F.col("yhat")
    want = {}
    for held in (True, False):
        scored = models.score_rows(rows, coefficients, held).withColumn("fold", F.col("group_token") if held else F.lit(""))
        want |= {(r.candidate_id, r.fold): r.sse for r in scored.groupBy("candidate_id", "fold").agg(F.sum(e * e).alias("sse")).collect()}
    assert len(errors) == len(want) > 20
    for r in errors:
        assert r.sse == pytest.approx(want[r.candidate_id, r.fold_token], rel=1e-6, abs=1e-12)


def test_result_tables_and_file_fingerprints(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "scope string, x int")
    measurements.write_result_tables({"t": df, "plain": df.select("x")}, str(tmp_path / "out"))
    assert sorted((r.scope, r.x) for r in spark.read.parquet(f"{tmp_path}/out/t").collect()) == [("a", 1), ("b", 2), ("b", 3)]
    assert (tmp_path / "out" / "t" / "scope=a").is_dir() and spark.read.parquet(f"{tmp_path}/out/plain").count() == 3
    (tmp_path / "f.csv").write_bytes(b"x,y\n1,2\n")
    r = measurements.file_fingerprint(spark, str(tmp_path / "f.csv")).first()
    sha = hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    assert (r.sha256, r.dataset_id) == (sha, "dataset-" + sha[:16])


def test_unsafe_evidence_and_missing_checksums(spark):
    facts = spark.createDataFrame([("A", "fine", "ok", 1.0, "mL"), ("A", "call +1 (555) 010-0199", "ok", 1.0, "mL"), ("A", "see /home/someone", "ok", 1.0, "mL"), ("A", "a\x01b", "ok", 1.0, "mL"), ("A", "+1 (555) 010-0199", "ok", 1.0, "mL")], "component string, statement string, status string, value double, unit string")
    made = evidence.make_evidence(facts.withColumn("parents", F.array().cast("array<string>")))
    found = {r.problem for r in evidence.unsafe_content(made).collect()}
    assert found == {"ABSOLUTE_LINUX_PATH", "CONTROL_CHARACTER", "PERSONAL_VALUE"}
    lost = made.withColumn("content_sha256", F.when(F.col("statement") != "fine", F.col("content_sha256")))
    fine = made.filter("statement = 'fine'").first().evidence_id
    assert {r.problem for r in evidence.verify_evidence(lost).filter(F.col("evidence_id") == fine).collect()} == {"content_mismatch", "id_mismatch"}


def test_written_tables_can_be_dropped(spark):
    from plumbline.session import drop_written, written

    drop_written(spark)
    kept = written(spark.range(5).toDF("x"), "some")
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert kept.count() == 5 and os.path.isdir(path)
    assert drop_written(spark) == 1 and not os.path.exists(path) and drop_written(spark) == 0
