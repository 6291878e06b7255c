"""Results that must not depend on how rows are dealt: small data over many partitions, against brute force."""

import collections
import contextlib
import csv
import io
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.functions import special
from plumbline.operators import bootstrap, claims, evidence, headroom, models, prepare, profile, stability, tails, views
from plumbline.operators.prepare import Policy
from plumbline.sources import measurements


@contextlib.contextmanager
def many_parts(spark, n=16):
    """No partitions are put together: every range part stays."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# --- ordered stability -------------------------------------------------------------------------------


def runs(signs, least):
    hits, length, last = 0, 0, None
    for s in [*signs, None]:
        if s is not None and s == last:
            length += 1
            continue
        hits += last in (1, -1) and length >= least
        length, last = 1, s
    return hits


def brute_rules(segment):
    n, mean, sd = len(segment), statistics.fmean(segment), statistics.stdev(segment)
    steps = [b - a for a, b in zip(segment, segment[1:])]
    mr = statistics.fmean(map(abs, steps)) / 1.128
    sigma = mr if mr > 0 else sd
    q = max(1, n // 4)
    sign = lambda v: (v > 0) - (v < 0)
    return (
        n, round(sigma, 9), sum(abs(v - mean) > 3 * sigma for v in segment) if sigma > 0 else 0, runs([sign(v - mean) for v in segment], 8), runs([sign(v) for v in steps], 5),
        int(sd > 0 and abs(statistics.fmean(segment[:q]) - statistics.fmean(segment[-q:])) > 1.5 * sd),
    )


@pytest.mark.parametrize("parts", [1, 16])
def test_run_rules_go_over_the_ends_of_range_parts(spark, parts):
    rng = random.Random(parts)
    policy, rows, want = Policy(nominal=1, lower_limit=0), [], {}
    for scope, product, n in (("a", "p", 900), ("a", "q", 300), ("b", "p", 25), ("b", "q", 10)):
        values, level = [], 0
        while len(values) < n:  # long runs, rises and falls, and flat stretches
            kind, k = rng.choice(["side", "rise", "fall", "flat", "noise"]), rng.randint(3, 30)
            level = rng.randint(-20, 20)
            values += [level + {"side": rng.randint(0, 3), "rise": i, "fall": -i, "flat": 0, "noise": rng.randint(-9, 9)}[kind] for i in range(k)]
        values = [float(v * 4) for v in values[:n]]
        segments, own = [[]], []
        for t, v in enumerate(values):
            if n > 100 and t in (n // 3, n // 2):  # a tie without keys is dropped and splits the stream
                own += [(scope, "g", v, product, "s", None, float(t), []), (scope, "g", v, product, "s", None, float(t), [])]
                segments.append([])
            else:
                own.append((scope, "g", v, product, "s", None, float(t), [str(t)]))
                segments[-1].append(v)
        rows += own
        want |= {(scope, product, 2 * i): brute_rules(x) for i, x in enumerate(segments) if len(x) >= 20}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "scope string, group_token string, y double, product string, stream string, shift string, time_h double, tie_key array<string>")
    with many_parts(spark, parts):
        segments = stability.ordered_segments(df)
        assert segments.select("part").distinct().count() >= parts // 2
        got = {(r.scope, r.product, r.segment): (r.n, round(r.sigma, 9), r.beyond_3sigma, r.one_side_runs, r.monotone_runs, r.quartile_shift) for r in stability.segment_rules(segments, policy).collect()}
        coverage = {r.scope: (r.n_rows, r.unresolved_rows, r.eligible_rows) for r in stability.ordered_coverage(segments, policy).collect()}
    assert got == want
    assert coverage == {"a": (1204, 8, 1196), "b": (35, 0, 25)}


# --- texts -----------------------------------------------------------------------------------------


def test_two_phase_scan_finds_what_the_expressions_find(spark):
    rng = random.Random(5)
    pieces = [
        "sk-" + "a1B2" * 6, "sk-short", "AKIA" + "Q7" * 8, "akia" + "q7" * 8, "ghp_" + "x9" * 12, "github_pat_" + "z" * 24, "-----BEGIN RSA PRIVATE KEY-----", "export MY_API_KEY = v1", "my_ApiKey: ", "apikey='changeme'",
        "TOKEN: abc", "auth_token=null", "a token = b", "Bearer " + "t0k" * 6, "BEARER\t" + "~" * 16, "/Users/me", "x/Users/me", "/home/me", "/private/etc", "/tmp/x", "/var/tmp/x", "/var/folders/x", "C:\\x", "xc:\\x", "\\\\host\\share",
        "İ", "K", "ſk-" + "a" * 30, "\n", "\n", "\r", "\u2028", " ", "\t", "=", "words", "",
    ]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for i in range(3000)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(claims._rule_hit(F.col("text"), p, c, h), F.lit(code)) for code, p, c, h in V.TEXT_RULES]))).alias("code"))
    want = {tuple(r) for r in every.collect()}
    assert {tuple(r) for r in claims.scan_text(docs).collect()} == want
    assert {c for _, c in want} == {rule[0] for rule in V.TEXT_RULES} == set(V.RULE_LITERALS)


def test_planted_scan_and_its_sql_see_what_documents_hold_of_their_own(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    own = ['token = "2abc3ff2ca8f"', "words", "API_KEY=changeme", "see /home/me", "Bearer " + "t0k" * 6, None]
    spark.createDataFrame([(i, own[i % len(own)]) for i in range(120)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine = sorted(tuple(r) for r in entry.queries()["secret_scan_planted"](spark, str(tmp_path)).select("doc_id", "code").collect())
    assert (0, "SECRET_TOKEN_ASSIGNMENT") in mine and len(mine) > 120
    assert mine == sorted(c.sql(f"SELECT doc_id, code FROM ({entry.oracle_sql()['secret_scan_planted']})").fetchall())


# --- tails of residuals ------------------------------------------------------------------------------


def audit_table(spark, n=900, seed=7):
    """Groups with shifts of their own, heavy tails, three products, two streams, time."""
    rng = np.random.default_rng(seed)
    group, product, stream = rng.integers(0, 12, n), rng.integers(0, 3, n), rng.integers(0, 2, n)
    y = 50 + 0.3 * product + 0.05 * (group % 4) + 0.2 * stream + 0.6 * rng.standard_t(6, n) + 0.002 * np.arange(n) / 60
    rows = [("ALL", f"g{g:02d}", float(round(v, 3)), f"p{p}", f"s{s}", "day", float(i) / 60) for i, (g, v, p, s) in enumerate(zip(group, y, product, stream))]
    rows += [("B", *r[1:]) for r in rows[:400]]
    df = spark.createDataFrame(rows, "scope string, group_token string, y double, product string, stream string, shift string, time_h double")
    centres = df.groupBy("scope").agg(F.avg("y").alias("y_centre"), F.avg("time_h").alias("t_centre"))
    return rows, df.join(centres, "scope")


def held_out_predictions(rows, scope, terms, w):
    """Predictions and residuals of one replicate by least squares on copied rows, each copy's group held out."""
    own = [r for r in rows if r[0] == scope]

    def design(part, levels):
        cols = [np.ones(len(part))]
        for f, k in (("product", 3), ("stream", 4)):
            if f in terms:
                cols += [np.array([r[k] == x for r in part], float) for x in levels[f][1:]]
        if "time" in terms:
            cols.append(np.array([r[6] for r in part]))
        return np.stack(cols, 1)

    levels = {f: sorted({r[k] for r in own}) for f, k in (("product", 3), ("stream", 4))}
    e, pred, weight = [], [], []
    for g, times in w.items():
        train = [r for r in own for _ in range(w.get(r[1], 0) - (r[1] == g))]
        beta = np.linalg.lstsq(design(train, levels), np.array([r[2] for r in train]), rcond=None)[0]
        held = [r for r in own if r[1] == g]
        p = design(held, levels) @ beta
        pred += p.tolist()
        e += (np.array([r[2] for r in held]) - p).tolist()
        weight += [times] * len(held)
    return np.array(e), np.array(pred), np.array(weight, float)


def solved(e, pred, weight, policy, student):
    total = weight.sum()
    if student:
        failure, df, where, scale = special.fit_student(e, weight, 2.1, 100.0, 1e-3)
        if failure:
            return None
        cdf = lambda z: special.student_cdf(z, df)
    else:
        where = (weight @ e) / total
        scale, cdf = math.sqrt((weight @ (e - where) ** 2) / (total - 1)), special.normal_cdf
    return special.largest_shift(lambda s: float(weight @ cdf((policy.lower_limit + s - pred - where) / scale)) / total, policy.alpha, policy.maximum_shift)[0]


@pytest.mark.parametrize(("candidate", "blocks"), [("M2_product_stream", 1), ("M5_product_time", 3)])
def test_replicates_equal_refits_on_copied_rows(spark, candidate, blocks):
    rows, df = audit_table(spark)
    policy = Policy(nominal=50, lower_limit=47.5, alpha=0.05, maximum_shift=5.0)
    draws = bootstrap.bootstrap_draws(df, 7, 5, mode="compatible").cache()
    chosen = models.candidate_table(spark).filter(F.col("candidate_id") == candidate).crossJoin(df.select("scope").distinct()).select("scope", "candidate_id", "terms")
    got = {(r.scope, r.replicate, r.protocol_id): r.value for r in bootstrap.bootstrap_parametric(df, models.cell_statistics(df), draws, chosen, policy, blocks=blocks).collect()}
    w = {}
    for r in draws.collect():
        w.setdefault((r.scope, r.replicate), {})[r.group_token] = r.w
    terms = V.CANDIDATES[candidate]
    assert len(got) == 28
    for (scope, replicate), drawn in w.items():
        parts = held_out_predictions(rows, scope, terms, drawn)
        for protocol, student in ((V.H2, False), (V.H3, True)):
            want = solved(*parts, policy, student)
            assert (got[scope, replicate, protocol] is None) == (want is None)
            assert want is None or got[scope, replicate, protocol] == pytest.approx(want, abs=2e-8)


def test_point_tails_equal_the_fits_on_one_histogram(spark):
    rng = np.random.default_rng(3)
    policy = Policy(nominal=12, lower_limit=9, alpha=0.05, maximum_shift=4.0)
    rows = []
    for scope, e in (("t", 0.5 * rng.standard_t(5, 3000)), ("skew", rng.gamma(3, 0.4, 2000)), ("flat", np.zeros(100)), ("normal", rng.normal(0, 0.5, 2000)), ("low", rng.normal(-2, 1, 500)), ("far", rng.normal(0, 0.1, 500))):
        at = 20 if scope == "far" else 11
        rows += [(scope, f"g{i % 5}", "M0_intercept", 0, float(at + 0.1 * (i % 3) + v), 1, at + 0.1 * (i % 3)) for i, v in enumerate(e)]
    df = spark.createDataFrame(rows, "scope string, group_token string, candidate_id string, ordinal int, y double, k int, yhat double")
    with many_parts(spark, 6):
        samples = tails.point_samples(df).cache()
        got = {s: {r.scope: r for r in tails.tail_headroom(samples, policy.lower_limit, policy.alpha, policy.maximum_shift, s).collect()} for s in (False, True)}
    for scope in ("t", "skew", "normal", "low", "far"):
        e, pred = (np.array([f(r) for r in rows if r[0] == scope]) for f in (lambda r: r[4] - r[6], lambda r: r[6]))
        for student in (False, True):
            want, r = solved(e, pred, np.ones(len(e)), policy, student), got[student][scope]
            assert (r.failure_code is None) == (want is not None), (scope, student, r)
            assert want is None or r.headroom == pytest.approx(want, abs=2e-9), (scope, student)
            if student and want is not None:
                _, df_, where, scale = special.fit_student(e, np.ones(len(e)), 2.1, 100.0, 1e-3)
                assert (r.df, r.location, r.scale) == (pytest.approx(df_, rel=1e-6), pytest.approx(where, abs=1e-8), pytest.approx(scale, rel=1e-8))
    assert not got[False]["low"].feasible and got[False]["far"].censored and got[False]["far"].headroom == 4.0
    assert {got[s]["flat"].failure_code for s in (False, True)} == {"PARAMETRIC_DEGENERATE_SCALE"}


def test_condensed_values_are_bounded_and_give_the_same_tails(spark):
    """Twice the rows do not make twice the values; a fit much narrower than the values' spread is told."""
    rng = np.random.default_rng(8)
    policy = Policy(nominal=12, lower_limit=9, alpha=0.05, maximum_shift=4.0)
    held, found = [], []
    for n in (6000, 12000):
        e = 0.5 * rng.standard_t(4, n)
        df = spark.createDataFrame([("s", f"g{i % 3}", "M0_intercept", 0, float(12 + 0.1 * (i % 3) + v), 1, 12 + 0.1 * (i % 3)) for i, v in enumerate(e.tolist())], "scope string, group_token string, candidate_id string, ordinal int, y double, k int, yhat double")
        few, every = (tails.point_samples(df, f).cache() for f in (tails.condensed, tails.whole))
        held.append(few.agg(F.sum(F.size("y"))).first()[0])
        assert few.select(F.sum(F.aggregate("n", F.lit(0.0), lambda a, x: a + x))).first()[0] == pytest.approx(n)
        exact = lambda keys, df=df: tails.point_samples(df.join(keys, ["scope", "candidate_id"], "left_semi"), tails.whole)
        for student in (True,) if n == 6000 else ():
            a, b = (tails.tail_headroom(x, policy.lower_limit, policy.alpha, policy.maximum_shift, student, exact=f).first() for x, f in ((few, exact), (every, None)))
            found.append((student, a.failure_code, b.failure_code))
            assert a.failure_code == b.failure_code, found
            if b.failure_code is None:
                assert (a.headroom, a.location, a.scale) == tuple(pytest.approx(x, rel=1e-9, abs=1e-9) for x in (b.headroom, b.location, b.scale))
    assert held[1] < 1.5 * held[0] < 3000
    fit = lambda scale: few.select(*tails.KEYS).distinct().select(*tails.KEYS, *[F.array(F.lit(v)).alias(c) for c, v in (("location", 0.0), ("scale", scale), ("df", 4.0))])
    assert tails._too_wide(few, fit(0.5)).isEmpty() and tails._too_wide(few, fit(0.005)).count() == 1 and tails._too_wide(every, fit(0.005)).isEmpty()


def test_places_by_range_parts_equal_row_numbers(spark):
    from pyspark.sql import Window

    from plumbline.plans import audit_queries as q

    d = "/root/testdata/sf0.001"
    flag = F.substring("o_orderpriority", 1, 1) == "5"
    stream = Window.partitionBy(*q.LOG_SCOPE, "l_linestatus")
    i, n = F.row_number().over(stream.orderBy(F.col("log_price").asc_nulls_first(), *q._ORDER)) - 1, F.count("*").over(stream)
    place = F.when(flag, F.row_number().over(stream.orderBy(*q._ORDER))).otherwise(F.when(i < F.floor(n / 2), 2 * i).otherwise(2 * (n - 1 - i) + 1))
    shown = lambda df: sorted(map(str, df.select(*q.LOG_SCOPE, "l_linestatus", "batch", "log_price", F.unix_seconds("at").alias("at")).collect()))
    with many_parts(spark, 7):
        assert shown(q.log_source(spark, d)) == shown(q.log_values(spark, d).withColumn("at", F.timestamp_seconds(60 * place)))


def test_degenerate_replicates_do_not_depend_on_student(spark):
    """One rule for the scale of a replicate, whether Student's tail is asked for or not."""
    rows = [("ALL", f"g{i % 9}", 10.0 + (1e-9 if i % 2 else 0.0) * (i % 5), "p", "s", "d", 0.0) for i in range(180)]
    df = spark.createDataFrame(rows, "scope string, group_token string, y double, product string, stream string, shift string, time_h double")
    df = df.crossJoin(df.agg(F.avg("y").alias("y_centre"), F.avg("time_h").alias("t_centre")))
    policy = Policy(nominal=10, lower_limit=9.9, alpha=0.05, maximum_shift=1.0)
    draws = bootstrap.bootstrap_draws(df, 6, 1).cache()
    chosen = models.candidate_table(spark).filter("candidate_id = 'M0_intercept'").select(F.lit("ALL").alias("scope"), "candidate_id", "terms")
    both = [{r.replicate: r.value for r in bootstrap.bootstrap_parametric(df, models.cell_statistics(df), draws, chosen, policy, student=s).collect() if r.protocol_id == V.H2} for s in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 6 and None not in both[0].values()


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_binned_rank_equals_sorted_copies(spark, kind):
    rng = random.Random(kind)
    value = {"spread": lambda: round(rng.gauss(20, 5), 4), "ties": lambda: float(rng.randint(3, 6)), "few": lambda: rng.choice([0.5, 100.0])}[kind]
    rows = [("AB"[i % 3 == 0], f"g{rng.randint(0, 10) ** 2 // 12}", value()) for i in range(4000)]
    df = spark.createDataFrame(rows, "scope string, group_token string, y double")
    policy = Policy(nominal=20, lower_limit=2.0, alpha=0.07)
    draws = bootstrap.bootstrap_draws(df, 40, 5).cache()
    with many_parts(spark, 6):
        got = {(r.scope, r.replicate): r.value for r in bootstrap.bootstrap_h1(df, draws, policy).collect()}
    w = {}
    for r in draws.collect():
        w.setdefault((r.scope, r.replicate), []).extend([r.group_token] * r.w)
    y = {}
    for s, g, v in rows:
        y.setdefault((s, g), []).append(v - 2.0)
    assert len(got) == 80
    for key, tokens in w.items():
        m = sorted(v for t in tokens for v in y[key[0], t])
        k = int(0.07 * len(m) + 1e-9)
        want = None if sum(v < 0 for v in m) > k or len(tokens) < 4 else max(0.0, m[k])
        assert got[key] == (pytest.approx(want) if want is not None else None)


def plans(monkeypatch, module):
    """The plans of the tables that ``module`` writes, by name."""
    seen, write = {}, module.written
    monkeypatch.setattr(module, "written", lambda df, name, *a, **k: (seen.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()), write(df, name, *a, **k))[1])
    return seen


def test_plain_numbers_do_not_go_through_text(spark, monkeypatch):
    values = [0.1, -0.0, 5e-324, 1.7976931348623157e308, 1e22, float("nan"), float("inf"), -float("inf"), None, 3.0]
    longs = [2**53 + 1, -(2**63), 2**63 - 1, 0, None, 7, 8, 9, 10, 2**62 + 257]
    df = spark.createDataFrame(list(zip(values, longs)), "x double, i bigint")
    for name, kind in (("x", "double"), ("i", "bigint")):
        assert all(r.a == r.b for r in df.select(prepare.number(name).alias("a"), prepare.number(name, kind).alias("b")).collect())
    roles = prepare.Roles("x", ("i",))
    seen = plans(monkeypatch, prepare)
    rows, scopes = prepare.prepare(df.filter((F.abs("x") < float("inf")) & F.col("i").isNotNull()), roles)
    assert "RLIKE" not in seen["narrow"] and rows.count() == 5
    text = spark.createDataFrame([("1.5", "a"), ("x", "a")], "x string, i string")
    assert prepare.prepare(text, roles)[1].first().bad_quantities == 1 and "RLIKE" in seen["narrow"]


def test_margins_are_dealt_by_compiled_steps(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("A", f"g{i % 7}", float(rng.randint(0, 300))) for i in range(3000)]
    df = spark.createDataFrame(rows, "scope string, group_token string, y double")
    seen = plans(monkeypatch, bootstrap)
    assert bootstrap.bootstrap_h1(df, bootstrap.bootstrap_draws(df, 20, 5), Policy(nominal=20, lower_limit=2.0, alpha=0.07)).count() == 20
    assert not any("lambdafunction" in seen[name] for name in ("bins", "counts", "fine"))
    # the second pass over the rows leaves out what lies beyond the bins hit before it deals the rest
    assert "low" in seen["span"] and "high" in seen["counts"]
    cuts = sorted(rng.choice(range(50)) + 0.0 for _ in range(127))
    margins = [-1.0, 0.0, 49.0, 50.0, *(rng.uniform(-1, 51) for _ in range(50)), *map(float, range(50))]
    got = bootstrap._dealt(spark.createDataFrame([(m, cuts) for m in margins], "margin double, cuts array<double>"), "bin", 7).collect()
    assert [r.bin for r in got] == [sum(c < r.margin for c in cuts) for r in got]


def test_quantiles_are_not_kept_for_each_group(spark, monkeypatch):
    """200 groups in each of two scopes: more keys than an aggregation of objects holds before it sorts its rows."""
    rows = [("AB"[i % 2], f"g{i // 2 % 200}" if i % 11 else None, float(i * 37 % 1009)) for i in range(6000)]
    df = spark.createDataFrame(rows, "scope string, group_token string, y double")
    seen = plans(monkeypatch, headroom)
    got = {r.scope: r for r in headroom.empirical_headroom(df, Policy(nominal=20, lower_limit=2.0, alpha=0.07)).collect()}
    quantiles = [line for line in seen["brackets"].splitlines() if "percentile" in line and "Aggregate" in line]
    assert quantiles and not any("group_token" in line for line in quantiles)
    for scope, r in got.items():
        m = sorted(y - 2.0 for s, _, y in rows if s == scope)
        assert (r.n_rows, r.n_groups, r.k, r.raw_boundary) == (3000, len({g for s, g, _ in rows if s == scope and g}), 210, m[210])
        assert r.baseline_underfills == sum(x < 0 for x in m)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_rank_brackets_are_exact_at_any_accuracy(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [(s, f"g{i % 7}", round(rng.gauss(10, 2), d)) for s, d in (("fine", 6), ("ties", 0)) for i in range(3000)] + [("same", f"g{i % 7}", 4.0) for i in range(500)]
    df = spark.createDataFrame(rows, "scope string, group_token string, y double")
    got = {r.scope: r for r in headroom.empirical_headroom(df, Policy(nominal=10, lower_limit=2.0, alpha=0.07), accuracy).collect()}
    for scope in ("fine", "ties", "same"):
        m = sorted(y - 2.0 for s, _, y in rows if s == scope)
        k = len(m) * 7 // 100
        r = got[scope]
        assert (r.k, r.raw_boundary, r.tie_multiplicity, r.underfills_at_boundary) == (k, m[k], m.count(m[k]), sum(v < m[k] for v in m))


def test_one_sessions_tables_outlive_anothers_end(spark):
    from plumbline.session import drop_written, written

    drop_written(spark)
    other = spark.newSession()
    mine, theirs = written(spark.range(3), "mine"), written(other.range(4), "theirs")
    assert drop_written(other) == 1 and mine.count() == 3 and drop_written(spark) == 1
    with pytest.raises(Exception, match="(?i)exist|FileNotFound"):
        theirs.collect()


def test_many_groups_block_neither_readiness_nor_audit(spark):
    from plumbline.operators import readiness
    from plumbline.operators.prepare import Roles

    df = spark.createDataFrame([(float(i % 9), f"b{i // 3}") for i in range(1500)], "q double, b string")
    found = {(r.code, r.severity) for r in readiness.support_issues(df, Roles("q", ("b",)), Policy(nominal=5, lower_limit=0)).collect()}
    assert found == set()


@pytest.mark.parametrize("most", [3, 40, 10**6])
def test_medians_by_rounds_equal_sorted_values(spark, most):
    rng = random.Random(most)
    columns = [[rng.gauss(0, 1) for _ in range(801)], [rng.choice([-1e300, 1e-300, 5.0, 1e300]) for _ in range(400)], [7.0], [1.0, 2.0], [float(rng.randint(0, 50)) for _ in range(2000)], [3.0] * 500]
    rows = [(i, x, 1) for i, c in enumerate(columns) for x in c[: len(c) // 2]] + [(i, x, k) for i, c in enumerate(columns) for x, k in collections.Counter(c[len(c) // 2 :]).items()]
    df = spark.createDataFrame(rows, "position int, x double, n long")
    with many_parts(spark, 4):
        got = {r.position: r.x_median for r in profile.weighted_medians(df, most).collect()}
    assert got == {i: statistics.median(c) for i, c in enumerate(columns)}
    assert profile.weighted_medians(df.limit(0)).count() == 0

# --- strict CSV in parts -----------------------------------------------------------------------------


def _cell(rng):
    kind = rng.random()
    if kind < 0.4:
        return str(rng.randrange(1000))
    return "".join(rng.choice(['"', ",", "\n", "\r\n", "a", "é", " b", "", 'x"y']) for _ in range(rng.randrange(8)))


@contextlib.contextmanager
def small_splits(spark, size):
    """A file of a few kilobytes is read by many tasks."""
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 1, "spark.sql.files.minPartitionNum": 64}
    kept = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_parts_equals_one_reader(spark, tmp_path, end):
    rng = random.Random(len(end))
    rows = [[_cell(rng) for _ in range(3)] + [str(i)] for i in range(400)]
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["a", "b c", "d", "i"])
    for i, row in enumerate(rows):
        if i % 50 == 9:  # a value without quotes around it that holds one
            row[1] = f'in"ches {i}'
            out.write(f"1,{row[1]},2,{i}{end}")
            row[0], row[2] = "1", "2"
        else:
            writer.writerow(row)
    text = "﻿" + out.getvalue()
    (tmp_path / "t.csv").write_bytes(text.encode())
    assert [r[3] for r in list(csv.reader(io.StringIO(text, newline=""), strict=True))[1:]] == [str(i) for i in range(400)]
    for size in (100, 1000, 1 << 20):
        with small_splits(spark, size):
            df = measurements.read_measurements(spark, str(tmp_path / "t.csv"))
            assert df.columns == ["a", "b c", "d", "i"]
            got = {r[3]: tuple(r) for r in df.collect()}
            assert df.count() == 400
        assert got == {r[3]: tuple(x.strip(" ") for x in r) for r in rows}


@pytest.mark.parametrize(
    "text", ['a,b\n1,2,3\n', 'a,b\n1\n', 'a,b\n"x"y,2\n', 'a,b\n1,"open\n2,3\n4,5\n', 'a,b\n""x,2\n', "a,b\n1\r2,3\n", "\na,b\n1,2\n", 'a,b\n1,"b,"c"\n2,"d"\n']
)
def test_csv_errors_in_parts(spark, tmp_path, text):
    (tmp_path / "bad.csv").write_bytes(text.encode())
    for size in (4, 1 << 20):
        with small_splits(spark, size), pytest.raises(Exception, match="does not match|does not end"):
            measurements.read_measurements(spark, str(tmp_path / "bad.csv")).select("b").collect()


def test_csv_of_several_files_bytes_and_long_records(spark, tmp_path, monkeypatch):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.csv").write_text('a,b\n1,"x\ny"\n\n')
    (tmp_path / "m" / "2.csv").write_text("a,b\n2,z\n")
    read = lambda at: measurements.read_measurements(spark, str(tmp_path / at))
    assert sorted(tuple(r) for r in read("m").collect()) == [("1", "x\ny"), ("2", "z")]
    assert read("m").count() == 2
    (tmp_path / "m" / "3.csv").write_text("a,c\n2,z\n")
    with pytest.raises(Exception, match="does not match"):
        read("m").count()
    (tmp_path / "u.csv").write_bytes(b"a,b\n1,\xff\n")
    with pytest.raises(Exception, match="does not match"):
        read("u.csv").collect()
    monkeypatch.setattr(measurements, "LONGEST_RECORD", 10)
    (tmp_path / "long.csv").write_text('a,b\n1,"' + "x\n" * 20 + '"\n')
    with pytest.raises(Exception, match="does not end"):
        read("long.csv").collect()
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert read("empty.csv").collect() == []


# --- lineage -----------------------------------------------------------------------------------------


def brute_lineage(links):
    """Levels by peeling, and all pairs of node and ancestor."""
    up = collections.defaultdict(set)
    for c, p in links:
        up[c].add(p)
    nodes = {x for link in links for x in link}
    levels, left = {}, set(nodes)
    while free := [n for n in left if all(p in levels for p in up[n])]:
        levels |= {n: 1 + max((levels[p] for p in up[n]), default=-1) for n in free}
        left -= set(free)
    pairs = set()
    for n in nodes:
        todo, seen = list(up[n]), set()
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += up[p]
        pairs |= {(n, p) for p in seen}
    return {n: levels.get(n) for n in nodes}, pairs


@pytest.mark.parametrize("seed", range(4))
def test_lineage_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 40
    links = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range([45, 70, 30, 60][seed])) if a > b or (seed % 2 and rng.random() < 0.08)]
    links += [links[0]] + [(f"d{2 * i + k}", f"d{2 * i - 1 - j}") for i in range(1, 7) for k in (0, 1) for j in (0, 1)]  # a repeated link; layers of two
    df = spark.createDataFrame([*links, (None, "n1"), ("n1", None)], "child string, parent string")
    levels, pairs = brute_lineage(links)
    assert {r.node: r.level for r in evidence.topo_levels(df).collect()} == levels
    assert sorted(tuple(r) for r in evidence.ancestors(df).collect()) == sorted(pairs)
    some = rng.sample(sorted(levels), 3)
    given = spark.createDataFrame([(x,) for x in [*some, some[0], "nowhere", None]], "node string")
    assert sorted(r.node for r in evidence.ancestors_of(df, given).collect()) == sorted({p for c, p in pairs if c in some})


def test_lineage_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, writes = 10_000, []
    kept = evidence.written
    monkeypatch.setattr(evidence, "written", lambda df, name: (writes.append(name), kept(df, name))[1])
    chain = spark.range(1, n).select(F.col("id").cast("string").alias("child"), (F.col("id") - 1).cast("string").alias("parent"))
    loop = spark.createDataFrame([("l0", "l1"), ("l1", "l2"), ("l2", "l0"), ("behind", "l0")], "child string, parent string")
    levels = evidence.topo_levels(chain.unionByName(loop))
    got = levels.agg(F.count_if(F.col("level") == F.col("node").cast("int")), F.count_if(F.col("level").isNull())).first()
    assert tuple(got) == (n, 4) and len(writes) < 25
    writes.clear()
    above = evidence.ancestors_of(chain, spark.createDataFrame([(str(n - 1),), ("50",)], "node string"))
    assert above.count() == n - 1 and above.distinct().count() == n - 1 and writes.count("reached") < 20


def test_lineage_of_nothing(spark):
    df = spark.createDataFrame([], "child string, parent string")
    assert evidence.topo_levels(df).collect() == evidence.ancestors(df).collect() == evidence.ancestors_of(df, spark.createDataFrame([], "node string")).collect() == []


# --- findings, views and result tables ---------------------------------------------------------------


def test_findings_cite_exactly_what_their_facts_rest_on(spark):
    facts = spark.createDataFrame([("gate.a", ["e1", "e2"]), ("gate.b", ["e2"]), ("gate.c", [])], "fact_key string, evidence_ids array<string>")
    known = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "evidence_id string")
    findings = [(1, 1, "FND-001", ["e2", "e1", "e1"], ["gate.a", "gate.b"]), (1, 2, "FND-002", ["e1", "e3"], ["gate.b"]), (1, 3, "FND-003", None, ["gate.c"]), (2, 1, None, ["e9"], ["gate.z", None])]
    df = spark.createDataFrame(findings, "doc_id int, position int, finding_id string, evidence_ids array<string>, fact_keys array<string>")
    assert sorted(tuple(r) for r in claims.check_findings(df, facts, known).collect() if r.item) == [
        (1, 2, "extraneous_evidence", "e1"), (1, 2, "extraneous_evidence", "e3"), (1, 2, "missing_evidence", "e2"), (2, 1, "extraneous_evidence", "e9"), (2, 1, "unknown_evidence", "e9"), (2, 1, "unknown_fact", "gate.z"),
    ]
    assert [tuple(r) for r in claims.check_findings(df, facts, known).filter("item IS NULL").collect()] == [(2, 1, "id_out_of_order", None)]


def test_units_conflicts_and_manifest(spark, tmp_path):
    texts = spark.createDataFrame([(1, "5 mL, 3kg g L"), (2, "xkg gL"), (3, None), (4, "µL")], "doc_id int, text string")
    got = claims.ungrounded_units(texts, spark.createDataFrame([("mL",)], "unit string")).collect()
    assert sorted((r.doc_id, r.cited) for r in got) == [(1, "L"), (1, "g"), (1, "kg"), (4, "µL")]
    decided = spark.createDataFrame([("a", "diagnose_process_first", True), ("b", "pilot_only_conservative", True), ("c", "pilot_range_supported", False)], "scope string, state string, material_protocol_conflict boolean")
    assert {r.scope: r.conflict for r in views.conflict_summary(decided).collect()} == {"a": "order_decides", "b": "conservative", "c": "none"}
    manifest = measurements.write_result_tables({"decided": decided.repartition(3), "again": decided.select("state")}, str(tmp_path / "out"))
    rows = {r.table: r for r in manifest.collect()}
    assert rows["decided"].n_rows == 3 and rows["decided"].dataset_id == measurements.table_fingerprint(decided).first().dataset_id
    assert rows["again"].columns == "state" and "not a production setpoint" in rows["again"].claim_boundary
    with pytest.raises(ValueError):
        measurements.write_result_tables({"manifest": decided}, str(tmp_path / "other"))
