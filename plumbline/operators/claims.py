"""Checks of texts: secrets and paths, ungrounded numbers and citations, prohibited claims, verdicts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V


def _rule_hit(text: Column, pattern: str, case: bool, placeholder: bool) -> Column:
    flags = f"(?m{'' if case else 'i'})"
    if not placeholder:
        return text.rlike(flags + pattern)
    values = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(1))
    bare = lambda v: F.trim(F.regexp_replace(F.trim(v), r"""\A["']+|["']+\z""", ""))
    real = lambda v: ~F.lower(bare(v)).isin(V.PLACEHOLDERS) & ~bare(v).rlike(rf"(?i)\A(?:{V.PLACEHOLDER_SHAPE})\z")
    return F.exists(values, real)


def _holds(text: Column, code: str) -> Column:
    """Whether a text holds one of a rule's literals."""
    return reduce(or_, [text.contains(x) for x in V.RULE_LITERALS[code]])


def scan_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, code): one finding for each document and rule. No join and no shuffle.

    Two phases: every text is searched for the rules' literals, plain and in lower case, which costs a
    comparison of bytes; only where one stands is its rule's expression tried, and only on the lines that
    hold it, for no rule's match goes over a line feed.
    """
    first = docs.select(key, F.col(text).alias("t")).withColumn("folded", F.lower("t"))
    flags = [_holds(F.col("t" if case else "folded"), code).alias(f"f{k}") for k, (code, _, case, _) in enumerate(V.TEXT_RULES)]
    flagged = first.select(key, "t", *flags)
    # texts without any literal, nearly all, are not split
    lines = flagged.withColumn("lines", F.when(reduce(or_, [F.col(f"f{k}") for k in range(len(flags))]), F.split("t", "\n")))

    def hit(k: int, code: str, pattern: str, case: bool, placeholder: bool) -> Column:
        tried = lambda line: _holds(line if case else F.lower(line), code) & _rule_hit(line, pattern, case, placeholder)
        return F.when(F.col(f"f{k}"), F.when(F.exists("lines", tried), F.lit(code)))

    hits = F.array_compact(F.array(*[hit(k, *rule) for k, rule in enumerate(V.TEXT_RULES)]))
    return lines.select(key, F.explode(F.when(F.col("lines").isNotNull(), hits)).alias("code"))


def scan_content(files: DataFrame, key: str = "doc_id", text: str = "text", most_bytes: int = 10 * 1024 * 1024, blocklist: DataFrame | None = None) -> DataFrame:
    """(key, code): too large, control characters, and known hashes (``blocklist(sha256)``)."""
    t = F.col(text)
    controls = F.regexp_count(t, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    hits = F.array_compact(
        F.array(
            F.when(F.octet_length(t) > most_bytes, F.lit("FILE_TOO_LARGE")),
            F.when(t.contains("\x00") | (controls > F.greatest(F.lit(2), F.floor(F.length(t) / 100))), F.lit("SUSPICIOUS_BINARY_FILE")),
        )
    )
    out = files.select(key, F.explode(hits).alias("code"))
    if blocklist is not None:
        known = files.select(key, F.sha2(t.cast("binary"), 256).alias("sha256")).join(blocklist.select("sha256"), "sha256", "left_semi")
        out = out.unionByName(known.select(key, F.lit("KNOWN_PRIVATE_HASH").alias("code")))
    return out


def numbers_in(text: Column) -> Column:
    """Number tokens of a text, identifiers masked."""
    masked = F.regexp_replace(text, V.MASKED_IDENTIFIERS, "")
    return F.regexp_extract_all(masked, F.lit(V.NUMBERS_IN_TEXT), F.lit(1))


def ungrounded_numbers(texts: DataFrame, facts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token): numbers that no fact carries; equal as decimals, percentages as they are written.

    ``facts(value string)`` may be any size: an anti join on the normal form of the number.
    """
    normal = lambda c: F.when(c.endswith("%"), c).otherwise(c.try_cast("decimal(38,12)").cast("string"))
    tokens = texts.select(key, F.explode(F.array_distinct(numbers_in(F.col(text)))).alias("token")).withColumn("normal", F.coalesce(normal(F.col("token")), F.col("token")))
    allowed = facts.select(F.coalesce(normal(F.col("value")), F.col("value")).alias("normal")).distinct()
    return tokens.join(allowed, "normal", "left_anti").select(key, "token")


def ungrounded_citations(texts: DataFrame, evidence_ids: DataFrame, fact_keys: DataFrame, protocols: list[str], states: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, cited): evidence ids, fact keys, protocol labels and action labels that are not allowed."""
    t = F.col(text)
    every = lambda pattern: F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    kinds = [("evidence", every(V.EVIDENCE_IN_TEXT)), ("fact", every(V.FACT_IN_TEXT)), ("protocol", every(V.PROTOCOL_IN_TEXT))]
    kinds.append(("action", F.array_compact(F.array(*[F.when(t.contains(s), F.lit(s)) for s in V.ACTION_STATES]))))
    cited = texts.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("cited")) for k, c in kinds])).alias("k")).select(key, "k.kind", F.explode("k.cited").alias("cited"))
    allowed = evidence_ids.select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("cited")).unionByName(fact_keys.select(F.lit("fact").alias("kind"), F.col("fact_key").alias("cited")))
    fixed = [("protocol", p) for p in protocols] + [("action", s) for s in states]
    allowed = allowed.unionByName(texts.sparkSession.createDataFrame(fixed, "kind string, cited string"))
    return cited.join(allowed.distinct(), ["kind", "cited"], "left_anti").select(key, "kind", "cited")


def ungrounded_units(texts: DataFrame, units: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, cited): units of measure that stand in a text and not in ``units(unit)``; null texts name none."""
    named = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(V.UNITS_IN_TEXT), F.lit(0)))
    cited = texts.select(key, F.lit("unit").alias("kind"), F.explode(named).alias("cited"))
    return cited.join(units.select(F.col("unit").alias("cited")).distinct(), "cited", "left_anti").select(key, "kind", "cited")


def check_findings(findings: DataFrame, facts: DataFrame, evidence_ids: DataFrame) -> DataFrame:
    """(doc_id, position, problem, item): findings must cite exactly the evidence that their facts rest on.

    ``findings(doc_id, position, finding_id, evidence_ids, fact_keys)``, positions from 1; ``facts(fact_key,
    evidence_ids)``; ``evidence_ids(evidence_id)``. Problems: unknown_fact, unknown_evidence, missing_evidence (a
    fact rests on it), extraneous_evidence (no fact does), id_out_of_order. Null lists are empty, and
    what a list repeats counts once.
    """
    at = ["doc_id", "position"]
    each = lambda c, name: findings.select(*at, F.explode(F.array_distinct(c)).alias(name)).filter(F.col(name).isNotNull())
    cited, keys = each("evidence_ids", "item"), each("fact_keys", "fact_key")
    needed = keys.join(facts.select("fact_key", F.explode("evidence_ids").alias("item")), "fact_key").select(*at, "item").distinct()
    known = evidence_ids.select(F.col("evidence_id").alias("item")).distinct()
    found = {
        "unknown_fact": keys.join(facts.select("fact_key").distinct(), "fact_key", "left_anti").withColumnRenamed("fact_key", "item"),
        "unknown_evidence": cited.join(known, "item", "left_anti"),
        "missing_evidence": needed.join(cited, [*at, "item"], "left_anti"),
        "extraneous_evidence": cited.join(needed, [*at, "item"], "left_anti"),
        "id_out_of_order": findings.filter(~F.col("finding_id").eqNullSafe(F.format_string("FND-%03d", "position"))).select(*at, F.col("finding_id").alias("item")),
    }
    return reduce(DataFrame.unionByName, [t.select(*at, F.lit(problem).alias("problem"), "item") for problem, t in found.items()])


def is_prohibited(text: Column) -> Column:
    """A claim that no evidence here can carry."""
    lowered = F.lower(text)
    return lowered.rlike("|".join(V.PROHIBITED_CLAIMS)) | (lowered.contains("production setpoint") & ~lowered.contains("not a production setpoint"))


def prohibited_sentences(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_prohibited): sentences that make a positive claim without a negation."""
    sentences = F.split(F.lower(F.col(text)), r"[.!?;\n]+")
    has = lambda s, phrases: F.lit(False) if not phrases else s.rlike("|".join(phrases))
    bad = F.filter(sentences, lambda s: has(s, [*V.POSITIVE_PHRASES, "production setpoint"]) & ~has(s, V.NEGATIONS))
    return texts.select(key, F.size(bad).alias("n_prohibited")).filter(F.col("n_prohibited") > 0)


def judge_claims(claims: DataFrame, decisions: DataFrame, integrity: DataFrame | None = None, other_reviews: DataFrame | None = None) -> DataFrame:
    """(doc_id, claim_id, verdict): the first that holds, merged with a second reviewer's by severity.

    ``claims(doc_id, claim_id, claim_text)``, ``decisions(doc_id, state, conflict)``,
    ``integrity(doc_id)``: documents with broken citations or numbers, ``other_reviews(doc_id, claim_id,
    verdict)``.
    """
    c = claims.join(decisions.select("doc_id", "state", "conflict"), "doc_id", "left")
    broken = F.lit(False)
    if integrity is not None:
        c = c.join(integrity.select("doc_id", F.lit(True).alias("broken")).distinct(), "doc_id", "left")
        broken = F.coalesce("broken", F.lit(False))
    t = F.lower("claim_text")
    blocked = F.coalesce(F.col("state").isin(V.ACTION_STATES[:4]), F.lit(False))
    pilot = (t.contains("supports a pilot") | t.contains("pilot interval is supported") | t.contains("proceed with a pilot")) & ~t.contains("no pilot")
    verdict = (
        F.when(broken | is_prohibited(t), "prohibited")
        .when(F.coalesce("conflict", F.lit(False)) & (t.contains("full agreement") | t.contains("protocols agree")), "overstated")
        .when(blocked & pilot, "unsupported")
        .when(t.contains("d0") & (t.contains("action") | t.contains("pilot")), "unsupported")
        .otherwise("supported")
    )
    out = c.select("doc_id", "claim_id", verdict.alias("verdict"))
    if other_reviews is not None:
        rank = lambda v: F.array_position(F.array(*[F.lit(x) for x in V.VERDICTS]), v)
        second = other_reviews.select("doc_id", "claim_id", F.col("verdict").alias("other"))
        out = out.join(second, ["doc_id", "claim_id"], "left").select("doc_id", "claim_id", F.when(rank(F.col("other")) > rank(F.col("verdict")), F.col("other")).otherwise(F.col("verdict")).alias("verdict"))
    return out


def document_status(verdicts: DataFrame) -> DataFrame:
    """(doc_id, status): blocked, revise or pass, by the worst verdict."""
    any_of = lambda *v: F.bool_or(F.col("verdict").isin(*v))
    worst = F.when(any_of("prohibited"), "blocked").when(any_of("unsupported", "overstated", "supported_with_qualification"), "revise").otherwise("pass")
    return verdicts.groupBy("doc_id").agg(worst.alias("status"))


def fact_table(results: DataFrame) -> DataFrame:
    """Facts of (fact_key, raw, unit, evidence_ids): adds ``display``, two decimals and the unit."""
    shown = F.format_string("%.2f", F.col("raw").cast("double"))
    return results.select("fact_key", F.concat_ws(" ", shown, F.when(F.length("unit") > 0, F.col("unit"))).alias("display"), "raw", "unit", "evidence_ids")


def state_semantics(texts: DataFrame, key: str = "doc_id", text: str = "text", state: str = "state") -> DataFrame:
    """(key, missing): texts that lack a phrase, or hold one too many, for their action state."""
    t = F.lower(F.col(text))
    lacks = lambda *phrases: [F.when(~t.contains(p), F.lit(f"lacks: {p}")) for p in phrases]
    holds = lambda *phrases: [F.when(t.contains(p), F.lit(f"holds: {p}")) for p in phrases]
    sentences = F.split(t, r"[.!?;\n]+")
    interval = F.when(F.exists(sentences, lambda s: s.contains("pilot") & s.rlike(V.NUMBERS_IN_TEXT)), F.lit("holds: numeric pilot interval"))
    disagreement = F.when(~(t.contains("protocol disagreement") | t.contains("protocol conflict")), F.lit("lacks: protocol disagreement"))
    rules = {
        "pilot_range_supported": lacks("retrospective screening reference", "controlled pilot", "engineering review", "not a production setpoint"),
        "pilot_only_conservative": [*lacks("conservative", "controlled pilot", "not a production setpoint"), disagreement, *holds("full agreement", "protocols agree", "complete agreement", "unanimous")],
        "diagnose_process_first": [*lacks("no pilot interval", "process diagnosis"), interval],
        "insufficient_evidence": lacks("cannot support an action", "diagnostic headroom"),
        "no_actionable_headroom": lacks("no actionable headroom", "no pilot interval"),
        "invalid_contract": lacks("contract"),
    }
    found = F.array().cast("array<string>")
    for name, checks in rules.items():
        found = F.when(F.col(state) == name, F.array_compact(F.array(*checks))).otherwise(found)
    return texts.select(key, F.explode(found).alias("missing"))


def export_gate(claims: DataFrame) -> DataFrame:
    """(doc_id, exportable, blocking_rules) from claims with doc_id, kind (material, headline or
    supporting), verdict, conditional, qualified, precheck_failed and hides_limitation."""
    heavy = F.col("kind").isin("material", "headline")
    rules = [
        ("prohibited_material_or_headline_claim", heavy & (F.col("verdict") == "prohibited")),
        ("unresolved_unsupported_or_overstated_material_or_headline", heavy & F.col("verdict").isin("unsupported", "overstated")),
        ("conditional_claim_missing_required_qualifier", F.col("conditional") & ~F.col("qualified")),
        ("deterministic_precheck_failure", F.col("precheck_failed")),
        ("supporting_removal_hides_material_limitations", (F.col("kind") == "supporting") & F.col("hides_limitation")),
    ]
    found = claims.groupBy("doc_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"r{i}") for i, (_, c) in enumerate(rules)])
    blocking = F.array_compact(F.array(*[F.when(F.col(f"r{i}"), F.lit(name)) for i, (name, _) in enumerate(rules)]))
    return found.select("doc_id", (F.size(blocking) == 0).alias("exportable"), blocking.alias("blocking_rules"))
