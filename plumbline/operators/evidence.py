"""Content-addressed evidence, its verification, and lineage queries.

Evidence rows: evidence_id, component, status, statement, value, unit, parents, payload,
content_sha256. The payload is a JSON object in this library's own canonical form (sorted keys, numbers
as text), so ids are reproducible here and are not meant to equal another writer's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.operators.profile import is_email, is_phone, normalized_name
from plumbline.session import written


def payload(component: Column, statement: Column, status: Column, value: Column, unit: Column, parents: Column) -> Column:
    """Canonical JSON: keys in alphabetical order, every value a string, parents sorted and joined."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    number = F.coalesce(F.round(value.cast("double"), 9).cast("decimal(38,9)").cast("string"), F.lit(""))
    return F.to_json(
        F.struct(
            text(component).alias("component"),
            F.array_join(F.array_sort(F.coalesce(parents, F.array().cast("array<string>"))), ",").alias("parents"),
            text(statement).alias("statement"),
            text(status).alias("status"),
            text(unit).alias("unit"),
            number.alias("value"),
        )
    )


def evidence_id(component: Column, sha: Column) -> Column:
    """EV-<COMPONENT>-<12 hex>."""
    return F.concat(F.lit("EV-"), F.upper(component), F.lit("-"), F.upper(F.substring(sha, 1, 12)))


def make_evidence(facts: DataFrame) -> DataFrame:
    """Evidence rows of (component, statement, status, value, unit, parents)."""
    p = payload(*[F.col(c) for c in ("component", "statement", "status", "value", "unit", "parents")])
    out = facts.withColumn("payload", p).withColumn("content_sha256", F.sha2("payload", 256))
    return out.withColumn("evidence_id", evidence_id(F.col("component"), F.col("content_sha256")))


def verify_evidence(evidence: DataFrame) -> DataFrame:
    """(evidence_id, problem): payloads that do not match, wrong ids, repeated ids, colliding ids. A
    missing checksum or id never matches."""
    p = payload(*[F.col(c) for c in ("component", "statement", "status", "value", "unit", "parents")])
    checked = evidence.withColumn("__sha", F.sha2(p, 256))
    problems = F.array_compact(
        F.array(
            F.when(~F.col("__sha").eqNullSafe(F.col("content_sha256")), F.lit("content_mismatch")),
            F.when(F.col("evidence_id").isNull() | ~evidence_id(F.col("component"), F.col("content_sha256")).eqNullSafe(F.col("evidence_id")), F.lit("id_mismatch")),
        )
    )
    single = checked.select("evidence_id", F.explode(problems).alias("problem"))
    again = evidence.groupBy("evidence_id").agg(F.count("*").alias("n"), F.count_distinct("content_sha256").alias("kinds")).filter(F.col("n") > 1)
    return single.unionByName(again.select("evidence_id", F.when(F.col("kinds") > 1, "id_collision").otherwise("duplicate_id").alias("problem")))


def edges(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.col("evidence_id").alias("child"), F.explode("parents").alias("parent"))


def check_lineage(evidence: DataFrame) -> DataFrame:
    """(evidence_id, problem): duplicate_id, duplicate_parent, self_parent, missing_parent."""
    e = edges(evidence)
    ids = evidence.select("evidence_id")
    repeated = ids.groupBy("evidence_id").count().filter("count > 1").select("evidence_id", F.lit("duplicate_id").alias("problem"))
    twice = evidence.filter(F.size("parents") > F.size(F.array_distinct("parents"))).select("evidence_id", F.lit("duplicate_parent").alias("problem"))
    own = e.filter(F.col("child") == F.col("parent")).select(F.col("child").alias("evidence_id"), F.lit("self_parent").alias("problem"))
    lost = e.join(ids.withColumnRenamed("evidence_id", "parent"), "parent", "left_anti").select(F.col("child").alias("evidence_id"), F.lit("missing_parent").alias("problem"))
    return repeated.unionByName(twice).unionByName(own).unionByName(lost).distinct()


def topo_levels(links: DataFrame) -> DataFrame:
    """(node, level) for a table of (child, parent): 0 for nodes without parents, null for nodes on or
    behind a cycle; else one more than the highest of the parents' levels. Links with a null end are left out.

    Contracts the graph. A link carries the longest way that it stands for; a node without parents gets one to null,
    of length 1. Each round replaces links to nodes with a single link by what that link leads to, adding up
    lengths, and keeps the longest of those between the same two. A chain of n takes log2(n) rounds, as do
    diamonds in a row; no graph takes more rounds than it has levels. The table never grows. A way longer
    than there are nodes runs in a cycle and is followed no further.
    """
    links = links.select("child", "parent").filter("child IS NOT NULL AND parent IS NOT NULL").distinct()
    nodes = links.select(F.col("child").alias("node")).union(links.select("parent")).distinct()
    tops = nodes.join(links.select(F.col("child").alias("node")), "node", "left_anti").select(F.col("node").alias("child"), F.lit(None).cast("string").alias("parent"))
    ways = links.select(F.col("child").cast("string"), F.col("parent").cast("string")).unionByName(tops.withColumn("child", F.col("child").cast("string")))
    ways = written(ways.withColumns({"length": F.lit(1).cast("long"), "moved": F.lit(True)}), "ways")
    most = ways.select("child").distinct().count() + 1
    while not ways.filter("moved").isEmpty():
        single = ways.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("beyond"), F.first("length").alias("further")).filter("n = 1")
        single = single.filter((F.col("further") <= most) & ~F.col("beyond").eqNullSafe(F.col("child"))).select(F.col("child").alias("parent"), "beyond", "further")
        met = F.col("further").isNotNull()
        step = ways.drop("moved").join(single, "parent", "left").select("child", F.when(met, F.col("beyond")).otherwise(F.col("parent")).alias("parent"), (F.col("length") + F.coalesce("further", F.lit(0))).alias("length"), met.alias("moved"))
        ways = written(step.groupBy("child", "parent").agg(F.max("length").alias("length"), F.max("moved").alias("moved")), "ways")
    ends = ways.groupBy("child").agg(F.bool_and(F.col("parent").isNull()).alias("sure"), F.max("length").alias("length"))
    return ends.select(F.col("child").cast(links.schema["child"].dataType).alias("node"), F.when(F.col("sure"), (F.col("length") - 1).cast("int")).alias("level"))


def ancestors(links: DataFrame) -> DataFrame:
    """(node, ancestor) for every path of (child, parent) links; a node on a cycle is its own ancestor.

    Round r joins only the pairs that are exactly 2^(r-1) links apart, by the shortest way, with all pairs known:
    the first half of every new shortest way is among the former, the rest among the latter.
    """
    known = links.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).filter("node IS NOT NULL AND ancestor IS NOT NULL").distinct()
    known, reach = written(known.withColumn("distance", F.lit(1).cast("long")), "closure"), 1
    while True:
        edge = known.filter(F.col("distance") == reach).select("node", F.col("ancestor").alias("via"))
        rest = known.select(F.col("node").alias("via"), "ancestor", "distance")
        far = edge.join(rest, "via").groupBy("node", "ancestor").agg((F.min("distance") + reach).alias("distance"))
        far = written(far.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "further")
        if far.isEmpty():
            return known.select("node", "ancestor")
        known, reach = written(known.unionByName(far), "closure"), 2 * reach


def ancestors_of(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): all that the nodes of ``nodes(node)`` descend from by (child, parent) links, without the closure of
    all others; a given node is among them only if it lies above a given one.

    Jumps of 1, 2, 4, ... links are composed with themselves, and what is reached takes each jump once: a chain
    of n takes log2(n) rounds. Where the jumps of one length would be more than the links themselves (much
    branching), single links are followed from what was reached last instead.
    """
    jumps = links.select(F.col("child").alias("node"), F.col("parent").alias("to")).filter("node IS NOT NULL AND to IS NOT NULL").distinct()
    one = written(jumps, "links")
    most = 2 * one.count()
    reached = written(one.join(nodes.select("node").distinct(), "node", "left_semi").select(F.col("to").alias("node")).distinct(), "reached")
    jumps, doubling, last = one, True, reached
    while True:
        new = (reached if doubling else last).join(jumps, "node").select(F.col("to").alias("node")).distinct()
        new = written(new.join(reached, "node", "left_anti"), "new")
        if new.isEmpty():
            return reached
        reached, last = written(reached.unionByName(new), "reached"), new
        if doubling:
            composed = jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("beyond")), "to").select("node", F.col("beyond").alias("to"))
            composed = written(composed.distinct(), "jumps")
            if composed.count() > most:  # from here on link by link, first from all that is reached
                jumps, doubling, last = one, False, reached
            else:
                jumps = composed


def descendants(links: DataFrame) -> DataFrame:
    """(node, descendant): the same closure, read the other way."""
    return ancestors(links).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"))


def unsafe_content(evidence: DataFrame, column: str = "statement") -> DataFrame:
    """(evidence_id, problem): secrets, local paths, personal cells, control characters."""
    t = F.col(column)
    secret = [F.when(t.rlike(f"(?m{'' if case else 'i'}){pattern}"), F.lit(code)) for code, pattern, case, placeholder in V.TEXT_RULES if not placeholder]
    value = F.trim(t)
    other = [F.when(is_email(value) | is_phone(value), F.lit("PERSONAL_VALUE")), F.when(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit("CONTROL_CHARACTER"))]
    return evidence.select("evidence_id", F.explode(F.array_compact(F.array(*secret, *other))).alias("problem"))


def is_sensitive_key(key: Column) -> Column:
    """Keys that name raw rows, credentials, persons or prompts, however they are written."""
    k = normalized_name(key)
    named = k.isin(V.SENSITIVE_KEYS) | k.rlike("^(?:" + "|".join(V.SENSITIVE_BEGINNINGS) + ")") | k.rlike("(?:" + "|".join(V.SENSITIVE_ENDS) + ")$")
    return named & ~k.isin(V.PERMITTED_KEYS)


def nested_values(evidence: DataFrame, column: str, deepest: int = V.DEEPEST) -> DataFrame:
    """(evidence_id, depth, key_path, key, value, entries): every value at any depth of the JSON in ``column``, and
    ``entries`` of it if it is an object or array. Goes down level by level, each a projection without a
    shuffle, to one level below ``deepest``; text that is no JSON has the depth -1."""
    spark = evidence.sparkSession
    top = evidence.select("evidence_id", F.lit(0).alias("depth"), F.lit("$").alias("key_path"), F.lit(None).cast("string").alias("key"), F.col(column).alias("value"))
    level, out = top, None
    for _ in range(deepest + 2):
        kind = F.schema_of_variant(F.try_parse_json("value"))
        # a value of the levels below is JSON by now
        level = written(level.withColumn("kind", F.coalesce(kind, F.lit("none"))).withColumn("depth", F.when((F.col("kind") == "none") & (F.col("depth") == 0), -1).otherwise(F.col("depth"))), "level")
        below = level.filter(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")).select("evidence_id", "depth", "key_path", F.parse_json("value").alias("v"))
        found = below.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        inside = found.select("evidence_id", (F.col("depth") + 1).alias("depth"), F.concat("key_path", step).alias("key_path"), "key", F.to_json("value").alias("value"))
        sizes = found.groupBy("evidence_id", "key_path").agg(F.count("*").alias("entries"))
        part = level.join(sizes, ["evidence_id", "key_path"], "left")
        out = part if out is None else out.unionByName(part)
        if below.isEmpty():
            break
        level = inside
    return out


def unsafe_nested(evidence: DataFrame, column: str = "payload", deepest: int = V.DEEPEST) -> DataFrame:
    """(evidence_id, key_path, problem): what may not stand in the JSON of ``column`` at any depth: sensitive keys,
    secrets, local paths, personal values and control characters in keys and texts, values that are too long,
    too many or too deep, and text that is no JSON."""
    seen = nested_values(evidence, column, deepest)
    # a text's JSON has quotes and escapes; other scalars hold nothing unsafe
    text = F.when(F.col("kind") == "STRING", F.try_variant_get(F.try_parse_json("value"), "$", "string"))
    seen = seen.withColumn("text", text)

    def unsafe(c: str) -> list[Column]:
        t = F.col(c)
        rules = [F.when(t.rlike(f"(?m{'' if case else 'i'}){pattern}"), F.lit(code)) for code, pattern, case, placeholder in V.TEXT_RULES if not placeholder]
        return [*rules, F.when(is_email(F.trim(t)) | is_phone(F.trim(t)), F.lit("PERSONAL_VALUE")), F.when(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit("CONTROL_CHARACTER"))]

    hits = [
        F.when(F.col("depth") < 0, F.lit("INVALID_JSON")), F.when(F.col("depth") > deepest, F.lit("TOO_DEEP")), F.when(F.col("entries") > V.MOST_ENTRIES, F.lit("TOO_MANY_ENTRIES")),
        F.when(F.length("text") > V.LONGEST_VALUE, F.lit("VALUE_TOO_LONG")), F.when(F.length("key") > V.LONGEST_KEY, F.lit("KEY_TOO_LONG")), F.when(is_sensitive_key(F.col("key")), F.lit("SENSITIVE_KEY")),
        *unsafe("text"), *unsafe("key"),
    ]
    return seen.select("evidence_id", "key_path", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))).alias("problem"))
