"""Cross-site boilerplate lines (operator 2), DataFrame functions only.

A line is boilerplate if it stands in documents of at least ``MIN_SITES`` distinct sources. Each
line's sources go into a HyperLogLog sketch that merges by aggregation; lines whose estimate lies
near the threshold get an exact distinct count, all others are decided by the sketch. Lines are
compared by the MD5 digest of the trimmed line; blank lines are never boilerplate.

One line may stand in a third of all documents. Counts and sketches merge before any shuffle, and rows
meet the keys by ``join_by_key``: the lines that hold more than 1/10000 of all rows by broadcast, the
others by a shuffle.

Defined results: a null text has no lines and stays null; a null source counts as no site; repeated
rows are each rewritten; a document made of boilerplate alone keeps its row with an empty text; an
empty table gives no rows; other columns pass through, but two of the names of ``counts`` make way for
the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import free_names
from plumbline.llm.hot_keys import HOT, join_by_key
from plumbline.session import written

MIN_SITES = 8
LG_K = 12  # relative standard error 1.04 / sqrt(2**12) = 1.6 %
NEAR = 0.1  # six standard errors


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def line_sites(docs: DataFrame) -> DataFrame:
    """(key, source): one row for each distinct line of a document that is not blank."""
    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))
    return docs.select("source", F.explode(F.filter(lines, lambda x: F.length(x) > 0)).alias("line")).select(line_key(F.col("line")).alias("key"), "source")


def boilerplate_keys(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, hot: int = HOT) -> DataFrame:
    """(key, n): the lines that at least ``min_sites`` sources share, and the documents that hold them."""
    margin = max(1.0, NEAR * min_sites)
    sites = line_sites(docs)
    sketched = sites.groupBy("key").agg(F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(lg_k))).alias("sites"))
    spread = written(sketched.filter(F.col("sites") >= min_sites - margin), "spread")
    sure = spread.filter(F.col("sites") > min_sites + margin).select("key", "n")
    near = spread.filter(F.col("sites") <= min_sites + margin).select("key", "n")
    counted = join_by_key(sites, near, ["key"], "n", hot=hot).distinct()  # a row per line and source
    exact = counted.groupBy("key", "n").agg(F.count("source").alias("sites")).filter(F.col("sites") >= min_sites)
    return written(sure.unionByName(exact.select("key", "n")), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, counts: tuple[str, str] = ("n_lines", "n_removed"), hot: int = HOT) -> DataFrame:
    """The documents with boilerplate lines taken out of ``text``; adds the numbers of lines and of lines
    removed under the names of ``counts``."""
    n_lines, n_removed = counts
    doc, gone, kept = free_names([*docs.columns, *counts], "doc", "gone", "kept")
    bad = boilerplate_keys(docs, min_sites, lg_k, hot)
    keyed = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), line_key))).alias("key"))
    per_doc = join_by_key(keyed, bad, ["key"], "n", hot=hot).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("key").alias(gone))
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x: ~F.array_contains(F.col(gone), line_key(x)))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col(doc)), "left").drop(doc)
    return (
        joined.withColumn(n_lines, size(lines).cast("long"))
        .withColumn(kept, F.when(F.col(gone).isNull(), lines).otherwise(left))
        .withColumn(n_removed, (F.col(n_lines) - size(kept)).cast("long"))
        .withColumn("text", F.when(F.col(n_removed) > 0, F.array_join(kept, "\n")).otherwise(F.col("text")))
        .drop(gone, kept)
    )


def op2_line_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = remove_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_line_sites": op2_line_sites}
ORACLE_SQL = {
    "op2_line_sites": f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
bad AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE length(trim(line, ' ')) > 0
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON trim(l.line, ' ') = b.line),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id""",
}
