"""Reading measurement tables, fingerprints, and checksum inventories."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
LONGEST_RECORD = 1 << 26  # characters


class BadHeader(ValueError):
    """A header that is not usable; says which column, never what it holds."""


def validate_header(columns: list[str]) -> None:
    """Names are trimmed, 1 to 128 characters, NFKC, without slashes or control characters, and unique
    whatever their case."""
    seen: set[str] = set()
    for i, name in enumerate(columns):
        odd = any(c in "/\\" or unicodedata.category(c).startswith("C") for c in name)
        if name != name.strip() or not 1 <= len(name) <= 128 or unicodedata.normalize("NFKC", name) != name or odd:
            raise BadHeader(f"column {i}: invalid name")
        if name.casefold() in seen:
            raise BadHeader(f"column {i}: repeated name")
        seen.add(name.casefold())


def read_measurements(spark: SparkSession, path: str, format: str = "csv", ordered: bool = True) -> DataFrame:
    """A strict CSV (or a Parquet table) as trimmed strings; rows of another width fail the read.

    Files are cut into parts of any size, also within quoted line breaks (see ``csv_records``). Empty lines
    between records are skipped, a first line that is empty is an error, as are invalid UTF-8, a quoted value that
    goes on after its closing quote or never ends, a carriage return outside quotes other than at a
    line's end, and a file whose header is not the first file's. An unquoted value may hold quotes. Rows come
    in the order of the files, at the price of a sort by range; ``ordered=False`` does without it.
    """
    if format == "parquet":
        df = spark.read.parquet(path)
        validate_header(df.columns)
        return df.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    head = spark.read.options(header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    columns = [c.lstrip("\ufeff").strip() for c in head.columns]
    validate_header(columns)
    schema = ", ".join(f"c{i} string" for i in range(len(columns))) + f", {CORRUPT} string"
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true", "lineSep": "\n", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(columns) + 1))}
    records = csv_records(spark, path).withColumn("parsed", F.from_csv("record", schema, options))
    cells = F.array(*[F.trim(F.coalesce(F.col(f"parsed.c{i}"), F.lit(""))) for i in range(len(columns))])
    alien = (F.col("number") == 1) & (cells != F.array(*[F.lit(c) for c in columns]))
    bad = F.col(f"parsed.{CORRUPT}").isNotNull() | is_irregular(F.col("record")) | alien
    # in the filter, so that no choice of columns escapes the check
    whole = F.when(bad, F.raise_error(F.lit("a row does not match the header")).cast("boolean")).otherwise((F.col("number") > 1) & (F.length("record") > 0))
    rows = records.withColumn("cells", cells).filter(whole)
    rows = rows.orderBy("file", "number") if ordered else rows
    return rows.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(columns)])


def _rest(text: Column) -> Column:
    """What is left of comma and text when complete values are taken from its beginning, one after another.

    Pairs of quotes stand as one character, so that no expression repeats a group.
    """
    pairs = F.regexp_replace(F.regexp_replace(F.concat(F.lit(","), text), "\x01", "?"), '""', "\x01")
    return F.regexp_replace(pairs, r'\G,(?:\x01*+"[^"]*+"(?=,|\z)|\x01*+(?=,|\z)|[^",\x01\r][^,\r]*+(?=,|\z))', "")


def _open(text: Column) -> Column:
    """Does a record that begins so end within quotes? Irregular text does not."""
    return F.when(text.contains('"'), _rest(text).rlike(r'\A,\x01*+"[^"]*+\z')).otherwise(False)


def is_irregular(record: Column) -> Column:
    """Quotes that neither close a value nor stand within an unquoted one, and stray carriage returns."""
    return F.when(record.contains('"') | record.contains("\r"), F.length(_rest(record)) > 0).otherwise(False)


def _states(lines: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Adds ``ends_0`` and ``ends_1``: the state (0 outside, 1 within quotes) after each row if the first row is met
    outside or within quotes, from each row's own ``if_0`` and ``if_1``.

    A row either settles the state, keeps it or turns it: the state is the last settled one, turned as
    often as rows since then say.
    """
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("turns", F.sum(F.when((F.col("if_0") == 1) & (F.col("if_1") == 0), 1).otherwise(0)).over(upto))
    settled = F.last(F.when(F.col("if_0") == F.col("if_1"), F.struct(F.col("if_0").alias("state"), F.col("turns").alias("at"))), ignorenulls=True).over(upto)
    lines = lines.withColumn("settled", settled)
    since = lambda start: F.when(F.col("settled").isNull(), (F.lit(start) + F.col("turns")) % 2).otherwise((F.col("settled.state") + F.col("turns") - F.col("settled.at")) % 2)
    return lines.withColumns({"ends_0": since(0), "ends_1": since(1)}).drop("turns", "settled")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record): the records of CSV files, numbered from 1 in each, line breaks in quotes included.

    Files are read in parts (``spark.sql.files.maxPartitionBytes``). What a part does to the state, outside or
    within quotes, is known for both states that it may be met in; a row per part, put together by windows over
    parts, tells in which it is met. Only records of several lines are then grouped. One longer than
    ``LONGEST_RECORD`` characters is an error before it is put together: a quote was not closed.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    value = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.lit("a row does not match the header: invalid UTF-8")))
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), value.alias("line"))
    part = Window.partitionBy("file", "part").orderBy("id")
    first = (F.col("part") == 0) & (F.row_number().over(part) == 1)
    lines = lines.withColumn("line", F.when(first & F.col("line").startswith("\ufeff"), F.expr("substring(line, 2)")).otherwise(F.col("line")))
    bare = F.regexp_replace("line", r"\r\z", "")
    lines = lines.withColumns({"if_0": _open(bare).cast("int"), "if_1": F.when(F.col("line").contains('"'), _open(F.concat(F.lit('"'), bare))).otherwise(True).cast("int")})
    lines = _states(lines, "id", ["file", "part"])
    met = lambda start: F.coalesce(F.lag(f"ends_{start}").over(part), F.lit(start))
    lines = lines.withColumns({"met_0": met(0), "met_1": met(1)})
    begun = lambda start: F.sum(1 - F.col(f"met_{start}"))
    parts = lines.groupBy("file", "part").agg(
        F.max_by("ends_0", "id").alias("if_0"), F.max_by("ends_1", "id").alias("if_1"), begun(0).alias("begun_0"), begun(1).alias("begun_1")
    )
    parts = _states(parts, "part", ["file"])
    over = Window.partitionBy("file").orderBy("part")
    parts = parts.withColumn("start", F.coalesce(F.lag("ends_0").over(over), F.lit(0)))
    begun_here = F.when(F.col("start") == 0, F.col("begun_0")).otherwise(F.col("begun_1"))
    parts = parts.withColumn("begun", begun_here).withColumn("before", F.sum("begun").over(over) - F.col("begun")).select("file", "part", "start", "before")
    lines = lines.join(parts, ["file", "part"])
    of = lambda name: F.when(F.col("start") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))
    lines = lines.select("file", "part", "id", "line", of("met").alias("met"), of("ends").alias("ends"), "before")
    lines = lines.withColumn("number", F.col("before") + F.sum(1 - F.col("met")).over(part))
    alone = (F.col("met") == 0) & (F.col("ends") == 0)
    single = lines.filter(alone).select("file", "number", F.col("line").alias("record"))
    pieces = lines.filter(~alone).select("file", "number", "part", "id", "line")
    sizes = pieces.groupBy("file", "number").agg(F.sum(F.length("line") + 1).alias("size"))
    fit = F.when(F.col("size") > LONGEST_RECORD, F.raise_error(F.lit("a quoted value does not end"))).otherwise(F.col("line"))
    joined = pieces.join(sizes, ["file", "number"]).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("part", "id", fit.alias("line")))).alias("p"))
    several = joined.select("file", "number", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("record"))
    return single.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, dataset_id) of files as they are."""
    files = spark.read.format("binaryFile").load(path)
    sha = F.sha2("content", 256)
    return files.select("path", sha.alias("sha256"), F.concat(F.lit("dataset-"), F.substring(sha, 1, 16)).alias("dataset_id"))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's values as a JSON array of strings, columns in order of name; null stays null."""
    return F.sha2(F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)])), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: a digest of the multiset of rows, whatever their order and partitioning.

    Sums of 15-digit slices of the row digests and the row count: repeated rows count.
    """
    sums = df.select(row_digest(df).alias("h")).select(*[F.substring("h", 1 + 15 * k, 15).alias(f"p{k}") for k in range(4)])
    parts = [F.coalesce(F.sum(F.conv(f"p{k}", 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    out = sums.agg(F.count("*").alias("n_rows"), *parts)
    text = F.concat_ws("-", F.col("n_rows").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)])
    return out.select("n_rows", F.concat(F.lit("dataset-"), F.substring(F.sha2(text, 256), 1, 16)).alias("dataset_id"))


def checksum_inventory(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sha256) of a table of contents (or of a ``binaryFile`` read); ``repeated`` marks a path
    that stands more than once."""
    return files.groupBy(F.col(path).alias("path")).agg(F.min(F.sha2(F.col(content).cast("binary"), 256)).alias("sha256"), (F.count("*") > 1).alias("repeated"))


def verify_checksums(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): ok, missing, unexpected or hash_mismatch."""
    e, f = expected.select("path", F.col("sha256").alias("expected")), found.select("path", F.col("sha256").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("found") != F.col("expected"), "hash_mismatch").otherwise("ok")
    return e.join(f, "path", "full_outer").select("path", status.alias("status"))


CLAIM_BOUNDARY = "retrospective screening reference; requires a controlled pilot and engineering review; not a production setpoint"


def write_result_tables(tables: dict[str, DataFrame], path: str, partition_by: str = "scope") -> DataFrame:
    """Each table as Parquet under its name, by scope where it has one, and beside them ``manifest``, which is returned:
    (table, n_rows, dataset_id, columns, claim_boundary), as the tables read back.

    Rows of a scope are brought together first, so that a scope has few files; Spark splits a scope that is too large.
    """
    if "manifest" in tables:
        raise ValueError("manifest is the name of the list of tables")
    listed = []
    for name, df in tables.items():
        clustered = partition_by in df.columns
        writer = (df.hint("rebalance", partition_by) if clustered else df).write
        (writer.partitionBy(partition_by) if clustered else writer).parquet(f"{path}/{name}")
        read = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
        listed.append(table_fingerprint(read).select(F.lit(name).alias("table"), "n_rows", "dataset_id", F.lit(",".join(df.columns)).alias("columns"), F.lit(CLAIM_BOUNDARY).alias("claim_boundary")))
    if not listed:
        raise ValueError("no tables")
    manifest = reduce(DataFrame.unionByName, listed)
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return manifest.sparkSession.read.schema(manifest.schema).parquet(f"{path}/manifest")
