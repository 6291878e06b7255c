"""Sharding along a Hilbert curve (operator 1), DataFrame functions only.

Three metadata dimensions are quantised to ``BITS`` bits each, a row's cell gets its index on the
Hilbert curve, rows are range-sorted by that index and the sorted sequence is cut into runs. Rows
that agree in language, source and size class therefore lie in the same or neighbouring shards, and
the per-shard bounds of ``shard_manifest`` let a reader skip shards on any of the dimensions.

Law ``rows``: shard sizes differ by at most one row.

Defined results: a null text has size 8 and the checksum of the empty string; a null language or
source falls into cell 0 of its dimension; equal rows are interchangeable and take neighbouring
slots; an empty table gives no rows; columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import written

BITS = 5
N_SHARDS = 24
OVERHEAD_BYTES = 8


def label_cell(column: Column, bits: int = BITS) -> Column:
    """A label's cell: equal labels share one; null is cell 0."""
    return F.when(column.isNull(), F.lit(0)).otherwise(F.crc32(column.cast("binary")) % (2**bits)).cast("int")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """A size's cell: two per power of two, from 8 bytes up, monotone in the size."""
    length = F.length(F.bin(size))
    second = (size / F.pow(F.lit(2.0), length - 2)).cast("long") % 2
    cell = 2 * (length - 4) + second
    return F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), cell)).cast("int")


def with_hilbert_index(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """Adds the Hilbert index of integer cells (each in [0, 2**bits)) as a long.

    The axes-to-transpose form of the curve: one projection per bit and axis, so that every step
    refers to computed columns instead of nesting copies of its operands.
    """
    x = [f"__h{i}" for i in range(len(dims))]
    df = df.withColumns({name: F.col(dim).cast("long") for name, dim in zip(x, dims)})
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(dims)):
            here, first = F.col(x[i]), F.col(x[0])
            is_set = here.bitwiseAND(1 << b) != 0
            swap = first.bitwiseXOR(here).bitwiseAND(low)
            if i == 0:
                df = df.withColumns({x[0]: F.when(is_set, first.bitwiseXOR(low)).otherwise(first)})
            else:
                df = df.withColumns(
                    {
                        x[0]: F.when(is_set, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap)),
                        x[i]: F.when(is_set, here).otherwise(here.bitwiseXOR(swap)),
                    }
                )
    for i in range(1, len(dims)):
        df = df.withColumns({x[i]: F.col(x[i]).bitwiseXOR(F.col(x[i - 1]))})
    flips = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        flips = flips.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumns({"__flips": flips})
    df = df.withColumns({name: F.col(name).bitwiseXOR(F.col("__flips")) for name in x})
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for name in x:
            index = index * 2 + F.shiftright(F.col(name), b).bitwiseAND(1)
    return df.withColumn(out, index).drop(*x, "__flips")


def cells(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, checksum, the three cells and the Hilbert index; the text itself is not carried on."""
    narrow = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        label_cell(F.col("lang"), bits).alias("lang_cell"),
        label_cell(F.col("source"), bits).alias("source_cell"),
    ).withColumn("size_cell", size_cell(F.col("size"), bits))
    return with_hilbert_index(narrow, ["lang_cell", "source_cell", "size_cell"], bits, "hilbert")


def ranked(df: DataFrame, order: list[str], out: str, count: str) -> DataFrame:
    """Adds each row's place in the total order and the number of rows, without a one-task sort.

    Range partitions are sorted on their own and written once, so that both passes see one division;
    the offsets table has one row per partition.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    spread = written(spread, "ranked").withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1))
    counts = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias(count))
    # one row per range partition: its size is that of the shuffle, not of the data
    return spread.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.col("__row")).drop("__at", "__part", "__row", "__n", "__before")


def shard(docs: DataFrame, n_shards: int = N_SHARDS, bits: int = BITS) -> DataFrame:
    """Every document's shard, slot and cells, by law ``rows`` along the Hilbert curve."""
    placed = ranked(cells(docs, bits), ["hilbert", "doc_id", "text_crc32", "size"], "__pos", "__rows")
    shard_of = F.expr(f"cast((__pos * {n_shards}) div __rows as int)")
    return (
        placed.withColumn("shard", shard_of)
        .withColumn("slot", F.expr(f"__pos - (cast(shard as bigint) * __rows + {n_shards - 1}) div {n_shards}"))
        .withColumn("law", F.lit("rows"))
        .drop("__pos", "__rows")
    )


def shard_manifest(assigned: DataFrame) -> DataFrame:
    """Per shard: rows, bytes and the bounds of every dimension, by which a reader prunes."""
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lang_cell", "source_cell", "size_cell", "hilbert") for n, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *bounds)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(docs).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "lang_cell", "source_cell", "size_cell", "hilbert")


QUERIES = {"op1_hilbert_shards": op1_hilbert_shards}


def _crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes, half a byte at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(f"{c}::BIGINT")
    step = lambda c, b: f"xor(({c}) >> 4, [{', '.join(table)}][(xor({c}, {b}) & 15) + 1])"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step(step('c', 'b'), 'b >> 4')}), 4294967295::BIGINT)"


def _hilbert_sql(source: str) -> str:
    """Common table expressions from ``source`` with lang_cell, source_cell, size_cell on: the cells'
    bits, from the highest to the lowest, undone by the curve's reflections, one table per step."""
    steps, last = [], source
    for b in range(BITS - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(3):
            swap = f"(xor(x0, x{i}) & {low})"
            kept = [f"x{k}" for k in range(3)]
            kept[0] = f"CASE WHEN x{i} & {1 << b} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {swap}) END AS x0"
            if i:
                kept[i] = f"CASE WHEN x{i} & {1 << b} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}"
            steps.append(f"h{b}_{i} AS (SELECT * EXCLUDE (x0, x1, x2), {', '.join(kept)} FROM {last})")
            last = f"h{b}_{i}"
    flips = "0"
    for b in range(BITS - 1, 0, -1):
        flips = f"xor({flips}, CASE WHEN g2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    steps.append(f"gray AS (SELECT *, x0 AS g0, xor(x1, x0) AS g1, xor(x2, xor(x1, x0)) AS g2 FROM {last})")
    steps.append(f"turned AS (SELECT *, {flips} AS f FROM gray)")
    bits = " + ".join(f"((xor(g{i}, f) >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(BITS) for i in range(3))
    steps.append(f"curve AS (SELECT *, CAST({bits} AS BIGINT) AS hilbert FROM turned)")
    return ",\n".join(steps)


_CELL = f"CASE WHEN {{0}} IS NULL THEN 0 ELSE {_crc_sql('{0}')} % {2**BITS} END"
ORACLE_SQL = {
    "op1_hilbert_shards": f"""
WITH label AS (
  SELECT 'lang' AS kind, lang AS v, {_CELL.format("lang")} AS cell FROM (SELECT DISTINCT lang FROM documents)
  UNION ALL SELECT 'source', source, {_CELL.format("source")} FROM (SELECT DISTINCT source FROM documents)),
size AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + {OVERHEAD_BYTES} AS BIGINT) AS size, CAST({_crc_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32, a.cell AS lang_cell, b.cell AS source_cell
  FROM documents d JOIN label a ON a.kind = 'lang' AND a.v IS NOT DISTINCT FROM d.lang JOIN label b ON b.kind = 'source' AND b.v IS NOT DISTINCT FROM d.source),
cells AS (
  SELECT *, lang_cell AS x0, source_cell AS x1, size_cell AS x2
  FROM (SELECT *, greatest(0, least({2**BITS - 1}, 2 * (k - 3) + CASE WHEN size >= (1::BIGINT << k) + (1::BIGINT << (k - 1)) THEN 1 ELSE 0 END)) AS size_cell
        FROM (SELECT *, CAST(floor(log2(size + 0.5)) AS BIGINT) AS k FROM size))),
{_hilbert_sql("cells")},
placed AS (SELECT *, row_number() OVER (ORDER BY hilbert, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM curve),
dealt AS (SELECT *, pos * {N_SHARDS} // n AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard,
       CAST(lang_cell AS INTEGER) AS lang_cell, CAST(source_cell AS INTEGER) AS source_cell, CAST(size_cell AS INTEGER) AS size_cell, hilbert
FROM dealt""",
}
