"""Proportional stratified interleaving into shards (DataFrame functions only).

Rows are shuffled by a seeded digest of their id, ranked within their source, and sorted by
the fraction of the source that lies before them; cutting that order into equal runs gives
every shard the mixture of the whole.

Both orders are made by range partitions that are sorted apart: a row's place is its place in
its partition and the sizes of the partitions ahead.  The order is total, so a source, an id or a
group of equal rows with any share of the table is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweir.plans.durable import ROW, durable, row_numbers

SHARDS = 24
SEED = "interleave-1"
#: monotonically_increasing_id() counts the rows of a partition in so many bits, below the partition's number.
PLACE_BITS = 33


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows``, as a durable table, with ``pos``: each row's place from 0 in ``order``, which must be total."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    written = durable(ordered, name)
    part, place = F.shiftright("at", PLACE_BITS), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = written.groupBy(part.alias("part_")).agg(F.count("*").alias("n"))  # one row per partition
    ahead = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part_", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return written.join(offsets, part == F.col("part_")).withColumn("pos", F.col("before") + place).drop("part_", "before", "at")


def interleaved(rows: DataFrame, source: str, tie: list[str]) -> DataFrame:
    """Adds ``pos``, the row's place from 0 in the interleaved order; ``tie`` orders the rows of a source."""
    by_source = F.col(source).asc_nulls_last()
    ranked = placed(rows, [by_source, *map(F.col, tie)], "by-source")
    spans = ranked.groupBy(F.col(source).alias("s_")).agg(F.min("pos").alias("start"), F.count("*").alias("of"))
    ranked = ranked.join(spans, F.col(source).eqNullSafe(F.col("s_"))).drop("s_")
    # (2 rank - 1) / (2 rows of the source), with ranks from 1
    fraction = (2 * (F.col("pos") - F.col("start")) + 1) / (2 * F.col("of"))
    return placed(ranked.withColumn("f", fraction).drop("pos", "start", "of"), [F.col("f"), by_source, *map(F.col, tie)], "interleaved")


def shuffle_key(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, ``__gw_row``.

    The law is ``rows``: shard counts differ by one at most, and slots run from 0 without a
    gap.  Size is the text's UTF-8 bytes plus 8, a null text has none; its checksum is that
    of no bytes.  A null source is a source of its own.  Ties of the shuffle key (repeated
    ids) are broken by the checksum, the size and then the row's place in the input.  With
    fewer rows than shards the later shards stay empty; an empty table gives an empty
    result.  Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("src"),
            row_numbers(row_col),
            (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            shuffle_key(F.col(id_col), seed).alias("key"),
        ),
        "shard-rows",
    )
    total = rows.count()
    ordered = interleaved(rows, "src", ["key", "id", "crc", "size", ROW])
    shard = F.expr(f"cast((pos * {n_shards}) div {max(total, 1)} as int)")
    out = ordered.withColumn("shard", shard)
    first = F.expr(f"(cast(shard as bigint) * {max(total, 1)} + {n_shards - 1}) div {n_shards}")
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("pos") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        ROW,
    )


#: The same by SQL.  DuckDB has no CRC-32, so it is folded over the text's bytes with a table made from the polynomial.
SQL = f"""
WITH RECURSIVE poly AS (
    SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
d AS (SELECT doc_id, source, coalesce(text, '') AS x, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
byte AS (SELECT doc_id, source, x, key, hex(encode(x)) AS h FROM d),
crc AS (SELECT doc_id, source, key, (length(h) // 2 + 8)::BIGINT AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc FROM byte, tab),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, crc, size) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS f FROM crc),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS LAST, key, doc_id, crc, size) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (pos * {SHARDS} // n)::INT AS shard,
    pos - ((pos * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard FROM p
"""
