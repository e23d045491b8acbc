"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is normalised, cut where a hash of the last few words says so, and from then on stands for
itself as the ordered list of its chunks' identifiers: long texts are read once and never
shuffled.  A cut depends on nothing but the words before it, so two texts that share a passage
share its chunks, wherever it stands.  Identifiers are 64-bit hashes that are verified against a second, 256-bit digest
over all chunks; a 64-bit value that two different chunks share is extended by that digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.plans.durable import ROW, durable, row_numbers

#: Runs of ASCII white space, which count as one space.
SPACE = r"[\x20\x09-\x0D]+"
#: Of texts of which most characters take three bytes or more, single characters are hashed where scripts have no spaces, and words of all others.
WIDE = 2.2
SCRIPTS = r"\p{IsIdeographic}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNIT = rf"(?s)[{SCRIPTS}]|[^ {SCRIPTS}]+ ?| "
#: Units that the rolling hash sees, and units per chunk on average.
SEEN, MEAN = 3, 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(text: Column, mean: int = MEAN) -> Column:
    """The content-defined pieces of ``text`` (normalised), in order; their concatenation is ``text``."""

    def cut(units: Column, glue: str) -> Column:
        n = F.size(units)
        ends_here = lambda i: F.pmod(F.xxhash64(*[F.get(units, i - k) for k in range(1, SEEN + 1)]), F.lit(mean)) == 0
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ends_here(i))

        def piece(a: Column, b: Column) -> Column:
            words = F.array_join(F.slice(units, a + 1, b - a), glue)
            return F.concat(words, F.when(b < n, glue).otherwise("")) if glue else words

        def pieces(ends: Column) -> Column:
            return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1)), ends, piece)

        return bound(ends, pieces)

    wide = F.octet_length(text) >= WIDE * F.length(text)
    by_word = bound(F.split(text, " "), lambda u: cut(u, " "))
    by_character = bound(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: cut(u, ""))
    found = F.when(F.length(text) == 0, F.array().cast("array<string>")).when(wide, by_character).otherwise(by_word)
    return F.filter(found, lambda c: c != "")


def verified_recipes(parts: DataFrame) -> DataFrame:
    """Adds ``recipe``: the chunk identifiers of ``parts.ids`` (an array of h, v), verified.

    ``h`` alone identifies a chunk unless another chunk with a different digest ``v`` has
    the same ``h``; then, and only then, ``v`` is kept beside it.
    """
    each = parts.select(ROW, F.explode("ids").alias("c")).select(ROW, "c.h", "c.v")
    dictionary = each.groupBy("h").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    shared = dictionary.filter("lo <> hi").select("h")
    bad = each.join(shared, "h", "left_semi").groupBy(ROW).agg(F.collect_set("h").alias("bad"))
    none = F.lit("").cast("binary")
    recipe = F.transform(
        "ids",
        lambda c: F.struct(
            c["h"].alias("h"),
            F.when(F.array_contains(F.coalesce("bad", F.array().cast("array<bigint>")), c["h"]), c["v"]).otherwise(none).alias("v"),
        ),
    )
    return parts.join(bad, ROW, "left").withColumn("recipe", recipe).drop("bad", "ids")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, with_digest: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and ``__gw_row`` (``row_col``, or a number made for the row);
    text_sha256 of the normalised text too, if wanted.

    Texts are equal if they are identical after each run of ASCII white space became one
    space; a null text counts as empty, and all empty texts form one group.  Of equal texts
    the row with the smallest id stays, a null id comes last, and of rows that repeat that
    id exactly one stays.  Very long texts are cut into as many chunks as they need; a word is never cut.  An
    empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    norm = docs.select(
        F.col(id_col).alias("id"),
        row_numbers(row_col),
        normalised(F.col(text_col)).alias("t"),
    )
    ids = F.transform(chunks(F.col("t")), lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("v")))
    sha = F.sha2("t", 256) if with_digest else F.lit(None).cast("string")
    parts = durable(norm.select("id", ROW, sha.alias("sha"), ids.alias("ids")), "recipes")
    rows = verified_recipes(parts).withColumn("key", F.xxhash64("recipe"))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col(ROW).alias("row"))
    groups = rows.groupBy("key", "recipe").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    out = rows.join(groups, ["key", "recipe"])
    digest = [F.col("sha").alias("text_sha256")] if with_digest else []
    return out.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col(ROW) == F.col("first.row")).alias("kept"),
        *digest,
        ROW,
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
