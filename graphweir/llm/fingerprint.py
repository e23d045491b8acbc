"""Threshold-scaled sketches of word shingles (DataFrame functions only).

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space.  Whether a
shingle is kept depends on nothing but its hash, so the sketch of a union is the union of the
sketches, and the share of one sketch that another holds estimates containment without bias,
however unequal the two texts are.

A fingerprint is the digest of the text, which tells equal texts however short, and the sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.llm.exact_dedup import bound
from graphweir.llm.sharding import placed
from graphweir.plans.durable import ROW, durable, row_numbers

#: Words in a shingle, and the share of all hashes that a sketch keeps.
WORDS = 5
FRACTION = 1 / 8
#: Runs of white space between words.
SPACE = r"[\x20\x09-\x0D]+"
#: Hexadecimal digits of a shingle's hash.
DIGITS = 16


def threshold(fraction: float) -> str:
    """The first hash that is not kept; at a fraction of 1 one that is above all."""
    return f"{int(fraction * 16**DIGITS):0{DIGITS}x}" if fraction < 1 else "g"


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """The hashes of ``text``'s distinct shingles that are below the threshold, ascending.

    A text of fewer words than a shingle has one shingle, all its words; one without words has none.
    """

    def hashes(units: Column) -> Column:
        last = F.greatest(F.size(units) - words, F.lit(0))
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.md5(F.array_join(F.slice(units, i + 1, words), " ")), 1, DIGITS))
        return F.when(F.size(units) > 0, F.filter(each, lambda h: h < threshold(fraction))).otherwise(F.array().cast("array<string>"))

    found = bound(F.filter(F.split(text, SPACE), lambda w: w != ""), hashes)
    return F.sort_array(F.array_distinct(found))


def packed(kept: Column) -> Column:
    """A sketch as bytes, eight to a hash."""
    return F.unhex(F.array_join(kept, ""))


def unpacked(raw: Column) -> Column:
    n = F.octet_length(raw).cast("int")
    each = F.transform(F.sequence(F.lit(1), n, F.lit(DIGITS // 2)), lambda i: F.lower(F.hex(F.substring(raw, i, F.lit(DIGITS // 2)))))
    return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))


def rendered(digest: Column, kept: Column) -> Column:
    """A fingerprint as one string: the text's digest, a colon, and the hashes, of 16 digits each."""
    return F.concat(digest, F.lit(":"), F.array_join(kept, ""))


def likeness(a_digest: Column, a: Column, b_digest: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two texts' shingles: 1 for equal texts, 0 if neither sketch holds a hash."""
    common = F.size(F.array_intersect(a, b))
    return F.when(a_digest == b_digest, 1.0).otherwise(F.coalesce(F.try_divide(common.cast("double"), F.size(a) + F.size(b) - common), F.lit(0.0)))


def contained(a_digest: Column, a: Column, b_digest: Column, b: Column) -> Column:
    """The estimated share of the first text's shingles that the second holds too; 1 for equal texts, 0 for an empty sketch."""
    common = F.size(F.array_intersect(a, b))
    return F.when(a_digest == b_digest, 1.0).otherwise(F.coalesce(F.try_divide(common.cast("double"), F.size(a)), F.lit(0.0)))


def merged(sketches: DataFrame, keys: list[str], kept: str = "sketch") -> DataFrame:
    """The sketch of all texts of a key together, a row per key and hash: no key's hashes ever meet in one task."""
    return sketches.select(*keys, F.explode(kept).alias("hash")).distinct()


def containments(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """For merged sketches that share a hash: both keys, common, a_size, b_size and the two estimated containments.

    ``a`` and ``b`` have a row per key and hash.  Hashes meet by an equi-join, and pairs are counted where they meet before
    they are shuffled; keys that share nothing have no row.
    """
    sizes = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
    pairs = a.select(a_key, "hash").join(b.select(b_key, "hash"), "hash").groupBy(a_key, b_key).agg(F.count("*").alias("common"))
    out = pairs.join(sizes(a, a_key, "a_size"), a_key).join(sizes(b, b_key, "b_size"), b_key)
    return out.withColumns({"a_in_b": F.col("common") / F.col("a_size"), "b_in_a": F.col("common") / F.col("b_size")})


def fingerprints(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited, contained_next and ``__gw_row``.

    The edited text has its last third (rounded down, in code points) replaced by the first as many code points of the next
    document, or all it has; documents follow each other by descending id, null ids last, rows of the same id by the digest of
    their texts and then their row number, and the first follows the last (a single row follows itself).  A null text counts
    as empty; an empty table gives an empty result; texts of any length are read whole.  Other columns are ignored, whatever
    their names.

    ``row_col`` names a column that tells rows apart and that stays the same whenever the table is read again (see
    ``sources.files.row_places``); without one, rows are numbered and written with their texts first.

    The order is made of ids and lengths alone.  Texts are shuffled once, by row; what travels besides is the part
    of each text that its neighbour asks for, and its sketch.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), row_numbers(row_col), text.alias("t"))
    if row_col is None:
        rows = durable(rows, "fingerprint-rows")
    rows = rows.withColumns({"n": F.length("t").cast("bigint"), "digest": F.md5(F.col("t").cast("binary"))})
    slim = durable(rows.drop("t"), "fingerprint-ids")
    order = placed(slim, [F.desc_nulls_last("id"), F.asc("digest"), F.asc(ROW)], "fingerprint-order")
    total = slim.count()
    follows = order.select(F.col(ROW).alias("next_row"), F.when(F.col("pos") == 0, total).otherwise(F.col("pos")).alias("place"))
    pairs = order.select(F.col(ROW).alias("for_row"), "id", "n", (F.col("pos") + 1).alias("place")).join(follows, "place").drop("place")

    texts, cut = rows.select(ROW, "t", "digest"), F.expr("cast(n div 3 as int)")
    lent = texts.join(pairs, F.col(ROW) == F.col("next_row")).select("for_row", "id", "n", F.substring(F.col("t"), F.lit(1), cut).alias("lent"), F.col("digest").alias("next_digest"), packed(sketch(F.col("t"), words, fraction)).alias("next_packed"))
    both = texts.join(lent, F.col(ROW) == F.col("for_row"))
    edited = F.concat(F.substring(F.col("t"), F.lit(1), (F.col("n") - cut).cast("int")), F.col("lent"))
    told = both.select(ROW, "id", "n", "digest", "next_digest", unpacked(F.col("next_packed")).alias("next_sketch"), sketch(F.col("t"), words, fraction).alias("own"), edited.alias("e"))
    told = told.withColumns({"sha": F.sha2("e", 256), "e_digest": F.md5(F.col("e").cast("binary")), "e_sketch": sketch(F.col("e"), words, fraction)}).drop("e")
    own, changed, after = (F.col("digest"), F.col("own")), (F.col("e_digest"), F.col("e_sketch")), (F.col("next_digest"), F.col("next_sketch"))
    return told.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        rendered(*own).alias("fingerprint"),
        rendered(*changed).alias("edited_fingerprint"),
        likeness(*own, *changed).alias("near_edited"),
        likeness(*own, *after).alias("near_next"),
        contained(*own, *changed).alias("contained_edited"),
        contained(*own, *after).alias("contained_next"),
        ROW,
    )


def _sql_sketch(text: str) -> str:
    units = f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
    one = f"left(md5(array_to_string(list_slice(u, i + 1, i + {WORDS}), ' ')), {DIGITS})"
    kept = f"list_filter(list_transform(range(greatest(len(u) - {WORDS - 1}, least(len(u), 1))), lambda i: {one}), lambda h: h < '{threshold(FRACTION)}')"
    return f"list_sort(list_distinct((SELECT {kept} FROM (SELECT {units} AS u))))"


def _sql_share(a: str, b: str, whole: str) -> str:
    common = f"len(list_intersect({a}_sketch, {b}_sketch))"
    size = f"(len({a}_sketch) + len({b}_sketch) - {common})" if whole == "both" else f"len({a}_sketch)"
    return f"CASE WHEN {a}_digest = {b}_digest THEN 1.0 ELSE coalesce({common}::DOUBLE / nullif({size}, 0), 0.0) END::DOUBLE"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, length(t)::BIGINT AS n_chars, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(t) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(t, n_chars - n_chars // 3) || left(nx, n_chars // 3) AS ed FROM p),
s AS (SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, md5(t) AS own_digest, md5(ed) AS changed_digest, md5(nx) AS after_digest,
    {_sql_sketch("t")} AS own_sketch, {_sql_sketch("ed")} AS changed_sketch, {_sql_sketch("nx")} AS after_sketch FROM e)
SELECT doc_id, n_chars, edited_sha256, own_digest || ':' || array_to_string(own_sketch, '') AS fingerprint, changed_digest || ':' || array_to_string(changed_sketch, '') AS edited_fingerprint,
    {_sql_share("own", "changed", "both")} AS near_edited, {_sql_share("own", "after", "both")} AS near_next,
    {_sql_share("own", "changed", "own")} AS contained_edited, {_sql_share("own", "after", "own")} AS contained_next FROM s
"""
