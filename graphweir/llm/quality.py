"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is trained on the n-grams of four characters of all trusted text.  All characters
count, so the tables grow with the corpus and any script is seen.  Counts and continuation
counts are tables sharded by n-gram and by context; nothing is gathered.  Documents are
scored in blocks: distinct texts are dealt to blocks by their digest, the distinct contexts
of a block are joined to the counts, and what is found meets the block's texts again (asking and
scoring read one shuffle of them), where
discounts and context weights (Chen and Goodman, "An Empirical Study of Smoothing Techniques
for Language Modeling", 1999) give every character its probability.  A document is rejected if its perplexity, or its
share of distinct pairs of words, lies outside quantiles of the trusted documents of its
language and length, a fifth of which the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.plans.durable import durable, free_names

ORDER, SYMBOLS = 4, 1 << 21
#: Bytes of text that a block holds on average, characters that are worked on at once, and digests and n-grams that a task remembers.
BLOCK_BYTES, CHUNK, REMEMBERED, HELD = 4 << 20, 3_000_000, 1_000_000, 4_000_000
#: What is hashed to that many slots can be broadcast whole, however long the table.
SLOTS = 1 << 20
#: Trusted documents outside these quantiles are rejected.
LOW, HIGH = 0.0005, 0.999
#: Their places in a normal distribution.
LOW_Z, HIGH_Z = -3.2905, 3.0902
SCORES = ("char", "pair")
#: One of so many trusted documents is kept from training, so that the quantiles know unseen text.
HELD_OUT = 5
#: Bounds of a length class lean on its language's, those of a language on all, as if so many further trusted documents said so.
LEAN = 10
#: The upper quantile leans on that of all trusted texts as if so many held-out ones said so.
LEAN_HELD = 8
#: A language's typical cost a character leans on the overall one as if so many further characters said so.
LEAN_UNITS = 10_000

MODEL = "k int, x long, s array<int>, c array<long>"


def symbols_of(text: str) -> np.ndarray:
    """The characters, lower-cased; tabs and ends of lines are spaces, and a run of spaces is one."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    x[(x >= 9) & (x <= 13)] = 32
    return x[~np.concatenate([np.zeros(1, bool), (x[1:] == 32) & (x[:-1] == 32)])[: len(x)]]


def repeated_words(text: str) -> tuple[int, int]:
    """Words, and distinct pairs of a word and the one before (nothing, at the start)."""
    words = text.split()
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), h])[: len(h)]
    return len(h), len(np.unique(before * np.uint64(0x9E3779B97F4A7C15) ^ h))


class Grams:
    """The n-grams of some texts, each with ORDER - 1 blanks before it: distinct ones (context ``x``, symbol ``s``), how often each occurs,
    and for each place in the texts (``own``: of which text) which n-gram ends there."""

    def __init__(self, texts: list[np.ndarray], order: int = ORDER, base: int = SYMBOLS):
        n, blanks = [len(t) for t in texts], np.full(order - 1, 32, np.int64)
        line = np.concatenate([p for t in texts for p in (blanks, t)])
        self.own = np.repeat(np.arange(len(n)), n)
        end = np.arange(len(self.own)) + (order - 1) * (self.own + 1)
        seen = np.zeros(base, bool)
        seen[line] = True
        alphabet = np.flatnonzero(seen)
        number = np.zeros(base, np.uint64)
        number[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
        dense, size = number[line], np.uint64(len(alphabet))
        code = np.zeros(len(end), np.uint64)
        for k in range(order - 1, 0, -1):
            code = code * size + dense[end - k]
        contexts = None
        if len(alphabet) ** order >= 2**63:  # too many for one number: number the contexts that occur
            contexts, code = np.unique(code, return_inverse=True)
            code = code.astype(np.uint64)
        self.code = code * size + dense[end]
        self.distinct, self.count = np.unique(self.code, return_counts=True)
        x, self.s = self.distinct // size, alphabet[(self.distinct % size).astype(np.int64)]
        x = x if contexts is None else contexts[x.astype(np.int64)]
        self.x = np.zeros(len(x), np.int64)
        for k in range(order - 1):
            digit = (x // size ** np.uint64(order - 2 - k)) % size
            self.x = self.x * base + alphabet[digit.astype(np.int64)]

    def at_each_place(self, value: np.ndarray, bits: int = 22) -> np.ndarray:
        """``value`` (of each distinct n-gram) for every place: from a table by a hash, and by search where two n-grams share a slot."""
        slot = lambda c: (c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        own = slot(self.distinct).astype(np.int64)
        table = np.full(1 << bits, np.nan)
        table[own] = value
        table[np.bincount(own, minlength=1 << bits) > 1] = np.nan
        out = table[slot(self.code).astype(np.int64)]
        shared = np.flatnonzero(np.isnan(out))
        out[shared] = value[np.searchsorted(self.distinct, self.code[shared])]
        return out


def chunks(blobs: list[bytes]) -> Iterator[tuple[int, list[str], list[np.ndarray]]]:
    """Texts and their symbols, some CHUNK characters at a time, and the place of the first."""
    unpack, first, texts, symbols, held = zstandard.ZstdDecompressor(), 0, [], [], 0
    for i, blob in enumerate(blobs):
        texts.append(unpack.decompress(blob).decode("utf-8", "surrogatepass"))
        symbols.append(symbols_of(texts[-1]))
        held += len(symbols[-1])
        if held >= CHUNK or i == len(blobs) - 1:
            yield first, texts, symbols
            first, texts, symbols, held = i + 1, [], [], 0


def packed(docs: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """block, th, z: texts as Zstandard frames; a task packs equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(3), set()
        for batch in batches:
            block, th, z = [], [], []
            for b, h, t in zip(*(batch.column(c).to_pylist() for c in ("block", "th", "text")), strict=True):
                if h not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(h)
                    block.append(b)
                    th.append(h)
                    z.append(pack.compress(t.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(th, pa.binary()), pa.array(z, pa.binary())], names=["block", "th", "z"])

    text = docs.filter(F.length(text_col) > 0).select(digest(text_col), F.col(text_col).alias("text"))
    return text.withColumn("block", block_of(blocks)).mapInArrow(run, "block long, th binary, z binary")


def distinct_texts(docs: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """block, th, z: each distinct text once, with its block's others."""
    return packed(docs, text_col, blocks).repartition("block").groupBy("block", "th").agg(F.first("z").alias("z"))


def trained_texts(docs: DataFrame, marks: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """n, z: the texts that ``marks`` (block, th, n) names, each once, and how often each is trained on.

    Most other texts are told by the slots of their digests before the shuffle: there are at most SLOTS of them, so they are broadcast.
    """
    (slot,) = free_names(docs, "slot")
    slots = marks.select(slot_of().alias(slot)).distinct()
    some = docs.join(F.broadcast(slots), slot_of(digest(text_col)) == F.col(slot), "left_semi")
    frames = packed(some, text_col, blocks).withColumn("n", F.lit(None).cast("bigint"))
    marked = marks.select("block", "th", F.lit(None).cast("binary").alias("z"), "n")
    each = frames.unionByName(marked).repartition("block").groupBy("block", "th").agg(F.first("z", ignorenulls=True).alias("z"), F.max("n").alias("n"))
    return each.filter("n is not null").select("n", "z")


def slot_of(th: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), F.col("th") if th is None else th), F.lit(SLOTS))


def digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col))).alias("th")


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("th"), F.lit(blocks)).cast("bigint")


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of (context, symbol, count) and their counts."""
    x, s, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((s, x))
    x, s = x[order], s[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), (np.diff(x) != 0) | (np.diff(s) != 0)]))
    return x[first], s[first], np.add.reduceat(c[order], first)


def trained_counts(texts: DataFrame) -> DataFrame:
    """x, s, c: how often each n-gram occurs in the texts, each of them n times; summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, held = [], [], 0

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, waiting, held
            for n in sorted({n for n, _ in waiting}):
                for _, _, symbols in chunks([z for k, z in waiting if k == n]):
                    g = Grams(symbols)
                    parts.append((g.x, g.s, g.count * n))
            waiting, held = [], 0
            if parts:
                x, s, c = merged(parts)
                parts = [(x, s, c)]
                if last or len(x) > HELD:
                    parts = []
                    for lo in range(0, len(x), 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 200_000], t) for v, t in ((x, pa.int64()), (s, pa.int32()), (c, pa.int64()))], names=["x", "s", "c"])

        for batch in batches:
            waiting += zip(batch.column("n").to_pylist(), batch.column("z").to_pylist(), strict=True)
            held += batch.nbytes
            if held >= BLOCK_BYTES:
                yield from rows(False)
        yield from rows(True)

    grams = texts.mapInArrow(run, "x long, s int, c long")
    return grams.groupBy("x", "s").agg(F.sum("c").alias("c"))


def model_of(counts: DataFrame, order: int = ORDER, base: int = SYMBOLS) -> DataFrame:
    """The sharded model, as rows of MODEL, from counts (x, s, c) of the longest n-grams.

    For k from ``order`` to 2, the symbols seen behind each context of k - 1 symbols and their counts; for k = 1 the
    count of the symbol x; for k = 0 of order x how many n-grams occur 1 to 4 times, the sum of all counts, and the
    number of n-grams.  Counts below the longest are continuation counts: before how many symbols an n-gram occurs.
    A context has at most as many rows as there are characters.
    """
    out, none = None, F.array().cast("array<int>")
    for k in range(order, 0, -1):
        if k == 1:
            rows = counts.select(F.lit(1).alias("k"), F.col("s").cast("bigint").alias("x"), none.alias("s"), F.array("c").alias("c"))
        else:
            lists = counts.groupBy("x").agg(F.collect_list(F.struct("s", "c")).alias("l"))
            rows = lists.select(F.lit(k).alias("k"), "x", F.col("l.s").alias("s"), F.col("l.c").alias("c"))
        often = [F.count_if(F.col("c") == n) for n in (1, 2, 3, 4)] + [F.coalesce(F.sum("c"), F.lit(0)), F.count("*")]
        rows = rows.unionByName(counts.agg(F.array(*often).alias("c")).select(F.lit(0).alias("k"), F.lit(k).cast("bigint").alias("x"), none.alias("s"), "c"))
        out = rows if out is None else out.unionByName(rows)
        if k > 1:
            counts = durable(counts.groupBy((F.col("x") % base ** (k - 2)).alias("x"), "s").agg(F.count("*").alias("c")), "continuations")
    return out


def suffix(x: np.ndarray, k: int, order: int, base: int) -> np.ndarray:
    """The last k - 1 symbols of contexts of order - 1."""
    return x if k == order else x % base ** (k - 1)


def asked(texts: DataFrame) -> DataFrame:
    """block, k, x: the rows of the model that a block's texts depend on."""

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for _, _, symbols in chunks(texts.column("z").to_pylist()):
            g = Grams(symbols)
            found.append((np.unique(g.x), np.unique(g.s)))
        x = np.unique(np.concatenate([f[0] for f in found]))
        parts = [(0, np.arange(1, ORDER + 1)), (1, np.unique(np.concatenate([f[1] for f in found])))]
        parts += [(k, np.unique(suffix(x, k, ORDER, SYMBOLS))) for k in range(2, ORDER + 1)]
        k = np.concatenate([np.full(len(v), n, np.int32) for n, v in parts])
        return pa.table({"block": np.full(len(k), key[0].as_py(), np.int64), "k": k, "x": np.concatenate([v for _, v in parts]).astype(np.int64)})

    return texts.groupBy("block").applyInArrow(run, "block long, k int, x long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Chen and Goodman's three discounts, from how many n-grams occur 1 to 4 times."""
    if not (n1 and n2):
        return np.full(3, 0.5)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return np.clip(d, 0.05, (0.95, 1.9, 2.9))


class Known:
    """Rows of the model, for the n-grams that they cover."""

    def __init__(self, rows: pa.Table, order: int = ORDER, base: int = SYMBOLS):
        self.order, self.base, self.levels = order, base, {}
        rows = rows.combine_chunks()
        kind, x = rows.column("k").to_numpy(), rows.column("x").to_numpy()
        often = {int(a): c for a, c in zip(x[kind == 0], rows.filter(pa.array(kind == 0)).column("c").to_pylist(), strict=True)}
        for k in range(1, order + 1):
            mine = rows.filter(pa.array(kind == k)).sort_by("x")
            stats = often.get(k, [0] * 6)
            cut = np.concatenate([[0.0], discounts(*stats[:4])])
            flat = lambda name: mine.column(name).combine_chunks().flatten().to_numpy().astype(np.int64) if len(mine) else np.zeros(0, np.int64)  # noqa: B023, E731
            c, at = flat("c"), mine.column("x").to_numpy()
            less = cut[np.minimum(c, 3)]
            if k == 1:
                n1, n2, _, _, total, types = stats
                rest = cut[1] * n1 + cut[2] * n2 + cut[3] * (types - n1 - n2)
                self.floor = (rest / total if total else 1.0) / (types + 1)
                self.levels[1] = at, np.maximum(c - less, 0) / max(total, 1)
                continue
            length = pc.list_value_length(mine.column("s")).to_numpy().astype(np.int64)
            own = np.repeat(np.arange(len(at)), length)
            total = np.bincount(own, c, len(at))
            weight = np.bincount(own, less, len(at)) / np.maximum(total, 1)
            key = own * base + flat("s")
            order_ = np.argsort(key)
            self.levels[k] = at, weight, key[order_], (np.maximum(c - less, 0) / total[own])[order_]

    @staticmethod
    def find(among: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``x`` in ``among`` (sorted), and whether they are there."""
        if not len(among):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(among, x), len(among) - 1)
        return at, among[at] == x

    def costs(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """-log p(s | x): each order's share, and its weight times the lower order's."""
        symbols, share = self.levels[1]
        at, there = self.find(symbols, s)
        p = np.full(len(s), self.floor)
        p[there] += share[at[there]]
        for k in range(2, self.order + 1):
            contexts, weight, key, share = self.levels[k]
            at, there = self.find(contexts, suffix(x, k, self.order, self.base))
            p[there] *= weight[at[there]]
            own = np.flatnonzero(there)
            hit, seen = self.find(key, at[own] * self.base + s[own])
            p[own[seen]] += share[hit[seen]]
        return -np.log(np.maximum(p, 1e-300))


def scored(docs: DataFrame, marks: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """th, cost (nats in all), units (characters), words and pairs of every distinct text; the model is of the texts in ``marks``."""
    model = durable(model_of(durable(trained_counts(trained_texts(docs, marks, text_col, blocks)), "grams")), "model")
    texts = distinct_texts(docs, text_col, blocks)
    answers = asked(texts).join(model, ["k", "x"]).select("block", "k", "x", "s", "c")

    def run(texts: pa.Table, rows: pa.Table) -> pa.Table:
        known, th = Known(rows), texts.column("th").to_pylist()
        cost, units, words = np.zeros(len(th)), np.zeros(len(th), np.int64), np.zeros((len(th), 2), np.int64)
        for first, part, symbols in chunks(texts.column("z").to_pylist()):
            g, here = Grams(symbols), slice(first, first + len(part))
            cost[here] = np.bincount(g.own, g.at_each_place(known.costs(g.x, g.s)), len(part))
            units[here] = [len(x) for x in symbols]
            words[here] = [repeated_words(t) for t in part]
        return pa.table({"th": pa.array(th, pa.binary()), "cost": cost, "units": units, "words": words[:, 0], "pairs": words[:, 1]})

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "th binary, cost double, units long, words long, pairs long")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids whose labels all say good and none says toxic, and their use: 1 to train, 2 held out; null ids are left out."""
    per = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return per.filter("q = 1 and t = 0").select(F.col(id_col).alias("gw_id"), F.when(F.pmod(F.xxhash64(id_col), F.lit(HELD_OUT)) == 0, 2).otherwise(1).alias("gw_use"))


def rated(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """A slim durable table, one row per input row: id, lang, th (digest of the text), gw_use, and cost, units, words and pairs of the text."""
    text = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = text.select("id", "lang", digest("text"), F.octet_length("text").alias("bytes"))
    rows = durable(rows.join(trusted_ids(labels, id_col), F.col("id") == F.col("gw_id"), "left").drop("gw_id"), "quality-rows")
    blocks = max(1, -(-(rows.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES))
    trained = rows.filter("gw_use = 1 and bytes > 0").withColumn("block", block_of(blocks))
    marks = durable(trained.groupBy("block", "th").agg(F.count("*").alias("n")), "quality-marks")
    costs = durable(scored(text, marks, "text", blocks), "quality-costs")
    return durable(rows.drop("bytes").join(costs, "th", "left").fillna(0, ["cost", "units", "words", "pairs"]), "quality-rated")


def with_scores(df: DataFrame, typical: DataFrame, overall: float) -> DataFrame:
    """``score<k>`` and ``class<k>`` of SCORES: how far the cost is from the language's typical one, by the root of the
    length, and the share of pairs of words that are not repeated; classes by powers of four of the length."""
    df = df.join(typical, F.col("lang").eqNullSafe(F.col("gw_l")), "left").drop("gw_l")
    grade = lambda n: F.floor(F.log(F.greatest(n, F.lit(1))) / F.log(F.lit(4.0)) + 1e-9)
    excess = F.col("cost") - F.coalesce("rate", F.lit(overall)) * F.col("units")
    df = df.withColumn("score0", excess / F.sqrt(F.greatest("units", F.lit(1)))).withColumn("class0", grade(F.col("units")))
    pairs = F.when(F.col("words") > 0, F.col("pairs") / F.col("words")).otherwise(1.0)
    return df.withColumn("score1", pairs).withColumn("class1", grade(F.col("words"))).drop("rate")


def leaning(own: Column, n: Column, wider: Column, weight: float) -> Column:
    """``own``, seen on ``n`` values, drawn towards ``wider`` with the weight of so many more values; ``wider`` where there is none."""
    return F.coalesce((n * own + weight * wider) / (n + weight), wider)


def limit(score: str, low: bool) -> Column:
    """The quantile LOW of all trusted texts, or HIGH of the held-out ones (the model knows the others too well).

    Of n values, n times the share beyond the quantile can be expected to show it.  That is the weight of the quantile as seen, against a weight of one for
    the outer of it and Student's for as many values.
    """
    q, z, order = (LOW, LOW_Z, F.least) if low else (HIGH, HIGH_Z, F.greatest)

    def of(v: Column) -> Column:
        seen, shown = F.percentile_approx(v, q, 100_000), F.count(v) * min(q, 1 - q)
        n = F.greatest(F.count(v), F.lit(2))
        far = (z + (z**3 + z) / (4 * (n - 1))) * F.sqrt(1 + 1 / n)  # Student's, for the next value after n
        outer = order(seen, F.avg(v) + far * F.coalesce(F.stddev(v), F.lit(0.0)))
        return (shown * seen + outer) / (shown + 1)

    held = F.when(F.col("gw_use") == 2, F.col(score))
    return of(F.col(score)) if low else leaning(of(held), F.count(held), of(F.col(score)), LEAN_HELD)


def bounds_of(known: DataFrame) -> DataFrame:
    """kind, lang, class, wide, n, lo, hi: limits of SCORES over trusted rows; wide is 3 for all, 1 for a language, 0 for a length in it."""
    each = known.select("lang", "gw_use", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"class{k}").alias("class"), F.col(f"score{k}").cast("double").alias("score")) for k in (0, 1)])))
    limits = [F.count("*").alias("n"), limit("score", True).alias("lo"), limit("score", False).alias("hi")]
    sets = [["kind"], ["kind", "lang"], ["kind", "lang", "class"]]
    return each.groupingSets(sets, "kind", "lang", "class").agg(F.grouping_id().alias("wide"), *limits)


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (rated) with perplexity, score, lower and upper of SCORES, and keep.

    What is known of a language, or of a length in it, are some numbers each; Spark broadcasts them if they are small.
    """
    trusted = rows.filter("gw_use is not null")
    overall = trusted.agg(F.coalesce(F.try_divide(F.sum("cost"), F.sum("units")), F.lit(0.0)).alias("rate")).first()["rate"]
    rate = (F.sum("cost") + LEAN_UNITS * F.lit(overall)) / (F.sum("units") + LEAN_UNITS)
    typical = durable(trusted.groupBy(F.col("lang").alias("gw_l")).agg(rate.alias("rate")), "quality-rates")
    bounds = durable(bounds_of(with_scores(trusted, typical, overall)), "quality-bounds")
    wide = {r["kind"]: r for r in bounds.filter("wide = 3").collect()}  # two rows
    out, keep = with_scores(rows, typical, overall), F.col("units") >= 0
    for k, name in enumerate(SCORES):
        own = bounds.filter(f"wide = 1 and kind = {k}").select(F.col("lang").alias("gw_l"), *[F.col(c).alias(f"{c}_lang") for c in ("n", "lo", "hi")])
        fine = bounds.filter(f"wide = 0 and kind = {k}").select(F.col("lang").alias("gw_l"), F.col("class").alias("gw_c"), *[F.col(c).alias(f"{c}_class") for c in ("n", "lo", "hi")])
        out = out.join(own, F.col("lang").eqNullSafe(F.col("gw_l")), "left").drop("gw_l")
        out = out.join(fine, F.col("lang").eqNullSafe(F.col("gw_l")) & (F.col(f"class{k}") == F.col("gw_c")), "left").drop("gw_l", "gw_c", f"class{k}")

        def of(x: str) -> Column:
            language = leaning(F.col(f"{x}_lang"), F.col("n_lang"), F.lit(wide[k][x] if k in wide else None).cast("double"), LEAN)  # noqa: B023
            return leaning(F.col(f"{x}_class"), F.col("n_class"), language, LEAN)

        out = out.withColumn(f"{name}_lower", of("lo")).withColumn(f"{name}_upper", of("hi") if k == 0 else F.lit(1.0))
        out = out.drop(*[f"{c}_{level}" for c in ("n", "lo", "hi") for level in ("class", "lang")]).withColumnRenamed(f"score{k}", f"{name}_score")
        keep = keep & F.coalesce(F.col(f"{name}_score").between(F.col(f"{name}_lower"), F.col(f"{name}_upper")), F.lit(True))
    perplexity = F.exp(F.coalesce(F.try_divide("cost", "units"), F.lit(0.0)))
    return out.withColumn("char_perplexity", perplexity).withColumn("keep", keep | (F.col("units") == 0))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, language, chars, words, perplexity by characters, its score, lower and upper, the same of the pairs of
    words, and keep.

    The score is the cost beyond that of the language's typical text of the same length,
    divided by the root of the length, and for pairs the share of distinct pairs
    among all pairs of words, which is low where words repeat.  Bounds are quantiles of
    the trusted documents of the language and of about the same length, drawn towards those of the language and of all by stated weights,
    alike for few and many; ``keep`` says whether both lie within them.  A null or empty text has perplexity 1 and is kept.  A null language is a language of its own.
    Without trusted documents all is kept.  Whole texts are scored, however long; repeated
    rows are judged alike; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    columns = ["char_perplexity", *[f"{n}_{x}" for n in SCORES for x in ("score", "lower", "upper")]]
    out = judged(rated(docs, labels, id_col, text_col, lang_col))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.col("units").alias("chars"), "words", *columns, "keep")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever their names.

    A decision depends on the text and the language alone, so the rows to go are told by the text's digest.
    """
    th, lang = free_names(docs, "th", "lang")
    gone = durable(judged(rated(docs, labels, id_col, text_col, lang_col)).filter("not keep").select(F.col("th").alias(th), F.col("lang").alias(lang)).distinct(), "quality-rejected")
    return docs.join(gone, (digest(text_col) == F.col(th)) & F.col(lang_col).eqNullSafe(F.col(lang)), "left_anti")
