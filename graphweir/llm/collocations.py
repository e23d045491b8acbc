"""Phrase collocations: per-shard suffix automata, counts reduced globally, subsumption along suffix links.

A shard is what a task holds of one language at a time.  Its generalised suffix automaton is cut at
a depth of a few words: a state is a class of phrases that end at the same places, ``endpos`` is how many
places those are, and the suffix link of a state leads to the longest shorter suffix that ends at more
places.  Along the links the states form a tree, the trie of reversed contexts, so the shard's places
sorted by their last words, last word first, have every state as one run: states, links and counts come from one sort.

Phrases that cannot be frequent are never counted as texts.  A first pass adds up, by 64-bit hashes, how often each pair of words
occurs.  The pairs that may be frequent set bits in a table of a fixed 16 MB; a second pass counts, exactly and
by their words, single words and those phrases all of whose pairs have their bit.  A bit that two pairs share costs a phrase that is
counted in vain; no frequent phrase is ever lost, as a phrase is no more frequent than its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweir.plans.durable import durable

#: Least count of a candidate, words of the longest, rows of a language, percentage at which a longer phrase stands for a shorter one.
LEAST, LONGEST, TOP, COVERS = 10, 3, 2000, 50
#: The table of pairs that may be frequent has 2^27 bits, 16 MB, whatever the corpus.
SLOT_BITS = 27
#: Places of a shard before its automaton is made, and bytes of text that are split at once.
PLACES, CHUNK = 1 << 20, 1 << 20
#: Partial rankings of a language, so that no task sees all its phrases.
PARTS = 16

#: The score of a cut, in decimals of 38 digits.
SCORE = "cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"

_UPPER, _ENDS = bytes(range(65, 91)), b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _ENDS, _UPPER.lower() + b"." * len(_ENDS))
_GAP = re.compile(rb"[ \t.]")


def token_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text``, A-Z in lower case, and ``.`` between pieces, some megabyte of text at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(_TABLE).replace(b".", b" . ").split()
        at = end


class Vocabulary(dict):
    """Numbers words from 1 as they come; 0 is the border between pieces."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Automaton:
    """The depth-bounded generalised suffix automaton of a shard, without its transitions.

    ``states[d]`` has, for the states whose longest phrase has d words, the packed phrase (last word first), the
    number of words of the shortest, and the size of endpos.  The link of a state is the class of its longest phrase's last
    ``shortest - 1`` words.
    """

    def __init__(self, places: np.ndarray, depth: int):
        self.depth, self.bits = depth, 63 // depth
        places, mask = np.sort(places), (1 << self.bits) - 1
        self.states: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        runs = []  # by depth: first place of each run, its size, words of the shortest phrase of its state, whether the state goes on below
        for d in range(1, depth + 1):
            prefix = places >> (self.bits * (depth - d))
            starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))) if len(places) else np.zeros(0, np.int64)
            sizes, real = np.diff(np.append(starts, len(places))), (prefix[starts] & mask) != 0
            starts, sizes, shortest = starts[real], sizes[real], np.full(int(real.sum()), d)
            if runs:
                above = np.searchsorted(runs[-1][0], starts, "right") - 1
                same = sizes == runs[-1][1][above]
                shortest[same] = runs[-1][2][above[same]]
                runs[-1][3][above[same]] = True
            runs.append((starts, sizes, shortest, np.zeros(len(starts), bool), prefix[starts]))
        for d, (_, sizes, shortest, below, prefix) in enumerate(runs, 1):
            self.states[d] = (prefix[~below], shortest[~below], sizes[~below])

    def phrases(self, words: int) -> tuple[list[np.ndarray], np.ndarray]:
        """All distinct phrases of so many words: their words' numbers in reading order, and how often they occur."""
        packed, sizes = [], []
        for d in range(words, self.depth + 1):
            prefix, shortest, endpos = self.states[d]
            here = shortest <= words
            packed.append(prefix[here] >> (self.bits * (d - words)))
            sizes.append(endpos[here])
        p, mask = np.concatenate(packed), (1 << self.bits) - 1
        return [(p >> (self.bits * k)) & mask for k in range(words)], np.concatenate(sizes)


class Shard:
    """Gathers the places of one language's words; each place is packed with the words before it in its piece."""

    def __init__(self, depth: int):
        self.depth, self.bits = depth, 63 // depth
        self.vocabulary, self.held, self.n = Vocabulary(), [], 0

    def room(self) -> int:
        """Words that surely fit."""
        return min(PLACES - self.n, (1 << self.bits) - 1 - len(self.vocabulary))

    def add(self, tokens: list[bytes], context: int) -> None:
        """``tokens``, of which the first ``context`` are only there as the neighbours of the others."""
        ids = np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int64, len(tokens))
        place, alive = ids.copy(), ids > 0
        for d in range(1, self.depth):
            before = np.zeros_like(ids)
            before[d:] = ids[:-d]
            alive &= before > 0
            place = (place << self.bits) | np.where(alive, before, 0)
        self.held.append(place[context:][ids[context:] > 0])
        self.n += len(self.held[-1])

    def automaton(self) -> Automaton:
        return Automaton(np.concatenate(self.held) if self.held else np.zeros(0, np.int64), self.depth)


def shards(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[str, Shard]]:
    """The shards of a task's rows (lang, text as bytes), full ones as they fill; a document of any length spans as many as it needs."""
    open_: dict[str, Shard] = {}
    waiting: dict[str, list[bytes]] = {}

    def work(lang: str) -> Iterator[tuple[str, Shard]]:
        context: list[bytes] = []
        for tokens in token_lists(b".".join(waiting.pop(lang))):
            at = 0
            while at < len(tokens):
                shard = open_.setdefault(lang, Shard(depth))
                take = min(shard.room() - len(context), len(tokens) - at)
                if take <= 0:
                    yield lang, open_.pop(lang)
                    continue
                shard.add(context + tokens[at : at + take], len(context))
                context = (context + tokens[at : at + take])[1 - depth :] if depth > 1 else []
                at += take

    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py()
            waiting.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw)
            if sizes[lang] >= CHUNK:
                sizes[lang] = 0
                yield from work(lang)
        if sum(s.n for s in open_.values()) > 2 * PLACES:  # many languages
            for lang in list(open_):
                yield lang, open_.pop(lang)
    for lang in list(waiting):
        yield from work(lang)
    yield from open_.items()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(lang: str, vocabulary: Vocabulary) -> np.ndarray:
    """A 64-bit hash of each word of a language, by number."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(3) + _mixed(second))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, shard in shards(batches, 2):
        (first, second), n = shard.automaton().phrases(2)
        h = word_hashes(lang, shard.vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(h[first], h[second]).view(np.int64)), pa.array(n)], ["h", "n"])


def _counter(depth: int, bits: Broadcast):
    """Counts single words, and the phrases all of whose pairs have their bit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for lang, shard in shards(batches, depth):
            automaton, h = shard.automaton(), word_hashes(lang, shard.vocabulary)
            spelled = pa.array(list(shard.vocabulary), pa.binary())
            for words in range(1, depth + 1):
                ids, n = automaton.phrases(words)
                keep = np.ones(len(n), bool)
                for a, b in zip(ids, ids[1:]):
                    slot = pair_hashes(h[a], h[b]) & np.uint64((1 << SLOT_BITS) - 1)
                    keep &= (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                parts = [spelled.take(pa.array(i[keep])) for i in ids]
                phrase = parts[0] if words == 1 else pc.binary_join_element_wise(*parts, b" ")
                for at in range(0, len(phrase), 1 << 16):
                    some = phrase[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(np.full(len(some), words, np.int32)), pa.array(n[keep][at : at + (1 << 16)])], ["lang", "phrase", "words", "n"])

    return count


def may_be_frequent(texts: DataFrame, least: int) -> np.ndarray:
    """The bits of the pairs that occur ``least`` times, 2^27 of them, as bytes: packed by Spark into at most 4096 rows."""
    counts = texts.mapInArrow(_pairs, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    slot = F.col("h").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) + 1  # Spark's bitmaps count from 1
    packed = counts.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    table = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    for row in packed.toLocalIterator():
        table[(row["bucket"] - 1) * 4096 :][:4096] = np.frombuffer(row["bits"], np.uint8)
    return table


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, words, f: all single words, and at least those phrases of 2 to ``longest`` words that occur ``least`` times, with exact counts."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(may_be_frequent(texts, least))
    found = texts.mapInArrow(_counter(longest, bits), "lang string, phrase binary, words int, n long")
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("n").alias("f")).filter((F.col("words") == 1) | (F.col("f") >= least))


def _run(units: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(units, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covers: int = COVERS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` candidates that no longer one stands for.

    A-Z are lowered; texts are split into pieces at ``.,;:!?`` and line breaks, pieces into words at spaces and tabs.  A candidate has 2 to
    ``longest`` words and occurs ``least`` times; its score is that of its lowest cut.  It is dropped if a candidate one or
    more words longer holds it and occurs at least ``covers`` percent as often.  That is looked for step by step: the suffix link of
    a phrase drops its first word, the other step its last.  Null texts count as empty, null languages are ``und``, repeated rows count each time, an
    empty table gives an empty result, and other columns are ignored.  Scores are decimals of 38 digits, so products may pass
    64 bits.
    """
    counts = durable(phrase_counts(docs, least, longest, text_col, lang_col), "phrases")
    candidates = counts.filter(F.col("words") >= 2).withColumn("u", F.split("phrase", " "))

    shorter = lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: _run(F.col("u"), i, F.lit(size)))
    inside = None
    for size in range(2, longest):  # phrases of ``size`` words in longer candidates, the runs that links and their mirror images lead to
        step = candidates.filter(F.col("words") > size).select("lang", F.explode(F.array_distinct(shorter(size))).alias("phrase"), F.col("f").alias("longer"))
        inside = step if inside is None else inside.unionByName(step)
    left = candidates
    if inside is not None:
        held = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        left = candidates.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covers * F.col("f")))

    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), _run(F.col("u"), F.lit(1), k).alias("l"), _run(F.col("u"), k + 1, F.col("words")).alias("r")))
    each = left.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("c.l").alias("part")), F.struct(F.lit(False).alias("first"), F.col("c.r").alias("part")))).alias("p"))
    parts = each.select("lang", "phrase", "a", "k", "p.first", F.col("p.part").alias("part")).join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = parts.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    lowest = sides.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = lowest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    words = counts.filter("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS u FROM d),
g AS (SELECT lang, m, array_to_string(u[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, u, m, unnest(range(1, len(u) - m + 2)) AS i FROM p, range(1, {LONGEST + 1}) r(m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS u FROM f WHERE m >= 2 AND f >= {LEAST}),
h AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(u[i:i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM c, range(2, {LONGEST}) r(s) WHERE s < m)) GROUP BY ALL),
k AS (SELECT lang, phrase, a, k, array_to_string(u[1:k], ' ') AS lp, array_to_string(u[k + 1:], ' ') AS rp FROM
    (SELECT c.*, unnest(range(1, m)) AS k FROM c LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERS} * a)),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = lp JOIN f y ON y.lang = k.lang AND y.phrase = rp),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN n USING (lang) WHERE rank <= {TOP}
"""
