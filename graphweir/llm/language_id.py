"""Language of texts, and of their words, by a linear-chain conditional random field.

Words are emitted by affix, character n-gram and lexicon features, hashed into one weight
table; transitions between the languages of neighbouring words are learned with them, on
code-switched sequences spliced from labelled texts.  Forward-backward gives each word a
distribution over languages; a text's language has the largest sum over its words.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweir.plans.durable import durable

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, MAX_GRAM = 1 << 18, 4
#: The training sample: labelled texts per language, by the smallest hash of the text; the characters in a row
#: that a longer text gives, from a place that its hash names; and the characters of all, which many languages share.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_TOTAL = 80, 20_000, 64_000_000
#: The weights of a model, of all languages together: more languages than 64 share a shorter table of features.
MOST_WEIGHTS = 1 << 24
#: Characters that are labelled at once, and words of a segment of a longer text (whole blocks of a chain).
CHARS_AT_ONCE, SEGMENT = 1_000_000, 128 * 512
SEQUENCE, EPOCHS, BATCH, RATE, PENALTY, SEED = 48, 6, 256, 0.5, 1e-6, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first feature of each word): n-grams of ^word$ up to MAX_GRAM, and the word.

    N-grams with ^ are prefixes, those with $ suffixes.
    """
    joined = "".join(f"^{w}$" for w in words)
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(length) - length
    left = np.repeat(start + length, length) - np.arange(len(x))  # characters to the word's end
    owner = np.repeat(np.arange(len(words)), length)
    codes, owners, h = [], [], np.zeros(len(x), np.uint64)
    for n in range(1, MAX_GRAM + 1):
        h = h[: len(x) - n + 1] * _ODD + x[n - 1 :] + np.uint64(n)
        ok = left[: len(h)] >= n
        y = h[ok]
        codes.append(((y ^ (y >> np.uint64(31))) * _ODD) >> np.uint64(46))
        owners.append(owner[: len(h)][ok])
    whole = np.add.reduceat(x * _ODD ** (np.arange(len(x), dtype=np.uint64) - np.repeat(start, length).astype(np.uint64) + np.uint64(1)), start)
    codes.append(((whole ^ (whole >> np.uint64(29))) * _ODD) >> np.uint64(46))
    owners.append(np.arange(len(words)))
    code, own = np.concatenate(codes).astype(np.int64), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return code[order], np.searchsorted(own[order], np.arange(len(words)))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray  # languages x languages, log potentials

    def emissions(self, words: list[str]) -> np.ndarray:
        code, first = features(words)
        n = np.diff(np.append(first, len(code)))[:, None]
        return np.add.reduceat(self.weights[code % len(self.weights)], first, axis=0) / np.sqrt(n)


def _transfers(emit: np.ndarray, fresh: np.ndarray, transitions: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Emissions and beginnings of texts by block, transitions, and the transfer matrix of every block, which step together."""
    n, k = emit.shape
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    pad = -n % block
    e = np.concatenate([e, np.ones((pad, k))]).reshape(-1, block, k)
    new = np.concatenate([fresh, np.ones(pad, bool)]).reshape(-1, block)
    matrix = np.broadcast_to(np.eye(k), (len(e), k, k)).copy()
    for t in range(block):
        moved = matrix @ move
        moved = np.where(new[:, t, None, None], matrix.sum(axis=2, keepdims=True), moved) * e[:, t, None, :]
        matrix = moved / moved.sum(axis=(1, 2), keepdims=True)
    return e, new, move, matrix


def crossing(emit: np.ndarray, fresh: np.ndarray, transitions: np.ndarray, block: int = 128) -> np.ndarray:
    """The transfer matrix of a segment of whole blocks, but for a factor."""
    out = np.eye(emit.shape[1])
    for m in _transfers(emit, fresh, transitions, block)[3]:
        out = out @ m
        out /= out.sum()
    return out


def forward_backward(emit: np.ndarray, fresh: np.ndarray, transitions: np.ndarray, block: int = 128, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Marginals of a long chain of words; where ``fresh`` is true a new text begins.

    The chain is cut into blocks that step together: first the transfer matrix of every
    block, then the states at block borders, then the states within.  A segment of a longer
    chain has the states ``before`` and ``after`` it; one with words after it is of whole blocks.
    """
    n, k = emit.shape
    e, new, move, matrix = _transfers(emit, fresh, transitions, block)
    blocks = len(e)
    enter = np.empty((blocks, k))
    state = np.full(k, 1 / k) if before is None else before
    for b in range(blocks):
        enter[b] = state
        state = state @ matrix[b]
        state = state / state.sum()
    leave = np.empty((blocks, k))
    state = np.ones(k) if after is None else after
    for b in range(blocks - 1, -1, -1):
        leave[b] = state
        state = matrix[b] @ state
        state = state / state.sum()
    forward, state = np.empty_like(e), enter
    for t in range(block):
        state = np.where(new[:, t, None], state.sum(axis=1, keepdims=True), state @ move) * e[:, t]
        state = state / state.sum(axis=1, keepdims=True)
        forward[:, t] = state
    out, state = np.empty_like(e), leave
    for t in range(block - 1, -1, -1):
        both = forward[:, t] * state
        out[:, t] = both / both.sum(axis=1, keepdims=True)
        back = e[:, t] * state
        state = np.where(new[:, t, None], back.sum(axis=1, keepdims=True), back @ move.T)
        state = state / state.sum(axis=1, keepdims=True)
    return out.reshape(-1, k)[:n]


def fit(texts: list[tuple[str, str]], seed: int = SEED) -> Model:
    """A field trained on (language, text) pairs by AdaGrad on the conditional likelihood."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in texts})
    k, pieces = len(languages), []
    for lang, text in sorted(texts):
        words = WORD.findall(text.lower())
        at = 0
        while at < len(words):
            n = int(rng.integers(4, SEQUENCE))
            pieces.append((languages.index(lang), words[at : at + n]))
            at += n
    buckets = min(BUCKETS, 1 << (MOST_WEIGHTS // max(k, 1)).bit_length() - 1)
    if not pieces:
        return Model(languages or ["und"], np.zeros((buckets, max(k, 1)), np.float32), np.zeros((max(k, 1), max(k, 1))))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in pieces for w in ws))}
    code, first = features(list(vocabulary))
    code %= buckets
    end = np.append(first[1:], len(code))
    size = (end - first).astype(np.float64)
    label, word = [], []
    # half the time the next piece is in the language of the last one, so that both ways occur
    by_lang = [[p for p in rng.permutation(len(pieces)) if pieces[p][0] == y] for y in range(k)]
    now = int(rng.integers(k))
    while any(by_lang):
        if not by_lang[now] or rng.random() < 0.5:
            now = int(rng.choice([y for y in range(k) if by_lang[y]]))
        y, ws = pieces[by_lang[now].pop()]
        label += [y] * len(ws)
        word += [vocabulary[w] for w in ws]
    n_seq = max(1, len(word) // SEQUENCE)
    take = np.resize(np.arange(len(word)), n_seq * SEQUENCE)
    label, word = np.array(label)[take].reshape(n_seq, SEQUENCE), np.array(word)[take].reshape(n_seq, SEQUENCE)
    weights, transitions = np.zeros((buckets, k)), np.zeros((k, k))
    sq_w, sq_t = np.full((buckets, k), 1e-6), np.full((k, k), 1e-6)
    eye = np.eye(k)
    for _ in range(EPOCHS):
        order = rng.permutation(n_seq)
        for lo in range(0, n_seq, BATCH):
            rows = order[lo : lo + BATCH]
            w, y = word[rows], label[rows]
            distinct, at = np.unique(w, return_inverse=True)
            idx = np.concatenate([np.arange(first[d], end[d]) for d in distinct])
            n_f = (end - first)[distinct]
            start = np.cumsum(n_f) - n_f
            emit = (np.add.reduceat(weights[code[idx]], start, axis=0) / np.sqrt(size[distinct])[:, None])[at.reshape(w.shape)]
            marginal, pair = _sequence_marginals(emit, transitions)
            grad = eye[y] - marginal
            g_word = np.zeros((len(distinct), k))
            np.add.at(g_word, at.reshape(-1), grad.reshape(-1, k))
            g_word /= np.sqrt(size[distinct])[:, None]
            spread = np.repeat(g_word, n_f, axis=0)
            touched, where = np.unique(code[idx], return_inverse=True)
            g = np.stack([np.bincount(where, spread[:, c], len(touched)) for c in range(k)], axis=1) / len(rows)
            g -= PENALTY * weights[touched]
            sq_w[touched] += g * g
            weights[touched] += RATE * g / np.sqrt(sq_w[touched])
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
            g_t = (seen - pair) / len(rows)
            sq_t += g_t * g_t
            transitions += RATE * g_t / np.sqrt(sq_t)
    return Model(languages, weights.astype(np.float32), transitions)


def _sequence_marginals(emit: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals, and expected transitions, of equally long sequences."""
    s, t_max, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, t_max):
        a = (alpha[:, t - 1] @ move) * e[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(t_max - 2, -1, -1):
        b = (e[:, t + 1] * beta[:, t + 1]) @ move.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    marginal = both / both.sum(axis=2, keepdims=True)
    right = e[:, 1:] * beta[:, 1:]
    joint = np.einsum("sti,stj->stij", alpha[:, :-1], right) * move
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return marginal, joint.sum(axis=(0, 1))


class Labeller:
    """Word distributions and the language of whole texts; emissions are kept in a bounded cache."""

    def __init__(self, model: Model, cached_words: int = 600_000):
        self.model, self.cached_words = model, cached_words
        self.known: dict[str, int] = {}
        self.emit = np.zeros((1024, len(model.languages)), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            fresh = list(dict.fromkeys(w for w in words if w not in known))
            if len(known) + len(fresh) > self.cached_words:
                known.clear()
                fresh = list(dict.fromkeys(words))
            base = len(known)
            known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            if len(known) > len(self.emit):
                grown = np.zeros((max(len(known), 2 * len(self.emit)), self.emit.shape[1]), np.float32)
                grown[:base] = self.emit[:base]
                self.emit = grown
            for lo in range(0, len(fresh), 50_000):
                part = fresh[lo : lo + 50_000]
                self.emit[base + lo : base + lo + len(part)] = self.model.emissions(part)
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def words(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All words, the distribution of each, and the number of words of each text."""
        found = [[w for w in WORD.findall(t.lower())] if isinstance(t, str) else [] for t in texts]
        found = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in found]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = [w for ws in found for w in ws]
        if not flat:
            return flat, np.zeros((0, len(self.model.languages))), count
        fresh = np.zeros(len(flat), bool)
        starts = np.cumsum(count) - count
        fresh[starts[count > 0]] = True
        return flat, forward_backward(self.emit_of(flat), fresh, self.model.transitions), count

    def emit_of(self, words: list[str]) -> np.ndarray:
        rows = self._rows(words)
        return self.emit[rows].astype(np.float64)

    def long_text(self, text: str, segment: int = SEGMENT) -> tuple[str, float]:
        """As ``texts`` for one text of any length: its words are gone through twice, a segment at a time."""
        lower, k = text.lower(), len(self.model.languages)

        def segments() -> Iterator[list[str]]:
            found = (m.group() for m in WORD.finditer(lower))
            while words := list(itertools.islice(found, segment)):
                yield words

        def begins(n: int, i: int) -> np.ndarray:
            return (np.arange(n) == 0) & (i == 0)

        across, letters, n = [], False, 0
        for i, ws in enumerate(segments()):
            letters = letters or any(c.isalpha() for w in ws for c in w)
            n += len(ws)
            # the last segment may not be of whole blocks
            across.append(crossing(self.emit_of(ws), begins(len(ws), i), self.model.transitions, 128 if len(ws) % 128 == 0 else 1))
        if not letters:
            return "und", 0.0
        enter, leave = [np.full(k, 1 / k)], [np.ones(k)]
        for m in across[:-1]:
            state = enter[-1] @ m
            enter.append(state / state.sum())
        for m in across[:0:-1]:
            state = m @ leave[-1]
            leave.append(state / state.sum())
        leave.reverse()
        total = np.zeros(k)
        for i, ws in enumerate(segments()):
            total += forward_backward(self.emit_of(ws), begins(len(ws), i), self.model.transitions, before=enter[i], after=None if i == len(across) - 1 else leave[i]).sum(axis=0)
        best = int(total.argmax())
        return self.model.languages[best], float(np.clip(total[best] / n, 0, 1))

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language (``und`` without letters) and mean probability of each text."""
        _, p, count = self.words(texts)
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        has = np.flatnonzero(count)
        if len(has):
            mean = np.add.reduceat(p, (np.cumsum(count) - count)[has], axis=0) / count[has, None]
            best = mean.argmax(axis=1)
            for i, b in zip(has, best, strict=True):
                lang[i] = self.model.languages[b]
            score[has] = np.clip(mean.max(axis=1), 0, 1)
        return lang, score


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Up to ``per_language`` distinct labelled texts of each language, chosen by a hash of the text.

    The hash is thinned by each language's count of distinct texts first, so no task ranks a whole language.
    A long text gives SAMPLE_CHARS characters, or fewer where the languages are so many that SAMPLE_TOTAL would be passed;
    the window is cut before texts move.
    """
    spread = 1 << 20
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    share = rows.select("lang", "h").distinct().groupBy("lang").agg((F.lit(8.0 * per_language * spread) / F.count("*")).alias("share"))
    share = durable(share, "language-counts")
    most = min(SAMPLE_CHARS, max(1, SAMPLE_TOTAL // (per_language * max(1, share.count()))))
    window = F.substring("text", (F.pmod("h", F.greatest(F.length("text") - most, F.lit(0)) + 1) + 1).cast("int"), F.lit(most))
    thin = rows.join(share, "lang").filter(F.pmod("h", F.lit(spread)) < F.col("share")).withColumn("text", window).dropDuplicates(["lang", "h"])
    ranked = thin.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= per_language)
    return [(r["lang"], r["text"]) for r in ranked.select("lang", "text").collect()]


def portions(texts: list[str | None], rows: int, chars: int) -> Iterator[tuple[int, int]]:
    """Spans of ``texts`` with at most so many rows and characters; a longer text is a span of its own."""
    lo = held = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > lo and (i - lo == rows or held + n > chars):
            yield lo, i
            lo, held = i, 0
        held += n
    if len(texts) > lo:
        yield lo, len(texts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 1000) -> DataFrame:
    """id, lang_pred and score of every row; only the text decides."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(held.value)
        for frame in frames:
            texts = frame["text"].tolist()
            for lo, hi in portions(texts, rows_at_once, CHARS_AT_ONCE):
                if hi - lo == 1 and isinstance(texts[lo], str) and len(texts[lo]) > CHARS_AT_ONCE:
                    lang, score = ([x] for x in labeller.long_text(texts[lo]))
                else:
                    lang, score = labeller.texts(texts[lo:hi])
                yield pd.DataFrame({"id": frame["id"].iloc[lo:hi], "lang_pred": lang, "score": score})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def languages(docs: DataFrame, per_language: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    The field is fitted on at most ``per_language`` texts of each language (of long ones, on
    a window), from rows whose id does not hash into the held-out quarter.  A null text, or one without letters, is
    ``und`` with score 0, as is every text if nothing can be learned.  Whole texts are
    read, however long; equal texts get equal answers; ties go to the language that sorts
    first.  An empty table gives an empty result; other columns are ignored.
    """
    model = fit(training_sample(docs, per_language, id_col, text_col, lang_col))
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
