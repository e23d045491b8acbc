"""Fingerprints, whitening and collocations against brute force and SQL, and on odd rows."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweir.llm import collocations, fingerprint, whitening
from graphweir.plans.durable import ROW
from tests.llm.test_operators import CLASH, DOCS, frame, odd_rows, words

VECS = "vec_id long, embedding array<float>, label int"


def sql_rows(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return con.sql(sql)


# --- 11 fingerprints


def plain_sketch(text, fraction=fingerprint.FRACTION):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    hashes = {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(len(w) - 4, min(len(w), 1)))}
    return sorted(h for h in hashes if int(h, 16) < fraction * 16**16)


@pytest.mark.parametrize("clash", [False, True])
def test_fingerprints_equal_brute_force(spark, clash):
    long = words(random.Random(5), 400_000)  # some 2 MB
    rows = [*odd_rows(), (20, "é" * 10, "fr", "a", 1), (21, "\U0001f600 b", "fr", "a", 1), (22, long, "en", "a", 1), (23, long + " more", "en", "a", 1)]
    out = fingerprint.fingerprints(frame(spark, rows, clash)).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    wanted = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 3
        e = t[: len(t) - cut] + after[:cut]
        a, b, c = plain_sketch(t), plain_sketch(e), plain_sketch(after)
        like = lambda x, y, same: 1.0 if same else len({*x} & {*y}) / max(1, len({*x} | {*y}))
        named = lambda s, x: hashlib.md5(s.encode()).hexdigest() + ":" + "".join(x)
        wanted[i, len(t), hashlib.sha256(e.encode()).hexdigest(), named(t, a), named(e, b), round(like(a, b, t == e), 9), round(like(a, c, t == after), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == wanted


def test_one_row_follows_itself_and_none_gives_none(spark):
    (one,) = fingerprint.fingerprints(frame(spark, [(1, "a b c d e f", None, None, None)])).collect()
    assert one.near_next == 1.0
    assert one.n_chars == 11 and one.edited_sha256 == hashlib.sha256("a b c d a b".encode()).hexdigest()
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0


def test_containment_of_unequal_texts_and_of_merged_sketches(spark):
    rng = random.Random(6)
    parts = [words(rng, 3000, 10**6) for _ in range(12)]
    rows = [("big", t) for t in parts] + [("small", parts[3]), ("other", words(rng, 3000, 10**6)), ("null", None)]
    each = spark.createDataFrame(rows, "k string, t string").select("k", fingerprint.sketch(F.coalesce("t", F.lit(""))).alias("sketch"))
    m = fingerprint.merged(each, ["k"])
    found = {(r.k, r.k2): r for r in fingerprint.containments(m, m.select(F.col("k").alias("k2"), "hash"), "k", "k2").collect()}
    assert found["small", "big"].a_in_b == 1.0 and abs(found["big", "small"].a_in_b - 1 / 12) < 0.03
    assert ("other", "big") not in found and ("null", "big") not in found
    assert abs(found["big", "big"].common / (12 * 2996) - 1 / 8) < 0.01  # the fixed fraction, whatever the size


def test_fingerprints_equal_sql(spark):
    docs = frame(spark, [r for r in odd_rows() if r[0] != 8])
    out, there = fingerprint.fingerprints(docs).drop(ROW), sql_rows(fingerprint.SQL, docs)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(there.fetchall(), key=key) and out.columns == there.columns


# --- 12 whitening


def test_error_free_transformations():
    rng = np.random.default_rng(1)
    a, b = (rng.normal(size=500) * 10.0 ** rng.integers(-20, 20, 500) for _ in range(2))
    for (p, e), exact in ((whitening.two_sum(a, b), lambda x, y: x + y), (whitening.two_product(a, b), lambda x, y: x * y)):
        assert all(Fraction(x) + Fraction(y) == exact(Fraction(u), Fraction(v)) for x, y, u, v in zip(p, e, a, b))
    hi, lo = whitening.summed((np.array([[1e30], [1.0], [-1e30], [1e-10]] * 5), np.zeros((20, 1))))
    assert abs(Fraction(hi[0]) + Fraction(lo[0]) - (5 + 5 * Fraction(1e-10))) < Fraction(1, 10**12)


def brute(vectors, k=8):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    dev = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    z = np.array([[n * r[i] - s[i] for i in range(d)] for r in x], dtype=object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in z.T @ z])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q.T[::-1][:k]
    return n, dev, v, e, q, np.array(z, dtype=float) / n


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) * np.linspace(1, 0.01, 12)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(data)]
    out = whitening.whitened(spark.createDataFrame(rows, VECS).repartition(7)).toPandas()
    n, dev, v, e, q, z = brute(data)
    assert len(out) == 700 * 8 and set(out.n) == {n} and out.identity_error.max() < 1e-9
    for k in range(8):
        mine = out[out.component == k + 1].sort_values("vec_id")
        assert mine.deviation.tolist() == dev
        want = z @ q[k] / np.sqrt(e[k])
        assert min(np.abs(mine.whitened - want).max(), np.abs(mine.whitened + want).max()) < 1e-7
        assert np.allclose(mine.explained, e[k] / np.trace(v), rtol=1e-9)


def test_nearly_parallel_vectors_keep_their_small_components(spark):
    """A spread of some units beside one of millions: centred sums of plain doubles would lose it."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**20), 2**20, 500) / 1.0
    data = np.stack([base, base + rng.integers(-2, 3, 500) / 1024, rng.integers(-3, 4, 500) / 1024], axis=1)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    whole = df.select(F.lit(3).alias("dims"), F.transform("embedding", lambda c: F.floor(c * 1024) + 100000).alias("x"))
    means = whitening.integer_means(whole, "x")
    (p,) = whitening.outer_products(whitening.centred(whole, means.select("dims", "mean_hi", "mean_lo"), "x").select("dims", "hi", "lo")).collect()
    x = [[Fraction(int(c * 1024) + 100000) for c in v] for v in data]
    m = [sum(r[i] for r in x) / len(x) for i in range(3)]
    for (i, j), hi, lo in zip(zip(*np.triu_indices(3)), p.hi, p.lo):
        exact = sum((r[i] - m[i]) * (r[j] - m[j]) for r in x)
        size = sum(abs((r[i] - m[i]) * (r[j] - m[j])) for r in x)
        assert abs(Fraction(hi) + Fraction(lo) - exact) < size / 10**25


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [3.0, -1.0], 0), (None, [0.5, 0.25], None), (3, None, 0), (4, [], 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [4.0], 0), (9, [3e38, 1.0, 1.0], 0), (10, [0.0] * 9, 1), (11, [0.0] * 9, 1)]
    df = spark.createDataFrame(rows, VECS).withColumns({c: F.lit("x") for c in [*CLASH, "dims", "hi", "lo", "x", "v", "w", "vectors", "values", "sums", "mean_hi"]})
    out = whitening.whitened(df).toPandas()
    assert out.groupby("dims").size().to_dict() == {1: 1, 2: 8, 3: 3, 9: 16}
    assert not out.whitened.isna().any() and (out[out.dims.isin([1, 3, 9])].whitened == 0).all()
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    assert whitening.whitened(spark.createDataFrame([], VECS)).count() == 0


# --- 13 collocations


def online_automaton(pieces, depth):
    """Endpos sizes of all phrases by the textbook construction, one word after the other, over all pieces."""
    length, link, step, ends = [0], [-1], [{}], [0]
    for piece in pieces:
        last = 0
        for c in piece:
            if c in step[last] and length[step[last][c]] == length[last] + 1:
                last = step[last][c]
                ends[last] += 1
                continue
            length.append(length[last] + 1), link.append(0), step.append({}), ends.append(1)
            cur, p = len(length) - 1, last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    length.append(length[p] + 1), link.append(link[q]), step.append(dict(step[q])), ends.append(0)
                    clone = len(length) - 1
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
    order = sorted(range(1, len(length)), key=lambda s: -length[s])
    for s in order:
        ends[link[s]] += ends[s]
    found = Counter()
    walk = [((), 0)]
    while walk:
        phrase, s = walk.pop()
        if phrase:
            found[phrase] = ends[s]
        if len(phrase) < depth:
            walk += [((*phrase, c), t) for c, t in step[s].items()]
    return found


@pytest.mark.parametrize("seed", range(6))
def test_states_equal_counts_and_the_online_construction(seed):
    rng, depth = random.Random(seed), 3
    pieces = [[b"abcdefgh"[k : k + 1] for k in (rng.randrange(2 + seed) for _ in range(rng.randrange(12)))] for _ in range(40)]
    shard = collocations.Shard(depth)
    shard.add([w for p in pieces for w in (*p, b".")], 0)
    spelled = list(shard.vocabulary)
    mine = {}
    for n in range(1, depth + 1):
        ids, sizes = shard.automaton().phrases(n)
        for *w, s in zip(*ids, sizes):
            assert tuple(spelled[i] for i in w) not in mine
            mine[tuple(spelled[i] for i in w)] = int(s)
    plain = Counter(tuple(p[i : i + n]) for p in pieces for n in range(1, depth + 1) for i in range(len(p) - n + 1))
    assert mine == plain == online_automaton(pieces, depth)
    states = shard.automaton().states
    assert sum(len(s[0]) for s in states.values()) <= len(plain)  # classes, not phrases


ODD_TEXTS = [
    (1, "New York, new york! NEW YORK. new\tyork new york; ÉA éa " * 5, "en", "a", 0), (1, "New York, new york! NEW YORK. new\tyork new york; ÉA éa " * 5, "en", "a", 0),
    (2, None, "en", "a", 0), (3, "", None, None, 0), (4, "a a a a a b " * 40 + "\x0b" + "x y z.\r\nx y z\x0c" * 30, None, "b", 0), (5, "x y z " * 20, "und", "b", 0), (None, "中 文 中 文 . 中 文  中 文 " * 12, "zh", None, 0),
]


@pytest.mark.parametrize("limits", [None, (7, 16)])
def test_collocations_equal_sql(spark, monkeypatch, limits):
    rng = random.Random(8)
    common = ["of the", "in spite of", "x", "y", "as well as", "z.", "Q"]
    rows = [*ODD_TEXTS, *[(10 + i, " ".join(rng.choice(common) for _ in range(60)), rng.choice(["en", "de"]), "s", 0) for i in range(30)]]
    if limits:  # shards and blocks of a few words
        monkeypatch.setattr(collocations, "PLACES", limits[0]), monkeypatch.setattr(collocations, "CHUNK", limits[1])
        lists = list(collocations.shards(iter(batches(rows)), 3))
        counts = Counter()
        for lang, shard in lists:
            assert shard.n <= limits[0]
            spelled = list(shard.vocabulary)
            for n in (1, 2, 3):
                ids, sizes = shard.automaton().phrases(n)
                for *w, s in zip(*ids, sizes):
                    counts[lang, b" ".join(spelled[i] for i in w)] += int(s)
        assert counts == plain_counts(rows)
        return
    docs = frame(spark, rows, clash=True)
    out, there = collocations.collocations(docs), sql_rows(collocations.SQL, frame(spark, rows))
    assert sorted(map(tuple, out.collect())) == sorted(there.fetchall()) and out.columns == there.columns
    assert {r.lang for r in out.collect()} >= {"en", "de", "und", "zh"}


def batches(rows):
    import pyarrow as pa

    return [pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([(r[1] or "").encode() for r in rows], pa.binary())], ["lang", "text"])]


def plain_counts(rows):
    out = Counter()
    for _, text, lang, *_ in rows:
        lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(rb"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    out[lang or "und", b" ".join(w[i : i + n])] += 1
    return out


def test_collocations_of_nothing_and_exact_scores(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    big = 3_000_000_000
    assert collocations.collocations(frame(spark, [(1, "a b " * 3, "en", "a", 0)])).count() == 0
    score = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 1).alias("l"), F.lit(big + 7).alias("r")).select(F.expr(collocations.SCORE)).first()[0]
    assert score == 10**6 * big * big // ((big + 1) * (big + 7))
