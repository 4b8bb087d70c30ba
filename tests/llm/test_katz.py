import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reeltable.llm import katz

VOCAB = [f"w{i}" for i in range(40)]


def texts(n, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        size = int(rng.integers(0, 60))
        words = [VOCAB[min(39, int(rng.exponential(6)))] for _ in range(size)]
        if i % 9 == 0:
            words.append(f"Rare{i}")
        out.append((i, " ".join(words) if i % 11 else None))
    return out


def discounted(counts):
    n = Counter(counts)
    d = {r: (r - 0.5) / r for r in range(1, katz.K + 1)}
    if n[1] > (katz.K + 1) * n[katz.K + 1]:
        cut = (katz.K + 1) * n[katz.K + 1] / n[1]
        for r in d:
            if n[r]:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                if 0 < x < 1:
                    d[r] = x
    return lambda c: d.get(c, 1.0)


def brute(docs):
    toks = {i: [*(t or "").encode().lower().split(), b" "] for i, t in docs}  # bytes: A-Z only, ASCII white space only
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi = Counter(w for i in train for w in toks[i]), Counter(p for i in train for p in zip(["<s>", *toks[i]], toks[i]))
    n, v = sum(uni.values()), len(uni)
    d1, d2 = discounted(uni.values()), discounted(bi.values())
    freed = sum(c * (1 - d1(c)) for c in uni.values()) / n
    p1 = lambda w: d1(uni[w]) * uni[w] / n if uni[w] else freed
    followers = defaultdict(dict)
    for (a, b), c in bi.items():
        followers[a][b] = c

    def p2(a, b):
        f = followers.get(a)
        if not f:
            return p1(b)
        total = sum(f.values())
        kept = sum(d2(c) * c for c in f.values())
        scale = 1.0 if kept < total * (1 - 1e-12) else total / (total + 1)
        if b in f:
            return d2(f[b]) * f[b] / total * scale
        return alpha(a, kept, total, scale) * p1(b)

    alphas = {}

    def alpha(a, kept, total, scale):
        if a not in alphas:
            alphas[a] = (1 - kept / total * scale) / (1 - sum(map(p1, followers[a])))
        return alphas[a]

    for a in list(followers)[:20]:  # exactly normalised: all words and the unknown class sum to 1
        assert sum(p2(a, b) for b in [*uni, b"never seen"]) == pytest.approx(1)
    out = {}
    for i, ws in toks.items():
        out[i] = (i not in train, len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws), sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *ws], ws)))
    return out


@pytest.mark.parametrize(("per_batch", "keys"), [(1 << 20, 1 << 20), (300, 700)])
def test_scores_equal_brute_force(spark, per_batch, keys):
    docs = texts(160)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in katz.score_documents(df, per_batch, keys).collect()}
    want = brute(docs)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-6), i


def test_query_equals_brute_force(spark):
    """The registered query over its whole table."""
    from reeltable.llm import registry
    from tests.compare import DATA, connect

    want = brute(connect().sql("SELECT doc_id, text FROM documents").fetchall())
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op3_katz_scores"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-6), i


def test_tables_hold_the_counts(spark):
    docs = texts(160)
    batches = katz.written(katz.batches_of(spark.createDataFrame(docs, "doc_id long, text string"), 300))
    words = katz.written(katz.answer_words(batches, 3))
    level = katz.Words(katz._summed(words, katz.K + 3))
    bigrams = katz.written(katz.answer_bigrams(batches, words, level, 3, 2, katz.hot_contexts(words, level.n, 2), batches.count()))
    train = [[w.lower() for w in (t or "").split()] + ["<end>"] for i, t in docs if not katz.held_out(i)]
    uni, bi = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip(["<s>", *ws], ws))
    assert Counter(r["count"] for r in katz.word_table(words).collect() if r["count"]) == Counter(uni.values())
    assert Counter(r["count"] for r in katz.bigram_table(bigrams).collect()) == Counter(bi.values())


def test_spread_contexts_are_used(spark):
    df = spark.createDataFrame(texts(160), "doc_id long, text string")
    batches = katz.batches_of(df, 300)
    words = katz.answer_words(batches, 2)
    assert katz.hot_contexts(words, 4000, 8)


def test_held_out_beats_base(spark):
    rng = np.random.default_rng(3)
    chain = lambda: " ".join(VOCAB[(k + int(rng.integers(0, 2))) % 40] for k in range(int(rng.integers(5, 60))))
    df = spark.createDataFrame([(i, chain()) for i in range(300)], "doc_id long, text string")
    held = [r for r in katz.score_documents(df).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, "x"), (1, "a  b\tc", "y"), (1, "a  b\tc", "y"), (2, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = katz.score_documents(df).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in got) == [(False, 1), (False, 4), (False, 4), (True, 1)]
    assert katz.score_documents(df.limit(0)).collect() == []
