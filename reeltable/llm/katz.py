"""LM scoring with a Katz backoff bigram model: Good-Turing discounted counts, exactly normalised backoff weights.

P(w | v) = d(c) c / c(v) for a bigram seen c times in training, else a(v) P(w). The word level backs off in turn: seen
words keep their discounted share, and what the discount frees goes to one class for all unknown words.
a(v) = (1 - sum of seen P(. | v)) / (1 - sum of P over the same words), so each context's probabilities sum to 1; a
context whose counts are all above the discounted range gives up 1 / (c(v) + 1) of its mass.

Documents are cut into batches of about TOKENS tokens, each one row of a written table with its own vocabulary. Counts
are summed a batch first, then by key in buckets, which store the model as partitioned tables: words with their counts,
and bigrams with theirs (`word_table` and `bigram_table` read them). Twice a batch asks and gets answers, in key order:
its words' counts and numbers from word buckets, then its bigrams' counts and contexts' sums from bigram buckets; a token
is then scored by its bigram, or by its word and the context's backoff weight. So what is shuffled is each batch's
distinct keys, as arrays of numbers, and not a row for each token: a row for each bucket that a batch has keys of, so
never more rows than distinct keys of batches, however many batches and buckets there are. The number of buckets, and
with it that of the exchanges' partitions, follows the input, so a task's share stays as it is when the input grows.
Contexts that hold a large share of the corpus (at most 4 a bucket) are spread over all buckets and only their sums, a
row each, are put together again. Counts of counts and those sums alone reach the driver: K + 2 numbers a spread context.

The order is two: a third one would shuffle each batch's trigrams with the probabilities below them, which takes more disk
than four times the input (see the README). Words are told apart by 64-bit hashes.

Defined results: a null or empty text is its end token alone. A null doc_id counts as the text "" for the split. Rows
that repeat a doc_id are documents of their own. A very long text makes a batch of its own. Words of equal counts are
numbered in the order of their hashes. An empty table gives an empty result. Only doc_id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltable.llm.common import own_names, table, written

TOKENS, FOLDS, HELD_OUT = 3 << 20, 7, 2
#: Counts up to K are discounted. Keys a bucket should hold.
K, KEYS_PER_BUCKET = 5, 1 << 21
END = b" "  # no word holds a space
WORD_CACHE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def packed(a: np.ndarray) -> bytes:
    """An array of numbers, its bytes by significance, compressed."""
    a = np.ascontiguousarray(a)
    body = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return a.dtype.str.encode() + b" " + zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(b: bytes) -> np.ndarray:
    kind, _, body = bytes(b).partition(b" ")
    dtype = np.dtype(kind.decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def small(a: np.ndarray) -> np.ndarray:
    """a in the narrowest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def mixed(a: np.ndarray, n: int) -> np.ndarray:
    """A bucket below n for each of a."""
    x = a.astype(np.uint64) * MIX
    return ((x ^ (x >> np.uint64(31))) * MIX >> np.uint64(33)).astype(np.int64) % n


BATCHES = "batch long, doc_ids array<long>, sizes binary, vocab binary, counts binary, tokens binary, n_vocab long, n_tokens long"


def batches_of(docs: DataFrame, per_batch: int = TOKENS) -> DataFrame:
    """Rows of about per_batch tokens: documents, their sizes, the sorted word hashes, training counts, tokens as places among the hashes."""

    def row(number: int, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        vocab, tokens = np.unique(hashes, return_inverse=True)
        trains = np.repeat(np.array([not held_out(i) for i in ids]), sizes)
        counts = np.bincount(tokens[trains], minlength=len(vocab))
        return pa.RecordBatch.from_pydict({
            "batch": pa.array([number], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([packed(small(sizes))]), "vocab": pa.array([packed(vocab)]),
            "counts": pa.array([packed(small(counts))]), "tokens": pa.array([packed(small(tokens))]), "n_vocab": pa.array([len(vocab)], pa.int64()), "n_tokens": pa.array([len(tokens)], pa.int64())})

    def gather(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, ids, parts, held, cache = TaskContext.get().partitionId(), 0, [], [], 0, {}
        get, h = cache.get, xxhash.xxh64_intdigest
        end = h(END)
        for batch in arrow:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                found = list(map(get, words))
                if None in found:
                    if len(cache) > WORD_CACHE:
                        cache.clear()
                    for w in words:
                        if w not in cache:
                            cache[w] = h(w)
                    found = list(map(get, words))
                found.append(end)
                ids.append(doc_id.as_py())
                parts.append(np.array(found, dtype=np.uint64))
                held += len(found)
                if held >= per_batch:
                    yield row(task << 32 | n, ids, parts)
                    n, ids, parts, held = n + 1, [], [], 0
        if ids:
            yield row(task << 32 | n, ids, parts)

    chosen = own_names(docs, "doc_id", "text")
    return chosen.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(gather, BATCHES)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) for each bucket that has some, places in order."""
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            yield int(bucket[order[a]]), order[a:b]


MODEL = -1  # in place of a batch: the row is a bucket's part of the model


ANSWERS = "batch long, level int, bucket int, a binary, b binary, c binary, stats array<long>, hot array<double>"


def answer_words(batches: DataFrame, buckets: int) -> DataFrame:
    """For each batch and bucket: the words' numbers (from 1, frequent ones small) and counts, in the order of the batch's
    hashes. stats, once a bucket: tokens, distinct words, words counted 1 to K + 1 times."""

    def ask(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples():
                vocab, counts = unpacked(r.vocab), unpacked(r.counts)
                asked = [(b, r.batch, packed(vocab[at]), packed(counts[at])) for b, at in by_bucket(mixed(vocab, buckets))]
                yield pd.DataFrame(asked, columns=["bucket", "batch", "keys", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked(k) for k in pdf["keys"]]
        vocab, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([unpacked(c) for c in pdf["counts"]]), minlength=len(vocab)).astype(np.int64)
        rank = np.empty(len(vocab), dtype=np.int64)
        rank[np.lexsort((vocab, -counts))] = np.arange(len(vocab))
        bucket = int(pdf["bucket"].iloc[0])
        numbers = (1 + bucket + buckets * rank).astype(np.uint64)
        stats = [int(counts.sum()), int((counts > 0).sum()), *(int((counts == k).sum()) for k in range(1, K + 2))]
        out, at = [(MODEL, 1, bucket, packed(vocab), packed(small(numbers)), packed(small(counts)), stats, None)], 0
        for batch, k in zip(pdf["batch"], keys, strict=True):
            p = place[at : at + len(k)]
            at += len(k)
            out.append((batch, 1, bucket, packed(small(numbers[p])), packed(small(counts[p])), None, None, None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    asked = batches.select("batch", "vocab", "counts").mapInPandas(ask, "bucket int, batch long, keys binary, counts binary")
    return asked.repartition(2 * buckets, "bucket").groupBy("bucket").applyInPandas(answer, ANSWERS)


def discounts(counted: list[int]) -> np.ndarray:
    """d(c) for c = 0..K by Good-Turing in Katz's form, from how many keys were counted 1 to K + 1 times. Where the counts
    of counts don't give a share between 0 and 1, half a count is taken off."""
    d = np.array([1.0] + [(r - 0.5) / r for r in range(1, K + 1)])
    n = [0, *counted]
    if n[1] and n[1] > (K + 1) * n[K + 1]:
        cut = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r]:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                if 0 < x < 1:
                    d[r] = x
    return d


class Words:
    """The word level: log10 P by count, and the numbers that the whole corpus gives."""

    def __init__(self, stats: list[int]):
        self.n, self.v, self.d = stats[0], stats[1], discounts(stats[2:])
        n_r = np.array([0, *stats[2 : 2 + K]])
        freed = float((n_r * np.arange(K + 1) * (1 - self.d)).sum()) / self.n if self.n else 1.0
        self.scale = 1.0 if freed > 0 else self.n / (self.n + 1)  # no count is discounted: one token's worth goes to the unknown
        self.unknown = freed if freed > 0 else 1 / (self.n + 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(float)
        d = self.d[np.minimum(counts, K)]
        d = np.where(counts > K, 1.0, d)
        return np.where(counts > 0, d * c / max(self.n, 1) * self.scale, self.unknown)


def _numbered(vocab: np.ndarray, answers: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a batch's words, from its answers."""
    numbers, counts = np.zeros(len(vocab), np.uint64), np.zeros(len(vocab), np.int64)
    by = {int(b): (x, y) for b, x, y in zip(answers["bucket"], answers["a"], answers["b"], strict=True)}
    for b, at in by_bucket(mixed(vocab, buckets)):
        numbers[at], counts[at] = unpacked(by[b][0]), unpacked(by[b][1])
    return numbers, counts


def _bigrams(tokens: np.ndarray, sizes: np.ndarray, n_vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's distinct bigrams as (context, word) among its words, n_vocab being a text's start, and each token's bigram."""
    before = np.empty(len(tokens), dtype=np.int64)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = n_vocab
    keys, place = np.unique(before * (n_vocab + 1) + tokens, return_inverse=True)
    return keys // (n_vocab + 1), keys % (n_vocab + 1), place


def _bucketed(contexts: np.ndarray, words: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    spread = np.isin(contexts, hot)
    return mixed(np.where(spread, contexts * MIX + words, contexts), buckets)


def by_batch(batches: DataFrame, answers: DataFrame, n: int):
    """Each batch with its answers, in partitions of about half a batch."""
    return batches.repartition(2 * n, "batch").groupBy("batch").cogroup(answers.where(F.col("batch") != MODEL).repartition(2 * n, "batch").groupBy("batch"))


def answer_bigrams(batches: DataFrame, words: DataFrame, level: Words, word_buckets: int, buckets: int, hot: list[int], n_batches: int) -> DataFrame:
    """For each batch and bucket: a, the bigrams' counts; b, the contexts' sums, in the order of the batch's bigrams.

    A context's sums: its bigrams counted 1 to K times, the sum of larger counts, and sum P(w) over its seen words (c).
    stats: bigrams counted 1 to K + 1 times; hot: number and sums of this bucket's part of the spread contexts."""
    hot_a = np.array(sorted(hot), dtype=np.uint64)

    def ask(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples():
            vocab, tokens, sizes = unpacked(r.vocab), unpacked(r.tokens).astype(np.int64), unpacked(r.sizes).astype(np.int64)
            numbers, counts = _numbered(vocab, answers, word_buckets)
            v, w, place = _bigrams(tokens, sizes, len(vocab))
            trains = np.repeat(np.array([not held_out(i) for i in r.doc_ids]), sizes)
            seen = np.bincount(place[trains], minlength=len(v))
            gv, gw = np.append(numbers, np.uint64(0))[v], numbers[w]
            for b, at in by_bucket(_bucketed(gv, gw, hot_a, buckets)):
                out.append((b, r.batch, packed(small(gv[at])), packed(small(gw[at])), packed(small(seen[at])), packed(small(counts[w[at]]))))
        return pd.DataFrame(out, columns=["bucket", "batch", "v", "w", "seen", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        vs, ws = [unpacked(x).astype(np.uint64) for x in pdf["v"]], [unpacked(x).astype(np.uint64) for x in pdf["w"]]
        v, w = np.concatenate(vs), np.concatenate(ws)
        if int(v.max()) >> 32 or int(w.max()) >> 32:  # numbers too wide to share one key
            contexts, v_place = np.unique(v, return_inverse=True)
            others, w_place = np.unique(w, return_inverse=True)
            keys, place = np.unique(v_place * np.int64(len(others)) + w_place, return_inverse=True)
            key_v = contexts[keys // len(others)]
        else:
            keys, place = np.unique(v << np.uint64(32) | w, return_inverse=True)
            key_v = keys >> np.uint64(32)
        counts = np.bincount(place, weights=np.concatenate([unpacked(x) for x in pdf["seen"]]), minlength=len(keys)).astype(np.int64)
        uni = np.zeros(len(keys), np.int64)
        uni[place] = np.concatenate([unpacked(x) for x in pdf["counts"]])
        contexts, of = np.unique(key_v, return_inverse=True)
        sums = np.zeros((K + 1, len(contexts)), np.int64)
        for k in range(1, K + 1):
            sums[k - 1] = np.bincount(of[counts == k], minlength=len(contexts))
        sums[K] = np.bincount(of, weights=np.where(counts > K, counts, 0), minlength=len(contexts)).astype(np.int64)
        mass = np.bincount(of, weights=np.where(counts > 0, level.p(uni), 0), minlength=len(contexts))
        stats = [int((counts == k).sum()) for k in range(1, K + 2)]
        spread = np.flatnonzero(np.isin(contexts, hot_a))
        parts = np.column_stack([contexts[spread].astype(float), sums[:, spread].T, mass[spread]]).ravel().tolist()
        bucket, at, key_w = int(pdf["bucket"].iloc[0]), 0, np.zeros(len(keys), np.uint64)
        key_w[place] = w
        known = counts > 0
        out = [(MODEL, 2, bucket, packed(small(key_v[known])), packed(small(key_w[known])), packed(small(counts[known])), stats, parts)]
        for batch, x in zip(pdf["batch"], vs, strict=True):
            own = place[at : at + len(x)]
            at += len(x)
            first = np.flatnonzero(np.diff(x, prepend=x[:1] + np.uint64(1)) != 0)  # each context's first bigram
            c = of[own[first]]
            out.append((batch, 2, bucket, packed(small(counts[own])), packed(small(sums[:, c].ravel())), packed(mass[c]), None, None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    asked = by_batch(batches, words, n_batches).applyInPandas(ask, "bucket int, batch long, v binary, w binary, seen binary, counts binary")
    return asked.repartition(2 * buckets, "bucket").groupBy("bucket").applyInPandas(answer, ANSWERS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores_of(batches: DataFrame, answers: DataFrame, level: Words, bigram_stats: list[int], word_buckets: int, buckets: int, hot: dict[int, list[float]], n_batches: int) -> DataFrame:
    d = discounts(bigram_stats)
    hot_a = np.array(sorted(hot), dtype=np.uint64)

    def weights(sums: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of what a seen count is divided by, and of the backoff weight, for each context."""
        r = np.arange(1, K + 1)[:, None]
        total = (sums[:K] * r).sum(axis=0) + sums[K]
        kept = (sums[:K] * r * d[1:, None]).sum(axis=0) + sums[K]
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(kept < total * (1 - 1e-12), 1.0, total / (total + 1.0))
            share = np.where(total > 0, kept / total * scale, 0.0)
            alpha = np.where(total > 0, (1 - share) / (1 - mass), 1.0)
            return np.where(total > 0, np.log10(total / scale), 0.0), np.log10(alpha)

    def score(batch: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in batch.itertuples():
            vocab, tokens, sizes = unpacked(row.vocab), unpacked(row.tokens).astype(np.int64), unpacked(row.sizes).astype(np.int64)
            numbers, counts = _numbered(vocab, got[got["level"] == 1], word_buckets)
            v, w, place = _bigrams(tokens, sizes, len(vocab))
            gv = np.append(numbers, np.uint64(0))[v]
            of = {int(b): (x, y, z) for lv, b, x, y, z in zip(got["level"], got["bucket"], got["a"], got["b"], got["c"], strict=True) if lv == 2}
            seen, under, alpha = np.zeros(len(v), np.int64), np.zeros(len(v)), np.zeros(len(v))
            for b, at in by_bucket(_bucketed(gv, numbers[w], hot_a, buckets)):
                x = gv[at]
                new = np.diff(x, prepend=x[:1] + np.uint64(1)) != 0
                mass = unpacked(of[b][2])
                sums = unpacked(of[b][1]).reshape(K + 1, -1).astype(float)
                for h in np.flatnonzero(np.isin(x[new], hot_a)):  # at most as many as there are spread contexts
                    whole = hot[int(x[new][h])]
                    sums[:, h], mass[h] = whole[:-1], whole[-1]
                below, back = weights(sums, mass)
                context = np.cumsum(new) - 1
                seen[at], under[at], alpha[at] = unpacked(of[b][0]), below[context], back[context]
            with np.errstate(divide="ignore"):
                log_seen = np.log10(np.where(seen > K, 1.0, d[np.minimum(seen, K)]) * seen) - under
            logs = np.where(seen > 0, log_seen, alpha + np.log10(level.p(counts))[w])
            base = np.log10((counts + 1) / (level.n + level.v + 1))
            starts = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has a token
            ids = list(row.doc_ids)
            out.append(pd.DataFrame({
                "doc_id": pd.array(ids, dtype="Int64"), "held_out": [held_out(i) for i in ids], "n_tokens": sizes, "n_known": total((counts > 0)[tokens].astype(np.int64)), "train_tokens": level.n,
                "base_score": total(base[tokens]), "score": total(logs[place])}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in SCORES.split(", ")])

    return by_batch(batches, answers, n_batches).applyInPandas(score, SCORES)


def _summed(answers: DataFrame, n: int) -> list[int]:
    stats = answers.where("stats is not null").agg(*(F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(n))).first()
    return [int(x) for x in stats]


def score_documents(docs: DataFrame, per_batch: int = TOKENS, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each of docs."""
    batches = written(batches_of(docs, per_batch))
    size = batches.agg(F.coalesce(F.sum("n_vocab"), F.lit(0)).alias("v"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    n = max(1, size["n"])
    word_buckets = max(1, math.ceil(size["v"] / keys_per_bucket))
    buckets = max(1, math.ceil(size["t"] / keys_per_bucket))
    words = written(answer_words(batches, word_buckets))
    level = Words(_summed(words, K + 3))
    hot = hot_contexts(words, level.n, buckets)
    bigrams = written(answer_bigrams(batches, words, level, word_buckets, buckets, hot, n))
    return scores_of(batches, words.unionByName(bigrams), level, _summed(bigrams, K + 1), word_buckets, buckets, spread_sums(bigrams) if hot else {}, n)


def word_table(words: DataFrame) -> DataFrame:
    """The stored words: hash, number, and count in training."""

    def read(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for a, b, c in zip(pdf["a"], pdf["b"], pdf["c"], strict=True):
                yield pd.DataFrame({"word": unpacked(a).view(np.int64), "number": unpacked(b).astype(np.int64), "count": unpacked(c).astype(np.int64)})

    return words.where(F.col("batch") == MODEL).select("a", "b", "c").mapInPandas(read, "word long, number long, count long")


def bigram_table(bigrams: DataFrame) -> DataFrame:
    """The stored bigrams: numbers of context (0: a text's start) and word, and count in training."""

    def read(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for a, b, c in zip(pdf["a"], pdf["b"], pdf["c"], strict=True):
                yield pd.DataFrame({"context": unpacked(a).astype(np.int64), "word": unpacked(b).astype(np.int64), "count": unpacked(c).astype(np.int64)})

    return bigrams.where(F.col("batch") == MODEL).select("a", "b", "c").mapInPandas(read, "context long, word long, count long")


def spread_sums(bigrams: DataFrame) -> dict[int, list[float]]:
    """The whole sums of the spread contexts, at most 4 rows a bucket."""
    width = K + 3
    places = F.sequence(F.lit(0), (F.size("hot") / width).cast("int") - 1)
    parts = bigrams.where(F.size("hot") > 0).select(F.explode(F.transform(places, lambda i: F.slice("hot", i * width + 1, width))).alias("p"))
    sums = parts.groupBy(F.get("p", F.lit(0)).alias("n")).agg(*(F.sum(F.get("p", F.lit(i))).alias(f"x{i}") for i in range(1, width)))
    return {int(r[0]): [float(x) for x in r[1:]] for r in sums.collect()}


def hot_contexts(words: DataFrame, n: int, buckets: int) -> list[int]:
    """Numbers of words with over 1 / (4 * buckets) of all training tokens, at most 4 * buckets of them."""
    least = n / (4 * buckets)

    def over(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                counts = unpacked(b)
                yield pd.DataFrame({"number": unpacked(a)[counts > least].astype(np.int64)})

    model = words.where(F.col("batch") == MODEL)
    return [r[0] for r in model.select(F.col("b").alias("a"), F.col("c").alias("b")).mapInPandas(over, "number long").distinct().collect()]


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
