"""Cross-tokenizer alignment: where two tokenizers' tokens of a text end together, and which tokens do so how often.

Tokenizer A is a byte-level BPE, B a BPE of pieces with byte fallback. Each text, with a space before it, is told in the
bytes of both. Groups lie between the byte offsets where tokens of both end, found by divide and conquer: each interval of A's tokens
looks for a common end near its middle (a bisection of B's ends), goes outward from there until it has one, and both halves go on;
intervals without one are leaf groups. All open intervals of a batch of texts take a step at once, as arrays.

Batches of about BATCH_CHARS characters are a row each of a written table: the batch's different (A, B) pairs of tokens that end together with
their counts, and for each text which of them it has. Counts add up by pair over the corpus; each batch then asks for those
of its own pairs, so no corpus-wide table is held or sent whole. What is sent whole is the highest count of each B token,
of which there are at most as many as B's vocabulary has.

Both tokenizers join nothing across a space between two characters that aren't white space, so tokens are kept by such words; a test
holds that against the whole tokenizers. A's words are told by ranks, which are the same vocabulary and merges.

Defined results: null and empty texts, and texts that B can't give back byte for byte, have no tokens: zeros and an empty
string. Repeated rows, and rows without doc_id, are texts of their own, each of which counts. Special tokens' strings are plain text. A very long text is
a batch of its own. An empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltable.llm.common import own_names, table, written

BATCH_CHARS, WORD_CACHE = 1 << 22, 1 << 18
B_BITS = 16  # a pair is A's id, then B's in so many bits
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizers() -> tuple[str, str]:
    """A's ranks and B's model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class TwoTokenizers:
    """Ids of both for texts, kept by word."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if len(self.b_bytes) > 1 << B_BITS or len(self.a_bytes) > 1 << 16 or b"" in self.b_bytes:
            raise ValueError("ids have to fit into 16 bits, and each piece has to have a byte")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.a_bytes, self.b_bytes))
        #: What a token reads as in the digest, by twice its id and whether a group ends: A's, then B's.
        self.said = [f"{i}{end}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for end in ends]
        self.words_a: dict[str, bytes | None] = {}
        self.words_b: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> Iterator[tuple[bytes | None, bytes]]:
        """Ids of both for a space and each word, two bytes each; None for a word that isn't given back."""
        pack = lambda ids: np.array(ids, dtype=np.uint16).tobytes()
        for word, b in zip(words, self.b.encode(words, num_threads=1), strict=True):
            a, whole = self.a.encode_ordinary(" " + word), (" " + word).encode()
            same = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
            yield (pack(a), pack(b)) if same else (None, b"")

    def learn(self, words: set[str]) -> None:
        """Keeps the ids of new words that neither begin nor end with white space."""
        new = [w for w in words if w not in self.words_a and w and not w[0].isspace() and not w[-1].isspace()]
        for word, (a, b) in zip(new, self.ids(new), strict=True):
            self.words_a[word], self.words_b[word] = a, b

    def tokens(self, text: str, words: list[str]) -> tuple[bytes, bytes]:
        """Ids of both, none for a text that isn't given back. words: the text between spaces, learnt."""
        try:
            return b"".join(map(self.words_a.__getitem__, words)), b"".join(map(self.words_b.__getitem__, words))
        except TypeError:
            return b"", b""
        except KeyError:  # white space beside a space: those runs stay with their words
            found = list(self.ids(BETWEEN_WORDS.split(text)))
            return (b"", b"") if any(a is None for a, _ in found) else tuple(b"".join(x) for x in zip(*found, strict=True))


@functools.cache
def tokenizers_of(a_path: str, b_path: str) -> TwoTokenizers:
    """One for each Python worker, which keeps its words from task to task."""
    return TwoTokenizers(a_path, b_path)


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Indexes of A's tokens that end where one of B's does, in order. starts, stops: A's tokens of each text, the last of which is one."""
    cuts, low, high = [stops - 1], starts, stops

    def shared(at: np.ndarray) -> np.ndarray:
        return b_ends[np.searchsorted(b_ends, a_ends[at])] == a_ends[at]

    while True:
        more = high - low > 1
        low, high = low[more], high[more]
        if not len(low):
            return np.sort(np.concatenate(cuts))
        last = high - 2  # the last token ends at a cut already
        middle = (low + last) // 2
        cut = np.where(shared(middle), middle, -1)
        step = 0
        looking = np.flatnonzero(cut < 0)
        while len(looking):
            step += 1
            for side in (1, -1):
                at = middle[looking] + side * step
                inside = (at >= low[looking]) & (at <= last[looking])
                own, at = looking[inside], at[inside]
                cut[own[hit]] = at[hit] if (hit := shared(at)).any() else cut[own[hit]]
                looking = looking[cut[looking] < 0]
            looking = looking[(middle[looking] + step < last[looking]) | (middle[looking] - step > low[looking])]
        found = cut >= 0
        low, high, cut = low[found], high[found], cut[found]
        cuts.append(cut)
        low, high = np.concatenate((low, cut + 1)), np.concatenate((cut + 1, high))


BATCH = pa.schema([
    ("batch", pa.int64()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
    ("groups", pa.list_(pa.string())), ("kinds", pa.list_(pa.int64())), ("links", pa.binary()),
])
BATCH_SQL = "batch long, pairs array<long>, counts array<long>, doc_ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, groups array<string>, kinds array<long>, links binary"


def aligned(both: TwoTokenizers, doc_ids: list, texts: list[str], number: int) -> tuple:
    """A batch's row. kinds: how many different pairs each text has; links: their places in `pairs` and how often the text has them."""
    split = [t.split(" ") for t in texts]
    if len(both.words_a) > WORD_CACHE:
        both.words_a.clear()
        both.words_b.clear()
    both.learn(set().union(*split))
    told = [both.tokens(t, w) if t else (b"", b"") for t, w in zip(texts, split, strict=True)]
    del split
    n_a, n_b = (np.array([len(x[k]) // 2 for x in told], dtype=np.int64) for k in (0, 1))
    a, b = (np.frombuffer(b"".join([x[k] for x in told]), dtype=np.uint16).astype(np.int64) for k in (0, 1))
    del told
    a_ends, b_ends = np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b])  # texts follow one another in both
    a_stops, b_stops = np.cumsum(n_a), np.cumsum(n_b)
    full = n_a > 0
    cut_a = common_ends(a_ends, b_ends, (a_stops - n_a)[full], a_stops[full]) if full.any() else np.zeros(0, np.int64)
    cut_b = np.searchsorted(b_ends, a_ends[cut_a])
    doc_of = np.searchsorted(a_stops, cut_a, side="right")
    n_links = np.bincount(doc_of, minlength=len(texts))
    # The digest's order: A's tokens of a group, then B's.
    before_a, before_b = np.concatenate(([0], cut_a + 1)), np.concatenate(([0], cut_b + 1))
    group_a, group_b = (np.concatenate(([0], np.cumsum(np.bincount(cut, minlength=n)[:-1]))) if n else np.zeros(0, np.int64) for cut, n in ((cut_a, len(a)), (cut_b, len(b))))
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[cut_a] = ends_b[cut_b] = 1
    codes[np.arange(len(a)) + before_b[group_a]] = 2 * a + ends_a
    codes[np.arange(len(b)) + before_a[group_b + 1]] = 2 * (len(both.a_bytes) + b) + ends_b
    groups, at = [], 0
    for n in (n_a + n_b).tolist():
        said = b"".join(map(both.said.__getitem__, codes[at : at + n].tolist()))
        groups.append(hashlib.sha256(said[:-1]).hexdigest() if n else "")
        at += n
    pairs, place, counts = np.unique(a[cut_a] << B_BITS | b[cut_b], return_inverse=True, return_counts=True)
    of_doc, often = np.unique(doc_of << 32 | place, return_counts=True)
    kinds = np.bincount(of_doc >> 32, minlength=len(texts))
    places = (of_doc & 0xFFFFFFFF).astype(np.uint32)
    links = zstandard.compress(np.concatenate((np.diff(places, prepend=np.uint32(0)).astype(np.uint32), often.astype(np.uint32))).tobytes(), 1)
    return (number, pairs, counts, doc_ids, n_a, n_b, n_links, groups, kinds, links)


def batches_of(docs: DataFrame, a_path: str, b_path: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = tokenizers_of(a_path, b_path), TaskContext.get().partitionId() << 40
        ids, texts, held = [], [], 0

        def row() -> pa.RecordBatch:
            found = aligned(both, ids, texts, number)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(found, BATCH, strict=True)], schema=BATCH)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                said = text.as_py() or ""
                if texts and held + len(said) > batch_chars:
                    yield row()
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(doc_id.as_py())
                texts.append(said)
                held += len(said)
        if texts:
            yield row()

    named = own_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(align, BATCH_SQL)


RESULT = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])


def told_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in (batch.slice(i, 1) for i in range(batch.num_rows)):
            of = lambda c: r.column(c).values.to_numpy(zero_copy_only=False)[r.column(c).offsets[0].as_py() : r.column(c).offsets[1].as_py()]  # noqa: E731, B023
            asked = r.column("asked")[0].values  # null where the batch has no pair
            count, best = np.zeros(0, np.int64), np.zeros(0, bool)
            if asked is not None and len(asked):
                place, n, top = (asked.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                order = np.argsort(place)
                count, best = n[order], top[order].astype(bool)
            raw = np.frombuffer(zstandard.decompress(r.column("links")[0].as_py()), dtype=np.uint32)
            half = len(raw) // 2
            places, often = np.cumsum(raw[:half], dtype=np.uint32), raw[half:].astype(np.int64)
            sums = [np.concatenate(([0], np.cumsum(v))) for v in (often * best[places], often * count[places])]
            stops = np.cumsum(of("kinds"))
            n_best, count_sum = (s[stops] - s[stops - of("kinds")] for s in sums)
            links = of("n_links")
            groups = r.column("groups")[0].as_py()
            ids = r.column("doc_ids")[0].as_py()
            columns = (ids, of("n_a"), of("n_b"), links, links, n_best, count_sum, groups)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)


def pair_counts(batches: DataFrame) -> DataFrame:
    """pair, n: corpus-wide, and best: whether no other A token is linked more often with the pair's B token."""
    each = batches.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("n"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    most = counts.groupBy(b_id.alias("_b")).agg(F.max("n").alias("_most"))  # a row a token of B: at most 2^16
    return counts.join(F.broadcast(most), b_id == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


class Alignment:
    """Texts aligned in batches, and the corpus' links."""

    def __init__(self, docs: DataFrame, a_path: str | None = None, b_path: str | None = None, batch_chars: int = BATCH_CHARS):
        a, b = default_tokenizers()
        self.batches = written(batches_of(docs, a_path or a, b_path or b, batch_chars))
        self.counts = written(pair_counts(self.batches))

    def links(self) -> DataFrame:
        """a_id, b_id, n, best: how often tokens of both end together, the table that a change of tokenizers needs."""
        return self.counts.select(F.shiftright("pair", B_BITS).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b_id"), "n", "best")

    def documents(self) -> DataFrame:
        """A row a text: tokens, groups, links, those that are their B token's most frequent, sum of counts, digest of the groups."""
        asks = self.batches.select("batch", F.posexplode("pairs").alias("place", "pair"))
        answers = asks.join(self.counts, "pair").groupBy(F.col("batch").alias("_batch")).agg(F.collect_list(F.struct("place", "n", "best")).alias("asked"))  # at most a batch's links
        joined = self.batches.join(answers, F.col("batch") == F.col("_batch"), "left")
        return joined.select("doc_ids", "n_a", "n_b", "n_links", "groups", "kinds", "links", "asked").mapInArrow(told_documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents")).documents()
