"""Alignment of two tokenizers against the whole tokenizers and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reeltable.llm import alignment as A
from tests.compare import DATA

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def whole():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    a_bytes = {i: bytes(letters[c] for c in token) for token, i in a.get_vocab(with_added_tokens=False).items()}

    def b_byte(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def both(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        p, q = [a_bytes[i] for i in x], [b_byte(i) for i in y]
        return (x, p, y, q) if text and b"".join(p) == b"".join(q) == (" " + text).encode() else ([], [], [], [])

    return both


def expected(whole, rows):
    told, counts = [], Counter()
    for doc_id, text in rows:
        x, p, y, q = whole(text or "")
        ends = lambda parts: np.cumsum([len(v) for v in parts]).tolist()
        places = {e: j for j, e in enumerate(ends(q))}
        groups, links, i0, j0 = [], [], 0, 0
        for i, e in enumerate(ends(p)):
            if e in places:
                j = places[e]
                groups.append(",".join(map(str, x[i0 : i + 1])) + "|" + ",".join(map(str, y[j0 : j + 1])))
                links.append((x[i], y[j]))
                i0, j0 = i + 1, j + 1
        counts.update(links)
        told.append((doc_id, len(x), len(y), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(d, a, b, len(g), len(k), sum(counts[t] == best[t[1]] for t in k), sum(counts[t] for t in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, k in told]


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "<|endoftext|> and <s> and <0x0A> <unk>"), (6, "lower▁bar"), (7, "a\n\n b \tc\x00d\x1c e"), (None, "no id"), (None, "no id"), (7, "a\n\n b \tc\x00d\x1c e"),
    (8, "　full width éé \U0001f600\U0001f468‍\U0001f469 中文 ال don't I'LL 1234567 ...!?"), (9, "x" * 70_000), (10, "中" * 3_000), (11, " " * 5_000 + "end"), (12, "\n" * 300), (13, "it's 's "),
]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_whole_tokenizers(spark, whole):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    assert rows_of(A.op13_token_alignment(spark, DATA)) == sorted(expected(whole, rows), key=str)


@pytest.mark.parametrize("batch_chars", [50, 1 << 22])
def test_odd_rows(spark, whole, batch_chars):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"batch": F.lit("x"), "pairs": F.lit(1), "n_a": F.lit(None).cast("int")})
    assert rows_of(A.Alignment(df, batch_chars=batch_chars).documents()) == sorted(expected(whole, ODD), key=str)
    assert A.Alignment(df.limit(0)).documents().collect() == []


def test_words_equal_whole_tokenizers(whole):
    """Ids kept by word, on random texts of all sorts of characters and white space."""
    both, rnd = A.TwoTokenizers(*A.default_tokenizers()), random.Random(3)
    parts = ["the", "cat", "Étion", "über", "'s", "'", "1", "23", ".", "?!", "<s>", "<|endoftext|>", "中文", "́", "\U0001f600", "x" * 20, "Аб", "-", "_", "​", "I'm"]
    spaces = [" "] * 12 + ["", "", "  ", "\n", " \n", "\t", " ", "　", "\x1c", "\x85", "\r\n", "   "]
    for _ in range(3_000):
        text = "".join(rnd.choice(parts) + rnd.choice(spaces) for _ in range(rnd.randrange(1, 9)))
        text = rnd.choice(spaces) + text if rnd.random() < 0.2 else text
        words = text.split(" ")
        both.learn(set(words))
        a, b = (np.frombuffer(x, dtype=np.uint16).tolist() for x in both.tokens(text, words))
        x, _, y, _ = whole(text)
        assert (a, b) == (x, y), repr(text)


def test_common_ends_equal_intersection():
    rnd = np.random.default_rng(1)
    for share in (0.02, 0.3, 0.9):
        starts, stops, a_all, b_all, at = [], [], [], [], 0
        for _ in range(200):
            n = int(rnd.integers(1, 200))
            a, b = (np.unique(np.append(rnd.choice(n, max(1, int(n * share)), replace=True), n)) + at for _ in "ab")
            a, b = a[a > at], b[b > at]
            starts.append(sum(map(len, a_all)))
            stops.append(starts[-1] + len(a))
            a_all.append(a)
            b_all.append(b)
            at += n
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        assert np.array_equal(A.common_ends(a, b, np.array(starts), np.array(stops)), np.flatnonzero(np.isin(a, b)))
