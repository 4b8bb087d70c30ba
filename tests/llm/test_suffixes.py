"""Substring dedup by prefix doubling against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reeltable.llm import suffixes as S
from tests.compare import DATA


def expected(rows, length):
    raws = [(text or "").encode() for _, text in rows]
    counts = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for (doc_id, _), raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_dictionary(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    assert got(S.op11_suffix_dedup(spark, DATA)) == expected(rows, S.LENGTH)


def texts_of(rnd, letters, n):
    """Texts that share passages of all lengths, at their edges and inside, and repeat themselves."""
    passages = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 400))) for _ in range(6)]
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(5)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            part = p[a : a + rnd.randrange(1, 400)]
            if rnd.random() < 0.3 and part:
                i = rnd.randrange(len(part))
                part = part[:i] + rnd.choice(letters) + part[i + rnd.randrange(2) :]
            parts += [part, "".join(rnd.choice(letters) for _ in range(rnd.randrange(3)))]
        yield "".join(parts)


@pytest.mark.parametrize("length, letters", [(200, "abcdé \n"), (12, "abé"), (5, "ab"), (1, "abcde\U0001f600")])
def test_random_texts(spark, length, letters):
    rows = list(enumerate(texts_of(random.Random(length), letters, 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(S.removed(df, length)) == expected(rows, length)


ODD = [
    (1, None), (2, ""), (3, "short"), (None, "né" * 150), (None, "né" * 150), (None, "x" * 199), (None, "x" * 200), (4, "x" * 201), (5, "twin " * 80), (5, "twin " * 80), (5, "other " + "y" * 300), (6, "\0" * 250 + "abc" * 100), (-7, "only " + "".join(map(chr, range(300, 700)))),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"uid": F.lit("x"), "start": F.lit(1), "kept": F.lit(2), "rank": F.lit(None).cast("int")})
    assert got(S.removed(df)) == expected(ODD, S.LENGTH)
    cut = S.drop_repeats(df)
    assert cut.columns == ["doc_id", "text", "uid", "start", "rank", "spans", "kept"]
    assert sorted(str((r["doc_id"], hashlib.sha256(r["kept"]).hexdigest(), sum(s["end"] - s["start"] for s in r["spans"]))) for r in cut.collect()) == sorted(str((r[0], r[4], r[2])) for r in expected(ODD, S.LENGTH))
    assert S.removed(df.limit(0)).collect() == []


def test_sections_of_long_texts(spark, monkeypatch):
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(1, base), (2, "zz" + base[1_048_000:1_049_900] + "qq"), (3, base[2_299_000:] + base[:300])]
    found = {r[0]: r for r in got(S.removed(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert found[2][2:4] == (1_900, 1) and found[3][2:4] == (1_300, 1)
    assert found[1][2:4] == (1_900 + 1_300, 3)
