"""The pipeline against plain Python over the small table, and its stages on odd rows."""

import importlib.util
import itertools

import pytest
from pyspark.sql import functions as F

from tests.compare import DATA, connect
from tests.llm.test_edges import CLASH, ROWS

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline isn't here")


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_components(docs):
    """The smallest id of each document's component of texts with a 5-word similarity of 0.8 or more, from all pairs."""
    root, sets = {i: i for i, *_ in docs}, {i: shingles(t) for i, t, *_ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(root), 2):
        x, y = sets[a], sets[b]
        if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in root}


def test_whole_run(spark):
    import corpus_pipeline as p
    from reeltable.llm import hostrules, mixing, surrogates

    con = connect()
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({hostrules.OP10_SQL}) WHERE kept").fetchall()}
    docs = [r for r in con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall() if r[0] in kept]
    comps = similar_components(docs)
    docs = [r for r in docs if comps[r[0]] == r[0]]
    docs = [(r[0], surrogates.replace(r[1], key=surrogates.TABLES_KEY)[0], *r[2:4]) for r in docs]
    con.execute("CREATE OR REPLACE TEMP TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?)", docs)
    sampled = {r[0] for r in con.sql(f"SELECT doc_id FROM ({mixing.OP5_SQL.replace('FROM documents', 'FROM d')}) WHERE sampled").fetchall()}
    got = p.run(spark, DATA).collect()
    assert {r["doc_id"] for r in got} == sampled and len(sampled) > 20
    from tokenizers import Tokenizer

    from reeltable.llm.packing import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    total = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t, *_ in docs if i in sampled}
    made, places = {}, {}
    for r in got:
        made[r["doc_id"]] = made.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert made == total
    assert all([a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 4096 for x in places.values())


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in CLASH})
    for name, stage in p.STAGES:
        out = stage(spark, docs, DATA)
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.collect() == []
        assert out.count() <= docs.count() or name == p.STAGES[-1][0]
        if name == "pii surrogates":
            assert out.count() == docs.count()
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns == empty.columns
            assert all(r[c] == "mine" for r in out.collect() for c in CLASH)
