"""The contracted queries against SQL or plain Python, over the whole small tables."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from reeltable.llm import registry
from tests.compare import DATA, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.fixture(scope="module")
def docs(con):
    return con.sql("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    same(registry.QUERIES[name](spark, DATA), con, registry.ORACLES[name])


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    prints = {i: brute_fingerprint(t) for i, t in docs}
    comps = brute_components(prints)
    got = registry.QUERIES["op2_simhash"](spark, DATA).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", comps[i]) for i, p in prints.items()}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    from reeltable.llm.packing import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    want = {}
    for i, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, p] = (at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    got = registry.QUERIES["op4_best_fit_packing"](spark, DATA).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 4096
    assert len(used) <= math.ceil(sum(n for _, n, _ in want.values()) / 4096) + 1


def test_media(spark, docs):
    import hashlib

    from reeltable.llm import ogg

    got = {r["doc_id"]: r for r in registry.QUERIES["op6_ogg_media"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = ogg.mux(padded)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"].startswith("streams=2;")


def test_pii(spark, docs):
    """Against patterns of the test's own: what looks like an entity is gone, one entity has one surrogate, and nothing else moves."""
    import re

    mail, phone, ip = re.compile(r"[a-z0-9.]+@[a-z0-9.]*[a-z]"), re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}"), re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_pii_surrogates"](spark, DATA).collect()}
    assert len(got) == len(docs)
    known, drawn, seen = {}, {}, 0
    for i, t in docs:
        new, n = got[i]["text"], got[i]["n_entities"]
        if not n:
            assert new == t
            continue
        for pattern in (mail, phone, ip):
            a, b = pattern.findall((t or "").lower()), pattern.findall(new.lower())
            assert len(a) == len(b) and not set(a) & set(b)
            seen += len(a)
            for x, y in zip(a, b, strict=True):
                assert known.setdefault(x, y) == y and drawn.setdefault(y, x) == x
                assert y.endswith(".example.com") or not x.endswith(".example.com")
        # Words that no digit or @ touches stay, all but the few that an entity holds.
        plain = lambda s: Counter(w for w in re.findall(r"\S+", s) if not re.search(r"[\d@]", w))
        assert sum((plain(t) - plain(new)).values()) <= 3 * n
    assert seen > 5


def test_sharding(spark, docs):
    got = registry.QUERIES["op8_vector_sharding"](spark, DATA).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in docs)
    of = dict(docs)
    shards = defaultdict(list)
    for r in got:
        raw = (of[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards[r["shard"]].append(r)
    assert sorted(shards) == list(range(8))
    sums = [sum(r["size"] for r in rows) for rows in shards.values()]
    assert max(sums) - min(sums) <= 0.02 * sum(sums) / 8 + 2000
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


def plain_cuts(raw):
    """Chunk ends by a loop over bytes, from the rules alone."""
    gear = []
    for i in range(256):
        x = (i + 1) * 0x9E3779B97F4A7C15 % 2**64
        gear.append((((x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64) >> 32) % 2**32)
    ends, last, h = [], 0, 0
    whole = lambda at: at == len(raw) or raw[at] & 0xC0 != 0x80
    for i in range(len(raw)):
        h = sum(gear[raw[i - k]] << k for k in range(min(16, i + 1))) % 2**32
        at = i + 1
        wanted = (h >> 8) % 256 < 10 and whole(at) or at == len(raw)
        while wanted and at - last > 96:
            last += 96
            while not whole(last):
                last -= 1
            ends.append(last)
        if wanted and (at - last >= 12 or at == len(raw) and at > last):
            ends.append(at)
            last = at
    return ends


def plain_spans(docs):
    """(doc, start, end, words, first, is_first) from (doc, text) by brute force, docs being told apart by the whole of doc."""
    held, found, out = defaultdict(set), defaultdict(list), set()
    for i, t in docs:
        raw = (t or "").encode()
        ends = plain_cuts(raw)
        starts = [0, *ends[:-1]]
        begins = [k for k in range(len(raw)) if raw[k : k + 1].strip() and not raw[max(0, k - 1) : k].strip()]
        for k, a in enumerate(starts):
            for b in ends[k:]:
                words = sum(a <= x < b for x in begins)
                if words >= 16:
                    held[raw[a:b]].add(i)
                    found[i].append((a, b, raw))
                    break
    for i, places in found.items():
        for first_here in (True, False):
            run = []
            for a, b, raw in [*sorted(set(places)), (10**9, 0, b"")]:
                others = held.get(raw[a:b], ())
                if run and (a > run[-1][1] or a == 10**9):
                    lo, hi = run[0][0], max(x[1] for x in run)
                    text = run[0][2]
                    n = sum(1 for k in range(lo, hi) if text[k : k + 1].strip() and not text[max(0, k - 1) : k].strip())
                    out.add((i, lo, hi, n, min(min(held[text[x:y]]) for x, y, _ in run), first_here))
                    run = []
                if len(others) > 1 and (min(others) == i) == first_here:
                    run.append((a, b, raw))
    return out


def test_chunk_dedup(spark, docs):
    got = {tuple(r) for r in registry.QUERIES["op9_chunk_dedup"](spark, DATA).collect()}
    assert got == plain_spans(docs)
