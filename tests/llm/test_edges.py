"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage."""

import bisect
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reeltable.llm import cdc, hostrules, katz, licenses, minhash, mixing, ogg, packing, sharding, simhash, surrogates

LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "src1", 0), (3, LONG, "en", "src1", len(LONG)), (4, "a b c", "de", None, 5), (4, "a b c", "de", None, 5), (5, "a b c", None, "src2", 5),
    (None, "Licensed under the Apache License, Version 2.0\nx@y.org", "en", "src2", 1), (6, "é ñ " * 40, "fr", "src2", 160),
]
CLASH = ["_id", "_keep", "_row", "_p", "_n", "_source", "kept", "n_words", "component_id", "host", "fp", "label", "score", "probability", "shard", "slot", "length", "start", "e", "root", "low", "topic"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("mine") for c in CLASH})


KEY = b"test key"
OPERATORS = {
    "licenses": licenses.scan_licenses, "simhash": simhash.near_duplicates, "katz": katz.score_documents, "mixing": mixing.mix,
    "surrogates": lambda d: surrogates.replace_pii(d, KEY), "sharding": lambda d: sharding.shard(sharding.written(sharding.sized(d))), "hostrules": hostrules.host_rules,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, name):
    got = OPERATORS[name](docs).collect()
    ids = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids(got) == ids(docs.collect())
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["surrogates", "hostrules"])
def test_extra_columns_stay(docs, name):
    assert {r["kept" if name == "surrogates" else "label"] for r in OPERATORS[name](docs).collect()} == {"mine"}


def test_licenses(docs):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert got[None]["labels"] == "apache,apache-2.0" and got[None]["n_base"] == 1 and got[None]["first_word"] == 3
    assert got[3]["n_words"] == 60_000 and got[1]["n_words"] == 0 and got[2]["score"] == 0.0


@pytest.mark.parametrize("text", ["CC BY 4.0, cc-by and MIT License mit license", "gnu general public", "the gnu general public license", "accby cc\nby"])
def test_phrases(spark, text):
    import re

    words = re.findall(licenses.LICENSE_WORD, text.lower())
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_base"], r["base_labels"]) == (len(places), ",".join(sorted({x for _, x in places})))
    assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_every_block_at_the_threshold_is_found(spark):
    """Against all windows of each template's span, counted out."""
    import re

    rng = np.random.default_rng(2)
    sets = licenses.template_sets()
    vocab = sorted({w for s in sets for w in s[1]}) + [f"z{i}" for i in range(30)]
    rows = []
    for i in range(300):
        words = sets[i % len(sets)][1]
        some = [w for w in words if rng.random() < 0.85]
        if i % 3:
            rng.shuffle(some)
        rows.append((i, " ".join([*rng.choice(vocab, 12), *some[: len(some) // 2], *rng.choice(vocab, int(rng.integers(0, 6))), *some[len(some) // 2 :], *rng.choice(vocab, 9)])))
    known = licenses.known_words(spark.createDataFrame(rows, "doc_id long, text string"), sets)
    got = {(r["doc_id"], r["template"]): (r["start"], r["containment"]) for r in licenses.matches(known, sets).collect()}
    want = {}
    for i, text in rows:
        ws = re.findall(licenses.LICENSE_WORD, text)
        for t, (_, words, need, span, telling) in enumerate(sets):
            for a in range(len(ws)):
                held = set(ws[a : a + span]) & set(words)
                if ws[a] in words and len(held) >= need and held >= set(telling) and len(held) / len(words) > want.get((i, t), (0, 0))[1]:
                    want[i, t] = (a, len(held) / len(words))
    assert len(want) > 50
    assert got == want


def test_simhash_masks_cover():
    masks = [m % (1 << 64) for m in simhash.table_masks()]
    for i in range(64):
        for j in range(i, 64):
            d = 1 << i | 1 << j
            assert any(not m & d for m in masks)


def test_simhash_links_chains(spark):
    rng = np.random.default_rng(1)
    prints = []
    for _ in range(40):
        p = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 9))):
            prints.append(p)
            for b in rng.integers(0, 64, int(rng.integers(0, 4))):
                p ^= 1 << int(b)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    from tests.llm.test_queries import brute_components

    want = brute_components({p: p % (1 << 64) for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.bucket_links(df)).collect()}
    assert {p: got.get(p, p) for p in prints} == want


def test_components_end_where_links_are_stars(spark):
    """Two components of which one link each changes in the second round, before they are stars, and leaves the number of links and the sum of their hashes what they were."""
    parts = [(0, 1, 252_699, 500_000, 500_001), (1_000_000, 1_000_001, 1_007_469, 1_500_000, 1_500_001)]
    links = [(p[a], p[b]) for p in parts for a, b in ((2, 0), (3, 2), (4, 1), (4, 3))]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: p[0] for p in parts for x in p[1:]}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_leave_one(spark):
    rows = [(9, LONG), (3, LONG + " tail"), (3, LONG + " tail"), (5, "quite another text here"), (None, LONG), (7, None)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 3), (False, 5), (False, 7)]  # the row without an id is a copy of 3


def test_pieces_of_long_texts(docs):
    got = packing.pack_documents(docs).collect()
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 3)
    assert [x[2] for x in long[:-1]] == [4096] * (len(long) - 1) and [x[1] for x in long] == [4096 * i for i in range(len(long))]
    assert sorted(r["length"] for r in got if r["doc_id"] in (1, 2)) == [1, 1]
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_words_are_encoded_as_whole_texts_are():
    rng = random.Random(1)
    encoder = packing.encoder_of(packing.default_tokenizer())
    letters = "abcXYZéÉßñÑœŒ'.,!-_1٣αΣςЖжİıſ\u212aÅ ́ \u00a0 \u2003\t\x1c#$<|>ªǅŉ日🙂"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert encoder.encode(text) == encoder.direct(text), text


def best_fit_decreasing(histogram):
    free, bins = [], 0
    for x in sorted(histogram, reverse=True):
        for _ in range(histogram[x]):
            i = bisect.bisect_left(free, x)
            room = free.pop(i) if i < len(free) else 4096
            bins += room == 4096
            bisect.insort(free, room - x)
    return bins


def test_plans_are_whole_and_no_longer_than_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(20):
        h = {int(x): int(n) for x, n in zip(rng.integers(1, 4097, 300), rng.integers(1, 50, 300), strict=True)}
        plan = packing.plan_packing(h)
        made: dict[int, int] = {}
        for filling, times in plan:
            assert sum(filling) <= 4096
            for x in filling:
                made[x] = made.get(x, 0) + times
        assert made == h
        assert sum(t for _, t in plan) <= best_fit_decreasing(h)


def test_exhaustive_search_of_many_sequences():
    """More sequences than Python lets calls nest."""
    found, whole = packing.exhausted({3000: 1500, 1000: 1500}, 4096, 1500, 300_000)
    assert whole and sorted(map(sorted, found)) == [[1000, 3000]] * 1500
    assert packing.exhausted({3000: 3, 1000: 3}, 4096, 2, 300_000) == (None, True)


def fewest(lengths, capacity):
    """By trying all."""
    best = len(lengths)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for k, free in enumerate(room):
            if lengths[i] <= free and free not in room[:k]:
                put(i + 1, [*room[:k], free - lengths[i], *room[k + 1 :]])
        put(i + 1, [*room, capacity - lengths[i]])

    put(0, [])
    return best


def test_plans_are_the_fewest_on_small_instances():
    rng = random.Random(7)
    for _ in range(60):
        lengths = sorted((rng.randint(8, 60) for _ in range(rng.randint(4, 10))), reverse=True)
        plan = packing.plan_packing(Counter(lengths), 100, 2_000)
        assert sum(t for _, t in plan) == fewest(lengths, 100), lengths


def test_exact_triples_come_near_the_fewest():
    rng, lengths = random.Random(3), []
    while len(lengths) < 300:
        a, b = rng.randint(1100, 1700), rng.randint(1100, 1700)
        lengths += [a, b, 4096 - a - b] if 1100 <= 4096 - a - b <= 1700 else []
    assert sum(t for _, t in packing.plan_packing(Counter(lengths), 4096, 10_000)) <= 102


def test_plans_find_exact_fillings():
    # Best fit takes 2000 + 2000, which leaves 96; the search finds 2000 + 1996 + 100.
    assert sum(t for _, t in packing.plan_packing({2000: 6, 1996: 6, 100: 6})) == 6


def test_ogg_faults():
    payload = bytes(range(256)) * 300
    media = ogg.mux(payload)
    assert ogg.read_back(media)[0] == payload
    for broken in (media[:-1], media[:100] + b"?" + media[101:], media[len(media) // 2 :], media + media[:58], b""):
        with pytest.raises(ValueError):
            ogg.read_back(broken)


@pytest.mark.parametrize("size", [64, 254, 255, 256, 9_999, 10_000, 10_001, 65_025, 130_050, 400_000])
def test_ogg_round_trip(size):
    payload = bytes((i * 7 + i // 255) % 256 for i in range(size))
    assert ogg.read_back(ogg.mux(payload))[0] == payload


def plain_ogg(media):
    """{serial: (packets, granule of each or None)} by a reader of the test's own, with a checksum bit by bit."""
    out, at, open_ = {}, 0, {}
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        flags, granule = media[at + 5], int.from_bytes(media[at + 6 : at + 14], "little", signed=True)
        serial, number, told, n = (int.from_bytes(media[at + i : at + i + w], "little") for i, w in ((14, 4), (18, 4), (22, 4), (26, 1)))
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        crc = 0
        for x in media[at : at + 22] + bytes(4) + media[at + 26 : end]:
            crc ^= x << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        assert crc == told
        pages = out.setdefault(serial, [[], [], 0, False])
        assert bool(flags & 2) == (number == 0) and number == pages[2] and bool(flags & 1) == bool(open_.get(serial)) and not pages[3]
        pages[2], pages[3] = number + 1, bool(flags & 4)
        body, part, ended = at + 27 + n, open_.pop(serial, b""), 0
        for value in lacing:
            part += media[body : body + value]
            body += value
            if value < 255:
                pages[0].append(part)
                pages[1].append(None)
                part, ended = b"", ended + 1
        if part:
            open_[serial] = part
        if ended:
            pages[1][-1] = granule
        at = end
    assert all(p[3] for p in out.values()) and not open_
    return {k: (p[0], p[1]) for k, p in out.items()}


@pytest.mark.parametrize("size", [64, 10_000, 25_024])
def test_another_reader_reads_the_media(spark, size):
    payload = bytes((i * 31 + i // 7) % 256 for i in range(size))
    media = ogg.mux(payload)
    (packets, granules), (index, _) = plain_ogg(media).values()
    assert b"".join(packets[1:]) == payload and index[0] == b"CRCINDEX" and granules[-1] == size
    ends = [sum(map(len, packets[1 : k + 2])) for k in range(len(packets) - 1)]
    rows = ogg.explode_packets(spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")).collect()
    assert [(r["doc_id"], r["packet"], r["end_ms"], bytes(r["data"])) for r in rows] == [(1, k, e * 1000 // 8000, p) for k, (e, p) in enumerate(zip(ends, packets[1:], strict=True))]
    assert all(g in (None, e) for g, e in zip(granules[1:], ends, strict=True))


def test_media_query_on_odd_rows(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = ogg.op6_ogg_media(spark, str(tmp_path)).collect()
    assert sorted(r["payload_bytes"] for r in got)[:2] == [64, 64] and len(got) == len(ROWS) and all(r["payload_bytes"] >= r["n_bytes"] and "fault" not in r["feature"] for r in got)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert ogg.op6_ogg_media(spark, f"{tmp_path}/none").collect() == []


def test_ogg_crc_is_the_plain_one():
    def plain(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.page_crc(data) == plain(data)


def test_read_media_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "p"), (2, bytearray(b"junk"), "p"), (3, bytearray(ogg.mux(b"x" * 64)), "p")], "doc_id long, media binary, payload string")
    got = {r["doc_id"]: (r["payload"], r["feature"]) for r in ogg.read_media(df).collect()}
    assert got[1] == (None, None) and got[2][0] is None and got[2][1].startswith("fault=") and bytes(got[3][0]) == b"x" * 64


def test_surrogates_keep_format():
    text = "Mr. John Smith met Mr Smith and Frau Müller: (212) 555-1234, +1 212-555-1234, 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00, 10.0.0.1, г-жа Иванова."
    new, n = surrogates.replace(text, key=KEY)
    assert n == 9 and not any(x in new for x in ("Smith", "Müller", "1234", "4111", "3704", "10.0.0.1", "Иванова"))
    smith = new.split(" met ")[0].split()[-1]
    assert f"Mr {smith} and" in new
    assert any("Ѐ" <= c <= "ӿ" for c in new.split("г-жа ")[1])
    phone, longer, card = new.split(": ")[1].split(", ")[:3]
    assert longer == "+1 " + phone.replace("(", "").replace(") ", "-")
    assert len(card) == 19 and surrogates._luhn(card.replace(" ", "")) == 0
    assert surrogates.replace("order 4111111111111112, 9807915762804490", key=KEY) == ("order 4111111111111112, 9807915762804490", 0)
    assert surrogates.replace("nothing here, 12.5 % of 2024-01-02", key=KEY) == ("nothing here, 12.5 % of 2024-01-02", 0)
    assert surrogates.replace("4111111111111111", key=KEY) != surrogates.replace("4111111111111111", key=b"another")


def changed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r["text"] for r in sorted(surrogates.replace_pii(df, KEY, "n").collect(), key=lambda r: r["doc_id"])]


def test_draws_end_where_all_short_forms_are_taken(spark):
    mails = [f"{c}@example.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    got = changed(spark, [f"write to {m} now" for m in mails] + [f"{c}@{d}.io" for c in "ab" for d in "qrstuvwxyzabcdefghijklmnop"])
    new = [t.split()[2] for t in got[:26]]
    assert len(set(new)) == 26 and not set(new) & set(mails) and all(m.endswith("@example.com") for m in new)
    hosts = [t.split("@")[1] for t in got[26:]]
    assert len(set(hosts)) == 26 and hosts[:26] == hosts[26:] and all(h.endswith(".io") and len(h) > 4 for h in hosts)


def test_collisions_are_drawn_again(spark, monkeypatch):
    """First draws that can't be told apart: each but the first mover of its group moves, and all end up distinct."""
    real = surrogates.surrogate
    monkeypatch.setattr(surrogates, "_drawn", lambda key: lambda *c: F.when(F.col("attempt") < 1, F.concat(F.lit("x"), F.substring("canon", 3, 1))).otherwise(F.concat("canon", F.lit("'"), F.col("attempt"))))
    df = spark.createDataFrame([(f"{i:03d}-00-0000",) for i in range(30)], "canon string").select(F.lit("ssn").alias("kind"), "canon", F.lit("").alias("gender"), F.lit(None).cast("string").alias("host"))
    got = {r["canon"]: (r["attempt"], r["drawn"]) for r in surrogates.settle(df, KEY).collect()}
    assert len(got) == 30 and len({d for _, d in got.values()}) == 30
    assert {c for c, (n, _) in got.items() if n == 0} == {f"{i:03d}-00-0000" for i in range(10)}
    assert real("ssn", "123456789", key=KEY) != "123456789"


def test_names_are_one_person_over_titles(spark):
    got = changed(spark, ["Mr Peter Jones came", "Dr Peter Jones left", "Dear Mr Jones, hello", "Contact Peter Jones today", "Anna Schmidt, Prof Anna Schmidt"])
    first, last = got[0].split()[1:3]
    assert got[1] == f"Dr {first} {last} left" and got[2] == f"Dear Mr {last}, hello" and got[3] == f"Contact {first} {last} today"
    assert "Peter" not in " ".join(got) and got[4].split(", Prof ")[0] == got[4].split(", Prof ")[1] and "Anna" not in got[4]


def test_chunks_resist_insertions():
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    moved = text[:5_000] + b"inserted" + text[5_000:]
    a = {text[x:y] for x, y in zip([0, *cdc.cuts_of(text)], cdc.cuts_of(text), strict=False)}
    b = {moved[x:y] for x, y in zip([0, *cdc.cuts_of(moved)], cdc.cuts_of(moved), strict=False)}
    assert len(a - b) <= 6
    for raw in ("é" * 500).encode(), ("日本" * 300).encode():
        for c in cdc.cuts_of(raw):
            raw[:c].decode()


def test_planted_passages_are_found_and_others_left(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9)))))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], set()
    for i in range(120):
        if i % 6 == 0:
            passage = prose(51)
            planted |= {i, i + 1}
            rows += [(i, f"{prose(80)} {passage} {prose(60)}"), (i + 1, f"{prose(33)} {passage} {prose(90)}")]
        elif i % 6 > 1:
            rows.append((i, prose(150)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in cdc.repeated_spans(df).collect()}
    assert got <= planted and len(got) >= 0.97 * len(planted)
    kept = {r["doc_id"]: r["text"] for r in cdc.drop_repeats(df).collect()}
    assert all(kept[i] == t for i, t in rows if i not in got)
    assert all(len(kept[i + 1]) < len(dict(rows)[i + 1]) for i in got if i % 6 == 0)


def test_cdc_edges(docs):
    assert {r["doc_id"] for r in cdc.repeated_spans(docs).collect()} == set()  # repeated rows of one document, and short texts
    assert cdc.repeated_spans(docs.limit(0)).collect() == []
    assert cdc.drop_repeats(docs).count() == docs.count()


def test_documents_that_share_an_id(spark):
    """Rows of one doc_id, or of none, are told apart by their texts."""
    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9))))) for _ in range(n))
    passage, other = words(90), "".join(map(chr, rng.integers(0x3041, 0x3090, 600)))
    schema = "doc_id long, text string"
    rows = [(7, f"{words(40)} {passage} {words(40)}"), (7, other), (1, f"{words(30)} {passage}"), (8, words(100))]
    kept = sorted((r["doc_id"], r["text"]) for r in cdc.drop_repeats(spark.createDataFrame(rows, schema)).collect())
    assert (7, other) in kept and (1, rows[2][1]) in kept and len(min(t for i, t in kept if i == 7)) < len(rows[0][1]) - 300
    found = cdc.repeated_spans(spark.createDataFrame([(1, f"{words(30)} {passage}"), (None, f"{passage} {words(20)}"), (None, words(200))], schema)).collect()
    assert sorted((r["doc_id"] is None, r["first_doc_id"], r["is_first"]) for r in found) == [(False, 1, True), (True, 1, False)]
    left = simhash.drop_near_duplicates(spark.createDataFrame([(3, passage), (5, passage), (5, other), (5, other)], schema)).collect()
    assert sorted(map(tuple, left)) == [(3, passage), (5, other)]
    left = minhash.drop_near_duplicates(spark.createDataFrame([(3, passage), (5, passage + " more"), (5, other), (5, other)], schema)).collect()
    assert sorted(map(tuple, left)) == [(3, passage), (5, other)]
    labels = licenses.scan_licenses(spark.createDataFrame([(1, "all rights reserved"), (1, "plain words only"), (None, "no"), (None, "MIT license")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["labels"], r["score"]) for r in labels) == [(0, "", 0.0), (0, "mit", 1.0), (1, "", 0.0), (1, "reserved", 1.0)]


@pytest.mark.parametrize(("text", "want"), [
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met", "bsd"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0", "mpl-2.0"), ("Licensed under CC BY 4.0", "cc-by"), ("Released under the Apache License", "apache"),
])
def test_notices_over_lines(spark, text, want):
    """Wrapped notices are found, and short templates' neighbours aren't."""
    assert licenses.scan_licenses(spark.createDataFrame([(1, f"{'word ' * 50}{text} {'word ' * 50}")], "doc_id long, text string")).first()["labels"] == want


def test_sharding_keeps_groups_whole(spark):
    rows = [(i, f"copy {i % 12} " * 200 if i < 240 else f"text {i} " * (i % 40)) for i in range(2000)]
    got = sharding.shard(sharding.written(sharding.sized(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))).collect()
    of = defaultdict(set)
    for r in got:
        of[dict(rows)[r["doc_id"]]].add(r["shard"])
    assert {len(x) for x in of.values()} == {1}
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.05 * sum(sums.values()) / 8


def test_sharding_splits_a_hot_group(spark):
    rows = [(i, "the same text " * 20 if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(900)]
    got = sharding.shard(sharding.written(sharding.sized(spark.createDataFrame(rows, "doc_id long, text string")))).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sums = [r["b"] for r in got]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.03 * sum(sums) / 8


def test_raking_meets_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 80))) + ("|" if i % 5 == 0 else ""), "en" if rng.random() < 0.6 else "de", f"s{int(rng.integers(0, 4))}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, keep=0.4, given={"lang": {"en": 0.3, "de": 0.7}}).toPandas()
    got["e"] = got["n_tokens"] * got["probability"]
    share = got.groupby("lang")["e"].sum() / got["e"].sum()
    assert share["en"] == pytest.approx(0.3, abs=1e-4) and got["residual"].max() < 1e-3
    assert got["e"].sum() == pytest.approx(0.4 * got["n_tokens"].sum(), rel=1e-3)
    assert got["sampled"].mean() == pytest.approx(got["probability"].mean(), abs=0.04)


def test_the_prior_is_free_of_noise(spark):
    """Hosts that differ by chance alone get the common rate; hosts that differ get theirs."""
    rng = np.random.default_rng(5)
    alike = [(f"h{i}", bool(rng.random() < 0.3)) for i in range(400) for _ in range(10)]
    apart = [(f"h{i}", i % 2 == 0) for i in range(40) for _ in range(50)]
    for rows, spread in ((alike, 0.1), (apart, 0.9)):
        hosts = hostrules.host_verdicts(spark.createDataFrame(rows, "source string, rule_failed boolean")).collect()
        rates = [r["host_rate"] for r in hosts]
        assert (max(rates) - min(rates) < spread) if spread < 0.5 else (max(rates) - min(rates) > spread)


def test_a_bad_host_is_rejected(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "spam spam spam " * 40
    rows = [(i, bad if i % 2 and i % 40 != 1 else good, "bad" if i % 2 else f"good{i % 8}") for i in range(800)]
    got = hostrules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["source"] for r in got if not r["host_rate"] <= 0.6} == {"bad"}
    assert all(r["kept"] == (r["source"] != "bad") for r in got)
