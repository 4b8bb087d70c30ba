"""Ends of intervals, found in buckets, against one pass over the rows."""

import random

import pytest

from reeltable.operators.audio import transcribe_chunks
from reeltable.operators.chains import with_interval_numbers


def one_pass(rows, interval, from_zero):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[1:])
        start, number = 0 if from_zero or not own else own[0][1], 0
        for r in own:
            out.append((*r, number))
            if r[1] - start >= interval:
                start, number = r[1], number + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("interval, spread, span, from_zero", [(7, 1, 300, False), (7, 2, 300, True), (50, 3, 400, False), (3, 64, 2_000, True), (1, 1, 60, False)])
def test_numbers_equal_one_pass(spark, interval, spread, span, from_zero):
    """Ties, gaps wider than buckets, times below 0, a null key, rows without a time."""
    rnd = random.Random(interval)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(span) + (5_000 if rnd.random() < 0.2 else 0) + (1 if from_zero else -40), i) for i in range(300)]
    rows += [("a", None, 999), ("c", 5, 1_000)]
    df = spark.createDataFrame(rows, "k string, at long, id int")
    found = with_interval_numbers(df, ["k"], "at", interval, ["id"], from_zero, spread)
    assert sorted((tuple(r) for r in found.collect()), key=str) == one_pass(rows, interval, from_zero)
    assert with_interval_numbers(df.limit(0), ["k"], "at", interval).collect() == []


def test_numbers_where_joins_turn_to_broadcasts(spark):
    """Joins that are planned by shuffle and turn to broadcasts at run time, as those of large tables with few buckets, leave a bucket's rows together."""
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.randrange(4_000), i) for i in range(3_000)]
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        found = with_interval_numbers(spark.createDataFrame(rows, "k string, at long, id int"), ["k"], "at", 7, ["id"], spread=4).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((tuple(r) for r in found), key=str) == one_pass(rows, 7, False)


def test_chunks_of_blocks_of_all_sizes(spark):
    rnd = random.Random(1)
    blocks = [(s, b, [rnd.randrange(-9, 9)] * rnd.choice([0, 1, 500, 1_600, 9_000])) for s in (1, 2, None) for b in range(60)]
    expected = set()
    for stream in (1, 2, None):
        held, chunk = [], 0
        for _, _, samples in sorted(b for b in blocks if b[0] == stream):
            held += samples
            if len(held) > 8_000:
                expected.add((stream, chunk, len(held), tuple(x / 32768 for x in held)))
                held, chunk = [], chunk + 1
    df = spark.createDataFrame(blocks, "stream_id int, block long, samples array<smallint>").repartition(4)
    assert {(r["stream_id"], r["chunk"], r["size"], tuple(r["samples"])) for r in transcribe_chunks(df, 0.5).collect()} == expected
