"""Rows that no doc_id tells apart, plans against brute force, telephone numbers that are nobody's."""

import random
from collections import Counter

from reeltable.llm import cdc, minhash, packing, sharding, surrogates
from reeltable.llm.common import written

KEY = b"test"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(n))


def test_equal_rows_without_ids_share_their_passages(spark):
    text = prose(1, 90)
    rows = [(None, text), (None, text), (None, text), (4, prose(2, 90)), (7, prose(3, 60)), (7, prose(3, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r["doc_id"], r["is_first"]) for r in cdc.repeated_spans(df).collect())
    assert found == Counter({(None, True): 1, (None, False): 2, (7, True): 1, (7, False): 1})
    kept = Counter(len(r["text"]) > 100 for r in cdc.drop_repeats(df).collect())
    assert kept == Counter({True: 3, False: 3})  # one of each group of copies


def test_near_duplicates_without_ids(spark):
    text = prose(5, 80)
    near = text.rsplit(" ", 1)[0] + " else"
    rows = [(None, text), (None, text), (None, near), (None, prose(6, 80)), (9, near), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(df).collect()]
    assert len(kept) == 3 and (9, near) in kept and (None, prose(6, 80)) in kept
    alone = spark.createDataFrame(rows[:4], "doc_id long, text string")
    assert sorted(r["text"] == prose(6, 80) for r in minhash.drop_near_duplicates(alone).collect()) == [False, True]


def test_hot_text_without_ids_is_split(spark):
    rows = [(None, "hot " * 50)] * 400 + [(i, prose(i, 30)) for i in range(600)]
    put = sharding.shard(written(sharding.sized(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))).collect()
    sizes, slots = Counter(), {}
    for r in put:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(put) == 1_000 and max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def fewest(pieces: list[int], capacity: int) -> int:
    best = [len(pieces)]

    def put(i: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= pieces[i]:
                rest = list(rooms)
                rest.remove(room)
                put(i + 1, [*rest, room - pieces[i]])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best[0]


def test_small_plans_are_the_shortest():
    rnd = random.Random(11)
    for _ in range(2_000):
        capacity = rnd.randint(8, 60)
        pieces = sorted((rnd.randint(1, max(1, capacity * rnd.choice([2, 2, 1]) // rnd.choice([2, 3, 4]))) for _ in range(rnd.randint(0, 12))), reverse=True)
        plan = packing.plan_packing(dict(Counter(pieces)), capacity, 400)
        made = Counter()
        for filling, times in plan:
            assert sum(filling) <= capacity
            made.update({x: n * times for x, n in Counter(filling).items()})
        assert made == Counter(pieces) and sum(times for _, times in plan) == fewest(pieces, capacity)


def test_plans_that_a_dominated_filling_hid():
    for capacity, pieces, n in ((20, [2, 3, 3, 5, 5, 6, 7, 8, 8, 8, 10, 15], 4), (37, [6, 8, 9, 10, 12, 12, 13, 19, 21], 3)):
        assert sum(times for _, times in packing.plan_packing(dict(Counter(pieces)), capacity)) == n
    assert packing.Open({5: 1, 4: 1}).candidates(10, 10, 8) == [[5, 4]]


def test_fictional_numbers_stay_fictional():
    rnd = random.Random(3)
    for mention in ("+1 (212) 555-0123", "212-555-0199", "(305) 555 0100"):
        for _ in range(20):
            area = str(rnd.randrange(200, 999))
            said = mention.replace("212", area).replace("305", area)
            text, n = surrogates.replace(f"Call {said} now.", key=KEY)
            digits = "".join(c for c in text if c.isdigit())
            assert n == 1 and digits[-7:-2] == "55501" and said not in text and ("+1 (" in text) == ("+1 (" in said)
    text, _ = surrogates.replace("Call 305-444-1234 or +44 20 7946 0958.", key=KEY)
    assert "+44 " in text and "305-444-1234" not in text and "7946 0958" not in text
