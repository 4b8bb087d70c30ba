"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens, by bin completion.

What a packing needs of a corpus is how many pieces have each length: at most `capacity` numbers, however many
documents there are. Best-fit decreasing on that histogram is the first incumbent. A plan is proven where it has as many
sequences as the tokens need at least, or as the pieces of over half a sequence do (`lower_bound`). Otherwise bin
completion looks for a shorter one: it takes the longest open length and enumerates the fillings around it, those with
the least waste first. A filling is dominated, and left out, where one open length fits in place of one or two of its
own and wastes less or is one piece instead of two. A branch ends where its waste is over what so many sequences can
waste in all, and the search goes back over the sequences before. Then sequences that waste most are taken apart with
some others and completed anew, again and again: the incumbent gives way where that takes fewer sequences.

A histogram of many pieces is cut down first: fillings found in the same way are made as often as their lengths last,
until TAIL pieces are left, and those are searched. The search fills NODES pieces anew, a parameter: with more
it finds shorter plans; the plan is whole whatever it is.

The documents then meet their patterns in Spark: each piece gets a number among those of its length (counted by salted
groups, so that no length is one task's), and a lookup turns length and number into sequence and offset. The lookup has
at most a row a length and pattern and is broadcast.

Defined results: a null or empty text is a document of its closing id alone (length 1). Repeated rows, also of one
doc_id, and rows without one are packed as documents of their own; which of two pieces of one length takes which place is
told by doc_id, piece and digest, and between equal ones it doesn't matter. A very long text is cut into full pieces,
which are patterns of one. An empty table gives an empty result. Only doc_id and text are read, so other columns can't
clash.
"""

from __future__ import annotations

import functools
import math
import os
import random
import re
import string
import struct
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reeltable.llm.common import own_names, table, written

CAPACITY, CLOSING_ID = 4096, 1
#: Pieces that a search fills anew at most, and sequences until it starts over in another order; fillings looked at in a node, and steps for them; pieces searched at once.
NODES, TURN, WIDTH, STEPS, TAIL = 60_000, 1_000, 8, 600, 1_500
#: Steps of the search that sees all fillings, which proves a plan the shortest if they suffice.
PROOF = 300_000
ROWS_PER_SALT = 4_096
WORD_CACHE = 1 << 18
BEHIND, PAST_LATIN = string.punctuation.replace("'", ""), "\u0250"  # an apostrophe may begin a token group with letters
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level tokenizers write printable bytes as themselves and the others, in order, as the letters from U+0100 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _OWN)}
ODD_SPACE = re.compile("[\x1c-\x1f]")  # Python splits at these, the tokenizer doesn't


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """ids of whole texts, kept by word: texts repeat words, and this tokenizer joins nothing across white space.

    New words of Latin letters, with or without punctuation behind, go to the tokenizer's model in its lower case and
    byte letters; other new words to the whole tokenizer. Texts with the tokenizer's special strings, with separators
    that only Python takes for white space, or not in the tokenizer's normal form go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize

    def direct(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        core = word.rstrip(BEHIND)
        if core.isalpha() and (core.isascii() or max(core) < PAST_LATIN and core.lower().isalpha()):
            low = core.lower()
            ids = [p.id for p in self.pieces(low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTERS))]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(core) < len(word):
                found += self[word[len(core) :]]  # punctuation is a token group of its own
        else:
            found = self.direct(word)
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The text's ids, each as four bytes, the lowest first."""
        if "<|" in text or not (text.isascii() or unicodedata.is_normalized("NFC", text)) or ODD_SPACE.search(text):
            return self.direct(text)
        return b"".join(map(self.__getitem__, text.split()))


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """One for each Python worker, which keeps its words from task to task."""
    return WordEncoder(path)


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) for each piece of each document."""
    path = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = encoder_of(path), closing_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + closing
                doc = doc_id.as_py()
                for piece, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc, piece, at, len(part) // 4, part))
                held += len(ids)
                if held > 1 << 23:
                    yield _pieces(rows)
                    rows, held = [], 0
            yield _pieces(rows)

    def _pieces(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    chosen = own_names(docs, "doc_id", "text")
    return chosen.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary")


class Open:
    """The pieces that are still to be packed: how many of each length, and the lengths that there are, ascending."""

    def __init__(self, histogram: dict[int, int]):
        self.counts = {x: n for x, n in histogram.items() if n > 0}
        self.lengths = sorted(self.counts)
        self.pieces, self.tokens = sum(self.counts.values()), sum(x * n for x, n in self.counts.items())

    def take(self, filling: list[int], times: int = 1) -> None:
        for x in filling:
            self.counts[x] -= times
            if not self.counts[x]:
                del self.counts[x], self.lengths[bisect_left(self.lengths, x)]
        self.pieces -= len(filling) * times
        self.tokens -= sum(filling) * times

    def put_back(self, filling: list[int]) -> None:
        for x in filling:
            if x not in self.counts:
                self.counts[x] = 0
                insort(self.lengths, x)
            self.counts[x] += 1
        self.pieces += len(filling)
        self.tokens += sum(filling)

    def between(self, low: int, high: int) -> bool:
        """Whether there is a length in [low, high]."""
        i = bisect_left(self.lengths, low)
        return i < len(self.lengths) and self.lengths[i] <= high

    def fillings(self, gap: int, waste: int, start: float = 1.0, steps: int = STEPS) -> Iterator[list[int]]:
        """Descending lists of lengths that fill gap but for waste at most, and that nothing more fits into; in so many steps at most.
        They begin with the length at `start` of those that fit, go down, and then come to those above."""
        lengths, counts, smallest = self.lengths, self.counts, self.lengths[0] if self.lengths else 0

        def rest_of(gap: int, i: int, low: int, chosen: list[int]) -> Iterator[list[int]]:
            nonlocal steps
            any_fits = False
            while i >= low and steps > 0:
                steps -= 1
                x = lengths[i]
                run = 0  # chosen descends, so what it holds of x stands at its end
                while run < len(chosen) and chosen[-1 - run] == x:
                    run += 1
                if run < counts[x]:
                    any_fits, left = True, gap - x
                    if left == 0 or left < smallest and left <= waste:
                        yield [*chosen, x]
                    elif left >= smallest:
                        yield from rest_of(left, min(i, bisect_right(lengths, left) - 1), 0, [*chosen, x])
                    else:  # neither full nor room for more: on to what leaves room
                        i = min(i, bisect_right(lengths, gap - smallest))
                i -= 1
            if not any_fits and low == 0 and gap <= waste:
                yield chosen

        top = bisect_right(lengths, gap) - 1
        if top < 0:
            if gap <= waste:
                yield []
            return
        first = int(top * start)
        yield from rest_of(gap, first, 0, [])
        if first < top:
            yield from rest_of(gap, top, first + 1, [])

    def dominated(self, filling: list[int], waste: int) -> bool:
        """Whether a length that stays open beside the filling can stand for one of its first few with less waste, or for two of them."""
        self.take(filling)
        found = self._replaceable(filling[:4], waste)
        self.put_back(filling)
        return found

    def _replaceable(self, filling: list[int], waste: int) -> bool:
        for i, x in enumerate(filling):
            if waste and self.between(x + 1, x + waste):
                return True
            for y in filling[i + 1 :]:
                if self.between(x + y, x + y + waste):
                    return True
        return False

    def candidates(self, gap: int, waste: int, width: int, start: float = 1.0) -> list[list[int]]:
        """The first undominated fillings of gap, least waste first."""
        found: list[tuple[int, list[int]]] = []
        for filling in self.fillings(gap, waste, start):
            left = gap - sum(filling)
            if not self.dominated(filling, left):
                found.append((left, filling))
                if len(found) >= 4 * width or left == 0 and len(found) >= width:
                    break
        return [f for _, f in sorted(found, key=lambda f: f[0])[:width]]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that are needed at least: by the tokens, and by pieces of which no two share a sequence together with what can't stand beside them."""
    total = sum(x * n for x, n in histogram.items())
    bound = -(-total // capacity)
    for small in [1, *sorted(x for x in histogram if x <= capacity // 2)]:
        alone = sum(n for x, n in histogram.items() if x > capacity - small)
        big = {x: n for x, n in histogram.items() if capacity // 2 < x <= capacity - small}
        rest = sum(x * n for x, n in histogram.items() if small <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in big.items())
        bound = max(bound, alone + sum(big.values()) + max(0, -(-(rest - room) // capacity)))
    return bound


def search(histogram: dict[int, int], capacity: int, bins: int, nodes: int) -> list[list[int]] | None:
    """Fillings that pack the histogram into so many sequences, if the search finds them in its nodes."""
    spare = bins * capacity - sum(x * n for x, n in histogram.items())
    if spare < 0:
        return None
    for turn in range(-(-nodes // TURN)):
        open_, order = Open(histogram), random.Random(turn)
        path: list[list[int]] = []
        todo: list[Iterator[list[int]]] = []
        left = [spare]
        for _ in range(TURN):
            if not open_.pieces:
                return path
            if len(path) < bins:
                longest = open_.lengths[-1]
                open_.take([longest])
                # From a length drawn anew each time: always from the longest would use up the lengths in the middle.
                found = open_.candidates(capacity - longest, left[-1], WIDTH, order.random())
                open_.put_back([longest])
                todo.append(iter([[longest, *f] for f in found]))
            else:
                todo.append(iter(()))
            while todo and (step := next(todo[-1], None)) is None:  # back over the sequences before
                todo.pop()
                if path:
                    open_.put_back(path.pop())
                    left.pop()
            if not todo:
                return None  # all that was looked at has been seen
            open_.take(step)
            path.append(step)
            left.append(left[-1] - (capacity - sum(step)))
    return None


def exhausted(histogram: dict[int, int], capacity: int, bins: int, steps: int) -> tuple[list[list[int]] | None, bool]:
    """Fillings that pack the histogram into so many sequences, or None; and whether that is proven: all undominated fillings around
    each longest length were seen, within so many steps."""
    open_, left = Open(histogram), steps

    def around(spare: int) -> Iterator[tuple[list[int], int]]:
        """The fillings around the longest length with the waste that is left beside each, which is taken while it is looked at."""
        longest = open_.lengths[-1]
        gap = capacity - longest
        open_.take([longest])
        for f in list_of(open_.fillings(gap, min(gap, spare), steps=left)):
            waste = gap - sum(f)
            if waste > spare or open_.dominated(f, waste):
                continue
            open_.take(f)
            yield [longest, *f], spare - waste
            open_.put_back(f)
        open_.put_back([longest])

    def list_of(fillings: Iterator[list[int]]) -> list[list[int]]:
        nonlocal left
        found = []
        for f in fillings:
            left -= 1 + len(f)
            if left <= 0:
                return []
            found.append(f)
        return sorted(found, key=sum, reverse=True)

    spare = bins * capacity - sum(x * n for x, n in histogram.items())
    path: list[list[int]] = []
    todo: list[Iterator[tuple[list[int], int]]] = []  # not by recursion, as there may be thousands of sequences
    while open_.pieces:
        todo.append(around(spare) if len(path) < bins and left > 0 else iter(()))
        while todo and (step := next(todo[-1], None)) is None:  # back over the sequences before
            todo.pop()
            if path:
                path.pop()
        if not todo:
            return None, left > 0
        path.append(step[0])
        spare = step[1]
    return path, left > 0


def refilled(histogram: dict[int, int], capacity: int, order: random.Random) -> list[list[int]]:
    """The histogram packed by one filling after another around the longest length, each with the least waste of those looked at, from a length drawn anew each time."""
    open_, found = Open(histogram), []
    while open_.pieces:
        longest = open_.lengths[-1]
        open_.take([longest])
        gap = capacity - longest
        best = open_.candidates(gap, 0, 1, order.random()) or open_.candidates(gap, capacity, 2, order.random())
        found.append([longest, *(best[0] if best else [])])
        open_.take(found[-1][1:])
    return found


def improved(fillings: list[list[int]], capacity: int, least: int, nodes: int) -> list[list[int]]:
    """The sequences, some that waste most and some others taken apart and filled anew again and again. A round is kept if it takes
    fewer sequences, or as many whose waste lies together better; where one sequence less could do, it is searched for with backtracking first."""
    order, now = random.Random(1), [list(f) for f in fillings]
    worth = lambda some: sum(sum(f) ** 2 for f in some)
    spent = 0
    while len(now) > least and spent < nodes:
        now.sort(key=sum)
        loose = sum(sum(f) < capacity for f in now)
        few = min(loose, order.randint(2, 14))
        others = order.sample(range(few, len(now)), min(len(now) - few, order.randint(2, 14)))
        chosen = [*range(few), *others]
        taken = [now[i] for i in chosen]
        pieces = Counter(x for f in taken for x in f)
        made = search(pieces, capacity, len(taken) - 1, len(taken)) if len(taken) < 12 else None
        made = made or refilled(pieces, capacity, order)
        spent += pieces.total()
        if (len(made), -worth(made)) <= (len(taken), -worth(taken)):
            gone = set(chosen)
            now = [f for i, f in enumerate(now) if i not in gone] + made
    return now


def tallied(fillings: list[list[int]]) -> list[tuple[list[int], int]]:
    return [(list(f), n) for f, n in Counter(tuple(sorted(f, reverse=True)) for f in fillings).items()]


def completed(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """Patterns by bin completion: in bulk while there are many pieces, then one by one with the search behind it."""
    open_, patterns = Open(histogram), []
    while open_.pieces > TAIL:
        longest = open_.lengths[-1]
        open_.take([longest])
        found = open_.candidates(capacity - longest, 0, 1) or open_.candidates(capacity - longest, capacity, 2)
        open_.put_back([longest])
        filling = [longest, *(found[0] if found else [])]
        uses = Counter(filling)
        times = max(1, min(min(open_.counts[x] // n for x, n in uses.items()), (open_.pieces - TAIL) // len(filling)))
        open_.take(filling, times)
        patterns.append((filling, times))
    return patterns + tallied(shortest(dict(open_.counts), capacity, nodes))


def shortest(histogram: dict[int, int], capacity: int, nodes: int) -> list[list[int]]:
    """The fewest sequences found for a histogram of at most about TAIL pieces; best fit's are the first incumbent."""
    least = lower_bound(histogram, capacity)
    best = [f for f, n in best_fit(histogram, capacity) for _ in range(n)]
    if len(best) > least:
        best = min(best, search(histogram, capacity, least, TURN) or best, refilled(histogram, capacity, random.Random(0)), key=len)
        best = improved(best, capacity, least, nodes)
    while len(best) > least:  # what is left is proven, or the steps end
        found, _ = exhausted(histogram, capacity, len(best) - 1, PROOF)
        if found is None:
            break
        best = found
    return best


def repacked(patterns: list[tuple[list[int], int]], capacity: int, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """patterns, those sequences that waste most and some others taken apart and searched anew."""
    taken, kept, pieces = Counter(), [], 0
    for filling, times in sorted(patterns, key=lambda p: sum(p[0])):
        n = min(times, max(0, (TAIL - pieces) // len(filling)))
        pieces += n * len(filling)
        if n:
            taken.update({x: c * n for x, c in Counter(filling).items()})
        if times > n:
            kept.append((filling, times - n))
    return kept + tallied(shortest(dict(taken), capacity, nodes))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of best-fit decreasing. Bins alike are counted, not listed, so the work is bounded by the lengths too."""
    open_: list[list] = []  # [free, filling, bins], ascending by free
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            i = bisect_left(open_, length, key=lambda g: g[0])
            free, filling, bins = open_.pop(i) if i < len(open_) else (capacity, [], -1)
            each = free // length
            whole = n // each if bins < 0 else min(bins, n // each)
            if whole:
                insort(open_, [free - each * length, filling + [length] * each, whole], key=lambda g: g[0])
                n -= whole * each
            if bins - whole > 0 or bins < 0 and n:
                if 0 < n < each:  # one bin takes the rest
                    insort(open_, [free - n * length, filling + [length] * n, 1], key=lambda g: g[0])
                    n, whole = 0, whole + 1
                if bins - whole > 0:
                    insort(open_, [free, filling, bins - whole], key=lambda g: g[0])
    return [(filling, bins) for _, filling, bins in open_]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """(lengths of a filling, how often it is made)."""
    histogram = {x: n for x, n in histogram.items() if n > 0}
    size = lambda plan: sum(times for _, times in plan)
    best, least = best_fit(histogram, capacity), lower_bound(histogram, capacity)
    for better in (lambda: repacked(best, capacity, nodes), lambda: completed(histogram, capacity, nodes)):
        if size(best) > least:
            best = min(best, better(), key=size)
    return best


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple]:
    """(length, from, to, uses, sequence, offset): of a length's pieces, number k in [from, to) goes to sequence + (k - from) // uses, at offset + length * ((k - from) % uses)."""
    found, sequence, taken = [], 0, {}
    for filling, times in patterns:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            uses = filling.count(length)
            at = taken.get(length, 0)
            found.append((length, at, at + uses * times, uses, sequence, offset))
            taken[length] = at + uses * times
            offset += uses * length
        sequence += times
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces (doc_id, piece, length, ids_crc32 and more; a written table, as it is read twice) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity numbers
    salts = max(1, math.ceil(max(histogram.values(), default=0) / ROWS_PER_SALT))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # a row a salt
    offsets = groups.select("length", "_salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    lookup = spark.createDataFrame(slots(plan_packing(histogram, capacity, nodes)), "length long, _from long, _to long, _uses long, _sequence long, _offset long")
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_row", F.row_number().over(own) - 1).join(offsets, ["length", "_salt"]).withColumn("_k", F.col("_before") + F.col("_row"))
    # The lookup is bounded by the capacity, not by the documents.
    placed = numbered.join(F.broadcast(lookup), (numbered["length"] == lookup["length"]) & (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to"))).drop(lookup["length"])
    k = F.col("_k") - F.col("_from")
    placed = placed.withColumns({"sequence_id": F.col("_sequence") + F.floor(k / F.col("_uses")), "offset": F.col("_offset") + F.col("length") * F.pmod(k, F.col("_uses"))})
    return placed.drop("_salt", "_row", "_before", "_k", "_from", "_to", "_uses", "_sequence", "_offset")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. Tokens are made once; only their sizes and digests are kept for packing."""
    return pack(written(digest(pieces_of(docs, tokenizer, capacity))), capacity, nodes)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
