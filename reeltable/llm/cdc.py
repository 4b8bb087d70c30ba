"""Substring dedup by content-defined chunking with a gear rolling hash.

Texts are cut where the rolling hash of the last bytes has given bits zero, so chunks follow the content: an insertion
moves the cuts near it and no others. From each chunk on, as many chunks as it takes to hold MIN_WORDS words are keyed by
one 128-bit digest of their bytes. A digest in two or more documents is a passage that those documents share, bytes in a
row, so no run is pieced together from chunks that different documents happen to hold. Shared passages that overlap or
meet are one span. Whole chunks only are seen, so a passage's edges (up to a chunk each) aren't part of its span;
MIN_WORDS is well under the shortest passage that must be caught for that. Digests are combined on the map side to a row
each with its smallest and largest document before the shuffle; the join back is on digests, whose hot ones AQE splits.

Documents are told apart by `uid`: the doc_id where no other row has it, else, and for ids from 2^62 on, a number above all of
those. So rows that share a doc_id, or have none, are documents of their own.

Defined results: null and empty texts have no chunks. A null doc_id is kept as such; its documents come after all others
in the order that tells which is first. Rows that repeat a doc_id, or have none, are different documents,
told apart and each with its own spans, equal rows too: of those one is the first. A very long text is one task's, chunk by chunk.
Ties of order don't occur, as each row has a uid of its own. An empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from reeltable.llm.common import carried, own_names, table, written

MIN_BYTES, MAX_BYTES, MIN_WORDS = 12, 96, 16
CUT_SHIFT, CUT_BELOW = 8, 10  # a cut where eight bits of the hash are below ten: at one byte in 26


def gear_table() -> np.ndarray:
    """256 scattered 32-bit values, by a rule."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def cuts_of(raw: bytes) -> list[int]:
    """Ends of the chunks of raw, never inside a UTF-8 character."""
    data = np.frombuffer(raw, dtype=np.uint8)
    h = GEAR[data]
    for width in (1, 2, 4, 8):  # the sum over the last 16 bytes, each shifted by its age
        h[width:] += h[:-width] << np.uint32(width)
    whole = np.ones(len(data), dtype=bool)  # a character starts after this byte
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    ends, last = [], 0
    for c in (np.flatnonzero(((h >> np.uint32(CUT_SHIFT)) & np.uint32(255) < CUT_BELOW) & whole) + 1).tolist() + [len(raw)]:
        while c - last > MAX_BYTES:
            cut = last + MAX_BYTES
            while not whole[cut - 1]:
                cut -= 1
            ends.append(cut)
            last = cut
        if c - last >= MIN_BYTES or c == len(raw) and c > last:
            ends.append(c)
            last = c
    return ends


def _passages(raw: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first word and word behind, digests (two signed 64-bit integers each) of the chunks from each chunk on that hold min_words words."""
    ends = np.array(cuts_of(raw))
    starts = np.concatenate(([0], ends[:-1]))
    data = np.frombuffer(raw, dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    counted = np.concatenate(([0], np.cumsum(begins)))
    last = np.searchsorted(counted[ends], counted[starts] + min_words)  # the first chunk that completes the words
    starts = starts[last < len(ends)]
    ends = ends[last[last < len(ends)]]
    d = xxhash.xxh3_128_digest
    digests = np.frombuffer(b"".join([d(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), dtype=">i8").reshape(-1, 2)
    return starts, ends, counted[starts], counted[ends], digests


BIG = 1 << 62
PASSAGES = "uid long, start int, end int, word int, word_end int, hi long, lo long"


def identified(docs: DataFrame) -> DataFrame:
    """docs with `uid`, a row's own: the doc_id where no other row has it, else a number from BIG on. Rows that need one are a written table, in
    order of doc_id and text's hash, so their numbers stay; repeated ids are one too, so Spark knows whether they are few enough to broadcast."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_again"))
    again = written(ids)
    none = F.col("doc_id").isNull() | (F.col("doc_id") >= BIG)
    same = docs["doc_id"] == again["_again"]
    plain = docs.where(~none).join(again, same, "left_anti").withColumn("uid", F.col("doc_id"))
    odd = docs.where(none).unionByName(docs.where(~none).join(again, same, "left_semi")).withColumns({"_hash": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    order = [F.asc_nulls_last("doc_id"), F.asc("_hash"), F.asc("_at")]
    numbered = written(odd.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id() + F.lit(BIG)).drop("_hash", "_at"))
    return plain.unionByName(numbered)


def passages_of(known: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """known: uid, text. From each chunk on, the chunks that hold min_words words: uid, start and end (bytes), word and word_end, digest (hi, lo)."""

    def rows(found: list) -> pa.RecordBatch:
        names = [x.split()[0] for x in PASSAGES.split(", ")]
        uids = np.repeat(np.array([x[0] for x in found], dtype=np.int64), [len(x[1]) for x in found])
        cat = lambda k, dtype: np.concatenate([x[k] for x in found]).astype(dtype) if found else np.zeros(0, dtype)
        digests = np.concatenate([x[5] for x in found]).astype(np.int64) if found else np.zeros((0, 2), np.int64)
        columns = [uids, *(cat(k, np.int32) for k in (1, 2, 3, 4)), np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for uid, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if raw:
                    found.append((uid.as_py(), *_passages(raw, min_words)))
                    held += len(raw)
                if held > 1 << 23:
                    yield rows(found)
                    found, held = [], 0
            yield rows(found)

    return known.select("uid", F.col("text").cast("string")).mapInArrow(cut, PASSAGES)


def spans_of(known: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """known: uid, text. uid, start, end, n_words, first, is_first: what other documents hold too, first being the smallest uid of those that hold a part of it."""
    passages = passages_of(known, min_words)
    digests = passages.groupBy("hi", "lo").agg(F.min("uid").alias("first"), F.max("uid").alias("_last"))
    shared = digests.where("first <> _last").drop("_last")
    place = ("uid", "start", "end", "word", "word_end")
    repeated = passages.join(shared, ["hi", "lo"]).groupBy(*place).agg(F.min("first").alias("first")).withColumn("is_first", F.col("first") == F.col("uid"))
    of_doc = Window.partitionBy("uid", "is_first").orderBy("start")
    runs = repeated.withColumn("_new", (F.coalesce(F.lag("end").over(of_doc), F.lit(-1)) < F.col("start")).cast("int")).withColumn("_run", F.sum("_new").over(of_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("uid", "is_first", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word_end") - F.min("word")).alias("n_words"), F.min("first").alias("first"))
    return spans.select("uid", "start", "end", "n_words", "first", "is_first")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, n_words, first_doc_id, is_first: the passages that other documents hold too.

    is_first: no document that comes before holds it; a corpus without repeats keeps those spans."""
    known = identified(own_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    spans = spans_of(known, min_words)
    # Only uids from 2^62 on stand for another doc_id; those rows' ids are looked up.
    ids = written(known.where(F.col("uid") >= BIG).select("uid", "doc_id"))
    for uid, name in (("uid", "doc_id"), ("first", "first_doc_id")):
        found = ids.select(F.col("uid").alias("_uid"), F.col("doc_id").alias("_id"))
        spans = spans.join(found, spans[uid] == found["_uid"], "left").withColumn(name, F.when(F.col(uid) < BIG, F.col(uid)).otherwise(F.col("_id"))).drop("_uid", "_id")
    return spans.select("doc_id", "start", "end", "n_words", "first_doc_id", "is_first")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, their texts without the spans that a document before them holds."""

    def cut(spans, text):
        if text is None or spans is None:
            return text
        raw, at, kept = text.encode(), 0, []
        for a, b in sorted((s["start"], s["end"]) for s in spans):
            kept.append(raw[at : max(at, a)])
            at = max(at, b)
        return b"".join([*kept, raw[at:]]).decode()

    rows = identified(carried(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}))
    spans = spans_of(rows.select("uid", "text"), min_words).where("not is_first").groupBy(F.col("uid").alias("_uid")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))  # at most a text's chunks
    joined = rows.join(spans, rows["uid"] == spans["_uid"], "left").withColumn("_cut", F.udf(cut, StringType(), useArrow=True)("_spans", "text"))
    return joined.select(*(F.col("_cut").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
