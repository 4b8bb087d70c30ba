"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has 64 bits. Each bit is given one of the 2^(r+1) - 1 nonzero vectors of r + 1 bits; table v keeps the
bits whose vector has an odd inner product with v. Any r bits leave some v orthogonal to all their vectors, so two
fingerprints that differ in at most r bits agree on everything that table v keeps: each such pair meets in some bucket.

Within a bucket only the bits that its table leaves out can differ. Two fingerprints are within 2 bits of one another
exactly if some centre is within 1 bit of both, so each member of a bucket emits itself and its one-bit changes in the
left-out bits, and members that share a centre are linked to the smallest of them. That is linear in the bucket's
size, links all pairs within 2 bits and no others directly; nothing collects a bucket. Components are then found by
alternating large-star and small-star steps on written tables.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other. A null
doc_id takes part, but component_id is the smallest that isn't null. Repeated rows stay, and ties have one component. An empty table gives an empty
result. Texts of any length are read whole, in blocks of shingles. Only doc_id and text are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from reeltable.llm.common import own_names, table, written

RADIUS, SHINGLE, SEED = 2, 3, 42
BLOCK = 1 << 15  # shingles whose bits are counted at once


def simhash(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1  # where each word ends
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@pandas_udf(LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([simhash(t) for t in s], dtype="int64")


def table_masks(radius: int = RADIUS) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables, as signed 64-bit integers."""
    n = (1 << (radius + 1)) - 1
    vectors = [1 + i % n for i in range(64)]
    masks = [sum(1 << i for i in range(64) if bin(vectors[i] & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _flips(mask: int) -> list[int]:
    return [0] + [(1 << i) - (1 << 64) * (i == 63) for i in range(64) if not (mask >> i) & 1]


def bucket_links(prints: DataFrame) -> DataFrame:
    """prints: distinct `fp`. Links (a, b), a > b, that join up all fingerprints within 2 bits of one another."""
    masks = table_masks()
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(m).alias("mask")) for t, m in enumerate(masks))))
    keyed = prints.select("fp", tables.alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    members = keyed.join(shared, ["t", "key"], "left_semi").select("t", "fp")
    flips = F.element_at(F.array(*(F.array(*map(F.lit, _flips(m))) for m in masks)), F.col("t") + 1)
    centres = members.select("t", "fp", F.explode(flips).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    hubs = centres.groupBy("t", "centre").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    return centres.join(hubs, ["t", "centre"]).where("fp > hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b) that isn't its component's smallest node, which is the root.

    Large-star: each node links its larger neighbours to its smallest neighbour. Small-star: each node links its smaller
    neighbours, and itself, to the smallest of them. Their alternation ends in stars after about log^2 rounds; each
    round's links are a written table, and no round has more links than the one before. The end is told by the links themselves:
    no node has two, and none that is linked to has one of its own.
    """
    links = written(links.select("a", "b"))
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        links = written(small)
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(links.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs' doc_id with `fp` (long) and component_id, the smallest doc_id reachable over fingerprints within 2 bits."""
    return joined_up(fingerprints(docs)).select("doc_id", "fp", "component_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp of each of docs; a written table."""
    return written(own_names(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_udf("text").alias("fp")))


def joined_up(printed: DataFrame) -> DataFrame:
    """printed (doc_id, fp and more) with component_id and `component`, the smallest fingerprint, as components may share a doc_id."""
    prints = written(printed.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(bucket_links(prints.select("fp")))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = rooted.join(of_root, "root").select("fp", "component_id", F.col("root").alias("component"))
    return printed.join(of_print, "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Of docs one document of each component, by placed (doc_id, text_hash, component): that with the smallest doc_id (none: the last), then the
    smallest hash of the text. Documents are told apart by both, so rows that share a doc_id, or have none, are different documents unless
    their texts are equal too; of such one row stays."""
    own, order = "_text_hash_of_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = placed.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_keep"), F.col("k.text_hash").alias("_hash"))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    return hashed.join(keep, hashed["doc_id"].eqNullSafe(keep["_keep"]) & (hashed[own] == keep["_hash"]), "left_semi").dropDuplicates(["doc_id", own]).drop(own)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without those that another document of their component stands for."""
    return first_of_each(docs, joined_up(fingerprints(docs)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
