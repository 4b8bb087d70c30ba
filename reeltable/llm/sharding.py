"""Sharding by vector bin packing: groups of equal texts go to shards so that bytes, tokens and rows balance jointly.

Each group goes where the dot product of its size vector with the shards' residual capacity is highest, largest groups
first. Groups of over 1 / (LARGE * shards) of all bytes or rows are placed first, over the whole corpus: there are at most
2 * LARGE * shards of them, so they are placed in one go on the driver. All others are dealt by hash to cells of about
GROUPS_PER_CELL, which are filled in parallel: a cell shares out what the large groups left of the shards' capacity, so
it makes up for them, and its own remainders are small, as its groups are. The law that holds is `bytes`: shards' sizes
are near equal.

A group stays whole as long as it fits a shard. One with more bytes than a shard's share can't, and is split by a hash of
doc_id into parts of a quarter of that share. Slots number each shard's rows from 0 by counting in salted groups, so that a
shard is never one task's.

Defined results: a null text has no bytes and is grouped with the empty text; size is bytes + 1. Rows with a null or
repeated doc_id are rows like others. Groups of one size are taken in the order of their text's digest. A very long text
is a row like others; one of more than a shard's share stays whole. An empty table gives an empty result. Only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reeltable.llm.common import own_names, table, words_of, written

SHARDS, LARGE, GROUPS_PER_CELL, ROWS_PER_SALT = 8, 64, 4096, 4096
#: Bytes are the law, so they weigh most where the three pull apart.
WEIGHTS = (64.0, 1.0, 1.0)


def place(sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each row of sizes (groups x dimensions), largest first, by the highest dot product with the residual capacity
    of room (shards x dimensions). Of equal ones the first shard; what room has beyond the groups is shared by all."""
    totals = sizes.sum(axis=0)
    scale = np.sqrt(np.array(WEIGHTS))[: sizes.shape[1]] / np.where(totals > 0, totals, 1)
    unit, left = sizes * scale, room * scale
    out = np.empty(len(sizes), dtype=np.int32)
    for i in np.argsort(-unit.max(axis=1), kind="stable"):
        best = int(np.argmax(left @ unit[i]))
        out[i] = best
        left[best] -= unit[i]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens, the text's digest and a number of the row's own, to be written before it is used."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = own_names(docs, "doc_id", "text")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.size(words_of(text)).cast("long").alias("tokens"), F.unhex(F.md5(text.cast("binary"))).alias("key"), F.monotonically_increasing_id().alias("row"))


def large_groups(rows: DataFrame, groups: DataFrame, share: np.ndarray, shards: int) -> DataFrame:
    """key, part, b, t, n of the large groups; those that fit no shard in parts of at most a quarter of a shard's share. At most 10 * LARGE * shards rows."""
    large = groups.where((F.col("b") > float(share[0] / LARGE)) | (F.col("n") > float(share[2] / LARGE)))
    parts = F.when(F.col("b") > float(share[0]), F.least(F.col("n"), F.ceil(F.col("b") * 4 / float(max(share[0], 1.0))))).otherwise(F.lit(1)).cast("long")
    split = large.where(F.col("b") > float(share[0])).select("key", parts.alias("parts"))  # at most `shards` groups
    split_parts = rows.join(F.broadcast(split), "key").groupBy("key", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part")).agg(F.first("parts").alias("parts"), F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return large.where(F.col("b") <= float(share[0])).select("key", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), "b", "t", "n").unionByName(split_parts)


def shard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (doc_id, size, tokens, key, row; a written table) with shard and slot."""
    spark = rows.sparkSession
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")))
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btn"), F.count("*").alias("groups")).first()
    n_groups, n_rows, share = total["groups"], total["n"], np.array([total["b"], total["t"], total["n"]], dtype=float) / shards
    large = large_groups(rows, groups, share, shards).orderBy("key", "part").collect()  # bounded by parameters
    sizes, room = np.array([[r["b"], r["t"], r["n"]] for r in large], dtype=float).reshape(-1, 3), np.tile(share, (shards, 1))
    at = place(sizes, room)
    np.subtract.at(room, at, sizes)
    first = spark.createDataFrame([(bytes(r["key"]), r["parts"], r["part"], int(s)) for r, s in zip(large, at, strict=True)], "key binary, parts long, part long, shard int")
    cells = max(1, math.ceil(n_groups / GROUPS_PER_CELL))
    left = np.maximum(room, 0) / np.maximum(np.maximum(room, 0).sum(axis=0), 1e-9)  # each shard's part of what is left

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)  # no result hangs on the order of arrival
        sizes = pdf[["b", "t", "n"]].to_numpy(dtype=float)
        turn = int(pdf["cell"].iloc[0]) % shards  # shards take turns at being the first of equal ones
        order = np.roll(np.arange(shards), -turn)
        pdf["shard"] = order[place(sizes, (left * sizes.sum(axis=0))[order])].astype(np.int32)
        return pdf[["key", "shard"]]

    # The large groups' list is bounded by a parameter, so it is broadcast.
    whole = F.broadcast(first.select("key").distinct())
    small = groups.join(whole, "key", "left_anti").withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    placed = small.groupBy("cell").applyInPandas(fill, "key binary, shard int")
    parts = F.broadcast(first.select("key", "parts").distinct())
    put_large = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).join(F.broadcast(first.drop("parts")), ["key", "part"]).drop("parts", "part")
    put_small = rows.join(whole, "key", "left_anti").join(placed, "key")
    put = written(put_large.unionByName(put_small).drop("key", "tokens"))
    salts = max(1, math.ceil(n_rows / (shards * ROWS_PER_SALT)))
    salted = put.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    counts = salted.groupBy("shard", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = Window.partitionBy("shard", "_salt").orderBy("doc_id", "text_crc32", "row")
    return salted.withColumn("_row", F.row_number().over(own) - 1).join(before, ["shard", "_salt"]).withColumn("slot", (F.col("_before") + F.col("_row")).cast("long")).drop("_salt", "_row", "_before", "row")


def op8_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = shard(written(sized(table(spark, sf_dir, "documents"))))
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
