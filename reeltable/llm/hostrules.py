"""Quality rules by host: rule failures are summed by source, their rates shrunk with an empirical beta prior, and the host's verdict goes back to its documents.

The prior's mean is the common rate; its weight comes from how much the hosts' rates differ beyond what chance alone makes
of so many documents (moments weighted by documents, the binomial noise taken out). Hosts that differ no more than by
chance share the common rate; hosts that differ as much as they can keep their own.

Defined results: a null or empty text has no words (all counts 0, base_failed). A null source is a host of its own.
An empty table gives an empty result. Each row is judged by itself, so repeated rows stay and extra columns do no harm.
A very long text is one row's work, linear but for a sort of its windows. Hosts with a rate at the limit are kept.
Everything is DataFrame functions; a document never leaves its row, and only sums by host are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltable.llm.common import carried, let, own_names, table, words_of, written

#: A host goes when its shrunken failure rate is above this.
MAX_RATE = 0.6
#: Rules that count against the host besides the base rules: symbols a word, share of repeated lines.
MAX_SYMBOLS_PER_WORD, MAX_DUP_LINE_SHARE = 0.5, 0.5
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are compared by a 64-bit hash of their words.

    Only texts with a repeated window pay for the sort; the sorted (hash, place) pairs show repeats side by side, and
    each repeated window adds the words that the next repeated window doesn't cover.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda s: F.sort_array(F.filter(F.transform(s, lambda e, k: F.when((F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"])), lambda x: x.isNotNull())))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(starts, covered))

    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(F.slice(hashed, 1, F.size(w) - 2), repeated)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(windows(w)))


def score_documents(docs: DataFrame) -> DataFrame:
    """docs with the metrics, `base_failed` and `rule_failed` (base or one of the softer rules)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    counted = docs.withColumns({"_w": of_words, "_lines": of_lines, "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long")})
    counted = counted.withColumns({**{c: F.col(f"_w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}, "n_dup_lines": (F.col("_lines.n") - F.col("_lines.d")).cast("long"), "_n_lines": F.col("_lines.n")})
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    soft = (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")) | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("_n_lines"))
    return counted.withColumns({"base_failed": base, "rule_failed": base | soft}).drop("_w", "_lines", "_n_lines")


def host_verdicts(scored: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row a host: n, failed, the shrunken rate and `host_kept`. Only sums by host meet, so a hot host costs a row a task.

    With rates r of n documents each, N in all, k hosts and the common rate m, what the hosts share is
    rho = (sum n (r - m)^2 / (m (1 - m)) - (k - 1)) / (N - sum n^2 / N - (k - 1)), and the prior weighs 1 / rho - 1 documents.
    """
    hosts = scored.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    sums = hosts.agg(
        F.sum("n").cast("double").alias("n"), F.sum("failed").cast("double").alias("f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("f2"), F.count("*").alias("k"))
    mean, extra = F.col("f") / F.col("n"), F.col("k") - 1
    spread = mean * (1 - mean)
    beyond = F.col("n") - F.col("n2") / F.col("n") - extra
    rho = F.when((spread > 0) & (beyond > 0), ((F.col("f2") - F.col("f") * mean) / spread - extra) / beyond).otherwise(F.lit(0.0))
    prior = sums.select(F.struct(mean.alias("mean"), F.least(F.greatest(rho, F.lit(0.0)), F.lit(1.0)).alias("rho")))
    weight = 1 / F.col("p.rho") - 1
    shrunk = F.when(F.col("p.rho") > 0, (F.col("failed") + F.col("p.mean") * weight) / (F.col("n") + weight)).otherwise(F.col("p.mean"))
    return hosts.withColumn("p", prior.scalar()).select("host", "n", "failed", shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_kept"))


def judge(scored: DataFrame, hosts: DataFrame) -> DataFrame:
    """scored with `host_rate` and `kept`. The join has no hint: hosts is a written table, whose size Spark
    knows, so few hosts are broadcast, and many are shuffled and hot ones split by AQE."""
    verdicts = hosts.select("host", "host_rate", "host_kept")
    joined = scored.join(verdicts, scored["source"].eqNullSafe(verdicts["host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))).drop("host", "host_kept")


def judged(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """docs' rows as `_row` with metrics, host_rate and kept. Texts are read once: the scored rows are a written table."""
    scored = written(score_documents(carried(docs, "doc_id", "text", "source")).drop("doc_id", "text"))
    return judge(scored, written(host_verdicts(scored, max_rate)))


def host_rules(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """docs with metrics, base_failed, host_rate and kept, which take the place of columns of these names."""
    added = (*METRICS, "base_failed", "host_rate", "kept")
    return judged(docs, max_rate).select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in added), *added)


def keep_good(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """docs without those that fail the base rules or whose host is rejected."""
    return judged(docs, max_rate).where("kept").select("_row.*")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_names(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    scored = written(score_documents(docs).drop("text"))
    found = judge(scored, written(host_verdicts(scored)))
    return found.select("doc_id", *METRICS, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT doc_id, t, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dl.n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n_repeat_words, 0) AS n_repeat_words, coalesce(dl.n_lines, 0) AS n_lines
    FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS (SELECT *, base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.5 * n_lines AS rule_failed FROM r),
h AS (SELECT source, count(*) AS n, sum(CAST(rule_failed AS INT)) AS failed FROM s GROUP BY source),
p0 AS (SELECT CAST(sum(failed) AS DOUBLE) / sum(n) AS mean, count(*) - 1 AS others, CAST(sum(n) AS DOUBLE) AS total FROM h),
p1 AS (SELECT sum(n * pow(failed / n - mean, 2)) AS s, sum(CAST(n AS DOUBLE) * n) AS n2 FROM h, p0),
p2 AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND total - n2 / total - others > 0 THEN least(1, (s / (mean * (1 - mean)) - others) / (total - n2 / total - others)) ELSE 0 END AS rho FROM p0, p1),
v AS (SELECT source, CASE WHEN rho > 0 THEN (failed + mean * (1 / rho - 1)) / (n + 1 / rho - 1) ELSE mean END AS host_rate FROM h, p2)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND host_rate <= 0.6 AS kept, round(host_rate, 6) AS host_rate
FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
"""
