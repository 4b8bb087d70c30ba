"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Each round scales the cells' weights so that the token shares of
the sources meet their targets, then those of the languages, then those of the topics. A document is sampled with its
cell's probability by a hash of its doc_id, so that a rerun samples the same ones.

A probability can't be over 1, so the fit is under that bound: a cell's probability is its weight, or 1 where that is
less, and a step scales what is below 1 to the share that the full cells leave. Of the tokens as many are kept, up to
`keep`, as the targets allow: no value can give more than all it has, so at most the least share / target of all values,
less a SLACK without which the last tokens take many rounds. Rounds go on until no share is off by TOLERANCE of itself.
Where values occur together in too few ways for that, half as many tokens are tried, and so on; the fit of the least
miss is taken then, and the miss is reported.

Targets are the tempered shares of the corpus (share ^ exponent, normalised) unless given by name; names that are not in
the corpus are ignored, and values without a given target share out what the given ones leave, in the ratio of their
tempered shares. Topics are told by rules on the text, or given as a column.

Defined results: null source, language or topic is a value of its own (""); a null or empty text has no tokens and its
document takes the kept share as its probability. A very long text weighs as many tokens as it has. Rows that repeat a
doc_id, or have none, are sampled alike; equal cells are one. An empty table gives an empty result. Extra columns stay and
don't clash. Only sums by cell are shuffled; a cell is one row, and marginals are sums with partial aggregation, so
neither a hot source nor a hot language is one task's. Cells stay in written tables; what the driver sees of them is one
number a round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reeltable.llm.common import WORD, carried, own_names, table, words_of, written

DIMS = ("source", "lang", "topic")
#: Exponents that temper each dimension's shares; 1 keeps a dimension as it is, 0 makes it even.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
KEEP, SLACK = 0.75, 0.95
#: The largest miss of a share, as a part of it, that a fit ends at and that is taken for met; rounds and halvings tried.
TOLERANCE, MET, MOST_ROUNDS, HALVINGS = 1e-4, 1e-3, 30, 3
#: So many cells at most are one task's work in a round.
FEW_CELLS = 50_000
#: First match wins; a topic is told from the whole text.
TOPICS = (("legal", "(?i)licen[sc]e|copyright|rights reserved"), ("contact", "@|[+]1 [(]"), ("tabular", "[|]"), ("technical", "[#$%&=<>]"))
OTHER = "prose"
SEED = "mix1"


def topic_of(text: Column, topics=TOPICS) -> Column:
    found = F.lit(OTHER)
    for topic, pattern in reversed(topics):
        found = F.when(text.rlike(pattern), F.lit(topic)).otherwise(found)
    return found


def described(docs: DataFrame, topics=TOPICS, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens. Topics come from the column `topic` if one is named, else from rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = own_names(docs, "doc_id", "text", "source", "lang", *([topic] if topic else []))
    told = F.coalesce(F.col(topic), F.lit("")) if topic else topic_of(text, topics)
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), told.alias("topic"), F.size(words_of(text)).cast("long").alias("n_tokens"))


def targets_of(cells: DataFrame, dim: str, given: dict[str, float] | None = None) -> DataFrame:
    """dim, `share` of the tokens and `target`, which sums to 1."""
    sums = written(cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0"))
    total = sums.agg(F.sum("t")).scalar()
    named = F.element_at(F.create_map(*(F.lit(x) for k, v in given.items() for x in (k, float(v)))), F.col(dim)) if given else F.lit(None).cast("double")
    told = written(sums.select(dim, (F.col("t") / total).alias("share"), F.pow(F.col("t") / total, F.lit(EXPONENTS[dim])).alias("own"), named.alias("named")))
    sides = told.agg(F.coalesce(F.sum("named"), F.lit(0.0)).alias("g"), F.coalesce(F.sum(F.when(F.col("named").isNull(), F.col("own"))), F.lit(0.0)).alias("rest"))
    left = F.greatest(F.lit(0.0), 1 - F.col("_s.g"))
    raw = F.coalesce("named", F.col("own") * left / F.col("_s.rest"))
    sums_to = F.col("_s.g") + F.when(F.col("_s.rest") > 0, left).otherwise(F.lit(0.0))
    return written(told.withColumn("_s", sides.select(F.struct("g", "rest")).scalar()).select(dim, "share", (raw / sums_to).alias("target")))


@dataclass
class Fit:
    """The cells (DIMS, tokens) with their probability, the share of tokens kept, and the largest miss of a share as a part of it."""

    cells: DataFrame
    kept: float
    miss: float


def rake(cells: DataFrame, targets: dict[str, DataFrame], kept: float) -> tuple[DataFrame, float]:
    """cells (DIMS, tokens; only those with tokens) with `weight`, fitted until kept of all tokens have the target shares, and the largest miss that is left."""
    fitted = written(cells.where("tokens > 0").withColumn("weight", F.lit(float(kept))))
    size = fitted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("n")).first()
    wanted = size["tokens"] * kept
    # A few cells stay in one partition, so that a round needs no shuffle; the sums are the same either way.
    together = (lambda df: df.coalesce(1)) if size["n"] <= FEW_CELLS else (lambda df: df)
    fitted = together(fitted)
    part = F.col("tokens") * F.least(F.lit(1.0), F.col("weight"))
    miss = 0.0
    for _ in range(MOST_ROUNDS):
        step = fitted.withColumn("_miss", F.lit(0.0))
        for dim in DIMS:
            full = F.col("weight") >= 1
            now = step.groupBy(dim).agg(F.sum(part).alias("_now"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("_full"), F.sum(F.when(full, 0.0).otherwise(part)).alias("_free"))
            now = now.join(targets[dim].select(dim, (F.col("target") * wanted).alias("_to")), dim)
            factor = F.when((F.col("_to") > F.col("_full")) & (F.col("_free") > 0), (F.col("_to") - F.col("_full")) / F.col("_free")).otherwise(F.col("_to") / F.col("_now"))
            now = now.select(dim, F.greatest(F.lit(0.25), F.least(F.lit(4.0), factor)).alias("_factor"), F.abs(F.col("_now") / F.col("_to") - 1).alias("_off"))
            step = step.join(now, dim).select(*DIMS, "tokens", (F.col("weight") * F.col("_factor")).alias("weight"), F.greatest("_miss", "_off").alias("_miss"))
        seen = Observation()
        fitted = together(written(step.observe(seen, F.max("_miss").alias("miss")).drop("_miss")))
        miss = seen.get["miss"] or 0.0
        if miss < TOLERANCE:
            break
    return fitted, float(miss)


def fit(cells: DataFrame, keep: float = KEEP, given: dict[str, dict[str, float]] | None = None) -> Fit:
    """The fit with as many tokens, up to keep, as the targets allow."""
    targets = {dim: targets_of(cells, dim, (given or {}).get(dim)) for dim in DIMS}
    bounds = [targets[dim].where("target > 0").agg(F.min(F.col("share") / F.col("target"))).first()[0] for dim in DIMS]
    kept = min([keep, *(SLACK * b for b in bounds if b is not None)])
    best = None
    for turn in range(HALVINGS + 1):
        fitted, miss = rake(cells, targets, kept / 2**turn)
        if best is None or miss < best.miss:
            best = Fit(fitted.withColumn("probability", F.least(F.lit(1.0), F.col("weight"))), kept / 2**turn, miss)
        if miss < MET:
            break
    return best


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) that hangs on doc_id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mix(docs: DataFrame, keep: float = KEEP, given: dict[str, dict[str, float]] | None = None, topics=TOPICS, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, residual (the largest miss of a share), sampled for each of docs."""
    told = written(described(docs, topics, topic))
    found = fit(written(told.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))), keep, given)
    joined = told.join(found.cells.drop("tokens"), [*DIMS], "left").withColumns({"weight": F.coalesce("weight", F.lit(found.kept)), "probability": F.coalesce("probability", F.lit(found.kept)), "residual": F.lit(found.miss)})
    return joined.withColumn("sampled", chance(F.col("doc_id")) < F.col("probability"))


def sample_mix(docs: DataFrame, keep: float = KEEP, given: dict[str, dict[str, float]] | None = None, topics=TOPICS) -> DataFrame:
    """The sampled ones of docs, with their columns. The cells' probabilities are joined back on the cell, not on doc_id."""
    told = written(described(docs, topics))
    found = fit(written(told.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))), keep, given)
    cell = {"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "_topic": topic_of(F.coalesce(F.col("text"), F.lit("")), topics)}
    chances = found.cells.select(*(F.col(d).alias(f"_{d}") for d in DIMS), F.col("probability").alias("_p"))
    joined = carried(docs, "doc_id", "text", "source", "lang").withColumns(cell).drop("text", "source", "lang").join(chances, [*cell], "left")
    return joined.where(chance(F.col("doc_id")) < F.coalesce("_p", F.lit(found.kept))).select("_row.*")


def op5_rake_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 4).alias("probability"), F.round("residual", 2).alias("residual"), "sampled")


def _sql() -> str:
    topic = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS) + f" ELSE '{OTHER}' END"
    steps, last = [], "w0"
    for dim in DIMS:
        steps.append(f"""s_{dim} AS (SELECT {dim}, CAST(sum(tokens) AS DOUBLE) / (SELECT sum(tokens) FROM cells) AS share FROM cells GROUP BY {dim} HAVING sum(tokens) > 0),
t_{dim} AS MATERIALIZED (SELECT {dim}, share, pow(share, {EXPONENTS[dim]}) / (SELECT sum(pow(share, {EXPONENTS[dim]})) FROM s_{dim}) AS target FROM s_{dim})""")
    bounds = ", ".join(f"{SLACK} * (SELECT min(share / target) FROM t_{dim})" for dim in DIMS)
    steps.append(f"k AS MATERIALIZED (SELECT least({KEEP}, {bounds}) AS kept, sum(tokens) AS total FROM cells)")
    steps.append("w0 AS MATERIALIZED (SELECT source, lang, topic, tokens, kept AS weight, CAST(1 AS DOUBLE) AS off_ FROM cells, k WHERE tokens > 0)")
    steps.append("v AS (SELECT true AS live)")
    live = "v"
    for n in range(MOST_ROUNDS):  # those after the shares are met change nothing
        steps.append(f"v{n} AS MATERIALIZED (SELECT max(off_) >= {TOLERANCE} AND (SELECT live FROM {live}) AS live FROM {last})")
        live = f"v{n}"
        for dim in DIMS:
            new = f"w{n}_{dim}"
            steps.append(f"""{new} AS MATERIALIZED (SELECT x.* REPLACE (weight * CASE WHEN (SELECT live FROM {live}) THEN greatest(0.25, least(4, CASE WHEN goal > filled AND free > 0 THEN (goal - filled) / free ELSE goal / now END)) ELSE 1 END AS weight,
greatest({"0" if dim == DIMS[0] else "off_"}, abs(now / goal - 1)) AS off_) FROM {last} x JOIN (
SELECT {dim}, target * kept * total AS goal, now, filled, free FROM (SELECT {dim}, sum(tokens * least(1, weight)) AS now, sum(CASE WHEN weight >= 1 THEN tokens ELSE 0 END) AS filled, sum(CASE WHEN weight < 1 THEN tokens * weight ELSE 0 END) AS free FROM {last} GROUP BY {dim})
JOIN t_{dim} USING ({dim}), k) USING ({dim}))""")
            last = new
    body = ",\n".join(steps)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents),
told AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, CAST(len(regexp_extract_all(t, '{WORD}')) AS BIGINT) AS n_tokens FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM told GROUP BY ALL),
{body}
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(least(1, weight), kept), 4) AS probability, round((SELECT max(off_) FROM {last}), 2) AS residual,
    CAST('0x' || substr(md5('{SEED}' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / {float(1 << 48)} < coalesce(least(1, weight), kept) AS sampled
FROM told LEFT JOIN {last} USING (source, lang, topic), k
"""


OP5_SQL = _sql()
