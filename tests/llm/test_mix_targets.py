"""The stage's sample meets its targets."""

from pyspark.sql import functions as F

from reeltable.llm import mixing


def shares(rows, dim):
    sums = {}
    for r in rows:
        sums[r[dim]] = sums.get(r[dim], 0) + r["n_tokens"]
    return {k: v / sum(sums.values()) for k, v in sums.items()}


def test_skewed_corpus_meets_targets(spark):
    """A rare topic, source and language whose targets are far above their shares."""
    n = 60_000
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "a b c d e f x@y").otherwise("a b c d e f g").alias("text"),
        F.when(F.col("id") % 40 < 3, "small").otherwise("large").alias("source"), F.when(F.col("id") % 30 < 2, "de").otherwise("en").alias("lang"))
    cells = mixing.described(docs).groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("tokens"))
    got = mixing.described(mixing.sample_mix(docs)).collect()
    for dim in mixing.DIMS:
        target = {r[0]: r["target"] for r in mixing.targets_of(cells, dim).collect()}
        have = shares(got, dim)
        assert have.keys() == target.keys()
        assert all(abs(have[k] - v) < 0.02 for k, v in target.items()), (dim, have, target)


def cells_of(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, lang string, topic string, tokens long")


def test_keeps_what_the_targets_allow(spark):
    """One dimension tells: the rare topic has 10 of 100 tokens and a target of a half, so 20 tokens can stay, less the slack."""
    cells = cells_of(spark, ("s", "l", "rare", 10), ("s", "l", "prose", 90))
    fit = mixing.fit(cells, given={"topic": {"rare": 0.5, "prose": 0.5}})
    p = {r["topic"]: r["probability"] for r in fit.cells.collect()}
    assert abs(fit.kept - 0.2 * mixing.SLACK) < 1e-9 and fit.miss < 1e-6
    assert abs(p["rare"] - mixing.SLACK) < 1e-4 and abs(p["prose"] - mixing.SLACK / 9) < 1e-4
    full = mixing.fit(cells_of(spark, ("s", "l", "a", 50), ("s", "l", "b", 50)), given={"topic": {"a": 0.4, "b": 0.6}})
    assert abs(full.kept - 0.75) < 1e-9 and full.miss < 1e-6


def test_some_targets_given(spark):
    """One of twenty equal sources gets half; the others share the rest."""
    cells = cells_of(spark, *((f"s{i}", "l", "t", 10) for i in range(20)))
    got = {r["source"]: r["target"] for r in mixing.targets_of(cells, "source", {"s0": 0.5, "absent": 0.3}).collect()}
    assert abs(got["s0"] - 0.5) < 1e-12 and all(abs(got[f"s{i}"] - 0.5 / 19) < 1e-12 for i in range(1, 20))


def test_a_cap_is_made_up_for_by_others(spark):
    """A small cell is full at once; the rest of its source and topic makes up for it, and all shares hold."""
    cells = cells_of(spark, ("a", "l", "x", 2), ("a", "l", "y", 98), ("b", "l", "x", 98), ("b", "l", "y", 902))
    fit = mixing.fit(cells, given={"source": {"a": 0.3, "b": 0.7}, "topic": {"x": 0.3, "y": 0.7}})
    rows = [(r["source"], r["topic"], r["tokens"] * r["probability"]) for r in fit.cells.collect()]
    total = sum(t for *_, t in rows)
    assert abs(total - fit.kept * 1100) < 1e-3 * total
    assert abs(sum(t for s, _, t in rows if s == "a") / total - 0.3) < 1e-3 and abs(sum(t for _, x, t in rows if x == "x") / total - 0.3) < 1e-3


def test_shares_that_cannot_be_met_end_with_the_miss(spark, monkeypatch):
    """Values that occur only together can't have different shares."""
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 5)
    monkeypatch.setattr(mixing, "HALVINGS", 1)
    fit = mixing.fit(cells_of(spark, ("a", "l", "x", 50), ("b", "l", "y", 50)), given={"source": {"a": 0.2, "b": 0.8}, "topic": {"x": 0.8, "y": 0.2}})
    assert fit.miss > 0.1
