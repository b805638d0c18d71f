"""Leaked evaluation items, mixtures of sources and personal information in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vektorium.llm import leaks, mixing, pii
from vektorium.sources.tables import read, stored


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p6_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's template with other numbers or names in its slots."""
    return leaks.reparameterised(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p6_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents that hold it."""
    items = read(spark, sf_dir, "eval_items").select("item_id", "suite")
    return items.join(p6_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents"))


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, tuple[float, int]], dict[str, int]]:
    docs = read(spark, sf_dir, "documents").where(F.col("source").isNotNull()).select("doc_id", mixing.source_name(F.col("source")).alias("source"), "text")
    sized = stored(mixing.with_tokens(docs, ["doc_id", "source"], "text"), "tokens")
    wanted = mixing.wanted_of(read(spark, sf_dir, "mixture_targets"))
    return sized, wanted, mixing.available_tokens(sized, wanted)


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, mixing.Budget]]:
    sized, wanted, available = _sized(spark, sf_dir)
    return sized, mixing.plan(available, wanted, mixing.whole_total(available, wanted))


def _shares(sized: DataFrame, budgets: dict[str, mixing.Budget]) -> DataFrame:
    """Target, planned and actual share of every listed source, with the exponent they come from."""
    drawn = mixing.draw(sized, budgets).groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), F.max("block").alias("passes"))
    drawn = drawn.withColumn("_share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1))))  # at most one row a listed source
    rows = [(s, b.target, b.max_repeats, b.available, b.exponent, b.weight) for s, b in budgets.items()]
    goal = sized.sparkSession.createDataFrame(rows, "source string, target_weight double, max_repeats int, available_tokens long, exponent double, planned_share double")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return goal.join(drawn, "source", "left").select(*goal.columns, zero("n_tokens"), zero("n_rows"), zero("passes"), F.coalesce("_share", F.lit(0.0)).alias("actual_share"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each copy drawn, in the order of ``mix_key``."""
    return mixing.draw(*_mixture(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, planned and actual share of every listed source in the mixture of ``p7_mixture``."""
    return _shares(*_mixture(spark, sf_dir))


def p7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares at a total of twice what the listed sources have: the exponent gives way to the repetition limits."""
    sized, wanted, available = _sized(spark, sf_dir)
    return _shares(sized, mixing.plan(available, wanted, 2.0 * sum(available.values())))


def p7_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares ``share ** t`` with the entropy of the target weights, within the repetition limits."""
    sized, wanted, available = _sized(spark, sf_dir)
    return _shares(sized, mixing.plan_by_entropy(available, wanted, mixing.bits({s: w for s, (w, _) in wanted.items()})))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders in place of what was found."""
    return pii.redact(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p6_found, p6_reparameterised, p6_by_item, p7_mixture, p7_shares, p7_repetition, p7_entropy, p8_found, p8_redacted)}
SQL: dict[str, str] = {}
