"""Frequent values and percentiles of ``field_values``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vektorium.llm import frequent, percentiles
from vektorium.sources.tables import read, stored

TEXT_FIELDS, NUMBER_FIELDS = ("tag", "source", "category", "status"), ("price", "score", "temperature", "age", "count")
SHARE, ACCURACY, QS = 0.01, 0.01, (0.01, 0.5, 0.9, 0.95, 0.99)
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field_name, s_val`` of kind s, not null, each ``value_id`` once (the latest delivery holds)."""
    v = read(spark, sf_dir, "field_values").where(F.col("field_name").isin(*TEXT_FIELDS))
    v = v.select("value_id", "arrived_at", "field_name", F.when(F.col("val_kind") == "s", F.col("s_val")).alias("s_val"))
    v = frequent.latest_rows(v, ["value_id"], ["arrived_at", "s_val"])
    return stored(v.where("s_val IS NOT NULL").select("field_name", "s_val"), "strings")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent_values(_strings(spark, sf_dir), "field_name", "s_val", SHARE).select(F.col("grp").alias("field_name"), F.col("value").alias("s_val"))


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent values of each field among those of at least 1 in 200, with exact counts."""
    top = frequent.top_values(_strings(spark, sf_dir), "field_name", "s_val", 20, 0.005)
    return top.select(F.col("grp").alias("field_name"), F.col("value").alias("s_val"), F.col("n_exact").alias("n"), F.col("rank").cast("int").alias("rank"))


def p3_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sketch's own estimates lie above the true counts, by field."""
    f = frequent.frequent_values(_strings(spark, sf_dir), "field_name", "s_val", SHARE)
    return f.groupBy(F.col("grp").alias("field_name")).agg(F.count("*").alias("n_values"), F.max((F.col("est") - F.col("n_exact")) / F.col("n_group")).alias("max_excess_share"), F.min((F.col("est") - F.col("n_exact")) / F.col("n_group")).alias("min_excess_share"))


def number_of(kind: Column, i: Column, f: Column, s: Column) -> Column:
    """The number in the column that the kind names; text counts if it is a plain decimal number."""
    return F.when(kind == "i", i.cast("double")).when(kind == "f", f).when((kind == "s") & s.rlike(NUMBER), F.expr("try_cast(trim(s_val) AS double)"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "field_values").where(F.col("field_name").isin(*NUMBER_FIELDS))
    x = number_of(F.col("val_kind"), F.col("i_val"), F.col("f_val"), F.col("s_val"))
    v = v.select("value_id", "arrived_at", "field_name", "coll_name", F.to_date("ts").alias("day"), percentiles.bucket_of(x, ACCURACY).alias("bucket"))
    v = frequent.latest_rows(v, ["value_id"], ["arrived_at", "bucket"]).where("bucket IS NOT NULL")
    return v.groupBy("field_name", "coll_name", "day", "bucket").agg(F.count("*").alias("n"))


def p4_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result that is kept per day: bucket counts by field, collection and day of ``ts``."""
    return _daily(spark, sf_dir)


def _quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded to six digits after the point, as two engines' powers differ in the last bit."""
    q = percentiles.quantiles(sketches, keys, QS, ACCURACY)
    return q.select(*(F.round(c, 6).alias(c) if c.startswith("q") else c for c in q.columns))


def p4_by_collection_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantiles(_daily(spark, sf_dir), ["field_name", "coll_name", "day"])


def p4_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sketches combined over collections and days."""
    return _quantiles(percentiles.combine(_daily(spark, sf_dir), ["field_name"]), ["field_name"])


def p4_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sketches combined over days."""
    keys = ["field_name", "coll_name"]
    return _quantiles(percentiles.combine(_daily(spark, sf_dir), keys), keys)


QUERIES = {f.__name__: f for f in (p3_found, p3_top, p3_estimates, p4_daily_sketches, p4_by_collection_day, p4_by_field, p4_by_collection)}

_TEXT = "WITH v AS (SELECT field_name, s_val FROM (SELECT *, row_number() OVER (PARTITION BY value_id ORDER BY arrived_at DESC) AS rn FROM field_values WHERE field_name IN ('tag', 'source', 'category', 'status')) WHERE rn = 1 AND val_kind = 's' AND s_val IS NOT NULL), c AS (SELECT field_name, s_val, count(*) AS n, sum(count(*)) OVER (PARTITION BY field_name) AS total FROM v GROUP BY field_name, s_val)"
_LG = repr(math.log((1 + ACCURACY) / (1 - ACCURACY)))
_GAMMA = repr((1 + ACCURACY) / (1 - ACCURACY))
_DAILY = f"""
WITH x AS (SELECT field_name, coll_name, CAST(ts AS DATE) AS day, CASE WHEN val_kind = 'i' THEN CAST(i_val AS DOUBLE) WHEN val_kind = 'f' THEN f_val
    WHEN val_kind = 's' AND regexp_matches(s_val, '{NUMBER}') THEN CAST(trim(s_val) AS DOUBLE) END AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY value_id ORDER BY arrived_at DESC) AS rn FROM field_values WHERE field_name IN ('price', 'score', 'temperature', 'age', 'count')) WHERE rn = 1),
d AS (SELECT field_name, coll_name, day, CAST(CASE WHEN abs(x) < 1e-12 THEN 0 ELSE sign(x) * (ceil(ln(CASE WHEN x = 0 THEN 1.0 ELSE abs(x) END) / {_LG}) + 1048576) END AS INTEGER) AS bucket, count(*) AS n
  FROM x WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) GROUP BY ALL)
"""


def _quantile_sql(keys: str) -> str:
    value = f"CASE WHEN b = 0 THEN 0.0 ELSE sign(b) * pow({_GAMMA}, abs(b) - 1048576) * (2 / ({_GAMMA} + 1)) END"
    picks = ", ".join(f"min(CASE WHEN c > floor({q} * (total - 1)) THEN bucket END) AS b{i}" for i, q in enumerate(QS))
    outs = ", ".join(f"round({value.replace('b)', f'b{i})').replace('b =', f'b{i} =')}, 6) AS q{q * 100:g}" for i, q in enumerate(QS))
    part = f"PARTITION BY {keys}"
    return _DAILY + f", e AS (SELECT {keys}, bucket, sum(n) AS n FROM d GROUP BY {keys}, bucket), f AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS c, sum(n) OVER ({part}) AS total FROM e), g AS (SELECT {keys}, CAST(max(total) AS BIGINT) AS n, {picks} FROM f GROUP BY {keys}) SELECT {keys}, n, {outs} FROM g"


SQL = {
    "p3_found": _TEXT + f" SELECT field_name, s_val FROM c WHERE n >= {SHARE} * total",
    "p3_top": _TEXT + ", r AS (SELECT field_name, s_val, n, row_number() OVER (PARTITION BY field_name ORDER BY n DESC, s_val) AS rank FROM c WHERE n >= 0.005 * total) SELECT field_name, s_val, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20",
    "p4_daily_sketches": _DAILY + "SELECT field_name, coll_name, day, bucket, n FROM d",
    "p4_by_collection_day": _quantile_sql("field_name, coll_name, day"),
    "p4_by_field": _quantile_sql("field_name"),
    "p4_by_collection": _quantile_sql("field_name, coll_name"),
}
