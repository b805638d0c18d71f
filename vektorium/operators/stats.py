"""Statistics of segments (groups of rows) and what follows from them: pruning, selectivity, entropy.

Every statistic is a grouped aggregation with partial sums before the shuffle; there is no sampling
and no cap on distinct values. NaN is counted but left out of numbers; nulls are left out of everything.
A segment is pruned only where no row of it can match.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from vektorium.functions import vector as V
from vektorium.operators.filters import Filter

BINS = 16
#: Upper bound of bin i as a share of the range: ln(2 + i) / ln 17, so bins get finer upwards.
EDGES = tuple(math.log(1 + i) / math.log(BINS + 1) for i in range(BINS + 1))


def numeric(df: DataFrame, segment: str, columns: Sequence[str]) -> DataFrame:
    """``segment, field, n, min, max, sum, sum_sq, has_nan, variance`` for each numeric column.

    All columns are aggregated in one pass over the rows as they are; only the few results are turned into one row a field.
    """
    aggs = []
    for i, c in enumerate(columns):
        raw = F.col(c).cast("double")
        x = F.when(~F.isnan(raw), raw)
        aggs += [F.count(raw).alias(f"_a{i}"), F.count(x).alias(f"_n{i}"), F.min(x).alias(f"_l{i}"), F.max(x).alias(f"_h{i}"), F.sum(x).alias(f"_s{i}"), F.sum(x * x).alias(f"_q{i}")]
    wide = df.groupBy(segment).agg(*aggs)
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_n{i}").alias("n"), F.col(f"_l{i}").alias("min"), F.col(f"_h{i}").alias("max"), F.col(f"_s{i}").alias("sum"), F.col(f"_q{i}").alias("sum_sq"), (F.col(f"_a{i}") > F.col(f"_n{i}")).alias("has_nan"), F.col(f"_a{i}").alias("_a")) for i, c in enumerate(columns)))
    s = wide.select(segment, F.explode(fields).alias("_s")).select(segment, "_s.*").where("_a > 0").drop("_a")
    mean = F.col("sum") / F.col("n")
    return s.withColumn("variance", F.when(F.col("n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("sum_sq") / F.col("n") - mean * mean)))


def totals(df: DataFrame, segment: str, columns: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """``segment, total_rows, live_rows, deleted_ratio, has_fields``: the columns that any row of the segment has a value in."""
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    s = df.groupBy(segment).agg(F.count("*").alias("total_rows"), F.count(F.when(~gone, 1)).alias("live_rows"), *(F.max(F.when(F.col(c).isNotNull(), c)).alias(f"_f{i}") for i, c in enumerate(columns)))
    return s.select(segment, "total_rows", "live_rows", (1 - F.col("live_rows") / F.col("total_rows")).alias("deleted_ratio"), F.array_compact(F.array(*(f"_f{i}" for i in range(len(columns))))).alias("has_fields"))


def histogram(df: DataFrame, segment: str, column: str) -> DataFrame:
    """``segment, bin, n, lo, hi``: the non-empty of 16 log-scaled bins over each segment's range."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(segment, x.alias("x"))
    ends = rows.groupBy(segment).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    # one row a segment; joined by its key, broadcast only if the planner finds it small
    r = rows.join(ends, segment).where("_hi > _lo")
    at = F.lit(0)
    for i in range(1, BINS):
        at = at + F.when(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(EDGES[i]) <= F.col("x"), 1).otherwise(0)
    return r.select(segment, at.alias("bin"), "x").groupBy(segment, "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def entropy(counts: DataFrame, segment: str, n: str = "n", bins: int | None = BINS) -> DataFrame:
    """``segment, entropy`` in [0, 1]: Shannon entropy over that of equal counts (of ``bins``, or of the values there are)."""
    c = F.col(n).cast("double")
    top = F.lit(math.log2(bins)) if bins else F.log2(F.count("*"))
    # -sum(p log p) of p = c / t is log t - sum(c log c) / t: sums only, no window over a segment
    out = counts.where(F.col(n) > 0).groupBy(segment).agg((F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)).alias("_h"), F.count("*").alias("_k"), top.alias("_top"))
    return out.select(segment, F.when((F.col("_k") > 1) & (F.col("_top") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_h") / F.col("_top")))).otherwise(0.0).alias("entropy"))


def value_counts(df: DataFrame, segment: str, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(segment, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def categorical(df: DataFrame, segment: str, column: str) -> DataFrame:
    """``segment, n_distinct, dominant, dominant_ratio, entropy``. Ties for the dominant value go to the least."""
    c = value_counts(df, segment, column)
    s = c.groupBy(segment).agg(F.count("*").alias("n_distinct"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("dominant"), (F.max("n") / F.sum("n")).alias("dominant_ratio"))
    return s.join(entropy(c, segment, bins=None), segment)


def top_values(df: DataFrame, segment: str, column: str, k: int = 16) -> DataFrame:
    """``segment, value, n, rank``: the most frequent values."""
    w = W.partitionBy(segment).orderBy(F.col("n").desc(), "value")
    return value_counts(df, segment, column).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def filter_entropy(numeric_entropy: Column, categorical_entropy: Column) -> Column:
    """0.4 of the numeric and 0.6 of the categorical mean; either alone where the other is missing."""
    return F.coalesce(numeric_entropy * 0.4 + categorical_entropy * 0.6, numeric_entropy, categorical_entropy, F.lit(0.0))


def centroids(df: DataFrame, segment: str, vec: str, dim: int) -> DataFrame:
    """``segment, n, centroid``: the mean vector, one aggregate for each dimension (no explosion of rows)."""
    v = df.where(V.valid(F.col(vec), dim))
    sums = v.groupBy(segment).agg(F.count("*").alias("n"), *(F.avg(F.col(vec)[i].cast("double")).alias(f"_{i}") for i in range(dim)))
    return sums.select(segment, "n", F.array(*(f"_{i}" for i in range(dim))).alias("centroid"))


#: Ranges of values that a rank is looked for in.
RANGES = 4096


def _ranked(rows: DataFrame, wanted: DataFrame, segment: str) -> DataFrame:
    """``segment, radius_95``: the ``_at``-th least ``_d`` of each segment, of (segment, _d, _b) rows with ``_b`` rising with ``_d``.

    The range that holds the rank is found from counts; only rows of that range are sorted, not the whole segment.
    """
    counts = rows.groupBy(segment, "_b").agg(F.count("*").alias("_n"))  # at most RANGES + 1 rows a segment
    upto = counts.withColumn("_to", F.sum("_n").over(W.partitionBy(segment).orderBy("_b"))).join(wanted, segment)
    place = upto.where((F.col("_to") >= F.col("_at")) & (F.col("_to") - F.col("_n") < F.col("_at"))).select(segment, "_b", (F.col("_at") - F.col("_to") + F.col("_n")).alias("_r"))
    inside = rows.join(place, [segment, "_b"]).withColumn("_k", F.row_number().over(W.partitionBy(segment, "_b").orderBy("_d")))
    return inside.where(F.col("_k") == F.col("_r")).select(segment, F.col("_d").alias("radius_95"))


def vector_stats(df: DataFrame, segment: str, vec: str, dim: int) -> DataFrame:
    """Norms and distances to the centroid (min, max, mean norm; mean, 95th percentile and largest distance), and tightness."""
    v = df.where(V.valid(F.col(vec), dim))
    c = centroids(df, segment, vec, dim)
    d = v.join(c, segment).select(segment, "n", V.norm(F.col(vec)).alias("_norm"), F.sqrt(V.squared_l2(F.col(vec), F.col("centroid"))).alias("_d"))
    s = d.groupBy(segment).agg(F.max("n").alias("n"), F.min("_norm").alias("min_norm"), F.max("_norm").alias("max_norm"), F.avg("_norm").alias("mean_norm"), F.avg("_d").alias("avg_distance"), F.max("_d").alias("radius_max"))
    at = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1) + 1
    s = s.join(_ranked(d.join(s.select(segment, "radius_max"), segment).select(segment, "_d", F.floor(F.col("_d") / F.greatest(F.col("radius_max"), F.lit(1e-300)) * RANGES).alias("_b")), s.select(segment, at.alias("_at")), segment), segment)
    spread = F.greatest(F.lit(0.0), F.col("radius_95") - F.col("avg_distance"))
    return s.withColumn("is_clustered", F.coalesce(F.col("avg_distance") / F.col("mean_norm") < 0.5, F.lit(False))).withColumn("tightness", F.when(F.col("avg_distance") > 0, 1 - F.least(F.lit(1.0), spread / F.col("avg_distance"))).otherwise(1.0))


def is_sorted(df: DataFrame, segment: str, order: str, ts: str) -> DataFrame:
    """``segment, is_sorted``: whether ``ts`` never falls in the order of rows."""
    before = F.lag(ts).over(W.partitionBy(segment).orderBy(order))
    return df.select(segment, (F.coalesce(F.col(ts) >= before, F.lit(True))).alias("_ok")).groupBy(segment).agg(F.bool_and("_ok").alias("is_sorted"))


def inverted_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, value, n``: the cardinality of every (field, value), values as typed keys (``i:5``, ``s:x``, ``b:1``, ``f:0.5``)."""
    keys = [F.struct(F.lit(c).alias("field"), _typed_key(df, c).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*keys)).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))


def _typed_key(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    tag = "i:" if isinstance(t, T.IntegralType) else "f:" if isinstance(t, T.FractionalType) else "b:" if isinstance(t, T.BooleanType) else "s:"
    return F.concat(F.lit(tag), F.col(c).cast("int").cast("string") if tag == "b:" else F.col(c).cast("string"))


def inverted_bitmaps(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """``field, value, block, ids, n``: which ids have each (field, value), as bitmaps of 32,768 ids, and how many.

    Ids are whole numbers from 0; a value of any number of ids is spread over its blocks. Combine with ``bitmap_and``.
    """
    keys = F.array(*(F.struct(F.lit(c).alias("field"), _typed_key(df, c).alias("value")) for c in columns))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.explode(keys).alias("x")).where("x.value IS NOT NULL")
    out = rows.groupBy("x.field", "x.value", F.bitmap_bucket_number("_id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("ids"))
    return out.withColumn("n", F.bitmap_count("ids"))


def bitmap_ids(maps: DataFrame, terms: Sequence[tuple[str, str]]) -> DataFrame:
    """``id``: the ids that have all of the (field, value) terms, from ``inverted_bitmaps``."""
    want = F.lit(False)
    for f, v in terms:
        want = want | ((F.col("field") == f) & (F.col("value") == v))
    both = maps.where(want).groupBy("block").agg(F.count("*").alias("_k"), F.bitmap_and_agg("ids").alias("ids")).where(F.col("_k") == len(set(terms)))
    octets = both.select("block", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.conv(F.hex(F.substring("ids", i + 1, F.lit(1))), 16, 10).cast("int"))).alias("_i", "_o")).where("_o > 0")
    bits = octets.select("block", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(F.getbit(F.col("_o").cast("long"), j) == 1, F.col("_i") * 8 + j)), lambda x: x.isNotNull())).alias("_p"))
    first = F.when(F.col("block") > 0, (F.col("block") - 1) * 32768 + 1).otherwise(F.col("block") * 32768)
    return bits.select((first + F.col("_p")).cast("long").alias("id"))


def bloom(df: DataFrame, segment: str, column: str, bits: int = 1 << 14, hashes: int = 7) -> DataFrame:
    """``segment, words``: a Bloom filter of each segment's values; ``bits`` a segment, about 1 % false positives at a tenth as many values."""
    at = F.array(*(F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(bits)) for k in range(hashes)))
    rows = df.where(F.col(column).isNotNull()).select(segment, F.explode(at).alias("_p"))
    words = rows.groupBy(segment, F.floor(F.col("_p") / 64).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_x"))
    return words.groupBy(segment).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_x"))).alias("words"))  # at most bits / 64 entries


def bloom_may_hold(value: Column, bits: int = 1 << 14, hashes: int = 7) -> Column:
    """Whether the filter in ``words`` admits a value of the column's own type; never false for one that is there."""
    ok = F.lit(True)
    for k in range(hashes):
        p = F.pmod(F.xxhash64(F.lit(k), value), F.lit(bits))
        ok = ok & (F.getbit(F.coalesce(F.try_element_at("words", F.floor(p / 64)), F.lit(0).cast("long")), (p % 64).cast("int")) == 1)
    return ok


def categorical_selectivity(stats: DataFrame, value, n_rows: str = "n") -> DataFrame:
    """Adds ``selectivity`` of equality to ``categorical`` statistics: the dominant value's ratio, else an even share of the rest."""
    rest = (1 - F.col("dominant_ratio")) / F.greatest(F.col("n_distinct") - 1, F.lit(1))
    return stats.withColumn("selectivity", F.when(F.col("dominant") == value, F.col("dominant_ratio")).when(F.col("n_distinct") > 1, rest).otherwise(0.0))


def may_match(numeric_stats: Mapping[str, tuple[float, float]], distinct: Mapping[str, set], fields: Sequence[str], f: Filter) -> bool:
    """Whether a segment can hold a row that satisfies the filter.

    ``numeric_stats``: least and largest number of the numeric fields; ``distinct``: all values of
    fields whose values are known completely; ``fields``: the fields that occur at all.
    """
    if f.field not in fields:
        return False
    values = f.value if f.op == "in" else [f.value]
    if f.op in ("eq", "in"):
        return any(_may_equal(numeric_stats, distinct, f.field, v) for v in values)
    if f.op in ("gt", "gte", "lt", "lte") and isinstance(f.value, (int, float)) and not isinstance(f.value, bool):
        if f.field not in numeric_stats:
            return f.field not in distinct
        lo, hi = numeric_stats[f.field]
        return {"gt": hi > f.value, "gte": hi >= f.value, "lt": lo < f.value, "lte": lo <= f.value}[f.op]
    return True


def _may_equal(numeric_stats, distinct, field: str, v) -> bool:
    if field in distinct:
        return v in distinct[field]
    if isinstance(v, (int, float)) and not isinstance(v, bool) and field in numeric_stats:
        return numeric_stats[field][0] <= v <= numeric_stats[field][1]
    return True


def prune(stats: DataFrame, segment: str, field: str, f: Filter) -> DataFrame:
    """Segments of ``numeric`` statistics that can match a comparison: the same rule as ``may_match``, as a plan."""
    s = stats.where(F.col("field") == field)
    lo, hi, v = F.col("min"), F.col("max"), f.value
    keep = {"eq": lambda: (lo <= v) & (hi >= v), "gt": lambda: hi > v, "gte": lambda: hi >= v, "lt": lambda: lo < v, "lte": lambda: lo <= v, "ne": lambda: ~((lo == v) & (hi == v) & ~F.col("has_nan")), "in": lambda: F.exists(F.array(*(F.lit(float(x)) for x in v)), lambda x: (lo <= x) & (hi >= x))}[f.op]()
    return s.where(keep).select(segment)


def range_selectivity(stats: DataFrame, lo: float, hi: float) -> DataFrame:
    """Adds ``selectivity``: the share of a uniform column between ``lo`` and ``hi``."""
    width = F.col("max") - F.col("min")
    inside = (F.least(F.lit(hi), F.col("max")) - F.greatest(F.lit(lo), F.col("min"))) / width
    return stats.withColumn("selectivity", F.when(width > 0, F.greatest(F.lit(0.0), inside)).otherwise(F.when((F.col("min") >= lo) & (F.col("max") <= hi), 1.0).otherwise(0.0)))


def histogram_selectivity(hist: DataFrame, segment: str, lo: float, hi: float) -> DataFrame:
    """``segment, selectivity`` from bins: whole bins inside count, bins that are cut count in proportion."""
    width = F.col("hi") - F.col("lo")
    part = F.when(width > 0, F.greatest(F.lit(0.0), (F.least(F.lit(hi), F.col("hi")) - F.greatest(F.lit(lo), F.col("lo"))) / width)).otherwise(((F.col("lo") >= lo) & (F.col("hi") <= hi)).cast("double"))
    return hist.groupBy(segment).agg((F.sum(F.col("n") * part) / F.sum("n")).alias("selectivity"))


def query_cost(evaluated: int, short_circuited: int) -> float:
    """Full distance computations and 0.3 of the cut-short ones."""
    return evaluated + 0.3 * short_circuited
