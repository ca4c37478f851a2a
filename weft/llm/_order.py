"""Work in ascending order of a key without a global sort: ranges of (key, tie) from a sample's quantiles.

Nulls come before all other keys. The tie, a hash that differs between rows, splits keys that many rows share, null among them, over several ranges.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROWS_PER_BUCKET, MAX_BUCKETS, SAMPLED = 4000, 1 << 14, 24

Splits = list[tuple[int, int, int]]


def bucket_splits(rows: DataFrame, key: str = "doc_id", tie: str = "_tie", per_bucket: int = ROWS_PER_BUCKET) -> Splits:
    """Ascending split points, at most MAX_BUCKETS. They come from about ``SAMPLED`` rows a bucket, so the driver gets two numbers of some 400,000 rows at most."""
    n = rows.count()
    buckets = min(MAX_BUCKETS, n // per_bucket + 1)
    if buckets == 1:
        return []
    drawn = rows.select(key, tie).sample(min(1.0, SAMPLED * buckets / n), 17).collect()
    order = sorted((0, 0, t) if k is None else (1, k, t) for k, t in drawn)
    return sorted({order[i * len(order) // buckets] for i in range(1, buckets)}) if order else []


def bucket_of(splits: Splits, key: str = "doc_id", tie: str = "_tie") -> Column:
    """Number of the split points at or below a row, by binary search."""
    if not splits:
        return F.lit(0)
    known = F.from_json(F.lit(json.dumps([dict(zip("pkt", s, strict=True)) for s in splits])), "array<struct<p int, k bigint, t bigint>>")  # folded once
    own = F.struct(F.col(key).isNotNull().cast("int").alias("p"), F.coalesce(key, F.lit(0)).cast("bigint").alias("k"), F.col(tie).alias("t"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(splits).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= own, at + step).otherwise(at))


def running_start(sizes: DataFrame, size: str, splits: Splits, key: str = "doc_id", tie: str = "_tie") -> DataFrame:
    """Add ``start``: the sum of ``size`` over all earlier rows. ``sizes`` must be cheap to read twice.

    Each bucket's total goes through one small window over at most MAX_BUCKETS + 1 rows; rows are summed
    inside their bucket only.
    """
    b = sizes.withColumn("_bucket", bucket_of(splits, key, tie))
    totals = b.groupBy("_bucket").agg(F.sum(size).alias("_total"))
    before = totals.select(
        "_bucket",
        F.coalesce(F.sum("_total").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = W.partitionBy("_bucket").orderBy(key, tie).rowsBetween(W.unboundedPreceding, -1)
    out = b.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return out.join(F.broadcast(before), "_bucket").withColumn("start", (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_before", "_inside")
