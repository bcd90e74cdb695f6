"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of one ordered bucket at most, on average; a bucket is sorted in one task.
ROWS_PER_BUCKET, BYTES_PER_BUCKET = 500_000, 256 << 20
LEAST_LONG = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only where it is unset (tests, local runs) set a folder of our own."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that later steps survive a lost executor without recomputing it."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda variable stays one, whereas Catalyst may paste a column's expression into each iteration of a higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def longs(values) -> Column:
    """A literal array; the split is folded into one literal, so that thousands of values stay one plan node."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


class Ordering:
    """Ascending buckets of rows by a long key and a long tie-breaker: their first rows and the rows before each.

    Spark's range partitioning samples both, so that buckets are even whatever the ids are, also where many rows have one
    id or none. The driver gets one row for each bucket, and no bucket needs the rows of another.
    """

    def __init__(self, keys: DataFrame, key: str, tie: str | None = None, wide: str | None = None):
        """tie: a long column that parts rows of one key, no null; wide: a column of texts that moves with the rows; its bytes count for the number of buckets."""
        self.key, self.tie = key, tie
        size = F.coalesce(F.sum(F.octet_length(wide)), F.lit(0)) if wide else F.lit(0)
        rows, bytes_ = keys.agg(F.count(F.lit(1)), size).first()
        buckets = max(4 * shuffle_width(keys.sparkSession), math.ceil(rows / ROWS_PER_BUCKET), math.ceil(bytes_ / BYTES_PER_BUCKET)) if rows else 1
        found = (
            keys.select(self.sort_key().alias("_k"), self.sort_tie().alias("_t"))
            .repartitionByRange(buckets, "_k", "_t")
            .groupBy(F.spark_partition_id().alias("_p"))
            .agg(F.min(F.struct("_k", "_t")).alias("lo"), F.count(F.lit(1)).alias("n"))
            .select("lo.*", "n")
            .collect()
        )
        found.sort()
        self.first, self.first_tie, self.before = [r[0] for r in found], [r[1] for r in found], [0]
        for r in found:
            self.before.append(self.before[-1] + r.n)
        self.rows = self.before.pop()

    def sort_key(self) -> Column:
        return F.coalesce(F.col(self.key), F.lit(LEAST_LONG))

    def sort_tie(self) -> Column:
        return F.col(self.tie).cast("long") if self.tie else F.lit(0).cast("long")

    def bucket(self) -> Column:
        """Binary search for the bucket of a row."""
        n = max(1, len(self.first))
        steps = [1 << i for i in reversed(range((n - 1).bit_length()))]
        if not steps:
            return F.lit(0)
        keys, ties = longs(self.first), longs(self.first_tie)
        begun = lambda i: (F.get(keys, i) < self.sort_key()) | ((F.get(keys, i) == self.sort_key()) & (F.get(ties, i) <= self.sort_tie()))
        return F.aggregate(longs(steps).cast("array<int>"), F.lit(0), lambda at, s: F.when((at + s < n) & begun(at + s), at + s).otherwise(at))

    def is_first(self, bucket: Column) -> Column:
        """Whether a row is as small as its bucket's first."""
        return (F.get(longs(self.first), bucket) == self.sort_key()) & (F.get(longs(self.first_tie), bucket) == self.sort_tie())

    def numbered(self, df: DataFrame, ties: list, name: str = "row_number") -> DataFrame:
        """df with the global row number from 0, by the key, the tie-breaker and then ties."""
        if not self.rows:
            return df.withColumn(name, F.lit(0).cast("long"))
        put = df.withColumn("_bucket", self.bucket())
        w = Window.partitionBy("_bucket").orderBy(self.sort_key(), self.sort_tie(), *ties)
        return put.withColumn(name, F.get(longs(self.before), F.col("_bucket")) + F.row_number().over(w) - 1).drop("_bucket")
