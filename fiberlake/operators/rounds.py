"""Iterative operators: cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; a folder of our own only where spark.checkpoint.dir is unset."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder.

    It is computed once (a checkpoint computes its last stage twice), takes little room, and has its own size in plans: tables that were exploded
    from small ones are thought to be small, and would be broadcast.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join that shuffles it: its rows grow with pixels or vertices, and Spark would take an exploded table for one small enough to be sent to all through the driver."""
    return df.hint("merge")


#: Rows of a table that is sent to all tasks at most.
SENT = 50_000


def beside(small: DataFrame) -> DataFrame:
    """small for a join with pixels, which are often exploded from few rows: Spark would take them for the smaller side and send them to all through the driver.

    small itself is sent if it has SENT rows at most, so that pixels stay where they are; else both are shuffled. It is counted here, so it should have been written.
    """
    return small.hint("broadcast" if small.count() <= SENT else "merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to as many tasks as the session has shuffle partitions: for steps whose work is far larger than their rows, which Spark would join into a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Rounds:
    """Tables of a loop, written to the shared folder; each one goes once the next is written.

    A checkpoint keeps the size that its plan was thought to have, and a loop of joins multiplies that with itself each round, until the number
    alone takes minutes. A table that is read again has its own size.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def kept(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.top}/{self.n}")
        self.remove(f"{self.top}/{self.n - 1}")
        return self.spark.read.parquet(f"{self.top}/{self.n}")

    def remove(self, path: str | None = None) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.top)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that links reach) of every node of links (a, b of any one comparable type).

    In a round each node learns its neighbours' smallest label, tells it to the node that its own label names, and takes over that node's new
    label. So whole trees of labels hang onto smaller ones at once, and rounds grow with the logarithm of the longest path.
    """
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct())
    rounds = Rounds(links.sparkSession)
    labels = rounds.kept(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy(F.col("u").alias("_u")).agg(F.min("label").alias("_near"))
        step = labels.join(near, labels.node == F.col("_u")).select("node", "label", F.least("label", "_near").alias("next"))
        told = step.groupBy(F.col("label").alias("_at")).agg(F.min("next").alias("_told"))
        own = step.join(told, step.node == F.col("_at"), "left").select(F.col("node").alias("_own"), F.least("next", F.coalesce("_told", "next")).alias("_to"))
        new = rounds.kept(step.join(own, step.next == F.col("_own")).select("node", F.col("label").alias("was"), F.least("next", "_to").alias("label")))
        moved = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            out = cut(labels)
            rounds.remove()
            return out
