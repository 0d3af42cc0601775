"""Tables in the folder that all machines share, and ranks over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session
    takes a temporary folder, which is then set; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster's machines need a folder that they share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, label: str = "table", buckets: str | None = None) -> DataFrame:
    """df as a table in the shared folder, so loops stay shallow and a lost
    executor costs no more than reading files again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(buckets) if buckets else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_of(name: str, values: list) -> Column:
    """Whether a column is one of a list of texts or whole numbers, as one expression:
    a literal each would be a call each."""
    if not values:
        return F.lit(False)
    said = [str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return F.expr(f"`{name}` IN ({', '.join(said)})")


def ranked(df: DataFrame, order: list[Column], name: str, first: int | Column = 1) -> DataFrame:
    """df with name, each row's place in the order, from first. Rows are dealt by
    range, ranked inside a range, and moved by the number of rows in the ranges
    before: only that last step, a row a range, is one task's."""
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    first = F.lit(first) if isinstance(first, int) else first
    return dealt.withColumn(name, inside).join(F.broadcast(ranges), "_range").withColumn(name, F.col(name) + F.col("_before") + first - 1).drop("_range", "_before")
