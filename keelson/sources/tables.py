"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.session import shipped

#: Bytes below which a table is left as it is, however few its splits are.
SMALL = 1 << 18


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    shipped(spark)
    return spread(spark.read.parquet(f"{directory}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """scan over all cores where its files give fewer splits than there are cores; a table of many splits is not shuffled."""
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size, files = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), len(scan.inputFiles())
    if size < SMALL or files >= cores:
        return scan
    conf = spark._jsparkSession.sessionState().conf()  # sizes as Spark reads them, in whatever unit they are set
    most, least = int(conf.filesMaxPartitionBytes()), int(conf.filesOpenCostInBytes())
    split = min(most, max(least, (size + files * least) // cores))
    return scan if -(-size // split) >= cores else scan.repartition(cores)
