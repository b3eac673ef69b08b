"""What the operators share: tables, written intermediates and batch settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnout.session import scratch

#: Rows of one Arrow batch; texts are long, so the default of 10,000 would be too much memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Lineage ends there without tying the data to an executor, columns stay prunable, and the
    planner knows the size of the files: a side is broadcast only if that is under the limit.
    ``files`` is for results whose rows are bounded by a count already made (see ``enough``).
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def enough(rows: int, each: int) -> int:
    """Tasks, and files, for so many rows."""
    return 1 + rows // each


def apart(per_key: DataFrame) -> DataFrame:
    """A small aggregate dealt out anew, so that a join's shuffle is its own and a hot key's rows on the other side may be split."""
    return per_key.hint("rebalance")


def batched(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that texts travel in."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*columns: str) -> list[Column]:
    """``k1`` and ``k2``, two hashes that know a row by those columns and are never null."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(*reversed(columns), F.lit(1)).alias("k2")]


def without(docs: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """``docs`` less the rows whose key over ``columns`` is in ``gone``; all columns stay."""
    keys = [F.xxhash64(*columns), F.xxhash64(*reversed(columns), F.lit(1))]
    found = gone.select(F.col("k1").alias("_gone1"), F.col("k2").alias("_gone2"))
    return docs.join(found, (keys[0] == F.col("_gone1")) & (keys[1] == F.col("_gone2")), "left_anti")
