"""Order-dependent operators without a window over all rows in one task.

Rows are range-partitioned by the order, summed inside each partition, and every
partition gets the total of those before it: the driver's plan handles one row per
partition, never the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut_lineage, sized_join


def running_before(df: DataFrame, order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """Adds the exclusive running sum of `value` in `order`; the order must be total."""
    held = cut_lineage(df.withColumn("_v", value.cast("long")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = held.groupBy("_p").agg(F.sum("_v").alias("_t"))
    above = totals.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return held.join(F.broadcast(above), "_p").withColumn(name, F.sum("_v").over(w) - F.col("_v") + F.col("_o")).drop("_v", "_p", "_o")


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Row numbers from 1 in a total order."""
    return running_before(df, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def budget_cap(df: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """Texts in order of a unique key until their lengths reach `budget`; the last one is cut to what is left.

    The running sum moves keys and lengths only. Nulls and empties take nothing and are left out.
    """
    sizes = running_before(df.where(F.length(text) > 0).select(key, F.length(text).alias("_n")), [F.col(key)], F.col("_n")).where(F.col("before") < budget)
    out = sized_join(df, sizes.select(key, "before"), [key])
    return out.withColumn(text, F.expr(f"substring({text}, 1, least(length({text}), {budget} - before))"))


def tail_split(df: DataFrame, order: list[Column], fraction: float) -> DataFrame:
    """Marks the last max(1, floor(n * fraction)) rows as val."""
    n = df.count()
    return numbered(df, order).withColumn("split", F.when(F.col("rn") > n - max(1, int(n * fraction)), "val").otherwise("train"))


def hash_order(key: Column, seed: int) -> Column:
    """A portable seeded shuffle key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def quota_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in seeded order."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
