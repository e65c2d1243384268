"""Runs and clusters in ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_by_gap(df: DataFrame, group: list[str], position: str, tolerance: float, order: str) -> DataFrame:
    """df with a column cluster: 1, 2, ... within a group; a gap of more than the tolerance begins the next one."""
    w = Window.partitionBy(*group).orderBy(position, order)
    new = (F.col(position) - F.lag(position).over(w) > tolerance).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def consecutive_runs(df: DataFrame, group: list[str], order: list[str], value: str, least: int = 5) -> DataFrame:
    """Runs of rows, one after the other, whose values go up by one: group, first, last, length."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) != 1).cast("int"), F.lit(1))
    run = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = run.groupBy(*group, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length"))
    return got.filter(F.col("length") >= least).drop("_run")


def longest_block(df: DataFrame, group: list[str], order: str, inside: str, neutral: str | None = None) -> DataFrame:
    """The longest run of rows for which `inside` holds; rows that are neutral neither count nor break it.

    group, start (order of its first row) and length; of equals the first.
    """
    rows = df if neutral is None else df.filter(~F.coalesce(F.col(neutral), F.lit(False)))
    w = Window.partitionBy(*group).orderBy(order)
    rows = rows.withColumn("_cut", F.sum((~F.col(inside)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.filter(F.col(inside)).groupBy(*group, "_cut").agg(F.count("*").alias("length"), F.min(order).alias("start"))
    return runs.groupBy(*group).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("r")).select(*group, "r.start", "r.length")
