"""Accuracy, distributions and counts of predictions and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(correct: Column, places: int | None) -> Column:
    mean = F.avg(correct.cast("int").cast("double"))
    return mean if places is None else F.bround(mean, places)


def accuracy_by(preds: DataFrame, group: str, places: int | None = 4) -> DataFrame:
    """group, n, accuracy; rows without a group are left out. Rounding is half-even."""
    return preds.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), _share(F.col("correct"), places).alias("accuracy"))


def overall(preds: DataFrame) -> DataFrame:
    unparsed = F.bround(F.avg(F.col("pred").isNull().cast("int").cast("double")), 4)
    return preds.agg(F.count("*").alias("n"), _share(F.col("correct"), 4).alias("accuracy"), unparsed.alias("unparsed_rate"))


def accuracy_sets(preds: DataFrame, first: str = "subject", second: str = "category") -> DataFrame:
    """Accuracy by either column and in total, of one pass: level, subject, category, n, accuracy."""
    level = F.when(F.grouping(first) == 0, first).when(F.grouping(second) == 0, second).otherwise("all")
    sets = preds.groupingSets([[F.col(first)], [F.col(second)], []], F.col(first), F.col(second))
    return sets.agg(level.alias("level"), F.count("*").alias("n"), _share(F.col("correct"), 4).alias("accuracy")).select("level", first, second, "n", "accuracy")


def side_by_side(parts: dict[str, DataFrame], key: str, value: str = "accuracy") -> DataFrame:
    """One column for each part's value, by key; null where a part hasn't the key."""
    long = None
    for name, df in parts.items():
        one = df.select(key, F.lit(name).alias("part"), F.col(value).alias("v"))
        long = one if long is None else long.unionByName(one)
    return long.groupBy(key).pivot("part", list(parts)).agg(F.first("v"))


def answer_distribution(df: DataFrame, column: str, domain: int = 4) -> DataFrame:
    """Share of each answer 1..domain among those that are not null, 0 where none has it: answer, n, share."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("int").alias("answer")).agg(F.count("*").alias("n"))
    inside = F.when(F.col("answer").between(1, domain), F.struct("answer", "n"))
    row = counts.agg(F.map_from_entries(F.array_compact(F.collect_list(inside))).alias("m"), F.sum("n").alias("total"))
    each = row.select("m", "total", F.explode(F.sequence(F.lit(1), F.lit(domain))).alias("answer"))
    n = F.coalesce(F.try_element_at("m", F.col("answer")), F.lit(0)).cast("long")
    return each.select("answer", n.alias("n"), (n / F.col("total")).alias("share"))


def majority(distribution: DataFrame) -> DataFrame:
    """The most frequent answer (the smallest of equals) and its share: the floor that a model has to beat."""
    return distribution.agg(F.max_by("answer", F.struct("share", -F.col("answer"))).alias("answer"), F.max("share").alias("share"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.filter(" and ".join(f"`{c}` is not null" for c in cols)).groupBy(*cols).agg(F.count("*").alias("n"))


def counts_with_first(df: DataFrame, key: str, other: str, order: str) -> DataFrame:
    """Count of each key, with the first value of another column."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min_by(other, order).alias(other))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts by row and column, 0 for none, with a total."""
    counts = [F.count(F.when(F.col(col) == v, 1)).alias(v) for v in values]
    return df.filter(F.col(row).isNotNull()).groupBy(row).agg(*counts).withColumn("total", sum(F.col(f"`{v}`") for v in values))


def accuracy_gain(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    a = accuracy_by(before, key, None).select(key, F.col("accuracy").alias("before"))
    b = accuracy_by(after, key, None).select(key, F.col("accuracy").alias("after"))
    return a.join(b, key, "full").withColumn("gain", F.col("after") - F.col("before"))


def best_trial(trials: DataFrame, score: str, *ties: str) -> DataFrame:
    """The row of the highest score, of equals the first by the tie columns."""
    return trials.orderBy(F.desc_nulls_last(score), *ties).limit(1)
