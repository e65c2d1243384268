"""Splits, samples, weighting and augmentation. Randomness is the order of md5(seed-...), so it is the same anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mcq import ABOVE


#: Hexadecimal digits of a draw that tell bins apart: 65,536 of them.
BIN = 4


def draw(seed: int, *cols: Column | str) -> Column:
    """A text that orders rows at random: md5 of the seed and the columns, joined by '-'."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).cast("binary"))


def uniform(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of draw()."""
    return F.conv(F.left(draw(seed, *cols), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def ranked(df: DataFrame, group: str, drawn: Column, id_col: str) -> DataFrame:
    """df with _r, the place (from 1) of each row in its group by a draw() and then the id, and _n, the rows of the group.

    A group is counted by the first BIN hexadecimal digits of the draw, and its places are those within a bin after all
    bins before, so however large a group is, no task has more of it than a bin. A null group is one, too.
    """
    d = df.withColumn("_d", drawn).withColumn("_b", F.left("_d", F.lit(BIN)))
    bins = d.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_c")).agg(F.count("*").alias("_m"))
    of = Window.partitionBy("_g")  # at most 16 ** BIN rows
    bins = bins.withColumn("_n", F.sum("_m").over(of)).withColumn("_before", F.sum("_m").over(of.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m"))
    both = d.join(bins, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    place = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_d", id_col))
    return both.withColumn("_r", F.col("_before") + place).drop("_d", "_b", "_g", "_c", "_m", "_before")


def sample_n(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    return df.orderBy(draw(seed, id_col), id_col).limit(n)


def shuffle(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    return df.orderBy(draw(seed, id_col), id_col)


def stratified_split(df: DataFrame, stratum: str, id_col: str = "id", train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """df with a column split; each stratum is divided in proportion, rounded by largest remainder (ties: train, val, test).

    The first rows of a stratum, in random order, are train, the next val, the rest test. A null stratum is one, too.
    """
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("the ratios have to sum to 1")
    df = ranked(df, stratum, draw(seed, id_col), id_col)
    # exact in thousandths, so that remainders compare alike everywhere
    whole = [round(x * 1000) for x in (train, val, test)]
    base = [F.floor(F.col("_n") * x / 1000) for x in whole]
    rest = [(F.col("_n") * x) % 1000 for x in whole]
    left = F.col("_n") - base[0] - base[1] - base[2]
    rank = [sum(((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("int") for j in range(3) if j != i) for i in range(3)]
    size = [base[i] + (rank[i] < left).cast("int") for i in range(3)]
    part = F.when(F.col("_r") <= size[0], "train").when(F.col("_r") <= size[0] + size[1], "val").otherwise("test")
    return df.withColumn("split", part).drop("_n", "_r")


def validation_slice(df: DataFrame, group: str, id_col: str = "id", fraction: float = 0.05, least: int = 20, seed: int = 42) -> DataFrame:
    """df with a boolean column val: a fraction (half-even, at least one) of each group of at least so many rows."""
    n = F.col("_n")
    k = F.when(n >= least, F.greatest(F.lit(1), F.bround(n.cast("double") * fraction, 0).cast("int"))).otherwise(0)
    return ranked(df, group, draw(seed, id_col), id_col).withColumn("val", F.col("_r") <= k).drop("_n", "_r")


def oversample(df: DataFrame, factor: Column, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Rows repeated by a factor; its fraction is a chance. Copies after the first get '#rep1', ... at their id."""
    whole = F.floor(factor)
    n = (whole + (uniform(seed, id_col) < factor - whole).cast("int")).cast("int")
    copies = df.withColumn("_n", n).filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return copies.withColumn(id_col, F.when(F.col("_k") == 0, F.col(id_col)).otherwise(F.concat(id_col, F.lit("#rep"), F.col("_k").cast("string")))).drop("_n", "_k")


def option_shuffles(df: DataFrame, copies: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """df and copies of its rows with options in a random order, the answer following, '#shuf0', ... at their id.

    Rows with an option like "all of the above" are not copied.
    """
    if copies <= 0:
        return df
    each = df.filter(~F.exists("choices", lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit(ABOVE)))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    key = lambda i: F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("_c").cast("string"), i.cast("string")).cast("binary"))
    place = F.array_sort(F.transform("choices", lambda c, i: F.struct(key(i).alias("k"), i.alias("i"))))
    each = each.withColumn("_o", F.transform(place, lambda s: s["i"]))
    moved = each.withColumn("choices", F.transform("_o", lambda i: F.get("choices", i))).withColumn("answer", F.array_position("_o", F.col("answer") - 1).cast(df.schema["answer"].dataType))
    moved = moved.withColumn(id_col, F.concat(F.col(id_col).cast("string"), F.lit("#shuf"), F.col("_c").cast("string")))
    return df.withColumn(id_col, F.col(id_col).cast("string")).unionByName(moved.drop("_c", "_o"))


def few_shots(df: DataFrame, pool: DataFrame, k: int, id_col: str = "id", group: str = "subject", columns: tuple[str, ...] = ("prompt", "answer"), seed: int = 42) -> DataFrame:
    """df with a column shots: up to k rows of the pool with the same group, drawn anew for each row of df.

    A row's draw starts at a point of its own in the pool's random order and takes the k places after it, so the join has
    k rows for each of df and no more, however large a group of the pool is. Rows of df without a pool get no shots.
    """
    ring = ranked(pool, group, draw(seed, id_col), id_col).withColumn("_at", (F.col("_r") - 1).cast("int"))
    size = pool.groupBy(group).agg(F.count("*").alias("_size"))
    start = F.floor(uniform(seed, id_col) * F.col("_size"))
    want = df.select(id_col, group).join(size, group).withColumn("_j", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_size")).cast("int") - 1))).filter(F.lit(k > 0))
    want = want.withColumn("_at", ((start + F.col("_j")) % F.col("_size")).cast("int"))
    got = want.join(ring.select(group, "_at", F.struct(*columns).alias("_shot")), [group, "_at"])
    shots = got.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_j", "_shot"))).alias("_s")).select(id_col, F.transform("_s", lambda s: s["_shot"]).alias("shots"))
    return df.join(shots, id_col, "left").withColumn("shots", F.coalesce("shots", F.filter(F.array(F.struct(*[F.lit(None).cast(pool.schema[c].dataType).alias(c) for c in columns])), lambda s: F.lit(False))))


def pack_batches(df: DataFrame, length: str, budget: int, chunk: Column, order: str) -> DataFrame:
    """df with a column batch: rows of a chunk in the order of their lengths, packed while padded size stays in a budget.

    A batch holds rows while (its rows) * (its longest) <= budget; a row that is longer than the budget has its own.
    """
    import pandas as pd

    schema = df.withColumn("_chunk", chunk).withColumn("batch", F.lit(0)).schema

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, order], kind="stable").reset_index(drop=True)
        batch, first, out = 0, 0, []
        for i, n in enumerate(pdf[length]):
            if i > first and (i - first + 1) * n > budget:
                batch, first = batch + 1, i
            out.append(batch)
        return pdf.assign(batch=pd.Series(out, dtype="int32"))

    return df.withColumn("_chunk", chunk).groupBy("_chunk").applyInPandas(pack, schema)
