"""The training set: extracted questions without those that are unfit, repeated or in the test set, and its splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mcq import bag_key, canonical_subject, exact_key, is_bad, is_malformed, repair_answer, to_four
from ..functions.text import source_key
from ..operators.dedup import keep_first, question_grams, test_overlap, unique_ids
from ..operators.joins import canonical_by_mode
from ..operators.sampling import validation_slice


def validate(raw: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(clean, dropped) of raw questions: spellings of a subject unified, answers repaired, unfit and repeated rows out.

    dropped has the id and why: 'bad' or 'repeated'.
    """
    q = canonical_by_mode(raw, "subject", order).withColumn("answer", repair_answer(F.col("answer").cast("string"), F.col("choices")))
    q = q.withColumn("_bad", is_bad(F.col("question"), F.col("choices"), F.col("answer")))
    clean = keep_first(q.filter(~F.col("_bad")).drop("_bad"), exact_key(F.col("question"), F.col("choices")), F.col(order))
    again = q.filter(~F.col("_bad")).join(clean.select(order), order, "left_anti").select(order, F.lit("repeated").alias("why"))
    return clean, q.filter("_bad").select(order, F.lit("bad").alias("why")).unionByName(again)


@dataclass
class TrainingSet:
    kept: DataFrame
    removed: DataFrame
    counts: DataFrame


def training_set(extracted: DataFrame, dev: DataFrame, save, top: int | None = 8, with_nfc: bool = True) -> TrainingSet:
    """Decide on each extracted question (columns of a raw one, and row, a number that orders them).

    The decision is the first that holds: no answer; needs context; malformed (after five options became four); same
    paper as a test question; overlaps one; repeated; kept. Similarity is computed for what reaches that rule only, and
    repeats are counted among what reaches theirs. save writes a table and reads it again: three results read it.
    """
    choices, answer = to_four(F.col("question"), F.col("choices"), F.col("answer"))
    five = (F.size("choices") == 5) & (F.coalesce("answer", F.lit(0)) != 0) & ~F.coalesce(F.col("metadata.needs_context"), F.lit(False))
    q = extracted.withColumn("was_five", five).withColumn("original_n_options", F.when(five, 5).otherwise(F.coalesce("metadata.original_n_options", F.size("choices"))))
    q = q.withColumns({"choices": choices, "answer": answer, "source_key": source_key(F.col("metadata.source"))})
    early = (
        F.when(F.coalesce("answer", F.lit(0)).isin(0) | F.col("choices").isNull() | (F.size("choices") == 0), "no answer")
        .when(F.coalesce(F.col("metadata.needs_context"), F.lit(False)), "needs context")
        .when(is_malformed(F.col("choices"), F.col("answer")), "malformed")
    )
    q = save(q.withColumn("decision", early))
    papers = dev.select(source_key(F.col("metadata.source")).alias("source_key")).filter("source_key <> ''").distinct().withColumn("_same", F.lit(True))
    q = q.join(papers, "source_key", "left").withColumn("decision", F.coalesce("decision", F.when(F.col("_same"), "same paper"))).drop("_same")
    q = save(q)
    probe = save(question_grams(q.filter("decision is null").select("row", "question", "choices"), with_nfc))
    test = save(question_grams(dev.select(F.col("id").alias("dev_id"), "question", "choices"), with_nfc))
    found = test_overlap(probe, test, "row", "dev_id", top)
    q = q.join(found, "row", "left").withColumn("decision", F.coalesce("decision", F.when(F.col("dev_id").isNotNull(), "overlaps test")))
    q = save(q.withColumn("_key", bag_key(F.col("question"), F.col("choices"), with_nfc)))
    firsts = q.filter("decision is null").groupBy("_key").agg(F.min("row").alias("row")).select("row", F.lit("kept").alias("_kept"))
    q = save(q.join(firsts, "row", "left").withColumn("decision", F.coalesce("decision", "_kept", F.lit("repeated"))).drop("_key", "_kept"))
    name = F.concat(F.lit("g"), F.coalesce(F.col("metadata.grade").cast("string"), F.lit("None")), F.lit("::"), F.left(F.regexp_replace(F.regexp_extract(F.coalesce("metadata.pdf", F.lit("x")), "([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), F.lit(60)), F.lit("::"), F.col("q_no").cast("string"))
    rows = unique_ids(q.filter("decision = 'kept'").withColumn("id", name), "id", F.col("row"), save)
    kept = rows.select(
        "id", canonical_subject(F.col("subject")).alias("subject"), "category", "question", "choices", "answer", "metadata.grade", "metadata.difficulty", "metadata.year", "metadata.term",
        "metadata.region", "metadata.source", F.lit("extracted").alias("dataset"), "original_n_options",
    )
    removed = q.filter("decision in ('same paper', 'overlaps test')").join(dev.select(F.col("id").alias("dev_id"), F.col("question").alias("dev_question"), F.col("choices").alias("dev_choices")), "dev_id", "left")
    because = F.when(F.col("decision") == "same paper", "same exam paper as a test question").otherwise(F.col("reason"))
    removed = removed.select("row", "question", "choices", "answer", because.alias("removed_because"), "dev_question", "dev_choices")
    counts = q.groupBy("decision").agg(F.count("*").alias("n"), F.count(F.when(F.col("was_five"), 1)).alias("n_from_five"))
    return TrainingSet(kept, removed, counts)


def with_validation(kept: DataFrame, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """kept with a column split: val for a fraction of each subject of at least 20 questions, else train."""
    cut = validation_slice(kept, "subject", "id", fraction, seed=seed)
    return cut.withColumn("split", F.when(F.col("val"), "val").otherwise("train")).drop("val")


def summary(split: DataFrame, test: DataFrame, counts: DataFrame) -> DataFrame:
    """part, key, n: what there is to know of a training set: numbers of rows by split, decision, grade, subject and answer,
    and of the subjects that only the test set has. split: as with_validation returns it; counts: those of a TrainingSet."""
    train = split.filter("split = 'train'")
    by = lambda part, df, key: df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("None")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "key", "n")
    new = test.join(train.select("subject").distinct(), "subject", "left_anti")
    parts = [
        by("split", split.select("split").unionByName(test.select(F.lit("test").alias("split"))), "split"), counts.select(F.lit("decision").alias("part"), F.col("decision").alias("key"), "n"),
        by("grade", train, "grade"), by("subject", train, "subject"), by("test subject", test, "subject"), by("answer", train, "answer"), by("only in test", new, "subject"),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out
