"""Looking at questions: filters, a sample, and a readable form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import sample_n


def contains_ignoring_case(c: Column, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(part.lower()))


def browse(questions: DataFrame, subject: str | None = None, pdf: str | None = None, answered: bool | None = None, n: int | None = 10, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Questions of a subject and a paper (parts of their names will do), with or without an answer; n of them, or all.

    The column shown has the question, its source and its options, the right one marked.
    """
    rows = questions
    if subject:
        rows = rows.filter(contains_ignoring_case(F.col("subject"), subject))
    if pdf:
        rows = rows.filter(contains_ignoring_case(F.col("metadata.pdf"), pdf))
    if answered is not None:
        has = F.coalesce(F.col("answer"), F.lit(0)) != 0
        rows = rows.filter(has if answered else ~has)
    if n is not None:
        rows = sample_n(rows, n, id_col, seed)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    head = F.concat(F.col("subject"), F.lit(" | Q"), text(F.col("q_no")), F.lit(" | "), text(F.col("metadata.year")), F.lit(" term "), text(F.col("metadata.term")), F.lit(" | "), text(F.col("metadata.pdf")))
    note = F.when(F.coalesce(F.col("metadata.needs_context"), F.lit(False)), "   [needs figure, table or passage]").otherwise("")
    options = F.transform("choices", lambda c, i: F.concat(F.lit("   ("), (i + 1).cast("string"), F.lit(") "), c, F.when(F.col("answer") == i + 1, "   <== answer").otherwise("")))
    return rows.withColumn("shown", F.concat(head, note, F.lit("\n\n"), F.col("question"), F.lit("\n"), F.array_join(options, "\n")))


def of_grade(papers: DataFrame, grade: int, path: str = "local_path") -> DataFrame:
    """Papers in the folder of a grade."""
    return papers.filter(F.startswith(path, F.lit(f"grade_{grade:02d}/")))
