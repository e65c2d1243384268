"""From lines of papers to questions, with keys of other files of the same page, without test questions and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mcq import line_key, to_four
from ..operators.dedup import keep_first
from ..operators.joins import match_keys
from ..operators.parse import classify_papers, parse_papers, with_metadata


def extract(lines: DataFrame, papers: DataFrame, dev: DataFrame, save, four: bool = False) -> dict[str, DataFrame]:
    """questions (answered), unanswered, report and needs_ocr.

    lines: as for parse_papers; papers: paper_id, subject, grade, term, year, region, source_page, pdf_url; dev: question,
    choices. Papers without lines are in the report, too. Of equal questions the one of the first paper_id stays.
    """
    kind = save(classify_papers(lines))
    parsed = save(parse_papers(lines, save))
    keys = parsed.filter("kind = 'key'").join(papers.select("paper_id", "source_page"), "paper_id").filter("source_page is not null and source_page <> ''")
    sinhala = kind.filter("class = 'sinhala_text'")
    asked = with_metadata(parsed.filter("kind = 'question'").join(sinhala.select("paper_id"), "paper_id", "left_semi"), papers)
    asked = match_keys(asked.withColumnRenamed("paper_id", "paper").withColumn("n_options", F.size("choices")), keys.select(F.col("paper_id").alias("key_id"), "source_page", "q_no", "answer"))
    asked = save(asked.withColumnRenamed("paper", "paper_id").drop("n_options"))
    rows = asked
    if four:
        choices, answer = to_four(F.col("question"), F.col("choices"), F.col("answer"))
        was = (F.size("choices") == 5) & (F.coalesce("answer", F.lit(0)) != 0)
        meta = F.when(was, F.col("metadata").withField("n_options", F.lit(4)).withField("original_n_options", F.lit(5))).otherwise(F.col("metadata"))
        rows = rows.withColumns({"choices": choices, "answer": answer, "metadata": meta})
    rows = rows.withColumn("_key", line_key(F.col("question"), F.col("choices")))
    known = dev.select(line_key(F.col("question"), F.col("choices")).alias("_key")).distinct()
    rows = keep_first(rows.join(known, "_key", "left_anti"), F.col("_key"), [F.col("paper_id"), F.col("q_no")]).drop("_key")
    rows = save(rows)
    counts = asked.groupBy("paper_id").agg(F.count("*").alias("questions"), F.count("answer").alias("answers"), F.min("method").alias("answer_source"))
    has_key = keys.select("paper_id").distinct().withColumn("_key_only", F.lit(True))
    report = papers.select("paper_id", "subject", "grade", "source_page").join(kind, "paper_id", "left").join(counts, "paper_id", "left").join(has_key, "paper_id", "left")
    status = (
        F.when(F.col("questions") > 0, "ok")
        .when(F.col("class") == "english_medium", "english_medium")
        .when(F.col("_key_only"), "answer_key_only")
        .when(F.col("class") == "sinhala_text", "no_mcq_found")
        .otherwise("needs_ocr")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = report.select("paper_id", "subject", "grade", "source_page", status.alias("status"), zero("questions"), zero("answers"), F.coalesce("answer_source", F.lit("none")).alias("answer_source"))
    return {
        "questions": rows.filter("coalesce(answer, 0) <> 0"),
        "unanswered": rows.filter("coalesce(answer, 0) = 0"),
        "report": report.drop("source_page"),
        "needs_ocr": report.filter("status in ('needs_ocr', 'no_mcq_found')").select("paper_id", "subject", "grade", "status", F.col("source_page").alias("source")),
    }
