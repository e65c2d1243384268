"""Evaluation that goes on where it stopped: in batch by an anti-join with the log, as a stream by a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mcq import build_messages, format_question
from ..operators.joins import restrict, todo
from ..operators.sampling import few_shots
from ..operators.scoring import Scorer, predictions, score
from ..sources.questions import PREDICTIONS


def prompts(questions: DataFrame, pool: DataFrame | None = None, k: int = 0, language: str = "en", seed: int = 42, with_nfc: bool = True) -> DataFrame:
    """questions with messages; with a pool and k > 0, up to k questions of the same subject go before as turns."""
    q = questions.withColumn("prompt", format_question(F.col("question"), F.col("choices"), language, with_nfc))
    if pool is None or k <= 0:
        return q.withColumn("messages", build_messages(F.col("prompt"), None, language)).drop("prompt")
    shots = pool.withColumn("prompt", format_question(F.col("question"), F.col("choices"), language, with_nfc)).select("id", "subject", "prompt", "answer")
    return few_shots(q, shots, k, seed=seed).withColumn("messages", build_messages(F.col("prompt"), F.col("shots"), language)).drop("prompt", "shots")


def run_eval(spark: SparkSession, questions: DataFrame, make: Callable[[], Scorer], log: str, **how) -> DataFrame:
    """Predictions of all questions; those in the log are not asked again, and new ones are appended to it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        left = todo(questions, spark.read.schema(PREDICTIONS).json(log), "id")
    else:
        left = questions
    predictions(score(prompts(left, **how), make)).write.mode("append").option("ignoreNullFields", False).json(log)
    return restrict(spark.read.schema(PREDICTIONS).json(log), questions)


def stream_eval(spark: SparkSession, folder: str, schema, make: Callable[[], Scorer], log: str, checkpoint: str, **how):
    """A query that predicts what files of questions come into a folder, each file once, and stops when it has done so.

    A batch's number is part of its folder in the log, so a batch that is repeated after a failure replaces itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        predictions(score(prompts(batch, **how), make)).write.mode("overwrite").option("ignoreNullFields", False).json(f"{log}/batch={number}")

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(stream: DataFrame, save: Callable[[DataFrame, int], None], key: str, version: str, checkpoint: str):
    """Keep the latest row of each key of a stream: each micro-batch is reduced to it, and save merges that."""

    def one(batch: DataFrame, number: int) -> None:
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
        save(batch.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, version).alias("_r")).select("_r.*"), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
