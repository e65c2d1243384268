"""Readers and writers of questions, papers, predictions and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}


def _struct(columns: str) -> T.StructType:
    """A schema of 'name kind, ...'; it needs no session, unlike DDL."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(","))])


METADATA = _struct("difficulty string, grade int, type string, term int, year int, region string, source string, pdf string, n_options int, needs_context boolean, original_n_options int")
#: answer is read as text: it may be a number or an option.
RAW = _struct("q_no int, subject string, category string, question string, choices strings, answer string").add("metadata", METADATA)
TRAIN = _struct("id string, subject string, category string, question string, choices strings, answer int, grade int, difficulty string, year int, term int, region string, source string, dataset string, original_n_options int")
PREDICTIONS = _struct("id string, subject string, category string, answer int, pred int, raw_output string, correct boolean")
PAPERS = ["grade", "subject", "term", "year", "region", "has_answers", "source_page", "pdf_url", "local_path", "sha256"]


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Files of JSON arrays of questions, flat: id is the file's stem and the question's number."""
    raw = spark.read.schema(RAW).option("multiLine", True).json(f"{folder}/*.json").withColumn("source_file", F.col("_metadata.file_name"))
    name = F.url_decode(F.replace("source_file", F.lit("+"), F.lit("%2B")))
    return raw.select(
        F.concat(F.regexp_replace(name, r"\.json$", ""), F.lit("::"), F.col("q_no").cast("string")).alias("id"), name.alias("source_file"), "q_no",
        F.trim("subject").alias("subject"), F.trim("category").alias("category"), "question", "choices", "answer", "metadata.difficulty", "metadata.grade", "metadata.year", "metadata",
    )


def read_extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of all grades below a folder of grade_NN folders."""
    return spark.read.schema(RAW).option("multiLine", True).json(f"{folder}/grade_*/questions_grade_*.json").withColumn("answer", F.col("answer").try_cast("int"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty ones null; a byte order mark is not part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns])


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue with numbers and booleans as such."""
    df = read_csv(spark, path)
    for c in ("grade", "term", "year"):
        df = df.withColumn(c, F.col(c).try_cast("int"))
    return df.withColumn("has_answers", F.col("has_answers") == "True")


def files_on_disk(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """local_path (below the folder), size and sha256 of files, and whether they begin as PDFs do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.element_at(F.split(F.col("path"), "\\Q" + root + "/\\E", 2), 2)
    return files.select(rel.alias("local_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_by_grade(df: DataFrame, path: str, grade: Column) -> None:
    """A folder for each grade; rows without one go to grade 0."""
    df.withColumn("grade_folder", F.lpad(F.coalesce(grade, F.lit(0)).cast("string"), 2, "0")).write.mode("overwrite").option("ignoreNullFields", False).partitionBy("grade_folder").json(path)


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """With a header and, for spreadsheets, a byte order mark before it."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "﻿" + first) if bom else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_errors(df: DataFrame, path: str) -> None:
    """Add url and error to a log of CSV files; the first of them has the header, and nothing else has."""
    rows = df.select("url", "error")
    if not _exists(df.sparkSession, path):
        df.sparkSession.createDataFrame([("url", "error")], rows.schema).coalesce(1).write.csv(path)
    rows.write.mode("append").option("escape", '"').csv(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, error string").option("escape", '"').csv(path).filter("not (url = 'url' and error = 'error')")


def write_json_array(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One file with an indented JSON array of all rows, in an order if one is given; an empty table gives [].

    A JSON array is one text, so one task writes it; it holds a batch of rows at a time. write_by_grade is for large tables.
    """
    import pyarrow as pa

    rows = (df.orderBy(*order) if order else df).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).coalesce(1)

    def run(batches):
        before = "["
        for b in batches:
            for text in b.column("value").to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [before + "\n  " + text.replace("\n", "\n  ")]})
                before = ","
        yield pa.RecordBatch.from_pydict({"value": ["[]" if before == "[" else "]"]})

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], anew: bool = False) -> DataFrame:
    """The table at a path; it is made and written where there is none, or when it is wanted anew."""
    if anew or not _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report_json(**tables: DataFrame) -> DataFrame:
    """One row with a JSON object of each (small) table's rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))).alias("rows")).select(F.lit(name).alias("name"), F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("json"))
        out = one if out is None else out.unionByName(one)
    pairs = F.array_sort(F.collect_list(F.concat(F.lit('"'), "name", F.lit('":'), "json")))
    return out.agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("json"))
