"""What the training-data operators share: shared scratch tables, table reading and Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch where the session still has Spark's default of 10,000: texts are long.
ARROW_ROWS = 512
_own_scratch = "/tmp/paperquill-scratch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches from now on, in this session, unless it has a size of its own; Spark reads the setting when a
    query runs, so it can't be put back before. Results don't depend on it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of this machine; any other is an error, for executors would each write
    to their own disk.
    """
    set_ = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_ and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (set_ or f"file://{_own_scratch}").rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner removes what is left
        pass


#: (weak reference to the JVM's relation, session, path) of tables that are deleted once no plan has the relation.
_watched: list[tuple] = []


def _relation(df: DataFrame):
    return df._jdf.queryExecution().analyzed().collectLeaves().head().relation()


def sweep() -> None:
    """Delete the tables that no plan, of whatever DataFrame is derived from them, refers to any more."""
    for entry in list(_watched):
        weak, spark, path = entry
        try:
            gone = weak.get() is None
        except Exception:  # of a session that has ended
            _watched.remove(entry)
            continue
        if gone:
            _watched.remove(entry)
            _delete(spark, path)


class Scratch:
    """Tables of one operator run, written to the shared folder, so that no lineage hangs on an executor's disk.

    save() writes and rereads; drop() deletes a table that nothing reads any more, and close() all that are left, as does the
    end of a with block. Of a Scratch that isn't closed, a table goes when the JVM has dropped every plan that reads it:
    later, when another table is saved. Whoever takes an RDD from a result has to keep the result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        if self.root.startswith(f"file://{_own_scratch}/"):
            atexit.register(shutil.rmtree, self.root.removeprefix("file://"), True)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        schema, path = df.schema, self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        del df
        self.free()
        out = self.spark.read.schema(schema).parquet(path)
        out._paperquill_path = path
        self.tie(path, out)
        return out

    def save_split(self, df: DataFrame, column: str, name: str = "t") -> tuple[DataFrame, DataFrame]:
        """The rows for which a boolean column is true, and those for which it is false, stored apart and without it."""
        schema, path = df.drop(column).schema, self.path(name)
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
        del df
        self.free()
        out = []
        for value in ("true", "false"):
            part = f"{path}/{column}={value}"
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
            if p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                table = self.spark.read.schema(schema).parquet(part)
                table._paperquill_path = part
                self.tie(part, table)
            else:  # there are no such rows
                table = self.spark.createDataFrame([], schema)
            out.append(table)
        return out[0], out[1]

    def tie(self, path: str, table: DataFrame) -> None:
        """Delete a path when the plans that read the table are gone."""
        _watched.append((self.spark.sparkContext._jvm.java.lang.ref.WeakReference(_relation(table)), self.spark, path))

    def free(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished jobs, and old tables go."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        sweep()

    def close(self) -> None:
        """Delete all tables: results have to be read or stored before."""
        _watched[:] = [x for x in _watched if not x[2].startswith(self.root + "/")]
        _delete(self.spark, self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if hasattr(t, "_paperquill_path"):
                _delete(self.spark, t._paperquill_path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of df (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list:
    """All columns of df as they are, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """(docs stored with a number for each row, the name of that column).

    A scan numbers rows by its splits, which change with the cores that are registered when it is planned; so rows are
    numbered once, and every later step reads the stored numbers.
    """
    (row,) = fresh(docs, "row")
    return scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


#: A join by a key with very many rows is spread so that no piece has more than this share of all rows.
HOT_PARTS = 2000


def hot_join(rows: DataFrame, table: DataFrame, key: str, other: str, count: str, total: int) -> DataFrame:
    """rows joined with a table of one row per key, which says in a column how many rows each key has.

    Keys with over a HOT_PARTS-th of the total are fewer than HOT_PARTS, so they are broadcast; their rows are dealt to as
    many tasks as they fill, by the hash of another column, and the table's row is copied to each of these.
    """
    w, salt = fresh(rows, "w", "salt")
    piece = F.lit(max(1, -(-total // HOT_PARTS)))
    wide = F.ceil(F.col(count) / piece).cast("int")
    hot = F.broadcast(table.filter(F.col(count) > piece).select(key, wide.alias(w)))
    dealt = rows.join(hot, key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(other), F.col(w)).cast("int"), F.lit(0))).drop(w)
    copied = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(wide, F.lit(1)) - 1)))
    return dealt.join(copied, [key, salt]).drop(salt)


def trim() -> None:
    """At the end of a task: give memory that isn't used back, for the worker waits for the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a column added, or replaced where that name is taken."""
    i = batch.schema.get_field_index(name)
    if i < 0:
        return batch.append_column(name, values)
    return batch.set_column(i, name, values)


def added_schema(df: DataFrame, *fields: tuple[str, str]) -> str:
    """DDL of df's columns with the given ones added, or put in the place of those of the same name."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    new = dict(fields)
    out = [(n, new.pop(n, t)) for n, t in have]
    return ", ".join(f"`{n}` {t}" for n, t in [*out, *new.items()])


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lens[0]], flat[starts[1]:...], ... joined."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts - (ends - lens), lens)
    return flat[at]


def crc_mod(column: str, modulus: int):
    """crc32 of a column's text form, modulo; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
