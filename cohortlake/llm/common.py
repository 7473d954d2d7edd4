"""What the operators share: the shared folder, staged tables and Arrow batches cut by bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these bytes.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Texts are handed to a batch function in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: Short rows that one staged file holds, about.
FILE_ROWS = 50_000
#: Rows of two or three numbers (some 10 MB) up to which a table is sent to every executor, so that texts stay in place.
BROADCAST_ROWS = 250_000
#: Prefix sums go by groups of so many.
GROUP = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where it is unset, in local mode, a temporary folder is made, set and removed at exit.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def staged(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    Later stages then start from files that outlive any executor; nothing upstream is computed twice. rows: how many
    (short) rows there are at most, where that is known: they go to a file for each FILE_ROWS, not to one for each partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, rows // FILE_ROWS))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of staged tables that are still there, in the order they were made.
_made: list[str] = []


def made() -> int:
    """How many tables are staged: what ``discard`` counts from."""
    return len(_made)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables staged since then, but the last ones to keep. Whatever reads them must have been written or collected."""
    gone = _made[since : len(_made) - keep]
    _made[since : len(_made) - keep] = []
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Texts are long: Spark's defaults of 4,096 rows to a reader's batch and 10,000 to a worker's hold tens of MB at once.
BATCH_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; batch sizes that the session leaves at their defaults become smaller."""
    for key, (default, rows) in BATCH_ROWS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, rows)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A staged table of a few numbers a row, to be broadcast if it has at most BROADCAST_ROWS rows; else it is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def running(df: DataFrame, index: str, value: str) -> DataFrame:
    """df (key, index, value) with before: the values of the key's smaller indices. Indices are summed in groups of GROUP, so
    no window holds more than a key's groups or a group's indices."""
    grouped = df.withColumn("group", F.floor(F.col(index) / GROUP).cast("long"))
    sums = grouped.groupBy("key", "group").agg(F.sum(value).alias("total"))
    sums = sums.select("key", "group", (F.sum("total").over(Window.partitionBy("key").orderBy("group")) - F.col("total")).alias("lower"))
    within = F.sum(value).over(Window.partitionBy("key", "group").orderBy(index)) - F.col(value)
    out = grouped.withColumn("within", within).join(sums, ["key", "group"])
    return out.withColumn("before", F.col("lower") + F.col("within")).drop("group", "within", "lower")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the column holds about limit bytes; one longer text makes a slice of its own."""
    array = batch.column(batch.schema.get_field_index(column))
    if len(array) == 0:
        return
    sizes = np.asarray(pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(array)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, by: str) -> DataFrame:
    """mapInArrow over byte-bounded slices of each batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, by):
                yield fn(part)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null reads as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def as_text(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) with further columns; any other column, whatever its name, is dropped."""
    return df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
