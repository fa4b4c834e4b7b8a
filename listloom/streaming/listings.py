"""New page files to listing rows, micro-batch by micro-batch."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What tasks call travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keyed state kept on disk, not on the heap; changes go to the checkpoint with each batch.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Flow = Callable[[DataFrame], DataFrame]


def page_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of page rows from Parquet files arriving in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_listings(pages: DataFrame, flow: Flow, sink: str, checkpoint: str) -> None:
    """Run a stateless flow over all available pages and append to a Parquet sink.

    The flow is the one used for tables; offsets live in ``checkpoint``, so a
    restarted job goes on where it stopped and writes each page once.
    """
    query = (
        flow(pages)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


#: Rows a task collects before it thins them out.
HELD = 1 << 16


def _first_of_each(rows: pa.Table) -> pa.Table:
    """Of each code its first row; rows without an order come last, among equals any is the first."""
    rows = rows.combine_chunks()
    # Null is a code like others.
    codes = pc.dictionary_encode(rows.column("code"), null_encoding="encode").combine_chunks().indices
    ordered = pc.sort_indices(
        pa.table({"seed": rows.column("seed"), "code": codes, "order": rows.column("order")}),
        sort_keys=[("code", "ascending"), ("seed", "descending"), ("order", "ascending")],
    )
    sorted_codes = codes.take(ordered).to_numpy(zero_copy_only=False)
    first = np.ones(len(sorted_codes), bool)
    first[1:] = sorted_codes[1:] != sorted_codes[:-1]
    return rows.take(ordered.filter(pa.array(first)))


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each code in an Arrow batch, its first row: a very frequent code sends few rows to its task."""
    for batch in batches:
        if batch.num_rows:
            yield from _first_of_each(pa.Table.from_batches([batch])).to_batches()


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each code in a task, its first row."""
    held, size, limit = [], 0, HELD
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= limit:
            held = _first_of_each(pa.Table.from_batches(held)).to_batches()
            size = sum(b.num_rows for b in held)
            limit = max(HELD, 2 * size)
    if held:
        yield from _first_of_each(pa.Table.from_batches(held)).to_batches()


def stream_skip_listed(rows: DataFrame, code: str, order: str, sink: str, checkpoint: str) -> None:
    """Append rows whose code is in no earlier batch; the first by ``order`` stays.

    Listed codes are keyed state in RocksDB: a batch looks up and writes only its own
    codes and never reads the sink.  Rows of a code are thinned out before the shuffle,
    so a code that most rows share is no large group; behind it a task holds one row of
    each of its codes, and the state, Spark's own of dropped duplicates, sees each code
    once a batch.  A batch writes the folder of its run and number by overwriting, so a
    retried batch leaves the same rows once.

    The run is named by the checkpoint.  With a new one on an old sink, the codes that
    other runs listed are read once, kept beside the checkpoint, and come ahead of all
    rows of the first batch.  Null codes are one code; rows without an order come after
    all others of their code.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    kind = rows.schema[code].dataType
    before = f"{checkpoint.rstrip('/')}-listed-before"
    if not _exists(spark, f"{before}/_SUCCESS"):
        _listed_before(spark, sink, run, code, kind).write.mode("overwrite").parquet(before)
    narrow = rows.select(F.lit(False).alias("seed"), F.col(code).alias("code"), F.col(order).alias("order"), F.struct("*").alias("row"))
    listed = spark.readStream.schema(T.StructType([T.StructField("code", kind)])).parquet(before)
    nothing = [F.lit(None).cast(narrow.schema[name].dataType).alias(name) for name in ("order", "row")]
    every = narrow.union(listed.select(F.lit(True).alias("seed"), "code", *nothing))
    thinned = every.mapInArrow(_first_of_batch, every.schema).repartition("code")
    fresh = thinned.mapInArrow(_first_of_task, every.schema).dropDuplicates(["code"]).where("NOT seed")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.select("row.*").write.mode("overwrite").parquet(f"{sink}/run={run}/batch_id={batch_id}")

    query = (
        fresh.writeStream.foreachBatch(append)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _listed_before(spark: SparkSession, sink: str, run: str, code: str, kind: T.DataType) -> DataFrame:
    """Codes that other runs wrote into the sink."""
    if not _exists(spark, sink):
        return spark.createDataFrame([], T.StructType([T.StructField("code", kind)]))
    schema = T.StructType([T.StructField(code, kind), T.StructField("run", T.StringType())])
    other = spark.read.schema(schema).parquet(sink).where(F.col("run") != run)
    return other.select(F.col(code).alias("code")).distinct()
