"""Incremental counting and accumulation over file streams.

Counts and vector sums live in Spark's state store alone and are read from there with the
state data source, as of any batch that is still kept; no second copy is written, and a
replayed batch changes nothing, as the store keeps a version for each batch.  The
vocabulary finds new tokens by deduplication in the state store.  Its batches write their
new tokens and the next free id to folders of their own, overwritten on replay.

Context vectors have up to k state rows for each word, so their stream is started with the
RocksDB store, which keeps rows on disk; the others take the session's store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from corpuslens.operators import context as C
from corpuslens.operators import vocabulary as V
from corpuslens.operators.ordering import ordered_index


@dataclass(frozen=True)
class Running:
    """A started stream: its query handle, and its table as far as it has come."""

    query: StreamingQuery
    read: Callable[..., DataFrame]

    def __call__(self, spark: SparkSession) -> DataFrame:
        """The table once all input that was there has been processed."""
        self.query.processAllAvailable() if self.query.isActive else self.query.awaitTermination()
        return self.read(spark)


def read_documents(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _start(writer: DataStreamWriter, state: str, trigger: dict | None) -> StreamingQuery:
    """Starts the query; by default it takes what is there and ends."""
    return writer.option("checkpointLocation", f"{state}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def state_table(spark: SparkSession, state: str, schema: str, batch: int | None = None) -> DataFrame:
    """A streamed aggregation's groups and sums, read from the state store as of a batch, by default the last.

    `schema` names the key columns and then the sums; a stream without a batch has no rows.
    """
    reader = spark.read.format("statestore")
    try:
        rows = (reader if batch is None else reader.option("batchId", batch)).load(f"{state}/checkpoint")
    except PySparkException as error:
        if batch is None and error.getCondition() in NO_BATCH:
            return spark.createDataFrame([], schema)
        raise
    return rows.select("key.*", "value.*").toDF(*[c.split()[0] for c in schema.split(", ")])


# What the state data source raises for a checkpoint without a committed batch.
NO_BATCH = ("STDS_COMMITTED_BATCH_UNAVAILABLE", "STDS_OFFSET_LOG_UNAVAILABLE", "STDS_NO_PARTITION_DISCOVERED_IN_STATE_STORE")


ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # saves a lookup at each write
}


@contextmanager
def session_conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings for the streams started inside, which keep those of their start."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _summed(groups: DataFrame, schema: str, state: str, trigger: dict | None) -> Running:
    """Runs a streamed aggregation for its state; the sink takes nothing."""
    writer = groups.writeStream.outputMode("update").format("noop")
    return Running(_start(writer, state, trigger), lambda spark, batch=None: state_table(spark, state, schema, batch))


def stream_word_frequencies(stream: DataFrame, state: str, trigger: dict | None = None) -> Running:
    """Running counts of a stream with `tokens`; one state row per token."""
    return _summed(V.word_frequencies(stream), "token string, freq long", state, trigger)


def stream_context_vectors(
    stream: DataFrame, state: str, size: int, k: int, s: int, seed: int = 0, include_target: bool = True, trigger: dict | None = None
) -> Running:
    """Running context vectors ``(target, idx, w)``: one state row per cell, at most k for each word."""
    cells = C.context_cells(stream, size, k, s, seed, include_target)
    sums = cells.groupBy("target", "idx").agg(F.sum("v").alias("w"))
    with session_conf(stream.sparkSession, ON_DISK):
        running = _summed(sums, "target string, idx int, w long", state, trigger)
    return Running(running.query, lambda spark, batch=None: running.read(spark, batch).where("w <> 0"))


NEXT = "next long, batch_id int"


def stream_vocabulary(stream: DataFrame, state: str, trigger: dict | None = None) -> Running:
    """A growing vocabulary ``(token, id)``: new tokens take the next ids, old ids never change.

    The state store lets each token through once, so a batch sees only its new tokens; from
    what is stored it reads one number, the next free id after the batch before.  A batch that
    is replayed meets the same state and the same number, and writes the same ids again.
    """
    table, numbers = f"{state}/table", f"{state}/next"

    def write(fresh: DataFrame, batch_id: int) -> None:
        spark = fresh.sparkSession
        before = spark.read.schema("next long").parquet(f"{numbers}/batch_id={batch_id - 1}").first()[0] if batch_id else 0
        # The stateful part runs once: its rows are written before they are ordered.
        fresh.write.mode("overwrite").parquet(f"{state}/fresh/batch_id={batch_id}")
        tokens = spark.read.schema("token string").parquet(f"{state}/fresh/batch_id={batch_id}")
        named = ordered_index(tokens, "token", name="id", start=before)
        named.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        found = spark.read.schema("id long").parquet(f"{table}/batch_id={batch_id}").count()
        spark.range(1).select(F.lit(before + found).alias("next")).write.mode("overwrite").parquet(f"{numbers}/batch_id={batch_id}")

    def read(spark: SparkSession, batch: int | None = None) -> DataFrame:
        """The ids after a batch, by default the last one that is complete."""
        if batch is None:
            batch = spark.read.schema(NEXT).parquet(numbers).agg(F.max("batch_id")).first()[0]
        rows = spark.read.schema("token string, id long, batch_id int").parquet(table)
        return rows.where(F.col("batch_id") <= batch).select("token", "id")

    once = V.tokens_only(stream).dropDuplicates(["token"])
    return Running(_start(once.writeStream.outputMode("append").foreachBatch(write), state, trigger), read)


def stream_rows(stream: DataFrame, state: str, trigger: dict | None = None) -> Running:
    """Appends the rows of a stateless stream (tokens, n-grams, entities) to a Parquet table."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{state}/table")
    return Running(_start(writer, state, trigger), lambda spark: spark.read.parquet(f"{state}/table"))
