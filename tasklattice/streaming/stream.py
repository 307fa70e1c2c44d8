"""Structured Streaming: event windows and resumable admission."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, is_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, so that it need not fit in the executors' heap."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _once(writer, where: str) -> None:
    query = writer.option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()


def event_stream(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    """The events of a Parquet file or folder as a stream with an event-time column and a watermark of an hour; rows of a folder ``mark`` are added."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rpartition("/")
    events = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    if mark:
        events = events.unionByName(spark.readStream.schema(schema).parquet(mark))
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def windowed(spark: SparkSession, path: str, kind: str, work: str | None = None, close: bool = True) -> DataFrame:
    """Counts and sums per window: ``tumbling`` (1 hour), ``sliding`` (1 hour every 30 minutes) or ``session`` (per user, 30 minutes' gap).

    A window is written when the watermark has passed its end, and its state is
    dropped: state is bounded by the hour of lateness, and rows later than that
    are lost. With ``close`` the input is finished: a mark far in the future
    passes the watermark over all windows. Without it, windows above the last
    watermark stay in the state, and a later run with the same ``work`` folder
    (output and checkpoint) goes on where this one ended. Rows without a time
    are in no window.
    """
    work = work or Scratch(spark, f"stream-{kind}").root
    mark = f"{work}/mark" if close else None
    if close:
        spark.read.parquet(path).limit(0).union(spark.range(1).select(*[(F.lit("9000-01-01 00:00:00") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.read.parquet(path).schema])).write.mode("overwrite").parquet(mark)
    events = event_stream(spark, path, mark)
    if kind == "session":
        keys = [F.session_window("ts", "30 minutes").alias("w"), F.col("user_id")]
    else:
        keys = [F.window("ts", "1 hour", *(["30 minutes"] if kind == "sliding" else [])).alias("w")]
    counts = events.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    _once(counts.writeStream.outputMode("append").format("parquet").option("path", f"{work}/out"), f"{work}/state")
    done = spark.read.schema(counts.schema).parquet(f"{work}/out")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    extra = ["user_id"] if kind == "session" else []
    return done.select(*extra, stamp("w.start").alias("starts"), stamp("w.end").alias("ends"), "n", "total")


def _gate(rows: DataFrame, key: Column, order: list[str], n: int, reason: str) -> DataFrame:
    """The rows of a stream with a ``reason`` for those beyond the first ``n`` of their key; the number of rows seen is the key's state."""
    names = [f.name for f in rows.schema if f.name != "reason"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", reason string"

    def run(_key, frames, state):
        import numpy as np
        import pandas as pd

        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        before = state.get[0] if state.exists else 0
        state.update((before + len(pdf),))
        beyond = np.arange(before, before + len(pdf)) >= n
        yield pdf[names].assign(reason=np.where(beyond, reason, None))

    return rows.drop("reason").withColumn("_key", key).groupBy("_key").applyInPandasWithState(run, schema, "seen long", "append", "NoTimeout")


def admitted(spark: SparkSession, folder: str, columns: str, id_col: str, request: str, shape: str, order: list[str], cap: int, work: str | None = None, screen: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """All rows of a folder of Parquet files that arrives bit by bit, with a ``reason``: equal to ``admit.admission`` if files arrive in order.

    Three gates follow each other, by id, by request and by shape. A gate is a
    stream with keyed state, one number per key, in RocksDB: a batch touches
    the keys it holds and nothing else, and between gates rows go through
    committed Parquet folders. Rows that are screened (column ``screen``) or
    have no id pass no gate; a null or empty request key joins nothing.

    ``work`` holds all outputs and checkpoints. A run that was killed, or a run
    after new files have come, goes on from there with the same call and
    neither loses nor repeats rows; without it a temporary folder is used and
    nothing can be resumed. A batch holds ``files_per_batch`` files; the rows
    of one key in one batch are sorted together.
    """
    work = work or Scratch(spark, "admitted").root
    schema = spark.createDataFrame([], columns).schema
    whole = spark.createDataFrame([], columns + ", reason string").schema
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    passed = lambda name: spark.readStream.schema(whole).parquet(f"{work}/{name}").where("reason is null")
    refused = F.coalesce(F.when(F.col(id_col).isNull(), "missing_id"), F.col(screen)) if screen else F.when(F.col(id_col).isNull(), "missing_id")
    asked = F.coalesce(F.col(request), F.lit("")) != ""

    def write(rows: DataFrame, name: str) -> None:
        _once(rows.writeStream.outputMode("append").format("parquet").option("path", f"{work}/{name}"), f"{work}/{name}-state")

    with _state_on_disk(spark):
        write(source().withColumn("reason", refused).where("reason is not null"), "refused")
        write(_gate(source().withColumn("reason", refused).where("reason is null"), F.col(id_col), order, 1, "duplicate_task_id"), "ids")
        write(_gate(passed("ids").where(asked), F.col(request), order, 1, "duplicate_request"), "requests")
        write(_gate(passed("ids").where(~asked).unionByName(passed("requests")), F.coalesce(F.col(shape), F.lit("")), order, cap, "signature_capped"), "shapes")
    read = lambda name: spark.read.schema(whole).parquet(f"{work}/{name}")
    out = read("refused").unionByName(read("ids").where("reason is not null")).unionByName(read("requests").where("reason is not null"))
    return out.unionByName(read("shapes").withColumn("reason", F.coalesce("reason", F.lit("ok"))))


def running_counts(stream: DataFrame, author: str, kept: str) -> DataFrame:
    """Attempts and kept per author of a stream, for the complete output mode."""
    return stream.groupBy(author).agg(F.count("*").alias("attempts"), F.count_if(F.col(kept)).alias("kept"))
