"""Structured Streaming flows. Each runs with ``availableNow`` into the shared folder and returns what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordqc.session import shared_folder

C = F.col
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events.parquet") -> DataFrame:
    """Arrivals with a fixed schema; ``ts`` is a UTC instant so that it can carry a watermark."""
    return (spark.readStream.schema(EVENTS).option("pathGlobFilter", file_glob).parquet(folder)
            .withColumn("ts", C("ts").cast("timestamp")))


def _paths(spark: SparkSession, name: str, root: str | None) -> tuple[str, str]:
    root = root.rstrip("/") if root else f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def _append(stream: DataFrame, out: str, ckpt: str) -> None:
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_append(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Run an append-mode query over what has arrived and read its sink; a caller's ``root`` folder resumes where the last call ended."""
    out, ckpt = _paths(stream.sparkSession, name, root)
    _append(stream, out, ckpt)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


#: Later than any arrival: moves the watermark past all of them; its own window stays open and is never emitted.
END = "9999-01-01 00:00:00"


def run_closed(events: DataFrame, flow: Callable[[DataFrame], DataFrame], name: str, root: str | None = None) -> DataFrame:
    """``flow(events)`` in append mode to the end of a finite input: windows and sessions that the last arrivals leave open are emitted too.

    A second source beside the events is empty at first. After everything has arrived it is given one row at ``END``, and the same query
    goes on from its checkpoint, so no arrival of an earlier batch can be late because of it. What arrives after that is late.
    """
    spark = events.sparkSession
    out, ckpt = _paths(spark, name, root)
    closing = out[:-len("out")] + "closing"
    spark.createDataFrame([], events.schema).write.mode("ignore").parquet(closing)
    stream = flow(events.unionByName(spark.readStream.schema(events.schema).parquet(closing)))
    _append(stream, out, ckpt)
    last = [F.to_timestamp(F.lit(END)).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*last).write.mode("append").parquet(closing)
    _append(stream, out, ckpt)
    return spark.read.schema(stream.schema).parquet(out)


def _version(spark: SparkSession, out: str) -> int:
    """The last complete version of a snapshot."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/v*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return max(int(f.getPath().getParent().getName()[1:]) for f in found)


def run_snapshot(stream: DataFrame, keys: list[str], order: list[str], name: str, root: str | None = None) -> DataFrame:
    """Merge arrivals into a versioned snapshot that holds the newest row per key.

    Each batch writes version ``batch + 1`` from the version before, so a batch
    that runs again writes the same version again. With a caller's ``root`` folder
    the next call goes on from the last version.
    """
    spark = stream.sparkSession
    out, ckpt = _paths(spark, name, root)
    cols = stream.columns
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/v0")

    def merge(batch: DataFrame, batch_id: int) -> None:
        old = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/v{batch_id}")
        newest(old.unionByName(batch), keys, order).select(*cols).write.mode("overwrite").parquet(f"{out}/v{batch_id + 1}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/v{_version(spark, out)}")


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key; partial maxima before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def catalog_arrivals(events: DataFrame) -> DataFrame:
    """File sightings: path, size and time of every event."""
    return events.select(F.concat(F.lit("Main/u"), C("user_id").cast("string"), F.lit("/"), "event_type").alias("path"),
                         F.floor(C("value") * 100).alias("size"), F.unix_micros("ts").alias("modified_us"), C("event_id").alias("seq"))


def scan_progress(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Totals per status and tumbling window, with the last value in the window."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("value").alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))
            .select(F.unix_seconds("w.start").alias("window_start"), "event_type", "files", "total", "last_value"))


def session_expiry(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions per user that have closed."""
    return (events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("actions"))
            .select("user_id", F.unix_micros("w.start").alias("started_us"), F.unix_micros("w.end").alias("expires_us"), "actions"))


def undo_window(events: DataFrame, seconds: int = 12, late: str = "10 minutes") -> DataFrame:
    """A discard (click) followed by an undo (view) of the same user inside the window."""
    side = lambda kind, p: events.where(C("event_type") == kind).select(
        C("event_id").alias(f"{p}_id"), C("ts").alias(f"{p}_ts"), C("user_id").alias(f"{p}_user")).withWatermark(f"{p}_ts", late)
    d, u = side("click", "discard"), side("view", "undo")
    span = F.expr(f"interval {int(seconds)} seconds")
    return d.join(u, (C("discard_user") == C("undo_user")) & (C("undo_ts") >= C("discard_ts")) & (C("undo_ts") <= C("discard_ts") + span)) \
            .select("discard_id", "undo_id", C("discard_user").alias("user_id"))


def content_dedupe(events: DataFrame, horizon: str = "1 day") -> DataFrame:
    """The first arrival of a content hash inside the retention horizon."""
    h = events.withColumn("hash", F.sha2(F.concat_ws("|", "props", "event_type"), 256))
    return h.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["hash"]).select("hash", "event_id")


def throughput(events: DataFrame, window: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes", planned: int = 100000) -> DataFrame:
    """Completed per second and seconds to go, over sliding windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("completed"))
    secs = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    rate = C("completed") / secs
    return w.select(F.unix_seconds("w.start").alias("window_start"), "completed", rate.alias("per_second"),
                    ((F.lit(planned) - C("completed")) / rate).alias("eta_seconds"))


def issue_lifecycle(events: DataFrame) -> DataFrame:
    """Detected / cleared / resolved events of an issue key; feed to ``run_snapshot`` for the current state."""
    action = F.when(C("event_type") == "click", "detected").when(C("event_type") == "view", "cleared").otherwise("resolved")
    return events.select(C("user_id").alias("project_id"), F.get_json_object("props", "$.k").alias("issue"), action.alias("action"),
                         F.when(action == "detected", "Unresolved").otherwise("Resolved").alias("status"), F.unix_micros("ts").alias("at_us"), "event_id")
