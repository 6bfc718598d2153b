"""A stream of request-log rows: windowed latency summaries and an idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import exists

LOG = "request_id string, ts timestamp, bucket_label string, success boolean, latency_ms double, ttft_ms double"


def request_stream(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def windowed_latency(stream: DataFrame, window: str = "1 minute", late: str = "5 minutes", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Per window and bucket: requests, successes, and of successful requests the mean and approximate 99th percentile latency and the mean time to the first token.

    Windows tumble, slide by ``slide``, or are sessions that end after a pause of ``gap``. Rows later than ``late`` are
    dropped, repeats by request id are counted once. Logs without a ``ttft_ms`` column give null for it.
    """
    ok = lambda c: F.when(F.col("success"), F.col(c))
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])
    if "ttft_ms" not in stream.columns:
        once = once.withColumn("ttft_ms", F.lit(None).cast("double"))
    of = F.session_window("ts", gap) if gap else F.window("ts", window, slide)
    out = once.groupBy(of.alias("w"), "bucket_label").agg(F.count(F.lit(1)).alias("requests"), F.count_if("success").alias("successes"), F.avg(ok("latency_ms")).alias("mean_ms"), F.percentile_approx(ok("latency_ms"), 0.99).alias("p99_ms"), F.avg(ok("ttft_ms")).alias("mean_ttft_ms"))
    return out.select("w.start", "w.end", "bucket_label", "requests", "successes", "mean_ms", "p99_ms", "mean_ttft_ms")


def progress(query: StreamingQuery) -> list[dict]:
    """What a query has done so far, batch by batch: batch, input rows, rows a second, state rows, rows dropped as late, watermark."""
    return [
        {
            "batch": p["batchId"], "input_rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond"), "state_rows": sum(o["numRowsTotal"] for o in p.get("stateOperators", [])),
            "late_rows": sum(o["numRowsDroppedByWatermark"] for o in p.get("stateOperators", [])), "watermark": (p.get("eventTime") or {}).get("watermark"),
        }
        for p in query.recentProgress
    ]


def write_once(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append micro-batches to Parquet; a batch that was written before a restart is not written again."""

    def sink(batch: DataFrame, number: int) -> None:
        place = f"{target}/batch={number:012d}"
        if not exists(batch.sparkSession, place + "/_SUCCESS"):
            batch.write.mode("overwrite").parquet(place)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
