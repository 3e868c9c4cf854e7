"""Raw landing stream (S8, S9, T8): change-event text -> partitioned JSON lines.

The file sink with a checkpoint is exactly-once (its commit log names the
files of each batch), so the reference's "write, then commit offsets"
at-least-once loop becomes a plain ``writeStream``.  The trigger interval plays
the flush timer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import schemas as S
from feedlake.streaming import envelope as EN
from feedlake.sources.bronze import RAW_TOPIC, TOPIC_PREFIX, safe_topic


def raw_records(values: DataFrame) -> DataFrame:
    """Flatten parsed envelopes into the 17-field raw record plus time parts.
    Malformed lines are not landed (the speed layer keeps them as dead letters)."""
    root, env = EN.unwrapped(F.col("value"))
    record = [c for c in ("topic", "partition", "offset", "kafka_timestamp") if c in values.columns]
    df = values.select(root.alias("_root"), env.alias("_env"), *record).filter(F.col("_root").isNotNull())
    e = F.col("_env")
    table = F.try_variant_get(e, "$.source.table", "string")
    number = lambda path: EN.as_long(F.try_variant_get(e, path, "variant"))

    def of_record(name: str, kind: str, default: Column) -> Column:
        """The source's record identity where it has one (a file source has none)."""
        return (F.coalesce(F.col(name).cast(kind), default) if name in record else default.cast(kind)).alias(name)

    ts_ms = number("$.ts_ms")
    # folders follow the landing (ingestion) time, as the lander's flush does
    ts = F.current_timestamp()
    return df.select(
        of_record("topic", "string", F.concat(F.lit(RAW_TOPIC), F.coalesce(table, F.lit("unknown")))),
        of_record("partition", "int", F.lit(0)),
        of_record("offset", "long", F.lit(None).cast("long")),
        of_record("kafka_timestamp", "long", EN.event_ms(e)),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ingested_at"),
        table.alias("table"),
        F.try_variant_get(e, "$.source.schema", "string").alias("schema"),
        F.try_variant_get(e, "$.op", "string").alias("op"),
        ts_ms.alias("event_ts_ms"),
        number("$.ts_us").alias("event_ts_us"), number("$.ts_ns").alias("event_ts_ns"),
        EN.source_ms(e).alias("source_ts_ms"),
        F.try_variant_get(e, "$.source.snapshot", "string").alias("snapshot"),
        number("$.source.txId").alias("tx_id"), number("$.source.lsn").alias("lsn"),
        F.try_variant_get(e, "$.before", "variant").alias("before"),
        F.try_variant_get(e, "$.after", "variant").alias("after"),
        F.date_format(ts, "yyyy-MM-dd").alias("date"),
        F.date_format(ts, "yyyy").alias("year"), F.date_format(ts, "MM").alias("month"),
        F.date_format(ts, "dd").alias("day"), F.date_format(ts, "HH").alias("hour"),
    )


def land(values: DataFrame, root: str, checkpoint: str, layout: str = "raw-cdc", table: str | None = None,
         max_records_per_file: int = 1_000_000, available_now: bool = True, flush_seconds: int = 15):
    """Start the lander.

    raw-cdc: ``<root>/raw-cdc/topic=<topic with . -> _>/date=/hour=`` (all tables);
    topics:  ``<root>/topics/postgres.public.<table>/year=/month=/day=/hour=`` (one table).

    Files are gzip-packed JSON lines.  A micro-batch's size, which the source's trigger caps bound, sets the size of its
    files; ``max_records_per_file`` rolls them over earlier (0: not), since a packed file is read by one task."""
    recs = raw_records(values)
    if layout == "raw-cdc":
        df = recs.drop("year", "month", "day").withColumn("topic", F.regexp_replace("topic", r"\.", "_"))
        parts, out = ["topic", "date", "hour"], f"{root.rstrip('/')}/raw-cdc"
    elif layout == "topics":
        if table is None:
            raise ValueError("the topics layout lands one table; pass table=")
        df = recs.filter(F.col("table") == table).drop("date")
        parts, out = ["year", "month", "day", "hour"], f"{root.rstrip('/')}/topics/{TOPIC_PREFIX}{table}"
    else:
        raise ValueError(f"unknown layout {layout!r}")
    w = (df.writeStream.format("json").partitionBy(*parts).option("path", out)
         .option("checkpointLocation", checkpoint).option("maxRecordsPerFile", str(max_records_per_file)).option("compression", "gzip"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{flush_seconds} seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def read_landed(spark: SparkSession, root: str) -> DataFrame:
    """Read raw-cdc landed records back; folder values become text columns."""
    fields = [f for f in S.RAW_RECORD_SCHEMA.fields if f.name != "topic"]
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in ("topic", "date", "hour")])
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/raw-cdc")


def format_topic_path(topic: str, date: str, hour: str, prefix: str = "raw-cdc") -> str:
    """Folder of one landed batch (the lander's naming rule)."""
    return f"{prefix}/topic={safe_topic(topic)}/date={date}/hour={hour}/"
