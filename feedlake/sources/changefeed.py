"""Change-event lines for the speed layer, derived from the given tables.

Each line is the JSON text a CDC topic would carry (what a Kafka value cast
to string looks like), covering the shapes the speed layer must handle:
wrapped and unwrapped envelopes, numeric and text ``ts_ms``, source-time
fallback, no time at all, missing ids, non-create ops, other tables and
malformed lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.sources import fixtures as FX
from feedlake.sources.bronze import order_change_events
from feedlake.sources.tables import read_table

# fixed values of the change-feed adapter
WRAP_MODULUS = 2            # even keys arrive wrapped as {"payload": envelope}
NO_POST_ID_MODULUS = 97     # interaction creates with event_id % 97 = 0 lack post_id
TEXT_TS_MODULUS = 7         # post creates with doc_id % 7 = 0 carry ts_ms as text
NO_SOURCE_TS_MODULUS = 26   # ... with doc_id % 26 = 0 carry no source.ts_ms
SOURCE_TS_BASE = 1_700_000_000_000
SPLIT_AT = "2024-01-16 00:00:00"   # events before land in the first batch, the rest later

#: lines are packed (they repeat every field's name) and rolled over, since a packed file is read by one task
LINE_FILES = {"compression": "lz4", "maxRecordsPerFile": "25000"}
_JSON_OPTS = {"ignoreNullFields": "false"}


def _line(env: Column, key: Column) -> Column:
    wrapped = F.to_json(F.struct(env.alias("payload")), _JSON_OPTS)
    return F.when(key % WRAP_MODULUS == 0, wrapped).otherwise(F.to_json(env, _JSON_OPTS))


def _source(table: str, ts: Column) -> Column:
    return F.struct(F.lit("public").alias("schema"), F.lit(table).alias("table"), ts.alias("ts_ms"))


def interaction_creates(spark: SparkSession, base: str) -> DataFrame:
    i = FX.interactions(spark, base)
    ts = F.unix_millis(F.to_timestamp("occurred_at_raw"))
    after = F.struct(
        "event_id", "user_id",
        F.when(F.col("event_id") % NO_POST_ID_MODULUS != 0, F.col("post_id")).alias("post_id"),
        "interaction_type", "occurred_at_raw", "session_id", "device_type", "source_surface",
        "dwell_time_seconds")
    env = F.struct(F.lit("c").alias("op"), ts.alias("ts_ms"), F.lit(None).cast("string").alias("before"),
                   after.alias("after"), _source("interactions", ts).alias("source"))
    return i.select(_line(env, F.col("event_id")).alias("value"), ts.alias("arrival_ms"))


def post_creates(spark: SparkSession, base: str) -> DataFrame:
    p = FX.posts(spark, base)
    pub = F.unix_millis(F.to_timestamp("published_at_raw"))
    doc = F.col("post_id")
    ts_field = F.when(doc % TEXT_TS_MODULUS == 0, pub.cast("string").cast("variant")) \
        .otherwise(pub.cast("variant"))
    src_ts = F.when(doc % NO_SOURCE_TS_MODULUS != 0, F.lit(SOURCE_TS_BASE) + doc)
    after = F.struct(*[F.col(c) for c in p.columns])
    env = F.struct(F.lit("c").alias("op"), ts_field.alias("ts_ms"), F.lit(None).cast("string").alias("before"),
                   after.alias("after"), _source("posts", src_ts).alias("source"))
    return p.select(_line(env, doc).alias("value"), F.coalesce(pub, src_ts).alias("arrival_ms"))


def order_changes(spark: SparkSession, base: str) -> DataFrame:
    ev = order_change_events(spark, base).drop("landed_ms")
    key = F.coalesce(F.col("after.o_orderkey"), F.col("before.o_orderkey"))
    env = F.struct("op", "ts_ms", "before", "after", "source")
    return ev.select(_line(env, key).alias("value"), F.col("ts_ms").alias("arrival_ms"))


def malformed(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "pages").select(F.col("url").alias("value"),
                                                   F.lit(None).cast("long").alias("arrival_ms"))


def change_lines(spark: SparkSession, base: str) -> DataFrame:
    """All lines with their arrival time (ms, may be null)."""
    return (interaction_creates(spark, base).unionByName(post_creates(spark, base))
            .unionByName(order_changes(spark, base)).unionByName(malformed(spark, base)))


def land_lines(spark: SparkSession, base: str, folder: str) -> list[str]:
    """Write the lines as text drops, in one job: 0 = arrivals before SPLIT_AT
    (or without a time), 1 = the rest.  Returns the folder of each."""
    cut = F.unix_millis(F.lit(SPLIT_AT).cast("timestamp"))
    later = F.coalesce(F.col("arrival_ms") >= cut, F.lit(False)).cast("int")
    path = folder.rstrip("/")
    change_lines(spark, base).select("value", later.alias("drop")).write.options(**LINE_FILES).partitionBy("drop").text(path)
    return [f"{path}/drop={i}" for i in (0, 1)]


def land_all(spark: SparkSession, base: str, folder: str) -> str:
    """Write every line as one text drop (one job)."""
    path = f"{folder.rstrip('/')}/drop0"
    change_lines(spark, base).select("value").write.options(**LINE_FILES).mode("overwrite").text(path)
    return path


def order_changes_with_op(spark: SparkSession, base: str) -> DataFrame:
    """Orders change lines with their op (for snapshot-then-changes drops)."""
    ev = order_change_events(spark, base).drop("landed_ms")
    key = F.coalesce(F.col("after.o_orderkey"), F.col("before.o_orderkey"))
    env = F.struct("op", "ts_ms", "before", "after", "source")
    return ev.select(_line(env, key).alias("value"), "op")
