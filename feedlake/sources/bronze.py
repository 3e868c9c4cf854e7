"""Bronze change-event files: layouts, writers and the reader (S2-S4, S8/S9 batch form).

Three layouts share one reader:

* ``topics``  — ``topics/<topic>/year=YYYY/month=MM/day=DD/hour=HH/*.json``
  (time-partitioned topic sink, S9); records are change envelopes.
* ``raw-cdc`` — ``raw-cdc/topic=<topic with . -> _>/date=YYYY-MM-DD/hour=HH/*.json``
  (raw lander, S8); records are the flat 17-field raw record.
* ``bronze``  — ``bronze/<topic>/...`` (default prefix); envelopes.

The reader always applies an explicit schema (no inference pass over the
data), knows the layout's time folders as partition columns, so that a time
range reads its hours only, and maps the raw record onto the envelope so every
layout normalizes the same way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import schemas as S

LAYOUTS = ("topics", "raw-cdc", "bronze")
TOPIC_PREFIX = "postgres.public."       # topic sink (S9) topics
RAW_TOPIC = "feedlake_cdc.public."     # raw lander (S8) topics


def topic_name(table: str) -> str:
    return f"{TOPIC_PREFIX}{table}"


def safe_topic(topic: str) -> str:
    """Topic folder name of the raw lander: dots become underscores."""
    return topic.replace(".", "_")


RAW_TOPIC_PREFIX = safe_topic(RAW_TOPIC)


# S3 -------------------------------------------------------------------------
def build_input_path(root: str, layout: str, table: str) -> str:
    root = root.rstrip("/")
    if layout == "topics":
        return f"{root}/topics/{topic_name(table)}/"
    if layout == "raw-cdc":
        return f"{root}/raw-cdc/topic={RAW_TOPIC_PREFIX}{table}/"
    if layout == "bronze":
        return f"{root}/bronze/{topic_name(table)}/"
    raise ValueError(f"unknown layout {layout!r}")


# writers (batch form of the landing sinks) ----------------------------------------
def _time_parts(ts_ms: Column) -> dict[str, Column]:
    ts = F.timestamp_millis(ts_ms)
    return {
        "year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"),
        "day": F.date_format(ts, "dd"), "hour": F.date_format(ts, "HH"),
        "date": F.date_format(ts, "yyyy-MM-dd"),
    }


def raw_record(envelopes: DataFrame, topic: str) -> DataFrame:
    """Flatten envelopes to the lander's 17-field raw record (before/after
    stay nested objects in the JSON text).  Record identity (topic, partition,
    offset, kafka_timestamp) and source position (snapshot, tx_id, lsn) are
    taken from the input where it has them."""
    src = F.col("source")
    fields = envelopes.schema["source"].dataType.fieldNames()

    def given(name: str, kind: str, default=None) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in envelopes.columns else F.lit(default).cast(kind)

    def of_source(name: str, kind: str, default=None) -> Column:
        return F.coalesce(src.getField(name).cast(kind), F.lit(default).cast(kind)) if name in fields else F.lit(default).cast(kind)

    return envelopes.select(
        given("topic", "string", topic).alias("topic"), given("partition", "int", 0).alias("partition"),
        given("offset", "long").alias("offset"),
        (F.coalesce(F.col("kafka_timestamp").cast("long"), F.col("landed_ms")) if "kafka_timestamp" in envelopes.columns
         else F.col("landed_ms")).alias("kafka_timestamp"),
        F.date_format(F.timestamp_millis("landed_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ingested_at"),
        src.getField("table").alias("table"), src.getField("schema").alias("schema"),
        F.col("op"), F.col("ts_ms").alias("event_ts_ms"),
        (F.col("ts_ms") * 1000).alias("event_ts_us"), (F.col("ts_ms") * 1_000_000).alias("event_ts_ns"),
        src.getField("ts_ms").alias("source_ts_ms"),
        of_source("snapshot", "string", "false").alias("snapshot"), of_source("txId", "long").alias("tx_id"),
        of_source("lsn", "long").alias("lsn"),
        F.col("before"), F.col("after"), F.col("landed_ms"),
    )


def write_bronze(envelopes: DataFrame, root: str, layout: str, table: str) -> str:
    """Land envelopes (with a ``landed_ms`` column) in one of the layouts.

    Rows are rebalanced by their partition folder first: a folder's rows come
    together in as few tasks as their size asks for, and AQE splits an hour
    that is larger than its advisory partition size over several tasks, hence
    files."""
    path = build_input_path(root, layout, table)
    parts = _time_parts(F.col("landed_ms"))
    if layout == "raw-cdc":
        df = raw_record(envelopes, topic_name(table)).withColumn("date", parts["date"]) \
            .withColumn("hour", parts["hour"])
        keys = ["date", "hour"]
    else:
        df = envelopes
        for k in ("year", "month", "day", "hour"):
            df = df.withColumn(k, parts[k])
        keys = ["year", "month", "day", "hour"]
    df = df.drop("landed_ms").hint("rebalance", *[F.col(k) for k in keys])
    df.write.mode("overwrite").partitionBy(*keys).json(path)
    return path


# S2 + S4 ----------------------------------------------------------------------
def _relative_object_name(root: str) -> Column:
    """Object name relative to the landing root (scheme and bucket or
    local prefix stripped)."""
    bare = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "", root.rstrip("/"))
    return F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(bare) + "/", "")


#: time folders of a layout, by which its files are partitioned
TIME_FOLDERS = {"topics": ["year", "month", "day", "hour"], "bronze": ["year", "month", "day", "hour"], "raw-cdc": ["date", "hour"]}


def folder_date(layout: str) -> Column:
    return F.col("date") if layout == "raw-cdc" else F.concat_ws("-", "year", "month", "day")


def landed_between(df: DataFrame, layout: str, since: str | None, until: str | None) -> DataFrame:
    """Rows landed from the hour ``since`` up to, without it, the hour ``until`` (``YYYY-MM-DD HH``): a filter on the
    partition columns alone, so that other folders are not opened."""
    landed = F.concat(folder_date(layout), F.lit(" "), F.col("hour"))
    if since is not None:
        df = df.filter(landed >= since)
    return df if until is None else df.filter(landed < until)


def with_path_fields(events: DataFrame, topic: str, table: str, layout: str | None = None) -> DataFrame:
    """What the writer put into the path.  Topic and table are the ones
    whose folder is read (D6: so `post_media` stays whole); date and hour are
    the layout's partition columns or, without a ``layout``, come from the
    ``name=value`` folders of the object name, under any prefix (D7)."""
    parts = F.str_to_map(F.col("_object_name"), F.lit("/"), F.lit("="))
    at = lambda name: F.try_element_at(parts, F.lit(name))
    dotted = topic.split(".")
    date = folder_date(layout) if layout else F.coalesce(at("date"), F.concat(at("year"), F.lit("-"), at("month"), F.lit("-"), at("day")))
    out = events.withColumns({
        "topic_name": F.lit(topic),
        "path_schema": F.lit(dotted[1] if len(dotted) == 3 else None).cast("string"), "path_table": F.lit(table),
        "object_date": date, "object_hour": F.col("hour") if layout else at("hour")})
    return out.drop(*TIME_FOLDERS[layout]) if layout else out


def load_raw_events(spark: SparkSession, root: str, table: str, layout: str, row_schema: T.StructType,
                    since: str | None = None, until: str | None = None, recursive: bool = False) -> DataFrame:
    """Read one table's change events as envelopes + ``_object_name`` + the
    path's fields; with ``since`` or ``until`` (``YYYY-MM-DD HH``, landing
    time) only that range's folders.  ``recursive`` reads files under folders
    of any shape instead, which cannot be pruned.

    C1: ``before``/``after`` are read as raw JSON text and parsed with the
    declared row schema, so nested objects and JSON-encoded text both load."""
    if recursive and (since or until):
        raise ValueError("a time range needs the layout's folders")
    path = build_input_path(root, layout, table)
    text_rows = {"before", "after"}
    if layout == "raw-cdc":
        schema = S.RAW_RECORD_SCHEMA
    else:
        schema = T.StructType([f if f.name not in text_rows else T.StructField(f.name, T.StringType())
                               for f in S.envelope_schema(row_schema).fields])
    reader = spark.read.option("multiLine", "false")
    folders = [] if recursive else TIME_FOLDERS[layout]
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    else:
        schema = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in folders]])
        reader = reader.option("basePath", path)
    raw = reader.schema(schema).json(path)
    if not recursive:
        raw = landed_between(raw, layout, since, until)
    raw = raw.withColumn("_object_name", _relative_object_name(root))
    before, after = F.from_json("before", row_schema), F.from_json("after", row_schema)
    if layout == "raw-cdc":
        # The raw record names the event time `event_ts_ms` and carries the
        # source fields flat; map them back onto the envelope.
        raw = raw.select(
            "op", F.col("event_ts_ms").alias("ts_ms"), before.alias("before"), after.alias("after"),
            F.struct(F.col("schema").alias("schema"), F.col("table").alias("table"),
                     F.col("source_ts_ms").alias("ts_ms")).alias("source"),
            "lsn", "partition", "offset", "_object_name", *folders)
        topic = f"{RAW_TOPIC_PREFIX}{table}"
    else:
        raw = raw.withColumn("before", before).withColumn("after", after)
        topic = topic_name(table)
    return with_path_fields(raw, topic, table, None if recursive else layout)


# fixture: orders change events -------------------------------------------------------
# fixed values of the orders change-event adapter
UPDATE_MODULUS = 5      # keys % 5 = 0 get an update (new status)
DELETE_MODULUS = 11     # keys % 11 = 0 get a delete (before image only)
STEP_MS = 1000          # r < u < d by one second each
LANDING_BASE = "2024-06-01 00:00:00"   # replay day; landing hour = key % 24


def order_change_events(spark: SparkSession, base: str) -> DataFrame:
    """Snapshot (r) for every order, update (u) and delete (d) for some keys.

    Columns: op, ts_ms, before, after, source, landed_ms."""
    from feedlake.sources.tables import read_table

    o = read_table(spark, base, "orders")
    ts0 = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    row = F.struct(
        F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_totalprice"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("o_orderdate"),
        F.col("o_orderpriority"))
    new_status = F.when(F.col("o_orderstatus") == "F", F.lit("O")).otherwise(F.lit("F"))
    updated = row.withField("o_orderstatus", new_status)
    is_upd = F.col("o_orderkey") % UPDATE_MODULUS == 0
    is_del = F.col("o_orderkey") % DELETE_MODULUS == 0
    landed = (F.unix_millis(F.lit(LANDING_BASE).cast("timestamp"))
              + (F.col("o_orderkey") % 24) * 3_600_000 + F.col("_step") * 60_000)
    null_row = F.lit(None).cast(S.ORDER_ROW_SCHEMA)
    events = o.select(
        "o_orderkey", ts0.alias("_ts0"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("_step"), F.lit("r").alias("op"), null_row.alias("before"),
                     row.alias("after")),
            F.struct(F.lit(1).alias("_step"), F.lit("u").alias("op"), row.alias("before"),
                     updated.alias("after")),
            F.struct(F.lit(2).alias("_step"), F.lit("d").alias("op"),
                     F.when(is_upd, updated).otherwise(row).alias("before"), null_row.alias("after")),
        )).alias("e"),
        is_upd.alias("_u"), is_del.alias("_d"),
    ).filter((F.col("e._step") == 0) | ((F.col("e._step") == 1) & F.col("_u"))
             | ((F.col("e._step") == 2) & F.col("_d")))
    ts = F.col("_ts0") + F.col("e._step") * STEP_MS
    return events.select(
        F.col("e.op").alias("op"), ts.alias("ts_ms"), F.col("e.before").alias("before"),
        F.col("e.after").alias("after"),
        F.struct(F.lit("public").alias("schema"), F.lit("orders").alias("table"), ts.alias("ts_ms"))
        .alias("source"),
        F.col("e._step").alias("_step"), F.col("o_orderkey"),
    ).withColumn("landed_ms", landed).drop("_step", "o_orderkey")


def interaction_create_events(spark: SparkSession, base: str) -> DataFrame:
    """Create (c) events of every interaction, landed on the replay day at
    hour event_id % 24.  Columns as ``order_change_events``."""
    from feedlake.sources import fixtures as FX

    i = FX.interactions(spark, base)
    ts = F.unix_millis(F.to_timestamp("occurred_at_raw"))
    row = F.struct(*[F.col(c) for c in i.columns])
    landed = F.unix_millis(F.lit(LANDING_BASE).cast("timestamp")) + (F.col("event_id") % 24) * 3_600_000
    return i.select(
        F.lit("c").alias("op"), ts.alias("ts_ms"), F.lit(None).cast(row_schema_of(i)).alias("before"),
        row.alias("after"),
        F.struct(F.lit("public").alias("schema"), F.lit("interactions").alias("table"), ts.alias("ts_ms"))
        .alias("source"),
        landed.alias("landed_ms"))


def row_schema_of(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
