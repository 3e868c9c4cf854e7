"""Speed layer: change events -> trending, recent views, cold-start state, outcomes.

Each state is a Structured Streaming query whose state lives in Spark's own
state store (RocksDB) under its checkpoint; a restart goes on from there and
counts every event once.  Reads open the checkpoint with the ``statestore``
source, so serving needs no running stream.

* trending: a streaming ``groupBy(post_id).count()``.
* recent views: ``transformWithState`` with a list per user, newest first and
  cut to the limit, so a busy user costs as much as any other.
* cold start: a streaming ``groupBy(post_id, field)`` that keeps the last value of
  each field and, under no field, the last score; no Python runs per post.
* outcomes: one pass whose ``observe`` metrics count the events per outcome
  while the malformed lines go to a file sink (the dead letters).  Every other
  stream observes the same metrics.

Ordering ("arrival"): later micro-batches win; inside a batch the log's own
order (record time, partition, offset) decides where the source has one, and
the event time only where it has none (text files).  In the cold-start state a
batch's place is the start time that Spark records with it in the checkpoint.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from feedlake import schemas as S
from feedlake.session import ship, use_state_store
from feedlake.streaming import envelope as EN

ARRIVAL = ["k", "p", "o", "t"]
#: record identity that a source may carry, by its short name in the order
RECORD = {"k": "kafka_timestamp", "p": "partition", "o": "offset"}
OUTCOMES = (EN.INTERACTION, EN.POST_WITH_SCORE, EN.POST_WITHOUT_SCORE, EN.IGNORED, EN.MALFORMED)


def kafka_values(spark: SparkSession, bootstrap: str, topics: list[str],
                 max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Change-event values from Kafka, earliest offsets first.  A cap on
    offsets per trigger bounds each micro-batch (a backlog is worked off in
    many batches instead of one huge one).  Needs the Kafka connector on the
    classpath; tests use ``text_values``."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest"))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    return r.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset",
                           F.unix_millis("timestamp").alias("kafka_timestamp"))


def text_values(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path).select("value")


def arrival(parts: tuple) -> tuple:
    """When a row arrived within its batch; a missing part comes first."""
    return tuple((x is not None, x or 0) for x in parts)


def order_of(ev: DataFrame) -> list[str]:
    """The parts of the arrival that the source has."""
    return [c for c in ARRIVAL if c in ev.columns]


class RecentViews(StatefulProcessor):
    """A user's newest ``limit`` posts, newest first, duplicates kept.  Rows: user, post, parts of the arrival."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.views = handle.getListState("views", "post_id string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = heapq.nlargest(self.limit, rows, key=lambda r: (arrival(r[2:]), r[1]))
        views = [(r[1],) for r in newest]
        if len(views) < self.limit:
            views += [tuple(v) for v in self.views.get()][:self.limit - len(views)]
        self.views.put(views)
        return iter(())

    def close(self) -> None:
        pass


class SpeedLayer:
    """Owns the streams under ``root``: a checkpoint per state and the dead letters."""

    STATES = ("trending", "recent_views", "coldstart", "outcomes")

    def __init__(self, spark: SparkSession, root: str, recent_views_limit: int = S.RECENT_VIEWS_LIMIT,
                 allowed_ops: tuple[str, ...] = ("c",)):
        self.spark = spark
        self.root = root.rstrip("/")
        self.limit = recent_views_limit
        self.allowed_ops = allowed_ops
        self.counted: Counter[str] = Counter()

    # streams -----------------------------------------------------------------
    def events(self, values: DataFrame) -> DataFrame:
        """The parsed events, counted by outcome on their way (T6).  The
        metrics also keep filters above from being pushed below the parsing,
        where each of their fields would parse the line anew."""
        record = {k: F.col(c).cast("long") for k, c in RECORD.items() if c in values.columns}
        seen = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES]
        return EN.parse_envelopes(values.withColumns(record), self.allowed_ops).withColumn("t", F.col("event_ts_ms")).observe("outcomes", *seen)

    def trending_stream(self, ev: DataFrame) -> DataFrame:
        """+1 per interaction create of any type."""
        return ev.filter(F.col("outcome") == EN.INTERACTION).groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))

    def recent_views_stream(self, ev: DataFrame) -> DataFrame:
        """Newest-first list per user, duplicates kept, capped."""
        views = ev.filter(F.col("outcome") == EN.INTERACTION).select("user_id", "post_id", *order_of(ev))
        return views.groupBy("user_id").transformWithState(RecentViews(self.limit), "user_id string", "Update", "None")

    def coldstart_stream(self, ev: DataFrame) -> DataFrame:
        """T4, T5: per-post field map; score = ts_ms else source.ts_ms, only when a time exists."""
        at = F.current_timestamp()      # one for a batch, the same when it is run again
        posts = ev.filter(F.col("outcome").isin(EN.POST_WITH_SCORE, EN.POST_WITHOUT_SCORE)).select(
            "post_id", at.alias("at"), *order_of(ev), EN.field_map(F.col("after")).alias("fields"), F.col("event_ts_ms").cast("double").alias("score"))
        item = lambda key, value, score: F.struct(key.alias("field"), value.alias("value"), score.alias("score"))
        none = F.lit(None).cast("string")
        fields = F.transform(F.map_entries("fields"), lambda e: item(e["key"], e["value"], F.lit(None).cast("double")))
        items = F.concat(F.coalesce(fields, F.array().cast("array<struct<field:string,value:string,score:double>>")),
                         F.when(F.col("score").isNotNull(), F.array(item(none, none, F.col("score"))))
                         .otherwise(F.array().cast("array<struct<field:string,value:string,score:double>>")))
        each = posts.select("post_id", "at", *order_of(ev), F.inline(items))
        return each.groupBy("post_id", "field").agg(F.max(F.struct("at", *order_of(ev), "value", "score")).alias("last"))

    def outcomes_stream(self, ev: DataFrame) -> DataFrame:
        """The malformed lines; the others are only counted."""
        return ev.filter(F.col("outcome") == EN.MALFORMED).select("value")

    def start(self, name: str, values: DataFrame, available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
        use_state_store(self.spark)
        ship(self.spark)
        out = getattr(self, f"{name}_stream")(self.events(values)).writeStream.option("checkpointLocation", f"{self.root}/{name}")
        out = out.format("parquet").option("path", f"{self.root}/dead_letters") if name == "outcomes" else out.format("noop").outputMode("update")
        return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=processing_time or "15 seconds")).start()

    def run(self, values: DataFrame, names: Iterable[str] = STATES) -> None:
        """Work off what the source has now; the streams run side by side."""
        started = {name: self.start(name, values) for name in names}
        for name, query in started.items():
            query.awaitTermination()
            if name == "outcomes":
                self.count(query)

    def count(self, query: StreamingQuery) -> None:
        """Add a query's observed outcomes, a row of metrics per finished batch."""
        for progress in query.recentProgress:
            row = progress.observedMetrics.get("outcomes")
            if row:
                self.counted.update(row.asDict())

    # reads -------------------------------------------------------------------
    def state(self, name: str, variable: str | None = None) -> DataFrame:
        """The store of a state: of an aggregate, or of one state variable (lists and maps whole)."""
        use_state_store(self.spark)
        r = self.spark.read.format("statestore")
        if variable:
            r = r.option("stateVarName", variable).option("flattenCollectionTypes", "false")
        return r.load(f"{self.root}/{name}")

    def trending(self) -> DataFrame:
        return self.state("trending").select("key.post_id", F.col("value.count").cast("double").alias("score"))

    def trending_top(self, n: int = S.TRENDING_READ) -> DataFrame:
        """L3: ZREVRANGE 0 n-1 (score desc, member desc)."""
        return self.trending().orderBy(F.col("score").desc(), F.col("post_id").desc()).limit(n)

    def recent_views(self, n: int | None = None) -> DataFrame:
        """Every user's list by position, or its first ``n`` entries."""
        views = F.col("list_value") if n is None else F.slice("list_value", 1, n)
        return (self.state("recent_views", "views").select("key.user_id", F.posexplode(views).alias("pos", "view"))
                .select("user_id", "view.post_id", F.col("pos").cast("long").alias("pos")))

    def recent_views_read(self, n: int = S.RECENT_VIEWS_READ) -> DataFrame:
        """L4: LRANGE 0 n-1 of every user's list."""
        return self.recent_views(n)

    def coldstart_meta(self) -> DataFrame:
        return self.state("coldstart").where("key.field is not null").select("key.post_id", "key.field", "value.max.value")

    def coldstart_scores(self) -> DataFrame:
        return self.state("coldstart").where("key.field is null").select("key.post_id", "value.max.score")

    def outcomes(self) -> DataFrame:
        """Events per outcome that this layer's runs have observed."""
        return self.spark.createDataFrame([(o, n) for o, n in self.counted.items() if n], "outcome string, n long")

    def dead_letters(self) -> DataFrame:
        return self.spark.read.schema("value string").parquet(f"{self.root}/dead_letters")
