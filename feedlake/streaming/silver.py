"""Change events -> current-state tables, incrementally (silver as a stream).

One streaming query per table keeps each key's latest change in Spark's state
store (a streaming ``groupBy(key)`` with ``max_by``, so no Python runs per key): the
row, its place in the total order of changes and whether it deletes.  The order is that of the batch current
state (event time, source time, position in the log, deletes last), so neither
the order of the lines nor the cut of the batches matters.  A delete stays as a
tombstone, so a late, older change can never bring a deleted key back.  Reads
open the checkpoint and leave tombstones out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedlake import schemas as S
from feedlake.session import use_state_store
from feedlake.streaming import envelope as EN

#: as the batch state orders changes (operators.cdc.change_order)
ORDER = ["event_ts_ms", "source_ts_ms", "lsn", "partition", "offset", "is_delete", "op", "h"]
CHANGE = T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.LongType()) for c in ORDER[:5]],
                       T.StructField("is_delete", T.BooleanType()), T.StructField("h", T.LongType())])


class SilverStream:
    def __init__(self, spark: SparkSession, root: str, row_schemas: dict[str, T.StructType],
                 keys: dict[str, list[str]] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.row_schemas = row_schemas
        self.keys = {t: (keys or {}).get(t) or S.TABLE_KEYS[t] for t in row_schemas}

    def value_schema(self, table: str) -> T.StructType:
        return T.StructType([*self.row_schemas[table].fields, *CHANGE.fields])

    def changes(self, values: DataFrame, table: str) -> DataFrame:
        """The table's changes as rows of ``value_schema``."""
        _, env = EN.unwrapped(F.col("value"))
        e = F.col("_env")
        stood = [(F.col(c) if c in values.columns else F.lit(None)).cast("long").alias(c) for c in ("partition", "offset")]
        op = F.try_variant_get(e, "$.op", "string")
        is_delete = F.coalesce(op == "d", F.lit(False))
        side = F.to_json(F.when(is_delete, F.try_variant_get(e, "$.before", "variant")).otherwise(F.try_variant_get(e, "$.after", "variant")))
        rows = values.select(env.alias("_env"), *stood).select(
            F.try_variant_get(e, "$.source.table", "string").alias("table"), side.alias("side"), op.alias("op"), EN.event_ms(e).alias("event_ts_ms"),
            EN.source_ms(e).alias("source_ts_ms"), EN.as_long(F.try_variant_get(e, "$.source.lsn", "variant")).alias("lsn"),
            "partition", "offset", is_delete.alias("is_delete"))
        # the metrics keep the filter from being pushed below the parsing, which would then run once per use
        rows = (rows.observe("changes", F.count(F.when(F.col("table") == table, 1)).alias("changes"))
                .filter(F.col("table") == table).withColumn("payload", F.from_json("side", self.row_schemas[table]))
                .filter(F.col("payload").isNotNull()))
        return rows.withColumn("h", F.xxhash64(F.to_json("payload"))).select(
            *[F.col("payload").getField(f.name).alias(f.name) for f in self.row_schemas[table].fields], *CHANGE.fieldNames())

    def start(self, table: str, values: DataFrame, available_now: bool = True, processing_time: str = "15 seconds") -> StreamingQuery:
        use_state_store(self.spark)
        # a missing part of a place comes first, as null does in Spark's order
        latest = F.max_by(F.struct(*self.value_schema(table).fieldNames()), F.struct(*ORDER))
        out = self.changes(values, table).groupBy(*self.keys[table]).agg(latest.alias("current")).writeStream
        out = out.format("noop").outputMode("update").option("checkpointLocation", f"{self.root}/{table}")
        return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=processing_time)).start()

    def run(self, values: DataFrame) -> None:
        """Work off what the source has now, all tables side by side."""
        for query in [self.start(table, values) for table in self.row_schemas]:
            query.awaitTermination()

    def state(self, table: str) -> DataFrame:
        """The table's rows as of the last batch."""
        use_state_store(self.spark)
        held = self.spark.read.format("statestore").load(f"{self.root}/{table}")
        return held.select("value.valueWithExtremumOrdering.*").filter(~F.col("is_delete")).drop("h", "lsn", "partition", "offset")
