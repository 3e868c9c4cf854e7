"""All-text staging tables.

``read_staging_csv`` is the CSV scan (header, every column text, quoted
multi-line fields).  A file is read in splits, by many tasks, although a quoted
field may hold line breaks:

1. A pass over the splits counts quotes, which gives each split's parity; the
   parities of the splits before it tell whether a split begins inside quotes.
2. Each split's lines are joined to records where quotes are open.  What a split
   has of a record that begins or ends elsewhere becomes a fragment.
3. Fragments, at most two a split, are glued in file order; ``from_csv`` reads
   the fields of every record.

``staging_views`` renders the adapter tables as the all-text staging tables the
seed loader would have written (null -> ''), so the cleaning operators run on
whole tables without a CSV round trip.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from feedlake import schemas as S
from feedlake.sources import fixtures as FX


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and split, in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _begins_quoted(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """For each split whether it begins within quotes.  One entry a split: less than the list of splits that the
    driver holds for any scan."""
    odd = lines.groupBy("file", "block").agg((F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return {(r["file"], r["block"]): bool(r["open"] % 2) for r in odd.withColumn("open", F.coalesce(before, F.lit(0))).collect()}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the CSV files at ``path``: file, block and nth (place of the first line), record (text, line
    breaks inside quotes kept).  Blank lines are no records."""
    lines = _lines(spark, path)
    quoted = spark.sparkContext.broadcast(_begins_quoted(lines))

    def join(batches):
        names = ["file", "block", "nth", "record", "opens", "closes"]
        now, part, opens, nth, is_open = None, [], False, 0, False

        def flush(closes):
            nonlocal part, nth, opens
            row = (now[0], now[1], nth, "\n".join(part), opens, closes)
            part, nth, opens = [], nth + 1, False
            return row

        def record(rows):
            cols = list(zip(*rows))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            rows = []
            for file, block, line in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (file, block) != now:
                    if part:
                        rows.append(flush(False))
                    now, nth = (file, block), 0
                    is_open = opens = quoted.value[now]      # opens: the first record began in an earlier split
                part.append(line)
                is_open ^= bool(line.count('"') % 2)
                if not is_open:
                    rows.append(flush(True))
            rows = [r for r in rows if r[4] or not r[5] or r[3].strip("\r")]
            if rows:
                yield record(rows)
        if part:
            yield record([flush(False)])

    found = lines.mapInArrow(join, "file string, block long, nth long, record string, opens boolean, closes boolean")
    whole = found.filter("not opens and closes").select("file", "block", "nth", "record")
    torn = found.filter("opens or not closes")
    # a fragment that opens no earlier record starts one; those up to the next start belong to it
    start = F.last(F.when(~F.col("opens"), F.struct("block", "nth")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "nth"))
    glued = (torn.withColumn("start", start).groupBy("file", "start")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "nth", "record"))), lambda x: x["record"]), "\n").alias("record"))
             .select("file", F.col("start.block").alias("block"), F.col("start.nth").alias("nth"), "record"))
    return whole.unionByName(glued).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read_staging_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Columns go by the header's names, whatever their order; every file has
    the same header."""
    want = S.staging_schema(table)
    options = {"escape": '"', "multiLine": "true"}
    names = spark.read.options(header="true", **options).csv(path).columns
    if set(names) != set(want.names):
        raise ValueError(f"staging CSV of {table}: columns {names}, expected {want.names}")
    records = csv_records(spark, path)
    fields = F.from_csv("record", ", ".join(f"`{n}` string" for n in names), options)
    is_header = (F.col("block") == 0) & (F.col("nth") == 0)
    other = is_header & (F.array(*[F.col("row")[n] for n in names]) != F.array(*[F.lit(n) for n in names]))
    checked = F.when(other, F.raise_error(F.lit(f"staging CSV of {table}: files with different headers"))).otherwise(is_header)
    return records.select("block", "nth", fields.alias("row")).filter(~checked.cast("boolean")).select(*[F.col("row")[n].alias(n) for n in want.names])


def write_staging_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def _text(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def staging_users(spark: SparkSession, base: str) -> DataFrame:
    u = FX.users(spark, base)
    kind = (F.when((F.col("authored_posts_count") > 0) & (F.col("comments_count") > 0), F.lit("both"))
            .when(F.col("authored_posts_count") > 0, F.lit("author")))
    return u.select(
        _text("user_id").alias("user_id"), _text("username").alias("username"),
        _text(kind).alias("user_type"), _text("authored_posts_count").alias("num_posts"),
        _text("comments_count").alias("num_comments"), _text("interest_keywords").alias("interests"),
        _text("joined_on").alias("created_at"))


def staging_posts(spark: SparkSession, base: str) -> DataFrame:
    p = FX.posts(spark, base)
    pages = FX.post_media(spark, base).select("post_id", "source_url", "object_key")
    p = p.join(pages, "post_id", "left")
    return p.select(
        _text("post_id").alias("post_id"), _text("title").alias("title"), _text("author_id").alias("author_id"),
        _text(F.concat(F.lit("author_"), F.col("author_id").cast("string"))).alias("author"),
        _text("canonical_url").alias("url"), _text("body_text").alias("content"),
        _text("excerpt").alias("excerpt"), _text("categories").alias("categories"), _text("tags").alias("tags"),
        _text("published_at_raw").alias("published_at"), _text("comments_count").alias("comments_count"),
        _text("source_url").alias("image_url"), _text("object_key").alias("image_path"))


def staging_comments(spark: SparkSession, base: str) -> DataFrame:
    c = FX.comments(spark, base)
    return c.select(
        _text("comment_id").alias("comment_id"), _text("post_id").alias("post_id"),
        _text("user_id").alias("user_id"),
        _text(F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("username"),
        _text("body_text").alias("comment_text"), _text("commented_at_raw").alias("comment_time"),
        _text("parent_comment_id").alias("parent_comment_id"))


def staging_interactions(spark: SparkSession, base: str) -> DataFrame:
    i = FX.interactions(spark, base)
    return i.select(
        _text("event_id").alias("event_id"), _text("user_id").alias("user_id"), _text("post_id").alias("post_id"),
        _text("interaction_type").alias("event_type"), _text("occurred_at_raw").alias("timestamp"),
        _text("session_id").alias("session_id"), _text("device_type").alias("device"),
        _text("source_surface").alias("source"), _text("dwell_time_seconds").alias("dwell_time"),
        F.lit("").alias("weight"), F.lit("").alias("interest_score"))
