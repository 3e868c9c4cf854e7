"""Adapters: the five core tables of the data model as views over the given
tables (FIXTURES.md §3).  Nothing is copied; every adapter is a projection
(plus small per-key aggregates for counts), so pruning and pushdown still reach
the parquet scans.

The DuckDB twins of these views live in ``feedlake.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.sources.tables import read_table

# --- fixed values of the adapters (chosen here, mirrored in the oracle SQL) --
AUTHOR_MODULUS = 150          # posts.author_id = doc_id % 150
COMMENTER_MODULUS = 150       # comments.user_id = (conv_id * 7 + turn) % 150
DEVICES = ["web", "mobile", "tablet"]                       # by event_id % 3
SURFACES = ["feed", "search", "profile", "recommendation"]  # by event_id % 4
EVENT_TYPE_MAP = {"view": "view", "click": "like", "purchase": "save", "error": "comment"}
# signup -> share when event_id is even, else follow_author
PUBLISHED_NULL_MODULUS = 13   # posts with doc_id % 13 = 0 carry no publish time
COMMENT_TIME_NULL_TURN = 3    # turn 3 of each conversation carries no time
BASE_TIME = "2024-01-01 00:00:00"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
# ---------------------------------------------------------------------------


def _ts(col: str) -> Column:
    # the given tables store wall-clock TIMESTAMP_NTZ; the session is UTC
    return F.col(col).cast("timestamp")


def interactions(spark: SparkSession, base: str) -> DataFrame:
    ev = read_table(spark, base, "events")
    ts = _ts("ts")
    mapped = F.when(F.col("event_type") == "signup",
                    F.when(F.col("event_id") % 2 == 0, F.lit("share")).otherwise(F.lit("follow_author")))
    for src, dst in EVENT_TYPE_MAP.items():
        mapped = mapped.when(F.col("event_type") == src, F.lit(dst))
    return ev.select(
        F.col("event_id"),
        F.col("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("post_id"),
        mapped.alias("interaction_type"),
        F.date_format(ts, ISO_MICROS).alias("occurred_at_raw"),
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format(ts, "yyyy-MM-dd")).alias("session_id"),
        F.element_at(F.array(*[F.lit(d) for d in DEVICES]), (F.col("event_id") % 3 + 1).cast("int"))
        .alias("device_type"),
        F.element_at(F.array(*[F.lit(s) for s in SURFACES]), (F.col("event_id") % 4 + 1).cast("int"))
        .alias("source_surface"),
        F.when(F.col("event_type") == "view", F.floor("value").cast("int")).alias("dwell_time_seconds"),
    )


def comment_counts(spark: SparkSession, base: str) -> DataFrame:
    """Turns per conversation: the comment count a post carries."""
    return (read_table(spark, base, "conversations").groupBy(F.col("conv_id").alias("post_id"))
            .agg(F.count(F.lit(1)).cast("int").alias("n_comments")))


def posts(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents")
    published = F.date_format(
        F.lit(BASE_TIME).cast("timestamp") + F.make_dt_interval(mins=F.col("n_chars").cast("int")),
        "yyyy-MM-dd HH:mm:ss")
    p = docs.select(
        F.col("doc_id").alias("post_id"),
        (F.col("doc_id") % AUTHOR_MODULUS).alias("author_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("/posts/"), F.col("doc_id").cast("string")).alias("canonical_url"),
        F.col("text").alias("body_text"),
        F.lit(None).cast("string").alias("excerpt"),
        F.concat(F.lit('["'), F.col("source"), F.lit('"]')).alias("categories"),
        F.concat(F.lit('["'), F.col("lang"), F.lit('"]')).alias("tags"),
        F.when(F.col("doc_id") % PUBLISHED_NULL_MODULUS != 0, published).alias("published_at_raw"),
    )
    counts = comment_counts(spark, base)
    return (p.join(counts, "post_id", "left")
            .withColumn("comments_count", F.coalesce(F.col("n_comments"), F.lit(0)))
            .drop("n_comments"))


def comments(spark: SparkSession, base: str) -> DataFrame:
    conv = read_table(spark, base, "conversations")
    at = F.date_format(
        F.lit(BASE_TIME).cast("timestamp")
        + F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=(F.col("turn") / 2).cast("int")),
        ISO_SECONDS)
    return conv.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"),
        F.col("conv_id").alias("post_id"),
        ((F.col("conv_id") * 7 + F.col("turn")) % COMMENTER_MODULUS).alias("user_id"),
        F.when(F.col("turn") > 0,
               F.concat_ws("_", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))
        .alias("parent_comment_id"),
        F.col("text").alias("body_text"),
        F.when(F.col("turn") != COMMENT_TIME_NULL_TURN, at).alias("commented_at_raw"),
    )


def post_media(spark: SparkSession, base: str) -> DataFrame:
    pages = read_table(spark, base, "pages")
    return pages.select(
        F.col("page_id").alias("media_id"),
        F.col("page_id").alias("post_id"),
        F.lit("image").alias("media_type"),
        F.col("url").alias("source_url"),
        F.concat(F.lit("images/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("object_key"),
        F.lit("minio").alias("storage_provider"),
        F.lit(1).alias("display_order"),
    )


def users(spark: SparkSession, base: str) -> DataFrame:
    """customer -> users.  joined_on is the first order date; the two counts
    are the authored posts and written comments of the other adapters."""
    cust = read_table(spark, base, "customer")
    first_order = (read_table(spark, base, "orders").groupBy(F.col("o_custkey").alias("user_id"))
                   .agg(F.min("o_orderdate").cast("date").alias("joined_on")))
    authored = (read_table(spark, base, "documents")
                .groupBy((F.col("doc_id") % AUTHOR_MODULUS).alias("user_id"))
                .agg(F.count(F.lit(1)).cast("int").alias("authored_posts_count")))
    written = (read_table(spark, base, "conversations")
               .groupBy(((F.col("conv_id") * 7 + F.col("turn")) % COMMENTER_MODULUS).alias("user_id"))
               .agg(F.count(F.lit(1)).cast("int").alias("comments_count")))
    keywords = (F.when(F.col("c_acctbal") < 0, F.lit(""))
                .when(F.col("c_acctbal") < 100, F.lit("[broken"))
                .otherwise(F.concat(F.lit('["'), F.lower("c_mktsegment"), F.lit('", "nation'),
                                    F.col("c_nationkey").cast("string"), F.lit('"]'))))
    base_users = cust.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("account_type"),
        keywords.alias("interest_keywords"),
    )
    return (base_users.join(first_order, "user_id", "left")
            .join(authored, "user_id", "left")
            .join(written, "user_id", "left")
            .select("user_id", "username", "account_type",
                    F.coalesce("authored_posts_count", F.lit(0)).alias("authored_posts_count"),
                    F.coalesce("comments_count", F.lit(0)).alias("comments_count"),
                    "interest_keywords", "joined_on"))


def vectors(spark: SparkSession, base: str) -> DataFrame:
    emb = read_table(spark, base, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("text_embedding"),
                      F.col("label"))
