"""Declared schemas, key maps and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference for equal results) -------------
# interaction vocabulary of the core `interactions` table
INTERACTION_TYPES = ["view", "like", "save", "share", "comment", "follow_author"]
# engagement label per interaction type; a view counts 1.0 only with dwell >= 30 s
LABEL_WEIGHTS = {"like": 2.0, "comment": 3.0, "save": 4.0, "share": 5.0, "follow_author": 5.0}
VIEW_LABEL = 1.0
VIEW_DWELL_THRESHOLD = 30
# tenure is measured up to this date
TENURE_REFERENCE_DATE = "2026-05-18"
# interest-profile weight per signal
INTEREST_WEIGHTS = {"comment": 5, "like": 2, "save": 3, "share": 4}
# tokenizer for interest words
INTEREST_WORD_PATTERN = r"[a-zA-Z0-9_+#.-]{3,}"
INTEREST_WORD_LIMIT = 10
# post popularity saturates at this many comments
POPULARITY_COMMENTS = 50
# text cut for the post embedding text
POST_TEXT_CHARS = 512
# zero image vector width
IMAGE_VECTOR_DIM = 512
# recent-views list cap and read window (LRANGE 0 10)
RECENT_VIEWS_LIMIT = 100
RECENT_VIEWS_READ = 11
TRENDING_READ = 11
# feed paging
FEED_DEFAULT_LIMIT = 10
FEED_MAX_LIMIT = 20
FEED_COMMENTS_PER_POST = 3
POST_COMMENTS_LIMIT = 50
# display tags: split pattern, minimum length (exclusive), cap per field and total
TAG_SPLIT_PATTERN = r"[,|\s]+"
TAG_MIN_LENGTH = 2
TAG_CAP = 8
# staging defaults
DEFAULT_ACCOUNT_TYPE = "commenter"
DEFAULT_POST_TITLE = "(untitled post)"
MEDIA_TYPE = "image"
STORAGE_PROVIDER = "minio"
# accepted image extensions, default extension
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]
DEFAULT_IMAGE_EXTENSION = "jpg"
# ---------------------------------------------------------------------------

CORE_TABLES = ["users", "posts", "post_media", "comments", "interactions"]

# Primary keys per core table (explicit: the hint list in the reference names a
# non-existent `interaction_id`; the key of interactions is `event_id`).
TABLE_KEYS = {
    "users": ["user_id"],
    "posts": ["post_id"],
    "comments": ["comment_id"],
    "interactions": ["event_id"],
    "post_media": ["media_id"],
    "orders": ["o_orderkey"],
}

# Metadata columns added by CDC normalization; dropped again before features.
METADATA_COLUMNS = [
    "op", "event_ts", "event_ts_ms", "source_ts_ms", "schema_name",
    "table_name", "topic_name", "object_date", "object_hour",
    "_object_name", "is_delete",
]

# --- gold schema: fixed values, the scalar columns each side of a training pair carries
GOLD_USER_COLUMNS = [
    "user_id", "account_type", "tenure_days", "authored_posts_count", "comments_count",
    "total_interactions", "num_views", "num_likes", "num_comments_interaction", "num_saves",
    "num_shares", "num_follows", "avg_dwell_time", "num_unique_posts", "num_sessions",
    "preferred_device", "preferred_surface",
]
GOLD_POST_COLUMNS = [
    "post_id", "author_id", "body_word_count", "comments_count", "total_interactions", "num_views",
    "num_likes", "avg_dwell_time", "num_unique_users", "like_rate", "comment_rate", "has_image",
]

# --- staging tables: every column is text ----------------------------------
STAGING_COLUMNS = {
    "users": ["user_id", "username", "user_type", "num_posts", "num_comments", "interests", "created_at"],
    "posts": ["post_id", "title", "author_id", "author", "url", "content", "excerpt", "categories", "tags",
              "published_at", "comments_count", "image_url", "image_path"],
    "comments": ["comment_id", "post_id", "user_id", "username", "comment_text", "comment_time",
                 "parent_comment_id"],
    "interactions": ["event_id", "user_id", "post_id", "event_type", "timestamp", "session_id", "device",
                     "source", "dwell_time", "weight", "interest_score"],
}


def staging_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in STAGING_COLUMNS[table]])


# --- change-event envelope --------------------------------------------------
SOURCE_STRUCT = T.StructType([
    T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
])


def envelope_schema(row_schema: T.StructType) -> T.StructType:
    """Typed envelope for batch reads of bronze JSON lines."""
    return T.StructType([
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("before", row_schema),
        T.StructField("after", row_schema),
        T.StructField("source", SOURCE_STRUCT),
    ])


# Raw landed record: 17 flat fields (before/after kept as JSON text).
RAW_RECORD_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("kafka_timestamp", T.LongType()),
    T.StructField("ingested_at", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("event_ts_ms", T.LongType()),
    T.StructField("event_ts_us", T.LongType()),
    T.StructField("event_ts_ns", T.LongType()),
    T.StructField("source_ts_ms", T.LongType()),
    T.StructField("snapshot", T.StringType()),
    T.StructField("tx_id", T.LongType()),
    T.StructField("lsn", T.LongType()),
    T.StructField("before", T.StringType()),
    T.StructField("after", T.StringType()),
])

# Order rows carried by the orders change events (all fields text-safe types).
ORDER_ROW_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.StringType()),
    T.StructField("o_orderpriority", T.StringType()),
])
