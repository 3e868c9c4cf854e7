"""Feed reads.

Feed page plan: rank posts on their narrow columns (id, author, time) and keep
the first ``offset + limit`` (TakeOrdered: per-partition top-k, then a merge of
at most k rows per partition).  Only then are bodies, authors, media, comment
counts and likes joined — each big table is semi-joined against the page's post
ids.  The ids are broadcast up to ``MAX_BROADCAST_IDS`` (so the big scans never
shuffle) and left to AQE's measured size beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake import schemas as S


MAX_BROADCAST_IDS = 10_000
#: users whose ids and names go to every task: some 100 bytes each
MAX_BROADCAST_USERS = 250_000


def clamp_limit(limit: int | None) -> int:
    if limit is None:
        return S.FEED_DEFAULT_LIMIT
    return max(1, min(int(limit), S.FEED_MAX_LIMIT))


def _feed_order() -> list[Column]:
    return [F.col("published_at_raw").desc_nulls_last(), F.col("post_id").desc()]


def _blank(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


# A6 -------------------------------------------------------------------------
def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("post_id").agg(F.count(F.lit(1)).alias("comment_count"))


def like_counts(interactions: DataFrame) -> DataFrame:
    return (interactions.filter(F.col("interaction_type") == "like")
            .groupBy("post_id").agg(F.count(F.lit(1)).alias("like_count")))


# J7 -------------------------------------------------------------------------
def viewer_likes(interactions: DataFrame, viewer_id) -> DataFrame:
    """Distinct posts the viewer liked (the EXISTS of the reference)."""
    return (interactions.filter((F.col("interaction_type") == "like") & (F.col("user_id") == F.lit(viewer_id)))
            .select("post_id").distinct().withColumn("viewer_has_liked", F.lit(True)))


# L1 -------------------------------------------------------------------------
def feed_page(posts: DataFrame, users: DataFrame, post_media: DataFrame, comments: DataFrame,
              interactions: DataFrame, offset: int = 0, limit: int | None = None,
              viewer_id=None) -> DataFrame:
    limit = clamp_limit(limit)
    offset = max(0, int(offset))
    authors = users.select(F.col("user_id").alias("author_id"), F.col("username").alias("author_username"))
    # J4 filters posts without an author; J5 may add a row per extra first image,
    # so the first offset+limit rows of the result come from the first
    # offset+limit posts.
    narrow = posts.select("post_id", "author_id", "published_at_raw").join(authors, "author_id", "inner")
    # at most offset + limit rows; materialized once (reliable checkpoint) so
    # the posts table is ranked once, not once per branch below
    head = narrow.orderBy(*_feed_order()).limit(offset + limit).checkpoint(eager=True)
    ids = head.select("post_id").distinct()
    if offset + limit <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)

    def on_page(df: DataFrame) -> DataFrame:
        return df.join(ids, "post_id", "left_semi")

    media = on_page(post_media.filter(F.col("display_order") == 1)).select("post_id", "object_key")
    wide = on_page(posts.drop("author_id", "published_at_raw"))
    mine = F.lit(False) if viewer_id is None else F.coalesce(F.col("user_id") == F.lit(viewer_id), F.lit(False))
    likes = (on_page(interactions.filter(F.col("interaction_type") == "like")).groupBy("post_id")
             .agg(F.count(F.lit(1)).alias("like_count"), F.max(mine).alias("viewer_has_liked")))
    out = (head.join(wide, "post_id").join(media, "post_id", "left")
           .join(comment_counts(on_page(comments)), "post_id", "left").join(likes, "post_id", "left")
           .withColumn("viewer_has_liked", F.coalesce(F.col("viewer_has_liked"), F.lit(False))))
    page = out.orderBy(*_feed_order()).offset(offset).limit(limit)
    n = F.count(F.lit(1)).over(Window.partitionBy())  # the page: at most `limit` rows
    return page.select(
        "post_id", "title",
        _blank("body_text").alias("body_text"), _blank("excerpt").alias("excerpt"),
        _blank("tags").alias("tags"), _blank("categories").alias("categories"),
        _blank("published_at_raw").alias("published_at"), _blank("canonical_url").alias("canonical_url"),
        "author_id", "author_username",
        F.when(F.col("object_key").isNotNull() & (F.col("object_key") != ""),
               F.concat(F.lit("/media/"), F.col("object_key"))).otherwise(F.lit("")).alias("image_url"),
        F.coalesce(F.col("comment_count"), F.lit(0)).alias("comment_count"),
        F.coalesce(F.col("like_count"), F.lit(0)).alias("like_count"),
        "viewer_has_liked",
        (F.lit(offset) + n).alias("next_offset"),
        (n == F.lit(limit)).alias("has_more"),
    )


# W5 / J8 / L2 -------------------------------------------------------------------
def newest_comments(comments: DataFrame, users: DataFrame, per_post: int,
                    post_ids: DataFrame | None = None) -> DataFrame:
    """Newest `per_post` comments of each post (time desc nulls last, then
    comment_id desc; comment_id is the primary key), with the commenter's name;
    only comments of known users count.

    The users are counted first.  Up to ``MAX_BROADCAST_USERS`` their ids and
    names go to every task: comments then meet them where they are read, and
    `row_number() <= n` plans a partial WindowGroupLimit before the only
    shuffle, so a post with a huge thread ships at most n rows, bodies
    included, per task.  With more users the ranking runs on narrow columns
    and bodies are fetched for the survivors."""
    # a caller-supplied id list has no size bound here: AQE decides whether
    # to broadcast it at runtime (feed_with_comments passes its bounded page)
    c = comments if post_ids is None else comments.join(post_ids.select("post_id"), "post_id", "left_semi")
    w = Window.partitionBy("post_id").orderBy(F.col("commented_at_raw").desc_nulls_last(),
                                              F.col("comment_id").desc())
    out = ["post_id", "comment_id", "user_id", "username", _blank("body_text").alias("body_text"),
           _blank("commented_at_raw").alias("commented_at"), "rank"]
    names = users.select("user_id", "username")
    if names.limit(MAX_BROADCAST_USERS + 1).count() <= MAX_BROADCAST_USERS:
        rows = c.select("post_id", "comment_id", "user_id", "body_text", "commented_at_raw")
        known = rows.join(F.broadcast(names.select("user_id").distinct()), "user_id", "left_semi")
        top = known.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_post)
        return top.join(F.broadcast(names), "user_id").select(*out)
    keys = c.select("post_id", "comment_id", "user_id", "commented_at_raw")
    known = keys.join(names.select("user_id").distinct(), "user_id", "left_semi")
    top = known.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_post).drop("commented_at_raw")
    bodies = c.select("post_id", "comment_id", "user_id", "body_text", "commented_at_raw")
    return top.join(bodies, ["post_id", "comment_id", "user_id"]).join(names, "user_id").select(*out)


def top_comments(comments: DataFrame, users: DataFrame, post_ids: DataFrame | None = None,
                 limit_per_post: int = S.FEED_COMMENTS_PER_POST) -> DataFrame:
    return newest_comments(comments, users, limit_per_post, post_ids)


def post_comments(comments: DataFrame, users: DataFrame, post_id=None,
                  limit: int = S.POST_COMMENTS_LIMIT) -> DataFrame:
    """L2: the newest 50 comments of one post, or of every post when
    `post_id` is None."""
    c = comments if post_id is None else comments.filter(F.col("post_id") == F.lit(post_id))
    return newest_comments(c, users, limit)


def feed_with_comments(page: DataFrame, comments: DataFrame, users: DataFrame,
                       limit_per_post: int = S.FEED_COMMENTS_PER_POST) -> DataFrame:
    """The API shape: each page row with its newest comments as an array
    (at most `limit_per_post` per post, so the collect is bounded)."""
    ids = F.broadcast(page.select("post_id"))  # the page: at most FEED_MAX_LIMIT rows
    tc = top_comments(comments, users, ids, limit_per_post)
    nested = tc.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "comment_id", "user_id", "username", "body_text", "commented_at"))).alias("comments"))
    return page.join(nested, "post_id", "left").withColumn(
        "comments", F.coalesce(F.col("comments"), F.array().cast(nested.schema["comments"].dataType)))
