"""User dimension and interest profiles.

All of these are keyed aggregates over exploded (post, tag) or
(user, word) rows.  Signals are pre-aggregated per (user_id, post_id) before
the tag join, so the join input is bounded by distinct pairs, not raw events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake import schemas as S
from feedlake.functions import text as X


# A7 / U2 ----------------------------------------------------------------------
def user_dimension(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Every author or commenter with post count, comment count and type."""
    authored = posts.groupBy(F.col("author_id").alias("user_id")).agg(F.count(F.lit(1)).alias("num_posts"))
    written = comments.groupBy("user_id").agg(F.count(F.lit(1)).alias("num_comments"))
    both = authored.join(written, "user_id", "full_outer").filter(F.col("user_id").isNotNull())
    posts_n = F.coalesce(F.col("num_posts"), F.lit(0))
    comments_n = F.coalesce(F.col("num_comments"), F.lit(0))
    kind = (F.when((posts_n > 0) & (comments_n > 0), F.lit("both"))
            .when(posts_n > 0, F.lit("author")).otherwise(F.lit("commenter")))
    return both.select("user_id", posts_n.alias("num_posts"), comments_n.alias("num_comments"),
                       kind.alias("user_type"))


def all_people(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Distinct union of authors and commenters."""
    return (posts.select(F.col("author_id").alias("user_id"))
            .union(comments.select("user_id")).distinct())


# F6 -------------------------------------------------------------------------
def post_tags(posts: DataFrame) -> DataFrame:
    """(post_id, tag) for the set of words of tags + ' ' + categories."""
    text = F.concat_ws(" ", F.coalesce(F.col("tags"), F.lit("")), F.coalesce(F.col("categories"), F.lit("")))
    return posts.select("post_id", F.explode(X.parse_tags(text)).alias("tag"))


# A8 -------------------------------------------------------------------------
def interest_signals(comments: DataFrame, interactions: DataFrame | None = None) -> DataFrame:
    """(user_id, post_id, weight): every comment counts 5; likes 2, saves 3,
    shares 4 and comment interactions 5.  Pre-aggregated per pair."""
    sig = comments.select("user_id", "post_id", F.lit(S.INTEREST_WEIGHTS["comment"]).alias("w"))
    if interactions is not None:
        w = None
        for kind, weight in S.INTEREST_WEIGHTS.items():
            cond = F.col("interaction_type") == kind
            w = F.when(cond, F.lit(weight)) if w is None else w.when(cond, F.lit(weight))
        sig = sig.unionByName(interactions.select("user_id", "post_id", w.alias("w"))
                              .filter(F.col("w").isNotNull()))
    return sig.groupBy("user_id", "post_id").agg(F.sum("w").alias("w"))


def interest_profile(posts: DataFrame, comments: DataFrame, interactions: DataFrame | None = None) -> DataFrame:
    """(user_id, tag, score)."""
    sig = interest_signals(comments, interactions)
    return (sig.join(post_tags(posts), "post_id", "inner")
            .groupBy("user_id", "tag").agg(F.sum("w").alias("score")))


# A9 + A11 ---------------------------------------------------------------------
def interest_match(pairs: DataFrame, profile: DataFrame, posts: DataFrame) -> DataFrame:
    """min(Σ profile[tag of post] / max(Σ profile, 1), 1); 0 when the profile
    or the post's tags are empty.  Plus the post's popularity."""
    pairs = pairs.select("user_id", "post_id").distinct()
    tags = post_tags(posts)
    hits = (pairs.join(tags, "post_id", "inner")
            .join(profile, ["user_id", "tag"], "inner")
            .groupBy("user_id", "post_id").agg(F.sum("score").alias("hit")))
    totals = profile.groupBy("user_id").agg(F.sum("score").alias("total"))
    score = F.coalesce(F.least(F.col("hit") / F.greatest(F.col("total"), F.lit(1)), F.lit(1.0)), F.lit(0.0))
    popularity = posts.select("post_id", post_popularity("comments_count").alias("post_popularity"))
    return (pairs.join(hits, ["user_id", "post_id"], "left").join(totals, "user_id", "left")
            .join(popularity, "post_id", "left")
            .select("user_id", "post_id", score.alias("interest_score"), "post_popularity"))


def post_popularity(comments_count) -> F.Column:
    c = F.col(comments_count) if isinstance(comments_count, str) else comments_count
    return F.least(c / F.lit(float(S.POPULARITY_COMMENTS)), F.lit(1.0))


# A10 / J9 ---------------------------------------------------------------------
def interest_keywords(posts: DataFrame, comments: DataFrame, people: DataFrame | None = None,
                      limit: int = S.INTEREST_WORD_LIMIT) -> DataFrame:
    """First `limit` distinct interest words per user, in the order: authored
    tags, authored categories, commented tags, commented categories (posts
    by post_id, words by position).  Output text is a JSON list."""
    commented = comments.select("user_id", "post_id").distinct()   # J9: posts the user commented on
    p = posts.select("post_id", "author_id", "tags", "categories")
    authored = p.select(F.col("author_id").alias("user_id"), "post_id", "tags", "categories",
                        F.lit(0).alias("base"))
    on_commented = commented.join(p.drop("author_id"), "post_id", "inner").withColumn("base", F.lit(2))
    segs = authored.unionByName(on_commented)
    texts = segs.select("user_id", "post_id", F.explode(F.array(
        F.struct((F.col("base")).alias("seg"), F.col("tags").alias("txt")),
        F.struct((F.col("base") + 1).alias("seg"), F.col("categories").alias("txt")))).alias("s"))
    words = texts.select("user_id", "post_id", F.col("s.seg").alias("seg"),
                         F.posexplode(X.interest_words(F.col("s.txt"))).alias("pos", "word"))
    first = words.groupBy("user_id", "word").agg(F.min(F.struct("seg", "post_id", "pos")).alias("at"))
    w = Window.partitionBy("user_id").orderBy("at")
    top = first.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    lists = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rn", "word"))).alias("l"))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.col("l"), lambda x: F.concat(
        F.lit('"'), x.getField("word"), F.lit('"'))), ", "), F.lit("]"))
    people = people if people is not None else all_people(posts, comments)
    return people.join(lists.select("user_id", text.alias("interests")), "user_id", "left").select(
        "user_id", F.coalesce(F.col("interests"), F.lit("[]")).alias("interests"))


# A12 ------------------------------------------------------------------------
def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table, one row per table (one aggregate per table,
    no data moved to the driver)."""
    from functools import reduce

    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
