"""Staging -> core tables (P1-P4) and data-quality checks.

Cleaning is pure projection + filter (no shuffle).  The checks aggregate the
referencing side to distinct keys *before* the anti join, so a key that holds
a third of all rows costs one map-side combined group, not a skewed join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import schemas as S
from feedlake.functions.text import blank_to_null, int_or_default


def _present(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, [blank_to_null(c).isNotNull() for c in cols])


# P1 + P2 ----------------------------------------------------------------------
USER_KEYS = ["user_id", "username"]
POST_KEYS = ["post_id", "author_id"]
COMMENT_KEYS = ["comment_id", "post_id", "user_id"]
INTERACTION_KEYS = ["event_id", "user_id", "post_id", "event_type"]
USER_NUMBERS = ("num_posts", "num_comments")
POST_NUMBERS = ("comments_count",)
INTERACTION_NUMBERS = ("dwell_time",)


def clean_users(staging: DataFrame) -> DataFrame:
    return staging.filter(_present(*USER_KEYS) & _whole_numbers(*USER_NUMBERS)).select(
        "user_id", "username",
        F.coalesce(blank_to_null("user_type"), F.lit(S.DEFAULT_ACCOUNT_TYPE)).alias("account_type"),
        int_or_default("num_posts").alias("authored_posts_count"),
        int_or_default("num_comments").alias("comments_count"),
        blank_to_null("interests").alias("interest_keywords"),
        blank_to_null("created_at").try_cast("date").alias("joined_on"),
    )


def clean_posts(staging: DataFrame) -> DataFrame:
    return staging.filter(_present(*POST_KEYS) & _whole_numbers(*POST_NUMBERS)).select(
        "post_id", "author_id",
        F.coalesce(blank_to_null("title"), F.lit(S.DEFAULT_POST_TITLE)).alias("title"),
        blank_to_null("url").alias("canonical_url"),
        blank_to_null("content").alias("body_text"),
        blank_to_null("excerpt").alias("excerpt"),
        blank_to_null("categories").alias("categories"),
        blank_to_null("tags").alias("tags"),
        blank_to_null("published_at").alias("published_at_raw"),
        int_or_default("comments_count").alias("comments_count"),
    )


def media_surrogate_key(post_id, object_key) -> Column:
    """The full md5 of the natural key (post_id, object_key) as text, the
    first part with its length before it so that two keys never read the
    same; computed per row, so no global ordering or single-task numbering."""
    return F.md5(F.concat(F.length(post_id).cast("string"), F.lit(":"), F.col(post_id), F.col(object_key)))


def derive_post_media(staging_posts: DataFrame) -> DataFrame:
    """One image row for each post that has an image path."""
    return staging_posts.filter(_present("post_id", "image_path")).select(
        media_surrogate_key("post_id", "image_path").alias("media_id"),
        "post_id",
        F.lit(S.MEDIA_TYPE).alias("media_type"),
        blank_to_null("image_url").alias("source_url"),
        blank_to_null("image_path").alias("object_key"),
        F.lit(S.STORAGE_PROVIDER).alias("storage_provider"),
        F.lit(1).alias("display_order"),
    )


def clean_comments(staging: DataFrame) -> DataFrame:
    return staging.filter(_present(*COMMENT_KEYS)).select(
        "comment_id", "post_id", "user_id",
        blank_to_null("parent_comment_id").alias("parent_comment_id"),
        blank_to_null("comment_text").alias("body_text"),
        blank_to_null("comment_time").alias("commented_at_raw"),
    )


def clean_interactions(staging: DataFrame) -> DataFrame:
    return staging.filter(_present(*INTERACTION_KEYS) & _whole_numbers(*INTERACTION_NUMBERS)).select(
        "event_id", "user_id", "post_id",
        F.col("event_type").alias("interaction_type"),
        blank_to_null("timestamp").alias("occurred_at_raw"),
        blank_to_null("session_id").alias("session_id"),
        blank_to_null("device").alias("device_type"),
        blank_to_null("source").alias("source_surface"),
        blank_to_null("dwell_time").try_cast("int").alias("dwell_time_seconds"),
    )


def _whole_numbers(*cols: str) -> Column:
    """True where each text is blank or a whole number."""
    return reduce(lambda a, b: a & b, [blank_to_null(c).isNull() | F.col(c).try_cast("int").isNotNull() for c in cols])


def rejects(staging: DataFrame, required: list[str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """P2 side output: staging rows a cleaner drops, for a missing key or for
    text in a number column (``USER_NUMBERS``, ``POST_NUMBERS``,
    ``INTERACTION_NUMBERS``)."""
    ok = _present(*required)
    return staging.filter(~(ok & _whole_numbers(*numbers) if numbers else ok))


# P5 / J10 ---------------------------------------------------------------------
_REPORT = ["check", "table_name", "key", "n_rows"]


def _report(df: DataFrame, check: str, table: str, key: Column, n: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(table).alias("table_name"),
                     key.cast("string").alias("key"), n.cast("long").alias("n_rows"))


def duplicate_keys(df: DataFrame, table: str, cols: list[str], check: str | None = None,
                   where: Column | None = None) -> DataFrame:
    """PK / UNIQUE / partial-unique: keys that occur more than once."""
    src = df.filter(where) if where is not None else df
    dup = src.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _report(dup, check or f"unique({','.join(cols)})", table, _key_text(cols), F.col("n"))


def missing_parents(child: DataFrame, fk: str, parent: DataFrame, pk: str, child_table: str,
                    parent_table: str) -> DataFrame:
    """FK exists: referencing keys absent from the parent (nulls are allowed)."""
    refs = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(pk).alias("_k")).distinct()
    bad = refs.join(keys, "_k", "left_anti")
    return _report(bad, f"fk({fk}->{parent_table}.{pk})", child_table, F.col("_k"), F.col("n"))


def not_in_set(df: DataFrame, table: str, col: str, allowed: list[str]) -> DataFrame:
    bad = (df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*allowed))
           .groupBy(col).agg(F.count(F.lit(1)).alias("n")))
    return _report(bad, f"check({col})", table, F.col(col), F.col("n"))


def null_required(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    """NOT NULL: one pass counts the nulls of every column, then unpivots."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n"))
                                              for c in cols])).alias("x")).select("x.c", "x.n")
    return _report(long.filter(F.col("n") > 0), "not_null", table, F.col("c"), F.col("n"))


def _key_text(cols: list[str]) -> Column:
    """How a report shows a key."""
    return F.col(cols[0]).cast("string") if len(cols) == 1 else F.concat_ws("|", *cols)


def _key_id(cols: list[str]) -> Column:
    """What keys are compared by: the parts as a JSON list, so that neither a
    separator inside a part nor a null part makes two keys alike."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))


def _tagged_keys(df: DataFrame, table: str, specs: list[tuple]) -> DataFrame:
    """One row per (check, key) a table row contributes; a spec is
    (check, key columns[, condition])."""
    items = []
    for spec in specs:
        check, cols = spec[0], spec[1]
        item = F.struct(F.lit(check).alias("check"), _key_id(cols).alias("kid"), _key_text(cols).alias("key"))
        items.append(F.when(spec[2], item) if len(spec) > 2 else item)
    return (df.select(F.explode(F.array(*items)).alias("x")).filter(F.col("x").isNotNull())
            .select("x.check", F.lit(table).alias("table_name"), "x.kid", "x.key"))


def _all_there(*cols: str) -> Column:
    """A unique constraint leaves keys with a null part alone."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def quality_report(users: DataFrame, posts: DataFrame, post_media: DataFrame, comments: DataFrame,
                   interactions: DataFrame) -> DataFrame:
    """Every constraint of the core schema as one violations table.

    All uniqueness checks are one grouped count over (check, table, key)
    rows; all foreign-key checks are one anti join of the referencing keys
    (counted first, so a hot key is one combined row) against the parents'
    keys on (check, key).  Each table is read once per kind of check."""
    like = F.col("interaction_type") == "like"
    unique = [
        _tagged_keys(users, "users", [("primary_key", ["user_id"]), ("unique(username)", ["username"], _all_there("username"))]),
        _tagged_keys(posts, "posts", [("primary_key", ["post_id"])]),
        _tagged_keys(post_media, "post_media", [("primary_key", ["media_id"]),
                                                ("unique(post_id,object_key)", ["post_id", "object_key"],
                                                 _all_there("post_id", "object_key"))]),
        _tagged_keys(comments, "comments", [("primary_key", ["comment_id"])]),
        _tagged_keys(interactions, "interactions", [
            ("primary_key", ["event_id"]),
            ("unique_like", ["user_id", "post_id", "interaction_type"],
             like & _all_there("user_id", "post_id"))]),
    ]
    dup = (reduce(DataFrame.unionByName, unique).groupBy("check", "table_name", "kid", "key")
           .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))

    def fk(child_col: str, parent_table: str, parent_col: str) -> str:
        return f"fk({child_col}->{parent_table}.{parent_col})"

    def refs(df, table, cols_parents):
        specs = [(fk(c, pt, pc), [c], F.col(c).isNotNull()) for c, pt, pc in cols_parents]
        return _tagged_keys(df, table, specs)

    child_refs = reduce(DataFrame.unionByName, [
        refs(posts, "posts", [("author_id", "users", "user_id")]),
        refs(post_media, "post_media", [("post_id", "posts", "post_id")]),
        refs(comments, "comments", [("post_id", "posts", "post_id"), ("user_id", "users", "user_id")]),
        refs(interactions, "interactions", [("user_id", "users", "user_id"), ("post_id", "posts", "post_id")]),
    ]).groupBy("check", "table_name", "key").agg(F.count(F.lit(1)).alias("n"))     # one-column keys
    user_keys = users.select(_key_text(["user_id"]).alias("key")).filter(F.col("key").isNotNull())
    post_keys = posts.select(_key_text(["post_id"]).alias("key")).filter(F.col("key").isNotNull())
    parent_keys = reduce(DataFrame.unionByName, [
        user_keys.withColumn("check", F.lit(fk(c, "users", "user_id"))) for c in ("author_id", "user_id")
    ] + [post_keys.withColumn("check", F.lit(fk("post_id", "posts", "post_id")))]).distinct()
    missing = child_refs.join(parent_keys, ["check", "key"], "left_anti")

    out = [dup.select("check", "table_name", F.col("key").cast("string").alias("key"), F.col("n").cast("long")
                      .alias("n_rows")),
           missing.select("check", "table_name", F.col("key").cast("string").alias("key"),
                          F.col("n").cast("long").alias("n_rows")),
           not_in_set(interactions, "interactions", "interaction_type", S.INTERACTION_TYPES),
           null_required(users, "users", ["user_id", "username"]),
           null_required(posts, "posts", ["post_id", "author_id", "title"]),
           null_required(comments, "comments", ["comment_id", "post_id", "user_id"]),
           null_required(interactions, "interactions", ["event_id", "user_id", "post_id", "interaction_type"])]
    return reduce(DataFrame.unionByName, out)


def cascade_prune(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """ON DELETE CASCADE as a batch rule: keep children whose parent exists."""
    return child.join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_semi")
