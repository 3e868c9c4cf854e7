"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (through the adapter views) over whole
tables; results are returned lazily.  Array-valued operator outputs are shown
joined to text here so the DuckDB check can hash them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import schemas as S
from feedlake.functions import text as X
from feedlake.operators import cdc as CDC
from feedlake.operators import comments as CM
from feedlake.operators import features as FE
from feedlake.operators import feed as FD
from feedlake.operators import profile as PR
from feedlake.operators import staging as ST
from feedlake.operators import vectors as VE
from feedlake.plans.jobs import gold_pairs, write_dataframe
from feedlake.session import apply_defaults, scratch_path
from feedlake.sources import bronze as BR
from feedlake.sources import changefeed as CF
from feedlake.sources import fixtures as FX
from feedlake.sources import raw_posts as RP
from feedlake.sources import staging as SS
from feedlake.streaming import envelope as EN
from feedlake.streaming import landing as LD
from feedlake.streaming.silver import SilverStream
from feedlake.streaming.speed import SpeedLayer, text_values

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run
    return deco


# --- gold features -------------------------------------------------------------
@register("user_engagement")
def q_user_engagement(spark, d):
    """A1 (+ distinct sessions)."""
    inter = FX.interactions(spark, d)
    eng = FE.user_engagement(FE.interaction_grain(inter))
    sessions = FE.user_dimensions(inter).select("user_id", "num_sessions")
    return eng.join(sessions, "user_id", "left")


@register("post_engagement")
def q_post_engagement(spark, d):
    """A2 + A3."""
    return FE.post_engagement(FE.interaction_grain(FX.interactions(spark, d)))


@register("preferred_device")
def q_preferred_device(spark, d):
    """A4 / W4 on device_type."""
    return FE.mode_of(FX.interactions(spark, d), "user_id", "device_type", "preferred_device")


@register("preferred_surface")
def q_preferred_surface(spark, d):
    """A4 / W4 on source_surface."""
    return FE.mode_of(FX.interactions(spark, d), "user_id", "source_surface", "preferred_surface")


@register("user_features")
def q_user_features(spark, d):
    """J1, F3, F5, F9, P10."""
    uf = FE.user_features(FX.users(spark, d), FX.interactions(spark, d))
    return uf.withColumn("interest_kw_list", F.array_join("interest_kw_list", "|"))


@register("post_features")
def q_post_features(spark, d):
    """W3, F4, F8, P11 (+ A2/A3 joined)."""
    pf = FE.post_features(FX.posts(spark, d), FX.interactions(spark, d), FX.post_media(spark, d))
    for c in ("categories_list", "tags_list"):
        pf = pf.withColumn(c, F.array_join(c, "|"))
    return pf


@register("interaction_labels")
def q_interaction_labels(spark, d):
    """F10-F12, W2, A5, J2."""
    return FE.interaction_labels(FX.interactions(spark, d))


@register("training_pairs")
def q_training_pairs(spark, d):
    """J3 + P9: the flagship gold table.  The interaction grain is written
    once (a table in the shared checkpoint dir) and read by the
    user, post and label builders."""
    inter = FX.interactions(spark, d)
    path = scratch_path(spark, "gold")
    write_dataframe(FE.interaction_grain(inter), f"{path}/grain")
    grain = spark.read.parquet(f"{path}/grain")
    return gold_pairs(spark, FX.users(spark, d), FX.posts(spark, d), inter, FX.post_media(spark, d), grain, path)


# --- staging and data quality ----------------------------------------------------


@register("staging_clean_users")
def q_staging_clean_users(spark, d):
    """P1, P2 on the all-text users staging table."""
    return ST.clean_users(SS.staging_users(spark, d))


@register("staging_clean_posts")
def q_staging_clean_posts(spark, d):
    """P1, P2 on the all-text posts staging table."""
    return ST.clean_posts(SS.staging_posts(spark, d))


@register("staging_clean_comments")
def q_staging_clean_comments(spark, d):
    """P1, P2 on the all-text comments staging table."""
    return ST.clean_comments(SS.staging_comments(spark, d))


@register("staging_clean_interactions")
def q_staging_clean_interactions(spark, d):
    """P1, P2 on the all-text interactions staging table."""
    return ST.clean_interactions(SS.staging_interactions(spark, d))


@register("staging_csv")
def q_staging_csv(spark, d):
    """The posts staging table through CSV files, whose quoted bodies hold line breaks, read in splits."""
    path = scratch_path(spark, "staging-csv")
    SS.write_staging_csv(SS.staging_posts(spark, d), path)
    rows = SS.read_staging_csv(spark, path, "posts")
    return rows.select("post_id", "title", "author_id", "content", "categories", "published_at", "comments_count", "image_url")


@register("partition_rewrite")
def q_partition_rewrite(spark, d):
    """Interactions written by day, one day written again with other rows; read back."""
    path = scratch_path(spark, "by-day")
    rows = FX.interactions(spark, d).select("event_id", "user_id", "post_id", F.substring("occurred_at_raw", 1, 10).alias("day"), F.lit(1).alias("version"))
    write_dataframe(rows, path, "partitions", ["day"])
    again = rows.filter((F.col("day") == REWRITTEN_DAY) & (F.col("event_id") % 2 == 0)).withColumn("version", F.lit(2))
    write_dataframe(again, path, "partitions", ["day"])
    return spark.read.schema("event_id long, user_id long, post_id long, version int, day string").parquet(path)


@register("staging_post_media")
def q_staging_post_media(spark, d):
    """Image rows derived from staged posts, with surrogate keys."""
    return ST.derive_post_media(SS.staging_posts(spark, d))


@register("staging_rejects")
def q_staging_rejects(spark, d):
    """Every staged row a cleaner drops, by table."""
    out = None
    for name, staged, keys, numbers, key in (
            ("users", SS.staging_users, ST.USER_KEYS, ST.USER_NUMBERS, "user_id"),
            ("posts", SS.staging_posts, ST.POST_KEYS, ST.POST_NUMBERS, "post_id"),
            ("comments", SS.staging_comments, ST.COMMENT_KEYS, (), "comment_id"),
            ("interactions", SS.staging_interactions, ST.INTERACTION_KEYS, ST.INTERACTION_NUMBERS, "event_id")):
        rows = ST.rejects(staged(spark, d), keys, numbers).select(F.lit(name).alias("table_name"), X.blank_to_null(key).alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("cascade_prune")
def q_cascade_prune(spark, d):
    """Comments whose post and user exist."""
    kept = ST.cascade_prune(FX.comments(spark, d), "post_id", FX.posts(spark, d), "post_id")
    return ST.cascade_prune(kept, "user_id", FX.users(spark, d), "user_id").select("comment_id", "post_id", "user_id")


@register("dq_violations")
def q_dq_violations(spark, d):
    """Every constraint violation of the core tables."""
    return ST.quality_report(FX.users(spark, d), FX.posts(spark, d), FX.post_media(spark, d),
                             FX.comments(spark, d), FX.interactions(spark, d))


# --- CDC -------------------------------------------------------------------------

REWRITTEN_DAY = "2024-01-10"

CDC_META = ["op", "event_ts", "event_ts_ms", "source_ts_ms", "schema_name", "table_name", "topic_name",
            "object_date", "object_hour", "is_delete"]


def landed_orders(spark, d, layout, since=None, until=None):
    """Land the orders change events in a layout and return the normalized
    read of the files, or of a range of landing hours."""
    root = scratch_path(spark, "bronze")
    BR.write_bronze(BR.order_change_events(spark, d), root, layout, "orders")
    return CDC.normalize_events(BR.load_raw_events(spark, root, "orders", layout, S.ORDER_ROW_SCHEMA, since, until))


@register("cdc_normalize")
def q_cdc_normalize(spark, d):
    """S2-S4, S9 layout, C1-C4: every landed change event, normalized."""
    ev = landed_orders(spark, d, "topics")
    return ev.select(*CDC_META, "payload.*")


@register("cdc_window")
def q_cdc_window(spark, d):
    """The change events landed from 06:00 to 12:00, whose folders alone are read."""
    ev = landed_orders(spark, d, "raw-cdc", "2024-06-01 06", "2024-06-01 12")
    return ev.select(*CDC_META, "payload.*")


@register("cdc_current_state")
def q_cdc_current_state(spark, d):
    """S8 raw layout, D4, C5, C6, W1: current orders after r/u/d events."""
    ev = landed_orders(spark, d, "raw-cdc")
    return CDC.current_state(ev, "orders").drop("_object_name")


@register("cdc_event_union")
def q_cdc_event_union(spark, d):
    """Orders events (topic-sink layout) and interaction creates
    (default bronze layout) in one frame; the payload structs are merged."""
    orders = landed_orders(spark, d, "topics")
    root = scratch_path(spark, "bronze")
    ev = BR.interaction_create_events(spark, d)
    BR.write_bronze(ev, root, "bronze", "interactions")
    row = ev.schema["after"].dataType
    inter = CDC.normalize_events(BR.load_raw_events(spark, root, "interactions", "bronze", row))
    u = CDC.union_events([orders, inter])
    key = F.coalesce(F.col("payload.o_orderkey"), F.col("payload.event_id"))
    return u.select(*CDC_META, key.alias("row_key"))


# --- feed reads --------------------------------------------------------------------

FEED_OFFSET, FEED_LIMIT, FEED_VIEWER = 10, 20, 7


@register("feed_page")
def q_feed_page(spark, d):
    """One feed page (offset 10, limit 20) for viewer 7."""
    return FD.feed_page(FX.posts(spark, d), FX.users(spark, d), FX.post_media(spark, d),
                        FX.comments(spark, d), FX.interactions(spark, d),
                        offset=FEED_OFFSET, limit=FEED_LIMIT, viewer_id=FEED_VIEWER)


@register("feed_with_comments")
def q_feed_with_comments(spark, d):
    """L1 with W5: the feed page, each post with its newest comments (one row each here)."""
    users, comments = FX.users(spark, d), FX.comments(spark, d)
    page = FD.feed_page(FX.posts(spark, d), users, FX.post_media(spark, d), comments, FX.interactions(spark, d),
                        offset=FEED_OFFSET, limit=FEED_LIMIT, viewer_id=FEED_VIEWER)
    rows = FD.feed_with_comments(page, comments, users)
    return rows.select("post_id", "title", "author_username", F.explode_outer("comments").alias("c")).select(
        "post_id", "title", "author_username", F.col("c.rank").cast("long").alias("rank"), "c.comment_id", "c.username",
        "c.body_text", "c.commented_at")


@register("top_comments")
def q_top_comments(spark, d):
    """The three newest comments of every post."""
    return FD.top_comments(FX.comments(spark, d), FX.users(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@register("post_comments")
def q_post_comments(spark, d):
    """L2: the newest 50 comments of every post."""
    return FD.post_comments(FX.comments(spark, d), FX.users(spark, d)).withColumn("rank",
                                                                                F.col("rank").cast("long"))


# --- profiles --------------------------------------------------------------------
@register("user_dimension")
def q_user_dimension(spark, d):
    """Authors and commenters with counts and type."""
    return PR.user_dimension(FX.posts(spark, d), FX.comments(spark, d))


@register("interest_profile")
def q_interest_profile(spark, d):
    """Tag scores per user from comments and interactions."""
    return PR.interest_profile(FX.posts(spark, d), FX.comments(spark, d), FX.interactions(spark, d))


@register("interest_match")
def q_interest_match(spark, d):
    """Interest score of every interacted (user, post) pair."""
    posts, inter = FX.posts(spark, d), FX.interactions(spark, d)
    pairs = inter.filter(F.col("user_id").isNotNull() & F.col("post_id").isNotNull())
    prof = PR.interest_profile(posts, FX.comments(spark, d), inter)
    return PR.interest_match(pairs, prof, posts)


@register("table_counts")
def q_table_counts(spark, d):
    """Row counts of the core tables."""
    return PR.table_counts({"users": FX.users(spark, d), "posts": FX.posts(spark, d),
                            "comments": FX.comments(spark, d), "interactions": FX.interactions(spark, d),
                            "post_media": FX.post_media(spark, d)})


@register("interest_keywords")
def q_interest_keywords(spark, d):
    """First ten interest words per author/commenter."""
    return PR.interest_keywords(FX.posts(spark, d), FX.comments(spark, d))


# --- scalar functions over whole tables ---------------------------------------------
@register("hashed_ids")
def q_hashed_ids(spark, d):
    """seed and web user ids; name lookup key."""
    u = FX.users(spark, d)
    return u.select("user_id", X.make_id("user", "username").alias("seed_user_id"),
                    X.normalized_user_id("username").alias("web_user_id"),
                    X.equals_ignore_case("username", F.upper("username")).alias("name_matches_upper"))


@register("tag_display")
def q_tag_display(spark, d):
    """display chips of every post."""
    p = FX.posts(spark, d)
    return p.select("post_id", F.array_join(X.display_tags("tags", "categories"), " ").alias("display_tags"))


@register("list_parse")
def q_list_parse(spark, d):
    """tolerant keyword-list parse of every user."""
    u = FX.users(spark, d)
    kw = X.parse_json_list("interest_keywords")
    return u.select("user_id", X.join_list(kw, ", ").alias("kw_text"), F.size(kw).alias("kw_count"))


# --- streaming: speed layer and raw landing --------------------------------------------

def speed_run(spark, d, *states) -> SpeedLayer:
    """Land the change feed in two drops, work off the first, then pick up the
    second by a restart from the same checkpoints."""
    work = scratch_path(spark, "speed")
    layer = SpeedLayer(spark, f"{work}/state")
    first, _ = CF.land_lines(spark, d, f"{work}/in")
    for path in (first, f"{work}/in/drop=*"):
        layer.run(text_values(spark, path), states)
    return layer


@register("trending_state")
def q_trending_state(spark, d):
    """Global trending score of every post."""
    return speed_run(spark, d, "trending").trending()


@register("trending_topn")
def q_trending_topn(spark, d):
    """L3: the 11 top trending posts (score desc, member desc)."""
    return speed_run(spark, d, "trending").trending_top()


@register("recent_views")
def q_recent_views(spark, d):
    """Every user's newest-first list, capped at 100."""
    return speed_run(spark, d, "recent_views").recent_views()


@register("recent_views_read")
def q_recent_views_read(spark, d):
    """L4: LRANGE 0 10 of every user's list."""
    return speed_run(spark, d, "recent_views").recent_views_read()


@register("coldstart_meta")
def q_coldstart_meta(spark, d):
    """Per-post field maps (exploded)."""
    return speed_run(spark, d, "coldstart").coldstart_meta()


@register("coldstart_scores")
def q_coldstart_scores(spark, d):
    """T5: cold-start score set (ts_ms, else source.ts_ms)."""
    return speed_run(spark, d, "coldstart").coldstart_scores()


@register("event_outcomes")
def q_event_outcomes(spark, d):
    """Events per outcome class, malformed included, as the stream's metrics observed them."""
    return speed_run(spark, d, "outcomes").outcomes()


@register("dead_letters")
def q_dead_letters(spark, d):
    """The malformed lines, from the stream's second sink."""
    return speed_run(spark, d, "outcomes").dead_letters()


@register("routed_events")
def q_routed_events(spark, d):
    """Every line of the feed, unwrapped, with its table, op, ids, time and outcome."""
    return EN.parse_envelopes(CF.change_lines(spark, d)).select("op", "table", "user_id", "post_id", "event_ts_ms", "outcome")


@register("raw_landing")
def q_raw_landing(spark, d):
    """The raw lander stream; every landed record (17 fields but the
    ingestion time; of the row images, the keys they hold)."""
    work = scratch_path(spark, "landing")
    CF.land_all(spark, d, f"{work}/in")
    LD.land(text_values(spark, f"{work}/in/drop*"), f"{work}/out", f"{work}/ckpt")
    landed = LD.read_landed(spark, f"{work}/out")
    key = lambda c: F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in ("o_orderkey", "event_id", "post_id")])
    kept = [f.name for f in S.RAW_RECORD_SCHEMA.fields if f.name not in ("ingested_at", "before", "after")]
    return landed.select(*kept, key("before").alias("before_key"), key("after").alias("after_key"),
                         F.get_json_object("after", "$.title").alias("after_title"))


# --- vectors -------------------------------------------------------------------------

FIXTURE_VECTOR_DIM = 64   # width of the given `embeddings` table


@register("user_text")
def q_user_text(spark, d):
    """The text a user is encoded from."""
    return VE.user_text(FX.users(spark, d))


@register("post_text")
def q_post_text(spark, d):
    """The text a post is encoded from."""
    return VE.post_text(FX.posts(spark, d))


def _vector_summary(col: str, prefix: str):
    """Exact scalar view of a float vector for the DuckDB check: width, L2
    norm, sum and first component (all from the float32 values)."""
    v = F.col(col)
    return [F.size(v).alias(f"{prefix}_dim"), VE.l2_norm(v).alias(f"{prefix}_norm"),
            F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")).alias(f"{prefix}_sum"),
            F.element_at(v, 1).cast("double").alias(f"{prefix}_first")]


@register("l2_normalize")
def q_l2_normalize(spark, d):
    """Unit-length float32 vectors (shown by width, norm, sum, first value)."""
    v = FX.vectors(spark, d)
    unit = v.select("id", "label", VE.l2_norm("text_embedding").alias("norm"),
                    VE.l2_normalize("text_embedding").alias("unit"))
    return unit.select("id", "label", "norm", *_vector_summary("unit", "unit"))


@register("embedding_mapping")
def q_embedding_mapping(spark, d):
    """Post id -> image flag and image vector (zeros when missing)."""
    media = FX.post_media(spark, d)
    pf = (FX.posts(spark, d).select("post_id").join(FE.post_image(media), "post_id", "left")
          .withColumn("has_image", F.col("object_key").isNotNull()))
    img = VE.image_vectors(pf, media, FX.vectors(spark, d), FIXTURE_VECTOR_DIM)
    return img.select("post_id", "has_image", *_vector_summary("image_embedding", "image"))


TEXT_DIM = 384


def _encoder(spark, d):
    """The default encoder's model, fitted on users and posts."""
    return VE.fit_hashing_encoder(VE.user_text(FX.users(spark, d)), VE.post_text(FX.posts(spark, d)), dim=TEXT_DIM)


class LetterCounts:
    """A model small enough to check by hand: how often each of a to z stands in a lower-cased text."""

    def __call__(self, texts):
        import numpy as np

        return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], dtype=np.float32)


@register("model_encode")
def q_model_encode(spark, d):
    """Every post's text through a plugged-in model, as batch inference (shown by width, norm and entries)."""
    rows = VE.encode_with(VE.post_text(FX.posts(spark, d)), LetterCounts, dim=26, normalize=False)
    v = F.col("text_embedding")
    return rows.select("post_id", F.size(v).alias("dim"), VE.l2_norm(v).alias("norm"),
                       *[v[i].cast("double").alias(f"v{i}") for i in (0, 4, 13, 18, 25)])


@register("text_encode")
def q_text_encode(spark, d):
    """Every post's text encoded by the default encoder; the entries that
    are not zero, to six places."""
    w = VE.hashing_weights(VE.post_text(FX.posts(spark, d)), _encoder(spark, d), "post_id")
    return w.withColumn("weight", F.round("weight", 6))


@register("text_mapping")
def q_text_mapping(spark, d):
    """The user and post mappings, both encoded by one model (shown by
    width, norm and three entries)."""
    model = _encoder(spark, d)
    out = None
    for kind, texts, key in (("user", VE.user_text(FX.users(spark, d)), "user_id"), ("post", VE.post_text(FX.posts(spark, d)), "post_id")):
        m = VE.hashing_encoder(texts, model)
        m = VE.user_mapping(m) if kind == "user" else m.select("post_id", "text_embedding")
        v = F.col("text_embedding")
        rows = m.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.size(v).alias("dim"),
                        F.round(VE.l2_norm(v), 5).alias("norm"),
                        *[F.round(F.element_at(v, i).cast("double"), 5).alias(f"v{i}") for i in (1, 100, 384)])
        out = rows if out is None else out.unionByName(rows)
    return out


# --- raw post rows and comment extraction ------------------------------------------------


@register("comment_tree")
def q_comment_tree(spark, d):
    """N1, N3 (+ N2 through the dispatch), F21: comments of every raw post row."""
    return CM.comment_rows(RP.raw_posts(spark, d))


@register("deep_threads")
def q_deep_threads(spark, d):
    """Comments of threads that are thousands of replies deep."""
    return CM.comment_rows(RP.deep_posts(spark, d))


@register("deep_post_rows")
def q_deep_post_rows(spark, d):
    """N4 on the deep threads: the comments counted from the cell."""
    return CM.post_rows(RP.deep_posts(spark, d)).select("post_id", "title", "comments_count")


@register("comment_repr_rows")
def q_comment_repr_rows(spark, d):
    """Comments of the rows whose cell is Python-repr text."""
    raw = RP.raw_posts(spark, d)
    keyed = raw.select(X.make_id("post", CM.raw_post_key()).alias("post_id"), "comments").filter(
        F.try_parse_json("comments").isNull())
    return CM.comments_from_repr(keyed, "post_id", "comments").select(*CM.COMMENT_COLUMNS)


@register("post_rows")
def q_post_rows(spark, d):
    """Staging post rows from raw dataset rows."""
    return CM.post_rows(RP.raw_posts(spark, d))


# --- C8: silver as a stream ---------------------------------------------------------------


@register("cdc_stream_state")
def q_cdc_stream_state(spark, d):
    """The orders feed streamed as a snapshot drop (r) then a changes
    drop (u, d), folded incrementally; equals the batch current state."""
    work = scratch_path(spark, "silver-stream")
    lines = CF.order_changes_with_op(spark, d)
    layer = SilverStream(spark, f"{work}/state", {"orders": S.ORDER_ROW_SCHEMA})
    lines.select("value", F.when(F.col("op") == "r", 0).otherwise(1).alias("drop")).write.options(**CF.LINE_FILES).partitionBy("drop").text(f"{work}/in")
    for path in (f"{work}/in/drop=0", f"{work}/in/drop=*"):
        layer.run(text_values(spark, path))
    return layer.state("orders")
