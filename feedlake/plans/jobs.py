"""Pipeline drivers: bronze -> silver -> gold -> embeddings, and the two streams.

Each stage reads tables and writes tables (S5/S6, S11), so lineage is cut at
every stage boundary and a lost executor only re-runs tasks of the current
stage.  Inside the gold stage the (user_id, post_id) interaction grain is
written once and read by the user, post and label builders.

    python -m feedlake.plans.jobs silver --bronze ROOT --layout raw-cdc --silver OUT
    python -m feedlake.plans.jobs gold --silver DIR --gold OUT
    python -m feedlake.plans.jobs embeddings --silver DIR --gold DIR --out OUT
    python -m feedlake.plans.jobs speed --source PATH --state OUT
    python -m feedlake.plans.jobs land --source PATH --bronze ROOT --checkpoint CKPT
    python -m feedlake.plans.jobs silver-stream --source PATH --state OUT --schemas FILE
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import schemas as S
from feedlake.operators import cdc as CDC
from feedlake.operators import features as FE
from feedlake.operators import vectors as VE
from feedlake.session import TARGET_PARTITION_BYTES, apply_defaults, input_bytes, scratch_path, size_shuffles
from feedlake.sources import bronze as BR
from feedlake.sources.tables import read_silver


# S6 -------------------------------------------------------------------------
def write_dataframe(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """``mode`` is Spark's, or ``partitions``: only the partitions that ``df``
    has rows of are replaced, so that a day can be written again (S6, S11)."""
    if mode == "partitions" and not partition_by:
        raise ValueError("partitions are replaced by partition columns")
    w = df.write.mode("overwrite" if mode == "partitions" else mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if mode == "partitions":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


# silver ---------------------------------------------------------------------
def silver_stage(spark: SparkSession, bronze_root: str, layout: str, silver: str,
                 row_schemas: dict[str, T.StructType], tables: list[str] | None = None,
                 mode: str = "overwrite") -> dict[str, str]:
    """Read and normalize every table's change events once and write them as
    tables; the current states and the union of all events (C7) are built
    from those.  Returns the written paths."""
    apply_defaults(spark)
    tables = tables or list(row_schemas)
    size_shuffles(spark, [BR.build_input_path(bronze_root, layout, t) for t in tables])
    out, events = {}, []
    for t in tables:
        parsed = scratch_path(spark, "silver-events")
        write_dataframe(CDC.normalize_events(BR.load_raw_events(spark, bronze_root, t, layout, row_schemas[t])), parsed)
        ev = spark.read.parquet(parsed)
        events.append(ev)
        write_dataframe(CDC.current_state(ev, t), f"{silver}/{t}", mode)
        out[t] = f"{silver}/{t}"
    if events:
        write_dataframe(CDC.union_events(events), f"{silver}/events", mode)
        out["events"] = f"{silver}/events"
    return out


# gold -----------------------------------------------------------------------
#: a feature table up to so many bytes of Parquet goes to every task (it unpacks to a few times as much)
BROADCAST_BYTES = 8 << 20


def joined_features(spark: SparkSession, labels: DataFrame, features: str, key: str, scratch: str) -> DataFrame:
    """The labels with the columns of a written feature table, by ``key``.

    The table's size is known.  Up to ``BROADCAST_BYTES`` it is broadcast, so
    the labels, the largest side, are not shuffled.  Beyond, both are written
    in buckets of the key and joined bucket by bucket, which shuffles the
    labels once for the write; a key with many labels is one sorted bucket,
    streamed."""
    size = input_bytes(spark, [features])
    table = spark.read.parquet(features)
    if size <= BROADCAST_BYTES:
        return labels.join(F.broadcast(table), key, "left")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TARGET_PARTITION_BYTES)
    sides = []
    for kind, df in (("labels", labels), ("features", table)):
        name = f"bucketed_{kind}_{uuid.uuid4().hex}"
        (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{scratch}/{name}").saveAsTable(name))
        sides.append(spark.table(name))
    return sides[0].join(sides[1], key, "left")


def gold_pairs(spark: SparkSession, users: DataFrame, posts: DataFrame, inter: DataFrame, media: DataFrame, grain: DataFrame,
               gold: str, mode: str = "overwrite", joined_on_unit: str = "date") -> DataFrame:
    """User and post features and interaction labels, written under ``gold``;
    the training pairs are joined from those tables.  ``grain`` is written, too."""
    uc, pc = FE.compact_pair(FE.user_features(users, inter, grain, joined_on_unit), FE.post_features(posts, inter, media, grain))
    write_dataframe(uc, f"{gold}/user_features", mode)
    write_dataframe(pc, f"{gold}/post_features", mode)
    write_dataframe(FE.interaction_labels(inter, grain), f"{gold}/interaction_labels", mode)
    pairs = spark.read.parquet(f"{gold}/interaction_labels")
    scratch = scratch_path(spark, "buckets")
    for name, key in (("user_features", "user_id"), ("post_features", "post_id")):
        pairs = joined_features(spark, pairs, f"{gold}/{name}", key, scratch)
    first = ["user_id", "post_id"]
    return pairs.select(*first, *[c for c in pairs.columns if c not in first])


def gold_stage(spark: SparkSession, silver: str, gold: str, mode: str = "overwrite",
               joined_on_unit: str = "date") -> dict[str, str]:
    """User features, post features, interaction labels, training pairs.

    The interaction grain is materialized first (one scan + one shuffle of
    interactions) and every builder reads it back."""
    apply_defaults(spark)
    size_shuffles(spark, [f"{silver}/{n}" for n in S.CORE_TABLES])
    t = read_silver(spark, silver, S.CORE_TABLES)
    users, posts, media, inter = (FE.strip_metadata(t[n]) for n in ("users", "posts", "post_media", "interactions"))
    grain_path = scratch_path(spark, "gold-grain")
    write_dataframe(FE.interaction_grain(inter), grain_path)
    pairs = gold_pairs(spark, users, posts, inter, media, spark.read.parquet(grain_path), gold, mode, joined_on_unit)
    write_dataframe(pairs, f"{gold}/training_pairs", mode)
    return {n: f"{gold}/{n}" for n in ("user_features", "post_features", "interaction_labels", "training_pairs")}


# embeddings (E1-E6, S11) --------------------------------------------------------------
def embeddings_stage(spark: SparkSession, silver: str, gold: str, out: str, image_vectors: DataFrame | None = None,
                     encoder_factory=None, text_dim: int = 384, image_dim: int = S.IMAGE_VECTOR_DIM,
                     mode: str = "overwrite") -> dict[str, str]:
    """Text vectors for users and posts, image vectors for posts (zeros when
    a post has no image or no vector), written as id -> vector tables.
    ``has_image`` comes from the gold post features (the reference read it
    from silver, where it does not exist)."""
    apply_defaults(spark)
    t = read_silver(spark, silver, ["users", "posts", "post_media"])
    ut, pt = VE.user_text(FE.strip_metadata(t["users"])), VE.post_text(FE.strip_metadata(t["posts"]))

    model = None
    if encoder_factory is None:         # one model for both tables, so that users and posts can be compared
        model = VE.fit_hashing_encoder(ut, pt, dim=text_dim)

    def encode(df):
        if encoder_factory is None:
            return VE.hashing_encoder(df, model)
        return VE.encode_with(df, encoder_factory, dim=text_dim)

    pf = spark.read.parquet(f"{gold}/post_features").select("post_id", "has_image")
    pf = pf.join(FE.post_image(FE.strip_metadata(t["post_media"])), "post_id", "left")
    vecs = image_vectors if image_vectors is not None else spark.createDataFrame(
        [], "id string, text_embedding array<float>")
    images = VE.image_vectors(pf, FE.strip_metadata(t["post_media"]), vecs, image_dim)
    write_dataframe(VE.user_mapping(encode(ut)), f"{out}/user_embeddings_mapping", mode)
    write_dataframe(VE.post_mapping(encode(pt), images), f"{out}/post_embeddings_mapping", mode)
    return {n: f"{out}/{n}" for n in ("user_embeddings_mapping", "post_embeddings_mapping")}


# streams --------------------------------------------------------------------------------
def speed_job(spark: SparkSession, values: DataFrame, state_root: str, available_now: bool = False,
              trigger: str = "15 seconds", recent_views_limit: int = S.RECENT_VIEWS_LIMIT):
    """The speed layer over ``values``: one query per state, each with its
    checkpoint under ``state_root``.  Returns the layer and its running
    queries (none once everything there is has been worked off)."""
    from feedlake.streaming.speed import SpeedLayer

    apply_defaults(spark)
    layer = SpeedLayer(spark, state_root, recent_views_limit)
    if available_now:
        layer.run(values)
        return layer, []
    return layer, [layer.start(name, values, False, trigger) for name in layer.STATES]


def land_job(spark: SparkSession, values: DataFrame, bronze_root: str, checkpoint: str,
             available_now: bool = False, flush_seconds: int = 15, max_records_per_file: int = 0,
             layout: str = "raw-cdc", table: str | None = None):
    from feedlake.streaming import landing as LD

    apply_defaults(spark)
    return LD.land(values, bronze_root, checkpoint, layout, table, max_records_per_file, available_now, flush_seconds)


def silver_stream_job(spark: SparkSession, values: DataFrame, state_root: str,
                      row_schemas: dict[str, T.StructType], available_now: bool = False,
                      trigger: str = "15 seconds"):
    """C8 as a stream: change events -> per-table current state in the state store."""
    from feedlake.streaming.silver import SilverStream

    apply_defaults(spark)
    layer = SilverStream(spark, state_root, row_schemas)
    if available_now:
        layer.run(values)
        return layer, []
    return layer, [layer.start(table, values, False, trigger) for table in row_schemas]


def _load_schemas(path: str) -> dict[str, T.StructType]:
    import json

    with open(path) as f:
        return {k: T._parse_datatype_string(v) for k, v in json.load(f).items()}


def main(argv: list[str] | None = None) -> None:
    from feedlake.functions.text import parse_topic_list
    from feedlake.streaming.speed import kafka_values, text_values

    ap = argparse.ArgumentParser(prog="feedlake.plans.jobs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("silver")
    s.add_argument("--bronze", required=True)
    s.add_argument("--layout", default="raw-cdc", choices=BR.LAYOUTS)
    s.add_argument("--silver", required=True)
    s.add_argument("--schemas", required=True, help="JSON file: table -> row schema (DDL string)")
    s.add_argument("--tables", default="")
    s.add_argument("--mode", default="overwrite", choices=("overwrite", "append", "error", "ignore"))
    g = sub.add_parser("gold")
    g.add_argument("--silver", required=True)
    g.add_argument("--gold", required=True)
    g.add_argument("--mode", default="overwrite", choices=("overwrite", "append", "error", "ignore"))
    e = sub.add_parser("embeddings")
    e.add_argument("--silver", required=True)
    e.add_argument("--gold", required=True)
    e.add_argument("--out", required=True)
    for name in ("speed", "land", "silver-stream"):
        p = sub.add_parser(name)
        p.add_argument("--source", required=True, help="text folder, or kafka://host:port/topic1,topic2")
        p.add_argument("--bronze" if name == "land" else "--state", required=True)
        p.add_argument("--max-files-per-trigger", type=int, default=1000, help="bounds a micro-batch of a text folder")
        p.add_argument("--max-offsets-per-trigger", type=int, default=5_000_000, help="bounds a micro-batch of Kafka")
        if name == "speed":
            p.add_argument("--recent-views-limit", type=int, default=S.RECENT_VIEWS_LIMIT)
        if name == "land":
            p.add_argument("--checkpoint", required=True)
            p.add_argument("--max-records-per-file", type=int, default=0)
            p.add_argument("--flush-seconds", type=int, default=15)
            p.add_argument("--layout", default="raw-cdc", choices=("raw-cdc", "topics"))
            p.add_argument("--table", default=None, help="the table to land in the topics layout")
        if name == "silver-stream":
            p.add_argument("--schemas", required=True, help="JSON file: table -> row schema (DDL string)")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"feedlake-{a.cmd}").getOrCreate()
    if a.cmd == "silver":
        silver_stage(spark, a.bronze, a.layout, a.silver, _load_schemas(a.schemas), parse_topic_list(a.tables) or None, a.mode)
    elif a.cmd == "gold":
        gold_stage(spark, a.silver, a.gold, a.mode)
    elif a.cmd == "embeddings":
        embeddings_stage(spark, a.silver, a.gold, a.out)
    else:
        if a.source.startswith("kafka://"):
            host, _, topics = a.source[len("kafka://"):].partition("/")
            values = kafka_values(spark, host, parse_topic_list(topics), a.max_offsets_per_trigger)
        else:
            values = text_values(spark, a.source, a.max_files_per_trigger)
        if a.cmd == "speed":
            speed_job(spark, values, a.state, recent_views_limit=a.recent_views_limit)
        elif a.cmd == "silver-stream":
            silver_stream_job(spark, values, a.state, _load_schemas(a.schemas))
        else:
            land_job(spark, values, a.bronze, a.checkpoint, flush_seconds=a.flush_seconds,
                     max_records_per_file=a.max_records_per_file, layout=a.layout, table=a.table)
        spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
