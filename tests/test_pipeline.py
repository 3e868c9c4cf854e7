"""End to end: change feed -> raw lander stream -> bronze -> silver -> gold
-> embeddings, on the smallest tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import schemas as S
from feedlake.plans import jobs
from feedlake.session import scratch_path
from feedlake.sources import changefeed as CF
from feedlake.sources import fixtures as FX
from feedlake.streaming import landing as LD
from feedlake.streaming.speed import text_values

D = "/root/testdata/sf0.001"


def _row_schema(df):
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])


def test_stream_to_gold(spark):
    work = scratch_path(spark, "test-pipeline")
    CF.land_lines(spark, D, f"{work}/in")
    LD.land(text_values(spark, f"{work}/in/drop*"), f"{work}/bronze", f"{work}/ckpt")
    # payload values are strings in the stream (ids as text); posts keep their types
    inter_schema = _row_schema(FX.interactions(spark, D))
    post_schema = _row_schema(FX.posts(spark, D))
    schemas = {"interactions": inter_schema, "posts": post_schema, "orders": S.ORDER_ROW_SCHEMA}
    silver = f"{work}/silver"
    jobs.silver_stage(spark, f"{work}/bronze", "raw-cdc", silver, schemas)
    inter = spark.read.parquet(f"{silver}/interactions")
    assert inter.count() == FX.interactions(spark, D).count()
    assert spark.read.parquet(f"{silver}/orders").count() == spark.read.parquet(f"{D}/orders.parquet").filter(
        F.col("o_orderkey") % 11 != 0).count()
    # users / post_media come from the adapters directly (no change feed for them)
    jobs.write_dataframe(FX.users(spark, D), f"{silver}/users")
    jobs.write_dataframe(FX.post_media(spark, D), f"{silver}/post_media")
    jobs.write_dataframe(FX.comments(spark, D), f"{silver}/comments")
    gold = f"{work}/gold"
    out = jobs.gold_stage(spark, silver, gold)
    tp = spark.read.parquet(out["training_pairs"])
    labels = spark.read.parquet(out["interaction_labels"])
    assert tp.count() == labels.count() > 0
    assert {"user_num_views", "post_num_views", "label"} <= set(tp.columns)
    emb = jobs.embeddings_stage(spark, silver, gold, f"{work}/emb", text_dim=32, image_dim=8)
    pm = spark.read.parquet(emb["post_embeddings_mapping"])
    assert pm.count() == FX.posts(spark, D).count()
    assert pm.select(F.size("image_embedding").alias("n")).distinct().collect()[0].n == 8


def test_gold_cli(spark):
    """The pipeline CLI runs the gold stage on silver tables."""
    work = scratch_path(spark, "test-cli")
    silver = f"{work}/silver"
    for name, df in {"users": FX.users(spark, D), "posts": FX.posts(spark, D), "post_media": FX.post_media(spark, D),
                     "comments": FX.comments(spark, D), "interactions": FX.interactions(spark, D)}.items():
        jobs.write_dataframe(df, f"{silver}/{name}")
    jobs.main(["gold", "--silver", silver, "--gold", f"{work}/gold"])
    tp = spark.read.parquet(f"{work}/gold/training_pairs")
    assert tp.count() == spark.read.parquet(f"{work}/gold/interaction_labels").count() > 0
