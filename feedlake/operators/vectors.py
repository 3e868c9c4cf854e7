"""Embedding operators.

* Text assembly (E1, E2) and L2 normalization (E4) are built-in expressions.
* The default text encoder (E3) is built-in functions too: tokens hashed to
  buckets by md5, counted, weighted by one inverse document frequency table
  fitted on all texts that are to be compared, and brought to unit length, all
  within the row.  A model of your own plugs in through ``encode_with``
  (``predict_batch_udf``: one model a worker, batches of 64 texts).
* Image vectors come from an id-keyed vector table; posts without an image,
  or whose image has no vector, get a zero vector (E5).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import schemas as S
from feedlake.functions import text as X
from feedlake.session import ship

_FLOATS = T.ArrayType(T.FloatType())


# E1 / E2 ----------------------------------------------------------------------
def user_text(users: DataFrame) -> DataFrame:
    words = X.parse_json_list("interest_keywords")
    return users.select(F.col("user_id").cast("string").alias("user_id"),
                        X.join_list(words, " ").alias("text"))


def post_text(posts: DataFrame) -> DataFrame:
    """title + first 512 chars of body + tag words + category words."""
    tags = X.join_list(X.parse_str_list("tags"), " ")
    cats = X.join_list(X.parse_str_list("categories"), " ")
    text = X.join_text(F.col("title"), X.truncate("body_text"), tags, cats)
    return posts.select(F.col("post_id").cast("string").alias("post_id"), text.alias("text"))


# E4 -------------------------------------------------------------------------
def l2_norm(vec) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    sq = F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(sq)


def l2_normalize(vec) -> Column:
    """Unit-length float32 vector (a zero vector stays zero)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)).cast("float"))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


# E3 -------------------------------------------------------------------------
# fixed values: what a token is, after A-Z are lower-cased
TOKEN_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def token_buckets(text, dim: int) -> Column:
    """Bucket (0 to dim - 1) of each token: the first eight hex digits of its md5, modulo dim."""
    tokens = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(TOKEN_PATTERN), 0)
    return F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


def fit_hashing_encoder(*texts: DataFrame, text_col: str = "text", dim: int = 384) -> list[float]:
    """One model for all the given tables, so that their vectors can be compared: the idf of each bucket, ``dim``
    numbers.  idf = 1 + ln((texts + 1) / (texts with the bucket + 1)), so a text is never zero for being alone."""
    every = reduce(DataFrame.unionByName, [t.select(token_buckets(text_col, dim).alias("b")) for t in texts])
    seen = every.select(F.explode(F.array_union(F.array_distinct("b"), F.array(F.lit(-1)))).alias("bucket"))   # -1 counts texts
    df = {r["bucket"]: r["n"] for r in seen.groupBy("bucket").agg(F.count("*").alias("n")).collect()}            # at most dim + 1 rows
    return [1 + math.log((df.get(-1, 0) + 1) / (df.get(b, 0) + 1)) for b in range(dim)]


def hashing_entries(model: list[float], text_col: str = "text") -> Column:
    """The unit vector's entries that are not zero, (bucket, weight) by bucket: all within the row."""
    idf = F.array(*[F.lit(x) for x in model])

    def entries(buckets: Column) -> Column:
        raw = F.transform(F.array_sort(F.array_distinct(buckets)), lambda b: F.struct(
            b.alias("bucket"), (F.size(F.filter(buckets, lambda x: x == b)) * F.get(idf, b)).alias("w")))
        return F.transform(F.array(raw), lambda r: _unit(r))[0]

    def _unit(r: Column) -> Column:
        length = F.sqrt(F.aggregate(r, F.lit(0.0), lambda t, x: t + x["w"] * x["w"]))
        return F.transform(F.array(length), lambda n: F.transform(r, lambda x: F.struct(x["bucket"].alias("bucket"), (x["w"] / n).alias("weight"))))[0]

    # one-element arrays name a value that is used more than once, so that it is computed once
    return F.transform(F.array(token_buckets(text_col, len(model))), entries)[0]


def hashing_weights(df: DataFrame, model: list[float], id_col: str, text_col: str = "text") -> DataFrame:
    """id, bucket, weight of the unit vectors' entries that are not zero."""
    return df.select(F.col(id_col), F.explode(hashing_entries(model, text_col)).alias("e")).select(id_col, "e.bucket", "e.weight")


def hashing_encoder(df: DataFrame, model: list[float], text_col: str = "text", out_col: str = "text_embedding") -> DataFrame:
    """Offline default encoder, all JVM-side and without a shuffle: unit float32 vectors of hashed token counts
    weighted by ``model`` (``fit_hashing_encoder``); a text without tokens has the zero vector."""
    entries = F.map_from_entries(hashing_entries(model, text_col))
    vec = F.transform(F.array(entries), lambda m: F.transform(
        F.sequence(F.lit(0), F.lit(len(model) - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)).cast("float")))[0]
    return df.withColumn(out_col, vec)


Encoder = Callable[[list[str]], "object"]  # texts -> (n, dim) float array


def encode_with(df: DataFrame, encoder_factory: Callable[[], Encoder], dim: int, text_col: str = "text",
                out_col: str = "text_embedding", batch_size: int = 64, normalize: bool = True) -> DataFrame:
    """Run a model over a text column as batch inference: ``predict_batch_udf`` calls ``encoder_factory`` once for
    each Python worker (load the model there) and hands the encoder at most ``batch_size`` texts at a time."""

    def load():
        import numpy as np

        encode = encoder_factory()

        def predict(texts):
            mat = np.asarray(encode([t or "" for t in texts.tolist()]), dtype=np.float32).reshape(-1, dim)
            if normalize:
                norms = np.linalg.norm(mat, axis=1, keepdims=True)
                mat = (mat / np.where(norms > 0, norms, 1)).astype(np.float32)
            return mat

        return predict

    ship(df.sparkSession)
    encoder = predict_batch_udf(load, return_type=_FLOATS, batch_size=batch_size)
    return df.withColumn(out_col, encoder(F.coalesce(F.col(text_col), F.lit(""))))


# E5 / E6 ----------------------------------------------------------------------
def image_vectors(post_features: DataFrame, post_media: DataFrame, vectors: DataFrame, dim: int,
                  vector_key: str = "media_id") -> DataFrame:
    """post_id (text), has_image, unit image vector or zeros.  The post's
    image is the one post features chose (W3); its vector is looked up by
    ``post_media.<vector_key>`` = vector id.  A missing vector counts as a
    failed image load: zeros."""
    keyed = post_media.select("post_id", "object_key", F.col(vector_key).cast("string").alias("_vid"))
    vec = vectors.select(F.col("id").alias("_vid"), F.col("text_embedding").alias("_img"))
    out = (post_features.select("post_id", "has_image", "object_key")
           .join(keyed, ["post_id", "object_key"], "left")
           .join(vec, "_vid", "left"))
    emb = F.when(F.col("has_image") & F.col("_img").isNotNull(), l2_normalize("_img")).otherwise(zero_vector(dim))
    return out.select(F.col("post_id").cast("string").alias("post_id"), "has_image",
                      emb.alias("image_embedding"))


def post_mapping(post_texts: DataFrame, images: DataFrame) -> DataFrame:
    """post_id -> has_image, text vector, image vector."""
    return post_texts.select("post_id", "text_embedding").join(images, "post_id", "left")


def user_mapping(user_texts: DataFrame) -> DataFrame:
    return user_texts.select(F.col("user_id").cast("string").alias("user_id"), "text_embedding")


IMAGE_DIM = S.IMAGE_VECTOR_DIM
