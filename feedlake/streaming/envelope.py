"""Change-event text -> routed, classified events (T1, T5 time rule, T6, T7).

Input is a DataFrame with a string ``value`` column (Kafka value cast to
text, or lines of a file stream).  Parsing uses VARIANT so the exact JSON
node kinds survive: a numeric ``ts_ms`` is usable, a text one is not (D14);
nested values keep their JSON text in the field map (F20).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# outcome classes
INTERACTION = "INTERACTION"
POST_WITH_SCORE = "POST_WITH_SCORE"
POST_WITHOUT_SCORE = "POST_WITHOUT_SCORE"
IGNORED = "IGNORED"
MALFORMED = "MALFORMED"

_NUMERIC = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def _get(v, path: str, type_: str) -> Column:
    return F.try_variant_get(v, path, type_)


def _present(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def as_long(v: Column) -> Column:
    """A JSON number that fits a long (text is not accepted)."""
    kind = F.schema_of_variant(v)
    numeric = kind.isin(*_NUMERIC) | kind.startswith("DECIMAL")
    return F.when(_present(v) & numeric, v.try_cast("long"))


def unwrapped(value: Column) -> tuple[Column, Column]:
    """(the line's JSON, null if malformed; the envelope, its ``payload`` where it has one)."""
    root = F.try_parse_json(value)
    payload = _get(root, "$.payload", "variant")
    return root, F.when(_present(payload), payload).otherwise(root)


def source_ms(env: Column) -> Column:
    return as_long(_get(env, "$.source.ts_ms", "variant"))


def event_ms(env: Column) -> Column:
    """The envelope's time, else its source's (T5)."""
    return F.coalesce(as_long(_get(env, "$.ts_ms", "variant")), source_ms(env))


def parse_envelopes(values: DataFrame, allowed_ops: tuple[str, ...] = ("c",)) -> DataFrame:
    """Columns added: op, table, after (variant), ts_ms, user_id, post_id,
    event_ts_ms (ts_ms else source.ts_ms), outcome."""
    # step by step: each part is worked out once and then read by name
    df = values.withColumn("_root", F.try_parse_json("value")).withColumn("_payload", _get(F.col("_root"), "$.payload", "variant"))
    df = df.withColumn("_env", F.when(_present(F.col("_payload")), F.col("_payload")).otherwise(F.col("_root"))).drop("_payload")
    e = F.col("_env")
    after = _get(e, "$.after", "variant")
    df = df.select(
        "*",
        _get(e, "$.op", "string").alias("op"),
        _get(e, "$.source.table", "string").alias("table"),
        after.alias("after"),
        event_ms(e).alias("event_ts_ms"),
        _get(after, "$.user_id", "string").alias("user_id"),
        _get(after, "$.post_id", "string").alias("post_id"),
    )
    has_after = _present(F.col("after"))
    is_user = _present(_get(F.col("after"), "$.user_id", "variant"))
    is_post = _present(_get(F.col("after"), "$.post_id", "variant"))
    routed = F.col("op").isin(*allowed_ops) & has_after
    outcome = (F.when(F.col("_root").isNull(), F.lit(MALFORMED))
               .when(routed & (F.col("table") == "interactions") & is_user & is_post, F.lit(INTERACTION))
               .when(routed & (F.col("table") == "posts") & is_post & F.col("event_ts_ms").isNotNull(),
                     F.lit(POST_WITH_SCORE))
               .when(routed & (F.col("table") == "posts") & is_post, F.lit(POST_WITHOUT_SCORE))
               .otherwise(F.lit(IGNORED)))
    return df.withColumn("outcome", outcome).drop("_root", "_env")


def field_map(after: Column) -> Column:
    """F20 on a variant object: null -> '', scalar -> text, nested -> JSON."""
    m = F.try_variant_get(after, "$", "map<string,string>")
    return F.transform_values(m, lambda k, v: F.coalesce(v, F.lit("")))
