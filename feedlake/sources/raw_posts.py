"""Raw post rows as the seed dataset carries them (input of N1-N4).

One row per comment thread: a conversation turn t with t % 3 = 0 opens a
thread, turn t+1 replies to it and turn t+2 replies to that reply.  Threads
alternate between a JSON blob (nested ``replies``; the three levels use
different key names, the last reply has no id and its ``replies`` holder is
an object) and the Python-repr text form with ``datetime.datetime(...)``
values.  Post fields come from the document with doc_id = conv_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.sources import fixtures as FX
from feedlake.sources.tables import read_table

# fixed values of the raw-post adapter
THREAD_SPAN = 3
AUTHOR_MODULUS = 150
_JSON = {"ignoreNullFields": "true"}


def _turn_time(conv: Column, turn: Column) -> Column:
    return (F.lit(FX.BASE_TIME).cast("timestamp")
            + F.make_dt_interval(hours=conv.cast("int"), mins=(turn * 7).cast("int"), secs=(turn * 5 % 60).cast("int")))


def _py_str(text: Column) -> Column:
    """Python repr body of a text (inside single quotes)."""
    esc = F.regexp_replace(text, r"\\", r"\\\\")
    esc = F.regexp_replace(esc, "'", r"\\'")
    esc = F.regexp_replace(esc, "\n", r"\\n")
    return esc


def _repr_comment(cid: Column, author: Column, ts: Column, text: Column, parent: Column) -> Column:
    args = F.concat_ws(", ", F.year(ts).cast("string"), F.month(ts).cast("string"),
                       F.dayofmonth(ts).cast("string"), F.hour(ts).cast("string"), F.minute(ts).cast("string"),
                       F.when(F.second(ts) != 0, F.second(ts).cast("string")))
    par = F.when(parent.isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), parent, F.lit("'")))
    return F.concat(F.lit("{'comment_id': '"), cid, F.lit("', 'author': '"), author,
                    F.lit("', 'timestamp': datetime.datetime("), args,
                    F.lit("), 'content': '"), _py_str(text), F.lit("', 'parent_id': "), par, F.lit("}"))


def raw_posts(spark: SparkSession, base: str) -> DataFrame:
    conv = read_table(spark, base, "conversations").select("conv_id", "turn", "text")
    t0 = conv.filter(F.col("turn") % THREAD_SPAN == 0).select(
        "conv_id", F.col("turn").alias("t"), F.col("text").alias("x0"))
    t1 = conv.select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("x1"))
    t2 = conv.select("conv_id", (F.col("turn") - 2).alias("t"), F.col("text").alias("x2"))
    th = t0.join(t1, ["conv_id", "t"], "left").join(t2, ["conv_id", "t"], "left")

    c, t = F.col("conv_id"), F.col("t")

    def cid(k: int) -> Column:
        return F.concat(F.lit("c"), c.cast("string"), F.lit("_"), (t + k).cast("string"))

    def who(k: int) -> Column:
        return F.concat(F.lit("user_"), ((c * 7 + t + k) % AUTHOR_MODULUS).cast("string"))

    def when_iso(k: int) -> Column:
        return F.date_format(_turn_time(c, t + k), "yyyy-MM-dd'T'HH:mm:ss")

    grand = F.struct(who(2).alias("name"), F.col("x2").alias("body"), when_iso(2).alias("timestamp"),
                     cid(1).alias("parent_id"))
    child = F.struct(cid(1).alias("id"), who(1).alias("username"), F.col("x1").alias("text"),
                     when_iso(1).alias("created_at"), cid(0).alias("parent_id"),
                     F.when(F.col("x2").isNotNull(), grand).alias("replies"))
    root = F.struct(cid(0).alias("comment_id"), who(0).alias("author"), F.col("x0").alias("content"),
                    when_iso(0).alias("date"),
                    F.when(F.col("x1").isNotNull(), F.array(child)).otherwise(F.array()).alias("replies"))
    as_json = F.to_json(F.array(root), _JSON)
    reprs = [F.when(F.col(x).isNotNull(), _repr_comment(cid(k), who(k), _turn_time(c, t + k), F.col(x),
                                                         cid(k - 1) if k else F.lit(None).cast("string")))
             for k, x in enumerate(["x0", "x1", "x2"])]
    as_repr = F.concat(F.lit("["), F.concat_ws(", ", *reprs), F.lit("]"))
    thread = (t / THREAD_SPAN).cast("long")
    blob = F.when((c + thread) % 2 == 0, as_json).otherwise(as_repr)

    docs = read_table(spark, base, "documents").select(F.col("doc_id").alias("conv_id"), "text", "lang", "source",
                                                        "n_chars")
    pages = read_table(spark, base, "pages").select(F.col("page_id").alias("conv_id"), "url")
    rows = th.select("conv_id", thread.alias("thread"), blob.alias("comments")) \
        .join(docs, "conv_id", "left").join(pages, "conv_id", "left")
    # one index per (conversation, thread), however many threads there are
    idx = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("thread").cast("string"))
    image = F.col("url")
    pick = (F.col("conv_id") + F.col("thread")) % 3
    return rows.select(
        idx.alias("index"),
        F.concat(F.coalesce(F.substring_index("text", "\n", 1), F.lit("untitled")), F.lit(" #"),
                 F.col("thread").cast("string")).alias("title"),
        F.col("url"),
        F.concat(F.lit("author_"), (F.col("conv_id") % AUTHOR_MODULUS).cast("string")).alias("author"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("excerpt"),
        F.concat(F.lit('["'), F.col("source"), F.lit('"]')).alias("categories"),
        F.concat(F.lit('["'), F.col("lang"), F.lit('"]')).alias("tags"),
        F.when(F.col("thread") % 2 == 0, F.date_format(_turn_time(F.col("conv_id"), F.lit(0)), "yyyy-MM-dd"))
        .alias("published_at"),
        F.date_format(_turn_time(F.col("conv_id"), F.lit(1)), "yyyy-MM-dd").alias("date"),
        F.when(pick == 0, image).alias("featured_image"),
        F.when(pick == 1, image).alias("image"),
        F.when(pick == 2, image).alias("image_url"),
        F.col("comments"),
        F.lit(None).cast("int").alias("comments_count"),
    )


#: conversations whose turns make one deep thread
CHAINED = 500


def deep_posts(spark: SparkSession, base: str) -> DataFrame:
    """Raw post rows with one thread each, in which every turn of ``CHAINED``
    neighbouring conversations replies to the turn before it: thousands of
    levels, in the nested JSON form."""
    conv = read_table(spark, base, "conversations").select("conv_id", "turn", "text")
    c, t = F.col("conv_id"), F.col("turn")
    key = F.concat(F.lit("d"), c.cast("string"), F.lit("_"), t.cast("string"))
    fields = F.to_json(F.struct(key.alias("id"), F.concat(F.lit("user_"), ((c * 7 + t) % AUTHOR_MODULUS).cast("string")).alias("author"),
                                F.col("text").alias("text"), F.date_format(_turn_time(c, t), "yyyy-MM-dd'T'HH:mm:ss").alias("date")), _JSON)
    # the object without its closing brace, its replies left open
    head = F.concat(F.expr("substring(fields, 1, length(fields) - 1)"), F.lit(', "replies": ['))
    threads = (conv.withColumn("fields", fields).select((c / CHAINED).cast("long").alias("thread"), c, t, head.alias("head"))
               .groupBy("thread").agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn", "head"))).alias("turns")))
    cell = F.concat(F.lit("["), F.array_join(F.col("turns.head"), ""), F.expr("repeat(']}', size(turns))"), F.lit("]"))
    none = lambda kind="string": F.lit(None).cast(kind)
    return threads.select(
        F.concat(F.lit("deep_"), F.col("thread").cast("string")).alias("index"), F.concat(F.lit("deep thread "), F.col("thread").cast("string")).alias("title"),
        none().alias("url"), F.lit("author_0").alias("author"), none().alias("content"), none().alias("excerpt"), none().alias("categories"),
        none().alias("tags"), none().alias("published_at"), F.lit("2024-01-01").alias("date"), none().alias("featured_image"), none().alias("image"),
        none().alias("image_url"), cell.alias("comments"), none("int").alias("comments_count"))
