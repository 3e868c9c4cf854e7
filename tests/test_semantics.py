"""Operator semantics on small hand-made frames: the decisions of SURVEY
§2.12 (D1-D14) and edge cases of the scalar functions."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import schemas as S
from feedlake.functions import text as X
from feedlake.operators import cdc as CDC
from feedlake.operators import comments as CM
from feedlake.operators import features as FE
from feedlake.operators import feed as FD
from feedlake.operators import staging as ST
from feedlake.operators import vectors as VE
from feedlake.session import scratch_path
from feedlake.sources import bronze as BR
from feedlake.sources import staging as SS


def one(df, col):
    return [r[col] for r in df.collect()]


# scalar functions ------------------------------------------------------------------
def test_word_count_and_list_parsers(spark):
    df = spark.createDataFrame([(None,), ("",), ("a  b",), ("['x' 'y']",), ('["j", "k"]',), ("['p', 'q']",),
                                ("[broken",)], "s string")
    out = df.select(X.word_count("s").alias("wc"), X.parse_str_list("s").alias("l"),
                    X.parse_json_list("s").alias("j")).collect()
    assert [r.wc for r in out] == [None, 1, 3, 2, 2, 2, 1]
    assert [r.l for r in out] == [[], [], ["a  b"], ["x", "y"], ["j", "k"], ["p", "q"], ["broken"]]
    assert [r.j for r in out][4] == ["j", "k"] and [r.j for r in out][6] == []


def test_ids_tags_and_images(spark):
    import hashlib
    df = spark.createDataFrame([(" Alice ", "http://x/img.PNG?s=1", "a, bb ccc|dddd")], "u string, url string, t string")
    r = df.select(X.make_id("user", "u").alias("seed"), X.normalized_user_id("u").alias("web"),
                  X.image_filename("url", F.lit("p1")).alias("img"), X.split_tags("t").alias("tags")).first()
    assert r.seed == "user_" + hashlib.md5(b" Alice ").hexdigest()[:12]
    assert r.web == "user_" + hashlib.md5(b"alice").hexdigest()[:12]
    assert r.img == "p1.png"
    assert r.tags == ["ccc", "dddd"]


def test_datetime_repr_and_first_non_empty(spark):
    df = spark.createDataFrame([("2024, 1, 2, 3, 4",), ("2024, 1, 2, 3, 4, 5, 600",), ("bad",), ("2024, 13, 1",)],
                               "s string")
    assert one(df.select(X.parse_datetime_repr("s").alias("d")), "d") == [
        "2024-01-02T03:04:00", "2024-01-02T03:04:05.000600", "bad", "2024, 13, 1"]
    df2 = spark.createDataFrame([(None, "", "x")], "a string, b string, c string")
    assert df2.select(X.first_non_empty("a", "b", "c").alias("v")).first().v == "x"


def test_field_map_keeps_nested_json(spark):
    df = spark.createDataFrame([('{"a": null, "b": 1.50, "c": {"d": [1]}}',)], "s string")
    m = df.select(X.field_map("s").alias("m")).first().m
    assert m == {"a": "", "b": "1.5", "c": '{"d":[1]}'}


# features --------------------------------------------------------------------------
def _inter(spark, rows):
    schema = ("event_id long, user_id long, post_id long, interaction_type string, occurred_at_raw string, "
              "session_id string, device_type string, source_surface string, dwell_time_seconds int")
    return spark.createDataFrame(rows, schema)


def test_mode_tie_break_is_repeatable_under_permutation(spark):
    """Ties go to the greater value, null loses; input order does not matter."""
    rows = [(i, 1, 1, "view", None, "s", d, None, None) for i, d in enumerate(["web", "mobile", None, None, "web",
                                                                                  "mobile"])]
    for seed in range(3):
        df = _inter(spark, rows).orderBy(F.rand(seed)).repartition(3)
        assert one(FE.mode_of(df, "user_id", "device_type", "m"), "m") == ["web"]
        assert one(FE.user_dimensions(df), "preferred_surface") == [None]


def test_latest_interaction_tie_break_and_labels(spark):
    rows = [(1, 1, 1, "like", "2024-01-01T00:00:00", "s", "web", "feed", None),
            (2, 1, 1, "view", "2024-01-01T00:00:00", "s", "web", "feed", 45),
            (3, 1, 1, "view", None, "s", "web", "feed", 10),
            (4, None, 1, "view", "2024-01-02T00:00:00", "s", "web", "feed", 1)]
    lab = FE.interaction_labels(_inter(spark, rows)).collect()
    assert len(lab) == 1  # the null user is not a label row
    assert lab[0].label == 2.0 and lab[0].event_id == 2  # time tie -> greater event_id


def test_tenure_units(spark):
    """D3: a typed date, and the reference's epoch-ms reading as an option."""
    df = spark.createDataFrame([("2026-05-08", 19800)], "d string, ms long")
    r = df.select(X.tenure_days(F.col("d").cast("date")).alias("a"),
                  X.tenure_days_from_epoch_ms("ms").alias("b")).first()
    assert r.a == 10 and r.b == 20591


# CDC -------------------------------------------------------------------------------------
def test_table_keys_are_declared():
    """D1."""
    import pytest

    assert CDC.table_keys("interactions") == ["event_id"]
    with pytest.raises(KeyError):
        CDC.table_keys("unknown")


def test_object_name_parsing(spark):
    """Fields of the path, per layout."""
    cases = [("raw/topics/postgres.public.post_media/year=2024/month=01/day=02/hour=03/x.json", "postgres.public.post_media"),
             ("raw-cdc/topic=feedlake_cdc_public_post_media/date=2024-01-02/hour=03/x.json", "feedlake_cdc_public_post_media"),
             ("bronze/postgres.public.post_media/x.json", "postgres.public.post_media")]
    out = []
    for name, topic in cases:
        df = spark.createDataFrame([(name,)], "_object_name string")
        out.append(tuple(BR.with_path_fields(df, topic, "post_media").select("path_table", "topic_name", "path_schema", "object_date", "object_hour").first()))
    assert out == [("post_media", "postgres.public.post_media", "public", "2024-01-02", "03"),
                   ("post_media", "feedlake_cdc_public_post_media", None, "2024-01-02", "03"),
                   ("post_media", "postgres.public.post_media", "public", None, None)]


def _events(spark, data):
    """(op, ts_ms, before, after, object, lsn) as the reader hands them over."""
    row = "struct<k:long,v:string>"
    df = spark.createDataFrame(data, f"op string, ts_ms long, before {row}, after {row}, _object_name string, lsn long")
    df = df.withColumn("source", F.struct(F.lit("public").alias("schema"), F.lit("t").alias("table"), F.lit(None).cast("long").alias("ts_ms")))
    return CDC.normalize_events(BR.with_path_fields(df, "postgres.public.t", "t"))


def test_current_state_latest_wins_then_deletes_drop(spark):
    data = [("r", 1, None, (1, "a"), "o1", None), ("u", 2, (1, "a"), (1, "b"), "o1", None),
            ("r", 1, None, (2, "x"), "o1", None), ("d", 3, (2, "x"), None, "o1", None),
            ("r", 5, None, (3, "p"), "o1", 8), ("u", 5, None, (3, "q"), "o1", 9),     # equal times: the log's position
            ("d", 6, (4, "y"), None, "o1", None), ("u", 6, None, (4, "y"), "o1", None),  # nothing else tells: the delete
            ("c", 1, None, (5, "m"), "o1", None), ("d", 10, (5, "m"), None, "o2", None), ("u", 5, None, (5, "n"), "o3", None)]
    for seed in range(3):       # whatever the order and the files of the input
        ev = _events(spark, data).orderBy(F.rand(seed)).repartition(seed + 1)
        state = CDC.current_state(ev, "t", ["k"])
        assert sorted((r.k, r.v) for r in state.collect()) == [(1, "b"), (3, "q")]
    kept = CDC.current_state(_events(spark, data), "t", ["k"], keep_deletes=True)
    assert sorted((r.k, r.is_delete) for r in kept.collect()) == [(1, False), (2, True), (3, False), (4, True), (5, True)]


def test_scratch_needs_a_shared_folder_off_local_mode():
    """Without spark.checkpoint.dir, only a local master may use this machine's folders."""
    import pytest

    from feedlake import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Session(), "x")


def test_bronze_round_trip_all_layouts(spark):
    """S2-S4, S8/S9 batch form: every layout reads back to the same events."""
    base = "/root/testdata/sf0.001"
    ev = BR.order_change_events(spark, base)
    n = ev.count()
    for layout in BR.LAYOUTS:
        root = scratch_path(spark, "test-bronze")
        BR.write_bronze(ev, root, layout, "orders")
        back = CDC.normalize_events(BR.load_raw_events(spark, root, "orders", layout, S.ORDER_ROW_SCHEMA))
        assert back.count() == n
        assert back.filter(F.col("table_name") != "orders").count() == 0
        assert back.filter(~F.col("_object_name").startswith(layout + "/")).count() == 0


def test_csv_staging_round_trip(spark):
    """Quoted multi-line text survives the CSV staging scan."""
    path = scratch_path(spark, "test-csv")
    df = spark.createDataFrame([("1", "c1", "u1", "name", 'line one\nline "two", end', "", "")],
                               S.staging_schema("comments"))
    SS.write_staging_csv(df, path)
    back = SS.read_staging_csv(spark, path, "comments")
    assert back.first().comment_text == 'line one\nline "two", end'
    assert back.first().comment_time is None or back.first().comment_time == ""


def test_cascade_prune_and_rejects(spark):
    """J10 as a batch rule; P2 side output."""
    from feedlake.operators import staging as ST

    posts = spark.createDataFrame([(1,), (2,)], "post_id long")
    media = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "media_id long, post_id long")
    assert sorted(one(ST.cascade_prune(media, "post_id", posts, "post_id"), "media_id")) == [10]
    staged = spark.createDataFrame([("1", "a"), ("", "b"), ("3", "")], "user_id string, username string")
    assert sorted(one(ST.rejects(staged, ["user_id", "username"]), "username")) == ["", "b"]


# feed --------------------------------------------------------------------------------------
def test_feed_page_limits_and_viewer(spark):
    assert FD.clamp_limit(None) == 10 and FD.clamp_limit(0) == 1 and FD.clamp_limit(99) == 20
    posts = spark.createDataFrame([(i, 1, f"t{i}", None, None, None, None, f"2024-01-0{i}", None)
                                   for i in range(1, 4)],
                                  "post_id long, author_id long, title string, body_text string, excerpt string, "
                                  "tags string, categories string, published_at_raw string, canonical_url string")
    users = spark.createDataFrame([(1, "ann")], "user_id long, username string")
    media = spark.createDataFrame([(3, "k3", 1)], "post_id long, object_key string, display_order int")
    comments = spark.createDataFrame([(3, "c1", 1, "hi", None)],
                                     "post_id long, comment_id string, user_id long, body_text string, "
                                     "commented_at_raw string")
    inter = _inter(spark, [(1, 7, 3, "like", None, None, None, None, None)])
    page = FD.feed_page(posts, users, media, comments, inter, offset=0, limit=2, viewer_id=7).collect()
    assert [r.post_id for r in page] == [3, 2]
    assert page[0].viewer_has_liked and page[0].like_count == 1 and page[0].image_url == "/media/k3"
    assert page[0].has_more and page[0].next_offset == 2 and page[1].body_text == ""
    nested = FD.feed_with_comments(FD.feed_page(posts, users, media, comments, inter, 0, 2, 7), comments, users)
    assert [c.comment_id for c in nested.filter("post_id = 3").first().comments] == ["c1"]


# comments ------------------------------------------------------------------------------------
def test_comment_tree_shapes(spark):
    blob = json.dumps([
        [{"author": "a", "text": "t1", "replies": {"username": "b", "content": "t2"}}],  # nested list, dict reply
        "skip me",
        {"id": "x", "replies": [{"comment": "t4", "replies": []}]},
    ])
    df = spark.createDataFrame([("p", blob)], "post_id string, comments string")
    out = CM.extract_comments(df).orderBy("comment_id").collect()
    names = sorted(r.username for r in out)
    assert names == ["a", "anonymous_2", "anonymous_3", "b"]
    assert sorted(r.comment_text for r in out) == ["", "t1", "t2", "t4"]


def test_comment_walk_has_no_depth_or_nesting_limit(spark):
    """Lists in lists and long threads lose nothing; brackets and quotes
    inside texts do not count."""
    deep = json.dumps({"text": "leaf 199"})
    for i in reversed(range(199)):
        deep = json.dumps({"text": f"level {i} ]}}", "replies": [json.loads(deep)]})
    cells = {"p1": '[[[[[{"text":"a"}], {"text":"b"}]]], 5, {"text":"c","replies":[[{"text":"d"}],[]]}]', "p2": deep,
             "p3": '{"text":"one [[[ \\" {{", "replies":{"text":"two"}}', "p4": "[]", "p5": "7", "p6": '{"text":"x","replies":"none"}'}
    df = spark.createDataFrame(list(cells.items()), "pid string, comments string")
    got = {}
    for r in CM.flatten_comment_objects(df, "pid", "comments").collect():
        got.setdefault(r.pid, []).append(r)
    texts = {k: sorted(r.comment_text for r in v) for k, v in got.items()}
    assert texts.pop("p2") == sorted([f"level {i} ]}}" for i in range(199)] + ["leaf 199"])
    assert texts == {"p1": ["a", "b", "c", "d"], "p3": ['one [[[ " {{', "two"], "p6": ["x"]}
    order = [r.username for r in sorted(got["p1"], key=lambda r: r.comment_text)]
    assert order == ["anonymous_0", "anonymous_1", "anonymous_2", "anonymous_3"]    # depth first, lists in place


def test_deep_threads_lose_nothing(spark):
    """Thousands of levels, beyond what the JSON reader opens; texts with brackets, quotes and escapes."""
    def thread(n, text):
        head = "".join('{"text": %s, "replies": [[' % json.dumps(f"{text} {i}") for i in range(n))
        return "[" + head + "]]}" * n + "]"

    cells = {"a": thread(2000, 'x "]}{[ \\ é'), "b": thread(300, "y"), "c": thread(2000, "z") + "]", "d": thread(2000, "w")[:-2],
             "e": thread(1500, "q").replace("[[]]", "[[7, null, [], {}]]", 1), "f": "[" * 1500 + "]" * 1500}
    df = spark.createDataFrame(list(cells.items()), "post_id string, comments string")
    got = {}
    for r in CM.extract_comments(df).select("post_id", "comment_text", "username").collect():
        got.setdefault(r.post_id, []).append(r)
    want = {"a": [f'x "]}}{{[ \\ é {i}' for i in range(2000)], "b": [f"y {i}" for i in range(300)], "e": [f"q {i}" for i in range(1500)] + [""]}
    assert {k: [r.comment_text for r in sorted(v, key=lambda r: int(r.username[10:]))] for k, v in got.items()} == want
    raw = df.selectExpr("post_id AS index", "comments", "'t' AS title", *[f"cast(null AS string) AS {c}" for c in (
        "url", "author", "content", "excerpt", "categories", "tags", "published_at", "date", "featured_image", "image", "image_url")], "cast(null AS int) AS comments_count")
    counts = sorted(r.comments_count for r in CM.post_rows(raw).collect())
    assert counts == [0, 0, 0, 300, 1501, 2000]
    far = '[{"text": "t", "meta": ' + "[" * 1200 + "]" * 1200 + "}]"
    with pytest.raises(Exception, match="nests deeper"):       # not read, and not lost in silence
        CM.extract_comments(spark.createDataFrame([("p", far)], "post_id string, comments string")).collect()


def test_scan_and_walk_agree(spark, monkeypatch):
    """The token scan of deep cells gives the rows of the walk."""
    cells = ['[[[[[{"text":"a"}], {"text":"b"}]]], 5, {"text":"c","replies":[[{"text":"d"}],[]]}]', '{"text":"one [[[ \\" {{","replies":{"text":"two"}}',
             "[]", "7", '"[]"', '{"text":"x","replies":"none"}', '[{"a":{"replies":[{"text":"no"}]},"text":{"x":[1,2]}}, {"id":1.50,"\\u0072eplies":[{"id":true}]}]',
             '[{"text":"a",}]', '[{"text":"a"} {"text":"b"}]', '{"replies":[{"id":"r"}],"id":"k"}', '', '[{"text": "é\\n\\u00e9"}]',
             '[{"replies":[{"text":"p"}],"replies":[{"text":"q"}]}]']
    df = spark.createDataFrame(list(enumerate(cells)), "post_id long, comments string")
    rows = lambda: sorted(map(str, CM.extract_comments(df).collect()))
    walked = rows()
    monkeypatch.setattr(CM, "WALK_DEPTH", 0)
    assert rows() == walked and len(walked) > 10
    # what follows the value makes a scanned cell no JSON (the walk's reader stops reading before it)
    after = spark.createDataFrame([(1, '[{"text":"a"}] []'), (2, '{"x":1}}')], "post_id long, comments string")
    assert CM.extract_comments(after).count() == 0


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_csv_split_anywhere(spark, split):
    """A file is read in splits of any size, whatever its quotes hold."""
    names = [f.name for f in S.staging_schema("comments").fields]
    texts = ["plain", 'says "hi", twice ""', "two\nlines", "\n\n\n", '"\n"', "crlf\r\nkept\r", "", " x ", "é\u2028" * 30, "long\n" * 60, '""\n,"', "end\n"]
    rows = [tuple(f"{n}{i}" if n != names[4] else t for n in names) for i, t in enumerate(texts * 3)]
    path = scratch_path(spark, "test-csv")
    body = "\n".join(",".join('"' + v.replace('"', '""') + '"' if i % 2 or '"' in v or "\n" in v or "\r" in v or "," in v or v != v.strip() else v for i, v in enumerate(r, k))
                     for k, r in enumerate([tuple(names), *rows]))
    os.makedirs(path.replace("file:", ""), exist_ok=True)
    for name, text in (("a.csv", body + "\n"), ("b.csv", body.replace("\n", "\n") + "\r\n\n"), ("c.csv", ",".join(names) + "\n")):
        with open(f"{path.replace('file:', '')}/{name}", "w", newline="") as f:
            f.write(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = SS.read_staging_csv(spark, path, "comments")
        if split == "64":
            assert SS._lines(spark, path).rdd.getNumPartitions() > 20
        text = lambda r: tuple(v or "" for v in r)  # noqa: E731  an empty field is null
        assert sorted(text(r) for r in got.collect()) == sorted([r for r in rows for _ in range(2)])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bronze_folders_of_any_shape(spark):
    """Files under other folders are read recursively; a time range needs the layout's folders."""
    root = scratch_path(spark, "test-bronze")
    BR.write_bronze(BR.order_change_events(spark, "/root/testdata/sf0.001"), root, "topics", "orders")
    every = BR.load_raw_events(spark, root, "orders", "topics", S.ORDER_ROW_SCHEMA)
    loose = BR.load_raw_events(spark, root, "orders", "topics", S.ORDER_ROW_SCHEMA, recursive=True)
    assert every.columns == loose.columns and every.exceptAll(loose).isEmpty() and loose.exceptAll(every).isEmpty()
    late = BR.load_raw_events(spark, root, "orders", "topics", S.ORDER_ROW_SCHEMA, since="2024-06-01 20")
    assert sorted({r.object_hour for r in late.select("object_hour").collect()}) == ["20", "21", "22", "23"]
    assert BR.load_raw_events(spark, root, "orders", "topics", S.ORDER_ROW_SCHEMA, until="2024-06-01 00").count() == 0
    with pytest.raises(ValueError):
        BR.load_raw_events(spark, root, "orders", "topics", S.ORDER_ROW_SCHEMA, since="2024-06-01 20", recursive=True)


def test_partitions_are_replaced_not_lost(spark):
    """Writing a day again leaves the other days, twice the same."""
    from feedlake.plans.jobs import write_dataframe

    path = scratch_path(spark, "test-days")
    write_dataframe(spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [2.0])], "day string, id int, v array<float>"), path, "partitions", ["day"])
    for _ in range(2):
        write_dataframe(spark.createDataFrame([("b", 3, [3.0]), ("c", 4, None)], "day string, id int, v array<float>"), path, "partitions", ["day"])
    assert sorted((r.day, r.id) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(ValueError):
        write_dataframe(spark.range(1).toDF("id"), path, "partitions")


def test_equal_ids_keep_their_own_vectors(spark):
    """Rows that share an id are not merged."""
    df = spark.createDataFrame([("1", "a b b"), ("1", "c"), ("2", None)], "id string, text string")
    model = VE.fit_hashing_encoder(df, dim=16)
    rows = VE.hashing_encoder(df, model).collect()
    assert len(rows) == 3 and rows[0].text_embedding != rows[1].text_embedding and sum(rows[2].text_embedding) == 0
    assert all(abs(sum(x * x for x in r.text_embedding) - 1) < 1e-6 for r in rows[:2])


def test_python_literals(spark):
    """Every string escape; F4: tuples, None and quotes inside items."""
    cells = [r"a\xa0b", r"\u200b\U0001F600", r"\101\0\x41", r"\a\b\f\v\n\t\r\\\'\"", r"\q\8", "plain", "line\\\nend", "tail\\"]
    out = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select(
        "i", CM.decode_py_literal(F.col("c")).alias("d")).collect()
    assert [r.d for r in sorted(out)] == ["a\xa0b", "\u200b\U0001F600", "A\0A", "\a\b\f\v\n\t\r\\'\"", "\\q\\8", "plain", "lineend", "tail\\"]
    lists = ["['a', None]", "('a', 'b')", "('a',)", '["x", null]', "['it\\'s None', \"q, None\"]", "['a' 'b']", "", "[1, True]", "['a',]"]
    out = spark.createDataFrame([(i, c) for i, c in enumerate(lists)], "i int, c string").select("i", X.parse_str_list("c").alias("l")).collect()
    assert [r.l for r in sorted(out)] == [["a", None], ["a", "b"], ["a"], ["x", None], ["it's None", "q, None"], ["a", "b"], [], ["1", "true"], ["a"]]


def test_constraint_keys_and_rejects(spark):
    """Keys are compared part by part; numbers that are not go to the rejects."""
    like = [(i, u, p, "like", None, "s", None, None, None) for i, (u, p) in enumerate([(None, 5), (5, None), (None, 5), (1, 2), (1, 2)])]
    media = spark.createDataFrame([("m1", "a|b", "c"), ("m2", "a", "b|c"), ("m3", "a", None), ("m4", "a", None)], "media_id string, post_id string, object_key string")
    users = spark.createDataFrame([(1, "n")], "user_id long, username string")
    posts = spark.createDataFrame([(2, 1, "t")], "post_id long, author_id long, title string")
    comments = spark.createDataFrame([], "comment_id string, post_id long, user_id long")
    rows = ST.quality_report(users, posts, media, comments, _inter(spark, like)).filter("check like 'unique%'").collect()
    assert [(r.check, r.key, r.n_rows) for r in rows] == [("unique_like", "1|2|like", 2)]
    keys = media.filter("object_key is not null").select(ST.media_surrogate_key("post_id", "object_key").alias("k"))
    assert keys.distinct().count() == 2 and all(len(r.k) == 32 for r in keys.collect())
    staged = spark.createDataFrame([("1", "a", "", "12x", "3", "", ""), ("2", "b", "", "4", "", "", "")],
                                   "user_id string, username string, user_type string, num_posts string, num_comments string, interests string, created_at string")
    assert one(ST.clean_users(staged), "user_id") == ["2"]
    assert one(ST.rejects(staged, ST.USER_KEYS, ST.USER_NUMBERS), "user_id") == ["1"]


def test_raw_post_lists_and_title(spark):
    """List columns become JSON text; a missing title is post_<index>."""
    raw = spark.createDataFrame([("7", None, None, "a", "t", None, ["x", "y"], [], None, "2024", None, None, None, None, None)],
                                "index string, title string, url string, author string, content string, excerpt string, categories array<string>, "
                                "tags array<string>, published_at string, date string, featured_image string, image string, image_url string, comments string, comments_count int")
    r = CM.post_rows(raw).first()
    assert (r.title, r.categories, r.tags) == ("post_7", '["x","y"]', "[]")



def test_repr_comments_decode(spark):
    text = ("[{'comment_id': 'c1', 'author': 'bo', 'timestamp': datetime.datetime(2024, 2, 3, 4, 5), "
            "'content': 'it\\'s\\nok \\\\ yes', 'parent_id': None}, {'comment_id': '', 'author': 'al', "
            "'timestamp': datetime.datetime(2024, 2, 3, 4, 5, 6), 'content': 'x', 'parent_id': 'c1'}]")
    df = spark.createDataFrame([("p", text)], "post_id string, comments string")
    out = CM.extract_comments(df).collect()
    assert out[0].comment_text == "it's\nok \\ yes" and out[0].comment_time == "2024-02-03T04:05:00"
    assert out[1].parent_comment_id == "c1" and out[1].comment_time == "2024-02-03T04:05:06"


# vectors --------------------------------------------------------------------------------------
def test_python_encoder_hook(spark):
    import numpy as np

    def factory():
        def enc(texts):
            return np.array([[len(t), 1.0, 0.0] for t in texts], dtype=np.float32)
        return enc

    df = spark.createDataFrame([("a", "hello"), ("b", "")], "id string, text string")
    out = VE.encode_with(df, factory, dim=3, batch_size=1).orderBy("id").collect()
    assert len(out[0].text_embedding) == 3
    assert abs(sum(x * x for x in out[0].text_embedding) - 1.0) < 1e-5


def test_raw_landing_layout(spark):
    from feedlake.streaming import landing as LD
    from feedlake.streaming.speed import text_values

    src = scratch_path(spark, "test-land-in")
    lines = [json.dumps({"op": "c", "ts_ms": 1, "source": {"table": "posts"}, "after": {"post_id": "p"}}),
             json.dumps({"payload": {"op": "d", "source": {"table": "post_media"}, "before": {"media_id": 1}}})]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    root = scratch_path(spark, "test-land-out")
    LD.land(text_values(spark, src), root, scratch_path(spark, "test-land-ckpt"))
    local = root.replace("file:", "")
    topics = sorted(d for d in os.listdir(f"{local}/raw-cdc") if d.startswith("topic="))
    assert topics == ["topic=feedlake_cdc_public_post_media", "topic=feedlake_cdc_public_posts"]
    back = LD.read_landed(spark, root)
    assert sorted(back.select("op").rdd.flatMap(lambda r: r).collect()) == ["c", "d"]


def test_training_pairs_permutation_invariant(spark):
    """Shuffled input partitions give the same gold table."""
    from tools.oracle_check import digest
    from feedlake.sources import fixtures as FX

    d = "/root/testdata/sf0.001"
    base = FE.training_pairs(FX.users(spark, d), FX.posts(spark, d), FX.interactions(spark, d),
                             FX.post_media(spark, d))
    shuffled = FE.training_pairs(FX.users(spark, d), FX.posts(spark, d),
                                 FX.interactions(spark, d).orderBy(F.rand(7)).repartition(5), FX.post_media(spark, d))
    a = [tuple(r) for r in base.collect()]
    b = [tuple(r) for r in shuffled.collect()]
    assert digest(base.columns, a)[0] == digest(shuffled.columns, b)[0]


def test_hashed_parent_joins_to_comment_ids(spark):
    """Raw parent ids never matched the hashed comment ids; the added
    parent key does."""
    from feedlake.sources import raw_posts as RP

    rows = CM.comment_rows(RP.raw_posts(spark, "/root/testdata/sf0.001"))
    replies = rows.filter(F.col("parent_comment_key") != "")
    assert replies.count() > 0
    orphans = replies.join(rows.select(F.col("comment_id").alias("parent_comment_key")), "parent_comment_key",
                           "left_anti")
    assert orphans.count() == 0
    assert rows.join(rows.select(F.col("comment_id").alias("parent_comment_id")), "parent_comment_id",
                     "left_semi").count() == 0  # the raw ids alone never join


def test_raw_record_keeps_its_identity(spark):
    """Topic, partition, offset and record time pass through; a text ts_ms is no time."""
    from feedlake.streaming.landing import raw_records

    lines = [json.dumps({"op": "c", "ts_ms": "5", "source": {"table": "t", "lsn": 7, "txId": 8, "snapshot": "true"}, "after": {"k": 1}})]
    df = spark.createDataFrame([(lines[0], "other.topic", 3, 77, 1234)], "value string, topic string, partition int, offset long, kafka_timestamp long")
    r = raw_records(df).first()
    assert (r.topic, r.partition, r.offset, r.kafka_timestamp, r.event_ts_ms) == ("other.topic", 3, 77, 1234, None)
    assert (r.lsn, r.tx_id, r.snapshot) == (7, 8, "true")
    r = raw_records(df.select("value")).first()
    assert (r.topic, r.partition, r.offset, r.kafka_timestamp) == ("feedlake_cdc.public.t", 0, None, None)


def test_staging_csv_goes_by_header_names(spark):
    """Columns in another order are read by name; others are refused."""
    import pytest

    path = scratch_path(spark, "test-csv-order")
    names = S.staging_schema("comments").names
    row = spark.createDataFrame([tuple(f"<{n}>" for n in names)], S.staging_schema("comments"))
    SS.write_staging_csv(row.select(*reversed(names)), path)
    assert list(SS.read_staging_csv(spark, path, "comments").first()) == [f"<{n}>" for n in names]
    with pytest.raises(ValueError, match="expected"):
        SS.read_staging_csv(spark, path, "users")
