"""Speed-layer event handling: the reference's seven cases, re-expressed on
DataFrames, plus the cases it lacked (wrapper, malformed, r/d ops, text
ts_ms, nested values) and replay idempotency."""

import json

import pytest
from pyspark.sql import functions as F

from feedlake.functions.text import parse_topic_list
from feedlake.session import scratch_path
from feedlake.streaming import envelope as EN
from feedlake.streaming.speed import SpeedLayer, text_values


class Feed:
    """A speed layer whose events arrive as files, a run of the streams for each arrival."""

    def __init__(self, spark, limit=100, schema=None):
        self.spark, self.schema = spark, schema
        self.root = scratch_path(spark, "test-speed")
        self.layer = SpeedLayer(spark, f"{self.root}/state", recent_views_limit=limit)
        self.drops = 0

    def arrive(self, states, *events):
        lines = [e if isinstance(e, (str, tuple)) else json.dumps(e) for e in events]
        path = f"{self.root}/in/d{self.drops}"
        if self.schema:
            self.spark.createDataFrame(lines, self.schema).coalesce(1).write.json(path)
        else:
            self.spark.createDataFrame([(e,) for e in lines], "value string").coalesce(1).write.text(path)
        self.drops += 1
        self.again(states)
        return self.layer

    def again(self, states):
        """A restart: new queries on the same checkpoints."""
        source = f"{self.root}/in/d*"
        self.layer.run(self.spark.readStream.schema(self.schema).json(source) if self.schema else text_values(self.spark, source), states)


def _interaction(user="42", post="10001", op="c", ts=None):
    after = {"event_id": "e1", "interaction_type": "view"}
    if user is not None:
        after["user_id"] = user
    if post is not None:
        after["post_id"] = post
    env = {"op": op, "after": after, "source": {"table": "interactions"}}
    if ts is not None:
        env["ts_ms"] = ts
    return env


def _post(ts_ms="absent", source_ts="absent", op="c", **fields):
    after = {"post_id": "p1", "title": "Hello", "canonical_url": None, "comments_count": 3}
    after.update(fields)
    source = {"table": "posts"}
    if source_ts != "absent":
        source["ts_ms"] = source_ts
    env = {"op": op, "after": after, "source": source}
    if ts_ms != "absent":
        env["ts_ms"] = ts_ms
    return env


def test_topic_parse():
    assert parse_topic_list(" a.b , ,c ,") == ["a.b", "c"]
    assert parse_topic_list("") == []
    assert parse_topic_list(None) == []


def test_interaction_create_updates_trending_and_recent_views(spark):
    layer = Feed(spark).arrive(("trending", "recent_views", "outcomes"), _interaction())
    assert [tuple(r) for r in layer.trending().collect()] == [("10001", 1.0)]
    assert [tuple(r) for r in layer.recent_views().collect()] == [("42", "10001", 0)]
    assert {r.outcome: r.n for r in layer.outcomes().collect()} == {EN.INTERACTION: 1}


def test_recent_views_newest_first_with_duplicates_and_cap(spark):
    feed = Feed(spark, limit=3)
    feed.arrive(["recent_views"], *[_interaction(post=f"p{i}", ts=1000 + i) for i in range(4)])
    layer = feed.arrive(["recent_views"], _interaction(post="p3", ts=5000), _interaction(user="7", post="x", ts=1))
    views = sorted((r.user_id, r.pos, r.post_id) for r in layer.recent_views().collect())
    # duplicates kept, trimmed to 3; a later batch is newer
    assert views == [("42", 0, "p3"), ("42", 1, "p3"), ("42", 2, "p2"), ("7", 0, "x")]
    assert sorted((r.user_id, r.post_id) for r in layer.recent_views_read(1).collect()) == [("42", "p3"), ("7", "x")]


def test_state_of_a_hot_user_is_bounded(spark):
    """A user's list holds the limit, however many views arrive."""
    feed = Feed(spark)
    layer = feed.arrive(["recent_views"], *[_interaction(post=f"p{i}", ts=i) for i in range(1500)])
    assert layer.state("recent_views", "views").select(F.size("list_value")).first()[0] == 100
    assert sorted(int(r.post_id[1:]) for r in layer.recent_views().collect()) == list(range(1400, 1500))


def test_post_creates_metadata_and_score(spark):
    """T4, T5: the metadata of every post; the score by ts_ms, else the source's time, else none."""
    states = ("coldstart", "outcomes")
    layer = Feed(spark).arrive(states, _post(ts_ms=1710000000123, source_ts=1700000000000), _post(source_ts=1700000000000, post_id="p2"), _post(post_id="p3"))
    meta = {(r.post_id, r.field): r.value for r in layer.coldstart_meta().collect()}
    assert meta["p1", "canonical_url"] == "" and meta["p1", "comments_count"] == "3" and meta["p1", "title"] == "Hello" and len(meta) == 12
    assert {r.post_id: r.score for r in layer.coldstart_scores().collect()} == {"p1": 1710000000123.0, "p2": 1700000000000.0}
    assert {r.outcome: r.n for r in layer.outcomes().collect()} == {EN.POST_WITH_SCORE: 2, EN.POST_WITHOUT_SCORE: 1}


def test_later_posts_overwrite_fields_and_keep_the_others(spark):
    feed = Feed(spark)
    feed.arrive(["coldstart"], _post(ts_ms=10, only="first"))
    layer = feed.arrive(["coldstart"], _post(title="New"))        # without a time: the score stays
    assert {r.field: r.value for r in layer.coldstart_meta().collect()} == {"post_id": "p1", "title": "New", "canonical_url": "", "comments_count": "3", "only": "first"}
    assert [tuple(r) for r in layer.coldstart_scores().collect()] == [("p1", 10.0)]


def test_ignored_events(spark):
    """Ops but create, missing ids."""
    events = [e for op in "urd" for e in (_post(op=op, ts_ms=1), _interaction(op=op))]
    events += [_interaction(user=None), _interaction(post=None), {"op": "c", "after": {"title": "no id"}, "source": {"table": "posts"}, "ts_ms": 1}]
    layer = Feed(spark).arrive(SpeedLayer.STATES, *events)
    assert layer.trending().count() == 0 and layer.coldstart_meta().count() == 0 and layer.recent_views().count() == 0
    assert {r.outcome: r.n for r in layer.outcomes().collect()} == {EN.IGNORED: 9}


def test_payload_wrapper_malformed_text_ts_and_nested_values(spark):
    events = [
        {"payload": _interaction(post="w1")},                                   # wrapped
        "not json at all",                                                     # malformed
        _post(ts_ms="1710000000123", source_ts=1700000000000, tags={"a": [1, 2]}),  # text ts, nested
    ]
    layer = Feed(spark).arrive(SpeedLayer.STATES, *events)
    assert [r.post_id for r in layer.trending().collect()] == ["w1"]
    assert [r.value for r in layer.dead_letters().collect()] == ["not json at all"]
    # a text ts_ms is not a number: the source time is used
    assert [r.score for r in layer.coldstart_scores().collect()] == [1700000000000.0]
    meta = {r.field: r.value for r in layer.coldstart_meta().collect()}
    assert json.loads(meta["tags"]) == {"a": [1, 2]}


def test_restart_counts_once(spark):
    """A restart goes on from the checkpoint; what it has read it does not read again."""
    feed = Feed(spark)
    feed.arrive(("trending", "outcomes"), _interaction(), _interaction())
    feed.again(("trending", "outcomes"))
    layer = feed.arrive(("trending", "outcomes"), _interaction(), "broken")
    feed.again(("trending", "outcomes"))
    assert [tuple(r) for r in layer.trending().collect()] == [("10001", 3.0)]
    assert {r.outcome: r.n for r in layer.outcomes().collect()} == {EN.INTERACTION: 3, EN.MALFORMED: 1}
    assert [r.value for r in layer.dead_letters().collect()] == ["broken"]


def test_stream_equals_batch_over_small_batches(spark):
    """The same events in one batch and in many give the same state."""
    src = scratch_path(spark, "test-stream-in")
    events = [json.dumps(_interaction(post=f"p{i % 3}", ts=i)) for i in range(20)]
    spark.createDataFrame([(e,) for e in events], "value string").repartition(4).write.text(src)
    for cap in (None, 1):
        layer = SpeedLayer(spark, scratch_path(spark, "test-speed"))
        layer.run(text_values(spark, src, cap), ["trending"])
        assert sorted(tuple(r) for r in layer.trending().collect()) == [("p0", 7.0), ("p1", 7.0), ("p2", 6.0)]
        assert [r.post_id for r in layer.trending_top(1).collect()] == ["p1"]


def _change(op, k, v, ts, **source):
    row = {"event_id": k, "v": v}
    env = {"op": op, "ts_ms": ts, "source": {"table": "interactions", "ts_ms": ts, **source}}
    env["before" if op == "d" else "after"] = row
    return json.dumps(env)


@pytest.mark.parametrize("cut", [(9,), (2, 4, 9), (1, 2, 3, 4, 5, 6, 7, 8, 9)])
def test_silver_stream_any_order_and_cut(spark, cut):
    """Late, equal-time and late-after-delete changes give the batch state, however the batches are cut."""
    from pyspark.sql import types as T
    from feedlake.streaming.silver import SilverStream

    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("v", T.StringType())])
    changes = [_change("r", 1, "a", 1), _change("r", 2, "x", 1), _change("d", 2, "x", 3), json.dumps({"payload": json.loads(_change("u", 1, "b", 2))}),
               _change("u", 2, "late", 2), _change("c", 3, "first", 5, lsn=1), _change("u", 3, "second", 5, lsn=2), _change("d", 4, None, 7), _change("u", 4, "same time", 7)]
    root = scratch_path(spark, "test-silver")
    layer = SilverStream(spark, f"{root}/state", {"interactions": schema})
    begin = 0
    for n, end in enumerate(cut):
        spark.createDataFrame([(c,) for c in changes[begin:end]], "value string").coalesce(1).write.text(f"{root}/in/d{n}")
        begin = end
        if len(cut) < 9:
            layer.run(text_values(spark, f"{root}/in/d*"))
    if len(cut) == 9:
        layer.run(text_values(spark, f"{root}/in/d*", 1))         # a batch a line
    assert sorted((r.event_id, r.v) for r in layer.state("interactions").collect()) == [(1, "b"), (3, "second")]


def test_arrival_order_is_the_logs_order(spark):
    """Inside a batch the offset decides, not the event time, and the
    cut of the batches does not matter."""
    events = [(_post(ts_ms=t, title=f"v{o}"), o) for o, t in ((3, 10), (1, 30), (2, 20))]
    rows = [(json.dumps(e), 0, o, 1000) for e, o in events]
    ordered = sorted(rows, key=lambda r: r[2])
    states = []
    for parts in ([rows], [ordered[:1], ordered[1:]]):
        feed = Feed(spark, schema="value string, partition int, offset long, kafka_timestamp long")
        for part in parts:
            layer = feed.arrive(["coldstart"], *part)
        meta = {r.field: r.value for r in layer.coldstart_meta().collect()}
        states.append((meta["title"], [tuple(r) for r in layer.coldstart_scores().collect()]))
    assert states == [("v3", [("p1", 10.0)])] * 2


def test_stream_state_runs_no_python(spark):
    """The cold-start and silver states fold in Spark's own aggregates: no Python call for each key of a batch."""
    from feedlake.streaming.silver import SilverStream
    from pyspark.sql import types as T

    root = scratch_path(spark, "test-plan")
    spark.createDataFrame([(json.dumps(_post(ts_ms=1)),)], "value string").coalesce(1).write.text(f"{root}/in")
    values = text_values(spark, f"{root}/in")
    queries = [SpeedLayer(spark, f"{root}/speed").start("coldstart", values),
               SilverStream(spark, f"{root}/silver", {"interactions": T.StructType([T.StructField("event_id", T.LongType())])}).start("interactions", values)]
    for query in queries:
        query.awaitTermination()
        plan = query._jsq.explainInternal(False)
        assert "StateStoreSave" in plan and "Python" not in plan and "TransformWithState" not in plan


def test_lines_and_landed_files_are_packed(spark):
    """Stream inputs and landed records are written packed; a landed row comes back as it was."""
    import glob

    from feedlake.sources import changefeed as CF
    from feedlake.streaming import landing as LD

    root = scratch_path(spark, "test-packed")
    CF.land_all(spark, "/root/testdata/sf0.001", f"{root}/in")
    LD.land(text_values(spark, f"{root}/in/drop*"), f"{root}/out", f"{root}/ckpt")
    local = root.replace("file:", "")
    named = lambda at: [f for f in glob.glob(f"{local}/{at}/**/part-*", recursive=True)]
    assert named("in") and all(f.endswith(".lz4") for f in named("in"))
    assert named("out") and all(f.endswith(".json.gz") for f in named("out"))
    lines = spark.read.text(f"{root}/in").where("try_parse_json(value) is not null").count()
    assert LD.read_landed(spark, f"{root}/out").count() == lines
