"""Plan shapes that the scale design relies on (checked on the physical plan)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_or_nested_loop_joins(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["cdc_current_state", "top_comments", "post_comments", "interest_keywords"])
def test_keyed_top_n_is_limited_before_the_shuffle(spark, name):
    plan = _plan(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_feed_page_cuts_on_narrow_columns(spark, monkeypatch):
    """The head is ranked and cut without any post body."""
    from pyspark.sql.classic.dataframe import DataFrame

    heads, checkpoint = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **b: heads.append(self._jdf.queryExecution().executedPlan().toString()) or checkpoint(self, *a, **b))
    E.queries()["feed_page"](spark, SF_SMALL)
    assert len(heads) == 1 and "TakeOrderedAndProject" in heads[0]
    assert not [ln for ln in heads[0].split("\n") if "documents.parquet" in ln and "text" in ln.partition("ReadSchema")[2]]


@pytest.mark.parametrize("name", ["top_comments", "post_comments"])
def test_comments_are_cut_before_the_only_shuffle(spark, name):
    """Bodies travel for at most n rows a post and task: nothing but broadcasts below the partial limit, comments are
    scanned once and shuffled once."""
    lines = _plan(spark, name).split("\n")
    ranked = max(i for i, ln in enumerate(lines) if "WindowGroupLimit" in ln)
    assert "Partial" in lines[ranked] and sum("conversations.parquet" in ln and "text" in ln for ln in lines) == 1
    own = next(i for i, ln in enumerate(lines) if i > ranked and "conversations.parquet" in ln and "text" in ln)
    assert not [ln for ln in lines[ranked:own] if "Exchange" in ln and "Broadcast" not in ln and ln.index("Exchange") <= lines[own].index("FileScan")]


def test_comments_of_many_users_rank_without_bodies(spark, monkeypatch):
    from feedlake.operators import feed as FD

    few = sorted(map(str, E.queries()["top_comments"](spark, SF_SMALL).collect()))
    monkeypatch.setattr(FD, "MAX_BROADCAST_USERS", 10)
    many = E.queries()["top_comments"](spark, SF_SMALL)
    assert sorted(map(str, many.collect())) == few
    lines = many._jdf.queryExecution().executedPlan().toString().split("\n")
    below = lines[max(i for i, ln in enumerate(lines) if "WindowGroupLimit" in ln):]
    assert "text" not in next(ln for ln in below if "Scan" in ln and "conversations" in ln).partition("ReadSchema")[2]


def test_training_pairs_do_not_shuffle_labels(spark, monkeypatch):
    """Small feature tables go to the labels; large ones meet them bucket by bucket."""
    from feedlake.plans import jobs

    few = E.queries()["training_pairs"](spark, SF_SMALL)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan
    want = sorted(map(str, few.collect()))
    monkeypatch.setattr(jobs, "BROADCAST_BYTES", 0)
    many = E.queries()["training_pairs"](spark, SF_SMALL)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "hashpartitioning" not in plan and "Bucketed: true" in plan
    assert sorted(map(str, many.collect())) == want


def test_landing_time_range_opens_its_folders_only(spark):
    """The range is a filter on partition columns."""
    plan = _plan(spark, "cdc_window")
    scan = next(ln for ln in plan.split("\n") if "FileScan json" in ln)
    filters = scan.partition("PartitionFilters: [")[2].partition("], PushedFilters")[0]
    assert "hour" in filters and ">= 2024-06-01 06" in filters and "< 2024" in filters


def test_encoder_does_not_shuffle(spark):
    """A text's vector comes from its own row; only the given tables' joins exchange rows."""
    plan = _plan(spark, "text_encode")
    assert plan.count("Exchange hashpartitioning") <= _plan(spark, "post_text").count("Exchange hashpartitioning")


def test_scans_read_only_needed_columns(spark):
    df = E.queries()["top_comments"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    conv_scan = [ln for ln in plan.split("\n") if "conversations.parquet" in ln or "conv_id" in ln and "Scan" in ln]
    assert conv_scan and all("role" not in ln for ln in conv_scan)
